"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows handed to Python at once.  Texts are long, so batches are short.
ARROW_ROWS = 512


def prepare(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str
) -> DataFrame:
    """Apply a function batch by batch; a batch may come back empty (None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names as near to ``wanted`` as can be that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of a batch, one after the other; null counts as empty."""
    for value in batch.column(name).cast(pa.binary()):
        yield value.as_py() or b""


#: Words are what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str):
    """Number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def domain_of(source: str):
    """The domain of a source: d0 to d3 by the number its name ends in, '' without one."""
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("")).otherwise(F.concat(F.lit("d"), (number.cast("int") % 4).cast("string")))


def pack(rows: DataFrame) -> DataFrame:
    """The rows with ``z`` in place of ``text``: compressed texts, which halves what an exchange holds of them."""
    others = [f for f in rows.schema.fields if f.name != "text"]
    schema = T.StructType([*others, T.StructField("z", T.BinaryType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        small = zstandard.ZstdCompressor(level=3)
        z = [small.compress(t) for t in text_bytes(batch, "text")]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(f.name) for f in others), pa.array(z, pa.binary())], names=schema.names
        )

    return map_batches(rows, run, schema)


def unpacked(batch: pa.RecordBatch) -> list[bytes]:
    """The texts of a batch of packed rows, as UTF-8 bytes."""
    large = zstandard.ZstdDecompressor()
    return [large.decompress(z.as_py()) for z in batch.column("z")]
