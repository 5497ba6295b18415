"""Documents of flat token files, found by their end-of-document identifiers.

A token file is nothing but ids of a fixed width in little-endian order, without an index.  It is read in blocks; each
block is searched for the end identifier by one vectorised comparison, at aligned places only.  A document may go on
over any number of blocks: a prefix maximum over the blocks' last separators tells where it began, and a prefix sum
over their counts which document of the file it is.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattledger.llm.common import map_batches
from wattledger.session import shared_dir

#: Bytes of a block.
BLOCK = 1 << 20


def write(df: DataFrame, path: str, ids: str = "ids", end: int = 50256, width: int = 2) -> None:
    """Write documents' ids as flat token files: each document's ids and then the end identifier.

    ``ids`` is a binary column of ids of ``width`` bytes; null writes no ids, only the end.  Spark's text writer puts
    the bytes out as they are, with the end identifier as line separator, to any store that Spark can reach.
    """
    mark = end.to_bytes(width, "little").decode("latin-1")
    df.select(F.coalesce(F.col(ids), F.lit(b"")).cast("string").alias("value")).write.option(
        "lineSep", mark).option("encoding", "ISO-8859-1").text(path)


def scan(spark: SparkSession, path: str, end: int = 50256, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, doc, start, n_tokens, ended) of every document of the token files under ``path``.

    ``doc`` counts a file's documents from 0, ``start`` is the first token's place in the file.  Two end identifiers in
    a row make a document without tokens.  Tokens after the last one are a document with ``ended`` false; an empty
    file has none.  A file whose size is no multiple of the width fails the job.  A file is read by one task, so it
    must stay under 2 GB, as Spark's binary file source demands.
    """
    if block % width:
        raise ValueError("a block holds whole ids")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0")
    whole = F.when(F.col("length") % width == 0, F.col("content")).otherwise(
        F.raise_error(F.concat(F.lit("not a multiple of the id width: "), F.col("path")))
    )
    blocks = files.select(
        F.col("path").alias("file"), "length", whole.alias("content"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(block).cast("bigint"))).alias("at"),
    ).select("file", "length", "at", F.expr(f"substring(content, int(at) + 1, {block})").alias("data"))
    kind = np.dtype(f"<u{width}")

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.column("at").to_pylist()
        found = [
            np.flatnonzero(np.frombuffer(d.as_py(), kind) == end) + a // width for d, a in zip(batch.column("data"), at)
        ]
        return pa.RecordBatch.from_arrays(
            [batch.column("file"), batch.column("length"), batch.column("at"), pa.array(found, pa.list_(pa.int64()))],
            names=["file", "length", "at", "ends"],
        )

    searched = map_batches(blocks, search, "file string, length bigint, at bigint, ends array<bigint>")
    before = W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    stitched = searched.withColumn("open", F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))).over(before), F.lit(-1).cast("bigint"))).withColumn(
        "docs", F.coalesce(F.sum(F.size("ends").cast("bigint")).over(before), F.lit(0).cast("bigint"))
    )
    last = F.col("at") + block >= F.col("length")
    tokens = (F.col("length") / width).cast("bigint")
    final = F.coalesce(F.try_element_at("ends", F.lit(-1)), F.col("open"))
    rest = last & (final < tokens - 1)
    ends = F.when(rest, F.array_append("ends", tokens)).otherwise(F.col("ends"))
    return (
        stitched.select("file", "docs", "open", "ends", F.posexplode(ends).alias("i", "stop"))
        .withColumn("begin", F.when(F.col("i") > 0, F.get("ends", F.col("i") - 1)).otherwise(F.col("open")) + 1)
        .select(
            "file", (F.col("docs") + F.col("i")).alias("doc"), F.col("begin").alias("start"),
            (F.col("stop") - F.col("begin")).alias("n_tokens"), (F.col("i") < F.size("ends")).alias("ended"),
        )
    )


def count_documents(df: DataFrame, key: str = "doc_id", ids: str = "ids", end: int = 50256, width: int = 2,
                    keys: DataFrame | None = None) -> DataFrame:
    """(key, n_tokens) of each row of (key, ids): its ids are written to flat files in the shared folder and counted there.

    The files hold no keys.  Rows are matched by their place: the part that wrote them and their number in it.
    ``keys`` may give the keys by a plan that is cheaper than ``df`` and has the same rows in the same places, such as
    the scan that ``df`` maps row by row.  Null and repeated keys come back as often as they occur.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(df, path, ids, end, width)
    place = F.monotonically_increasing_id()
    rows = (df if keys is None else keys).select(key).withColumn("part", F.shiftright(place, 33).cast("int")).withColumn(
        "doc", place.bitwiseAND(F.lit((1 << 33) - 1))
    )
    found = scan(spark, path, end, width).select(
        F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("int").alias("part"), "doc", "n_tokens"
    )
    return rows.join(found, ["part", "doc"]).select(key, "n_tokens")
