"""Content-defined chunking: fingerprints of documents that survive shifts, and how much of one is in another.

The gear hash of a place is a sum over the bytes before it, each shifted once more than the next; it is built by
doubling the span, for all places at once.  Boundaries are normalised: up to the wanted size a place must have more
zero bits, after it fewer, so that sizes lie near the middle.  A fingerprint is the set of the chunks' digests with
their lengths; containment is the share of a document's length whose chunks the other one has too.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattledger.llm.common import pack, unpacked

#: Least, wanted and largest bytes of a chunk; bytes that the hash of a place looks back on.
LEAST, WANTED, MOST, SPAN = 32, 96, 512, 32
#: Bits that must be zero before and after the wanted size: 1 in 256 and 1 in 32 places.
_HARD, _EASY = np.uint64(0xFF << 50), np.uint64(0x1F << 50)


def _gear() -> np.ndarray:
    """A 64-bit number for each byte, by SplitMix64 from the byte."""
    x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_GEAR = _gear()


def boundaries(data: bytes, least: int = LEAST, wanted: int = WANTED, most: int = MOST) -> list[int]:
    """Ends of the chunks of some bytes; the last is their number, none for no bytes."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    easy: list[int] = []
    hard: list[int] = []
    for begin in range(0, n, 1 << 20):  # in pieces, each with the bytes its first hashes look back on
        back = min(begin, SPAN - 1)
        h = _GEAR[np.frombuffer(data, np.uint8, min(n, begin + (1 << 20)) - begin + back, begin - back)]
        width = 1
        while width < SPAN:
            h[width:] = h[width:] + (h[:-width] << np.uint64(width))
            width *= 2
        found = np.flatnonzero((h[back:] & _EASY) == 0)
        strict = (h[back:][found] & _HARD) == 0
        easy += (found + begin + 1).tolist()
        hard += (found[strict] + begin + 1).tolist()
    ends, start = [], 0
    while n - start > least:
        limit = start + wanted
        k = bisect_left(hard, start + least)
        if k < len(hard) and hard[k] < limit:
            start = hard[k]
        else:
            k = bisect_left(easy, limit)
            start = min(easy[k] if k < len(easy) else n, start + most, n)
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunks(data: bytes) -> dict[int, int]:
    """Digest and length of the different chunks of some bytes."""
    out, start = {}, 0
    for end in boundaries(data):
        part = data[start:end]
        out[xxhash.xxh3_64_intdigest(part)] = end - start
        start = end
    return out


def fingerprint(found: dict[int, int]) -> str:
    """Digests in order, 16 hex digits each, with their lengths: ``digest:length`` joined by commas."""
    return ",".join(f"{d:016x}:{n}" for d, n in sorted(found.items()))


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of a's length that is in chunks of b; of two sets without chunks 1, of one without chunks 0."""
    if not a:
        return float(not b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def _placed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(bucket, guest, k, th, key, text): ranges of keys, each followed by the first row of the next one (guest).

    Splitters are quantiles of the keys.  A splitter and a first row per bucket go over the driver, no more.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63))).alias("k"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("th", F.xxhash64("text"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = rows.select(F.expr(f"approx_percentile(k, array({','.join(str(i / n) for i in range(1, n))}), 10000) AS m")).first()["m"]
    splitters = np.unique(np.array(marks or [], np.int64))

    @F.pandas_udf("int")
    def bucket(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, k.to_numpy(), "left").astype(np.int32))

    first = sorted(rows.groupBy(bucket("k").alias("bucket")).agg(F.max(F.struct("k", "th")).alias("first")).collect(), reverse=True)
    follows = {now["bucket"]: first[i - 1]["bucket"] for i, now in enumerate(first)}  # the one before, or the last
    schema = "bucket int, k bigint, th bigint, other int"
    heads = spark.createDataFrame([(r["bucket"], *r["first"], follows[r["bucket"]]) for r in first], schema)
    near = rows.withColumn("bucket", bucket("k"))
    # One row per bucket, and there are four times as many buckets as partitions.
    guests = near.join(F.broadcast(heads), ["bucket", "k", "th"]).select(
        F.col("other").alias("bucket"), F.lit(True).alias("guest"), "k", "th", "key", "text"
    )
    return near.select("bucket", F.lit(False).alias("guest"), "k", "th", "key", "text").union(guests)


def compare(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    ``edited`` is the text with its last half (rounded down, in code points) replaced by as many code points from the
    start of the next document's text, or all of it.  The next document has the next smaller key; after the last comes
    the first, so a single document follows itself.  A null text is empty.  Null keys come last; repeated keys are
    ordered by a hash of their texts, and a repeated row follows its double.
    """
    rows = pack(_placed(docs, key, text))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = rows.repartition(parts, "bucket").sortWithinPartitions(
        "bucket", "guest", F.col("k").desc(), F.col("th").desc()
    ).select("bucket", "guest", "key", "z")
    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in ("edited", "fingerprint", "edited_fingerprint")],
        *[T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")],
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # bucket, key, text, chunks of the row before
        for batch in batches:
            out = []
            for bucket, guest, own, body in zip(*(batch.column(c).to_pylist() for c in ("bucket", "guest", "key")), unpacked(batch)):
                if guest and (held is None or held[0] != bucket):
                    continue  # a repeated guest
                now = (bucket, own, body.decode(), chunks(body))
                if held is not None:
                    _, before, old, mine = held
                    half = len(old) // 2
                    edited = old[: len(old) - half] + now[2][:half]
                    other = chunks(edited.encode())
                    out.append((before, len(old), edited, fingerprint(mine), fingerprint(other),
                                containment(mine, other), containment(mine, now[3])))
                held = None if guest else now
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), _arrow(schema))], schema=_arrow(schema)
                )

    return ready.mapInArrow(run, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "smallint": pa.int16()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields])
