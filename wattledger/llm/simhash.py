"""SimHash fingerprints, linked by multi-index hashing.

A pair within ``radius`` bits of each other is within ``radius // segments`` bits in at least one segment.  So each
distinct fingerprint is entered in one table per segment under the segment's value, and looks there for the values of
a small Hamming ball around it.  Of two fingerprints whose segments differ only the one with the lower differing bit
clear looks the other up, which halves the ball.  What meets under a key is verified by whole distances.

Within a key no pairs are put out: a breadth-first search over the fingerprints that are not yet reached emits one link
for each reached one.  A key with very many fingerprints is divided into blocks, and each pair of blocks is a group of
its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattledger.llm.common import fresh, map_batches, text_bytes
from wattledger.llm.components import components
from wattledger.session import cut

BITS = 64
#: Fingerprints of one group that are compared in one go; more are divided into pairs of blocks.
BLOCK = 4096


def fingerprint_bytes(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one UTF-8 text: A-Z lower-cased, words between ASCII white space, ``shingle`` words each.

    Repeats count.  Fewer words make one shingle; no words give 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array(
            [digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64
        )
    counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", shingle: int = 3, seed: int = 42) -> DataFrame:
    """Replace the text by its fingerprint as a signed bigint.  Null and empty texts have fingerprint 0."""
    keep = [c for c in df.columns if c not in (text, out)]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out, T.LongType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint_bytes(t, shingle, seed) for t in text_bytes(batch, text)], np.uint64)
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in keep], pa.array(found.view(np.int64))], names=[*keep, out]
        )

    return map_batches(df.select(text, *keep), run, schema)


def _masks(width: int, ball: int) -> list[tuple[int, int]]:
    """(mask, its lowest bit) of every change of 1 to ``ball`` bits in a segment."""
    return [
        (sum(1 << i for i in chosen), 1 << chosen[0])
        for size in range(1, ball + 1) for chosen in combinations(range(width), size)
    ]


def lookups(fps: DataFrame, radius: int, segments: int) -> DataFrame:
    """(seg, key, fp): the table entries and the lookups of each fingerprint."""
    width, ball = BITS // segments, radius // segments
    if segments < 1 or BITS % segments or not 0 <= radius < BITS:
        raise ValueError("segments must divide 64 and the radius be less than 64")
    low = (1 << width) - 1 if width < BITS else -1
    parts = F.explode(F.array(*[
        F.struct(
            F.lit(i).alias("seg"),
            F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit(low).cast("bigint")).alias("value"),
        )
        for i in range(segments)
    ]))
    split = fps.select("fp", parts.alias("p")).select("fp", "p.seg", "p.value")
    changes = F.array(
        F.struct(F.lit(0).cast("bigint").alias("mask"), F.lit(0).cast("bigint").alias("low")),
        *[
            F.struct(F.lit(m).cast("bigint").alias("mask"), F.lit(b).cast("bigint").alias("low"))
            for m, b in _masks(width, ball)
        ],
    )
    return (
        split.select("fp", "seg", "value", F.explode(changes).alias("c"))
        .filter(F.col("value").bitwiseAND(F.col("c.low")) == 0)
        .select("seg", F.col("value").bitwiseXOR(F.col("c.mask")).alias("key"), "fp")
    )


def _reach(members: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """A forest of links that joins exactly the members within ``radius`` of each other, directly or by steps."""
    left = np.unique(members).view(np.uint64)
    while len(left) > 1:
        first = int(left[:1].view(np.int64)[0])
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                queue.extend(found)
                for x in found.view(np.int64).tolist():
                    yield x, first


def links(fps: DataFrame, radius: int = 3, segments: int = 2, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect exactly what fingerprints within ``radius`` bits connect.

    ``fps`` has one bigint column fp without repeats.  Every link is within reach by verified distances; links that
    others already imply inside a key are left out.
    """
    entries = lookups(fps, radius, segments)
    big = entries.groupBy("seg", "key").count().filter(F.col("count") > 2 * block).select(
        "seg", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks")
    )
    # Spark sizes the entries as if nothing were exploded and would broadcast them.  Big keys are at most one for
    # 2 * block entries; keys of one fingerprint are passed over below, without a join.
    placed = entries.join(F.broadcast(big), ["seg", "key"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), F.col("blocks") - 1)
    ))
    grouped = (
        placed.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", other)
        .select("seg", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
        .repartition("seg", "key", "i", "j").sortWithinPartitions("key", "seg", "i", "j")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _with_end(batches):
            if batch is not None:
                now = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(5)])
                rest = now if rest is None else np.concatenate([rest, now], axis=1)
            if rest is None or not rest.shape[1]:
                continue
            change = np.flatnonzero((rest[:4, 1:] != rest[:4, :-1]).any(0)) + 1
            bounds = np.concatenate([[0], change, [rest.shape[1]]])
            done = len(bounds) - 1 if batch is None else len(bounds) - 2
            a, b = [], []
            for k in np.flatnonzero(np.diff(bounds[: done + 1]) > 1).tolist():
                for x, y in _reach(rest[4, bounds[k] : bounds[k + 1]].copy(), radius):
                    a.append(x)
                    b.append(y)
            rest = rest[:, bounds[done] :]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return grouped.mapInArrow(run, "a bigint, b bigint")


def _with_end(batches):
    yield from batches
    yield None


def group(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42, radius: int = 3,
          segments: int = 2) -> DataFrame:
    """(key, fp, component): each row's fingerprint and the smallest key reachable by links within ``radius`` bits.

    Equal fingerprints are linked, also those of empty texts (0).  A row with a null key is returned; its component is
    the smallest key of its group, or null if the group has none.  Repeated rows come back as often as they occur.
    """
    id_, fp, component = "id", "fp", "component"
    rows = cut(fingerprints(df.select(F.col(key).alias(id_), F.col(text).alias("text")), "text", fp, shingle, seed))
    distinct = rows.groupBy(fp).agg(F.min(id_).alias("least"))
    found = components(links(distinct.select(fp), radius, segments))
    named = distinct.join(found.withColumnRenamed("node", fp), fp, "left").select(
        fp, F.coalesce("component", fp).alias("root"), "least"
    )
    least = named.groupBy("root").agg(F.min("least").alias(component))
    # Written, so that Spark can split the join where one fingerprint has very many rows.
    labels = cut(named.join(least, "root").select(fp, component))
    return rows.join(labels, fp).select(F.col(id_).alias(key), fp, component)


def hex_fingerprint(fp) -> F.Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each_group(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``df`` whose key is the smallest of its group.

    Rows with a null key stay, as nothing names another row of their group.  Repeated rows of a kept key stay.
    """
    (kept,) = fresh(df, "kept_key")
    groups = group(df, key, text, **how)
    keep = groups.filter(F.col(key) == F.col("component")).select(F.col(key).alias(kept)).distinct()
    return df.join(keep, F.col(key) == F.col(kept), "left_semi").unionByName(df.filter(F.col(key).isNull()))
