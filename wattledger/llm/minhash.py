"""Near copies by the Jaccard similarity of their word shingles.

Candidates come from MinHash: texts that agree in all ``ROWS`` hashes of one of ``BANDS`` bands meet under a key.  A
pair at the limit of 0.8 shares no key with a probability of (1 - 0.8^5)^24, less than 1 in 10,000.  Every link is
verified by the exact similarity:

1. Each text under a key is compared with the key's smallest one in a join, so a group of near copies costs one
   comparison per text and key, not one per pair.
2. Where one of these fails and the key has more than two texts, a search over all texts of the key finds the links
   among them.  A key with very many texts is divided into blocks, and each pair of blocks is a group of its own.

Texts travel compressed, and shingles are taken anew where two texts meet.

Spark takes an array for one element and what is exploded for no more than it came from, so the joins of keys and pairs
are asked for as merges: by such sizes it would broadcast tables that grow with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.llm.common import fresh, map_batches, text_bytes
from wattledger.llm.components import components
from wattledger.session import cut

#: Words of a shingle, and the least similarity of near copies in percent.
WORDS, LEAST = 5, 80
#: Bands and the hashes of each.
BANDS, ROWS = 24, 5
#: Texts, and words of texts, of one group that are compared in one go, about; more are divided into pairs of blocks.
BLOCK, BLOCK_WORDS = 512, 1 << 20
#: Shingles whose hashes are taken in one go.
PIECE = 2048

_FACTORS = np.random.default_rng(20).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the different shingles: A-Z lower-cased, words between ASCII white space.

    Fewer words make one shingle; no words make none.
    """
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined)], np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64))


def band_keys(found: np.ndarray) -> list[int]:
    """One signed 64-bit key per band of a set of shingles; an empty set has none."""
    if not len(found):
        return []
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), PIECE):
        least = np.minimum(least, (_FACTORS[:, None] * found[None, at : at + PIECE]).min(1))
    keys = [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def alike(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> bool:
    """Whether two sets of shingles are near copies."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < least * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= least * (len(a) + len(b) - both)


def _sets(df: DataFrame) -> DataFrame:
    """(id, node, words, keys, z) of (id, text); node is a hash of the text's shingles, so equal sets are one node."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        small = zstandard.ZstdCompressor(level=3)
        node, words, keys, z = [], [], [], []
        for text in text_bytes(batch, "text"):
            found = shingles(text)
            node.append(xxhash.xxh64_intdigest(found.tobytes()))
            words.append(len(found))
            keys.append(band_keys(found))
            z.append(small.compress(text))
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(words, pa.int64()),
             pa.array(keys, pa.list_(pa.int64())), pa.array(z, pa.binary())],
            names=["id", "node", "words", "keys", "z"],
        )

    kind = df.schema["id"].dataType.simpleString()
    return map_batches(df, run, f"id {kind}, node bigint, words bigint, keys array<bigint>, z binary")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are near copies."""
    one, other = (texts.select(F.col("node").alias(c), F.col("z").alias(f"z{c}")).hint("merge") for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = zstandard.ZstdDecompressor()
        last, mine = None, None
        for batch in batches:
            good = []
            for a, za, zb in zip(batch.column("a").to_pylist(), batch.column("za"), batch.column("zb")):
                if a != last:
                    last, mine = a, shingles(large.decompress(za.as_py()))
                good.append(alike(mine, shingles(large.decompress(zb.as_py()))))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(other, "b").join(one, "a").select("a", "b", "za", "zb").mapInArrow(run, "a bigint, b bigint")


def reach(sets: list[np.ndarray], least: int = LEAST) -> Iterator[tuple[int, int]]:
    """A forest of links (numbers of sets) that joins exactly what near copies among the sets join."""
    left = list(range(len(sets)))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and left:
            at = queue.pop()
            near = [k for k in left if alike(sets[at], sets[k], least)]
            if near:
                taken = set(near)
                left = [k for k in left if k not in taken]
                queue.extend(near)
                yield from ((at, k) for k in near)


def _searched(members: DataFrame, texts: DataFrame, block: int, block_words: int) -> DataFrame:
    """(a, b): links among the texts of each key of (key, node)."""
    sized = members.join(texts.select("node", "words"), "node")
    big = (
        sized.groupBy("key").agg(
            F.ceil(F.greatest(F.count("*") / block, F.sum("words") / block_words)).cast("int").alias("blocks")
        ).filter("blocks > 2")
    )
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), F.col("blocks") - 1)
    ))
    grouped = (
        members.join(big, "key", "left").withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", other)
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node")
        .join(texts.select("node", "z").hint("merge"), "node").select("key", "i", "j", "node", "z")
        .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    )

    def links(nodes: list[int], packed: list[bytes]) -> pa.RecordBatch:
        large = zstandard.ZstdDecompressor()
        found = list(reach([shingles(large.decompress(z)) for z in packed]))
        return pa.RecordBatch.from_arrays(
            [pa.array([nodes[pair[i]] for pair in found], pa.int64()) for i in range(2)], names=["a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nodes, packed = None, [], []
        for batch in batches:
            for *key, node, z in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "node", "z"))):
                if key != last:
                    if len(nodes) > 1:
                        yield links(nodes, packed)
                    last, nodes, packed = key, [], []
                nodes.append(node)
                packed.append(z)
        if len(nodes) > 1:
            yield links(nodes, packed)

    return grouped.mapInArrow(run, "a bigint, b bigint")


def group(df: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, node, component): a hash of each row's shingles and the smallest key reachable over near copies.

    Texts with equal sets of shingles are linked, also those without words.  A row with a null key is returned; its
    component is the smallest key of its group, or null if the group has none.
    """
    rows = cut(_sets(df.select(F.col(key).alias("id"), F.col(text).alias("text"))))
    distinct = rows.groupBy("node").agg(F.min("id").alias("least"))
    entries = rows.select("node", F.explode("keys").alias("key")).distinct()
    # Of the keys with the same texts one is enough.
    keys = (
        entries.groupBy("key").agg(
            F.count("*").alias("n"), F.min("node").alias("first"), F.max("node").alias("last"),
            F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.hash("node").cast("bigint")).alias("s"),
        ).filter("n > 1").groupBy("n", "first", "last", "x", "s").agg(F.min("key").alias("key")).select("key", "n", "first")
    )
    # Written, so that Spark can split the joins where one text has very many near copies.
    members = cut(entries.join(keys.hint("merge"), "key").select("key", "n", "first", "node"))
    texts = cut(
        rows.join(members.select("node").distinct(), "node", "left_semi")
        .groupBy("node").agg(F.first("words").alias("words"), F.min("z").alias("z"))
    )
    pairs = members.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = cut(_verified(pairs.distinct(), texts))
    failed = cut(
        members.filter("n > 2 and node <> first")
        .join(near.select(F.col("a").alias("first"), F.col("b").alias("node")), ["first", "node"], "left_anti")
        .select("key").distinct()
    )
    rest = cut(members.join(failed, "key", "left_semi").select("key", "node"))
    found = components(near.union(_searched(rest, texts, block, block_words)))
    named = distinct.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("root"), "least")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    labels = cut(named.join(least, "root").select("node", "component"))
    return rows.select("id", "node").join(labels, "node").select(F.col("id").alias(key), "node", "component")


def one_of_each_group(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``df`` whose key is the smallest of its group.

    Rows with a null key stay, as nothing names another row of their group.  Repeated rows of a kept key stay.
    """
    (kept,) = fresh(df, "kept_key")
    keep = group(df, key, text, **how).filter(F.col(key) == F.col("component")).select(F.col(key).alias(kept)).distinct()
    return df.join(keep, F.col(key) == F.col(kept), "left_semi").unionByName(df.filter(F.col(key).isNull()))
