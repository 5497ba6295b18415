"""Hard negatives of anchors by rotated one-bit codes and exact integer scores.

Every vector becomes whole numbers.  A fixed random rotation and the signs of its coordinates give each row a code of
one bit per dimension, stored with its alignment: the inner product of the vector and its code's unit vector.  An
anchor's coordinates are rounded to PLANES bits, so that popcounts of code and bit planes estimate the anchor's inner
product with the unit vector.  What the code leaves of the row and what it leaves of the anchor are both orthogonal
to it, so Cauchy-Schwarz bounds the rest of the score by the product of their lengths: an interval that surely holds
it.  Rows whose interval cannot reach the result are left out; all others are scored with whole numbers.

Anchors and rows are dealt out as blocks of anchors and slices of rows; each pair of them is one group, of a fixed size
whatever the table's, and passes on a few rows per anchor.  A first round finds the anchors' positives, a second one
the negatives in each positive's band of scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattledger.llm.common import map_batches
from wattledger.session import cut

SCALE = 256
#: Bits of an anchor's rounded coordinates.
PLANES = 4
#: Anchors of a block, rows of a slice, and anchors that are held against a slice at a time.
ANCHORS, SLICE, TILE = 1024, 4096, 64
SEED = 11

#: Whole numbers up to here are exact in doubles.
_EXACT = 1 << 53
_NO_ID = np.iinfo(np.int64).max


def rotation(width: int, seed: int = SEED) -> np.ndarray:
    """The rotation that all tasks use."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words, padded with zeros."""
    padded = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
    return np.packbits(padded, axis=1).view(np.uint64)


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code words, alignment and squared length of each row of whole numbers."""
    turned = vectors @ turn
    return _words(turned > 0), np.abs(turned).sum(1) / np.sqrt(len(turn)), np.einsum("ij,ij->i", vectors, vectors)


def intervals(anchors: np.ndarray, codes: np.ndarray, align: np.ndarray, norm2: np.ndarray,
              turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds below and above the score of each anchor (row) with each coded vector (column)."""
    width = len(turn)
    turned = anchors @ turn
    low = turned.min(1, keepdims=True)
    step = np.maximum(turned.max(1, keepdims=True) - low, 1e-300) / ((1 << PLANES) - 1)
    rounded = np.rint((turned - low) / step).astype(np.int64)
    off = np.abs(turned - (low + step * rounded)).sum(1) / np.sqrt(width)
    ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
    met = np.zeros((len(anchors), len(codes)), np.int64)
    for j in range(PLANES):
        plane = _words((rounded >> j & 1).astype(bool))
        for w in range(codes.shape[1]):
            met += np.bitwise_count(plane[:, w, None] & codes[None, :, w]).astype(np.int64) << j
    along = (low * (2 * ones - width) + step * (2 * met - rounded.sum(1, keepdims=True))) / np.sqrt(width)
    size2 = np.einsum("ij,ij->i", anchors, anchors)[:, None]
    # Rounding in doubles: far less than this share of the largest possible value.
    slack = 1e-9 * np.sqrt(size2) * np.sqrt(norm2) + 1e-6
    off = off[:, None] + 1e-9 * np.sqrt(size2)
    rest = np.sqrt(np.maximum(0, size2 - np.maximum(0, np.abs(along) - off) ** 2))
    wide = align * off + rest * np.sqrt(np.maximum(0, norm2 - align**2)) + slack
    estimate = along * align
    return estimate - wide, estimate + wide


def scores(anchors: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly; they must fit 64 bits."""
    most = float(np.abs(anchors).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * anchors.shape[1]
    if most < _EXACT:
        return (anchors @ vectors.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape) for m in (anchors, vectors)]
    return np.array((whole[0] @ whole[1].T).tolist(), np.int64).reshape(len(anchors), len(vectors))


def _first(score: np.ndarray, ids: np.ndarray, rids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by score from high to low, then id, then row."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= least)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((rids[near], ids[near], -score[near]))[:k]]


def _column(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name)
    return column.fill_null(_NO_ID).to_numpy() if name == "id" else column.to_numpy()


def _matrix(table: pa.Table, name: str, kind: str) -> np.ndarray:
    data = b"".join(table.column(name).to_pylist())
    return np.frombuffer(data, kind).reshape(table.num_rows, -1)


def _held(kind: str, width: int, judge):
    """A function of cogrouped tables that holds the anchors of a block, some at a time, against the rows of a slice."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return judge.table([])
        turn = rotation(width)
        a_label, r_label = left.column("label").to_numpy(), right.column("label").to_numpy()
        a_vec, r_vec = (_matrix(t, "vec", kind).astype(np.float64) for t in (left, right))
        codes, align, norm2 = _matrix(right, "code", "u8"), right.column("align").to_numpy(), right.column("norm2").to_numpy()
        rows = {"id": _column(right, "id"), "rid": _column(right, "rid")}
        out: list[tuple] = []
        for label in np.unique(a_label):
            mine = np.flatnonzero(a_label == label)
            part = judge.rows(r_label == label)
            for at in range(0, len(mine) if len(part) else 0, TILE):
                these = mine[at : at + TILE]
                low, high = intervals(a_vec[these], codes[part], align[part], norm2[part], turn)
                judge.tile(left, these, rows, part, low, high, a_vec[these], r_vec, out)
        return judge.table(out)

    return run


class _Positives:
    """The k first rows of the anchor's label that are not the anchor."""

    def __init__(self, k: int):
        self.k = k

    def rows(self, same: np.ndarray) -> np.ndarray:
        return np.flatnonzero(same)

    def tile(self, left, these, rows, part, low, high, a_vec, r_vec, out):
        arid = _column(left, "arid")[these]
        other = rows["rid"][part][None, :] != arid[:, None]
        low = np.where(other, low, -np.inf)
        if low.shape[1] > self.k:
            least = np.partition(low, low.shape[1] - self.k, axis=1)[:, low.shape[1] - self.k]
        else:
            least = np.full(len(these), -np.inf)
        stays = other & (high >= least[:, None])
        some = np.flatnonzero(stays.any(0))
        exact = scores(a_vec, r_vec[part[some]])
        for i in range(len(these)):
            here = np.flatnonzero(stays[i, some])
            places = part[some[here]]
            for j in _first(exact[i, here], rows["id"][places], rows["rid"][places], self.k):
                out.append((int(arid[i]), int(rows["rid"][places[j]]), int(rows["id"][places[j]]), int(exact[i, here[j]])))

    def table(self, out):
        arid, rid, ids, score = zip(*out) if out else ((), (), (), ())
        return pa.table({
            "arid": pa.array(arid, pa.int64()), "rid": pa.array(rid, pa.int64()),
            "id": pa.array([None if x == _NO_ID else x for x in ids], pa.int64()), "score": pa.array(score, pa.int64()),
        })


class _Negatives:
    """For each positive of the anchor, the k first rows of other labels with a score in the positive's band."""

    def __init__(self, k: int, low: int, high: int):
        self.k, self.low, self.high = k, low, high

    def rows(self, same: np.ndarray) -> np.ndarray:
        return np.flatnonzero(~same)

    def tile(self, left, these, rows, part, low, high, a_vec, r_vec, out):
        arid = _column(left, "arid")[these]
        positives = [left.column("positives")[int(k)].as_py() for k in these]
        stays = np.zeros(low.shape, bool)
        for i, ps in enumerate(positives):
            for score in {p["score"] for p in ps}:
                if self.low * score <= self.high * score:
                    stays[i] |= (100 * high[i] >= self.low * score) & (100 * low[i] <= self.high * score)
        some = np.flatnonzero(stays.any(0))
        exact = scores(a_vec, r_vec[part[some]])
        for i, ps in enumerate(positives):
            here = np.flatnonzero(stays[i, some])
            value, places = exact[i, here], part[some[here]]
            for p in ps:
                # -(-a // b): the least whole number that is not below a / b.
                least, most = -(-self.low * p["score"] // 100), self.high * p["score"] // 100
                inside = np.flatnonzero((value >= least) & (value <= most))
                at = places[inside]
                for j in _first(value[inside], rows["id"][at], rows["rid"][at], self.k):
                    out.append((int(arid[i]), p["rank"], int(rows["rid"][at[j]]), int(rows["id"][at[j]]), int(value[inside[j]])))

    def table(self, out):
        arid, rank, rid, ids, score = zip(*out) if out else ((), (), (), (), ())
        return pa.table({
            "arid": pa.array(arid, pa.int64()), "prank": pa.array(rank, pa.int32()), "rid": pa.array(rid, pa.int64()),
            "id": pa.array([None if x == _NO_ID else x for x in ids], pa.int64()), "score": pa.array(score, pa.int64()),
        })


def _coded(df: DataFrame, key: str, label: str, vector: str, is_anchor: Column, scale: int) -> tuple[DataFrame, int, str]:
    """(rid, id, label, anchor, vec, code, align, norm2) of the rows that take part, their width and the vectors' type."""
    whole = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = df.select(
        F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        F.transform(vector, lambda x: x.cast("double")).alias("v"),
    ).filter(F.col("label").isNotNull() & F.col("v").isNotNull() & whole)
    state = rows.agg(
        F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("most")
    ).first()
    width, most = max(1, state["width"] or 0), scale * (state["most"] or 0.0) + 1
    if most == float("inf"):
        raise OverflowError("components are too large for whole scores")
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = np.zeros((batch.num_rows, width))
        column = batch.column("v")
        sizes = column.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        vectors[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(scale * column.flatten().to_numpy())
        codes, align, norm2 = encode(vectors, rotation(width))
        small = vectors.astype(kind)
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), batch.column("anchor"), pa.array([v.tobytes() for v in small], pa.binary()),
             pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(align), pa.array(norm2)],
            names=["id", "label", "anchor", "vec", "code", "align", "norm2"],
        )

    schema = "id bigint, label bigint, anchor boolean, vec binary, code binary, align double, norm2 double"
    return map_batches(rows, run, schema).withColumn("rid", F.monotonically_increasing_id()), width, kind


def mine(df: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding",
         positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = SCALE,
         anchors_each: int = ANCHORS, slice_rows: int = SLICE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the hard negatives of all anchors.

    Components become floor(scale * x); a score is the whole inner product with the anchor, and higher scores come
    first, ties by smaller key.  An anchor's positives are its first ``positives`` other rows of the same label; each
    one's negatives are the first ``negatives`` rows of other labels with low * positive score <= 100 * score <= high *
    positive score.  Rows with a null label, a null vector or a null or non-finite component take no part.  A vector
    shorter than the longest counts as filled up with zeros.  Rows that repeat a key are rows of their own; a null key
    comes after all others.  Scores must fit 64 bits, else the job fails.
    """
    coded, width, kind = _coded(df, key, label, vector, is_anchor, scale)
    # Written, so that row numbers stay as they are whatever is computed again.
    rows = cut(coded)
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("a")).first()
    blocks, slices = max(1, -(-sizes["a"] // anchors_each)), max(1, -(-sizes["n"] // slice_rows))
    dealt = rows.drop("anchor").withColumn("slice", F.pmod(F.xxhash64("rid"), F.lit(slices)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )

    def spread(some: DataFrame) -> DataFrame:
        return some.withColumn("block", F.pmod(F.xxhash64("arid"), F.lit(blocks)).cast("int")).withColumn(
            "slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
        )

    def held(some: DataFrame, judge, schema: str) -> DataFrame:
        return spread(some).groupBy("block", "slice").cogroup(dealt.groupBy("block", "slice")).applyInArrow(
            _held(kind, width, judge), schema
        )

    anchors = rows.filter("anchor").select(F.col("rid").alias("arid"), F.col("id").alias("anchor_id"), "label", "vec")
    best = W.partitionBy("arid").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "rid")
    found = held(anchors, _Positives(positives), "arid bigint, rid bigint, id bigint, score bigint")
    near = (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= positives)
        .groupBy("arid").agg(F.collect_list(F.struct("rank", "id", "score")).alias("positives"))
    )
    known = cut(anchors.join(near, "arid"))
    hard = held(known, _Negatives(negatives, low, high), "arid bigint, prank int, rid bigint, id bigint, score bigint")
    first = W.partitionBy("arid", "prank").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "rid")
    ranked = hard.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives)
    pairs = known.select("arid", "anchor_id", F.explode("positives").alias("p")).select(
        "arid", "anchor_id", F.col("p.rank").alias("prank"), F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score")
    )
    return ranked.join(pairs, ["arid", "prank"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def sql() -> str:
    """DuckDB SQL for the rows of the query over embeddings, by all scores of the anchors."""
    return """
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.rid AS arid, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same,
  CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.rid <> b.rid),
p AS (SELECT arid, anchor_id, rid, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id, rid) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.arid, p.rid ORDER BY s.score DESC, s.vec_id, s.rid) AS INTEGER) AS rank,
  s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (arid, anchor_id) WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
QUALIFY row_number() OVER (PARTITION BY p.arid, p.rid ORDER BY s.score DESC, s.vec_id, s.rid) <= 5"""
