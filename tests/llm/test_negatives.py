import numpy as np
import pytest
from pyspark.sql import functions as F

from wattledger.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, score int, rid string"


def plain(rows, positives=5, negatives_=5, low=80, high=100, every=10):
    """Brute force over all rows, ties by id and then by place."""
    part = []
    for place, (key, vec, label) in enumerate(rows):
        if label is None or vec is None or any(x is None or not np.isfinite(x) for x in vec):
            continue
        part.append((place, key, [int(np.floor(256 * float(np.float32(x)))) for x in vec], label))
    out = []
    for place, key, vec, label in part:
        if key is None or key % every:
            continue
        scored = [
            (-sum(a * b for a, b in zip(vec, v)), float("inf") if k is None else k, p, k, lab)
            for p, k, v, lab in part if p != place
        ]
        scored.sort(key=lambda s: s[:3])
        for pos in [s for s in scored if s[4] == label][:positives]:
            band = [s for s in scored if s[4] != label and low * -pos[0] <= 100 * -s[0] <= high * -pos[0]]
            out += [(key, pos[3], i + 1, s[3], -pos[0], -s[0]) for i, s in enumerate(band[:negatives_])]
    return sorted(out, key=str)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    got = negatives.mine(df, F.col("vec_id") % 10 == 0, **how)
    return sorted((tuple(r) for r in got.collect()), key=str)


def near_vectors(n, width, seed):
    """Vectors around a few centres, so that bands are well filled."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((4, width))
    return [(k, (centres[k % 4] + 0.5 * rng.standard_normal(width)).astype(np.float32).tolist(), int(rng.integers(3))) for k in range(n)]


@pytest.mark.parametrize("width,seed", [(64, 1), (7, 2), (70, 3)])
def test_agrees_with_brute_force_over_blocks_and_slices(spark, width, seed):
    rows = near_vectors(150, width, seed)
    want = plain(rows)
    assert want and mined(spark, rows, anchors_each=4, slice_rows=20) == want
    assert mined(spark, rows) == want


def test_odd_rows(spark):
    rows = near_vectors(40, 5, 4)
    rows += [(50, None, 1), (60, [1.0, None, 0.0, 0.0, 0.0], 1), (61, [float("nan")] * 5, 1), (62, [float("inf")] * 5, 2), (63, [1.0] * 5, None)]
    rows += [(None, rows[3][1], 0), (None, rows[0][1], 1), (70, [], 0), (71, [1.0, 2.0], 1), (80, [0.0] * 5, 2)]
    rows += [(90, [-1.0] * 5, 0), (91, [1.0] * 5, 0), (92, [-1.0] * 5, 1)]
    rows += [rows[10], rows[10]] + [(100 + k, rows[20][1], k % 3) for k in range(12)]  # repeated rows, ties
    got = mined(spark, rows, anchors_each=3, slice_rows=11)
    assert got == plain(rows)
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == []


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(k, (1e4 * rng.standard_normal(6) + 3e4).astype(np.float32).tolist(), k % 2) for k in range(40)]
    rows += [(k, [float(np.float32(3e6 + k))] * 6, k % 2) for k in range(40, 60)]
    assert mined(spark, rows) == plain(rows)


def test_intervals_hold_the_scores_and_leave_rows_out():
    rng = np.random.default_rng(6)
    for width in (16, 64, 200):
        turn = negatives.rotation(width)
        vectors = np.floor(256 * rng.standard_normal((500, width)))
        vectors[:9] = vectors[0] + np.floor(20 * rng.standard_normal((9, width)))
        vectors[9] = 0
        vectors[100:300] = -vectors[0] + np.floor(20 * rng.standard_normal((200, width)))
        codes, align, norm2 = negatives.encode(vectors, turn)
        low, high = negatives.intervals(vectors[:20], codes, align, norm2, turn)
        exact = negatives.scores(vectors[:20], vectors)
        assert (low <= exact).all() and (exact <= high).all()
        # The ninth best lower bound leaves out what points the other way.
        assert not (high[0, 100:300] >= np.sort(low[0])[-9]).any()
