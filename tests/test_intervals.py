import random

import pytest
from pyspark.sql import functions as F

from wattledger.operators import intervals as I
from wattledger.operators.ordered import last_before, max_before, next_after
from wattledger.plans.views import neighbours


def random_intervals(rng, n, tag):
    lengths = (0, -500, 1, 3_000, 70_000, 4_000_000, 900_000_000, 40_000_000_000)
    out = []
    for i in range(n):
        s = rng.randrange(-10**7, 10**8)
        out.append((rng.choice("ab"), f"{tag}{i}", s, s + rng.choice(lengths) + rng.randrange(3)))
    return out


def test_overlap_join_is_the_theta_join(spark):
    rng = random.Random(7)
    a, b = random_intervals(rng, 150, "a"), random_intervals(rng, 150, "b")
    left = spark.createDataFrame(a, "k string, a string, s bigint, e bigint")
    right = spark.createDataFrame(b, "k string, b string, t0 bigint, t1 bigint")
    got = [(r.a, r.b) for r in I.overlap_join(left, right, ["k"], ("s", "e"), ("t0", "t1")).collect()]
    # A pair of two empty or inverted intervals need not meet: one side is always a real window.
    want = {(x, y) for k, x, s, e in a for q, y, t0, t1 in b if k == q and s < t1 and e > t0}
    real = {y for _, y, t0, t1 in b if t1 > t0}
    real_a = {x for _, x, s, e in a if e > s}
    assert len(got) == len(set(got))
    keep = lambda pairs: {(x, y) for x, y in pairs if y in real or x in real_a}
    assert keep(got) == keep(want) and len(want) > 500


def test_no_nested_loop(spark):
    left = spark.createDataFrame([("k", 0, 10)], "k string, s bigint, e bigint")
    right = left.toDF("k", "t0", "t1")
    plan = I.overlap_join(left, right, ["k"], ("s", "e"), ("t0", "t1"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def merged(intervals):
    out = []
    for s, e in sorted(i for i in intervals if i[1] > i[0]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return {tuple(i) for i in out}


def test_islands(spark):
    rng = random.Random(3)
    rows = [("a", s, s + rng.choice((0, 100, 1000, 5000, 40_000))) for s in (rng.randrange(-50_000, 500_000) for _ in range(80))]
    rows += [("b", 0, 1000), ("b", 500, 2000), ("b", 2000, 3000), ("b", 7000, 7000)]
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint")
    got = I.merge_islands(df, ["k"], "s", "e", slice_ms=10_000).collect()
    for key in "ab":
        assert {(r.s, r.e) for r in got if r.k == key} == merged([(s, e) for k, s, e in rows if k == key])


def test_coverage(spark):
    windows = spark.createDataFrame([("k", 0, 1000), ("k", 500, 2000)], "k string, w0 bigint, w1 bigint")
    units = spark.createDataFrame([("k", "u1", 0, 2000), ("k", "u2", 0, 4000), ("k", "u3", 3000, 4000), ("k", "u4", 100, 100)], "k string, u string, u0 bigint, u1 bigint")
    got = {r.u: r.coverage for r in I.coverage_fraction(units, windows, ["k"], "u", ("u0", "u1"), ("w0", "w1")).collect()}
    assert got == {"u1": 1.0, "u2": 0.5, "u3": 0.0, "u4": 0.0}


def test_as_of_across_blocks(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), i * 3, rng.choice((None, rng.randrange(100)))) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    out = last_before(df, ["k"], "o", F.col("v"), "last", block=20)
    out = next_after(out, ["k"], "o", F.col("v"), "next", block=20)
    out = max_before(out, ["k"], "o", F.col("v"), "top", block=20)
    for r in out.collect():
        earlier = [v for k, o, v in rows if k == r.k and o < r.o and v is not None]
        later = [v for k, o, v in rows if k == r.k and o > r.o and v is not None]
        assert (r["last"], r["next"], r.top) == (earlier[-1] if earlier else None, later[0] if later else None, max(earlier) if earlier else None)


def test_neighbours_in_a_burst(spark):
    rng = random.Random(9)
    rows = [(f"e{i}", 60_000 + rng.choice((0, 0, 0, rng.randrange(-9000, 9000))), i) for i in range(90)]
    df = spark.createDataFrame(rows, "event_id string, ts_ms bigint, arrival bigint")
    got = {}
    for r in neighbours(df, 6000, 20).collect():
        got.setdefault(r.event_id, {})[r["rank"]] = (r.other_id, r.offset_ms)
    for e, t, a in rows:
        near = sorted((abs(u - t), b, o, u - t) for o, u, b in rows if o != e and abs(u - t) <= 6000)[:20]
        assert [got.get(e, {}).get(i + 1) for i in range(len(near))] == [(o, d) for _, _, o, d in near]
        assert len(got.get(e, {})) == len(near)


def first_fit(rows, lanes):
    """Lane of each (key, id, start, end), one key after the other."""
    out, ends = {}, {}
    for k, i, s, e in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[1])):
        busy = ends.setdefault(k, [None] * lanes)
        free = next((n for n, x in enumerate(busy) if x is None or x <= s), None)
        if free is not None:
            busy[free] = s if e is None else e
        out[i] = free
    return out


@pytest.mark.parametrize("slices", [1, 5, 16])
def test_tracks_are_first_fit(spark, slices):
    rng = random.Random(2)
    # One key holds most rows and fills many slices; lanes stay busy over several, and idle times come between.
    at = lambda: rng.randrange(0, 100_000) + rng.choice((0, 0, 500_000))
    rows = [(rng.choice(("k", "k", "k", "k", "m", None)), f"s{i:03d}", s, s + rng.choice((0, 500, 4000, 30_000))) for i, s in enumerate(at() for _ in range(300))]
    rows += [("k", "long", 10, 90_000), ("k", "tie", rows[0][2], rows[0][3]), ("x", "endless", 5, None), ("x", "after", 6, 9), ("x", "lost", None, 3)]
    df = spark.createDataFrame(rows, "k string, id string, s bigint, e bigint")
    found = I.assign_tracks(df, ["k"], "s", "e", "id", tracks=4, slices=slices)
    assert found.columns == ["k", "id", "s", "e", "track"]
    got = {r.id: r.track for r in found.collect()}
    assert got == first_fit(rows, 4)
    assert None in got.values() and got["endless"] == 0 == got["after"]


def test_tracks_of_nothing(spark):
    df = spark.createDataFrame([], "k string, id string, s bigint, e bigint")
    assert I.assign_tracks(df, ["k"], "s", "e", "id").count() == 0


def test_lanes_that_never_come_free_are_handed_through_all_slices(spark):
    rows = [("k", f"l{i}", i, 10**6) for i in range(3)] + [("k", f"s{i:03d}", 10 + i * 100, 60 + i * 100) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, id string, s bigint, e bigint")
    assert {r.id: r.track for r in I.assign_tracks(df, ["k"], "s", "e", "id", tracks=4, slices=8).collect()} == first_fit(rows, 4)
