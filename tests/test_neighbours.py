"""Neighbours by brute force, with bursts at one instant; no list is carried through a sort of all facts."""

from pyspark.sql import functions as F

from wattledger.plans import views as W


def test_neighbours_of_bursts(spark):
    at = [0] * 9 + [3] * 2 + [59_999, 60_001, 60_001, 66_000, 90_000] + [120_000] * 30 + [126_000, 126_001, -5, -5]
    rows = [(f"e{i:03d}", ts, (i * 37) % 101) for i, ts in enumerate(at)]
    facts = spark.createDataFrame(rows, "event_id string, ts_ms bigint, arrival bigint").repartition(3)
    got = {(r.event_id, r.rank): (r.other_id, r.offset_ms) for r in W.neighbours(facts, rows=4).collect()}
    want = {}
    for e, ts, _ in rows:
        near = sorted((abs(t - ts), a, o, t - ts) for o, t, a in rows if o != e and abs(t - ts) <= 6_000)[:4]
        want |= {(e, k + 1): (o, d) for k, (_, _, o, d) in enumerate(near)}
    assert got == want


def test_each_sort_sees_narrow_rows(spark):
    facts = spark.range(50).select(
        F.format_string("e%03d", "id").alias("event_id"), (F.col("id") * 100).alias("ts_ms"), F.col("id").alias("arrival")
    )
    plan = W.neighbours(facts)._jdf.queryExecution().optimizedPlan().toString()
    # Lists that come out of one window and feed another would be sorted with it.
    lists = [line for line in plan.splitlines() if "Window [" in line and "collect_list" in line]
    assert len(lists) == 1, lists
