"""Hand-computed splits, one session per case so that one run checks them all."""

import random

import pytest
from pyspark.sql import functions as F

from wattledger.operators import attribution as A

SPAN = "session_id string, event_id string, ts_ms bigint, span_id string, tool_name string, locus string, span_start bigint, span_end bigint, pids array<bigint>"
SAMPLE = "session_id string, sample_id string, ts_ms bigint, sample_start bigint, sample_end bigint, energy_j double"
PROC = "array<struct<pid:bigint,cpu_time_delta_ms:bigint,orphan_of:string>>"

# name: (spans (id, locus, start, end, pids), root pids, windows (start, end, [(pid, cpu, orphan)]), sample, expected)
CASES = {
    "half core": ([("s1", "local", 0, 1000, [10])], [], [(0, 1000, [(10, 500)])], (0, 1000, 100), ({"s1": 50}, 0, 50, "l2")),
    "three to one": ([("s1", "local", 0, 1000, [10]), ("s2", "local", 0, 1000, [11])], [], [(0, 1000, [(10, 300), (11, 100)])], (0, 1000, 100), ({"s1": 30, "s2": 10}, 0, 60, "l2")),
    "no process data": ([("s1", "local", 0, 500, []), ("s2", "local", 750, 1000, [])], [], [], (0, 1000, 100), ({"s1": 50, "s2": 25}, 0, 25, "l1")),
    "wall clock cap": ([(f"s{i}", "local", 0, 1000, []) for i in range(3)], [], [], (0, 1000, 90), ({"s0": 30, "s1": 30, "s2": 30}, 0, 0, "l1")),
    "window elsewhere": ([("s1", "local", 0, 1000, [10])], [], [(5000, 6000, [(10, 500)])], (0, 1000, 100), ({"s1": 100}, 0, 0, "l1")),
    "degenerate window": ([("s1", "local", 0, 1000, [10])], [], [(500, 500, [(10, 500)])], (0, 1000, 100), ({"s1": 100}, 0, 0, "l1")),
    "zero cpu": ([("s1", "local", 0, 1000, [10])], [], [(0, 1000, [(10, 0)])], (0, 1000, 100), ({"s1": 0}, 0, 100, "l2")),
    "root inherit": ([("s1", "local", 0, 1000, [])], [10], [(0, 1000, [(10, 500)])], (0, 1000, 100), ({"s1": 50}, 0, 50, "l2")),
    "two without pids": ([("s1", "local", 0, 1000, []), ("s2", "local", 0, 1000, [])], [10], [(0, 1000, [(10, 500)])], (0, 1000, 100), ({"s1": 25, "s2": 25}, 0, 50, "l2")),
    "own pids not widened": ([("s1", "local", 0, 1000, [11])], [10], [(0, 1000, [(10, 500)])], (0, 1000, 100), ({"s1": 0}, 50, 50, "l2")),
    "no root": ([("s1", "local", 0, 1000, [])], [], [(0, 1000, [(10, 500)])], (0, 1000, 100), ({"s1": 0}, 50, 50, "l2")),
    "two roots": ([("s1", "local", 0, 1000, [])], [10, 11], [(0, 1000, [(10, 300), (11, 200)])], (0, 1000, 100), ({"s1": 50}, 0, 50, "l2")),
    "shared pid": ([("s1", "local", 0, 1000, [10]), ("s2", "local", 0, 1000, [10])], [], [(0, 1000, [(10, 400), (10, 400)])], (0, 1000, 100), ({"s1": 20, "s2": 20}, 0, 60, "l2")),
    "largest delta": ([("s1", "local", 0, 1000, [10])], [], [(0, 1000, [(10, 200), (10, 500)])], (0, 1000, 100), ({"s1": 50}, 0, 50, "l2")),
    "orphan": ([("s1", "local", 0, 1000, [10])], [], [(0, 1000, [(10, 300), (11, 200, "s0")])], (0, 1000, 100), ({"s1": 30}, 20, 50, "l2")),
    "orphan shares pid": ([("s1", "local", 0, 1000, [10])], [], [(0, 1000, [(10, 400), (10, 400, "s0")])], (0, 1000, 100), ({"s1": 20}, 20, 60, "l2")),
    "orphan only": ([("s1", "local", 0, 500, [10])], [], [(1000, 2000, [(10, 400, "s1")])], (1000, 2000, 100), ({}, 40, 60, "l2")),
    "window scaled": ([("s1", "local", 0, 2000, [10])], [], [(500, 1500, [(10, 800)])], (0, 1000, 100), ({"s1": 40}, 0, 60, "l2")),
    "over one core": ([("s1", "local", 0, 1000, [10]), ("s2", "local", 0, 1000, [11])], [], [(0, 1000, [(10, 3000), (11, 1000)])], (0, 1000, 100), ({"s1": 75, "s2": 25}, 0, 0, "l2")),
    "span outside": ([("s1", "local", 2000, 3000, [10])], [], [(0, 1000, [(10, 500)])], (0, 1000, 100), ({}, 50, 50, "l2")),
    "remote unpaid": ([("s1", "remote", 0, 1000, [10])], [], [], (0, 1000, 100), ({}, 0, 100, "none")),
    "nothing placeable": ([], [], [(0, 1000, [])], (0, 1000, 100), ({}, 0, 100, "none")),
    "degenerate sample": ([("s1", "local", 0, 1000, [10])], [], [(0, 1000, [(10, 500)])], (500, 500, 100), ({}, 0, 100, "none")),
    "two events one payee": ([("s1", "local", 0, 1000, [10]), ("s1", "local", 0, 1000, [10]), ("s2", "local", 0, 1000, [10])], [], [(0, 1000, [(10, 300)])], (0, 1000, 100), ({"s1": 20, "s2": 10}, 0, 70, "l2")),
}


def frames(spark, cases):
    spans, samples, windows, roots = [], [], [], []
    for name, (ss, root, ws, (t0, t1, e), _) in cases.items():
        for i, (sid, locus, a, b, pids) in enumerate(ss):
            spans.append((name, f"{name}-{i}", a, sid, "Bash", locus, a, b, pids))
        roots += [(name, p) for p in root]
        samples.append((name, f"{name}-sample", t0, t0, t1, float(e)))
        for i, (a, b, procs) in enumerate(ws):
            windows.append((name, f"{name}-w{i}", a, a, b, [(*p, None)[:3] for p in procs]))
    w = spark.createDataFrame(windows, f"session_id string, window_id string, ts_ms bigint, window_start bigint, window_end bigint, processes {PROC}")
    w = w.withColumn("pid_cpu", A.per_pid(F.col("processes"))).drop("processes")
    return (
        spark.createDataFrame(samples, SAMPLE), spark.createDataFrame(spans, SPAN), w,
        spark.createDataFrame(roots, "session_id string, pid bigint"),
    )


def test_vectors(spark):
    app = A.apportion(*frames(spark, CASES))
    samples = {r.session_id: r for r in app.samples.collect()}
    paid = {}
    for r in A.span_energy(app).collect():
        paid.setdefault(r.session_id, {})[r.span_id] = r.allocated_j
    for name, (_, _, _, _, (spans, orphan, baseline, policy)) in CASES.items():
        s = samples[name]
        assert paid.get(name, {}) == pytest.approx(spans), name
        assert (s.orphaned_j, s.baseline_j) == pytest.approx((orphan, baseline), abs=1e-9), name
        assert s.policy_id.startswith(policy), name


def test_random_sessions_conserve_energy(spark):
    rng = random.Random(11)
    cases = {}
    for n in range(60):
        spans = []
        for i in range(rng.randrange(6)):
            a = rng.randrange(4000)
            spans.append((f"s{rng.randrange(4)}", rng.choice(("local", "remote", "hybrid", "unknown")), a, a + rng.randrange(-500, 4000), rng.sample(range(1, 5), rng.randrange(3))))
        windows = []
        for _ in range(rng.randrange(3)):
            a = rng.randrange(4000)
            windows.append((a, a + rng.randrange(-100, 3000), [(rng.randrange(1, 5), rng.randrange(4000), rng.choice((None, "s0"))) for _ in range(rng.randrange(5))]))
        t0 = rng.randrange(3000)
        cases[f"r{n}"] = (spans, rng.sample(range(1, 5), rng.randrange(3)), windows, (t0, t0 + rng.randrange(-200, 2000), rng.random() * 1000), None)
    app = A.apportion(*frames(spark, cases))
    assert A.conservation_violations(app).count() == 0
    assert app.samples.where("orphaned_j < -1e-9 or baseline_j < -1e-9").count() == 0
    assert app.rows.where("locus = 'remote' or event_j < -1e-9").count() == 0
    assert app.samples.count() == len(cases)


def test_sample_joules(spark):
    c = lambda *xs: [(k, None, float(j), "rapl") for k, j in xs]
    rows = [(c(("cpu", 10), ("dram", 3), ("total", 15)),), (c(("cpu", 10), ("dram", 3), ("gpu", 7)),), ([],)]
    df = spark.createDataFrame(rows, "c array<struct<kind:string,label:string,energy_j:double,method:string>>")
    assert [r[0] for r in df.select(A.sample_joules(F.col("c"))).collect()] == [15.0, 20.0, 0.0]
