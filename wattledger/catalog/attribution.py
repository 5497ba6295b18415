"""Interval joins, apportionment and its traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattledger.catalog import query
from wattledger.catalog.prelude import with_views as V
from wattledger.functions import exact_sum
from wattledger.operators import attribution as A
from wattledger.operators import intervals as I
from wattledger.sources import tables as T


def r(col, digits=6):
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


@query("at1_correlate_spans", V("""
SELECT session_id, event_id, span_id, tool_name, tool_kind, locus, s AS span_start, e AS span_end,
       array_to_string(pids, ',') AS pids, status, task_id, tool_call_id FROM spans"""))
def _(spark, sf):
    spans = A.spans_of(T.facts(spark, sf))
    return spans.withColumn("pids", F.array_join(F.col("pids").cast("array<string>"), ",")).drop("ts_ms")


@query("at2_root_pids", V("SELECT session_id, pid FROM roots"))
def _(spark, sf):
    return A.root_pids_of(A.spans_of(T.facts(spark, sf)))


@query("at3_sample_joules", V("SELECT session_id, sample_id, round(energy_j, 6) AS energy_j FROM samples"))
def _(spark, sf):
    return A.samples_of(T.facts(spark, sf)).select("session_id", "sample_id", r("energy_j").alias("energy_j"))


@query("at4_process_windows", V("""
SELECT session_id, CAST(count(*) FILTER (w1 > w0) AS BIGINT) AS usable, CAST(count(*) FILTER (w1 <= w0) AS BIGINT) AS skipped
FROM wins GROUP BY 1"""))
def _(spark, sf):
    w = A.windows_of(T.facts(spark, sf))
    ok = F.coalesce(F.col("window_end") > F.col("window_start"), F.lit(False))
    return w.groupBy("session_id").agg(F.count_if(ok).alias("usable"), F.count_if(~ok).alias("skipped"))


@query("at5_energy_windows", V("""
SELECT session_id, CAST(count(*) AS BIGINT) AS samples, CAST(count(*) FILTER (t1 <= t0) AS BIGINT) AS degenerate,
       CAST(sum(t1 - t0) AS BIGINT) AS measured_ms FROM samples GROUP BY 1"""))
def _(spark, sf):
    length = F.col("sample_end") - F.col("sample_start")
    return A.samples_of(T.facts(spark, sf)).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(length <= 0).alias("degenerate"), F.sum(length).alias("measured_ms")
    )


@query("at6_interval_join", V("""
SELECT a.event_id AS a_id, b.event_id AS b_id FROM spans a JOIN spans b
ON a.session_id = b.session_id AND a.s < b.e AND a.e > b.s AND a.event_id < b.event_id"""))
def _(spark, sf):
    """Every pair of overlapping spans of a session."""
    spans = A.spans_of(T.facts(spark, sf))
    a = spans.select("session_id", F.col("event_id").alias("a_id"), F.col("span_start").alias("a0"), F.col("span_end").alias("a1"))
    b = spans.select("session_id", F.col("event_id").alias("b_id"), F.col("span_start").alias("b0"), F.col("span_end").alias("b1"))
    pairs = I.overlap_join(a, b, ["session_id"], ("a0", "a1"), ("b0", "b1"))
    return pairs.where("a_id < b_id").select("a_id", "b_id")


@query("at6_sample_spans", V("""
SELECT a.sample_id, b.event_id FROM samples a JOIN spans b ON a.session_id = b.session_id AND a.t0 < b.e AND a.t1 > b.s"""))
def _(spark, sf):
    """Every span that a sample overlaps."""
    f = T.facts(spark, sf)
    samples = A.samples_of(f).select("session_id", "sample_id", F.col("sample_start").alias("a0"), F.col("sample_end").alias("a1"))
    spans = A.spans_of(f).select("session_id", "event_id", F.col("span_start").alias("b0"), F.col("span_end").alias("b1"))
    return I.overlap_join(samples, spans, ["session_id"], ("a0", "a1"), ("b0", "b1")).select("sample_id", "event_id")


@query("at7_covering_windows", V("SELECT sample_id, window_id, round(fraction, 8) AS fraction FROM cover"))
def _(spark, sf):
    f = T.facts(spark, sf)
    return A.covering_windows(A.samples_of(f), A.windows_of(f)).select("sample_id", "window_id", r("fraction", 8).alias("fraction"))


@query("at8_active_spans", V("SELECT sample_id, event_id, span_id, CAST(overlap_ms AS BIGINT) AS overlap_ms FROM active"))
def _(spark, sf):
    f = T.facts(spark, sf)
    return A.active_spans(A.samples_of(f), A.spans_of(f)).select("sample_id", "event_id", "span_id", "overlap_ms")


@query("at9_pid_dedup", V("""
SELECT window_id, pid, CAST(max(cpu) AS BIGINT) AS cpu_ms, bool_or(orphan_of IS NOT NULL) AS tagged FROM procs GROUP BY 1, 2"""))
def _(spark, sf):
    return A.windows_of(T.facts(spark, sf)).select("window_id", F.inline("pid_cpu"))


def _parts(spark, sf):
    f = T.facts(spark, sf)
    samples, spans, windows = A.samples_of(f), A.spans_of(f), A.windows_of(f)
    active = A.active_spans(samples, spans)
    claims = A.pid_claims(active)
    usage = A.pid_usage(A.covering_windows(samples, windows))
    shares = A.pid_shares(usage, claims, A.sample_activity(active), A.root_pids_of(spans))
    return samples, spans, windows, active, claims, usage, shares


@query("at10_pid_claims", V("""
SELECT sample_id, pid, CAST(count(*) AS BIGINT) AS claimants FROM claims GROUP BY 1, 2"""))
def _(spark, sf):
    shares = _parts(spark, sf)[-1]
    return shares.where("claimants > 0 and pid is not null").select("sample_id", "pid", "claimants")


@query("at11_equal_split", V("""
SELECT sample_id, pid, round(sum(share) FILTER (n > 0), 2) AS claim_ms, round(coalesce(sum(share) FILTER (to_orphan), 0), 2) AS orphan_ms
FROM shares GROUP BY 1, 2"""))
def _(spark, sf):
    shares = _parts(spark, sf)[-1].where("pid is not null")
    return shares.select(
        "sample_id", "pid", F.when(F.col("claimants") > 0, r("claim_ms", 2)).alias("claim_ms"), r("orphan_ms", 2).alias("orphan_ms")
    )


@query("at12_root_cpu", V("SELECT sample_id, round(root_cpu_ms, 3) AS root_cpu_ms FROM wts"))
def _(spark, sf):
    shares = _parts(spark, sf)[-1]
    return A.sample_weights(shares.where("pid is not null")).select("sample_id", r("root_cpu_ms", 3).alias("root_cpu_ms"))


_SPLIT = """
SELECT sample_id, round(energy_j, 6) AS energy_j, round(attributed_j, 6) AS attributed_j,
       round(orphaned_j, 6) AS orphaned_j, abs(round(baseline_j, 6)) AS baseline_j FROM split WHERE policy_id = '{}'"""


def _split(spark, sf, policy):
    samples = A.apportion_facts(T.facts(spark, sf)).samples.where(F.col("policy_id") == policy)
    return samples.select(
        "sample_id", r("energy_j").alias("energy_j"), r("attributed_j").alias("attributed_j"),
        r("orphaned_j").alias("orphaned_j"), F.abs(r("baseline_j")).alias("baseline_j"),
    )


@query("at13_l2_allocation", V(_SPLIT.format("l2_cpu_time/v1")))
def _(spark, sf):
    return _split(spark, sf, "l2_cpu_time/v1")


@query("at14_l1_allocation", V(_SPLIT.format("l1_wall_clock/v1")))
def _(spark, sf):
    return _split(spark, sf, "l1_wall_clock/v1")


@query("at15_unplaced_samples", V(_SPLIT.format("none")))
def _(spark, sf):
    return _split(spark, sf, "none")


@query("at16_baseline_remainder", V("""
SELECT session_id, round(sum(baseline_j), 6) AS baseline_j, round(sum(energy_j), 6) AS energy_j FROM split GROUP BY 1"""))
def _(spark, sf):
    return A.session_energy(A.apportion_facts(T.facts(spark, sf))).select(
        "session_id", r("baseline_j").alias("baseline_j"), r("energy_j").alias("energy_j")
    )


@query("at17_unmeasured_remote", V("""
SELECT s.session_id, CAST(count(DISTINCT p.span_id) AS BIGINT) AS unmeasured_remote_spans
FROM samples s JOIN spans p ON p.session_id = s.session_id AND p.locus = 'remote' AND p.s < s.t1 AND p.e > s.t0 AND s.t1 > s.t0 GROUP BY 1"""))
def _(spark, sf):
    f = T.facts(spark, sf)
    return A.distinct_spans_per_session(A.remote_overlaps(A.samples_of(f), A.spans_of(f)), "unmeasured_remote_spans")


@query("at18_degenerate_spans", V("""
SELECT s.session_id, CAST(count(DISTINCT p.span_id) AS BIGINT) AS degenerate_spans FROM samples s
JOIN (SELECT session_id, span_id, tool_name, locus, s, CASE WHEN k % 6 = 0 THEN s ELSE e END AS e FROM spans) p
ON p.session_id = s.session_id AND p.locus <> 'remote' AND p.e <= p.s AND p.tool_name <> '__session__' AND p.s < s.t1 AND p.e > s.t0
GROUP BY 1"""))
def _(spark, sf):
    """Local spans without duration; every sixth click is taken as one that never got its end."""
    f = T.facts(spark, sf)
    ends = f.withColumn(
        "t_end_ms",
        F.when((F.col("type") == "action_span") & (F.size("action_span.pids") == 0)
               & F.col("action_span.execution_locus").isin("local", "unknown"), F.col("t_start_ms")).otherwise(F.col("t_end_ms")),
    )
    return A.distinct_spans_per_session(A.degenerate_overlaps(A.samples_of(f), A.spans_of(ends)), "degenerate_spans")


@query("at19_unobserved_windows", V("""
SELECT session_id, CAST(count(*) FILTER (unobserved) AS BIGINT) AS unobserved_process_windows FROM head GROUP BY 1"""))
def _(spark, sf):
    return A.session_energy(A.apportion_facts(T.facts(spark, sf))).select("session_id", "unobserved_process_windows")


@query("at20_session_counters", V("""
SELECT session_id, CAST(count(*) FILTER (policy_id = 'l1_wall_clock/v1') AS BIGINT) AS samples_l1,
       CAST(count(*) FILTER (policy_id = 'l2_cpu_time/v1') AS BIGINT) AS samples_l2,
       CAST(count(*) FILTER (t1 <= t0) AS BIGINT) AS degenerate_samples, CAST(count(*) AS BIGINT) AS samples FROM head GROUP BY 1"""))
def _(spark, sf):
    return A.session_energy(A.apportion_facts(T.facts(spark, sf))).select(
        "session_id", "samples_l1", "samples_l2", "degenerate_samples", "samples"
    )


@query("at20_skipped_events", V("""
SELECT session_id, CAST(count(*) FILTER (type = 'process_sample' AND bad) AS BIGINT) AS skipped_events
FROM (SELECT f.session_id, f.type, w.w1 <= w.w0 AS bad FROM facts f LEFT JOIN wins w ON w.window_id = f.event_id
      WHERE f.type IN ('action_span','energy_sample','process_sample')) GROUP BY 1"""))
def _(spark, sf):
    return A.skipped_events(T.facts(spark, sf))


@query("at21_span_rollup", V("""
SELECT session_id, span_id, round(sum(j), 6) AS allocated_j, round(sum(w), 2) AS cpu_weight_ms,
       CAST(count(DISTINCT sample_id) AS BIGINT) AS samples FROM paid GROUP BY 1, 2"""))
def _(spark, sf):
    return A.span_energy(A.apportion_facts(T.facts(spark, sf))).select(
        "session_id", "span_id", r("allocated_j").alias("allocated_j"), r("cpu_weight_ms", 2).alias("cpu_weight_ms"), "samples"
    )


@query("at22_policy_labels", V("""
SELECT session_id, CASE WHEN l2 > 0 THEN 'l2_cpu_time/v1' WHEN l1 > 0 THEN 'l1_wall_clock/v1' ELSE 'none' END AS applied_policy_id,
       CASE WHEN l2 > 0 THEN 'l2_cpu_time/v1' ELSE 'l1_wall_clock/v1' END AS policy_id,
       CASE WHEN l2 > 0 THEN 'l2_cpu_time' ELSE 'l1_wall_clock' END AS policy
FROM (SELECT session_id, count(*) FILTER (policy_id LIKE 'l2%') AS l2, count(*) FILTER (policy_id LIKE 'l1%') AS l1 FROM head GROUP BY 1)"""))
def _(spark, sf):
    from wattledger.functions import policy_name

    return A.session_energy(A.apportion_facts(T.facts(spark, sf))).select(
        "session_id", "applied_policy_id", "policy_id", policy_name("policy_id").alias("policy")
    )


TRACE_SQL = """
SELECT p.sample_id, p.event_id, p.span_id, CAST(p.overlap_ms AS BIGINT) AS overlap_ms, round(g.w, 2) AS cpu_delta_ms,
       round(g.j, 6) AS allocated_j, round(p.l1_j, 6) AS l1_allocated_j, false AS excluded
FROM paid p JOIN (SELECT sample_id, span_id, sum(w) AS w, sum(j) AS j FROM paid GROUP BY 1, 2) g USING (sample_id, span_id)
UNION ALL
SELECT s.sample_id, r.event_id, r.span_id, greatest(least(r.e, s.t1) - greatest(r.s, s.t0), 0), 0, 0, 0, true
FROM samples s JOIN spans r ON r.session_id = s.session_id AND r.locus = 'remote' AND r.s < s.t1 AND r.e > s.t0 AND s.t1 > s.t0"""


@query("at23_trace_rows", V(TRACE_SQL))
def _(spark, sf):
    f = T.facts(spark, sf)
    rows = A.trace_rows(A.apportion_facts(f), A.samples_of(f), A.spans_of(f))
    return rows.select(
        "sample_id", "event_id", "span_id", "overlap_ms", r("cpu_delta_ms", 2).alias("cpu_delta_ms"),
        r("allocated_j").alias("allocated_j"), r("l1_allocated_j").alias("l1_allocated_j"), "excluded",
    )


@query("at24_trace_headers", V("""
SELECT sample_id, policy_id, CAST(t1 - t0 AS DOUBLE) AS denominator_cpu_ms, round(orphaned_j, 6) AS orphaned_j,
       abs(round(baseline_j, 6)) AS baseline_j, round(shadow, 6) AS l1_shadow_sum_share,
       CASE WHEN policy_id = 'none' AND root_cpu_ms = 0 THEN 0 ELSE round(root_cpu_ms, 3) END AS root_cpu_ms FROM split"""))
def _(spark, sf):
    return A.apportion_facts(T.facts(spark, sf)).samples.select(
        "sample_id", "policy_id", "denominator_cpu_ms", r("orphaned_j").alias("orphaned_j"),
        F.abs(r("baseline_j")).alias("baseline_j"), r("l1_shadow_sum_share", 6).alias("l1_shadow_sum_share"),
        r("root_cpu_ms", 3).alias("root_cpu_ms"),
    )


@query("at25_conservation", V("""
SELECT s.session_id, s.sample_id, s.energy_j, s.energy_j AS accounted_j FROM split s
WHERE abs(s.attributed_j + s.orphaned_j + s.baseline_j - s.energy_j) > 1e-6 * greatest(1.0, abs(s.energy_j))"""))
def _(spark, sf):
    """Samples that break conservation; there must be none."""
    return A.conservation_violations(A.apportion_facts(T.facts(spark, sf)))


@query("at0_policy_totals", V("""
SELECT policy_id, CAST(count(*) AS BIGINT) AS samples, round(sum(energy_j), 3) AS energy_j, round(sum(attributed_j), 3) AS attributed_j,
       round(sum(orphaned_j), 3) AS orphaned_j, round(sum(baseline_j), 3) AS baseline_j FROM split GROUP BY 1"""))
def policy_totals(spark, sf):
    """Energy by policy and bucket over the whole log."""
    return A.apportion_facts(T.facts(spark, sf)).samples.groupBy("policy_id").agg(
        F.count(F.lit(1)).alias("samples"), r(exact_sum("energy_j"), 3).alias("energy_j"),
        r(exact_sum("attributed_j"), 3).alias("attributed_j"), r(exact_sum("orphaned_j"), 3).alias("orphaned_j"),
        r(exact_sum("baseline_j"), 3).alias("baseline_j"),
    )


@query("ij5_coverage_islands", V("""
SELECT session_id, min(t0) AS t0, max(t1) AS t1 FROM (
  SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY t0, t1) AS island FROM (
    SELECT *, CASE WHEN t0 <= max(t1) OVER (PARTITION BY session_id ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                   THEN 0 ELSE 1 END AS opens FROM samples WHERE t1 > t0)) GROUP BY session_id, island"""))
def _(spark, sf):
    s = A.samples_of(T.facts(spark, sf)).select("session_id", F.col("sample_start").alias("t0"), F.col("sample_end").alias("t1"))
    return I.merge_islands(s, ["session_id"], "t0", "t1")


_ISLANDS = """
  SELECT session_id, min(t0) AS i0, max(t1) AS i1 FROM (
  SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY t0, t1) AS island FROM (
    SELECT *, CASE WHEN t0 <= max(t1) OVER (PARTITION BY session_id ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                   THEN 0 ELSE 1 END AS opens FROM samples WHERE t1 > t0)) GROUP BY session_id, island"""


@query("ij6_coverage_fraction", V("""
SELECT p.event_id, round(coalesce(sum(CASE WHEN i.i0 IS NOT NULL THEN least(p.e, i.i1) - greatest(p.s, i.i0) END), 0) / CAST(any_value(p.e - p.s) AS DOUBLE), 6) AS coverage
FROM att p LEFT JOIN islands i ON i.session_id = p.session_id AND i.i0 < p.e AND i.i1 > p.s GROUP BY 1""", islands=_ISLANDS))
def _(spark, sf):
    f = T.facts(spark, sf)
    units = A.spans_of(f).where(A.is_attributable()).select("session_id", "event_id", "span_start", "span_end")
    out = I.coverage_fraction(
        units, A.samples_of(f), ["session_id"], "event_id", ("span_start", "span_end"), ("sample_start", "sample_end")
    )
    return out.select("event_id", r("coverage", 6).alias("coverage"))


@query("ob15_coverage_gaps", V("""
SELECT session_id, i1 AS gap_start, nxt AS gap_end FROM (
  SELECT *, lead(i0) OVER (PARTITION BY session_id ORDER BY i0) AS nxt FROM islands) WHERE nxt IS NOT NULL""", islands=_ISLANDS))
def _(spark, sf):
    s = A.samples_of(T.facts(spark, sf)).select("session_id", F.col("sample_start").alias("t0"), F.col("sample_end").alias("t1"))
    return I.coverage_gaps(I.merge_islands(s, ["session_id"], "t0", "t1"), ["session_id"], "t0", "t1")
