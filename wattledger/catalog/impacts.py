"""Estimates, guarded sums, impact joins and the status line."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattledger.catalog import query
from wattledger.catalog.attribution import _ISLANDS, r
from wattledger.catalog.prelude import iso, with_views as V
from wattledger.functions import ordered_counts, policy_name
from wattledger.operators import attribution as A
from wattledger.operators import estimation as E
from wattledger.operators import impacts as J
from wattledger.operators import intervals as I
from wattledger.plans import reads as R
from wattledger.sources import tables as T

ZONE_GWP = (0.05, 0.06)
METHODOLOGY = "factors-1"


def _calls(spark, sf):
    return E.calls_of(T.facts(spark, sf))


_QUEUE = """SELECT c.event_id FROM calls c LEFT JOIN ests e USING (event_id)
WHERE e.event_id IS NULL OR (e.status IN ('unknown_model','missing_zone') AND e.methodology_version <> 'factors-1')"""


@query("es1_work_queue", V("SELECT c.event_id, c.session_id, c.ts_ms FROM calls c WHERE c.event_id IN (" + _QUEUE + ")"))
def _(spark, sf):
    q = E.calls_to_estimate(_calls(spark, sf), T.estimates(spark, sf), METHODOLOGY)
    return q.select("event_id", "session_id", "ts_ms").orderBy("ts_ms", "event_id")


@query("es2_never_estimated", V("SELECT event_id FROM calls c WHERE NOT EXISTS (SELECT 1 FROM ests e WHERE e.event_id = c.event_id)"))
def _(spark, sf):
    return E.calls_without_estimate(_calls(spark, sf), T.estimates(spark, sf)).select("event_id")


@query("es3_queue_ids", V(_QUEUE))
def _(spark, sf):
    return E.calls_to_estimate(_calls(spark, sf), T.estimates(spark, sf), METHODOLOGY).select("event_id")


@query("es4_queue_among", V(f"SELECT event_id FROM calls WHERE event_id IN ({_QUEUE}) AND k >= 50"))
def _(spark, sf):
    ids = T.event_log(spark, sf).where("k >= 50").select("event_id")
    queue = E.calls_to_estimate(_calls(spark, sf), T.estimates(spark, sf), METHODOLOGY)
    return E.pending_among(queue, ids).select("event_id")


@query("es5_pending_counts", V(f"""
SELECT (SELECT count(*) FROM calls c WHERE NOT EXISTS (SELECT 1 FROM ests e WHERE e.event_id = c.event_id)) AS never_estimated,
       (SELECT count(*) FROM ({_QUEUE})) AS to_estimate"""))
def _(spark, sf):
    return E.pending_counts(_calls(spark, sf), T.estimates(spark, sf), METHODOLOGY)


_ESTIMATED = """
  SELECT c.event_id, c.session_id, CASE WHEN c.output_tokens IS NULL THEN 'missing_usage' WHEN f.model IS NULL THEN 'unknown_model'
         WHEN z.zone IS NULL THEN 'missing_zone' ELSE 'ok' END AS status, c.output_tokens, c.duration_ms, f.n
  FROM calls c
  LEFT JOIN (SELECT 'p' || CAST(s_suppkey % 2 AS VARCHAR) AS provider, 'm' || CAST(s_suppkey AS VARCHAR) AS model, s_suppkey AS n FROM supplier) f
    ON f.provider = c.provider AND f.model = c.model_requested
  LEFT JOIN (SELECT 'FRA' AS zone FROM nation WHERE n_nationkey = 0) z ON z.zone = 'FRA'"""


def _estimated(spark, sf):
    estimator = E.factor_estimator(T.model_factors(spark, sf), T.zone_factors(spark, sf), "table-1")
    return E.estimate(_calls(spark, sf), estimator, "table-0", "FRA")


@query("es6_estimate", V("""
SELECT e.event_id, e.status, c.criterion, round(e.output_tokens * e.n * c.scale, 12) AS min,
       round(e.output_tokens * e.n * c.scale * CASE WHEN e.n % 2 = 0 THEN 2 ELSE 1 END, 12) AS max
FROM est e LEFT JOIN (SELECT unnest(['energy','gwp','adpe','pe','water']) AS criterion, unnest([1e-6,4e-7,1e-11,1e-5,2e-6]) AS scale) c
ON e.status = 'ok'""", est=_ESTIMATED))
def _(spark, sf):
    rows = _estimated(spark, sf).select("event_id", "status", F.explode_outer("impacts").alias("i"))
    return rows.select("event_id", "status", "i.criterion", r("i.min", 12).alias("min"), r("i.max", 12).alias("max"))


@query("es7_missing_usage", V("SELECT event_id, 'missing_usage' AS status, 'none' AS methodology_version FROM calls WHERE output_tokens IS NULL"))
def _(spark, sf):
    return _estimated(spark, sf).where("status = 'missing_usage'").select("event_id", "status", "methodology_version")


@query("es8_requests", V("""
SELECT event_id, provider, model_requested AS model, output_tokens, duration_ms / 1000.0 AS latency_s,
       CAST(NULL AS VARCHAR) AS region, duration_ms IS NULL AS latency_missing FROM calls"""))
def _(spark, sf):
    return E.requests(_calls(spark, sf)).select("event_id", "provider", "model", "output_tokens", "latency_s", "region", "latency_missing")


@query("es9_methodology", V("""
SELECT methodology_version, CAST(count(*) AS BIGINT) AS calls
FROM (SELECT CASE WHEN status = 'missing_usage' THEN 'none' ELSE 'table-1' END AS methodology_version FROM est) GROUP BY 1""", est=_ESTIMATED))
def _(spark, sf):
    return _estimated(spark, sf).groupBy("methodology_version").agg(F.count(F.lit(1)).alias("calls"))


@query("es10_region_stamp", V("""
SELECT event_id, CASE WHEN status <> 'missing_usage' THEN 'FRA' END AS region_id, CASE WHEN status <> 'missing_usage' THEN 'explicit' END AS region_source FROM est""", est=_ESTIMATED))
def _(spark, sf):
    return _estimated(spark, sf).select("event_id", "region_id", "region_source")


@query("es11_outcome_tally", V("""
SELECT count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'unknown_model') AS unknown_model,
       count(*) FILTER (status = 'missing_zone') AS missing_zone, count(*) FILTER (status = 'missing_usage') AS missing_usage,
       CAST(0 AS BIGINT) AS errors FROM est""", est=_ESTIMATED))
def _(spark, sf):
    return E.outcome_tally(_estimated(spark, sf))


@query("es12_factor_ranges", """
SELECT 'p' || CAST(s_suppkey % 2 AS VARCHAR) AS provider, 'm' || CAST(s_suppkey AS VARCHAR) AS model, criterion, unit,
       round(s_suppkey * scale, 12) AS min, round(s_suppkey * scale * CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END, 12) AS max,
       criterion IN ('gwp','adpe','pe') AS has_embodied
FROM supplier, (SELECT unnest(['energy','gwp','adpe','pe','water']) AS criterion, unnest(['kWh','kgCO2eq','kgSbeq','MJ','L']) AS unit, unnest([1e-6,4e-7,1e-11,1e-5,2e-6]) AS scale)""")
def _(spark, sf):
    return E.normalise_factors(T.model_factors(spark, sf)).withColumns({"min": r("min", 12), "max": r("max", 12)})


@query("es13_zone_factors", V("""
SELECT d.event_id, d.zone, CASE WHEN n.key IS NULL THEN 'missing_zone' ELSE 'ok' END AS status,
       round(CAST(0.01 + n.key * 0.001 AS DOUBLE), 6) AS gwp_min, round(CAST(0.02 + n.key * 0.001 AS DOUBLE), 6) AS gwp_max
FROM (SELECT event_id, coalesce(CASE k % 4 WHEN 1 THEN 'FRA' WHEN 2 THEN 'DEU' END, 'NOWHERE') AS zone FROM ev WHERE event_type = 'signup') d
LEFT JOIN (SELECT n_nationkey AS key, CASE n_nationkey WHEN 0 THEN 'FRA' WHEN 1 THEN 'DEU' WHEN 2 THEN 'WOR' ELSE 'Z' || CAST(n_nationkey AS VARCHAR) END AS zone FROM nation) n USING (zone)"""))
def _(spark, sf):
    zone = F.coalesce(F.nullif(F.col("session_meta.geo_zone"), F.lit("")), F.lit("NOWHERE"))
    declared = T.facts(spark, sf).where("type = 'session_meta'").select("event_id", zone.alias("zone"))
    out = E.with_zone_factors(declared, T.zone_factors(spark, sf), "zone")
    return out.select(
        "event_id", "zone", F.when(F.col("gwp_min").isNull(), "missing_zone").otherwise("ok").alias("status"),
        r("gwp_min").alias("gwp_min"), r("gwp_max").alias("gwp_max"),
    )


@query("es14_stale_regions", V("""
SELECT region_id, CAST(count(*) AS BIGINT) AS stale FROM (
  SELECT coalesce(region_id, CASE WHEN k % 2 = 0 THEN 'GBR' END) AS region_id FROM ests) WHERE region_id <> 'FRA' GROUP BY 1"""))
def _(spark, sf):
    log = T.event_log(spark, sf).select("event_id", "k")
    old = T.estimates(spark, sf).join(log, "event_id").withColumn("zone", F.when(F.col("k") % 2 == 0, "GBR"))
    return E.stale_regions(old, "FRA")


@query("es15_estimates_by_id", V("SELECT event_id, status FROM ests WHERE session_id IN (SELECT session_id FROM ev WHERE event_type = 'signup' AND k = 3)"))
def _(spark, sf):
    log = T.event_log(spark, sf)
    sessions = log.where("event_type = 'signup' and k = 3").select("session_id")
    ids = log.where("event_type = 'view'").join(sessions, "session_id", "left_semi").select("event_id")
    return E.estimates_for(T.estimates(spark, sf), ids).select("event_id", "status")


# ---------------------------------------------------------------- guarded sums

_SUMS = """
  SELECT g, criterion, first_unit AS unit, sum(lo) FILTER (unit = first_unit) AS lo, sum(hi) FILTER (unit = first_unit) AS hi,
         count(*) FILTER (unit = first_unit) AS contributors, count(*) FILTER (unit <> first_unit) AS mismatches
  FROM (SELECT *, first_value(unit) OVER (PARTITION BY g, criterion ORDER BY ts_ms, event_id) AS first_unit FROM scoped) GROUP BY 1, 2, 3"""


@query("ij9_guarded_sums", V("""
SELECT g AS session_id, criterion, unit, round(lo, 9) AS min, round(hi, 9) AS max, CAST(contributors AS BIGINT) AS contributors,
       CAST(mismatches AS BIGINT) AS mismatches FROM sums""", scoped="SELECT session_id AS g, * FROM crit", sums=_SUMS))
def _(spark, sf):
    scoped = _calls(spark, sf).select("session_id", "event_id", "ts_ms").join(T.estimates(spark, sf).drop("session_id"), "event_id")
    sums = E.sum_criteria(E.criterion_rows(scoped, ["session_id"]), ["session_id"])
    return sums.withColumns({"min": r("min", 9), "max": r("max", 9)})


# ---------------------------------------------------------------- joins

_UNITS = """
  SELECT 'session:' || session_id AS unit_key, 'session' AS level, session_id, NULL AS span_id, NULL AS task_id, NULL AS tool_call_id,
         min(ts_ms) AS u0, max(ts_ms) AS u1 FROM ev GROUP BY session_id
  UNION ALL
  SELECT 'tool_call:' || session_id || ':' || span_id, 'tool_call', session_id, span_id, NULL, arg_min(tool_call_id, event_id), min(s), max(e)
  FROM att GROUP BY session_id, span_id
  UNION ALL
  SELECT 'task:' || session_id || ':' || task_id, 'task', session_id, NULL, task_id, NULL, min(s), max(e) FROM att GROUP BY session_id, task_id"""
_SPANJ = "SELECT session_id, span_id, sum(j) AS j FROM paid GROUP BY 1, 2"
_UNITJ = """
  SELECT 'session:' || session_id AS unit_key, sum(energy_j) AS j FROM samples GROUP BY session_id
  UNION ALL SELECT 'tool_call:' || session_id || ':' || span_id, j FROM spanj
  UNION ALL SELECT 'task:' || m.session_id || ':' || m.task_id, sum(j.j) FROM (SELECT DISTINCT session_id, task_id, span_id FROM att) m
  JOIN spanj j USING (session_id, span_id) GROUP BY 1"""
_PAIRS = """
  SELECT 'session:' || session_id AS unit_key, event_id, ts_ms FROM calls
  UNION ALL SELECT u.unit_key, c.event_id, c.ts_ms FROM units u JOIN calls c ON u.level = 'task' AND c.session_id = u.session_id AND c.task_id = u.task_id
  UNION ALL SELECT u.unit_key, c.event_id, c.ts_ms FROM units u JOIN calls c ON u.level = 'tool_call' AND c.session_id = u.session_id AND c.tool_call_id = u.tool_call_id"""
_COVER = """
  SELECT u.unit_key, CASE WHEN u.u1 > u.u0 THEN coalesce(sum(CASE WHEN i.i0 IS NOT NULL THEN least(u.u1, i.i1) - greatest(u.u0, i.i0) END), 0) / CAST(u.u1 - u.u0 AS DOUBLE) ELSE 0 END AS coverage
  FROM units u LEFT JOIN islands i ON i.session_id = u.session_id AND i.i0 < u.u1 AND i.i1 > u.u0 GROUP BY u.unit_key, u.u0, u.u1"""
_COUNTS = """
  SELECT p.unit_key, count(*) AS n, count(*) FILTER (st = 'ok' AND has_impacts) AS ok_n FROM (
    SELECT p.unit_key, p.event_id, CASE WHEN e.event_id IS NULL THEN 'pending' ELSE coalesce(e.status, 'error') END AS st, coalesce(e.has_impacts, false) AS has_impacts
    FROM pairs p LEFT JOIN ests e USING (event_id)) p GROUP BY 1"""
_SCOPED = "SELECT p.unit_key AS g, c.* FROM pairs p JOIN crit c USING (event_id)"
_JOIN = """
  SELECT u.*, CASE WHEN m.session_id IS NOT NULL THEN coalesce(j.j, 0) / 3.6e6 END AS kwh, m.session_id IS NOT NULL AS measured,
         CASE WHEN m.session_id IS NOT NULL THEN c.coverage ELSE 0 END AS coverage, coalesce(n.n, 0) AS llm_calls, coalesce(n.ok_n, 0) AS ok_n
  FROM units u LEFT JOIN unitj j USING (unit_key) LEFT JOIN covr c USING (unit_key) LEFT JOIN counts n USING (unit_key)
  LEFT JOIN (SELECT DISTINCT session_id FROM samples) m ON m.session_id = u.session_id"""
_ALL = dict(islands=_ISLANDS, units=_UNITS, spanj=_SPANJ, unitj=_UNITJ, pairs=_PAIRS, covr=_COVER, counts=_COUNTS, scoped=_SCOPED, sums=_SUMS, joined=_JOIN)


def _ctes(*names):
    return {n: _ALL[n] for n in _ALL if n in names}


def joins(spark, sf):
    return J.build_joins(T.facts(spark, sf), T.estimates(spark, sf), "FRA", "flag", ZONE_GWP, region="FRA")


@query("ij1_session_units", V("""
SELECT u.session_id, round(s.a, 6) AS attributed_j, round(s.o, 6) AS orphaned_j, round(s.b, 6) AS baseline_idle_j, round(s.e, 6) AS total_j,
       coalesce(r.n, 0) AS unmeasured_remote_spans
FROM (SELECT session_id FROM units WHERE level = 'session') u LEFT JOIN (SELECT session_id, sum(attributed_j) AS a, sum(orphaned_j) AS o, sum(baseline_j) AS b, sum(energy_j) AS e FROM split GROUP BY 1) s USING (session_id)
LEFT JOIN (SELECT s.session_id, count(DISTINCT p.span_id) AS n FROM samples s JOIN spans p
  ON p.session_id = s.session_id AND p.locus = 'remote' AND p.s < s.t1 AND p.e > s.t0 GROUP BY 1) r USING (session_id)""", **_ctes("units")))
def _(spark, sf):
    return joins(spark, sf).where("level = 'session'").select(
        "session_id", r("attributed_j").alias("attributed_j"), r("orphaned_j").alias("orphaned_j"),
        r("baseline_j").alias("baseline_idle_j"), r("joules").alias("total_j"),
        F.coalesce("unmeasured_remote_spans", F.lit(0)).alias("unmeasured_remote_spans"),
    )


def _units(spark, sf):
    f = T.facts(spark, sf)
    return J.local_units(f, A.apportion_facts(f))


def _level(level):
    return V(f"""SELECT u.unit_key, u.u0 AS unit_start, u.u1 AS unit_end, u.tool_call_id, round(coalesce(j.j, 0), 6) AS joules
FROM units u LEFT JOIN unitj j USING (unit_key) WHERE u.level = '{level}'""", **_ctes("units", "spanj", "unitj"))


def _level_df(spark, sf, level):
    return _units(spark, sf).where(F.col("level") == level).select(
        "unit_key", "unit_start", "unit_end", "tool_call_id", r("joules").alias("joules")
    )


@query("ij2_tool_call_units", _level("tool_call"))
def _(spark, sf):
    return _level_df(spark, sf, "tool_call")


@query("ij3_task_units", _level("task"))
def _(spark, sf):
    return _level_df(spark, sf, "task")


@query("ij4_calls_per_unit", V("""
SELECT u.unit_key, count(p.event_id) AS llm_calls FROM units u LEFT JOIN pairs p USING (unit_key) GROUP BY 1""", **_ctes("units", "pairs")))
def _(spark, sf):
    f = T.facts(spark, sf)
    tools, members = J.span_units(A.spans_of(f))
    none = F.lit(None).cast("string")
    units = (
        J.session_bounds(f).select(J.unit_key("session", "session_id").alias("unit_key"), "session_id", F.lit("session").alias("level"), none.alias("tool_call_id"))
        .unionByName(tools.select(J.unit_key("tool_call", "session_id", "span_id").alias("unit_key"), "session_id", F.lit("tool_call").alias("level"), "tool_call_id"))
        .unionByName(members.select(J.unit_key("task", "session_id", "task_id").alias("unit_key"), "session_id", F.lit("task").alias("level"), none.alias("tool_call_id")).distinct())
    )
    n = J.call_groups(E.calls_of(f)).groupBy("call_group").agg(F.count(F.lit(1)).alias("llm_calls"))
    return units.withColumn("call_group", J.unit_call_group()).join(n, "call_group", "left").select(
        "unit_key", F.coalesce("llm_calls", F.lit(0)).alias("llm_calls")
    )


@query("ij7_measured_sessions", V("SELECT session_id, count(*) > 0 AS measured FROM samples GROUP BY 1"))
def _(spark, sf):
    return J.measured_sessions(T.facts(spark, sf))


@query("ij8_local_measured", V("""
SELECT unit_key, round(kwh, 9) AS local_kwh, round(kwh * 0.05, 13) AS local_gwp_min, round(kwh * 0.06, 13) AS local_gwp_max, round(coverage, 6) AS coverage
FROM (SELECT u.unit_key, c.coverage, coalesce(j.j, 0) / 3.6e6 AS kwh FROM units u LEFT JOIN unitj j USING (unit_key) LEFT JOIN covr c USING (unit_key))""",
    **_ctes("islands", "units", "spanj", "unitj", "covr")))
def _(spark, sf):
    f = T.facts(spark, sf)
    out = J.local_measured(J.local_units(f, A.apportion_facts(f)), f, ZONE_GWP)
    return out.select(
        "unit_key", r("local_kwh", 9).alias("local_kwh"), r("local_gwp_min", 13).alias("local_gwp_min"),
        r("local_gwp_max", 13).alias("local_gwp_max"), r("coverage").alias("coverage"),
    )


_GROUPED = """
  SELECT g.call_group, CASE WHEN e.event_id IS NULL THEN 'pending' ELSE coalesce(e.status, 'error') END AS st, e.has_impacts, e.region_id FROM (
    SELECT 'session:' || session_id AS call_group, event_id FROM calls
    UNION ALL SELECT 'task:' || session_id || ':' || task_id, event_id FROM calls WHERE task_id IS NOT NULL
    UNION ALL SELECT 'tool_call:' || session_id || ':' || tool_call_id, event_id FROM calls WHERE tool_call_id IS NOT NULL) g
  LEFT JOIN ests e USING (event_id)"""


@query("ij10_remote_estimated", V("""
SELECT c.call_group, count(*) AS llm_calls, count(*) FILTER (c.st = 'ok' AND c.has_impacts) AS ok_estimates,
       count(*) FILTER (c.region_id <> 'FRA') AS stale_zone_estimates, any_value(t.t) AS status_counts
FROM grouped c JOIN (SELECT call_group, string_agg(st || '=' || CAST(n AS VARCHAR), ',' ORDER BY st) AS t FROM (
        SELECT call_group, st, count(*) AS n FROM grouped GROUP BY 1, 2) GROUP BY 1) t USING (call_group) GROUP BY 1""", grouped=_GROUPED))
def _(spark, sf):
    counts, _ = J.remote_estimated(J.call_groups(_calls(spark, sf)), T.estimates(spark, sf), "FRA")
    return counts.withColumn("status_counts", ordered_counts("status_counts"))


_COMBINED = V("""
SELECT x.unit_key, round(x.e_lo, 9) AS energy_min, round(x.e_hi, 9) AS energy_max, round(x.g_lo, 13) AS gwp_min, round(x.g_hi, 13) AS gwp_max FROM (
  SELECT j.unit_key, CASE WHEN j.llm_calls = 0 THEN j.kwh WHEN j.llm_calls = j.ok_n AND e.mismatches = 0 AND e.unit = 'kWh' AND e.contributors = j.ok_n THEN j.kwh + e.lo END AS e_lo,
         CASE WHEN j.llm_calls = 0 THEN j.kwh WHEN j.llm_calls = j.ok_n AND e.mismatches = 0 AND e.unit = 'kWh' AND e.contributors = j.ok_n THEN j.kwh + e.hi END AS e_hi,
         CASE WHEN j.llm_calls = 0 THEN j.kwh * 0.05 WHEN j.llm_calls = j.ok_n AND g.mismatches = 0 AND g.contributors = j.ok_n THEN j.kwh * 0.05 + g.lo END AS g_lo,
         CASE WHEN j.llm_calls = 0 THEN j.kwh * 0.06 WHEN j.llm_calls = j.ok_n AND g.mismatches = 0 AND g.contributors = j.ok_n THEN j.kwh * 0.06 + g.hi END AS g_hi
  FROM joined j LEFT JOIN sums e ON e.g = j.unit_key AND e.criterion = 'energy' LEFT JOIN sums g ON g.g = j.unit_key AND g.criterion = 'gwp') x""", **_ALL)


@query("ij11_combined_total", _COMBINED)
def _(spark, sf):
    return joins(spark, sf).select(
        "unit_key", r("combined_energy_min", 9).alias("energy_min"), r("combined_energy_max", 9).alias("energy_max"),
        r("combined_gwp_min", 13).alias("gwp_min"), r("combined_gwp_max", 13).alias("gwp_max"),
    )


@query("ij12_unit_keys", V("SELECT unit_key, level, session_id FROM units", **_ctes("units")))
def _(spark, sf):
    return joins(spark, sf).select("unit_key", "level", "session_id").orderBy("unit_key")


@query("ij13_record_base", V(f"""
SELECT u.unit_key, {iso('u.u0')} AS t_start, {iso('u.u1')} AS t_end, CASE WHEN p.l2 > 0 THEN 'l2_cpu_time' ELSE 'l1_wall_clock' END AS attribution_policy,
       CASE WHEN p.l2 > 0 THEN 'l2_cpu_time/v1' ELSE 'l1_wall_clock/v1' END AS attribution_policy_id, 'FRA' AS zone, 'flag' AS zone_source, true AS factors_available
FROM units u LEFT JOIN (SELECT session_id, count(*) FILTER (policy_id LIKE 'l2%') AS l2 FROM head GROUP BY 1) p USING (session_id)""", **_ctes("units")))
def _(spark, sf):
    from wattledger.functions import format_ms

    return joins(spark, sf).select(
        "unit_key", format_ms("unit_start").alias("t_start"), format_ms("unit_end").alias("t_end"),
        policy_name("policy_id").alias("attribution_policy"), F.col("policy_id").alias("attribution_policy_id"),
        "zone", "zone_source", "factors_available",
    )


@query("ij14_call_order", V(f"""
SELECT session_id, event_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS BIGINT) AS position
FROM (SELECT session_id, event_id, {iso('ts_ms')} AS ts FROM calls)"""))
def _(spark, sf):
    """Calls numbered in event order inside each session.

    Numbered inside each session day, plus the calls of the session's earlier days, so no session is sorted in one task.
    """
    from pyspark.sql import Window

    from wattledger.functions import local_day

    calls = _calls(spark, sf).withColumn("day", local_day("ts_ms"))
    inside = F.row_number().over(Window.partitionBy("session_id", "day").orderBy(*R.EVENT_ORDER))
    earlier = F.sum("n").over(Window.partitionBy("session_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    days = calls.groupBy("session_id", "day").agg(F.count(F.lit(1)).alias("n")).select(
        "session_id", "day", F.coalesce(earlier, F.lit(0)).alias("before")
    )
    numbered = calls.select("session_id", "event_id", "day", inside.alias("place")).join(days, ["session_id", "day"])
    return numbered.select("session_id", "event_id", (F.col("place") + F.col("before")).alias("position"))


@query("rq10_joins_of_session", V("SELECT unit_key, level FROM units WHERE session_id = 'u7'", **_ctes("units")))
def _(spark, sf):
    return R.joins_of_session(joins(spark, sf), "u7").select("unit_key", "level")


_SL = """
SELECT j.session_id, round(coalesce({g}, (g.lo + g.hi) / 2, {m}), 9) AS gwp, round(coalesce((w.lo + w.hi) / 2, {m}), 9) AS water,
       round(coalesce({e}, j.kwh, (e.lo + e.hi) / 2, {m}), 9) AS energy, round(coalesce((a.lo + a.hi) / 2, {m}), 12) AS adpe, round(coalesce((p.lo + p.hi) / 2, {m}), 9) AS pe
FROM joined j
LEFT JOIN sums g ON g.g = j.unit_key AND g.criterion = 'gwp' AND g.mismatches = 0
LEFT JOIN sums e ON e.g = j.unit_key AND e.criterion = 'energy' AND e.mismatches = 0
LEFT JOIN sums w ON w.g = j.unit_key AND w.criterion = 'water' AND w.mismatches = 0
LEFT JOIN sums a ON a.g = j.unit_key AND a.criterion = 'adpe' AND a.mismatches = 0
LEFT JOIN sums p ON p.g = j.unit_key AND p.criterion = 'pe' AND p.mismatches = 0
WHERE j.level = 'session'"""


def _status_sql(missing):
    return V(_SL.format(
        m=missing,
        e="CASE WHEN j.llm_calls = 0 THEN j.kwh WHEN j.llm_calls = j.ok_n AND e.unit = 'kWh' AND e.contributors = j.ok_n THEN j.kwh + (e.lo + e.hi) / 2 END",
        g="CASE WHEN j.llm_calls = 0 THEN j.kwh * 0.055 WHEN j.llm_calls = j.ok_n AND g.contributors = j.ok_n THEN j.kwh * 0.055 + (g.lo + g.hi) / 2 END"), **_ALL)


def _status(spark, sf, missing):
    out = J.status_line(joins(spark, sf), missing)
    return out.select("session_id", r("gwp", 9).alias("gwp"), r("water", 9).alias("water"), r("energy", 9).alias("energy"), r("adpe", 12).alias("adpe"), r("pe", 9).alias("pe"))


@query("sl1_status_line", _status_sql("0.0"))
def _(spark, sf):
    return _status(spark, sf, 0.0)


@query("vw23_status_preview", _status_sql("CAST('NaN' AS DOUBLE)"))
def _(spark, sf):
    return _status(spark, sf, float("nan"))
