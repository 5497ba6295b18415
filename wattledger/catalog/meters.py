"""Meter windows and process counters to samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattledger.catalog import query
from wattledger.catalog.attribution import r
from wattledger.catalog.prelude import with_views as V
from wattledger.operators import counters as C
from wattledger.sources import tables as T


def host(window):
    """Four machines take the windows in turn."""
    return F.concat(F.lit("h"), (window % 4).cast("string")).alias("host_id")


def meter(spark, sf):
    n = F.col("o_orderkey")
    return T.table(spark, sf, "orders").select(
        host(n), n.alias("window_id"), (n * 5000).alias("t_start_ms"), (n * 5000 + 5000).alias("t_end_ms"),
        (F.col("o_totalprice") * 1e-9 / 7.3141592).alias("cpu_kwh"), (F.col("o_totalprice") * 2e-10 / 7.3141592).alias("ram_kwh"),
        F.when(n % 3 == 0, 1e-6).otherwise(0.0).alias("gpu_kwh"), (F.col("o_totalprice") * 1.2e-9 / 7.3141592).alias("total_kwh"), (n % 17 != 0).alias("ok"),
    )


def proc(spark, sf):
    """Counter readings: one per line item; some readings step back, some pids are dead."""
    seconds = (F.col("l_orderkey") * (1 + F.col("l_linenumber")) + F.floor(F.col("l_quantity") * 3)) / 1000.0
    return T.table(spark, sf, "lineitem").groupBy("l_orderkey", (F.col("l_suppkey") % 3).alias("s"), (F.col("l_partkey") % 2).alias("p"), "l_linenumber").agg(
        F.max("l_quantity").alias("l_quantity"), F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("dead")
    ).select(
        host(F.col("l_orderkey")), F.col("l_orderkey").alias("window_id"), F.concat(F.lit("s"), F.col("s").cast("string")).alias("session_id"),
        F.concat(F.lit("sp"), F.col("p").cast("string")).alias("span_id"), F.col("l_linenumber").cast("bigint").alias("pid"),
        seconds.alias("cpu_seconds"), (F.col("l_quantity") * 4096).cast("bigint").alias("rss_bytes"), (F.col("dead") == 0).alias("alive"),
        (F.col("l_orderkey") < 9).alias("is_baseline"),
    )


def ops(spark, sf):
    """Unwatches, one per host, session and span; the moments come from the first suppliers' keys."""
    pairs = proc(spark, sf).groupBy("host_id", "session_id", "span_id").agg(F.min("window_id").alias("first"))
    number = F.substring("session_id", 2, 5).cast("bigint") * 2 + F.substring("span_id", 3, 5).cast("bigint")
    return pairs.select("host_id", ((number + 1) * 7_000_000 + 1234).alias("ts_ms"), "session_id", "span_id", F.lit("unwatch").alias("op"))


_METER = """SELECT 'h' || CAST(o_orderkey % 4 AS VARCHAR) AS host_id, o_orderkey AS window_id, o_orderkey * 5000 AS t_start_ms, o_orderkey * 5000 + 5000 AS t_end_ms, o_totalprice, o_orderkey % 17 <> 0 AS ok FROM orders"""
_PROC = """
  SELECT 'h' || CAST(l_orderkey % 4 AS VARCHAR) AS host_id, l_orderkey AS window_id, 's' || CAST(l_suppkey % 3 AS VARCHAR) AS session_id, 'sp' || CAST(l_partkey % 2 AS VARCHAR) AS span_id, CAST(l_linenumber AS BIGINT) AS pid,
    (l_orderkey * (1 + l_linenumber) + floor(max(l_quantity) * 3)) / 1000.0 AS cpu_seconds, CAST(max(l_quantity) * 4096 AS BIGINT) AS rss_bytes,
    max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 0 AS alive, l_orderkey < 9 AS is_baseline
  FROM lineitem GROUP BY l_orderkey, l_suppkey % 3, l_partkey % 2, l_linenumber"""
_DELTA = """
  SELECT *, CAST(round(greatest(0, cpu_seconds - coalesce(previous, cpu_seconds)) * 1000) AS BIGINT) AS delta FROM (
    SELECT *, last_value(CASE WHEN alive OR is_baseline THEN cpu_seconds END IGNORE NULLS) OVER (PARTITION BY host_id, session_id, span_id, pid ORDER BY window_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM pr)
  WHERE alive AND NOT is_baseline"""
_OPS = """SELECT host_id, session_id, span_id, (CAST(substr(session_id, 2) AS BIGINT) * 2 + CAST(substr(span_id, 3) AS BIGINT) + 1) * 7000000 + 1234 AS ts_ms FROM pr GROUP BY 1, 2, 3"""
_EFF = "SELECT o.host_id, o.session_id, o.span_id, o.ts_ms, min(m.t_start_ms) AS effective_ms FROM op o LEFT JOIN mt m ON m.host_id = o.host_id AND m.t_start_ms >= o.ts_ms GROUP BY 1, 2, 3, 4"
_TAIL = """
  SELECT d.*, CASE WHEN m.t_start_ms >= e.effective_ms THEN d.span_id END AS orphan_of, m.t_end_ms - e.effective_ms >= 60000 AS expired,
    d.window_id >= (SELECT min(window_id) FROM (SELECT p.window_id FROM pr p JOIN mt x ON x.window_id = p.window_id WHERE p.host_id = d.host_id AND p.session_id = d.session_id AND p.span_id = d.span_id
       AND NOT p.is_baseline AND x.t_start_ms >= e.effective_ms AND x.t_end_ms - e.effective_ms < 60000 GROUP BY p.window_id HAVING NOT bool_or(p.alive))) AS ended
  FROM dl d JOIN mt m USING (host_id, window_id) LEFT JOIN eff e USING (host_id, session_id, span_id)"""
_SHARE = """
  SELECT window_id, session_id, cpu_ms, CASE WHEN sum(cpu_ms) OVER (PARTITION BY window_id) > 0 THEN cpu_ms / sum(cpu_ms) OVER (PARTITION BY window_id) ELSE 1.0 / count(*) OVER (PARTITION BY window_id) END AS share
  FROM (SELECT window_id, session_id, CAST(sum(delta) AS DOUBLE) AS cpu_ms FROM dl GROUP BY 1, 2)"""
_X = dict(mt=_METER, pr=_PROC, dl=_DELTA, op=_OPS, eff=_EFF, tail=_TAIL, shr=_SHARE)


def _c(*names):
    return {n: _X[n] for n in _X if n in names}


def deltas(spark, sf):
    return C.cpu_deltas(proc(spark, sf))


@query("src10_counter_tables", V("SELECT window_id, session_id, count(*) AS readings, count(*) FILTER (alive) AS alive FROM pr GROUP BY 1, 2", **_c("pr")))
def _(spark, sf):
    return proc(spark, sf).groupBy("window_id", "session_id").agg(F.count(F.lit(1)).alias("readings"), F.count_if("alive").alias("alive"))


@query("ct1_cpu_deltas", V("SELECT window_id, session_id, span_id, pid, delta AS cpu_time_delta_ms FROM dl", **_c("pr", "dl")))
def _(spark, sf):
    return deltas(spark, sf).select("window_id", "session_id", "span_id", "pid", "cpu_time_delta_ms")


@query("ct2_orphan_tail", V("SELECT window_id, session_id, span_id, pid, orphan_of FROM tail WHERE orphan_of IS NULL OR NOT coalesce(expired OR ended, expired, ended, false)", **_c("mt", "pr", "dl", "op", "eff", "tail")))
def _(spark, sf):
    m, p = meter(spark, sf), proc(spark, sf)
    return C.orphan_tail(C.cpu_deltas(p), p, m, ops(spark, sf)).select("window_id", "session_id", "span_id", "pid", "orphan_of")


@query("ct3_session_split", V("""
SELECT window_id, session_id, round(share, 9) AS share, round(o_totalprice * 1.2e-9 / 7.3141592 * 3.6e6 * share, 7) AS total_j FROM shr JOIN mt USING (window_id) WHERE ok""", **_c("mt", "pr", "dl", "shr")))
def _(spark, sf):
    e = C.energy_samples(meter(spark, sf), deltas(spark, sf))
    return e.select("window_id", "session_id", r("share", 9).alias("share"), r(F.element_at("components", -1)["energy_j"], 7).alias("total_j"))


@query("ct4_components", V("""
SELECT window_id, session_id, kind, round(f * 3.6e6 * share, 7) AS energy_j, method FROM (
  SELECT window_id, session_id, share, unnest(['cpu','dram','gpu','total']) AS kind, unnest([o_totalprice * 1e-9 / 7.3141592, o_totalprice * 2e-10 / 7.3141592, CASE WHEN window_id % 3 = 0 THEN 1e-6 ELSE 0 END, o_totalprice * 1.2e-9 / 7.3141592]) AS f,
    unnest(['rapl','other','other','rapl']) AS method FROM shr JOIN mt USING (window_id) WHERE ok) WHERE kind <> 'gpu' OR f > 0""", **_c("mt", "pr", "dl", "shr")))
def _(spark, sf):
    e = C.energy_samples(meter(spark, sf), deltas(spark, sf)).select("window_id", "session_id", F.inline("components"))
    return e.select("window_id", "session_id", "kind", r("energy_j", 7).alias("energy_j"), "method")


@query("ct5_failed_meter", V("""
SELECT m.window_id, coalesce(x.n, 0) AS energy_samples, coalesce(y.n, 0) AS process_samples, coalesce(y.empty, 0) AS empty_process_samples FROM mt m
LEFT JOIN (SELECT s.window_id, count(*) AS n FROM shr s JOIN mt USING (window_id) WHERE ok GROUP BY 1) x USING (window_id)
LEFT JOIN (SELECT m.window_id, count(*) AS n, count(*) FILTER (d.window_id IS NULL) AS empty FROM mt m JOIN ss s ON s.host_id = m.host_id AND s.from_ms < m.t_end_ms AND s.to_ms > m.t_start_ms
  LEFT JOIN (SELECT DISTINCT window_id, session_id FROM dl) d ON d.window_id = m.window_id AND d.session_id = s.session_id GROUP BY 1) y USING (window_id)""",
    **_c("mt", "pr", "dl", "shr"), ss="SELECT host_id, session_id, min(window_id) * 5000 AS from_ms, max(window_id) * 5000 + 5000 AS to_ms FROM pr GROUP BY 1, 2"))
def _(spark, sf):
    m, p = meter(spark, sf), proc(spark, sf)
    d = C.cpu_deltas(p)
    sessions = p.groupBy("host_id", "session_id").agg((F.min("window_id") * 5000).alias("from_ms"), (F.max("window_id") * 5000 + 5000).alias("to_ms"))
    e = C.energy_samples(m, d).groupBy("window_id").agg(F.count(F.lit(1)).alias("energy_samples"))
    s = C.process_samples(m, d, sessions).groupBy("window_id").agg(
        F.count(F.lit(1)).alias("process_samples"), F.count_if(F.size("processes") == 0).alias("empty_process_samples")
    )
    return m.select("window_id").join(e, "window_id", "left").join(s, "window_id", "left").fillna(0)


@query("ct6_meter_methods", """
SELECT o_orderpriority, CASE o_orderkey % 6 WHEN 0 THEN 'tdp_model' WHEN 1 THEN 'tdp_model' WHEN 2 THEN 'rapl' WHEN 3 THEN 'powermetrics' WHEN 4 THEN 'nvml' ELSE 'other' END AS method, count(*) AS windows FROM orders GROUP BY 1, 2""")
def _(spark, sf):
    mode = T.pick(("cpu_load", "constant", "rapl", "powermetrics", "nvml", "solar"), F.col("o_orderkey"))
    return T.table(spark, sf, "orders").groupBy("o_orderpriority", C.meter_method(mode).alias("method")).agg(F.count(F.lit(1)).alias("windows"))


@query("ct7_effective_ops", V("SELECT host_id, session_id, span_id, ts_ms, effective_ms FROM eff", **_c("mt", "pr", "op", "eff")))
def _(spark, sf):
    return C.effective_ops(ops(spark, sf), meter(spark, sf)).drop("op")


@query("src11_reference_factors", """
SELECT 'p' || CAST(s_suppkey % 2 AS VARCHAR) AS provider, 'm' || CAST(s_suppkey AS VARCHAR) AS model, CAST(5 AS BIGINT) AS criteria FROM supplier""")
def _(spark, sf):
    return T.model_factors(spark, sf).groupBy("provider", "model").agg(F.count(F.lit(1)).alias("criteria"))
