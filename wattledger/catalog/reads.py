"""Session reads, telemetry gap, zones and agents."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattledger.catalog import query
from wattledger.catalog.prelude import iso, with_views as V
from wattledger.plans import reads as R
from wattledger.sources import tables as T

_TS = iso("ts_ms")
SINCE = "2024-01-15T00:00:00.000Z"


@query("rq1_session_summaries", V(f"""
SELECT session_id, string_agg(type || '=' || CAST(n AS VARCHAR), ',' ORDER BY type) AS event_counts, CAST(sum(n) AS BIGINT) AS events,
       min(f) AS first_ts, max(l) AS last_ts
FROM (SELECT session_id, type, count(*) AS n, min({_TS}) AS f, max({_TS}) AS l FROM facts GROUP BY 1, 2) GROUP BY 1"""))
def _(spark, sf):
    s = R.session_summaries(T.facts(spark, sf))
    return R.summary_text(s).join(s.select("session_id", "events"), "session_id")


def _silent(facts):
    """The log with the calls of every fifth session missing, as when its export is not set up."""
    lost = (F.col("type") == "llm_call") & (F.substring("session_id", 2, 10).cast("bigint") % 5 == 0)
    return facts.where(~lost)


@query("rq2_telemetry_gap", V(f"""
SELECT session_id, CAST(count(*) FILTER (type = 'action_span' AND part = 0) AS BIGINT) AS tool_spans,
       CAST(0 AS BIGINT) AS llm_calls, max({_TS}) AS last_ts FROM facts
WHERE NOT (type = 'llm_call' AND CAST(substr(session_id, 2) AS BIGINT) % 5 = 0) GROUP BY 1
HAVING count(*) FILTER (type = 'action_span' AND part = 0) > 0 AND count(*) FILTER (type = 'llm_call') = 0 AND max({_TS}) >= '{SINCE}'"""))
def _(spark, sf):
    return R.sessions_without_calls(_silent(T.facts(spark, sf)), SINCE)


@query("rq3_calls_between", V(f"""
SELECT event_id, session_id, {_TS} AS ts FROM calls WHERE {_TS} BETWEEN '2024-01-10T00:00:00.000Z' AND '2024-01-12T00:00:00.000Z'"""))
def _(spark, sf):
    return R.calls_between(T.facts(spark, sf), "2024-01-10T00:00:00.000Z", "2024-01-12T00:00:00.000Z").select("event_id", "session_id", "ts")


@query("rq4_sessions_since", V(f"""
SELECT DISTINCT collector, session_id, {_TS} AS ts FROM facts WHERE {_TS} >= '{SINCE}'"""))
def _(spark, sf):
    return R.sessions_since(T.facts(spark, sf), SINCE)


@query("rq5_last_event", V(f"SELECT max({_TS}) AS last_event_at FROM ev"))
def _(spark, sf):
    return R.last_event_ts(T.facts(spark, sf))


@query("rq6_collector_sessions", V("SELECT DISTINCT session_id FROM facts WHERE collector = 'otlp-codex'"))
def _(spark, sf):
    return R.sessions_of_collector(T.facts(spark, sf), "otlp-codex")


@query("rq7_session_events", V(f"SELECT event_id, type, {_TS} AS ts FROM facts WHERE session_id = 'u7'"))
def _(spark, sf):
    return R.events_of_session(T.facts(spark, sf), "u7").select("event_id", "type", "ts")


@query("rq8_declared_zones", V("""
SELECT DISTINCT CASE k % 4 WHEN 1 THEN 'FRA' WHEN 2 THEN 'DEU' END AS zone FROM ev WHERE event_type = 'signup' AND k % 4 IN (1, 2)"""))
def _(spark, sf):
    return R.declared_zones(T.facts(spark, sf))


@query("rq9_resolve_zone", V("""
SELECT coalesce(min(z), 'WOR') AS zone, CASE WHEN min(z) IS NULL THEN 'default' ELSE 'session_meta' END AS source, count(DISTINCT z) > 1 AS conflict
FROM (SELECT CASE k % 4 WHEN 1 THEN 'FRA' WHEN 2 THEN 'DEU' END AS z FROM ev WHERE event_type = 'signup')"""))
def _(spark, sf):
    return R.resolve_zone(T.facts(spark, sf))


_AGENT = """CASE WHEN collector IN ('claude-code','cc-hooks','otlp-cc') THEN 'claude-code'
  WHEN collector = 'codex' OR collector LIKE 'otlp-codex%' THEN 'codex' WHEN collector = 'opencode' THEN 'opencode' END"""


@query("rq13_recent_activity", V(f"""
SELECT agent, session_id, session_last_ts, max(session_last_ts) OVER (PARTITION BY agent) AS agent_last_ts,
       count(*) OVER (PARTITION BY agent) AS agent_sessions
FROM (SELECT {_AGENT} AS agent, session_id, max({_TS}) AS session_last_ts FROM facts WHERE {_TS} >= '2024-01-29T00:00:00.000Z' GROUP BY 1, 2)
WHERE agent IS NOT NULL"""))
def _(spark, sf):
    return R.recent_activity(T.facts(spark, sf), "2024-01-29T00:00:00.000Z")


@query("rq14_collector_agents", V(f"""
SELECT collector, {_AGENT} AS agent, coalesce(CASE {_AGENT} WHEN 'claude-code' THEN 'Claude Code' WHEN 'codex' THEN 'Codex' WHEN 'opencode' THEN 'OpenCode' END, 'Other') AS name,
       CAST(count(*) AS BIGINT) AS events FROM facts GROUP BY 1, 2, 3"""))
def _(spark, sf):
    return T.facts(spark, sf).groupBy(F.col("collector.name").alias("collector")).agg(F.count(F.lit(1)).alias("events")).select(
        "collector", R.agent_of("collector").alias("agent"), R.agent_label(R.agent_of("collector")).alias("name"), "events"
    )


@query("rq15_remote_region", V("SELECT event_id, 'SWE' AS id, 'explicit' AS source FROM calls"))
def _(spark, sf):
    calls = T.facts(spark, sf).where("type = 'llm_call'")
    return calls.select("event_id", R.resolve_remote_region("SWE").alias("region")).select("event_id", "region.*")
