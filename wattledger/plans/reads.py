"""Read queries over the stored facts, estimates, joins and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattledger import schemas as S
from wattledger.functions import lookup, ordered_counts

EVENT_ORDER = ("ts", "event_id")


def session_summaries(facts: DataFrame) -> DataFrame:
    """Per session: counts by type as a sorted map, first and last timestamp text."""
    by_type = facts.groupBy("session_id", "type").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    return by_type.groupBy("session_id").agg(
        # One entry per event type of the session, already counted.
        F.sort_array(F.collect_list(F.struct(F.col("type").alias("key"), "n"))).alias("counts"),
        F.sum("n").alias("events"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    )


def summary_text(summaries: DataFrame) -> DataFrame:
    """Tab-separated report lines under their heading."""
    return summaries.select(
        "session_id", ordered_counts("counts").alias("event_counts"), "first_ts", "last_ts"
    )


def sessions_without_calls(facts: DataFrame, since: str) -> DataFrame:
    """Telemetry gap: sessions that ran tools, reported no model call and are recent; latest first."""
    tool = (F.col("type") == "action_span") & (F.col("action_span.tool_name") != S.BOOTSTRAP_TOOL)
    return (
        facts.groupBy("session_id")
        .agg(
            F.count_if(tool).alias("tool_spans"),
            F.count_if(F.col("type") == "llm_call").alias("llm_calls"),
            F.max("ts").alias("last_ts"),
        )
        .where((F.col("tool_spans") > 0) & (F.col("llm_calls") == 0) & (F.col("last_ts") >= since))
        .orderBy(F.desc("last_ts"), "session_id")
    )


def calls_between(facts: DataFrame, low: str, high: str) -> DataFrame:
    return facts.where((F.col("type") == "llm_call") & F.col("ts").between(low, high)).orderBy(*EVENT_ORDER)


def sessions_since(facts: DataFrame, since: str) -> DataFrame:
    return (
        facts.where(F.col("ts") >= since)
        .select(F.col("collector.name").alias("collector"), "session_id", "ts")
        .distinct()
    )


def last_event_ts(facts: DataFrame) -> DataFrame:
    return facts.agg(F.max("ts").alias("last_event_at"))


def sessions_of_collector(facts: DataFrame, collector: str) -> DataFrame:
    return facts.where(F.col("collector.name") == collector).select("session_id").distinct().orderBy("session_id")


def events_of_session(facts: DataFrame, session_id: str) -> DataFrame:
    return facts.where(F.col("session_id") == session_id).orderBy(*EVENT_ORDER)


def declared_zones(facts: DataFrame) -> DataFrame:
    zone = F.col("session_meta.geo_zone")
    return (
        facts.where((F.col("type") == "session_meta") & (zone != "")).select(zone.alias("zone")).distinct().orderBy("zone")
    )


def resolve_zone(
    facts: DataFrame, flag: str | None = None, env: str | None = None, fallback_env: str | None = None
) -> DataFrame:
    """The zone in force, where it came from, and whether declared zones disagree."""
    choices = [(flag, "flag"), (env, "env"), (fallback_env, "env_fallback")]
    declared = declared_zones(facts).agg(F.min("zone").alias("first"), F.count("zone").alias("n"))
    given = [F.when(F.lit(bool(v)), F.struct(F.lit(v or "").alias("zone"), F.lit(s).alias("source"))) for v, s in choices]
    stated = F.when(
        F.col("first").isNotNull(), F.struct(F.col("first").alias("zone"), F.lit("session_meta").alias("source"))
    )
    default = F.struct(F.lit(S.DEFAULT_ZONE).alias("zone"), F.lit("default").alias("source"))
    return declared.select(F.coalesce(*given, stated, default).alias("c"), (F.col("n") > 1).alias("conflict")).select(
        "c.zone", "c.source", "conflict"
    )


def resolve_remote_region(explicit: str | None) -> Column:
    """The region remote inference is assumed to run in: explicit, or null for automatic."""
    if explicit:
        return F.struct(F.lit(explicit).alias("id"), F.lit("explicit").alias("source"))
    return F.lit(None).cast("struct<id:string,source:string>")


def agent_of(collector: Column | str) -> Column:
    """The agent a collector reports for, or null."""
    name = F.col(collector) if isinstance(collector, str) else collector
    return F.coalesce(
        lookup(name, S.COLLECTOR_AGENTS),
        F.when(name.startswith(S.CODEX_COLLECTOR_PREFIX), F.lit("codex")),
    )


def agent_label(agent: Column | str) -> Column:
    return F.coalesce(lookup(agent, S.AGENT_NAMES), F.lit("Other"))


def recent_activity(facts: DataFrame, since: str) -> DataFrame:
    """Per agent and session heard since a moment: the session's and the agent's latest event."""
    heard = sessions_since(facts, since).withColumn("agent", agent_of("collector")).where("agent is not null")
    sessions = heard.groupBy("agent", "session_id").agg(F.max("ts").alias("session_last_ts"))
    agents = sessions.groupBy("agent").agg(
        F.max("session_last_ts").alias("agent_last_ts"), F.count(F.lit(1)).alias("agent_sessions")
    )
    return sessions.join(agents, "agent")


def joins_of_session(joins: DataFrame, session_id: str) -> DataFrame:
    return joins.where(F.col("session_id") == session_id).orderBy("unit_key")


def recent_rejects(rejects: DataFrame, limit: int) -> DataFrame:
    """The newest rejects: of stored ones by batch and place in it, else by arrival."""
    order = [c for c in ("batch", "id") if c in rejects.columns]
    return rejects.orderBy(*[F.desc(c) for c in order], *[c for c in ("origin",) if "batch" in rejects.columns]).limit(limit)


def keep_newest(df: DataFrame, order: str, n: int) -> DataFrame:
    """The newest ``n`` rows; a distributed top-k, not a global window."""
    return df.orderBy(F.desc(order)).limit(n)
