"""Open/close pairing of hook calls and durable events."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattledger.catalog import query
from wattledger.catalog.prelude import iso, with_views as V
from wattledger.operators import lifecycle as L
from wattledger.sources import frames
from wattledger.sources import tables as T

_EVENTS = ("PreToolUse", "PostToolUse", "PostToolUseFailure", "Stop", "SessionStart")


def hooks(spark, sf):
    """Hook calls as JSON lines: clicks open, views and errors close, purchases stop, signups start."""
    k = F.col("k")
    kind = F.col("event_type")
    name = (
        F.when(kind == "click", "PreToolUse").when(kind == "view", "PostToolUse").when(kind == "error", "PostToolUseFailure")
        .when(kind == "purchase", F.when(k % 2 == 0, "Stop").otherwise("SessionEnd")).otherwise("SessionStart")
    )
    doc = F.struct(
        F.col("session_id").alias("session_id"), name.alias("hook_event_name"),
        F.when(kind == "click", T.pick(T.TOOLS, k)).when(k % 4 == 0, T.pick(T.TOOLS, k)).alias("tool_name"),
        F.when(k % 13 != 0, F.concat(F.lit("c/"), (k % 3).cast("string"))).alias("tool_use_id"),
        F.when(k % 3 == 0, "true").alias("is_interrupt"),
    )
    log = T.event_log(spark, sf).select("arrival", "ts_ms", "event_id", F.to_json(doc).alias("value"))
    return frames.hook_payloads(log).withColumn("pid", F.col("arrival") % 1000)


_H = """
  SELECT arrival, ts_ms, session_id, k, event_type AS et, CASE WHEN k % 13 <> 0 THEN 'c' || CAST(k % 3 AS VARCHAR) ELSE '' END AS id,
    CASE WHEN event_type = 'click' OR k % 4 = 0 THEN ['Bash','Edit','WebFetch','mcp__db','Task','Read','Planner'][k % 7 + 1] ELSE '' END AS name FROM ev"""
_S = "SELECT session_id, arrival, ts_ms FROM h WHERE et = 'purchase'"
_TL = """
  SELECT t.*, lag(et) OVER w AS p_et, lag(ts_ms) OVER w AS p_ts, lag(name) OVER w AS p_name, lag(arrival) OVER w AS p_at, lead(arrival) OVER w AS n_at,
    (SELECT min(s.arrival) FROM s WHERE s.session_id = t.session_id AND s.arrival > t.arrival) AS stop_at
  FROM h t WHERE et IN ('click','view','error') AND id <> '' WINDOW w AS (PARTITION BY session_id, id ORDER BY arrival)"""
_PAIR = """
  SELECT t.*, coalesce(p_et = 'click' AND NOT EXISTS (SELECT 1 FROM s WHERE s.session_id = t.session_id AND s.arrival > t.p_at AND s.arrival < t.arrival), false) AS opened FROM tl t WHERE et <> 'click'"""
_SPANS = """
  SELECT session_id, id AS span_id, arrival, CASE WHEN name <> '' THEN name WHEN opened THEN p_name ELSE '' END AS tool_name, CASE WHEN opened THEN p_ts ELSE ts_ms END AS t_start_ms, ts_ms AS t_end_ms,
    CASE WHEN NOT opened THEN 'unknown' WHEN et = 'view' THEN 'ok' WHEN k % 3 = 0 THEN 'cancelled' ELSE 'error' END AS status, false AS swept, opened FROM pair
  UNION ALL
  SELECT t.session_id, t.id, t.stop_at, t.name, t.ts_ms, x.ts_ms, 'unknown', true, true FROM tl t JOIN s x ON x.session_id = t.session_id AND x.arrival = t.stop_at
  WHERE t.et = 'click' AND (t.n_at IS NULL OR t.stop_at < t.n_at)"""
_HX = dict(h=_H, s=_S, tl=_TL, pair=_PAIR, hs=_SPANS)


def _spans(spark, sf):
    return L.hook_spans(hooks(spark, sf))


@query("src9_hook_log", V("SELECT arrival, session_id, id <> '' AS has_id, name AS tool_name, k % 3 = 0 AS is_interrupt FROM h", h=_H))
def _(spark, sf):
    return hooks(spark, sf).select("arrival", "session_id", (F.col("tool_use_id") != "").alias("has_id"), "tool_name", "is_interrupt")


@query("lc1_hook_pairs", V("SELECT session_id, span_id, arrival, tool_name, t_start_ms, t_end_ms, status FROM hs WHERE NOT swept AND opened", **_HX))
def _(spark, sf):
    return _spans(spark, sf).where("not swept and status <> 'unknown'").select("session_id", "span_id", "arrival", "tool_name", "t_start_ms", "t_end_ms", "status")


@query("lc2_unseen_starts", V("SELECT session_id, span_id, arrival, t_start_ms, t_end_ms FROM hs WHERE NOT opened", **_HX))
def _(spark, sf):
    return _spans(spark, sf).where("not swept and status = 'unknown'").select("session_id", "span_id", "arrival", "t_start_ms", "t_end_ms")


@query("lc3_stop_sweep", V("SELECT session_id, span_id, arrival, tool_name, t_start_ms, t_end_ms, status FROM hs WHERE swept", **_HX))
def _(spark, sf):
    return _spans(spark, sf).where("swept").select("session_id", "span_id", "arrival", "tool_name", "t_start_ms", "t_end_ms", "status")


@query("lc4_session_starts", V("""
SELECT session_id, arrival, type, CASE WHEN type = 'action_span' THEN 'session-boot-' || session_id END AS span_id, CASE WHEN type = 'action_span' THEN ts_ms END AS t_start_ms,
       CASE WHEN type = 'action_span' THEN CAST(arrival % 1000 AS VARCHAR) END AS pids FROM h, (SELECT 'action_span' AS type UNION ALL SELECT 'session_meta') WHERE et = 'signup'""", h=_H))
def _(spark, sf):
    return L.session_starts(hooks(spark, sf)).select(
        "session_id", "arrival", "type", "span_id", "t_start_ms", F.array_join(F.col("pids").cast("array<string>"), ",").alias("pids")
    )


@query("lc5_tool_classes", V("""
SELECT tool_name, CASE tool_name WHEN 'Bash' THEN 'bash' WHEN 'Edit' THEN 'file_op' WHEN 'Read' THEN 'file_op' WHEN 'WebFetch' THEN 'web' WHEN 'mcp__db' THEN 'mcp' WHEN 'Task' THEN 'subagent' ELSE 'other' END AS hook_kind,
  CASE WHEN tool_name IN ('Bash','Edit','Read','Task') THEN 'local' WHEN tool_name = 'WebFetch' THEN 'remote' ELSE 'unknown' END AS hook_locus,
  CASE tool_name WHEN 'Bash' THEN 'bash' WHEN 'Edit' THEN 'file_op' WHEN 'Read' THEN 'file_op' WHEN 'WebFetch' THEN 'web' WHEN 'mcp__db' THEN 'mcp' WHEN 'Task' THEN 'subagent' ELSE 'other' END AS durable_kind,
  CASE WHEN k % 2 = 1 THEN 'remote' WHEN tool_name IN ('Bash','Edit','Read','Task') THEN 'local' WHEN tool_name = 'WebFetch' THEN 'remote' ELSE 'unknown' END AS durable_locus, count(*) AS spans
FROM spans WHERE tool_name <> '__session__' GROUP BY 1, 2, 3, 4, 5"""))
def _(spark, sf):
    log = T.event_log(spark, sf).where("event_type = 'click'").select(T.pick(T.TOOLS, F.col("k")).alias("tool_name"), "k")
    hook_kind, hook_locus = L.hook_tool(F.col("tool_name"))
    kind, locus = L.durable_tool(F.col("tool_name"), F.col("k") % 2 == 1)
    named = log.select("tool_name", hook_kind.alias("hook_kind"), hook_locus.alias("hook_locus"), kind.alias("durable_kind"), locus.alias("durable_locus"))
    return named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias("spans"))


# ---------------------------------------------------------------- durable events


def durable(spark, sf):
    """Durable-event frames of the log.  Signups open steps and views settle them, clicks open tools and
    purchases settle them, errors open (even ``k``) or settle (odd ``k``) shells."""
    k, kind = F.col("k"), F.col("event_type")
    event = (
        F.when(kind == "signup", "session.next.step.started")
        .when(kind == "view", F.when(k % 5 == 0, "session.next.step.failed").otherwise("session.next.step.ended"))
        .when(kind == "click", "session.next.tool.called")
        .when(kind == "purchase", F.when(k % 5 == 0, "session.next.tool.failed").otherwise("session.next.tool.success"))
        .otherwise(F.when(k % 2 == 0, "session.next.shell.started").otherwise("session.next.shell.ended"))
    )
    null = F.lit(None)
    data = F.struct(
        F.col("ts_ms").alias("timestamp"), F.col("session_id").alias("sessionID"),
        F.when(kind != "error", F.concat(F.lit("m"), (k % 3).cast("string"))).alias("assistantMessageID"),
        F.when(kind.isin("click", "purchase", "error"), F.concat(F.lit("c"), (k % 3).cast("string"))).alias("callID"),
        F.when(kind == "click", T.pick(T.TOOLS, k)).alias("tool"),
        F.when((kind == "signup") & (k % 19 != 0), F.struct(F.concat(F.lit("p"), (k % 2).cast("string")).alias("providerID"), F.concat(F.lit("m"), (k % 6).cast("string")).alias("id"))).alias("model"),
        F.when(kind == "view", F.struct((k * 100).alias("input"), (k * 10).alias("output"), F.struct(k.alias("read")).alias("cache"))).alias("tokens"),
        F.when((kind == "view") & (k % 10 == 0), F.struct(F.lit("Cancelled by user").alias("message"))).alias("error"),
        F.when(kind == "click", F.struct((k % 6 == 0).alias("executed"))).alias("provider"),
    )
    seq = F.when(k % 31 == 0, F.lit(0)).when(k % 25 == 0, F.greatest(F.col("arrival") - 500, F.lit(1))).otherwise(F.col("arrival") + 1)
    doc = F.struct(
        F.when(k % 2 == 0, F.col("event_id")).otherwise(F.concat(F.lit("e"), F.col("arrival").cast("string"))).alias("id"), event.alias("type"),
        F.when(k % 29 != 0, F.struct(F.when(k % 37 == 0, F.lit("other")).otherwise(F.col("session_id")).alias("aggregateID"), seq.alias("seq"))).alias("durable"),
        data.alias("data"),
    )
    raw = T.event_log(spark, sf).select("arrival", "session_id", F.concat(F.lit("data: "), F.to_json(doc), F.lit("\n")).alias("frame"))
    return frames.durable_events(frames.parse_frames(raw))


def _accepted(spark, sf):
    return L.durable_details(L.sequence_filter(durable(spark, sf)).where("accepted"))


def _pairs(spark, sf):
    return L.pair_durable(_accepted(spark, sf))


_SEQ = """
  SELECT *, CASE WHEN k % 29 = 0 THEN 'unnumbered' WHEN k % 37 = 0 THEN 'other_session' WHEN k % 31 = 0 THEN 'malformed'
     WHEN seq <= latest THEN 'regression' WHEN seq > latest + 1 THEN 'gap' ELSE 'next' END AS verdict FROM (
    SELECT *, coalesce(max(CASE WHEN k % 29 <> 0 AND k % 37 <> 0 AND k % 31 <> 0 THEN seq END) OVER (PARTITION BY session_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS latest FROM (
      SELECT *, CASE WHEN k % 31 = 0 THEN 0 WHEN k % 25 = 0 THEN greatest(arrival - 500, 1) ELSE arrival + 1 END AS seq FROM ev))"""
_DUR = """
  SELECT *, CASE event_type WHEN 'signup' THEN 'step' WHEN 'view' THEN 'step' WHEN 'error' THEN 'shell' ELSE 'tool' END AS family,
     CASE WHEN event_type IN ('signup','click') OR (event_type = 'error' AND k % 2 = 0) THEN 'open' ELSE 'close' END AS side,
     CASE WHEN event_type IN ('signup','view') THEN 'm' ELSE 'c' END || CAST(k % 3 AS VARCHAR) AS pair_id FROM sq WHERE verdict IN ('unnumbered','gap','next')"""
_DP = """
  SELECT * FROM (SELECT *, lag(side) OVER w AS p_side, lag(ts_ms) OVER w AS p_ts, lag(k) OVER w AS p_k FROM dur WINDOW w AS (PARTITION BY session_id, family, pair_id ORDER BY arrival)) WHERE side = 'close'"""
_DX = dict(sq=_SEQ, dur=_DUR, dp=_DP)
_EID = "CASE WHEN k % 2 = 0 THEN event_id ELSE 'opencode-' || substr(sha256('e' || CAST(arrival AS VARCHAR)), 1, 24) END"


@query("lc6_steps", V(f"""
SELECT {_EID} AS event_id, session_id, pair_id AS task_id, 'p' || CAST(p_k % 2 AS VARCHAR) AS provider, 'm' || CAST(p_k % 6 AS VARCHAR) AS model, k * 100 AS input_tokens, k * 10 AS output_tokens,
       k AS cached_read_tokens, greatest(ts_ms - p_ts, 0) AS duration_ms, CASE WHEN k % 10 = 0 THEN 'cancelled' WHEN k % 5 = 0 THEN 'error' ELSE 'ok' END AS status
FROM dp WHERE family = 'step' AND p_side = 'open' AND p_k % 19 <> 0""", **_DX))
def _(spark, sf):
    return L.durable_calls(_pairs(spark, sf)).select(
        "event_id", "session_id", "task_id", "provider", "model", "input_tokens", "output_tokens", "cached_read_tokens", "duration_ms", "status"
    )


def _span_cols(df):
    return df.select("event_id", "session_id", "span_id", "task_id", "tool_name", "tool_kind", "locus", "t_start_ms", "t_end_ms", F.element_at("pids", 1).alias("pid"), "status")


@query("lc7_tools", V(f"""
SELECT event_id, session_id, span_id, task_id, tool_name, tool_kind, locus, t_start_ms, t_end_ms, CASE WHEN locus = 'local' THEN CAST(4242 AS BIGINT) END AS pid, status FROM (
  SELECT {_EID} AS event_id, session_id, pair_id AS span_id, 'm' || CAST(k % 3 AS VARCHAR) AS task_id, ['Bash','Edit','WebFetch','mcp__db','Task','Read','Planner'][p_k % 7 + 1] AS tool_name,
    ['bash','file_op','web','mcp','subagent','file_op','other'][p_k % 7 + 1] AS tool_kind,
    CASE WHEN p_k % 6 = 0 THEN 'remote' ELSE ['local','local','remote','unknown','local','local','unknown'][p_k % 7 + 1] END AS locus,
    p_ts AS t_start_ms, ts_ms AS t_end_ms, CASE WHEN k % 5 = 0 THEN 'error' ELSE 'ok' END AS status FROM dp WHERE family = 'tool' AND p_side = 'open')""", **_DX))
def _(spark, sf):
    return _span_cols(L.durable_spans(_pairs(spark, sf), F.lit(4242).cast("bigint")).where("family = 'tool'"))


@query("lc8_shells", V(f"""
SELECT {_EID} AS event_id, session_id, pair_id AS span_id, CAST(NULL AS VARCHAR) AS task_id, 'shell' AS tool_name, 'bash' AS tool_kind, 'local' AS locus, p_ts AS t_start_ms, ts_ms AS t_end_ms,
  CAST(4242 AS BIGINT) AS pid, 'ok' AS status FROM dp WHERE family = 'shell' AND p_side = 'open'""", **_DX))
def _(spark, sf):
    return _span_cols(L.durable_spans(_pairs(spark, sf), F.lit(4242).cast("bigint")).where("family = 'shell'"))


@query("lc9_unpaired", V("""
SELECT session_id, family, pair_id, arrival, CASE WHEN p_side = 'open' THEN 'unmappable start' ELSE 'no start' END AS reason FROM dp
WHERE p_side IS DISTINCT FROM 'open' OR (family = 'step' AND p_k % 19 = 0)""", **_DX))
def _(spark, sf):
    return L.unpaired(_pairs(spark, sf))


@query("lc10_sequence_filter", V("SELECT arrival, verdict, latest FROM sq", sq=_SEQ))
def _(spark, sf):
    return L.sequence_filter(durable(spark, sf)).select("arrival", "verdict", "latest")


@query("lc11_stable_ids", V(f"SELECT arrival, {_EID} AS event_id FROM ev"))
def _(spark, sf):
    return durable(spark, sf).select("arrival", L.durable_event_id(F.col("source_id")).alias("event_id"))


@query("lc12_missing_session_meta", V("""
SELECT DISTINCT session_id FROM ev WHERE session_id NOT IN (SELECT session_id FROM ev WHERE event_type = 'signup' AND k % 4 = 0)"""))
def _(spark, sf):
    known = T.facts(spark, sf).where("type <> 'session_meta' or session_meta.geo_zone = ''")
    return L.missing_session_meta(T.event_log(spark, sf), known)


@query("src2_targeted_scan", V("""
SELECT collector AS collector_file, session_id, count(*) AS lines FROM facts WHERE session_id IN (SELECT session_id FROM calls WHERE k = 10) GROUP BY 1, 2"""))
def _(spark, sf):
    """Of all spool files those of the sessions that are due, named one by one."""
    from wattledger.catalog.events import spooled
    from wattledger.sources import spool

    folder = spooled(spark, sf)
    facts = T.facts(spark, sf)
    due = facts.where("type = 'llm_call' and llm_call.usage.output_tokens = 100").select("session_id").distinct()
    names = facts.join(due, "session_id").select(F.concat(F.col("collector.name"), F.lit("."), "session_id", F.lit(".jsonl"))).distinct()
    got = spool.scan_paths(spark, [f"{folder}/{r[0]}" for r in names.collect()])
    return got.groupBy("collector_file", F.col("session_file").alias("session_id")).agg(F.count(F.lit(1)).alias("lines"))
