"""Period summary figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattledger.catalog import query
from wattledger.catalog.attribution import r
from wattledger.catalog.prelude import iso, with_views as V
from wattledger.functions import ordered_counts
from wattledger.operators import estimation as E
from wattledger.plans import summary as M
from wattledger.sources import tables as T

NOW_MS = 1706572800000  # 2024-01-30T00:00:00Z
OFFSET = 60
PERIOD = M.Period("30d", NOW_MS, OFFSET)
WEEK = M.Period("7d", NOW_MS, OFFSET)

_AGENT = """CASE WHEN collector IN ('claude-code','cc-hooks','otlp-cc') THEN 'claude-code'
  WHEN collector = 'codex' OR collector LIKE 'otlp-codex%' THEN 'codex' WHEN collector = 'opencode' THEN 'opencode' END"""


def _labelled_sql(period):
    return f"""
  SELECT c.event_id, c.session_id, c.ts_ms, coalesce({_AGENT}, 'other') AS agent,
         coalesce(CASE {_AGENT} WHEN 'claude-code' THEN 'Claude Code' WHEN 'codex' THEN 'Codex' END, 'Other') AS name,
         coalesce(model_served, model_requested) AS model, strftime(make_timestamp(CAST((c.ts_ms + {OFFSET} * 60000) * 1000 AS BIGINT)), '%Y-%m-%d') AS day,
         coalesce(input_tokens, 0) AS input, coalesce(output_tokens, 0) AS output, coalesce(thought_tokens, 0) AS thought,
         coalesce(cached_read_tokens, 0) AS cache_read, coalesce(cached_write_tokens, 0) AS cache_write,
         CASE WHEN e.status = 'ok' AND e.has_impacts THEN NULL ELSE coalesce(e.status, 'pending') END AS reason
  FROM calls c LEFT JOIN ests e USING (event_id) WHERE c.ts_ms BETWEEN {period.from_ms} AND {period.now_ms}"""


_LABELLED = _labelled_sql(PERIOD)
_ROWS = """
  SELECT 'total' AS level, '' AS g_agent, '' AS label, * FROM lab UNION ALL
  SELECT 'agent', agent, name, * FROM lab UNION ALL SELECT 'model', agent, model, * FROM lab UNION ALL SELECT 'day', '', day, * FROM lab"""
_FIGURES = """
SELECT level, g_agent AS agent, label, count(*) AS calls, count(DISTINCT session_id) AS sessions, CAST(sum(input) AS BIGINT) AS input,
       CAST(sum(output) AS BIGINT) AS output, CAST(sum(thought) AS BIGINT) AS thought, CAST(sum(cache_read) AS BIGINT) AS cache_read,
       CAST(sum(cache_write) AS BIGINT) AS cache_write, CAST(sum(input + output + thought + cache_read + cache_write) AS BIGINT) AS total,
       count(*) FILTER (reason IS NULL) AS estimated_calls, count(*) FILTER (reason IS NOT NULL) AS unestimated_calls"""


def _labelled(spark, sf, period=PERIOD):
    return M.labelled_calls(E.calls_of(T.facts(spark, sf)), T.estimates(spark, sf), period)


def _figures(spark, sf):
    return M.figures(_labelled(spark, sf)).drop("unestimated_by_reason")


@query("sm1_period_bounds", V(f"""
SELECT '{PERIOD.name}' AS period, '{PERIOD.from_ms}' AS from_ms, count(*) AS calls,
       count(DISTINCT strftime(make_timestamp(CAST((ts_ms + {OFFSET} * 60000) * 1000 AS BIGINT)), '%Y-%m-%d')) AS days
FROM calls WHERE ts_ms >= {PERIOD.from_ms} AND ts_ms <= {PERIOD.now_ms}"""))
def _(spark, sf):
    from wattledger.functions import local_day

    calls = M.in_period(E.calls_of(T.facts(spark, sf)), PERIOD)
    return calls.agg(
        F.lit(PERIOD.name).alias("period"), F.lit(str(PERIOD.from_ms)).alias("from_ms"), F.count(F.lit(1)).alias("calls"),
        F.countDistinct(local_day("ts_ms", OFFSET)).alias("days"),
    )


@query("sm2_two_step_filter", V(f"SELECT event_id, ts_ms FROM calls WHERE ts_ms BETWEEN {WEEK.from_ms} AND {WEEK.now_ms}"))
def _(spark, sf):
    return M.in_period(E.calls_of(T.facts(spark, sf)), WEEK).select("event_id", "ts_ms")


@query("sm3_group_figures", V(f"""
SELECT level, label, g_agent AS agent, CAST(sum(n) AS BIGINT) AS unestimated_calls, string_agg(reason || '=' || CAST(n AS VARCHAR), ',' ORDER BY reason) AS unestimated_by_reason
FROM (SELECT level, label, g_agent, reason, count(*) AS n FROM gr WHERE reason IS NOT NULL GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""", lab=_LABELLED, gr=_ROWS))
def _(spark, sf):
    return M.figures(_labelled(spark, sf)).where("unestimated_calls > 0").select(
        "level", "label", "agent", "unestimated_calls", ordered_counts("unestimated_by_reason").alias("unestimated_by_reason")
    )


@query("sm4_grouping_sets", V(_FIGURES + " FROM gr GROUP BY 1, 2, 3", lab=_LABELLED, gr=_ROWS))
def grouping_sets(spark, sf):
    return _figures(spark, sf)


@query("sm5_model_of_call", V("SELECT coalesce(model_served, model_requested) AS model, count(*) AS calls FROM calls GROUP BY 1"))
def _(spark, sf):
    return E.calls_of(T.facts(spark, sf)).groupBy(M.model_of().alias("model")).agg(F.count(F.lit(1)).alias("calls"))


_DAYS = f"""
  SELECT strftime(make_timestamp(CAST(d * 86400000000 AS BIGINT)), '%Y-%m-%d') AS label
  FROM (SELECT unnest(generate_series({PERIOD.first_day}, {PERIOD.today})) AS d)"""


@query("sm6_dense_days", V("""
SELECT d.label, coalesce(l.calls, 0) AS calls, coalesce(l.sessions, 0) AS sessions, coalesce(l.input, 0) AS input
FROM days d LEFT JOIN (SELECT day, count(*) AS calls, count(DISTINCT session_id) AS sessions, CAST(sum(input) AS BIGINT) AS input FROM lab GROUP BY 1) l ON l.day = d.label""",
    lab=_LABELLED, days=_DAYS))
def _(spark, sf):
    return M.dense_days(_figures(spark, sf), PERIOD).select("label", "calls", "sessions", "input").orderBy("label")


@query("sm7_ranking", V("""
SELECT agent, model, total, row_number() OVER (ORDER BY total DESC, agent, model) AS rank FROM (
  SELECT agent, model, CAST(sum(input + output + thought + cache_read + cache_write) AS BIGINT) AS total FROM lab GROUP BY 1, 2)""", lab=_LABELLED))
def _(spark, sf):
    from pyspark.sql import Window

    # Ranked over finished figures: one row per agent and model.
    models = _figures(spark, sf).where("level = 'model'").select("level", "agent", F.col("label").alias("model"), "total")
    order = Window.partitionBy("level").orderBy(F.desc("total"), "agent", "model")
    return models.select("agent", "model", "total", F.row_number().over(order).cast("bigint").alias("rank"))


@query("sm8_models_not_estimated", V("""
SELECT agent, model, min(reason) AS reason, count(*) AS calls, CAST(sum(input + output + thought + cache_read + cache_write) AS BIGINT) AS tokens
FROM lab WHERE reason <> 'pending' GROUP BY 1, 2""", lab=_LABELLED))
def _(spark, sf):
    return M.models_not_estimated(_labelled(spark, sf))


@query("sm9_remote_sums", V("""
SELECT level, g_agent AS agent, label, criterion, any_value(first_unit) AS unit, round(sum(lo), 9) AS min, round(sum(hi), 9) AS max, count(*) AS contributors
FROM (SELECT g.level, g.g_agent, g.label, c.*, first_value(unit) OVER (PARTITION BY level, g_agent, label, criterion ORDER BY c.ts_ms, c.event_id) AS first_unit
      FROM gr g JOIN crit c USING (event_id) WHERE g.reason IS NULL)
GROUP BY 1, 2, 3, 4 HAVING count(*) FILTER (unit <> first_unit) = 0""", lab=_LABELLED, gr=_ROWS))
def _(spark, sf):
    sums = M.remote_sums(_labelled(spark, sf)).drop("mismatches")
    return sums.withColumns({"min": r("min", 9), "max": r("max", 9)})


@query("sm10_header", V(f"""
SELECT {iso(str(NOW_MS))} AS generated_at, '30d' AS period, {iso(str(PERIOD.from_ms))} AS "from", {iso(str(NOW_MS))} AS "to",
       CAST({OFFSET} AS BIGINT) AS utc_offset_minutes, max({iso('ts_ms')}) AS last_event_at FROM facts"""))
def _(spark, sf):
    return M.header(T.facts(spark, sf), PERIOD)


@query("snk11_summary_document", V("""
SELECT level, CASE WHEN level IN ('agent', 'model') THEN row_number() OVER (PARTITION BY level ORDER BY total DESC, agent, label) END AS place, agent, label, calls, sessions, total, estimated_calls
FROM (""" + _FIGURES + """ FROM gr GROUP BY 1, 2, 3)""", lab=_LABELLED, gr=_ROWS))
def _(spark, sf):
    """Every entry of the document that has calls, read back from its JSON, ranked ones with their place."""
    f = T.facts(spark, sf)
    doc = M.document(E.calls_of(f), T.estimates(spark, sf), f, PERIOD)
    v = F.try_parse_json(F.col(doc.columns[0]))
    entry = "struct<agent:string,name:string,model:string,date:string,calls:bigint,sessions:bigint,tokens:struct<total:bigint>,estimated_calls:bigint>"
    out = None
    for level, path, label in (("total", "totals", None), ("agent", "by_agent", "name"), ("model", "by_model", "model"), ("day", "by_day", "date")):
        listed = F.try_variant_get(v, f"$.{path}", f"array<{entry}>") if label else F.array(F.try_variant_get(v, f"$.{path}", entry))
        rows = doc.select(F.posexplode(listed).alias("i", "e")).where("e.calls > 0").select(
            F.lit(level).alias("level"), (F.col("i") + 1 if level in ("agent", "model") else F.lit(None)).cast("bigint").alias("place"),
            F.coalesce("e.agent", F.lit("")).alias("agent"), (F.col(f"e.{label}") if label else F.lit("")).alias("label"),
            "e.calls", "e.sessions", F.col("e.tokens.total").alias("total"), "e.estimated_calls",
        )
        out = rows if out is None else out.unionByName(rows)
    return out
