"""What the sinks and rebuilds write, as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wattledger.catalog import query
from wattledger.catalog.events import _CLASS, _OUTCOME, _classified
from wattledger.catalog.impacts import _ALL, ZONE_GWP, joins
from wattledger.catalog.prelude import iso, with_views as V
from wattledger.operators import estimation as E
from wattledger.operators import impacts as J
from wattledger.operators import validate as X
from wattledger.plans import reads as R
from wattledger.plans import rebuild as B
from wattledger.plans import store as P
from wattledger.session import cut, shared_dir
from wattledger.sources import tables as T

_TS = iso("ts_ms")


@query("snk1_new_facts", V("SELECT event_id, type, arrival FROM facts WHERE arrival >= (SELECT max(arrival) // 2 FROM facts)"))
def _(spark, sf):
    """A batch of late and repeated facts against a store that has the first half: each event once, earliest first."""
    facts = T.facts(spark, sf)
    half = facts.agg(F.expr("max(arrival) div 2")).scalar()
    again = facts.withColumn("arrival", F.col("arrival") + 1_000_000)
    stored = facts.where(F.col("arrival") < half)
    return P.new_rows(facts.unionByName(again), stored).select("event_id", "type", "arrival")


@query("snk1_order_lines", """
SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem)
WHERE n = 1 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def _(spark, sf):
    """The same append at volume: first line of each order, unless the order is closed."""
    lines = T.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("q")).alias("arrival")
    )
    stored = T.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return P.new_rows(lines, stored, "l_orderkey").drop("arrival")


@query("snk2_new_opaque", V("SELECT event_id, 'tool_trace' AS type FROM c WHERE outcome = 'opaque'", o=_OUTCOME, c=_CLASS))
def _(spark, sf):
    events = X.opaque_events(_classified(spark, sf))
    return P.new_rows(events.unionByName(events), events.limit(0)).select("event_id", "type")


@query("snk3_upsert_estimates", V("SELECT event_id, CASE WHEN k % 2 = 0 THEN 'ok' ELSE status END AS status FROM ests"))
def _(spark, sf):
    stored = T.estimates(spark, sf)
    log = T.event_log(spark, sf).select("event_id", "k")
    batch = stored.join(log, "event_id").where("k % 2 = 0").withColumn("status", F.lit("ok")).drop("k")
    return P.upserted(stored, batch).select("event_id", "status")


@query("snk4_changed_joins", V("""
SELECT u.unit_key, true AS changed FROM units u WHERE u.session_id IN (SELECT session_id FROM calls WHERE k = 10)""", **{k: _ALL[k] for k in ("units",)}))
def _(spark, sf):
    """A record differs when anything in it does: here the stored copies of some sessions are older."""
    fresh = J.join_records(joins(spark, sf))
    moved = E.calls_of(T.facts(spark, sf)).where(F.col("usage.output_tokens") == 100).select("session_id").distinct()
    old = fresh.join(moved.withColumn("moved", F.lit(True)), "session_id", "left").select(
        "unit_key", "session_id", F.when(F.col("moved"), F.lit("{}")).otherwise(F.col("json")).alias("json")
    )
    return P.changed_joins(old, fresh).select("unit_key", "changed")


_REJ = "SELECT arrival AS id FROM c WHERE outcome = 'rejected'"


@query("snk6_stored_rejects", V("SELECT id, origin, reason_kind FROM (SELECT arrival AS id, collector || ':' || session_id AS origin, reason_kind FROM c WHERE outcome = 'rejected')", o=_OUTCOME, c=_CLASS))
def _(spark, sf):
    """Rejects in two batches of one store, the second with the first's rows again: all are kept, each once."""
    store = P.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    rows = cut(X.reject_rows(_classified(spark, sf)))
    half = rows.agg(F.expr("max(id) div 2")).first()[0] or 0
    store.insert_rejects(rows.where(F.col("id") < half), 1_000)
    store.insert_rejects(rows, 2_000)
    return store.read("rejects").select("id", "origin", "reason_kind")


@query("snk6_newest_rejects", V("SELECT id FROM rej ORDER BY id DESC LIMIT 1000", o=_OUTCOME, c=_CLASS, rej=_REJ))
def _(spark, sf):
    return R.keep_newest(X.reject_rows(_classified(spark, sf)), "id", 1000).select("id")


@query("snk8_one_commit", V("""
SELECT 'facts' AS name, count(*) AS rows FROM c WHERE outcome = 'known' UNION ALL SELECT 'opaque', count(*) FROM c WHERE outcome = 'opaque'
UNION ALL SELECT 'rejects', count(*) FROM c WHERE outcome = 'rejected'""", o=_OUTCOME, c=_CLASS))
def _(spark, sf):
    """Two batches of lines through the ingest, the second delivered three times, once under a new number: no row twice."""
    from wattledger.catalog.events import lines
    from wattledger.sources import spool
    from wattledger.streaming import ingest

    store = P.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    rows = cut(spool.with_origin(lines(spark, sf)).withColumnRenamed("arrival", "byte_offset"))
    half = rows.agg(F.expr("max(byte_offset) div 2")).first()[0] or 0
    ingest.ingest_batch(store, rows.where(F.col("byte_offset") < half), 0)
    second = rows.where(F.col("byte_offset") >= half)
    for batch in (1, 1, 2):
        ingest.ingest_batch(store, second, batch)
    counts = [store.read(n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")) for n in ("facts", "opaque", "rejects")]
    return counts[0].union(counts[1]).union(counts[2])


@query("rq11_recent_rejects", V("SELECT id FROM rej ORDER BY id DESC LIMIT 20", o=_OUTCOME, c=_CLASS, rej=_REJ))
def _(spark, sf):
    return R.recent_rejects(X.reject_rows(_classified(spark, sf)), 20).select("id")


@query("snk9_report_documents", V("""
SELECT f.session_id, u.n AS joins, count(*) AS events FROM facts f JOIN (SELECT session_id, count(*) AS n FROM units GROUP BY 1) u USING (session_id) GROUP BY 1, 2""", **{k: _ALL[k] for k in ("units",)}))
def _(spark, sf):
    docs = P.report_documents(R.session_summaries(T.facts(spark, sf)), J.join_records(joins(spark, sf)))
    v = F.try_parse_json("document")
    counts = F.try_variant_get(v, "$.event_counts", "map<string,bigint>")
    return docs.select(
        "session_id", F.size(F.try_variant_get(v, "$.joins", "array<variant>")).cast("bigint").alias("joins"),
        F.aggregate(F.map_values(counts), F.lit(0).cast("bigint"), lambda a, n: a + n).alias("events"),
    )


@query("snk10_report_lines", V(f"""
SELECT session_id || chr(9) || string_agg(type || '=' || CAST(n AS VARCHAR), ',' ORDER BY type) || chr(9) || min(f) || chr(9) || max(l) AS line
FROM (SELECT session_id, type, count(*) AS n, min({_TS}) AS f, max({_TS}) AS l FROM facts GROUP BY 1, 2) GROUP BY session_id"""))
def _(spark, sf):
    s = R.summary_text(R.session_summaries(T.facts(spark, sf)))
    return s.select(F.concat_ws("\t", "session_id", "event_counts", "first_ts", "last_ts").alias("line"))


@query("snk12_event_lines", V(f"""
SELECT event_id, '{{"collector":{{"name":"' || collector || '","version":"0.1.0"}},"event_id":"' || event_id || '","payload":{{"agent_app":{{"name":"' || ['claude-code','codex','opencode'][k % 3 + 1] || '","version":"1.0"}}' ||
  CASE k % 4 WHEN 0 THEN ',"geo_zone":""' WHEN 1 THEN ',"geo_zone":"FRA"' WHEN 2 THEN ',"geo_zone":"DEU"' ELSE '' END || ',"hardware":{{"cpu_model":"cpu","gpu_models":[],"ram_gb":' || CAST(k AS VARCHAR) || '}},"os":"' || ['linux','macos'][k % 2 + 1] ||
  '","power_source":"' || ['ac','battery','unknown'][k % 3 + 1] || '"}},"schema_version":"0.1.0","session_id":"' || session_id || '","ts":"' || {_TS} || '","type":"session_meta"}}' AS value
FROM facts WHERE type = 'session_meta'
UNION ALL SELECT event_id, '{{"session_id":"' || session_id || '","ts":"' || {_TS} || '","type":"' || type || '"}}' FROM facts WHERE type <> 'session_meta'"""))
def _(spark, sf):
    """Whole lines of session records, and the fields all lines share of the others."""
    out = X.event_lines(T.facts(spark, sf))
    v = F.try_parse_json("value")
    kind = F.try_variant_get(v, "$.type", "string")
    shared = F.concat(
        F.lit('{"session_id":"'), F.try_variant_get(v, "$.session_id", "string"), F.lit('","ts":"'), F.try_variant_get(v, "$.ts", "string"),
        F.lit('","type":"'), kind, F.lit('"}'),
    )
    return out.select("event_id", F.when(kind == "session_meta", F.col("value")).otherwise(shared).alias("value"))


# ---------------------------------------------------------------- rebuild

SETTINGS = B.Settings("FRA", "flag", ZONE_GWP, "FRA")


@query("rb1_rebuild_all", V("SELECT unit_key, session_id FROM units", **{k: _ALL[k] for k in ("units",)}))
def _(spark, sf):
    out = B.records(T.facts(spark, sf), T.estimates(spark, sf), SETTINGS)
    return out.where("json is not null").select("unit_key", "session_id")


@query("rb2_rebuild_scope", V("SELECT unit_key, session_id FROM units WHERE session_id IN (SELECT session_id FROM calls WHERE k = 3)", **{k: _ALL[k] for k in ("units",)}))
def _(spark, sf):
    log = T.event_log(spark, sf).where("event_type = 'view' and k = 3")
    return B.records(T.facts(spark, sf), T.estimates(spark, sf), SETTINGS, log).select("unit_key", "session_id")


_TOUCHED = "SELECT session_id, bool_and(type IN ('energy_sample','process_sample')) AS samples_only, min(ts_ms) AS since_ms FROM facts WHERE ts_ms >= 1706486400000 GROUP BY 1"


@query("rb6_due_sessions", V("""
SELECT t.session_id FROM touched t LEFT JOIN (SELECT DISTINCT session_id FROM ev WHERE event_type = 'signup' AND k < 60) b USING (session_id)
WHERE NOT t.samples_only OR b.session_id IS NULL OR 1706572800000 - t.since_ms >= 6 * 10000000""", touched=_TOUCHED))
def _(spark, sf):
    batch = T.facts(spark, sf).where("ts_ms >= 1706486400000")
    known = T.event_log(spark, sf).where("event_type = 'signup' and k < 60").select("session_id").distinct()
    return B.due_sessions(B.batch_kinds(batch), known, 1706572800000, 10_000_000)


@query("rb7_zone_change", V("SELECT DISTINCT session_id FROM facts"))
def _(spark, sf):
    facts = T.facts(spark, sf)
    return B.zone_scope(B.batch_kinds(facts.where("ts_ms >= 1706486400000")), facts, "FRA", "WOR")


@query("rb8_estimated_sessions", V("SELECT DISTINCT session_id FROM ests WHERE status = 'ok'"))
def _(spark, sf):
    return B.sessions_of_estimates(T.estimates(spark, sf).where("status = 'ok'"))


@query("rb9_stored_estimates_only", V("""
SELECT unit_key, llm_calls, ok_n AS ok_estimates FROM joined""", **_ALL))
def _(spark, sf):
    return joins(spark, sf).select("unit_key", "llm_calls", F.coalesce("ok_estimates", F.lit(0)).alias("ok_estimates"))
