"""Log-export bodies: flattening, claims and mapped events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wattledger.catalog import query
from wattledger.catalog.attribution import r
from wattledger.catalog.prelude import iso, with_views as V
from wattledger.operators import otlp as O
from wattledger.session import cut
from wattledger.sources import bodies as EB
from wattledger.sources import tables as T

PER_BODY = 50


def bodies(spark, sf):
    """Export requests of 50 log records each, built from the event log.

    Views become calls of vendor A, vendor B or the semantic convention by ``k % 3``; signups start
    conversations, clicks are tool results, the rest is other logging.
    """
    k = F.col("k")
    log = T.event_log(spark, sf)

    def attr(key, s=None, i=None, d=None, b=None):
        none = lambda t: F.lit(None).cast(t)
        return F.struct(
            F.lit(key).alias("key"),
            F.struct(
                (s if s is not None else none("string")).alias("stringValue"), (i if i is not None else none("string")).alias("intValue"),
                (d if d is not None else none("double")).alias("doubleValue"), (b if b is not None else none("boolean")).alias("boolValue"),
            ).alias("value"),
        )

    whole = lambda c: c.cast("string")
    model = F.concat(F.lit("m"), (k % 6).cast("string"))
    session = F.concat(F.lit("/"), "session_id")
    a = F.array(
        attr("session.id", s=session), F.when(k % 7 != 0, attr("model", s=model)), attr("input_tokens", i=whole(k * 100)),
        attr("output_tokens", s=whole(k * 10)), attr("cache_read_tokens", d=(k * 1.0)), attr("cache_creation_tokens", d=(k + 0.5)),
        F.when(k % 2 == 0, attr("request_id", s=F.concat(F.lit("req-"), "event_id"))), attr("duration_ms", i=whole(k * 20)),
    )
    b = F.array(
        attr("event.name", s=F.lit("codex.sse_event")), attr("event.kind", s=F.lit("response.completed")),
        attr("conversation.id", s=session), F.when(k % 7 != 0, attr("model", s=model)),
        F.when(k % 5 != 0, attr("input_token_count", i=whole(k * 100))), F.when(k % 5 != 0, attr("output_token_count", i=whole(k * 10))),
        attr("event.timestamp", s=T.format_ms("ts_ms")),
    )
    g = F.array(
        attr("gen_ai.provider.name", s=F.lit("mistral")), F.when(k % 2 == 0, attr("gen_ai.request.model", s=model)),
        F.when(k % 7 != 0, attr("gen_ai.response.model", s=F.concat(model, F.lit("-x")))),
        attr("gen_ai.conversation.id", s=session), attr("gen_ai.usage.output_tokens", i=whole(k * 10)),
        F.when(k % 4 == 0, attr("error.type", s=F.lit("timeout"))), attr("gen_ai.request.stream", b=(k % 2 == 0)),
    )
    start = F.array(
        attr("event.name", s=F.lit("codex.conversation_starts")), attr("conversation.id", s=session),
        F.when(k % 3 != 0, attr("provider_name", s=F.concat(F.lit(" P"), (k % 4).cast("string"), F.lit(" ")))),
    )
    tool = F.array(
        attr("event.name", s=F.lit("codex.tool_result")), attr("conversation.id", s=session),
        attr("tool_name", s=T.pick(("exec_command", "apply_patch", "web_search", "mcp__x", "spawn_agent", "view_image"), k)),
        F.when(k % 2 == 0, attr("call_id", s=F.concat(F.lit("call-"), "event_id"))),
        F.when(k % 9 != 0, attr("duration_ms", i=whole(k * 1000))), F.when(k % 3 != 0, attr("success", b=(k % 3 == 1))),
    )
    other = F.array(attr("note", s=F.col("event_type")))
    kind = F.col("event_type")
    attrs = F.array_compact(
        F.when(kind == "view", F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise(g)).when(kind == "signup", start).when(kind == "click", tool).otherwise(other)
    )
    text = F.when((kind == "view") & (k % 3 == 0), O.VENDOR_A_BODY).when((kind == "view") & (k % 3 == 2), O.GENAI_BODY).otherwise("log")
    # Vendor B calls carry no nanosecond time, so their own timestamp is used.
    nano = F.when(~((kind == "view") & (k % 3 == 1)), (F.col("ts_ms") * 1_000_000 + 500_000).cast("string"))
    record = F.struct(nano.alias("timeUnixNano"), F.struct(text.alias("stringValue")).alias("body"), attrs.alias("attributes"))
    return (
        log.withColumn("body_id", F.floor(F.col("arrival") / PER_BODY).cast("bigint"))
        .groupBy("body_id")
        .agg(F.array_sort(F.collect_list(F.struct("arrival", record.alias("record")))).alias("rs"))
        .select(
            "body_id", F.col("body_id").alias("arrival"),
            F.to_json(
                F.struct(
                    F.array(
                        F.struct(
                            F.struct(F.array(attr("app.version", s=F.lit("9.9"))).alias("attributes")).alias("resource"),
                            F.array(
                                F.struct(
                                    F.struct(F.lit("exporter").alias("name"), F.array(attr("app.version", s=F.lit("1.2"))).alias("attributes")).alias("scope"),
                                    F.transform("rs", lambda x: x["record"]).alias("logRecords"),
                                )
                            ).alias("scopeLogs"),
                        )
                    ).alias("resourceLogs")
                )
            ).alias("body"),
        )
    )


_REC = """
  SELECT *, arrival // 50 AS body_id, arrival % 50 AS idx, '/' || session_id AS raw_session, 'm' || CAST(k % 6 AS VARCHAR) AS model,
    CASE WHEN event_type = 'view' AND k % 3 = 0 THEN 'vendor_a' WHEN event_type = 'view' AND k % 3 = 1 THEN 'vendor_b_call'
         WHEN event_type = 'view' THEN 'gen_ai' WHEN event_type = 'signup' THEN 'vendor_b_session' WHEN event_type = 'click' THEN 'vendor_b_tool' END AS who FROM ev"""
_CLAIM = """
  SELECT *, CASE who WHEN 'vendor_a' THEN CASE WHEN k % 7 <> 0 THEN 'event' ELSE 'dropped' END
     WHEN 'vendor_b_call' THEN CASE WHEN k % 7 <> 0 AND k % 5 <> 0 THEN 'event' WHEN k % 5 <> 0 THEN 'dropped' ELSE 'unclaimed' END
     WHEN 'gen_ai' THEN CASE WHEN k % 2 = 0 OR k % 7 <> 0 THEN 'event' ELSE 'dropped' END
     WHEN 'vendor_b_session' THEN 'event' WHEN 'vendor_b_tool' THEN CASE WHEN k % 9 <> 0 THEN 'event' ELSE 'dropped' END
     ELSE 'unclaimed' END AS outcome FROM rec"""
_X = dict(rec=_REC, claim=_CLAIM)


def _records(spark, sf):
    return O.decode(T.balanced(bodies(spark, sf)))[0]


def _claimed(spark, sf):
    return O.normalize(_records(spark, sf))


@query("src7_log_bodies", V("""
SELECT 'fine' AS outcome, records, count(*) AS bodies FROM (SELECT body_id, count(*) AS records FROM rec WHERE body_id % 20 <> 0 AND body_id % 7 <> 3 GROUP BY 1) GROUP BY 2
UNION ALL SELECT CASE WHEN body_id % 20 = 0 THEN 'over capacity' ELSE 'not JSON' END, CAST(NULL AS BIGINT), count(DISTINCT body_id) FROM rec WHERE body_id % 20 = 0 OR body_id % 7 = 3 GROUP BY 1""", rec=_REC))
def _(spark, sf):
    """Bodies written out one per line, some torn and some too large, streamed back by the reader, and put in quarantine or flattened."""
    from wattledger.catalog.streams import drain
    from wattledger.session import shared_dir

    folder = f"{shared_dir(spark)}/bodies-{uuid.uuid4().hex}"
    body = F.col("body")
    torn = F.when((F.col("body_id") % 20 != 0) & (F.col("body_id") % 7 == 3), F.substring(body, F.lit(1), (F.length(body) / 2).cast("int"))).otherwise(body)
    _with_large(bodies(spark, sf)).select(torn.alias("value")).repartition(4).write.text(folder)
    got = drain(EB.stream_bodies(spark, folder, per="line"))
    records, refused = O.decode(got)
    counts = records.groupBy("body_id").agg(F.count(F.lit(1)).alias("records")).groupBy("records").agg(F.count(F.lit(1)).alias("bodies"))
    bad = EB.quarantine(got, refused).groupBy("reason").agg(F.count(F.lit(1)).alias("bodies"))
    return counts.select(F.lit("fine").alias("outcome"), "records", "bodies").union(bad.select("reason", F.lit(None).cast("bigint"), "bodies"))


@query("ot1_flatten", V("SELECT body_id, idx AS index, CASE WHEN who = 'vendor_a' THEN 'claude_code.api_request' WHEN who = 'gen_ai' THEN 'gen_ai.client.inference.operation.details' ELSE 'log' END AS record_body FROM rec", rec=_REC))
def _(spark, sf):
    return _records(spark, sf).select("body_id", F.col("index").cast("bigint").alias("index"), "record_body")


def _with_large(b):
    """Bodies of which every twentieth is above the record limit."""
    repeated = F.format_string(
        '{"id":%d,"resourceLogs":[{"scopeLogs":[{"logRecords":[%s]}]}]}', F.col("body_id"), F.concat(F.repeat(F.lit("{},"), 10_000), F.lit("{}"))
    )
    return b.withColumn("body", F.when(F.col("body_id") % 20 == 0, repeated).otherwise(F.col("body")))


@query("ot2_over_capacity", V("SELECT body_id, 'over capacity' AS reason FROM rec WHERE body_id % 20 = 0 GROUP BY 1", rec=_REC))
def _(spark, sf):
    """Every twentieth body is repeated until it is above the record limit."""
    return O.decode(_with_large(bodies(spark, sf)))[1].select("body_id", "reason")


@query("ot3_attribute_caps", """
SELECT doc_id, octet_length(encode(text)) <= 16384 AS kept FROM documents""")
def _(spark, sf):
    """Document texts as attribute values, four times over; those above 64 KiB are left out."""
    docs = T.table(spark, sf, "documents")
    value = F.struct(F.struct(F.lit("doc").alias("key"), F.struct(F.repeat(F.col("text"), 4).alias("stringValue")).alias("value")).alias("a"))
    v = F.try_parse_json(F.to_json(F.struct(F.array(value["a"]).alias("attributes"))))
    return docs.select("doc_id", F.map_contains_key(O.attributes(v, "$.attributes"), "doc").alias("kept"))


@query("ot4_precedence", V("SELECT body_id, idx AS index, '1.2' AS version FROM rec", rec=_REC))
def _(spark, sf):
    return _records(spark, sf).select("body_id", F.col("index").cast("bigint").alias("index"), O.get_string("app.version").alias("version"))


@query("ot5_typed_getters", V("SELECT body_id, idx AS index, k * 100 AS input, k * 10 AS output, k AS cache_read, CAST(NULL AS BIGINT) AS cache_write FROM rec WHERE who = 'vendor_a'", rec=_REC))
def _(spark, sf):
    return _records(spark, sf).where(F.col("record_body") == O.VENDOR_A_BODY).select(
        "body_id", F.col("index").cast("bigint").alias("index"), O.get_u64("input_tokens").alias("input"), O.get_u64("output_tokens").alias("output"),
        O.get_u64("cache_read_tokens").alias("cache_read"), O.get_u64("cache_creation_tokens").alias("cache_write"),
    )


@query("ot6_record_time", V("SELECT body_id, idx AS index, ts_ms AS time_ms FROM rec WHERE who IS DISTINCT FROM 'vendor_b_call'", rec=_REC))
def _(spark, sf):
    return _records(spark, sf).where("time_nano is not null").select(
        "body_id", F.col("index").cast("bigint").alias("index"), O.nano_ms(F.col("time_nano")).alias("time_ms")
    )


@query("ot7_ordered_claim", V("SELECT CASE WHEN outcome <> 'unclaimed' THEN who END AS normalizer, outcome, count(*) AS records FROM claim GROUP BY 1, 2", **_X))
def _(spark, sf):
    return _claimed(spark, sf).groupBy("normalizer", "outcome").agg(F.count(F.lit(1)).alias("records"))


def _events(spark, sf, who):
    return _claimed(spark, sf).where((F.col("normalizer") == who) & (F.col("outcome") == "event")).select(F.col("record_seq").alias("seq"), "event.*")


_SEQ = "body_id * 10000 + idx AS seq"


@query("ot8_vendor_a_calls", V(f"""
SELECT {_SEQ}, session_id, replace({iso('ts_ms')}, 'Z', '5Z') AS ts, model, k * 100 AS input, k * 10 AS output, k * 20 AS duration_ms FROM claim WHERE who = 'vendor_a' AND outcome = 'event'""", **_X))
def _(spark, sf):
    c = F.col("llm_call")
    return _events(spark, sf, "vendor_a").select(
        "seq", "session_id", "ts", c["model_id_requested"].alias("model"), c["usage"]["input_tokens"].alias("input"),
        c["usage"]["output_tokens"].alias("output"), c["duration_ms"].alias("duration_ms"),
    )


@query("ot9_event_ids", V(f"""
SELECT {_SEQ}, CASE WHEN k % 2 = 0 THEN 'otlp-req-' || event_id END AS given_id, true AS long_enough FROM claim WHERE who = 'vendor_a' AND outcome = 'event'""", **_X))
def _(spark, sf):
    return _events(spark, sf, "vendor_a").select(
        "seq", F.when(F.col("event_id").startswith("otlp-req-"), F.col("event_id")).alias("given_id"), (F.length("event_id") >= 16).alias("long_enough")
    )


@query("ot10_vendor_b_sessions", V(f"SELECT {_SEQ}, session_id, 'codex' AS app, '1.2' AS version FROM claim WHERE who = 'vendor_b_session'", **_X))
def _(spark, sf):
    app = F.col("session_meta.agent_app")
    return _events(spark, sf, "vendor_b_session").select("seq", "session_id", app["name"].alias("app"), app["version"].alias("version"))


@query("ot11_vendor_b_calls", V(f"SELECT {_SEQ}, session_id, {iso('ts_ms')} AS ts, model, k * 100 AS input, k * 10 AS output FROM claim WHERE who = 'vendor_b_call' AND outcome = 'event'", **_X))
def _(spark, sf):
    c = F.col("llm_call")
    return _events(spark, sf, "vendor_b_call").select(
        "seq", "session_id", "ts", c["model_id_requested"].alias("model"), c["usage"]["input_tokens"].alias("input"), c["usage"]["output_tokens"].alias("output")
    )


@query("ot12_vendor_b_tools", V(f"""
SELECT {_SEQ}, session_id, {iso('ts_ms - k * 1000')} AS t_start, {iso('ts_ms')} AS t_end, ['bash','file_op','web','mcp','subagent','other'][k % 6 + 1] AS tool_kind,
       ['local','local','remote','unknown','local','unknown'][k % 6 + 1] AS locus, ['unknown','ok','error'][k % 3 + 1] AS status,
       CASE WHEN k % 2 = 0 THEN 'call-' || event_id END AS call_id FROM claim WHERE who = 'vendor_b_tool' AND outcome = 'event'""", **_X))
def _(spark, sf):
    s = F.col("action_span")
    return _events(spark, sf, "vendor_b_tool").select(
        "seq", "session_id", s["t_start"].alias("t_start"), s["t_end"].alias("t_end"), s["tool_kind"].alias("tool_kind"),
        s["execution_locus"].alias("locus"), s["status"].alias("status"), F.when(s["span_id"].startswith("call-"), s["span_id"]).alias("call_id"),
    )


@query("ot13_provider_carry", V(f"""
SELECT seq, coalesce(provider, 'unknown') AS provider FROM (
  SELECT {_SEQ}, who, outcome, last_value(CASE WHEN who = 'vendor_b_session' AND k % 3 <> 0 THEN 'p' || CAST(k % 4 AS VARCHAR) END IGNORE NULLS)
    OVER (PARTITION BY session_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS provider FROM claim)
WHERE who = 'vendor_b_call' AND outcome = 'event'""", **_X))
def _(spark, sf):
    return _events(spark, sf, "vendor_b_call").select("seq", F.col("llm_call.provider").alias("provider"))


@query("ot14_record_time_fallback", V(f"SELECT {_SEQ}, {iso('ts_ms')} AS ts, ts_ms FROM claim WHERE who = 'vendor_b_call' AND outcome = 'event'", **_X))
def _(spark, sf):
    return _events(spark, sf, "vendor_b_call").select("seq", "ts", "ts_ms")


@query("ot15_gen_ai_calls", V(f"""
SELECT {_SEQ}, session_id, CASE WHEN k % 2 = 0 THEN model ELSE model || '-x' END AS requested, CASE WHEN k % 7 <> 0 THEN model || '-x' END AS served,
       CASE WHEN k % 4 = 0 THEN 'error' END AS status, k % 2 = 0 AS streaming, k * 10 AS output FROM claim WHERE who = 'gen_ai' AND outcome = 'event'""", **_X))
def _(spark, sf):
    c = F.col("llm_call")
    return _events(spark, sf, "gen_ai").select(
        "seq", "session_id", c["model_id_requested"].alias("requested"), c["model_id_served"].alias("served"),
        c["status"].alias("status"), c["streaming"].alias("streaming"), c["usage"]["output_tokens"].alias("output"),
    )


@query("ot16_stable_ids", V("SELECT count(*) AS events, count(*) AS distinct_ids FROM claim WHERE outcome = 'event'", **_X))
def _(spark, sf):
    return O.events_of(_claimed(spark, sf)).agg(F.count(F.lit(1)).alias("events"), F.countDistinct("event_id").alias("distinct_ids"))


@query("ot17_dropped_keys", V("""
SELECT body_id, string_agg(key, ',' ORDER BY key) AS attribute_keys FROM (
  SELECT DISTINCT body_id, key FROM (
    SELECT body_id, k, unnest(CASE who
      WHEN 'vendor_a' THEN list_concat(['session.id','input_tokens','output_tokens','cache_read_tokens','cache_creation_tokens','duration_ms'], CASE WHEN k % 2 = 0 THEN ['request_id'] ELSE [] END)
      WHEN 'vendor_b_call' THEN ['event.name','event.kind','conversation.id','input_token_count','output_token_count','event.timestamp']
      WHEN 'gen_ai' THEN list_concat(['gen_ai.provider.name','gen_ai.conversation.id','gen_ai.usage.output_tokens','gen_ai.request.stream'], CASE WHEN k % 4 = 0 THEN ['error.type'] ELSE [] END)
      ELSE list_concat(list_concat(['event.name','conversation.id','tool_name'], CASE WHEN k % 2 = 0 THEN ['call_id'] ELSE [] END), CASE WHEN k % 3 <> 0 THEN ['success'] ELSE [] END) END) AS key
    FROM claim WHERE outcome = 'dropped')) GROUP BY 1""", **_X))
def _(spark, sf):
    return O.dropped_keys(_claimed(spark, sf)).select("body_id", F.array_join("attribute_keys", ",").alias("attribute_keys"))


@query("ot19_receiver_counters", V("""
SELECT count(*) FILTER (outcome = 'event' AND body_id % 20 <> 0) AS accepted, count(*) FILTER (outcome = 'dropped' AND body_id % 20 <> 0) AS dropped,
       count(*) FILTER (outcome = 'unclaimed' AND body_id % 20 <> 0) AS unclaimed, count(DISTINCT body_id) AS requests,
       count(DISTINCT CASE WHEN body_id % 20 = 0 THEN body_id END) AS bodies_refused, count(DISTINCT CASE WHEN event_type = 'purchase' THEN body_id END) AS metrics_discarded FROM claim""", **_X))
def _(spark, sf):
    """Every twentieth body is above the record limit and refused whole.

    Records, refusals and requests are counted over the same bodies, which are made once.
    """
    b = cut(_with_large(bodies(spark, sf)))
    records, refused = O.decode(b)
    metrics = T.event_log(spark, sf).where("event_type = 'purchase'").select(F.floor(F.col("arrival") / PER_BODY).alias("body_id")).distinct()
    return O.receiver_counters(b, O.normalize(records), refused, metrics)
