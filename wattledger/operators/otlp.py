"""Log exports (OTLP/JSON) to events: flatten, claim by the first matching normaliser, map.

A body is one export request.  Bodies are flattened to one row per log record with a body-wide
index; an ordered list of normalisers then claims rows in a single ``when`` chain.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger import schemas as S
from wattledger.functions import format_ms, parse_ms, provider_id, sanitize_id, stable_id
from wattledger.operators.ordered import last_before
from wattledger.session import cut

# Fixed values of the contract: names the exporters use.
VENDOR_A_BODY = "claude_code.api_request"
VENDOR_B_SESSION = "codex.conversation_starts"
VENDOR_B_CALL = "codex.sse_event"
VENDOR_B_CALL_KIND = "response.completed"
VENDOR_B_TOOL = "codex.tool_result"
GENAI_BODY = "gen_ai.client.inference.operation.details"
GENAI_SCOPE = "opentelemetry.instrumentation.genai"
VENDOR_B_USAGE = (
    "input_token_count", "output_token_count", "cached_token_count", "cache_write_token_count", "reasoning_token_count",
)
VENDOR_B_TOOLS = {
    "exec_command": "bash",
    "shell": "bash",
    "apply_patch": "file_op",
    "file_change": "file_op",
    "web_search": "web",
    "spawn_agent": "subagent",
    "send_input": "subagent",
    "wait_agent": "subagent",
}
LOCUS_OF_KIND = {"bash": "local", "file_op": "local", "subagent": "local", "web": "remote", "mcp": "unknown", "other": "unknown"}

# What is read of a body, in one pass over it.  Leaves stay variants, because their JSON types decide.
_LEAVES = "struct<stringValue:variant,intValue:variant,doubleValue:variant,boolValue:variant>"
_ATTRIBUTES = "array<struct<key:variant,value:variant>>"
_RECORD = f"struct<timeUnixNano:variant,body:struct<stringValue:variant>,attributes:{_ATTRIBUTES}>"
_SCOPE = f"struct<scope:struct<name:variant,attributes:{_ATTRIBUTES}>,logRecords:array<{_RECORD}>>"
_RESOURCES = f"array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeLogs:array<{_SCOPE}>>>"
# For counting alone: no element is copied.
_SIZES = "array<struct<scopeLogs:array<struct<logRecords:array<boolean>>>>>"


def _settled(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows with new columns, generated rather than projected, so that no later use computes them again."""
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.withColumn("x", F.explode(F.array(made))).select("*", "x.*").drop("x")


# ---------------------------------------------------------------- flatten


def _leaf_text(v: Column) -> Column:
    """The string a variant is; null when it is something else."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _typed_map(items: Column) -> Column:
    """An attribute list as a map of (text, count, flag); oversized keys and string values are left out."""
    read = F.transform(
        F.coalesce(items, F.array().cast(_ATTRIBUTES)),
        lambda a: F.struct(
            _leaf_text(a["key"]).alias("key"), a["value"].isNotNull().alias("there"),
            F.try_variant_get(a["value"], "$", _LEAVES).alias("leaves"),
        ),
    )
    typed = F.transform(
        read,
        lambda a: F.struct(
            a["key"].alias("key"), a["there"].alias("there"),
            F.struct(
                _leaf_text(a["leaves"]["stringValue"]).alias("text"), _u64(a["leaves"]).alias("count"), _bool(a["leaves"]).alias("flag")
            ).alias("value"),
        ),
    )
    kept = F.filter(
        typed,
        lambda a: a["there"]
        & (F.octet_length(a["key"]) <= S.MAX_ATTR_KEY_BYTES)
        & (F.coalesce(F.octet_length(a["value"]["text"]), F.lit(0)) <= S.MAX_ATTR_VALUE_BYTES),
    )
    return F.map_from_entries(F.transform(kept, lambda a: F.struct(a["key"].alias("key"), a["value"].alias("value"))))


def attributes(v: Column, path: str) -> Column:
    """Attribute list at a path as a map of typed values: its string, its count and its flag, each null where it is none."""
    return _typed_map(F.try_variant_get(v, path, _ATTRIBUTES))


def record_count(v: Column) -> Column:
    """Log records of a body, counted before anything is flattened."""
    total = lambda sizes: F.aggregate(sizes, F.lit(0), lambda a, n: a + F.coalesce(n, F.lit(0)))
    per_scope = lambda s: F.when(s["logRecords"].isNotNull(), F.size(s["logRecords"]))
    per_resource = lambda r: total(F.transform(r["scopeLogs"], per_scope))
    return F.coalesce(total(F.transform(F.try_variant_get(v, "$.resourceLogs", _SIZES), per_resource)), F.lit(0))


def decode(bodies: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(records, refused bodies).  A body over the record limit is refused whole.

    ``bodies`` carries ``body_id`` and an integer ``arrival``.
    """
    parsed = _settled(bodies, v=F.try_parse_json(body))
    sized = parsed.withColumn("n_records", record_count(F.col("v")))
    over = sized.where(F.coalesce(F.col("n_records") > S.MAX_LOG_RECORDS, F.lit(False)) | F.col("v").isNull()).select(
        "body_id", "arrival", F.when(F.col("v").isNull(), "not JSON").otherwise("over capacity").alias("reason"),
        F.octet_length(body).cast("bigint").alias("bytes"),
    )
    fine = sized.where(F.col("v").isNotNull() & (F.col("n_records") <= S.MAX_LOG_RECORDS)).select("body_id", "arrival", "v")
    # Attributes of a resource and of a scope are read once, not for each of their records.
    scope = lambda s: F.struct(
        _typed_map(s["scope"]["attributes"]).alias("attrs"), _leaf_text(s["scope"]["name"]).alias("name"), s["logRecords"].alias("logs")
    )
    resource = lambda r: F.struct(_typed_map(r["resource"]["attributes"]).alias("attrs"), F.transform(r["scopeLogs"], scope).alias("scopes"))
    read = _settled(fine, tree=F.try_variant_get(F.col("v"), "$.resourceLogs", _RESOURCES))
    listed = _settled(read.drop("v"), resources=F.transform("tree", resource))
    # The index runs over the whole body: it is the place in the list of all its records.
    joined = lambda lists: F.flatten(F.array_compact(lists))
    record = lambda r, s: lambda log: F.struct(
        r["attrs"].alias("resource_attrs"), s["attrs"].alias("scope_attrs"), s["name"].alias("scope_name"), log.alias("log")
    )
    of_resource = lambda r: joined(F.transform(r["scopes"], lambda s: F.transform(s["logs"], record(r, s))))
    rows = listed.select("body_id", "arrival", F.posexplode(joined(F.transform("resources", of_resource))).alias("index", "record"))
    log = F.col("log")
    own = _settled(rows.select("body_id", "arrival", "index", "record.*"), own=_typed_map(log["attributes"]))
    nano = F.try_variant_get(log["timeUnixNano"], "$", "string")
    nano_kind = F.schema_of_variant(log["timeUnixNano"])
    records = own.select(
        "body_id", "arrival", "index", "scope_name", _leaf_text(log["body"]["stringValue"]).alias("record_body"),
        F.when(nano_kind.isin("STRING", "BIGINT") & nano.rlike(r"^[+-]?[0-9]+$"), nano.try_cast("decimal(38,0)")).alias("time_nano"),
        # Later scopes win: record over scope over resource; a present key counts whatever its type.
        F.map_concat("resource_attrs", "scope_attrs", "own").alias("attrs"),
        F.map_keys("own").alias("own_keys"),
    )
    return records, over


# ---------------------------------------------------------------- typed getters


def _attr(key: str) -> Column:
    return F.try_element_at("attrs", F.lit(key))


def has(key: str) -> Column:
    return F.map_contains_key("attrs", key)


def get_string(key: str) -> Column:
    return _attr(key)["text"]


def _digits(value: Column) -> Column:
    return F.when(value.rlike(r"^\+?[0-9]+$"), value.try_cast("bigint"))


def _u64(leaves: Column) -> Column:
    """Count from ``intValue`` (number or digits), else digits in ``stringValue``, else a whole ``doubleValue``.

    An ``intValue`` that is there but unusable does not fall through.
    """
    int_, double = leaves["intValue"], leaves["doubleValue"]
    int_kind = F.schema_of_variant(int_)
    whole = F.try_variant_get(int_, "$", "bigint")
    from_int = F.when(int_kind == "BIGINT", F.when(whole >= 0, whole)).when(
        int_kind == "STRING", _digits(F.try_variant_get(int_, "$", "string"))
    )
    double_kind = F.schema_of_variant(double)
    number = F.when(
        (double_kind == "BIGINT") | (double_kind == "DOUBLE") | double_kind.startswith("DECIMAL"),
        F.try_variant_get(double, "$", "double"),
    )
    from_double = F.when((number >= 0) & (number < 9.2e18) & (F.floor(number) == number), number.cast("bigint"))
    string = leaves["stringValue"]
    return (
        F.when(int_.isNotNull(), from_int)
        .when(F.schema_of_variant(string) == "STRING", _digits(F.try_variant_get(string, "$", "string")))
        .otherwise(F.when(double.isNotNull(), from_double))
    )


def get_u64(key: str) -> Column:
    return _attr(key)["count"]


def _bool(leaves: Column) -> Column:
    flag = leaves["boolValue"]
    return F.when(F.schema_of_variant(flag) == "BOOLEAN", F.try_variant_get(flag, "$", "boolean"))


def get_bool(key: str) -> Column:
    return _attr(key)["flag"]


def nano_ms(nano: Column) -> Column:
    return F.floor(nano / F.lit(1_000_000)).cast("bigint")


def nano_text(nano: Column) -> Column:
    """RFC 3339 text of epoch nanoseconds, with the fraction digits that are needed."""
    seconds = F.floor(nano / F.lit(1_000_000_000)).cast("bigint")
    rest = F.pmod(nano, F.lit(1_000_000_000).cast("decimal(38,0)")).cast("bigint").cast("string")
    fraction = F.rtrim(F.lpad(rest, 9, "0"), F.lit("0"))
    return F.concat(
        F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)),
        F.lit("Z"),
    )


# ---------------------------------------------------------------- normalisers


@dataclass(frozen=True)
class Normalizer:
    """``applies``: whether a record is its business.  ``maps``: whether it can be mapped; ``event``: the mapped event.
    ``drops``: whether an unmappable record is dropped (else it stays unclaimed).  All read typed attributes.
    ``carries``: its event reads ``carried_provider``."""

    name: str
    applies: Callable[[], Column]
    maps: Callable[[], Column]
    event: Callable[[], Column]
    drops: Callable[[], Column] = lambda: F.lit(True)
    carries: bool = False


# Attributes the normalisers read, by type: each is looked up once per record.
STRINGS = (
    "model", "session.id", "request_id", "conversation.id", "event.name", "event.kind", "event.timestamp", "app.version",
    "provider_name", "tool_name", "call_id", "gen_ai.provider.name", "gen_ai.request.model", "gen_ai.response.model",
    "gen_ai.conversation.id", "gen_ai.response.id", "server.address", "error.type",
)
COUNTS = (
    "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "duration_ms", *VENDOR_B_USAGE,
    "gen_ai.usage.input_tokens", "gen_ai.usage.output_tokens", "gen_ai.usage.cache_read.input_tokens",
    "gen_ai.usage.cache_creation.input_tokens",
)
FLAGS = ("success", "gen_ai.request.stream")
PRESENT = ("gen_ai.provider.name", "gen_ai.request.model", "gen_ai.response.model")


def _name(kind_: str, key: str) -> str:
    return f"{kind_}_{key.replace('.', '_')}"


def typed_attributes(records: DataFrame) -> DataFrame:
    """The records with one column for each attribute that a normaliser reads, in place of the attribute map.

    What the normalisers share, the sanitised conversation and the record's time, becomes columns too.  So the code that
    is generated stays short.
    """
    readers = {"text": STRINGS, "count": COUNTS, "flag": FLAGS}
    found = {_name(n, k): _attr(k)[n] for n, keys in readers.items() for k in keys}
    there = {_name("has", k): has(k) for k in PRESENT}
    flat = _settled(records, **found, **there).drop("attrs")
    nano, stamp = F.col("time_nano"), parse_ms(_text("event.timestamp"))
    timed = _settled(flat, conversation=sanitize_id(_text("conversation.id")), stamp_ms=stamp)
    return timed.withColumns({
        "record_ts": F.when(nano > 0, nano_text(nano)).when(F.col("stamp_ms").isNotNull(), _text("event.timestamp")),
        "record_ms": F.when(nano > 0, nano_ms(nano)).otherwise(F.col("stamp_ms")),
    }).drop("stamp_ms")


def _text(key: str) -> Column:
    return F.col(_name("text", key))


def _count(key: str) -> Column:
    return F.col(_name("count", key))


def _flag(key: str) -> Column:
    return F.col(_name("flag", key))


def _has(key: str) -> Column:
    return F.col(_name("has", key))


def _event(event_id, ts, ts_ms, collector, session_id, kind_, tool_call_id=None, **payloads) -> Column:
    null = lambda ddl: F.lit(None).cast(ddl)
    attribution = null(S.ATTRIBUTION) if tool_call_id is None else F.struct(
        null("string"), null("string"), null("string"), tool_call_id
    ).cast(S.ATTRIBUTION)
    names = ("llm_call", "action_span", "session_meta")
    return F.struct(
        event_id.alias("event_id"), ts.alias("ts"), ts_ms.alias("ts_ms"), F.lit(collector).alias("collector"),
        session_id.alias("session_id"), F.lit(kind_).alias("type"), attribution.alias("attribution"),
        *[(payloads[n] if n in payloads else null(S.PAYLOADS[n])).alias(n) for n in names],
    )


def _call(provider, requested, served, endpoint, usage, duration, status, streaming) -> Column:
    null = F.lit(None)
    return F.struct(
        provider, requested, served if served is not None else null, endpoint if endpoint is not None else null,
        F.struct(*usage), F.lit("agent_telemetry"), duration if duration is not None else null,
        status if status is not None else null, streaming if streaming is not None else null,
    ).cast(S.LLM_CALL)


def _session(*keys: str) -> Column:
    return F.coalesce(*[sanitize_id(_text(k)) for k in keys], F.lit("unknown"))


def _vendor_a_event() -> Column:
    nano, model = F.col("time_nano"), _text("model")
    session, request = _session("session.id"), _text("request_id")
    tokens_in, tokens_out = _count("input_tokens"), _count("output_tokens")
    given = F.concat(F.lit("otlp-"), request)
    event_id = (
        F.when(request.isNull(), stable_id("otlp", session, nano, model, tokens_in, tokens_out, F.col("index")))
        .when(F.octet_length(given) >= S.MIN_EVENT_ID_LEN, given)
        .otherwise(F.concat(given, F.substring(stable_id("", request), 1, 17)))
    )
    usage = [tokens_in, tokens_out, F.lit(None).cast("bigint"), _count("cache_read_tokens"), _count("cache_creation_tokens")]
    call = _call(F.lit("anthropic"), model, None, None, usage, _count("duration_ms"), None, None)
    return _event(event_id, nano_text(nano), nano_ms(nano), "otlp-cc", session, "llm_call", llm_call=call)


def _vendor_a_maps() -> Column:
    return _text("model").isNotNull() & F.col("time_nano").isNotNull()


def _conversation() -> Column:
    return F.col("conversation")


def _vendor_b_time() -> tuple[Column, Column]:
    """(text, epoch ms): a positive ``timeUnixNano``, else the record's own timestamp kept as text."""
    return F.col("record_ts"), F.col("record_ms")


def _vendor_b_session() -> Column:
    ts, ms = _vendor_b_time()
    null = F.lit(None)
    meta = F.struct(F.struct(F.lit("codex"), _text("app.version")), null, null, null, null).cast(S.SESSION_META)
    event_id = stable_id("otlp-codex-session", _conversation(), ms, F.col("index"))
    return _event(event_id, ts, ms, "otlp-codex", _conversation(), "session_meta", session_meta=meta)


def _vendor_b_session_maps() -> Column:
    return _conversation().isNotNull() & _vendor_b_time()[0].isNotNull()


def _vendor_b_usage() -> list[Column]:
    return [_count(k) for k in VENDOR_B_USAGE]


def _vendor_b_call() -> Column:
    ts, ms = _vendor_b_time()
    model = _text("model")
    tokens_in, tokens_out, cached, written, thought = _vendor_b_usage()
    provider = F.coalesce("carried_provider", F.lit("unknown"))
    call = _call(provider, model, None, None, [tokens_in, tokens_out, thought, cached, written], None, F.lit("ok"), F.lit(True))
    event_id = stable_id("otlp-codex", _conversation(), ms, model, tokens_in, tokens_out, cached, thought, F.col("index"))
    return _event(event_id, ts, ms, "otlp-codex", _conversation(), "llm_call", llm_call=call)


def _any_usage() -> Column:
    return F.coalesce(*_vendor_b_usage()).isNotNull()


def _vendor_b_call_maps() -> Column:
    return _vendor_b_session_maps() & _text("model").isNotNull() & _any_usage()


def vendor_b_tool_kind(name: Column) -> Column:
    from wattledger.functions import lookup

    return F.coalesce(lookup(name, VENDOR_B_TOOLS), F.when(name.startswith("mcp__"), F.lit("mcp")), F.lit("other"))


def _vendor_b_tool() -> Column:
    from wattledger.functions import lookup

    _, ms = _vendor_b_time()
    name, call_id, duration = _text("tool_name"), _text("call_id"), _count("duration_ms")
    tool = vendor_b_tool_kind(name)
    span_id = F.coalesce(call_id, stable_id("codex-call", _conversation(), ms, name, duration, F.col("index")))
    success = _flag("success")
    span = F.struct(
        span_id, name, tool, lookup(tool, LOCUS_OF_KIND), format_ms(ms - duration), format_ms(ms),
        F.lit(None), F.lit(None), F.when(success, "ok").when(~success, "error").otherwise("unknown"),
    ).cast(S.ACTION_SPAN)
    event_id = stable_id("otlp-codex-tool", span_id)
    return _event(event_id, format_ms(ms), ms, "otlp-codex", _conversation(), "action_span", span_id, action_span=span)


def _vendor_b_tool_maps() -> Column:
    needed = (_conversation(), _text("tool_name"), _count("duration_ms"), _vendor_b_time()[1])
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in needed])


def _genai_applies() -> Column:
    scoped = F.coalesce(F.col("scope_name").startswith(GENAI_SCOPE), F.lit(False))
    model = _has("gen_ai.request.model") | _has("gen_ai.response.model")
    return F.coalesce(F.col("record_body") == GENAI_BODY, F.lit(False)) | (scoped & _has("gen_ai.provider.name") & model)


def _genai_event() -> Column:
    nano, provider = F.col("time_nano"), _text("gen_ai.provider.name")
    served = _text("gen_ai.response.model")
    requested = F.coalesce(_text("gen_ai.request.model"), served)
    session, response = _session("session.id", "gen_ai.conversation.id"), _text("gen_ai.response.id")
    event_id = F.when(response.isNotNull(), stable_id("otlp-genai", response)).otherwise(
        stable_id("otlp-genai", session, nano, provider, requested, F.col("index"))
    )
    usage = [
        _count("gen_ai.usage.input_tokens"), _count("gen_ai.usage.output_tokens"), F.lit(None).cast("bigint"),
        _count("gen_ai.usage.cache_read.input_tokens"), _count("gen_ai.usage.cache_creation.input_tokens"),
    ]
    status = F.when(_text("error.type").isNotNull(), "error")
    call = _call(provider, requested, served, _text("server.address"), usage, None, status, _flag("gen_ai.request.stream"))
    return _event(event_id, nano_text(nano), nano_ms(nano), "otlp-genai", session, "llm_call", llm_call=call)


def _genai_maps() -> Column:
    model = F.coalesce(_text("gen_ai.request.model"), _text("gen_ai.response.model"))
    return _text("gen_ai.provider.name").isNotNull() & model.isNotNull() & F.col("time_nano").isNotNull()


def _named(name: str) -> Column:
    return F.coalesce(_text("event.name") == name, F.lit(False))


# First match wins.
NORMALIZERS: tuple[Normalizer, ...] = (
    Normalizer(
        "vendor_a", lambda: F.coalesce(F.col("record_body") == VENDOR_A_BODY, F.lit(False)), _vendor_a_maps, _vendor_a_event
    ),
    Normalizer("vendor_b_session", lambda: _named(VENDOR_B_SESSION), _vendor_b_session_maps, _vendor_b_session),
    Normalizer(
        "vendor_b_call",
        lambda: _named(VENDOR_B_CALL) & F.coalesce(_text("event.kind") == VENDOR_B_CALL_KIND, F.lit(False)),
        _vendor_b_call_maps, _vendor_b_call, _any_usage, carries=True,
    ),
    Normalizer("vendor_b_tool", lambda: _named(VENDOR_B_TOOL), _vendor_b_tool_maps, _vendor_b_tool),
    Normalizer("gen_ai", _genai_applies, _genai_maps, _genai_event),
)


def with_provider(records: DataFrame, wanted: Column) -> DataFrame:
    """The wanted records with the provider named by the latest earlier start of the same conversation, in arrival order.

    Only they and the starts are sorted by conversation.
    """
    named = F.when(_conversation().isNotNull() & _named(VENDOR_B_SESSION), provider_id(_text("provider_name")))
    keyed = records.withColumns({"wanted": F.coalesce(wanted, F.lit(False)), "named_provider": named})
    kept = keyed.where(F.col("wanted") | F.col("named_provider").isNotNull())
    return last_before(kept, ["conversation"], "record_seq", F.col("named_provider"), "carried_provider").where("wanted")


def normalize(records: DataFrame, normalizers: Sequence[Normalizer] = NORMALIZERS) -> DataFrame:
    """Claim every record: ``normalizer``, ``outcome`` (event / dropped / unclaimed) and ``event``.

    An unmappable record its normaliser does not drop is offered to the next one.  The typed attributes and claims are
    written once; each normaliser then maps the records it has claimed in a branch of its own, which names itself and its
    outcome by literals, so that a filter on them leaves out whole branches.
    """
    seq = F.col("arrival") * S.MAX_LOG_RECORDS + F.col("index")
    found = _settled(typed_attributes(records).withColumn("record_seq", seq), claim=_claim(normalizers))
    claimed = cut(found.select("*", F.col("claim.name").alias("normalizer"), F.col("claim.outcome").alias("outcome")).drop("claim"))
    out = ["body_id", "arrival", "index", "record_seq", "own_keys"]

    def mapped(n: Normalizer) -> DataFrame:
        mine = (F.col("normalizer") == n.name) & (F.col("outcome") == "event")
        rows = with_provider(claimed, mine) if n.carries else claimed.where(mine)
        return rows.select(*out, F.lit(n.name).alias("normalizer"), F.lit("event").alias("outcome"), n.event().alias("event"))

    events = [mapped(n) for n in normalizers]
    kind_ = events[0].schema["event"].dataType
    other = F.when(F.col("outcome") == "dropped", "dropped").otherwise("unclaimed")
    rest = claimed.where("outcome <> 'event'").select(*out, "normalizer", other.alias("outcome"), F.lit(None).cast(kind_).alias("event"))
    return reduce(DataFrame.unionByName, events, rest)


def _claim(normalizers: Sequence[Normalizer]) -> Column:
    """(name, outcome) by the first normaliser that applies and maps or drops the record."""
    claim = F.struct(F.lit(None).cast("string").alias("name"), F.lit("unclaimed").alias("outcome"))
    for n in reversed(normalizers):
        outcome = F.when(n.maps(), "event").otherwise("dropped")
        claim = F.when(n.applies() & (n.maps() | n.drops()), F.struct(F.lit(n.name).alias("name"), outcome.alias("outcome"))).otherwise(claim)
    return claim


def events_of(claimed: DataFrame) -> DataFrame:
    """Mapped events as stored facts."""
    e = claimed.where("outcome = 'event'").select("record_seq", "event.*")
    null = lambda ddl: F.lit(None).cast(ddl)
    span = F.col("action_span")
    return e.select(
        F.lit(S.SCHEMA_VERSION).alias("schema_version"), "event_id", "ts",
        F.struct(F.col("collector"), F.lit(S.SCHEMA_VERSION)).cast(S.COLLECTOR).alias("collector"), "session_id", "attribution", "type",
        "ts_ms", parse_ms(span["t_start"]).alias("t_start_ms"), parse_ms(span["t_end"]).alias("t_end_ms"),
        F.col("record_seq").alias("arrival"), "llm_call", null(S.ENERGY_SAMPLE).alias("energy_sample"), "action_span",
        null(S.PROCESS_SAMPLE).alias("process_sample"), "session_meta",
    )


def dropped_keys(claimed: DataFrame) -> DataFrame:
    """Per body, the names (never values) of attributes of dropped records, at most 64."""
    names = claimed.where("outcome = 'dropped'").select("body_id", F.explode("own_keys").alias("key")).distinct()
    # A body is bounded by its record limit, so its distinct names are too.
    return names.groupBy("body_id").agg(F.slice(F.array_sort(F.collect_list("key")), 1, S.MAX_REJECT_KEYS).alias("attribute_keys"))


def receiver_counters(bodies: DataFrame, claimed: DataFrame, refused: DataFrame, metrics: DataFrame) -> DataFrame:
    """Requests, accepted, dropped and unclaimed records, refused bodies, discarded metric bodies."""
    one = F.lit(1).alias("one")
    n = claimed.agg(
        *[F.count_if(F.col("outcome") == o).alias(a) for o, a in (("event", "accepted"), ("dropped", "dropped"), ("unclaimed", "unclaimed"))]
    ).select("*", one)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).select("*", one)
    return (
        n.join(count(bodies, "requests"), "one").join(count(refused, "bodies_refused"), "one")
        .join(count(metrics, "metrics_discarded"), "one").drop("one")
    )
