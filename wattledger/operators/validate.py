"""Line validation: each event line is a known event, an opaque event, or a reject with a reason.

Lines are parsed once to VARIANT.  Types are tested on the variant itself, because typed JSON
readers coerce silently (a number becomes a string).  All rules are columns, so the whole check is
one projection.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattledger import schemas as S
from wattledger.functions import canonical_json, is_rfc3339, parse_ms

ATTRIBUTION_KEYS = ("agent_id", "subagent_id", "task_id", "tool_call_id")
USAGE_KEYS = ("input_tokens", "output_tokens", "thought_tokens", "cached_read_tokens", "cached_write_tokens")
REASON_TEXT = {
    "oversized": "line too long: ",
    "json": "invalid JSON: ",
    "schema": "schema violation: ",
    "unknown_version": "unsupported schema_version: ",
}


def field(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column, path: str = "$") -> Column:
    """Variant type at a path: null when absent, ``VOID`` for a JSON null."""
    return F.schema_of_variant(field(v, path))


def text(v: Column, path: str) -> Column:
    """The string at a path; null when it is not a string."""
    return F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def _absent(at: str, required: bool) -> Column:
    return F.lit(f"{at}: required") if required else F.lit(None).cast("string")


def a_string(
    v: Column, path: str, at: str, required: bool = True, among: Sequence[str] = (), min_len: int = 0, instant: bool = False
) -> Column:
    k = kind(v, path)
    value = F.try_variant_get(v, path, "string")
    out = F.when(k.isNull(), _absent(at, required)).when(k != "STRING", F.lit(f"{at}: not a string"))
    if among:
        out = out.when(~value.isin(*among), F.lit(f"{at}: not one of {', '.join(among)}"))
    if min_len:
        out = out.when(F.length(value) < min_len, F.lit(f"{at}: must contain at least {min_len} characters"))
    if instant:
        out = out.when(~is_rfc3339(value), F.lit(f"{at}: not an RFC 3339 date-time"))
    return out


def an_integer(v: Column, path: str, at: str, required: bool = False, minimum: int | None = None) -> Column:
    k = kind(v, path)
    out = F.when(k.isNull(), _absent(at, required)).when(k != "BIGINT", F.lit(f"{at}: not an integer"))
    if minimum is not None:
        out = out.when(F.try_variant_get(v, path, "bigint") < minimum, F.lit(f"{at}: less than {minimum}"))
    return out


def a_number(v: Column, path: str, at: str, required: bool = False, minimum: float | None = None) -> Column:
    k = kind(v, path)
    numeric = (k == "BIGINT") | (k == "DOUBLE") | k.startswith("DECIMAL")
    out = F.when(k.isNull(), _absent(at, required)).when(~numeric, F.lit(f"{at}: not a number"))
    if minimum is not None:
        out = out.when(F.try_variant_get(v, path, "double") < minimum, F.lit(f"{at}: less than {minimum}"))
    return out


def a_boolean(v: Column, path: str, at: str) -> Column:
    k = kind(v, path)
    return F.when(k.isNotNull() & (k != "BOOLEAN"), F.lit(f"{at}: not a boolean"))


def an_object(v: Column, path: str, at: str, required: bool = True, only: Sequence[str] = ()) -> Column:
    k = kind(v, path)
    out = F.when(k.isNull(), _absent(at, required)).when(~k.startswith("OBJECT"), F.lit(f"{at}: not an object"))
    if only:
        keys = F.map_keys(F.try_variant_get(v, path, "map<string,variant>"))
        extra = F.size(F.array_except(keys, F.array(*[F.lit(o) for o in only]))) > 0
        out = out.when(extra, F.lit(f"{at}: additional properties are not allowed"))
    return out


def an_array(
    v: Column, path: str, at: str, item: Callable[[Column], Column] | None, required: bool = True, min_items: int = 0
) -> Column:
    k = kind(v, path)
    items = F.try_variant_get(v, path, "array<variant>")
    out = F.when(k.isNull(), _absent(at, required)).when(~k.startswith("ARRAY"), F.lit(f"{at}: not an array"))
    if min_items:
        out = out.when(F.size(items) < min_items, F.lit(f"{at}: fewer than {min_items} items"))
    if item is not None:
        out = out.otherwise(F.get(F.array_compact(F.transform(items, item)), 0))
    return out


def _interval(v: Column) -> list[Column]:
    return [
        a_string(v, "$.payload.t_start", "/payload/t_start", instant=True),
        a_string(v, "$.payload.t_end", "/payload/t_end", instant=True),
    ]


def _payload_rules(v: Column) -> dict[str, list[Column]]:
    p, at = "$.payload", "/payload"

    def component(c: Column) -> Column:
        where = f"{at}/components"
        return F.coalesce(
            an_object(c, "$", where),
            a_string(c, "$.kind", f"{where}/kind", among=S.ENERGY_KINDS),
            a_number(c, "$.energy_j", f"{where}/energy_j", required=True, minimum=0),
            a_string(c, "$.method", f"{where}/method", among=S.ENERGY_METHODS),
            a_string(c, "$.label", f"{where}/label", required=False),
        )

    def process(c: Column) -> Column:
        where = f"{at}/processes"
        return F.coalesce(
            an_object(c, "$", where),
            an_integer(c, "$.pid", f"{where}/pid", required=True),
            an_integer(c, "$.cpu_time_delta_ms", f"{where}/cpu_time_delta_ms", required=True, minimum=0),
            *[an_integer(c, f"$.{n}", f"{where}/{n}", minimum=0) for n in ("memory_rss_bytes", "io_read_bytes", "io_write_bytes")],
            a_string(c, "$.orphan_of", f"{where}/orphan_of", required=False),
        )

    return {
        "llm_call": [
            a_string(v, f"{p}.provider", f"{at}/provider"),
            a_string(v, f"{p}.model_id_requested", f"{at}/model_id_requested"),
            a_string(v, f"{p}.model_id_served", f"{at}/model_id_served", required=False),
            a_string(v, f"{p}.endpoint", f"{at}/endpoint", required=False),
            an_object(v, f"{p}.usage", f"{at}/usage", only=USAGE_KEYS),
            *[an_integer(v, f"{p}.usage.{n}", f"{at}/usage/{n}", minimum=0) for n in USAGE_KEYS],
            a_string(v, f"{p}.usage_source", f"{at}/usage_source", among=S.USAGE_SOURCES),
            an_integer(v, f"{p}.duration_ms", f"{at}/duration_ms", minimum=0),
            a_string(v, f"{p}.status", f"{at}/status", required=False, among=S.STATUSES),
            a_boolean(v, f"{p}.streaming", f"{at}/streaming"),
        ],
        "energy_sample": [
            *_interval(v),
            an_array(v, f"{p}.components", f"{at}/components", component, min_items=1),
            a_string(v, f"{p}.host_id", f"{at}/host_id", required=False),
        ],
        "action_span": [
            a_string(v, f"{p}.span_id", f"{at}/span_id"),
            a_string(v, f"{p}.tool_name", f"{at}/tool_name"),
            a_string(v, f"{p}.tool_kind", f"{at}/tool_kind", among=S.TOOL_KINDS),
            a_string(v, f"{p}.execution_locus", f"{at}/execution_locus", among=S.LOCI),
            *_interval(v),
            an_array(v, f"{p}.pids", f"{at}/pids", lambda c: an_integer(c, "$", f"{at}/pids", required=True), required=False),
            a_string(v, f"{p}.cgroup", f"{at}/cgroup", required=False),
            a_string(v, f"{p}.status", f"{at}/status", required=False, among=S.STATUSES),
        ],
        "process_sample": [*_interval(v), an_array(v, f"{p}.processes", f"{at}/processes", process)],
        "session_meta": [
            an_object(v, f"{p}.agent_app", f"{at}/agent_app"),
            a_string(v, f"{p}.agent_app.name", f"{at}/agent_app/name"),
            a_string(v, f"{p}.agent_app.version", f"{at}/agent_app/version", required=False),
            a_string(v, f"{p}.os", f"{at}/os", required=False),
            an_object(v, f"{p}.hardware", f"{at}/hardware", required=False),
            a_string(v, f"{p}.hardware.cpu_model", f"{at}/hardware/cpu_model", required=False),
            an_array(v, f"{p}.hardware.gpu_models", f"{at}/hardware/gpu_models",
                     lambda c: a_string(c, "$", f"{at}/hardware/gpu_models"), required=False),
            a_number(v, f"{p}.hardware.ram_gb", f"{at}/hardware/ram_gb"),
            a_string(v, f"{p}.geo_zone", f"{at}/geo_zone", required=False),
            a_string(v, f"{p}.power_source", f"{at}/power_source", required=False, among=S.POWER_SOURCES),
        ],
    }


def contract_violation(v: Column) -> Column:
    """First violation of the event contract as ``path: message``, null when it holds."""
    tag = text(v, "$.type")
    rules = _payload_rules(v)
    by_type = None
    for name, checks in rules.items():
        by_type = F.when(tag == name, F.coalesce(*checks)) if by_type is None else by_type.when(tag == name, F.coalesce(*checks))
    return F.coalesce(
        F.when(~kind(v).startswith("OBJECT"), F.lit("/: not an object")),
        a_string(v, "$.schema_version", "/schema_version"),
        a_string(v, "$.event_id", "/event_id", min_len=S.MIN_EVENT_ID_LEN),
        a_string(v, "$.type", "/type", among=S.EVENT_TYPES),
        a_string(v, "$.ts", "/ts", instant=True),
        an_object(v, "$.collector", "/collector"),
        a_string(v, "$.collector.name", "/collector/name"),
        a_string(v, "$.collector.version", "/collector/version"),
        a_string(v, "$.session_id", "/session_id"),
        an_object(v, "$.attribution", "/attribution", required=False, only=ATTRIBUTION_KEYS),
        *[a_string(v, f"$.attribution.{k}", f"/attribution/{k}", required=False) for k in ATTRIBUTION_KEYS],
        an_object(v, "$.payload", "/payload"),
        by_type,
    )


def opaque_violation(v: Column) -> Column:
    """First violation of the base envelope of an event type this version does not know."""
    return F.coalesce(
        a_string(v, "$.schema_version", "/schema_version", min_len=1),
        a_string(v, "$.event_id", "/event_id", min_len=S.MIN_EVENT_ID_LEN),
        a_string(v, "$.ts", "/ts", instant=True),
        an_object(v, "$.collector", "/collector"),
        a_string(v, "$.collector.name", "/collector/name"),
        a_string(v, "$.collector.version", "/collector/version"),
        a_string(v, "$.session_id", "/session_id", min_len=1),
        a_string(v, "$.type", "/type", min_len=1),
        F.when(kind(v, "$.payload").isNull(), F.lit("/payload: required")),
    )


def bad_version(v: Column) -> Column:
    """The version text when it is a string this engine cannot read; other types go to the contract."""
    version = text(v, "$.schema_version")
    return F.when(~version.rlike(S.VERSION_PATTERN), version)


_NUMBER = r"(?:BIGINT|DOUBLE|DECIMAL\([0-9]+,[0-9]+\))"
_KINDS = {"string": "STRING", "bigint": "BIGINT", "double": _NUMBER, "boolean": "BOOLEAN"}


def _shape(ddl: T.DataType, required: Sequence[str] = (), also: dict[str, str] | None = None) -> str:
    """Pattern of ``schema_of_variant`` for values of a type; of an object's fields the ``required`` ones must be there."""
    if isinstance(ddl, T.ArrayType):
        return f"ARRAY<(?:VOID|{_shape(ddl.elementType)})>"
    if not isinstance(ddl, T.StructType):
        return _KINDS[ddl.simpleString()]
    kinds = {f.name: _shape(f.dataType) for f in ddl.fields} | (also or {})
    fields = "".join(f"(?:{n}: {kinds[n]}(?:, |(?=>))){'' if n in required else '?'}" for n in sorted(kinds))
    return f"OBJECT<{fields}>"


_REQUIRED = {
    "llm_call": ("provider", "model_id_requested", "usage", "usage_source"),
    "energy_sample": ("t_start", "t_end", "components"),
    "action_span": ("span_id", "tool_name", "tool_kind", "execution_locus", "t_start", "t_end"),
    "process_sample": ("t_start", "t_end", "processes"),
    "session_meta": ("agent_app",),
}
_HEADER = ("schema_version", "event_id", "ts", "type", "collector", "session_id", "payload")
_CHECKED = (
    f"struct<schema_version:string,event_id:string,ts:string,type:string,payload:struct<usage:{S.USAGE},usage_source:string,"
    f"duration_ms:bigint,status:string,t_start:string,t_end:string,components:array<{S.COMPONENT}>,tool_kind:string,"
    f"execution_locus:string,processes:array<{S.PROCESS}>,power_source:string>>"
)


def _line_shape(name: str) -> str:
    app = {"agent_app": _shape(_ddl("struct<name:string,version:string>"), ("name",))} if name == "session_meta" else {}
    payload = _shape(_ddl(S.PAYLOADS[name]), _REQUIRED[name], app)
    return _shape(_ddl(f"struct<{S.HEADER}>"), _HEADER, {
        "collector": _shape(_ddl(S.COLLECTOR), ("name", "version")), "payload": payload,
    })


def _ddl(text: str) -> T.DataType:
    return T.DataType.fromDDL(text)


def sound(v: Column, line: Column) -> Column:
    """True only where the event contract holds; lines it leaves open are for the rules to judge.

    One look at the line's whole type and one typed reading take the place of some fifty lookups.  Only fields of the
    contract may be there, and no ``null``: inside arrays the type does not show one.
    """
    shape, c = F.schema_of_variant(v), F.try_variant_get(v, "$", _CHECKED)

    def judge(c: Column) -> Column:
        p = c["payload"]
        least = lambda value: F.coalesce(value >= 0, F.lit(True))
        among = lambda value, known: F.coalesce(value.isin(*known), F.lit(True))
        interval = is_rfc3339(p["t_start"]) & is_rfc3339(p["t_end"])
        component = lambda x: F.coalesce(x["kind"].isin(*S.ENERGY_KINDS) & (x["energy_j"] >= 0) & x["method"].isin(*S.ENERGY_METHODS), F.lit(False))
        process = lambda x: F.coalesce(x["pid"].isNotNull() & (x["cpu_time_delta_ms"] >= 0), F.lit(False)) & least(
            x["memory_rss_bytes"]) & least(x["io_read_bytes"]) & least(x["io_write_bytes"])
        usage = least(p["duration_ms"]) & p["usage_source"].isin(*S.USAGE_SOURCES) & among(p["status"], S.STATUSES)
        for n in USAGE_KEYS:
            usage = usage & least(p["usage"][n])
        values = {
            "llm_call": usage,
            "energy_sample": interval & (F.size(p["components"]) > 0) & F.forall(p["components"], component),
            "action_span": interval & p["tool_kind"].isin(*S.TOOL_KINDS) & p["execution_locus"].isin(*S.LOCI) & among(p["status"], S.STATUSES),
            "process_sample": interval & F.forall(p["processes"], process),
            "session_meta": among(p["power_source"], S.POWER_SOURCES),
        }
        right = F.coalesce(*[F.when((c["type"] == n) & shape.rlike(f"^{_line_shape(n)}$"), x) for n, x in values.items()], F.lit(False))
        return right & c["schema_version"].rlike(S.VERSION_PATTERN) & (F.length(c["event_id"]) >= S.MIN_EVENT_ID_LEN) & is_rfc3339(c["ts"])

    held = F.get(F.transform(F.array(c), lambda c: F.when(c.isNotNull() & ~F.contains(line, F.lit("null")), judge(c))), 0)
    return F.coalesce(held, F.lit(False))


def classify(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ``v``, ``type``, ``outcome`` (known / opaque / rejected), ``reason_kind`` and ``reason``.

    A source may mark lines as ``oversized``: of those it has only a sample, so they are rejected as such.
    """
    v = F.col("v")
    # Generating the checked columns, rather than projecting them, keeps the optimizer from copying
    # the long rule expressions into every later use of their result.
    parsed = lines.withColumn("v", F.explode(F.array(F.try_parse_json(line))))

    def checked(v: Column) -> Column:
        tag = text(v, "$.type")
        unknown_type = F.coalesce(tag.isNotNull() & ~tag.isin(*S.EVENT_TYPES), F.lit(False))
        version = bad_version(v)
        return F.struct(
            tag.alias("type"),
            unknown_type.alias("unknown_type"),
            version.alias("version"),
            F.when(version.isNotNull(), F.lit(None).cast("string"))
            .when(unknown_type, opaque_violation(v))
            .otherwise(contract_violation(v))
            .alias("violation"),
        )

    nothing = F.lit(None).cast("string")
    right = F.struct(F.try_variant_get(v, "$.type", "string").alias("type"), F.lit(False).alias("unknown_type"), nothing.alias("version"), nothing.alias("violation"))
    # The rules stand in a function of the value: generated code of all of them in one method is too long to be compiled.
    judged = F.transform(F.array(v), lambda v: F.when(v.isNotNull() & ~sound(v, F.col(line)), checked(v)).when(v.isNotNull(), right))
    df = parsed.withColumn("c", F.explode(judged))
    oversized = F.col("oversized") if "oversized" in lines.columns else F.lit(False)
    reason_kind = (
        F.when(oversized, "oversized").when(v.isNull(), "json").when(F.col("c.version").isNotNull(), "unknown_version").when(F.col("c.violation").isNotNull(), "schema")
    )
    df = df.withColumn("reason_kind", reason_kind)
    detail = F.when(F.col("reason_kind") == "oversized", F.lit("longer than the source reads")).when(
        F.col("reason_kind") == "json", F.lit("not a JSON value")
    ).otherwise(F.coalesce("c.version", "c.violation"))
    prefix = F.coalesce(*[F.when(F.col("reason_kind") == k, F.lit(t)) for k, t in REASON_TEXT.items()])
    return df.withColumns(
        {
            "type": F.col("c.type"),
            "outcome": F.when(F.col("reason_kind").isNotNull(), "rejected").when(F.col("c.unknown_type"), "opaque").otherwise("known"),
            "reason": F.concat(prefix, detail),
        }
    ).drop("c")


def known_facts(classified: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Typed facts of the known lines, with parsed instants and canonical JSON."""
    v = F.col("v")

    def get(path: str, ddl: str) -> Column:
        return F.try_variant_get(v, path, ddl)

    payloads = {n: F.when(F.col("type") == n, get("$.payload", ddl)) for n, ddl in S.PAYLOADS.items()}
    timed = ("energy_sample", "action_span", "process_sample")
    df = classified.where("outcome = 'known'").select(
        get("$.schema_version", "string").alias("schema_version"),
        get("$.event_id", "string").alias("event_id"),
        get("$.ts", "string").alias("ts"),
        get("$.collector", S.COLLECTOR).alias("collector"),
        get("$.session_id", "string").alias("session_id"),
        get("$.attribution", S.ATTRIBUTION).alias("attribution"),
        "type",
        F.col(arrival).cast("bigint").alias("arrival"),
        *[c.alias(n) for n, c in payloads.items()],
        F.to_json(v).alias("json"),
    )
    start = F.coalesce(*[F.col(n)["t_start"] for n in timed])
    end = F.coalesce(*[F.col(n)["t_end"] for n in timed])
    return df.withColumns({"ts_ms": parse_ms("ts"), "t_start_ms": parse_ms(start), "t_end_ms": parse_ms(end)})


def opaque_events(classified: DataFrame, arrival: str = "arrival") -> DataFrame:
    v = F.col("v")
    get = lambda path: F.try_variant_get(v, path, "string")
    return classified.where("outcome = 'opaque'").select(
        get("$.schema_version").alias("schema_version"), get("$.event_id").alias("event_id"), get("$.ts").alias("ts"),
        get("$.collector.name").alias("collector"), get("$.session_id").alias("session_id"), "type",
        F.col(arrival).cast("bigint").alias("arrival"), F.to_json(v).alias("json"),
    )


def reject_rows(classified: DataFrame, line: str = "line", arrival: str = "arrival", origin: str = "origin") -> DataFrame:
    """Metadata of rejected lines: the reason, a digest and the size, never the content.

    The size is the source's ``bytes`` where it gives one, as it does for lines of which it has only a sample.
    """
    size = F.octet_length(line).cast("bigint")
    return classified.where("outcome = 'rejected'").select(
        F.col(arrival).cast("bigint").alias("id"),
        F.lit("spool").alias("source"),
        (F.col(origin) if origin in classified.columns else F.lit(None).cast("string")).alias("origin"),
        "reason_kind", "reason", F.array().cast("array<string>").alias("attribute_keys"),
        (F.coalesce("bytes", size) if "bytes" in classified.columns else size).alias("bytes"),
        F.sha2(F.col(line).cast("binary"), 256).alias("digest"),
    )


def event_lines(facts: DataFrame) -> DataFrame:
    """One canonical JSON line per fact; absent fields are left out."""
    payload = F.coalesce(*[F.to_json(F.col(n)) for n in S.PAYLOADS])
    head = F.to_json(F.struct("schema_version", "event_id", "ts", "collector", "session_id", "attribution", "type"))
    # The payload's text goes into the document's, so all of it is parsed once; no head is without a field.
    doc = F.when(payload.isNull(), head).otherwise(F.concat(F.lit('{"payload":'), payload, F.lit(","), F.substring(head, 2, 2**31 - 1)))
    return facts.select(
        F.col("collector.name").alias("collector"), "session_id", "event_id", "arrival", canonical_json(doc).alias("value")
    )


def conformance(facts: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Presence of each field in percent, with its tier, in long form."""
    counts = facts.agg(F.count(F.lit(1)).alias("total"), *[F.count(c).alias(n) for n, c in fields.items()])
    pairs = ", ".join(f"'{n}', `{n}`" for n in fields)
    long = counts.select("total", F.expr(f"stack({len(fields)}, {pairs}) AS (field, present)"))
    pct = F.when(F.col("total") > 0, F.col("present") * 100.0 / F.col("total")).otherwise(F.lit(0.0))
    tier = F.when(F.col("pct") > 90, "high").when(F.col("pct") >= 60, "partial").otherwise("low")
    return long.withColumn("pct", pct).withColumn("tier", tier)


def ingest_metrics(classified: DataFrame, inserted: DataFrame, line: str = "line") -> DataFrame:
    """Counts of one ingest: lines, bytes, parsed, opaque, rejected, inserted and deduplicated."""
    seen = classified.agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.octet_length(line) + 1).alias("bytes"),
        F.count_if(F.col("outcome") == "known").alias("parsed"),
        F.count_if(F.col("outcome") == "opaque").alias("opaque"),
        F.count_if(F.col("outcome") == "rejected").alias("rejected"),
    ).withColumn("one", F.lit(1))
    kept = inserted.agg(F.count(F.lit(1)).alias("inserted")).withColumn("one", F.lit(1))
    return seen.join(kept, "one").drop("one").withColumn("deduplicated", F.col("parsed") - F.col("inserted"))
