"""Pairing of opening and closing records into spans and calls.

What closes an opening is decided by the neighbours of each record in its own key (session and call
id) and by the session's next stop, all found with the block-wise as-of helpers, so neither a long
session nor a re-used id is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger import schemas as S
from wattledger.functions import digest_prefix, format_ms, lookup, sanitize_id, stable_id
from wattledger.operators.ordered import last_before, max_before, next_after
from wattledger.session import cut

# Fixed values of the contract: tool names the hook collector knows, with kind and place.
HOOK_TOOLS = {
    "Bash": ("bash", "local"),
    "Edit": ("file_op", "local"),
    "Write": ("file_op", "local"),
    "Read": ("file_op", "local"),
    "NotebookEdit": ("file_op", "local"),
    "Glob": ("file_op", "local"),
    "Grep": ("file_op", "local"),
    "Task": ("subagent", "local"),
    "Agent": ("subagent", "local"),
    "WebFetch": ("web", "remote"),
    "WebSearch": ("web", "remote"),
}
# Fixed values of the contract: lower-cased tool names of the durable-event agent.
DURABLE_TOOLS = {
    "bash": "bash",
    "shell": "bash",
    "terminal": "bash",
    "edit": "file_op",
    "write": "file_op",
    "read": "file_op",
    "patch": "file_op",
    "multiedit": "file_op",
    "task": "subagent",
    "agent": "subagent",
    "subagent": "subagent",
    "webfetch": "web",
    "websearch": "web",
    "fetch": "web",
    "search": "web",
}
LOCUS_OF_KIND = {"bash": "local", "file_op": "local", "subagent": "local", "web": "remote", "mcp": "unknown", "other": "unknown"}
MCP_PREFIX = "mcp__"
DURABLE_ID_PREFIX = "opencode-"


# ---------------------------------------------------------------- classification


def hook_tool(name: Column) -> tuple[Column, Column]:
    """(kind, locus) of a hook tool name."""
    mcp = name.startswith(MCP_PREFIX)
    kind = F.coalesce(lookup(name, {n: k for n, (k, _) in HOOK_TOOLS.items()}), F.when(mcp, F.lit("mcp")), F.lit("other"))
    locus = F.coalesce(lookup(name, {n: l for n, (_, l) in HOOK_TOOLS.items()}), F.lit("unknown"))
    return kind, locus


def durable_tool(name: Column, provider_executed: Column) -> tuple[Column, Column]:
    """(kind, locus) of a durable-event tool; one the provider runs itself is remote."""
    low = F.lower(name)
    kind = F.coalesce(lookup(low, DURABLE_TOOLS), F.when(low.startswith("mcp"), F.lit("mcp")), F.lit("other"))
    locus = F.when(F.coalesce(provider_executed, F.lit(False)), F.lit("remote")).otherwise(lookup(kind, LOCUS_OF_KIND))
    return kind, locus


def durable_event_id(source_id: Column) -> Column:
    return F.when(F.octet_length(source_id) >= S.MIN_EVENT_ID_LEN, source_id).otherwise(
        F.concat(F.lit(DURABLE_ID_PREFIX), digest_prefix(source_id, 24))
    )


# ---------------------------------------------------------------- hook pairing

_STOPS = ("Stop", "SessionEnd")
_CLOSES = ("PostToolUse", "PostToolUseFailure")


def hook_spans(hooks: DataFrame) -> DataFrame:
    """Spans of hook calls, at the call that emits each.

    A close takes the opening before it, unless a stop came between.  An opening that meets a stop
    first is swept there with status ``unknown``.  A close without opening has no length: a start
    nobody saw is never made up.  Needs ``session_id, event, tool_use_id, tool_name, is_interrupt,
    ts_ms, arrival``.
    """
    stop = F.when(F.col("event").isin(*_STOPS), F.struct(F.col("arrival").alias("at"), F.col("ts_ms").alias("ts")))
    # Each as-of step reads its input twice, so the parsed log and the results between steps are
    # written once instead of being computed again for every reader.
    relevant = cut(
        hooks.where(F.col("event").isin("PreToolUse", *_CLOSES, *_STOPS)).select(
            "session_id", "event", "tool_use_id", "tool_name", "is_interrupt", "ts_ms", "arrival"
        )
    )
    df = next_after(relevant, ["session_id"], "arrival", stop, "stop")
    tools = cut(
        df.where((F.col("tool_use_id") != "") & ~F.col("event").isin(*_STOPS)).withColumn("span_id", sanitize_id("tool_use_id"))
    )
    key = ["session_id", "span_id"]
    state = F.struct("event", "ts_ms", "tool_name", F.col("stop.at").alias("stop_at"))
    tools = last_before(tools, key, "arrival", state, "prev")
    tools = cut(next_after(tools, key, "arrival", F.col("arrival"), "next_at"))

    opened = (F.col("prev.event") == "PreToolUse") & (F.col("prev.stop_at").isNull() | (F.col("prev.stop_at") > F.col("arrival")))
    opened = F.coalesce(opened, F.lit(False))
    outcome = F.when(F.col("event") == "PostToolUse", "ok").when(F.col("is_interrupt"), "cancelled").otherwise("error")
    closed = tools.where(F.col("event").isin(*_CLOSES)).select(
        "session_id", "span_id", "arrival",
        F.when(F.col("tool_name") != "", F.col("tool_name")).otherwise(F.coalesce(F.when(opened, F.col("prev.tool_name")), F.lit(""))).alias("tool_name"),
        F.when(opened, F.col("prev.ts_ms")).otherwise(F.col("ts_ms")).alias("t_start_ms"),
        F.col("ts_ms").alias("t_end_ms"),
        F.when(opened, outcome).otherwise("unknown").alias("status"),
        F.lit(False).alias("swept"),
    )
    left_open = (F.col("event") == "PreToolUse") & F.col("stop").isNotNull() & (
        F.col("next_at").isNull() | (F.col("stop.at") < F.col("next_at"))
    )
    swept = tools.where(left_open).select(
        "session_id", "span_id", F.col("stop.at").alias("arrival"), "tool_name", F.col("ts_ms").alias("t_start_ms"),
        F.col("stop.ts").alias("t_end_ms"), F.lit("unknown").alias("status"), F.lit(True).alias("swept"),
    )
    spans = closed.unionByName(swept)
    kind, locus = hook_tool(F.col("tool_name"))
    return spans.withColumns({"tool_kind": kind, "locus": locus, "event_id": stable_id("cc-hooks", "session_id", "span_id", "arrival")})


def session_starts(hooks: DataFrame) -> DataFrame:
    """Each session start as two rows: a zero-length bootstrap span with the agent's pid, and the session record."""
    starts = hooks.where("event = 'SessionStart'")
    part = F.explode(F.array(F.lit("action_span"), F.lit("session_meta")))
    span = F.col("type") == "action_span"
    return starts.select("session_id", "ts_ms", "arrival", "pid", part.alias("type")).select(
        "session_id", "arrival", "type",
        F.when(span, F.concat(F.lit("session-boot-"), "session_id")).alias("span_id"),
        F.when(span, F.lit(S.BOOTSTRAP_TOOL)).alias("tool_name"),
        F.when(span, F.col("ts_ms")).alias("t_start_ms"), F.when(span, F.col("ts_ms")).alias("t_end_ms"),
        F.when(span & F.col("pid").isNotNull(), F.array("pid")).alias("pids"),
    )


# ---------------------------------------------------------------- durable events


def sequence_filter(events: DataFrame) -> DataFrame:
    """Verdict on each durable event's sequence number, per session in arrival order.

    ``other_session`` and ``malformed`` are skipped; a number not above the highest so far is a
    ``regression`` and dropped; a jump is a ``gap`` but accepted.  Events without a durable part
    pass.  Needs ``session_id, has_durable, aggregate_id, seq, arrival``.
    """
    durable = F.col("has_durable")
    usable = durable & (F.col("aggregate_id") == F.col("session_id")) & (F.col("seq") > 0)
    counted = F.when(F.coalesce(usable, F.lit(False)), F.col("seq"))
    df = max_before(events, ["session_id"], "arrival", counted, "latest").withColumn("latest", F.coalesce("latest", F.lit(0)))
    verdict = (
        F.when(~durable, "unnumbered")
        .when(F.col("aggregate_id").isNull(), "malformed")
        .when(F.col("aggregate_id") != F.col("session_id"), "other_session")
        .when(F.col("seq").isNull() | (F.col("seq") <= 0), "malformed")
        .when(F.col("seq") <= F.col("latest"), "regression")
        .when(F.col("seq") > F.col("latest") + 1, "gap")
        .otherwise("next")
    )
    return df.withColumn("verdict", verdict).withColumn("accepted", F.col("verdict").isin("unnumbered", "gap", "next"))


_FAMILIES = {
    "session.next.step.started": ("step", "open"),
    "session.next.step.ended": ("step", "close"),
    "session.next.step.failed": ("step", "close"),
    "session.next.tool.called": ("tool", "open"),
    "session.next.tool.success": ("tool", "close"),
    "session.next.tool.failed": ("tool", "close"),
    "session.next.shell.started": ("shell", "open"),
    "session.next.shell.ended": ("shell", "close"),
}


def durable_details(events: DataFrame) -> DataFrame:
    """Typed fields of durable events that open or close something."""
    d = F.col("event_data")

    def s(path: str) -> Column:
        return F.when(F.schema_of_variant(F.try_variant_get(d, path, "variant")) == "STRING", F.try_variant_get(d, path, "string"))

    def n(path: str) -> Column:
        v = F.try_variant_get(d, path, "variant")
        whole = F.try_variant_get(d, path, "bigint")
        return F.when((F.schema_of_variant(v) == "BIGINT") & (whole >= 0), whole)

    family = lookup(F.col("event_type"), {k: f for k, (f, _) in _FAMILIES.items()})
    side = lookup(F.col("event_type"), {k: x for k, (_, x) in _FAMILIES.items()})
    error = F.lower(F.to_json(F.try_variant_get(d, "$.error", "variant")))
    out = events.withColumns({"family": family, "side": side}).where("family is not null").withColumns(
        {
            "pair_id": F.when(F.col("family") == "step", s("$.assistantMessageID")).otherwise(s("$.callID")),
            "at_ms": n("$.timestamp"),
            "detail": F.struct(
                s("$.assistantMessageID").alias("message_id"), s("$.agent").alias("agent"), s("$.tool").alias("tool"),
                s("$.model.providerID").alias("provider"), s("$.model.id").alias("model"),
                F.try_variant_get(d, "$.provider.executed", "boolean").alias("provider_executed"),
                n("$.tokens.input").alias("input_tokens"), n("$.tokens.output").alias("output_tokens"),
                n("$.tokens.reasoning").alias("thought_tokens"), n("$.tokens.cache.read").alias("cached_read_tokens"),
                n("$.tokens.cache.write").alias("cached_write_tokens"), error.contains("cancel").alias("cancelled"),
            ),
        }
    )
    readable = F.col("at_ms").isNotNull() & s("$.sessionID").isNotNull() & F.col("pair_id").isNotNull()
    complete = ~((F.col("family") == "tool") & (F.col("side") == "close") & F.col("detail.message_id").isNull())
    return out.where(readable & complete)


def pair_durable(events: DataFrame) -> DataFrame:
    """Closing events with the opening they settle; ``paired`` is false when there is none.

    An opening is used once.  A settlement whose opening cannot be mapped is ``unmappable``.
    """
    key = ["session_id", "family", "pair_id"]
    state = F.struct("side", "at_ms", "detail")
    slim = cut(events.select(*key, "side", "at_ms", "detail", "source_id", "event_type", "arrival"))
    df = last_before(slim, key, "arrival", state, "prev").where("side = 'close'")
    paired = F.coalesce(F.col("prev.side") == "open", F.lit(False))
    start = F.col("prev.detail")
    mappable = (
        F.when(F.col("family") == "step", start["provider"].isNotNull() & start["model"].isNotNull())
        .when(F.col("family") == "tool", start["tool"].isNotNull())
        .otherwise(F.lit(True))
    )
    return df.withColumns({"paired": paired, "mappable": F.when(paired, mappable)})


def durable_calls(pairs: DataFrame) -> DataFrame:
    """Settled steps as model calls."""
    start, end = F.col("prev.detail"), F.col("detail")
    failed = F.col("event_type").endswith("failed")
    return pairs.where("family = 'step' and paired and mappable").select(
        durable_event_id(F.col("source_id")).alias("event_id"), "session_id", "arrival", format_ms("at_ms").alias("ts"),
        F.col("pair_id").alias("task_id"), start["agent"].alias("agent_id"), start["provider"].alias("provider"), start["model"].alias("model"),
        *[end[t].alias(t) for t in ("input_tokens", "output_tokens", "thought_tokens", "cached_read_tokens", "cached_write_tokens")],
        F.greatest(F.col("at_ms") - F.col("prev.at_ms"), F.lit(0)).alias("duration_ms"),
        F.when(~failed, "ok").when(F.coalesce(end["cancelled"], F.lit(False)), "cancelled").otherwise("error").alias("status"),
    )


def durable_spans(pairs: DataFrame, root_pid: Column | None = None) -> DataFrame:
    """Settled tools and shells as action spans; only work that can run here carries the agent's pid."""
    start = F.col("prev.detail")
    shell = F.col("family") == "shell"
    kind, locus = durable_tool(start["tool"], start["provider_executed"])
    kind, locus = F.when(shell, "bash").otherwise(kind), F.when(shell, "local").otherwise(locus)
    pid = root_pid if root_pid is not None else F.lit(None).cast("bigint")
    failed = F.col("event_type").endswith("failed")
    return pairs.where("family in ('tool', 'shell') and paired and mappable").select(
        durable_event_id(F.col("source_id")).alias("event_id"), "session_id", "arrival", "family",
        F.col("pair_id").alias("span_id"), F.when(~shell, F.col("detail.message_id")).alias("task_id"), F.col("pair_id").alias("tool_call_id"),
        F.when(shell, "shell").otherwise(start["tool"]).alias("tool_name"), kind.alias("tool_kind"), locus.alias("locus"),
        F.col("prev.at_ms").alias("t_start_ms"), F.col("at_ms").alias("t_end_ms"),
        F.when(locus.isin("local", "hybrid") & pid.isNotNull(), F.array(pid)).alias("pids"),
        F.when(failed, "error").otherwise("ok").alias("status"),
    )


def unpaired(pairs: DataFrame) -> DataFrame:
    """Settlements that are skipped, with why."""
    why = F.when(~F.col("paired"), "no start").otherwise("unmappable start")
    return pairs.where("not paired or not mappable").select("session_id", "family", "pair_id", "arrival", why.alias("reason"))


def missing_session_meta(sessions: DataFrame, facts: DataFrame) -> DataFrame:
    """Sessions that still need their session record."""
    known = facts.where("type = 'session_meta'").select("session_id").distinct()
    return sessions.select("session_id").distinct().join(known, "session_id", "left_anti")
