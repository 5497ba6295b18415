"""Observability queries: model reports, health, watchdog, traces, decisions, session lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger import schemas as S
from wattledger.functions import format_ms, policy_name, share
from wattledger.operators import attribution as A
from wattledger.operators.estimation import criterion_rows, sum_criteria

# Fixed texts of the contract.
NO_COMMAND = "unknown (no command line observed)"
ROOT_TREE = "root-tree (span declared none)"


def scoped_estimates(calls: DataFrame, estimates: DataFrame) -> DataFrame:
    """Calls with their estimate; absent is pending, unreadable is error."""
    stored = estimates.select("event_id", F.lit(True).alias("has_row"), "status", "impacts")
    return calls.join(stored, "event_id", "left").withColumn(
        "status", F.when(F.col("has_row").isNull(), "pending").otherwise(F.coalesce("status", F.lit("error")))
    )


def report_by_model(calls: DataFrame, estimates: DataFrame) -> DataFrame:
    """Guarded sums per session and requested model; criteria in several units are dropped."""
    keys = ["session_id", "model_requested"]
    rows = criterion_rows(scoped_estimates(calls, estimates), keys)
    return sum_criteria(rows, keys).where("mismatches = 0")


def per_model_statuses(calls: DataFrame, estimates: DataFrame) -> DataFrame:
    """Distinct statuses per session and model, and whether the model is unknown to the estimator."""
    return scoped_estimates(calls, estimates).groupBy("session_id", "model_requested").agg(
        F.array_join(F.array_sort(F.collect_set("status")), ", ").alias("statuses"),
        F.bool_or(F.col("status") == "unknown_model").alias("is_unknown"),
    )


def status_histogram(calls: DataFrame, estimates: DataFrame) -> DataFrame:
    """Calls per status and session, zero-filled for the known statuses; others only when seen."""
    counts = scoped_estimates(calls, estimates).groupBy("session_id", "status").agg(F.count(F.lit(1)).alias("calls"))
    known = F.explode(F.array(*[F.lit(s) for s in S.ESTIMATE_STATUSES])).alias("status")
    dense = counts.select("session_id").distinct().select("session_id", known)
    zeros = dense.withColumn("calls", F.lit(0).cast("bigint"))
    return counts.unionByName(zeros).groupBy("session_id", "status").agg(F.sum("calls").alias("calls"))


def reject_key(file_name: Column) -> Column:
    """``collector:session`` of the file a reject came from."""
    from wattledger.sources.spool import collector_of, session_of

    return F.concat_ws(":", collector_of(file_name), session_of(file_name))


def collector_health(facts: DataFrame, rejects: DataFrame) -> DataFrame:
    """Per (collector, session): events, first version, last seen, emitted types, rejects, transport."""
    name = F.col("collector.name")
    stats = facts.groupBy(name.alias("collector"), "session_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.min_by("collector.version", F.struct("ts", "event_id")).alias("version"),
        F.max("ts").alias("last_seen"),
        F.array_join(F.array_sort(F.collect_set("type")), ",").alias("emits"),
        F.max("arrival").alias("offset"),
    )
    lost = rejects.groupBy("origin").agg(F.count(F.lit(1)).alias("rejects"))
    keyed = stats.withColumn("origin", F.concat_ws(":", "collector", "session_id"))
    return keyed.join(lost, "origin", "left").drop("origin").withColumns(
        {
            "rejects": F.coalesce("rejects", F.lit(0)),
            "transport": F.when(F.col("collector").startswith("otlp-"), "otlp").otherwise("spool"),
        }
    )


def idle_sessions(facts: DataFrame, now_ms: int, timeout_ms: int = S.IDLE_SESSION_MS) -> DataFrame:
    last = facts.groupBy("session_id").agg(F.max("ts_ms").alias("last_ms"))
    return last.withColumn("idle_ms", now_ms - F.col("last_ms")).where(F.col("idle_ms") >= timeout_ms)


def retired_totals(health: DataFrame, retired: DataFrame) -> DataFrame:
    """What retired sessions leave behind per collector."""
    return health.join(retired.select("session_id"), "session_id", "left_semi").groupBy("collector").agg(
        F.sum("events").alias("events"), F.sum("rejects").alias("rejects"), F.count(F.lit(1)).alias("sessions"),
        F.max("last_seen").alias("last_seen"),
    )


def loss_totals(rejects: DataFrame, window: int = S.REJECT_WINDOW) -> DataFrame:
    """Rejects by source, how many are in the newest window, and how many fell out of it."""
    newest = rejects.orderBy(F.desc("id")).limit(window).agg(F.count(F.lit(1)).alias("in_window")).withColumn("one", F.lit(1))
    totals = rejects.agg(
        F.count_if(F.col("source") == "spool").alias("spool"), F.count_if(F.col("source") == "otlp").alias("otlp"),
        F.count(F.lit(1)).alias("total"),
    ).withColumn("one", F.lit(1))
    return totals.join(newest, "one").drop("one").withColumn("dropped_from_window", F.col("total") - F.col("in_window"))


def watchdog(facts: DataFrame) -> DataFrame:
    """Processes of each session's latest process sample with owner, state, cpu share and overrun.

    The owner of an orphan is the span it names; of another pid, the first span, in event order, that
    claims it.
    """
    procs = facts.where("type = 'process_sample'")
    latest = procs.groupBy("session_id").agg(
        F.max_by(F.struct("t_start_ms", "t_end_ms", F.col("process_sample.processes").alias("processes")), F.struct("ts", "event_id")).alias("s")
    )
    rows = latest.select("session_id", "s.t_start_ms", "s.t_end_ms", F.posexplode("s.processes").alias("pos", "p")).select(
        "session_id", "t_start_ms", "t_end_ms", "pos", "p.*"
    )
    spans = A.spans_of(facts)
    roots = A.root_pids_of(spans).withColumn("is_root", F.lit(True))
    first = F.min_by(F.struct("span_id", "tool_name", "span_end"), F.struct("ts_ms", "event_id"))
    seq = F.min(F.struct("ts_ms", "event_id")).alias("seq")
    by_id = spans.groupBy("session_id", F.col("span_id").alias("orphan_of")).agg(first.alias("named"))
    by_pid = spans.select("session_id", "ts_ms", "event_id", "span_id", "tool_name", "span_end", F.explode("pids").alias("pid")).groupBy(
        "session_id", "pid"
    ).agg(first.alias("own"), seq)
    heirs = spans.where(F.size("pids") == 0).groupBy("session_id").agg(first.alias("heir"), seq.alias("heir_seq"))
    df = (
        rows.join(roots, ["session_id", "pid"], "left").join(by_id, ["session_id", "orphan_of"], "left")
        .join(by_pid, ["session_id", "pid"], "left").join(heirs, "session_id", "left")
    )
    heir = F.when(F.col("is_root"), F.col("heir"))
    claimed = F.when(F.col("own").isNull() | (heir.isNotNull() & (F.col("heir_seq") < F.col("seq"))), F.coalesce(heir, F.col("own"))).otherwise(F.col("own"))
    orphan = F.col("orphan_of").isNotNull()
    df = df.withColumn("owner", F.when(orphan, F.col("named")).otherwise(claimed))
    window = F.col("t_end_ms") - F.col("t_start_ms")
    late = F.when(orphan & F.col("owner").isNotNull(), F.greatest(F.col("t_end_ms") - F.col("owner.span_end"), F.lit(0)))
    return df.select(
        "session_id", "pos", "pid",
        F.coalesce("orphan_of", "owner.span_id", F.lit("")).alias("span_id"),
        F.coalesce("owner.tool_name", F.lit(NO_COMMAND)).alias("cmd"),
        F.when(window > 0, F.col("cpu_time_delta_ms") / window * 100.0).otherwise(F.lit(0.0)).alias("cpu_pct"),
        F.coalesce("memory_rss_bytes", F.lit(0)).alias("rss_bytes"),
        F.when(orphan, "orphaned").when(F.coalesce("is_root", F.lit(False)) & F.col("owner").isNull(), "agent").otherwise("open").alias("state"),
        F.when(late.isNotNull(), format_ms("owner.span_end")).alias("orphaned_since"),
        late.alias("outlived_span_by_ms"),
        F.col("cpu_time_delta_ms").alias("cpu_ms"), window.alias("window_ms"),
    )


def allocation_trace(app: A.Apportionment, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, rows) of the trace with shares of the sample's energy."""
    samples = app.samples.withColumns(
        {"baseline_share": share("baseline_j", "energy_j"), "agent_share": share("orphaned_j", "energy_j"), "policy": policy_name("policy_id")}
    )
    energy = app.samples.select("sample_id", "energy_j")
    return samples, rows.join(energy, "sample_id").withColumn("share", share("allocated_j", "energy_j")).drop("energy_j")


def _decision(df: DataFrame, kind: str, ts: Column, text: Column, ref: Column) -> DataFrame:
    return df.select("session_id", F.lit(kind).alias("kind"), ts.alias("ts"), text.alias("text"), ref.alias("ref"))


def decision_log(facts: DataFrame, app: A.Apportionment, rows: DataFrame) -> DataFrame:
    """Ingest, span-open, attribution and orphan lines."""
    session = F.concat(F.lit(" session="), F.col("session_id"))
    token = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    interval = lambda p: F.concat(F.col(p)["t_start"], F.lit("→"), F.col(p)["t_end"])
    call, span = F.col("llm_call"), F.col("action_span")
    said = {
        "llm_call": F.concat(
            F.lit("llm_call "), call["model_id_requested"], F.lit(" in="), token(call["usage"]["input_tokens"]), F.lit(" out="),
            token(call["usage"]["output_tokens"]), F.lit(" src="), call["usage_source"], session,
        ),
        "action_span": F.concat(F.lit("action_span "), span["tool_name"], F.lit(" ("), span["tool_kind"], F.lit(") "), interval("action_span"), session),
        "energy_sample": F.concat(
            F.lit("energy_sample "), F.format_string("%.3f", A.sample_joules(F.col("energy_sample.components"))), F.lit("J over "), interval("energy_sample"), session
        ),
        "process_sample": F.concat(F.lit("process_sample "), F.size("process_sample.processes").cast("string"), F.lit(" tree(s) over "), interval("process_sample"), session),
        "session_meta": F.concat(F.lit("session_meta "), F.col("session_meta.agent_app.name"), F.lit(" "), F.coalesce("session_meta.os", F.lit("os=?")), session),
    }
    ingest = _decision(facts, "ingest", F.col("ts"), F.coalesce(*[F.when(F.col("type") == t, x) for t, x in said.items()]), F.col("event_id"))
    pids = F.array_join(span["pids"].cast("array<string>"), ",")
    opened = _decision(
        facts.where("type = 'action_span'"), "span_open", F.col("ts"),
        F.concat(span["tool_name"], F.lit(" pid="), F.when(pids != "", pids).otherwise(F.lit(ROOT_TREE)), F.lit(" span="), span["span_id"]), span["span_id"],
    )
    paid = rows.where("not excluded").groupBy("sample_id").agg(
        # The line names every span of the sample, so it is as long as the sample is busy.
        F.array_sort(F.collect_list(F.struct("event_id", F.concat(F.lit("span "), "span_id", F.lit(":"), F.format_string("%.1f", "allocated_j")).alias("t")))).alias("parts")
    )
    t_end = format_ms("sample_end")
    orphan_part = F.when(F.col("orphaned_j") > 0, F.concat(F.lit("orphan:"), F.format_string("%.1f", "orphaned_j")))
    pieces = F.concat(
        F.transform(F.coalesce("parts", F.array().cast("array<struct<event_id:string,t:string>>")), lambda p: p["t"]),
        F.array_compact(F.array(orphan_part, F.concat(F.lit("idle:"), F.format_string("%.1f", "baseline_j")))),
    )
    attr = _decision(
        app.samples.join(paid, "sample_id", "left"), "attr", t_end,
        F.concat(F.lit("sample "), F.format_string("%.1f", "energy_j"), F.lit("J → "), F.array_join(pieces, " "), F.lit(" ["), F.col("policy_id"), F.lit("]")),
        F.lit(None).cast("string"),
    )
    orphan = _decision(
        app.samples.where("orphaned_j > 0"), "orphan", t_end,
        F.concat(F.format_string("%.3f", "orphaned_j"), F.lit("J of unclaimed compute in "), format_ms("sample_start"), F.lit("→"), t_end,
                 F.lit(" (tree outlived its span, or no span claimed it)")),
        F.lit(None).cast("string"),
    )
    return ingest.unionByName(opened).unionByName(attr).unionByName(orphan)


def session_headers(facts: DataFrame, app: A.Apportionment, zone_gwp: tuple[float, float] | None) -> DataFrame:
    """Per session: first session record, bounds, event count, applied policy, grid grams per kWh."""
    first = F.when(F.col("type") == "session_meta", F.struct("ts", "event_id"))
    base = facts.groupBy("session_id").agg(
        F.min_by("session_meta.agent_app.name", first).alias("agent_app"), F.min("ts").alias("t_start"), F.max("ts").alias("last_ts"),
        F.count(F.lit(1)).alias("events"),
    )
    policies = A.session_energy(app).select("session_id", "applied_policy_id")
    grid = sum(zone_gwp) / 2 * 1000 if zone_gwp else None
    return base.join(policies, "session_id", "left").withColumns(
        {"applied_policy_id": F.coalesce("applied_policy_id", F.lit(S.POLICY_NONE)), "grid_g_per_kwh": F.lit(grid).cast("double")}
    )


def session_list(summaries: DataFrame) -> DataFrame:
    return summaries.select("session_id", "events", "first_ts", "last_ts").orderBy(F.desc("last_ts"), "session_id")


def trailing(frames: DataFrame, at: str, window_ms: int) -> DataFrame:
    """Frames within a window of the newest one."""
    head = frames.agg(F.max(at).alias("head")).scalar()
    return frames.where(F.col(at) >= head - window_ms)


def agent_states(activity: DataFrame, known_agents: list[str]) -> DataFrame:
    """``receiving`` for agents heard in the window, else ``silent``."""
    spark = activity.sparkSession
    agents = spark.range(1).select(F.explode(F.array(*[F.lit(a) for a in known_agents])).alias("agent"))
    heard = activity.select("agent", "agent_last_ts").distinct()
    return agents.join(heard, "agent", "left").withColumn("state", F.when(F.col("agent_last_ts").isNotNull(), "receiving").otherwise("silent"))
