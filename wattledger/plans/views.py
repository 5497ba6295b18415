"""Interactive views that compute: streams, neighbourhoods, timeline lanes, trace and impact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattledger import schemas as S
from wattledger.functions import range_mean, share

# Fixed values of the contract.
STREAM_ROWS = 400
NEAR_MS, NEAR_ROWS = 6_000, 20
TIMELINE_MS = 180_000
DECISION_ROWS, DECISION_ATTR_ROWS = 30, 8
RETAINED_FACTS = 4_000
LIVE_MS, QUIET_MS = 12_000, 45_000
SOURCE_RANK = {"api_response": 0, "agent_telemetry": 1, "transcript": 2, "estimated": 3}
MEASURED_METHODS = ("rapl", "powermetrics", "nvml")


def event_stream(facts: DataFrame, hidden: tuple[str, ...] = (), rows: int = STREAM_ROWS) -> DataFrame:
    """Newest facts of the shown types, with how many there are."""
    shown = facts.where(~F.col("type").isin(*hidden)) if hidden else facts
    total = shown.agg(F.count(F.lit(1)).alias("n")).scalar()
    top = shown.orderBy(F.desc("ts_ms"), "arrival").limit(rows)
    return top.withColumn("total", total)


def neighbours(facts: DataFrame, within_ms: int = NEAR_MS, rows: int = NEAR_ROWS, cell_ms: int = 60_000) -> DataFrame:
    """For every fact, the nearest others within a radius, at most ``rows``, with signed offset.

    Equal distances are taken in arrival order, so of one instant only the first ``rows`` + 1 facts can be near anything.
    Facts of an instant have the same list but for themselves: it is made once an instant, from the next ``rows``
    instants on either side in time order, in one sort of narrow rows.  A fact beyond the first of its instant has
    these as its nearest, so a burst yields neither all its pairs nor a wide group.
    """
    entry = F.struct("arrival", "event_id")
    nth = F.row_number().over(Window.partitionBy("ts_ms").orderBy("arrival", "event_id"))
    known = facts.select("event_id", "ts_ms", "arrival")
    instants = known.withColumn("nth", nth).where(F.col("nth") <= rows + 1).groupBy("ts_ms").agg(
        F.sort_array(F.collect_list(entry)).alias("own")
    )
    cells = F.array_distinct(
        F.transform(F.array(F.lit(-within_ms), F.lit(0), F.lit(within_ms)), lambda d: F.floor((F.col("ts_ms") + d) / cell_ms))
    )
    placed = instants.select("ts_ms", "own", F.explode(cells).alias("cell"))
    order = Window.partitionBy("cell").orderBy("ts_ms")
    around = F.concat(*[
        F.collect_list(F.struct("ts_ms", "own")).over(order.rowsBetween(*frame)) for frame in ((-rows, -1), (0, rows))
    ])
    offset = lambda at: at - F.col("ts_ms")
    near = F.flatten(F.transform(
        F.filter("around", lambda g: F.abs(offset(g["ts_ms"])) <= within_ms),
        lambda g: F.transform(g["own"], lambda n: F.struct(
            F.abs(offset(g["ts_ms"])).alias("distance"), n["arrival"].alias("arrival"), n["event_id"].alias("other_id"),
            offset(g["ts_ms"]).alias("offset_ms"),
        )),
    ))
    home = placed.withColumn("around", around).where(F.col("cell") == F.floor(F.col("ts_ms") / cell_ms))
    first = home.select("own", F.slice(F.sort_array(near), 1, rows + 1).alias("near")).select(
        F.explode("own.event_id").alias("event_id"), "near"
    )
    full = instants.where(F.size("own") > rows)
    later = known.join(full, "ts_ms").where(entry > F.element_at("own", -1)).select(
        "event_id",
        F.transform("own", lambda n: F.struct(
            F.lit(0).cast("bigint").alias("distance"), n["arrival"].alias("arrival"), n["event_id"].alias("other_id"),
            F.lit(0).cast("bigint").alias("offset_ms"),
        )).alias("near"),
    )
    others = F.slice(F.filter("near", lambda n: n["other_id"] != F.col("event_id")), 1, rows)
    listed = first.union(later).select("event_id", F.posexplode(others).alias("pos", "n"))
    return listed.select("event_id", (F.col("pos") + 1).cast("bigint").alias("rank"), "n.other_id", "n.offset_ms")


def span_segments(samples: DataFrame, rows: DataFrame) -> DataFrame:
    """Per (span, overlapped sample): the span's part, the agent's and the baseline's."""
    mine = rows.groupBy("session_id", "span_id", "sample_id").agg(F.sum("allocated_j").alias("span_j"), F.sum("share").alias("span_share"), F.bool_and("excluded").alias("excluded"))
    return mine.join(samples.select("sample_id", F.col("orphaned_j").alias("agent_j"), "agent_share", "baseline_j", "baseline_share"), "sample_id")


def share_segments(samples: DataFrame, rows: DataFrame) -> DataFrame:
    """All parts of each sample in long form: one per row, the agent, the baseline."""
    part = lambda df, kind, label, j, f: df.select("sample_id", F.lit(kind).alias("kind"), label.alias("label"), F.col(j).alias("value_j"), F.col(f).alias("fraction"))
    return (
        part(rows, "row", F.col("span_id"), "allocated_j", "share")
        .unionByName(part(samples, "agent", F.lit("agent process"), "orphaned_j", "agent_share"))
        .unionByName(part(samples, "baseline", F.lit("baseline/idle"), "baseline_j", "baseline_share"))
    )


def sample_list(samples: DataFrame, rows: DataFrame) -> DataFrame:
    """Samples with row and exclusion counts, attributed joules, watts and the over-attribution flag."""
    per = rows.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("excluded").alias("n_excluded"), F.sum("allocated_j").alias("rows_j"),
        F.array_join(F.array_sort(F.collect_set("excluded_reason")), "; ").alias("excluded_reasons"),
    )
    seconds = F.greatest(F.lit(0.001), (F.col("sample_end") - F.col("sample_start")) / 1000.0)
    return samples.join(per, "sample_id", "left").withColumns(
        {
            "n_rows": F.coalesce("n_rows", F.lit(0)), "n_excluded": F.coalesce("n_excluded", F.lit(0)), "rows_j": F.coalesce("rows_j", F.lit(0.0)),
            "avg_watts": F.col("energy_j") / seconds, "over_attributes": F.col("l1_shadow_sum_share") > 1,
        }
    )


def with_position(rows: DataFrame) -> DataFrame:
    """Order of a row inside its sample: remote rows first, then active spans, each in event order."""
    position = F.struct((~F.col("excluded")).alias("late"), "event_id")
    return rows.withColumn("position", position)


def largest_share(rows: DataFrame) -> DataFrame:
    """The row with the largest share of each sample; the first one on ties."""
    best = F.max("share").alias("share")
    tops = rows.groupBy("sample_id").agg(best)
    return (
        with_position(rows).join(tops, ["sample_id", "share"]).groupBy("sample_id").agg(
            F.min_by("span_id", "position").alias("span_id"), F.first("share").alias("share")
        )
    )


def timeline(facts: DataFrame, window_ms: int = TIMELINE_MS) -> DataFrame:
    """Intervals that reach into the window before the newest instant; a call spans its duration up to its ts."""
    start = F.when(F.col("type") == "llm_call", F.col("ts_ms") - F.coalesce("llm_call.duration_ms", F.lit(0))).otherwise(F.coalesce("t_start_ms", "ts_ms"))
    end = F.when(F.col("type") == "llm_call", F.col("ts_ms")).otherwise(F.coalesce("t_end_ms", "ts_ms"))
    lanes = facts.where("type <> 'session_meta'").withColumns({"start_ms": start, "end_ms": end})
    head = facts.agg(F.max("ts_ms").alias("h")).scalar()
    return lanes.withColumn("head_ms", head).where(
        (F.col("end_ms") >= F.col("head_ms") - window_ms) & (F.col("start_ms") <= F.col("head_ms"))
    )


def normalised_levels(df: DataFrame, level: Column) -> DataFrame:
    """Levels over the largest level of the view."""
    leveled = df.withColumn("level", level)
    top = leveled.agg(F.max("level").alias("m")).scalar()
    return leveled.withColumn("top", top).withColumn("normalised", share("level", "top")).drop("top")


def capped_decisions(decisions: DataFrame, rows: int = DECISION_ROWS, attr_rows: int = DECISION_ATTR_ROWS) -> DataFrame:
    """Newest decisions with at most a few of the chatty kind: two top-k steps, no whole-log window."""
    newest = [F.desc("ts"), F.desc("text")]
    attr = decisions.where("kind = 'attr'").orderBy(*newest).limit(attr_rows)
    other = decisions.where("kind <> 'attr'").orderBy(*newest).limit(rows)
    return attr.unionByName(other).orderBy(*newest).limit(rows)


def idle_tier(idle_ms: Column) -> Column:
    return F.when(idle_ms < LIVE_MS, "live").when(idle_ms < QUIET_MS, "quiet").otherwise("idle")


def rail(facts: DataFrame, now_ms: int) -> DataFrame:
    """Per collector and type: count, latest instant, idle tier."""
    counts = facts.groupBy(F.col("collector.name").alias("collector"), "type").agg(F.count(F.lit(1)).alias("events"), F.max("ts_ms").alias("last_ms"))
    return counts.withColumn("tier", idle_tier(F.greatest(now_ms - F.col("last_ms"), F.lit(0))))


def latest_span_state(updates: DataFrame) -> DataFrame:
    """Latest state per span: a close replaces an open and is never undone by a later open."""
    cols = [c for c in updates.columns if c not in ("session_id", "span_id")]
    return updates.groupBy("session_id", "span_id").agg(F.max_by(F.struct(*cols), F.struct("is_closed", "seq")).alias("s")).select("session_id", "span_id", "s.*")


def criteria_table(joins: DataFrame) -> DataFrame:
    """Five criterion rows per unit: unit, local, remote and combined means, local share of the means."""
    def local(kind: str) -> Column:
        return {"energy": F.col("local_kwh"), "gwp": range_mean("local_gwp_min", "local_gwp_max")}.get(kind, F.lit(None).cast("double"))

    def combined(kind: str) -> Column:
        return range_mean(f"combined_{kind}_min", f"combined_{kind}_max") if kind in ("energy", "gwp") else F.lit(None).cast("double")

    def row(kind: str) -> Column:
        c = F.try_element_at("impacts", F.lit(kind))
        local_unit = {"energy": "kWh", "gwp": "kgCO2eq"}.get(kind)
        return F.struct(
            F.lit(kind).alias("criterion"), F.coalesce(F.when(local(kind).isNotNull(), F.lit(local_unit)), c["unit"], F.lit("—")).alias("unit"),
            local(kind).alias("local_mean"), range_mean(c["min"], c["max"]).alias("remote_mean"), combined(kind).alias("combined_mean"),
        )

    rows = joins.select("unit_key", F.inline(F.array(*[row(k) for k in S.CRITERIA])))
    l = F.greatest(F.coalesce("local_mean", F.lit(0.0)), F.lit(0.0))
    m = F.greatest(F.coalesce("remote_mean", F.lit(0.0)), F.lit(0.0))
    return rows.withColumns({"split_local": share(l, l + m), "split_remote": share(m, l + m)})


def token_only_misses(joins: DataFrame) -> DataFrame:
    """What token counts do not show, per session."""
    return joins.where("level = 'session'").select(
        "session_id", "local_kwh", "coverage", "baseline_share_excluded", F.when(F.col("measured"), F.col("orphaned_j")).alias("orphaned_j"),
        F.coalesce(F.col("measured") & (F.col("policy_id") == S.POLICY_L2), F.lit(False)).alias("agent_share_in_orphaned"),
        F.coalesce("unmeasured_remote_spans", F.lit(0)).alias("unmeasured_remote_spans"),
    )


def provenance_rank(source: Column) -> Column:
    from wattledger.functions import lookup

    return lookup(source, SOURCE_RANK)


def method_class(method: Column) -> Column:
    return F.when(method.isin(*MEASURED_METHODS), "measured").when(method == "tdp_model", "modelled").otherwise("neutral")


def fact_texts(facts: DataFrame) -> DataFrame:
    """One-line facts, source or method, and status of each event."""
    dot, length = F.lit(" · "), F.concat((F.col("t_end_ms") - F.col("t_start_ms")).cast("string"), F.lit(" ms"))
    call, span = F.col("llm_call"), F.col("action_span")
    tokens = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    thought = call["usage"]["thought_tokens"]
    processes = F.size("process_sample.processes")
    joule = lambda c: F.concat(c["kind"], F.lit(" "), F.format_string("%.1f J", c["energy_j"]))
    facts_text = (
        F.when(F.col("type") == "llm_call", F.concat_ws(
            " · ", call["model_id_requested"], F.concat(F.lit("in "), tokens(call["usage"]["input_tokens"])), F.concat(F.lit("out "), tokens(call["usage"]["output_tokens"])),
            F.when(thought > 0, F.concat(F.lit("think "), thought.cast("string"))), F.concat(call["duration_ms"].cast("string"), F.lit(" ms"))))
        .when(F.col("type") == "action_span", F.concat(span["tool_name"], dot, length, dot, span["tool_kind"], F.lit("/"), span["execution_locus"]))
        .when(F.col("type") == "energy_sample", F.concat(length, F.lit(" · total … · "), F.array_join(F.transform("energy_sample.components", joule), " · ")))
        .when(F.col("type") == "process_sample", F.concat(processes.cast("string"), F.when(processes == 1, " process").otherwise(" processes")))
        .otherwise(F.concat_ws(" ", "session_meta.agent_app.name", "session_meta.agent_app.version"))
    )
    methods = F.array_join(F.array_distinct(F.transform("energy_sample.components", lambda c: c["method"])), " + ")
    return facts.select(
        "event_id", "type", facts_text.alias("facts"),
        F.coalesce(F.when(F.col("type") == "llm_call", call["usage_source"]), F.when(F.col("type") == "energy_sample", methods), F.lit("—")).alias("source"),
        F.coalesce(call["status"], span["status"], F.lit("—")).alias("status"),
    )


def recency_label(last_ms: Column, now_ms: int) -> Column:
    """How long ago an agent was heard, in whole seconds, minutes or hours."""
    elapsed = F.greatest(now_ms - last_ms, F.lit(0))
    whole = lambda unit: F.floor(elapsed / unit).cast("string")
    coarse = F.when(elapsed < 60_000, F.concat(whole(1_000), F.lit("s"))).when(elapsed < 3_600_000, F.concat(whole(60_000), F.lit("m"))).otherwise(F.concat(whole(3_600_000), F.lit("h")))
    return (
        F.when(last_ms.isNull(), "receiving").when(elapsed < 60_000, F.concat(F.lit("receiving · "), coarse, F.lit(" ago")))
        .otherwise(F.concat(F.lit("receiving · idle "), coarse))
    )
