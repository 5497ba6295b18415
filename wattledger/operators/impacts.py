"""Impact joins: measured and estimated halves per session, task and tool call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger import schemas as S
from wattledger.functions import exact_sum, format_ms, policy_name, range_mean
from wattledger.operators import attribution as A
from wattledger.operators.estimation import calls_of, criterion_rows, sum_criteria
from wattledger.operators.intervals import coverage_fraction


def unit_key(level: str, *parts: str) -> Column:
    return F.concat_ws(":", F.lit(level), *[F.col(p) for p in parts])


def session_bounds(facts: DataFrame) -> DataFrame:
    return facts.groupBy("session_id").agg(F.min("ts_ms").alias("unit_start"), F.max("ts_ms").alias("unit_end"))


def span_units(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tool-call units (one per attributable span id) and (task, span id) membership."""
    local = spans.where(A.is_attributable())
    tools = local.groupBy("session_id", "span_id").agg(
        F.min("span_start").alias("unit_start"),
        F.max("span_end").alias("unit_end"),
        # The first stated id in event order.
        F.min_by("tool_call_id", F.when(F.col("tool_call_id").isNotNull(), F.struct("ts_ms", "event_id"))).alias("tool_call_id"),
    )
    members = (
        local.where("task_id is not null")
        .groupBy("session_id", "task_id", "span_id")
        .agg(F.min("span_start").alias("m_start"), F.max("span_end").alias("m_end"))
    )
    return tools, members


def local_units(facts: DataFrame, app: A.Apportionment) -> DataFrame:
    """Every unit with its extent and joules; task joules count each span id once."""
    tools, members = span_units(A.spans_of(facts))
    paid = A.span_energy(app).select("session_id", "span_id", "allocated_j")
    joules = F.coalesce("allocated_j", F.lit(0.0))
    tool_units = tools.join(paid, ["session_id", "span_id"], "left").select(
        unit_key("tool_call", "session_id", "span_id").alias("unit_key"), F.lit("tool_call").alias("level"),
        "session_id", "span_id", F.lit(None).cast("string").alias("task_id"), "tool_call_id",
        "unit_start", "unit_end", joules.alias("joules"),
    )
    task_units = (
        members.join(paid, ["session_id", "span_id"], "left")
        .groupBy("session_id", "task_id")
        .agg(F.min("m_start").alias("unit_start"), F.max("m_end").alias("unit_end"), exact_sum(joules).alias("joules"))
        .select(
            unit_key("task", "session_id", "task_id").alias("unit_key"), F.lit("task").alias("level"),
            "session_id", F.lit(None).cast("string").alias("span_id"), "task_id",
            F.lit(None).cast("string").alias("tool_call_id"), "unit_start", "unit_end", "joules",
        )
    )
    totals = A.session_energy(app).select(
        "session_id", (F.col("attributed_j") + F.col("orphaned_j") + F.col("baseline_j")).alias("joules")
    )
    session_units = session_bounds(facts).join(totals, "session_id", "left").select(
        unit_key("session", "session_id").alias("unit_key"), F.lit("session").alias("level"), "session_id",
        F.lit(None).cast("string").alias("span_id"), F.lit(None).cast("string").alias("task_id"),
        F.lit(None).cast("string").alias("tool_call_id"), "unit_start", "unit_end", "joules",
    )
    return session_units.unionByName(tool_units).unionByName(task_units)


def measured_sessions(facts: DataFrame) -> DataFrame:
    """Sessions with at least one readable energy sample, even one without length."""
    return A.samples_of(facts).groupBy("session_id").agg(
        F.bool_or(F.col("sample_start").isNotNull() & F.col("sample_end").isNotNull()).alias("measured")
    )


def local_measured(units: DataFrame, facts: DataFrame, zone_gwp: tuple[float, float] | None) -> DataFrame:
    """Measured half: kWh, its gwp range where grid factors are known, and coverage."""
    covered = coverage_fraction(
        units, A.samples_of(facts), ["session_id"], "unit_key", ("unit_start", "unit_end"), ("sample_start", "sample_end")
    )
    joined = covered.join(measured_sessions(facts), "session_id", "left")
    measured = F.coalesce("measured", F.lit(False))
    kwh = F.when(measured, F.coalesce("joules", F.lit(0.0)) / S.J_PER_KWH)
    low, high = zone_gwp if zone_gwp else (None, None)
    return joined.withColumns(
        {
            "measured": measured,
            "local_kwh": kwh,
            "local_gwp_min": kwh * F.lit(low).cast("double"),
            "local_gwp_max": kwh * F.lit(high).cast("double"),
            "coverage": F.when(measured, F.col("coverage")).otherwise(F.lit(0.0)),
            "baseline_share_excluded": F.lit(True),
        }
    )


def call_groups(calls: DataFrame) -> DataFrame:
    """Each call under the groups units can ask for: its session, its task, its tool-call id.

    Units that share a tool-call id share the group, so calls are summed once per group and never
    paired with units.
    """
    keys = F.array_compact(
        F.array(
            unit_key("session", "session_id"),
            F.when(F.col("task_id").isNotNull(), unit_key("task", "session_id", "task_id")),
            F.when(F.col("tool_call_id").isNotNull(), unit_key("tool_call", "session_id", "tool_call_id")),
        )
    )
    return calls.select(F.explode(keys).alias("call_group"), "session_id", "event_id", "ts_ms")


def unit_call_group() -> Column:
    """The call group a unit reads; null for a tool unit that never named its tool call."""
    return (
        F.when(F.col("level") != "tool_call", F.col("unit_key"))
        .when(F.col("tool_call_id").isNotNull(), unit_key("tool_call", "session_id", "tool_call_id"))
    )


def remote_estimated(groups: DataFrame, estimates: DataFrame, region: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Estimated half per call group: (call counts and completeness, guarded criterion sums)."""
    scoped = groups.join(
        estimates.select("event_id", F.lit(True).alias("has_row"), "status", "region_id", "impacts"), "event_id", "left"
    ).withColumn("status", F.when(F.col("has_row").isNull(), "pending").otherwise(F.coalesce("status", F.lit("error"))))
    summable = (F.col("status") == "ok") & F.col("impacts").isNotNull()
    stale = F.lit(False) if region is None else F.coalesce(F.col("region_id") != region, F.lit(False))
    by_status = scoped.groupBy("call_group", "status").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(summable).alias("ok"), F.count_if(stale).alias("stale")
    )
    counts = by_status.groupBy("call_group").agg(
        F.sum("n").alias("llm_calls"),
        F.sum("ok").alias("ok_estimates"),
        F.sum("stale").alias("stale_zone_estimates"),
        # One entry per status.
        F.sort_array(F.collect_list(F.struct(F.col("status").alias("key"), "n"))).alias("status_counts"),
    )
    return counts, sum_criteria(criterion_rows(scoped, ["call_group"]), ["call_group"])


def remote_columns(counts: DataFrame, sums: DataFrame) -> DataFrame:
    """Criterion sums as one map per unit: published, withheld from totals, or refused for units."""
    entry = F.struct(F.col("unit"), F.col("min"), F.col("max"), F.col("contributors"), F.col("mismatches"))
    maps = sums.groupBy("call_group").agg(
        # One entry per criterion.
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("criterion"), entry.alias("sum"))))).alias("criteria")
    )
    return counts.join(maps, "call_group", "left").withColumns(
        {
            "impacts": F.map_filter("criteria", lambda _, v: v["mismatches"] == 0),
            "unit_mismatches": F.transform_values(
                F.map_filter("criteria", lambda _, v: v["mismatches"] > 0), lambda _, v: v["mismatches"]
            ),
        }
    ).drop("criteria")


def _remote_total(name: str, unit: str) -> Column:
    """Range to add on the remote side, null when there is none that may be added."""
    c = F.try_element_at("impacts", F.lit(name))
    complete = F.coalesce("llm_calls", F.lit(0)) == F.coalesce("ok_estimates", F.lit(0))
    zero = F.struct(F.lit(0.0).alias("min"), F.lit(0.0).alias("max"))
    usable = complete & (c["unit"] == unit) & (c["contributors"] == F.col("ok_estimates"))
    return F.when(F.coalesce("llm_calls", F.lit(0)) == 0, zero).when(usable, F.struct(c["min"].alias("min"), c["max"].alias("max")))


def combined_total(df: DataFrame) -> DataFrame:
    """Local plus remote for energy and gwp, only where both halves are whole and alike."""
    energy, gwp = _remote_total("energy", "kWh"), _remote_total("gwp", "kgCO2eq")
    return df.withColumns(
        {
            "combined_energy_min": F.when(F.col("measured"), F.col("local_kwh") + energy["min"]),
            "combined_energy_max": F.when(F.col("measured"), F.col("local_kwh") + energy["max"]),
            "combined_gwp_min": F.when(F.col("measured"), F.col("local_gwp_min") + gwp["min"]),
            "combined_gwp_max": F.when(F.col("measured"), F.col("local_gwp_max") + gwp["max"]),
        }
    )


def build_joins(
    facts: DataFrame,
    estimates: DataFrame,
    zone: str = S.DEFAULT_ZONE,
    zone_source: str = "default",
    zone_gwp: tuple[float, float] | None = None,
    region: str | None = None,
    app: A.Apportionment | None = None,
) -> DataFrame:
    """All impact joins as typed columns, one row per unit."""
    from wattledger.session import cut

    app = app or A.apportion_facts(facts)
    units = cut(local_units(facts, app))
    counts, sums = remote_estimated(call_groups(calls_of(facts)), estimates, region)
    spans = A.spans_of(facts)
    samples = A.samples_of(facts)
    session_cols = (
        A.session_energy(app)
        .drop("energy_j", "samples")
        .join(A.unmeasured_spans(samples, spans), "session_id", "left")
        .join(A.skipped_events(facts), "session_id", "left")
    )
    out = combined_total(
        local_measured(units, facts, zone_gwp)
        .withColumn("call_group", unit_call_group())
        .join(remote_columns(counts, sums), "call_group", "left")
        .drop("call_group")
    ).join(session_cols, "session_id", "left")
    return out.withColumns(
        {
            "zone": F.lit(zone), "zone_source": F.lit(zone_source), "factors_available": F.lit(zone_gwp is not None),
            "policy_id": F.coalesce("policy_id", F.lit(S.POLICY_L1)),
            "llm_calls": F.coalesce("llm_calls", F.lit(0)),
        }
    )


def _range(unit: str, low: str, high: str) -> Column:
    return F.when(
        F.col(low).isNotNull() & F.col(high).isNotNull(),
        F.struct(F.lit(unit).alias("unit"), F.struct(F.col(low).alias("min"), F.col(high).alias("max")).alias("total")),
    )


def join_records(joins: DataFrame) -> DataFrame:
    """Joins as JSON records keyed by unit, nulls left out, keys sorted."""
    from wattledger.functions import canonical_json

    is_session = F.col("level") == "session"
    nonempty = lambda m: F.when(F.size(m) > 0, F.col(m))
    record = F.struct(
        F.struct("level", "session_id", "span_id", "task_id", "tool_call_id").alias("unit"),
        format_ms("unit_start").alias("t_start"),
        format_ms("unit_end").alias("t_end"),
        policy_name("policy_id").alias("attribution_policy"),
        F.col("policy_id").alias("attribution_policy_id"),
        F.struct(F.col("zone").alias("id"), F.col("zone_source").alias("source"), "factors_available").alias("zone"),
        F.struct(
            _range("kWh", "local_kwh", "local_kwh").alias("energy"),
            _range("kgCO2eq", "local_gwp_min", "local_gwp_max").alias("gwp"),
            F.when(
                is_session & F.col("measured"),
                F.struct(
                    F.col("attributed_j").alias("attributed"), F.col("baseline_j").alias("baseline_idle"),
                    F.col("orphaned_j").alias("orphaned"), F.col("joules").alias("total"),
                ),
            ).alias("breakdown_j"),
            "baseline_share_excluded",
            "coverage",
        ).alias("local_measured"),
        F.struct(
            "llm_calls",
            F.map_from_entries("status_counts").alias("estimate_status_counts"),
            F.transform_values(
                nonempty("impacts"),
                lambda _, v: F.struct(v["unit"].alias("unit"), F.struct(v["min"].alias("min"), v["max"].alias("max")).alias("total")),
            ).alias("impacts"),
            nonempty("unit_mismatches").alias("unit_mismatches"),
            F.when(F.col("stale_zone_estimates") > 0, F.col("stale_zone_estimates")).alias("stale_zone_estimates"),
        ).alias("remote_estimated"),
        F.struct(
            _range("kWh", "combined_energy_min", "combined_energy_max").alias("energy"),
            _range("kgCO2eq", "combined_gwp_min", "combined_gwp_max").alias("gwp"),
        ).alias("combined_total"),
        F.when(is_session, F.coalesce("unmeasured_remote_spans", F.lit(0))).alias("unmeasured_remote_spans"),
        F.when(
            is_session,
            F.struct(
                F.coalesce("degenerate_spans", F.lit(0)).alias("degenerate_spans"),
                F.coalesce("degenerate_samples", F.lit(0)).alias("degenerate_samples"),
                F.coalesce("samples_l1", F.lit(0)).alias("samples_l1"),
                F.coalesce("samples_l2", F.lit(0)).alias("samples_l2"),
                F.coalesce("skipped_events", F.lit(0)).alias("skipped_events"),
                F.coalesce("unobserved_process_windows", F.lit(0)).alias("unobserved_process_windows"),
            ),
        ).alias("counters"),
    )
    return joins.select("unit_key", "session_id", canonical_json(F.to_json(record)).alias("json"))


# ---------------------------------------------------------------- status line


def status_line(joins: DataFrame, missing: float = 0.0) -> DataFrame:
    """Mean figures per session: combined first, then local, then remote, else ``missing``."""

    def remote(name: str) -> Column:
        c = F.try_element_at("impacts", F.lit(name))
        return range_mean(c["min"], c["max"])

    gone = F.lit(missing)
    combined_gwp = range_mean("combined_gwp_min", "combined_gwp_max")
    combined_energy = range_mean("combined_energy_min", "combined_energy_max")
    return joins.where("level = 'session'").select(
        "session_id",
        F.coalesce(combined_gwp, remote("gwp"), gone).alias("gwp"),
        F.coalesce(remote("water"), gone).alias("water"),
        F.coalesce(combined_energy, range_mean("local_kwh", "local_kwh"), remote("energy"), gone).alias("energy"),
        F.coalesce(remote("adpe"), gone).alias("adpe"),
        F.coalesce(remote("pe"), gone).alias("pe"),
    )
