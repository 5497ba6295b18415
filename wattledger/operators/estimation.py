"""Remote-inference impact estimates: the work queue, requests, factors and outcomes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger import schemas as S

# Fixed values of the contract: factor-table names that differ from the wire names, criteria that
# have an embodied part, and verdicts a newer methodology may change.
WIRE_NAMES = {"wcf": "water"}
EMBODIED = ("gwp", "adpe", "pe")
RETRIED = ("unknown_model", "missing_zone")
UNKNOWN_METHODOLOGY = "ecologits-unknown"

Estimator = Callable[[DataFrame], DataFrame]


def calls_of(facts: DataFrame) -> DataFrame:
    """Model calls with the columns estimates and summaries read."""
    c = F.col("llm_call")
    return facts.where(F.col("type") == "llm_call").select(
        "session_id", "event_id", "ts", "ts_ms",
        F.col("collector.name").alias("collector"),
        F.col("attribution.task_id").alias("task_id"),
        F.col("attribution.tool_call_id").alias("tool_call_id"),
        c["provider"].alias("provider"),
        c["model_id_requested"].alias("model_requested"),
        c["model_id_served"].alias("model_served"),
        c["usage"].alias("usage"),
        c["usage_source"].alias("usage_source"),
        c["duration_ms"].alias("duration_ms"),
        c["status"].alias("call_status"),
        "arrival",
    )


# ---------------------------------------------------------------- work queue


def calls_to_estimate(calls: DataFrame, estimates: DataFrame, methodology: str | None = None) -> DataFrame:
    """Calls without an estimate, and those whose verdict another methodology may overturn."""
    stored = estimates.select(
        "event_id", F.lit(True).alias("__known"), F.col("status").alias("__status"),
        F.col("methodology_version").alias("__methodology"),
    )
    due = F.col("__known").isNull()
    if methodology is not None:
        due = due | (F.col("__status").isin(*RETRIED) & (F.col("__methodology") != methodology))
    return calls.join(stored, "event_id", "left").where(F.coalesce(due, F.lit(False))).select(*calls.columns)


def calls_without_estimate(calls: DataFrame, estimates: DataFrame) -> DataFrame:
    return calls.join(estimates.select("event_id"), "event_id", "left_anti")


def pending_among(queue: DataFrame, ids: DataFrame) -> DataFrame:
    """The queue restricted to the given event ids."""
    return queue.join(ids.select("event_id"), "event_id", "left_semi")


def pending_counts(calls: DataFrame, estimates: DataFrame, methodology: str) -> DataFrame:
    """Both queue sizes in one pass."""
    stored = estimates.select(
        "event_id", F.lit(True).alias("__known"), "status", "methodology_version"
    )
    joined = calls.select("event_id").join(stored, "event_id", "left")
    never = F.col("__known").isNull()
    again = F.col("status").isin(*RETRIED) & (F.col("methodology_version") != methodology)
    return joined.agg(
        F.count_if(never).alias("never_estimated"), F.count_if(never | F.coalesce(again, F.lit(False))).alias("to_estimate")
    )


def estimates_for(estimates: DataFrame, ids: DataFrame) -> DataFrame:
    return estimates.join(ids.select("event_id"), "event_id", "left_semi")


# ---------------------------------------------------------------- requests


def requests(calls: DataFrame, region: str | None = None) -> DataFrame:
    """What the estimator is asked: latency in seconds when known, region only when explicit."""
    return calls.select(
        "event_id", "session_id", "ts_ms", "provider",
        F.col("model_requested").alias("model"),
        F.col("usage.output_tokens").alias("output_tokens"),
        (F.col("duration_ms") / 1000.0).alias("latency_s"),
        F.lit(region).cast("string").alias("region"),
        F.col("duration_ms").isNull().alias("latency_missing"),
    )


def normalise_factors(factors: DataFrame) -> DataFrame:
    """Long factor rows with wire names and both ends of each range (a scalar is its own range)."""
    name = F.col("wire_name")
    for ours, wire in WIRE_NAMES.items():
        name = F.when(F.col("wire_name") == ours, F.lit(wire)).otherwise(name)
    return factors.select(
        "provider", "model", name.alias("criterion"), "unit", "min", F.coalesce("max", "min").alias("max")
    ).where(F.col("criterion").isin(*S.CRITERIA)).withColumn("has_embodied", F.col("criterion").isin(*EMBODIED))


def factor_estimator(model_factors: DataFrame, zones: DataFrame, methodology: str) -> Estimator:
    """The built-in estimator: per-token factor rows, and a zone table that says which regions exist.

    Requests are reduced to distinct tuples before the factor join, so a popular model is looked up
    once.  Join sides are left to Spark, which broadcasts a factor table only when it is small.
    """
    per_model = normalise_factors(model_factors).groupBy("provider", "model").agg(
        # At most one entry per criterion.
        F.collect_list(F.struct("criterion", "unit", "min", "max")).alias("factors")
    )
    known_zones = zones.select(F.col("zone").alias("region"), F.lit(True).alias("__zone_known"))

    def run(reqs: DataFrame) -> DataFrame:
        # Generated, not projected: a region that is one literal for all would turn the zone join into a nested loop.
        region = F.explode(F.array("region")).alias("region")
        asked = reqs.select("provider", "model", "output_tokens", region).distinct()
        answered = asked.join(per_model, ["provider", "model"], "left").join(known_zones, "region", "left")
        status = (
            F.when(F.col("factors").isNull(), "unknown_model")
            .when(F.col("region").isNotNull() & F.col("__zone_known").isNull(), "missing_zone")
            .otherwise("ok")
        )
        tokens = F.col("output_tokens")
        impacts = F.transform(
            "factors",
            lambda f: F.struct(
                f["criterion"].alias("criterion"), f["unit"].alias("unit"),
                (f["min"] * tokens).alias("min"), (f["max"] * tokens).alias("max"),
            ),
        )
        return answered.withColumn("status", status).select(
            "provider", "model", "output_tokens", "region", "status",
            F.when(F.col("status") == "ok", F.array_sort(impacts)).alias("impacts"),
            F.lit(methodology).alias("response_methodology"),
            F.lit(None).cast("string").alias("response_region"),
        )

    return run


def estimate(
    calls: DataFrame, estimator: Estimator, current_methodology: str | None = None, region: str | None = None
) -> DataFrame:
    """Estimate rows for calls.  Calls without output tokens are answered without the estimator."""
    reqs = requests(calls, region)
    keys = ["provider", "model", "output_tokens", "region"]
    answered = reqs.where("output_tokens is not null")
    replies = estimator(answered)
    matched = answered.join(
        replies.withColumnsRenamed({k: f"__{k}" for k in keys}),
        [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys],
        "left",
    )
    estimated = matched.select(
        "event_id", "session_id",
        F.coalesce("status", F.lit("error")).alias("status"),
        F.coalesce("response_methodology", F.lit(current_methodology), F.lit(UNKNOWN_METHODOLOGY)).alias("methodology_version"),
        F.coalesce("response_region", "region").alias("region_id"),
        F.when(F.coalesce("response_region", "region").isNotNull(), F.when(F.col("response_region").isNotNull(), "response").otherwise("explicit")).alias("region_source"),
        F.when(F.col("status") == "ok", F.col("latency_missing")).otherwise(F.lit(False)).alias("latency_missing"),
        "impacts",
    )
    missing = reqs.where("output_tokens is null").select(
        "event_id", "session_id", F.lit("missing_usage").alias("status"), F.lit("none").alias("methodology_version"),
        F.lit(None).cast("string").alias("region_id"), F.lit(None).cast("string").alias("region_source"),
        F.lit(False).alias("latency_missing"), F.lit(None).cast(S.IMPACTS).alias("impacts"),
    )
    return estimated.unionByName(missing)


def outcome_tally(estimates: DataFrame) -> DataFrame:
    """Five disjoint counts over estimate rows."""
    def n(*statuses: str) -> Column:
        return F.count_if(F.col("status").isin(*statuses))

    return estimates.agg(
        n("ok").alias("ok"), n("unknown_model").alias("unknown_model"), n("missing_zone").alias("missing_zone"),
        n("missing_usage").alias("missing_usage"),
        F.count_if(~F.coalesce(F.col("status").isin("ok", "unknown_model", "missing_zone", "missing_usage"), F.lit(False))).alias("errors"),
    )


def stale_regions(estimates: DataFrame, expected: str) -> DataFrame:
    """How many estimates were made for another region than the one in force, per such region."""
    zone = F.col("region_id") if "zone" not in estimates.columns else F.coalesce("region_id", "zone")
    return estimates.select(zone.alias("region_id")).where(F.col("region_id") != expected).groupBy("region_id").agg(
        F.count(F.lit(1)).alias("stale")
    )


def with_zone_factors(df: DataFrame, zones: DataFrame, zone: str) -> DataFrame:
    """Attach the grid factors of one column's zone; unknown zones have none."""
    return df.join(zones.withColumnRenamed("zone", zone), zone, "left")


# ---------------------------------------------------------------- guarded sums


def criterion_rows(scoped: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long criterion rows of summable estimates (``ok`` and carrying impacts), with order keys."""
    return scoped.where((F.col("status") == "ok") & F.col("impacts").isNotNull()).select(
        *keys, "ts_ms", "event_id", F.inline("impacts")
    ).where(F.col("unit").isNotNull() & F.col("min").isNotNull() & F.col("max").isNotNull())


def sum_criteria(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Guarded sums: the unit of the first estimate wins, other units are counted and never added.

    Summed per unit first, so the second step sees a handful of rows per group however many
    estimates there are.
    """
    from wattledger.functions import exact_sum

    keys = list(keys)
    per_unit = rows.groupBy(*keys, "criterion", "unit").agg(
        F.min(F.struct("ts_ms", "event_id")).alias("first"),
        F.count(F.lit(1)).alias("n"),
        exact_sum("min").alias("min"),
        exact_sum("max").alias("max"),
    )
    winner = F.min_by(F.struct("unit", "n", "min", "max"), F.col("first"))
    return (
        per_unit.groupBy(*keys, "criterion")
        .agg(winner.alias("w"), F.sum("n").alias("__all"))
        .select(
            *keys, "criterion", "w.unit", "w.min", "w.max",
            F.col("w.n").alias("contributors"), (F.col("__all") - F.col("w.n")).alias("mismatches"),
        )
    )
