"""Period summary: token and impact figures in total, by agent, by model and by local day."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger import schemas as S
from wattledger.functions import day_text, format_ms, local_day
from wattledger.operators.estimation import criterion_rows, sum_criteria
from wattledger.plans.reads import agent_label, agent_of

PERIOD_DAYS = {"today": 1, "7d": 7, "30d": 30}
TOKENS = ("input", "output", "thought", "cache_read", "cache_write")
_USAGE = dict(zip(TOKENS, ("input_tokens", "output_tokens", "thought_tokens", "cached_read_tokens", "cached_write_tokens")))
KEYS = ("level", "agent", "label")


@dataclass(frozen=True)
class Period:
    """Local-day bounds under one UTC offset; both ends of the instant range are included."""

    name: str
    now_ms: int
    offset_minutes: int = 0

    @property
    def today(self) -> int:
        return (self.now_ms + self.offset_minutes * 60_000) // S.DAY_MS

    @property
    def first_day(self) -> int:
        return self.today - (PERIOD_DAYS[self.name] - 1)

    @property
    def from_ms(self) -> int:
        return self.first_day * S.DAY_MS - self.offset_minutes * 60_000


def in_period(calls: DataFrame, period: Period) -> DataFrame:
    """A day's margin on the text, which prunes files, then the exact instants."""
    low, high = (format_ms(F.lit(ms)) for ms in (period.from_ms - S.DAY_MS, period.now_ms + S.DAY_MS))
    return calls.where(F.col("ts").between(low, high)).where(
        F.col("ts_ms").between(period.from_ms, period.now_ms)
    )


def model_of() -> Column:
    return F.coalesce("model_served", "model_requested")


def labelled_calls(calls: DataFrame, estimates: DataFrame, period: Period) -> DataFrame:
    """Calls of the period with agent, model, day, token counts and why they have no estimate.

    Here an estimate without a readable status counts as pending, and one marked ok without
    impacts is unestimated for the reason ``ok``.
    """
    zero = F.lit(0).cast("bigint")
    tokens = {name: F.coalesce(F.col("usage")[field], zero) for name, field in _USAGE.items()}
    agent = agent_of("collector")
    stored = estimates.select("event_id", "status", "impacts")
    summable = F.coalesce((F.col("status") == "ok") & F.col("impacts").isNotNull(), F.lit(False))
    return (
        in_period(calls, period)
        .join(stored, "event_id", "left")
        .withColumns(
            {
                "agent": F.coalesce(agent, F.lit("other")),
                "name": agent_label(agent),
                "model": model_of(),
                "day": local_day("ts_ms", period.offset_minutes),
                **tokens,
                "reason": F.when(~summable, F.coalesce("status", F.lit("pending"))),
            }
        )
    )


def _level() -> Column:
    """Which grouping set a row belongs to."""
    return (
        F.when(F.grouping("day") == 0, "day")
        .when(F.grouping("model") == 0, "model")
        .when(F.grouping("agent") == 0, "agent")
        .otherwise("total")
    )


def _label() -> Column:
    return F.coalesce(day_text("day"), "model", "name")


def figures(labelled: DataFrame) -> DataFrame:
    """All four breakdowns in one pass over calls already summed per (keys, session, reason)."""
    total = sum((F.col(t) for t in TOKENS[1:]), F.col(TOKENS[0]))
    dims = ["agent", "name", "model", "day"]
    base = labelled.groupBy(*dims, "session_id", "reason").agg(
        F.count(F.lit(1)).alias("calls"), *[F.sum(t).alias(t) for t in TOKENS], F.sum(total).alias("total")
    )
    sets = [[], ["agent", "name"], ["agent", "model"], ["day"]]
    main = (
        base.groupingSets(sets, *dims)
        .agg(
            _level().alias("level"),
            F.sum("calls").alias("calls"),
            F.countDistinct("session_id").alias("sessions"),
            *[F.sum(t).alias(t) for t in TOKENS],
            F.sum("total").alias("total"),
            F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("calls"))), F.lit(0)).alias("estimated_calls"),
        )
        .select("level", F.coalesce("agent", F.lit("")).alias("agent"), F.coalesce(_label(), F.lit("")).alias("label"), "calls",
                "sessions", *TOKENS, "total", "estimated_calls", (F.col("calls") - F.col("estimated_calls")).alias("unestimated_calls"))
    )
    why = reasons(base)
    per_group = why.groupBy(*KEYS).agg(
        # One entry per reason.
        F.sort_array(F.collect_list(F.struct(F.col("reason").alias("key"), F.col("calls").alias("n")))).alias("unestimated_by_reason")
    )
    # The empty grouping set yields a row even over no calls.
    return main.where("calls is not null").join(per_group, list(KEYS), "left")


def reasons(base: DataFrame) -> DataFrame:
    """Unestimated calls and tokens per group and reason."""
    dims = ["agent", "name", "model", "day"]
    sets = [["reason"], ["agent", "name", "reason"], ["agent", "model", "reason"], ["day", "reason"]]
    return (
        base.where("reason is not null")
        .groupingSets(sets, *dims, "reason")
        .agg(_level().alias("level"), F.sum("calls").alias("calls"), F.sum("total").alias("tokens"))
        .select("level", F.coalesce("agent", F.lit("")).alias("agent"), F.coalesce(_label(), F.lit("")).alias("label"), "reason", "calls", "tokens")
    )


def models_not_estimated(labelled: DataFrame) -> DataFrame:
    """Models the estimator has no figures for, with those calls and tokens only, largest first."""
    total = sum((F.col(t) for t in TOKENS[1:]), F.col(TOKENS[0]))
    return (
        labelled.where(F.col("reason") != "pending")
        .groupBy("agent", "model")
        .agg(F.min("reason").alias("reason"), F.count(F.lit(1)).alias("calls"), F.sum(total).alias("tokens"))
        .orderBy(F.desc("tokens"), "agent", "model")
    )


def remote_sums(labelled: DataFrame) -> DataFrame:
    """Guarded criterion sums of every group; criteria reported in several units are left out."""
    group = lambda level, agent, label: F.struct(F.lit(level).alias("level"), agent.alias("agent"), label.alias("label"))
    none = F.lit("")
    groups = F.array(
        group("total", none, none), group("agent", F.col("agent"), F.col("name")),
        group("model", F.col("agent"), F.col("model")), group("day", none, day_text("day")),
    )
    scoped = labelled.where("reason is null").select(
        F.explode(groups).alias("g"), "ts_ms", "event_id", "status", "impacts"
    ).select("g.*", "ts_ms", "event_id", "status", "impacts")
    return sum_criteria(criterion_rows(scoped, KEYS), KEYS).where("mismatches = 0")


def dense_days(by_day: DataFrame, period: Period) -> DataFrame:
    """Every local day of the period, silent ones with zeros."""
    spark = by_day.sparkSession
    days = spark.range(period.first_day, period.today + 1).select(day_text("id").alias("label"))
    counts = [c for c in ("calls", "sessions", *TOKENS, "total", "estimated_calls", "unestimated_calls") if c in by_day.columns]
    return days.join(by_day.where("level = 'day'"), "label", "left").fillna(0, counts).fillna({"level": "day", "agent": ""})


def ranked(groups: DataFrame) -> DataFrame:
    """Largest token count first, ties by key."""
    return groups.orderBy(F.desc("total"), "agent", "label")


def header(facts: DataFrame, period: Period) -> DataFrame:
    return facts.agg(F.max("ts").alias("last_event_at")).select(
        format_ms(F.lit(period.now_ms)).alias("generated_at"), F.lit(period.name).alias("period"),
        format_ms(F.lit(period.from_ms)).alias("from"), format_ms(F.lit(period.now_ms)).alias("to"),
        F.lit(period.offset_minutes).cast("bigint").alias("utc_offset_minutes"), "last_event_at",
    )


def document(calls: DataFrame, estimates: DataFrame, facts: DataFrame, period: Period) -> DataFrame:
    """The whole summary as one JSON row.  Only finished figures are gathered, never calls."""
    labelled = labelled_calls(calls, estimates, period)
    sums = remote_sums(labelled).groupBy(*KEYS).agg(
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct("criterion", F.struct("unit", F.struct("min", "max").alias("total")).alias("v"))))
        ).alias("remote")
    )
    groups = dense_days(figures(labelled), period).unionByName(figures(labelled).where("level <> 'day'"))
    rows = groups.join(sums, list(KEYS), "left").select(
        "level", F.col("total").alias("rank"), "agent", "label",
        F.struct(
            F.when(F.col("agent") != "", F.col("agent")).alias("agent"),
            F.when(F.col("level") == "agent", F.col("label")).alias("name"),
            F.when(F.col("level") == "model", F.col("label")).alias("model"),
            F.when(F.col("level") == "day", F.col("label")).alias("date"),
            "calls", "sessions", F.struct(*TOKENS, "total").alias("tokens"), "estimated_calls", "unestimated_calls",
            F.coalesce(F.map_from_entries("unestimated_by_reason"), F.create_map().cast("map<string,bigint>")).alias("unestimated_by_reason"),
            F.col("remote"),
        ).alias("doc"),
    )

    def by_key(a: Column, b: Column) -> Column:
        return F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)

    def listed(level: str, order: Column) -> Column:
        entry = F.struct(F.struct(order.alias("o"), "agent", "label").alias("key"), "doc")
        entries = F.collect_list(F.when(F.col("level") == level, entry))
        return F.transform(F.array_sort(entries, by_key), lambda e: e["doc"]).alias("by_" + level)

    lists = rows.agg(
        F.first(F.when(F.col("level") == "total", F.col("doc")), ignorenulls=True).alias("totals"),
        listed("agent", -F.col("rank")), listed("model", -F.col("rank")), listed("day", F.lit(0)),
    )
    missing = models_not_estimated(labelled).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("tokens")).alias("o"), F.struct("agent", "model", "reason", "calls", "tokens").alias("doc")))),
            lambda e: e["doc"],
        ).alias("models_not_estimated")
    )
    one = F.lit(1).alias("__one")
    joined = (
        header(facts, period).select("*", one).join(lists.select("*", one), "__one").join(missing.select("*", one), "__one")
    )
    return joined.select(
        F.to_json(
            F.struct(
                "generated_at",
                F.struct(F.col("period").alias("name"), "from", "to", "utc_offset_minutes").alias("period"),
                F.struct("last_event_at").alias("collector"),
                "totals", "by_agent", "by_model", "by_day", "models_not_estimated",
            )
        ).alias("summary")
    )
