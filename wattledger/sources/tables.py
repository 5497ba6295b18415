"""Telemetry facts and reference tables derived from the star-schema tables.

The ``events`` table plays the event log: its rows become spans, calls, samples and session
records by type, with the details taken from ``props.k``.  All of it is projection, so readers of
one record type still push their filter and columns down to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger import schemas as S
from wattledger.functions import format_ms

TYPE_OF = {
    "click": "action_span",
    "view": "llm_call",
    "purchase": "energy_sample",
    "error": "process_sample",
    "signup": "session_meta",
}
TOOLS = ("Bash", "Edit", "WebFetch", "mcp__db", "Task", "Read", "Planner")
COLLECTORS = ("cc-hooks", "otlp-codex", "otlp-genai", "codecarbon")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def balanced(df: DataFrame) -> DataFrame:
    """Deal rows out evenly before work that is heavy per row, over all cores and more tasks where rows are many.

    A rebalance would make tasks by bytes alone, few for rows that are short now and become long lines.
    """
    return df.repartition(*df.columns)


def pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event rows with ids, instants and the derived end of each interval."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    start = F.floor(micros / F.lit(1000)).cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("evt-"), F.lpad(F.col("event_id").cast("string"), 16, "0")).alias("event_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"),
        F.col("event_id").alias("arrival"),
        F.col("event_type"),
        F.col("value"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        start.alias("ts_ms"),
        (start + F.round(F.col("value") * 100).cast("bigint") * 6000).alias("end_ms"),
    )


def _null(ddl: str) -> Column:
    return F.lit(None).cast(ddl)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per fact, in the stored shape.  A signup is a session record and a bootstrap span."""
    k = F.col("k")
    log = event_log(spark, sf_dir)
    boot = F.col("event_type") == "signup"
    log = log.withColumn("part", F.explode(F.when(boot, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    is_boot = F.col("part") == 1
    kind = F.when(is_boot, F.lit("action_span")).otherwise(
        F.coalesce(*[F.when(F.col("event_type") == e, F.lit(t)) for e, t in TYPE_OF.items()])
    )
    log = log.withColumns(
        {
            "type": kind,
            "event_id": F.when(is_boot, F.concat(F.lit("boot-"), F.col("event_id"))).otherwise(F.col("event_id")),
            "timed_end": F.when(is_boot, F.col("ts_ms")).otherwise(F.col("end_ms")),
        }
    )
    ts, t_end = format_ms("ts_ms"), format_ms("timed_end")
    timed = F.col("type").isin("action_span", "energy_sample", "process_sample")

    def payload(name: str, *fields: Column) -> Column:
        return F.when(F.col("type") == name, F.struct(*fields).cast(S.PAYLOADS[name]))

    span = payload(
        "action_span",
        F.when(is_boot, F.concat(F.lit("session-boot-"), F.col("session_id")))
        .when(k % 10 == 1, F.concat(F.col("session_id"), F.lit("-shared")))
        .otherwise(F.concat(F.lit("s"), F.col("arrival").cast("string"))),
        F.when(is_boot, F.lit(S.BOOTSTRAP_TOOL)).otherwise(pick(TOOLS, k)),
        F.when(is_boot, F.lit("other")).otherwise(
            pick(("bash", "file_op", "web", "mcp", "subagent", "file_op", "other"), k)
        ),
        F.when(is_boot, F.lit("local")).otherwise(pick(("local", "hybrid", "unknown", "remote"), k)),
        ts, t_end,
        F.when(is_boot, F.array(F.lit(0), F.lit(1)))
        .when(k % 3 == 0, F.array().cast("array<int>"))
        .otherwise(F.array((k % 5).cast("int")))
        .cast("array<bigint>"),
        _null("string"),
        F.when(is_boot, F.lit("ok")).otherwise(pick(S.STATUSES, k)),
    )
    call = payload(
        "llm_call",
        F.concat(F.lit("p"), (k % 2).cast("string")),
        F.concat(F.lit("m"), (k % 6).cast("string")),
        F.when(k % 2 == 0, F.concat(F.lit("m"), (k % 6).cast("string"))),
        _null("string"),
        F.struct(
            (k * 100), F.when(k % 17 != 0, k * 10), F.when(k % 5 == 0, k), F.when(k % 3 == 0, k * 50), _null("bigint")
        ).cast(S.USAGE),
        pick(S.USAGE_SOURCES, k),
        F.when(k % 4 != 0, k * 20),
        pick(S.STATUSES, k),
        (k % 2 == 0),
    )
    value = F.col("value")

    def component(name: str, joules: Column) -> Column:
        return F.struct(F.lit(name), _null("string"), joules, F.lit("rapl")).cast(S.COMPONENT)

    parts = F.array(component("cpu", value * 6), component("dram", value * 4))
    total = F.array(component("total", value * 10))
    sample = payload(
        "energy_sample",
        ts, t_end,
        F.when(k % 3 == 0, F.concat(parts, total)).when(k % 3 == 1, parts).otherwise(total),
        _null("string"),
    )

    def process(pid: Column, cpu: Column, orphan: Column) -> Column:
        return F.struct(pid, cpu, orphan, k * 4096, _null("bigint"), _null("bigint")).cast(S.PROCESS)

    processes = F.array(
        process(k % 5, k * 600_000, F.when(k % 10 == 0, F.concat(F.lit("s"), F.col("arrival").cast("string")))),
        process((k + 1) % 5, k * 300_000, _null("string")),
    )
    procs = payload(
        "process_sample", ts, t_end,
        F.when(k % 13 == 0, F.array().cast(f"array<{S.PROCESS}>")).otherwise(processes),
    )
    meta = payload(
        "session_meta",
        F.struct(pick(("claude-code", "codex", "opencode"), k), F.lit("1.0")),
        pick(("linux", "macos"), k),
        F.struct(F.lit("cpu"), F.array().cast("array<string>"), (k * 1.0)),
        F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.lit("FRA")).when(k % 4 == 2, F.lit("DEU")),
        pick(S.POWER_SOURCES, k),
    )
    has_ids = F.col("type").isin("action_span", "llm_call") & ~is_boot
    attribution = F.when(
        has_ids,
        F.struct(
            _null("string"), _null("string"),
            F.concat(F.lit("t"), (k % 7).cast("string")),
            F.when(k % 5 != 4, F.concat(F.lit("c"), (k % 11).cast("string"))),
        ).cast(S.ATTRIBUTION),
    )
    return log.select(
        F.lit(S.SCHEMA_VERSION).alias("schema_version"),
        "event_id",
        ts.alias("ts"),
        F.struct(pick(COLLECTORS, k), F.lit("0.1.0")).cast(S.COLLECTOR).alias("collector"),
        "session_id",
        attribution.alias("attribution"),
        "type",
        "ts_ms",
        F.when(timed, F.col("ts_ms")).alias("t_start_ms"),
        F.when(timed, F.col("timed_end")).alias("t_end_ms"),
        (F.col("arrival") * 2 + F.col("part")).alias("arrival"),
        call.alias("llm_call"),
        sample.alias("energy_sample"),
        span.alias("action_span"),
        procs.alias("process_sample"),
        meta.alias("session_meta"),
    )


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored estimates of the calls: some absent, some refused, some unreadable, some odd units."""
    k = F.col("k")

    def criterion(name: str, unit: Column, low: float, high: float) -> Column:
        return F.struct(
            F.lit(name).alias("criterion"), unit.alias("unit"), (k * low).alias("min"), (k * high).alias("max")
        )

    every = F.array(
        criterion("energy", F.when(k == 50, F.lit("Wh")).otherwise(F.lit("kWh")), 1e-4, 2e-4),
        criterion("gwp", F.lit("kgCO2eq"), 1e-3, 3e-3),
        criterion("adpe", F.lit("kgSbeq"), 1e-7, 2e-7),
        criterion("pe", F.lit("MJ"), 1e-2, 2e-2),
        criterion("water", F.lit("L"), 1e-3, 2e-3),
    )
    listed = F.filter(every, lambda c: ~((c["criterion"] == "gwp") & (k % 20 == 19)))
    status = F.when(k % 7 == 0, F.lit("unknown_model")).when(k % 23 != 0, F.lit("ok"))
    return (
        event_log(spark, sf_dir)
        .where((F.col("event_type") == "view") & (k % 9 != 0))
        .select(
            "event_id",
            "session_id",
            status.alias("status"),
            F.concat(F.lit("factors-"), (k % 2).cast("string")).alias("methodology_version"),
            F.when(k % 8 != 5, pick(("FRA", "DEU", "WOR"), k)).alias("region_id"),
            F.lit("explicit").alias("region_source"),
            F.lit(False).alias("latency_missing"),
            F.when((status == "ok") & (k % 29 != 0), listed).alias("impacts"),
        )
    )


def model_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact per output token of each model, from the supplier table; one row per criterion."""
    n = F.col("s_suppkey")
    wire = [("energy", "kWh", 1e-6), ("gwp", "kgCO2eq", 4e-7), ("adpe", "kgSbeq", 1e-11), ("pe", "MJ", 1e-5), ("wcf", "L", 2e-6)]
    rows = F.explode(
        F.array(*[
            F.struct(
                F.lit(name).alias("wire_name"), F.lit(unit).alias("unit"),
                (n * scale).alias("min"), F.when(n % 2 == 0, n * scale * 2).alias("max"),
            )
            for name, unit, scale in wire
        ])
    )
    return (
        table(spark, sf_dir, "supplier")
        .select(
            F.concat(F.lit("p"), (n % 2).cast("string")).alias("provider"),
            F.concat(F.lit("m"), n.cast("string")).alias("model"),
            rows.alias("f"),
        )
        .select("provider", "model", "f.*")
    )


def zone_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Electricity-mix factors per zone, from the nation table."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.when(n == 0, "FRA").when(n == 1, "DEU").when(n == 2, "WOR")
        .otherwise(F.concat(F.lit("Z"), n.cast("string"))).alias("zone"),
        (0.01 + n * 0.001).alias("gwp_min"),
        (0.02 + n * 0.001).alias("gwp_max"),
        (n * 1e-8).alias("adpe"),
        (n * 0.5 + 1).alias("pe"),
        (n * 0.1 + 1).alias("wue"),
    )
