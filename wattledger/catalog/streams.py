"""Streaming forms, drained over the event log; each equals its batch form or plain SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger.catalog import query
from wattledger.catalog.lifecycle import _HX, hooks
from wattledger.catalog.prelude import with_views as V
from wattledger.functions import sanitize_id
from wattledger.operators import validate as X
from wattledger.plans.store import Store
from wattledger.session import cut, shared_dir
from wattledger.sources import spool
from wattledger.sources import tables as T
from wattledger.sources.tail import SpoolTail, number_lines
from wattledger.streaming import ingest as I
from wattledger.streaming import stateful as K

_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_of(df: DataFrame) -> DataFrame:
    """A stream over a written copy of a table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stream-in-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything there is, and read back what it wrote."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-out-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/data")
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def closed(readings: DataFrame) -> DataFrame:
    """The readings and one empty one a day after the last, so that the watermark passes every window with readings."""
    end = readings.agg((F.max("event_time") + F.expr("INTERVAL 1 DAY")).alias("event_time"))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in readings.schema.fields if f.name != "event_time"]
    return readings.unionByName(end.select("event_time", *nothing))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return T.event_log(spark, sf).withColumn("event_time", F.timestamp_millis("ts_ms"))


def _growing(lines: DataFrame, files: int = 16) -> tuple[DataFrame, DataFrame]:
    """(file_name, line, arrival) lines over some spool files, and what the files hold when they are half written."""
    named = cut(lines.select(
        F.format_string("spool.%03d.jsonl", F.pmod(F.floor("arrival"), F.lit(files)).cast("int")).alias("file_name"), "line", "arrival"
    ))
    half = named.agg(F.expr("floor(max(arrival) / 2)")).first()[0] or 0
    return named, named.where(F.col("arrival") < half)


@query("src3_growing_files", V("SELECT event_id FROM facts"))
def _(spark, sf):
    """Every event line as spool files that grow between two drains of one tail: each line arrives once."""
    base = f"{shared_dir(spark)}/spool-{uuid.uuid4().hex}"
    spark.dataSource.register(SpoolTail)
    whole, first = _growing(X.event_lines(T.balanced(T.facts(spark, sf))).select(F.col("value").alias("line"), "arrival"))
    for part in (first, whole):
        spool.write_spool(part, f"{base}/in")
        stream = spark.readStream.format("spool_tail").load(f"{base}/in").select("line")
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(
            availableNow=True).start().awaitTermination()
    got = spark.read.schema("line string").parquet(f"{base}/out")
    return got.select(F.try_variant_get(F.try_parse_json("line"), "$.event_id", "string").alias("event_id"))


@query("src5_line_numbers", V("""
SELECT event_id, n AS line_number FROM (
  SELECT event_id, row_number() OVER (PARTITION BY CAST(floor(place) AS BIGINT) % 16 ORDER BY place) AS n FROM (
    SELECT event_id, CAST(arrival AS DOUBLE) AS place FROM facts UNION ALL SELECT NULL, arrival + 0.5 FROM facts WHERE arrival % 10 = 3))
WHERE event_id IS NOT NULL"""))
def _(spark, sf):
    """Lines numbered over two drains of files in many pieces, with blank lines between them; counts are kept in the store."""
    base = f"{shared_dir(spark)}/spool-{uuid.uuid4().hex}"
    spark.dataSource.register(SpoolTail)
    store = Store(spark, f"{base}/store")
    lines = X.event_lines(T.balanced(T.facts(spark, sf))).select(F.col("value").alias("line"), F.col("arrival").cast("double").alias("arrival"))
    blank = lines.where("arrival % 10 = 3").select(F.lit("").alias("line"), F.col("arrival") + 0.5)
    whole, first = _growing(lines.union(blank))

    def numbered(batch: DataFrame, batch_id: int) -> None:
        with store.commit("tail", batch_id) as fresh:
            if fresh:
                rows = cut(batch)
                found, counts = number_lines(rows, store.stored_near("line_counts", rows.select("file_name").distinct()))
                found.select("line", "line_number").write.mode("overwrite").parquet(f"{base}/out/{batch_id}")
                store.merge("line_counts", counts)

    for part in (first, whole):
        spool.write_spool(part, f"{base}/in")
        stream = spark.readStream.format("spool_tail").option("lineNumbers", "pieces").option("maxReadBytes", 16_384).load(f"{base}/in")
        stream.writeStream.foreachBatch(numbered).option("checkpointLocation", f"{base}/checkpoint").trigger(
            availableNow=True).start().awaitTermination()
    got = spark.read.option("recursiveFileLookup", "true").schema("line string, line_number bigint").parquet(f"{base}/out")
    return got.select(F.try_variant_get(F.try_parse_json("line"), "$.event_id", "string").alias("event_id"), "line_number")


#: The arrival pattern: six steps, four files from the first one and a fifth from the fourth, and lines that are a batch.
_STEP, _STEPS = "least(5, arrival * 6 {div} {most})", 6
_FLUSH_SQL = f"""
SELECT event_id, CAST((SELECT min(k) FROM flushes f WHERE f.step >= s.step) AS BIGINT) AS batch FROM stepped s"""


@query("st1_flush_borders", V(_FLUSH_SQL,
    stepped=f"SELECT event_id, {_STEP.format(div='//', most='(SELECT max(arrival) + 1 FROM facts)')} AS step FROM facts",
    sizes="SELECT step, count(*) AS n FROM stepped GROUP BY 1",
    waits="""SELECT 0 AS step, CAST(0 AS HUGEINT) AS waiting, true AS flushed UNION ALL
      SELECT w.step + 1, CASE WHEN w.flushed THEN 0 ELSE w.waiting END + n,
        w.step + 1 IN (3, 5) OR CASE WHEN w.flushed THEN 0 ELSE w.waiting END + n >= (SELECT count(*) // 4 FROM stepped)
      FROM waits w JOIN sizes z ON z.step = w.step + 1""",
    flushes="SELECT step, row_number() OVER (ORDER BY step) - 1 AS k FROM waits WHERE flushed").replace("WITH", "WITH RECURSIVE", 1))
def _(spark, sf):
    """Lines gather until they are a quarter of all or a new file comes; a drain takes the rest."""
    base = f"{shared_dir(spark)}/spool-{uuid.uuid4().hex}"
    spark.dataSource.register(SpoolTail)
    facts = X.event_lines(T.balanced(T.facts(spark, sf))).select(F.col("value").alias("line"), "arrival")
    most = facts.agg(F.max("arrival") + 1).first()[0] or 1
    step = F.expr(_STEP.format(div="div", most=most))
    files = F.when(step < 3, 4).otherwise(5)
    lines = cut(facts.withColumn("step", step).withColumn("file_name", F.format_string("spool.%d.jsonl", F.pmod("arrival", files))))
    source = lambda: spark.readStream.format("spool_tail").option("flushRows", lines.count() // 4).option(
        "flushSeconds", 86_400).option("published", f"{base}/published").load(f"{base}/in").select("line")
    # The files of a step are announced together, or a look between two of them would be a border of its own.
    write = lambda rows: spool.write_spool(rows, f"{base}/in", publish=f"{base}/published")

    def kept(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{base}/out/{batch_id}")

    def run(**trigger):
        return source().writeStream.foreachBatch(kept).option("checkpointLocation", f"{base}/checkpoint").trigger(**trigger).start()

    write(lines.where("step = 0"))
    resident = run(processingTime="200 milliseconds")
    try:
        for k in range(_STEPS - 1):
            if k:
                write(lines.where(F.col("step") <= k))
            resident.processAllAvailable()
    finally:
        resident.stop()
    write(lines)
    run(availableNow=True).awaitTermination()
    got = spark.read.option("recursiveFileLookup", "true").schema("line string, batch bigint").parquet(f"{base}/out")
    return got.select(F.try_variant_get(F.try_parse_json("line"), "$.event_id", "string").alias("event_id"), "batch")


@query("st5_sampling_windows", V("""
SELECT ts_ms // 5000 * 5000 AS window_start, session_id, round(sum(value * 10), 6) AS energy_j, count(*) AS readings FROM ev WHERE event_type = 'purchase'
GROUP BY 1, 2"""))
def _(spark, sf):
    """All windows, the last ones closed by the end of the input."""
    readings = _log(spark, sf).where("event_type = 'purchase'").select("event_time", "session_id", (F.col("value") * 10).alias("energy_j"))
    out = drain(I.tumbling_samples(stream_of(closed(readings))))
    return out.select(F.unix_millis("window.start").alias("window_start"), "session_id", F.round("energy_j", 6).alias("energy_j"), "readings")


@query("st6_trailing_windows", V("""
SELECT w AS window_start, event_type AS type, count(*) AS events FROM (SELECT ts_ms, event_type, unnest(generate_series((ts_ms // 5000 - 35) * 5000, ts_ms // 5000 * 5000, 5000)) AS w FROM ev)
WHERE ts_ms < w + 180000 GROUP BY 1, 2"""))
def _(spark, sf):
    events = _log(spark, sf).select("event_time", F.col("event_type").alias("type"))
    return drain(I.trailing_activity(stream_of(closed(events)))).select(F.unix_millis("window.start").alias("window_start"), "type", "events")


@query("st4_session_windows", V("""
SELECT session_id, min(ts_ms) AS window_start, count(*) AS events FROM (
  SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY ts_ms) AS n FROM (
    SELECT session_id, ts_ms, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY session_id ORDER BY ts_ms) < 600000 THEN 0 ELSE 1 END AS opens FROM ev))
GROUP BY session_id, n"""))
def _(spark, sf):
    events = _log(spark, sf).select("event_time", "session_id")
    out = drain(I.session_activity(stream_of(closed(events))))
    return out.select("session_id", F.unix_millis("session_window.start").alias("window_start"), "events")


@query("ob14_announce_once", V("SELECT event_id FROM ev"))
def _(spark, sf):
    """Every event delivered twice and announced once."""
    events = _log(spark, sf).select("event_time", "event_id")
    return drain(I.announce_once(stream_of(events.unionByName(events)), "40 days")).select("event_id")


@query("st7_stream_pairing", V("SELECT session_id, span_id, arrival, tool_name, t_start_ms, t_end_ms, status, swept FROM hs", **_HX))
def _(spark, sf):
    """Hook pairing on keyed state gives the batch result."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)
    calls = hooks(spark, sf).select("session_id", "event", "tool_use_id", "tool_name", "is_interrupt", "ts_ms", "arrival")
    return drain(K.pair_hooks(stream_of(calls.withColumn("span_id", sanitize_id("tool_use_id")))))


@query("st7_stream_provider", V("""
SELECT conversation, record_seq, coalesce(p, 'unknown') AS provider FROM (
  SELECT session_id AS conversation, arrival AS record_seq, event_type, last_value(CASE WHEN event_type = 'signup' AND k % 3 <> 0 THEN 'p' || CAST(k % 4 AS VARCHAR) END IGNORE NULLS)
    OVER (PARTITION BY session_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM ev) WHERE event_type = 'view'"""))
def _(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)
    k = F.col("k")
    named = F.when((F.col("event_type") == "signup") & (k % 3 != 0), F.concat(F.lit("p"), (k % 4).cast("string")))
    records = T.event_log(spark, sf).select(
        F.col("session_id").alias("conversation"), F.col("arrival").alias("record_seq"), (F.col("event_type") == "view").alias("is_call"), named.alias("named_provider")
    )
    return drain(K.carry_provider(stream_of(records)))
