"""Resident ingest: stream -> validate -> deduplicating append -> rebuild of touched sessions.

Delivery is at least once; a batch is one commit and is skipped when it comes again, so the effect is once.  Late events are
never dropped: they mark their session, which is rebuilt from all its facts.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wattledger.operators.estimation import Estimator
from wattledger.operators.validate import classify, known_facts, opaque_events, reject_rows
from wattledger.plans import ledger
from wattledger.plans.rebuild import Outcome, Settings
from wattledger.plans.store import Store
from wattledger.session import cut, scratch
from wattledger.streaming.hold import Hold

FLUSH = "60 seconds"
#: Samples alone wait for six of these.
INTERVAL_MS = 60_000
#: Batches from one cleaning of the store to the next, and commits whose parts stay readable.
VACUUM_EVERY, KEEP_COMMITS = 64, 128


def with_arrival(lines: DataFrame) -> DataFrame:
    """Arrival order inside a file; events of two files at one place are told apart by their JSON (``first_wins``)."""
    return lines.withColumn("arrival", F.col("byte_offset"))


def ingest_batch(
    store: Store, lines: DataFrame, batch_id: int, settings: Settings | None = None, writer: str = "ingest",
    estimator: Estimator | None = None, now_ms: int | None = None, interval_ms: int = INTERVAL_MS,
) -> dict[str, int]:
    """Commit one micro-batch: facts, opaque rows, rejects, the ledger and joins together, or nothing of it.

    A batch that the writer committed already is skipped.  Sessions with new facts are rebuilt in the batch, but for
    those known ones that brought samples only: they wait for some intervals (``plans.ledger``), as the ledger says even
    after a restart.  Intermediate results are deleted at the end.
    """
    counts = {"inserted": 0, "opaque": 0, "rejected": 0}
    now_ms = int(time.time() * 1000) if now_ms is None else now_ms
    with scratch(lines.sparkSession), store.commit(writer, batch_id) as fresh:
        if fresh:
            keep = [c for c in ("line", "arrival", "origin", "type", "outcome", "reason_kind", "reason", "bytes")]
            checked = classify(with_arrival(lines)).drop("v")
            checked = cut(checked.select(*[c for c in keep if c in checked.columns]))
            # VARIANT columns are parsed again from the kept text, which is cheaper than storing both.
            again = checked.withColumn("v", F.try_parse_json("line"))
            counts["inserted"] = store.insert_events(known_facts(again))
            counts["opaque"] = store.insert_opaque(opaque_events(again))
            counts["rejected"] = store.insert_rejects(reject_rows(checked), now_ms)
            if settings is not None:
                ledger.mark_facts(store, known_facts(again), now_ms)
                ledger.catch_up(store, settings, now_ms, interval_ms, estimator)
    if batch_id % VACUUM_EVERY == VACUUM_EVERY - 1:
        store.vacuum(KEEP_COMMITS)
    return counts


def writing(
    store: Store, writer: str, settings: Settings | None = None, estimator: Estimator | None = None, interval_ms: int = INTERVAL_MS,
) -> Callable[[DataFrame, int], dict[str, int]]:
    """Commits of one writer by batch number; a clean stop gives it to ``Hold.drain`` with the checkpoint as the writer."""
    return lambda batch, number: ingest_batch(store, batch, number, settings, writer, estimator, interval_ms=interval_ms)


def start(
    lines: DataFrame, store: Store, checkpoint: str, settings: Settings | None = None, every: str | None = FLUSH,
    on_batch: Callable[[dict[str, int]], None] | None = None, estimator: Estimator | None = None, interval_ms: int = INTERVAL_MS,
    hold: Hold | None = None,
) -> StreamingQuery:
    """Start the resident ingest; ``every=None`` drains what is there and stops.

    Batches that the store refuses fail the query, unless there is a ``hold``, in which they wait for the next batch.
    For flushes by rows or new files give the source ``flushRows`` and ``flushSeconds``, and a trigger of a second here.

    The checkpoint names the writer, so a restarted query does not commit a batch twice.  With an estimator the calls
    of touched sessions are estimated in the same commit.  After a clean stop ``drain`` rebuilds what still waits.
    """

    write = writing(store, checkpoint, settings, estimator, interval_ms)

    def flush(batch: DataFrame, batch_id: int) -> None:
        counts = hold.deliver(batch, batch_id, write) if hold else write(batch, batch_id)
        if on_batch:
            on_batch(counts)

    writer = lines.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.trigger(**trigger).start()


def drain(store: Store, settings: Settings, estimator: Estimator | None = None, now_ms: int | None = None) -> Outcome:
    """Rebuild everything that is dirty, as a clean stop does."""
    now_ms = int(time.time() * 1000) if now_ms is None else now_ms
    with scratch(store.spark):
        return ledger.catch_up(store, settings, now_ms, 0, estimator, everything=True)


def announce_once(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event id once within the watermark, for notifications (not for the stored facts)."""
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])


def tumbling_samples(readings: DataFrame, width: str = "5 seconds", delay: str = "1 minute") -> DataFrame:
    """Energy per session and sampling window from raw readings."""
    return readings.withWatermark("event_time", delay).groupBy(F.window("event_time", width), "session_id").agg(
        F.sum("energy_j").alias("energy_j"), F.count(F.lit(1)).alias("readings")
    )


def trailing_activity(events: DataFrame, width: str = "180 seconds", slide: str = "5 seconds", delay: str = "1 minute") -> DataFrame:
    """Events per type in a sliding window."""
    return events.withWatermark("event_time", delay).groupBy(F.window("event_time", width, slide), "type").agg(
        F.count(F.lit(1)).alias("events")
    )


def session_activity(events: DataFrame, gap: str = "600 seconds", delay: str = "10 minutes") -> DataFrame:
    """Stretches of activity per session, closed by ten idle minutes."""
    return events.withWatermark("event_time", delay).groupBy(F.session_window("event_time", gap), "session_id").agg(
        F.count(F.lit(1)).alias("events")
    )
