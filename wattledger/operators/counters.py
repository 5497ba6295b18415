"""Meter windows and process counters to energy and process samples.

Inputs: ``meter(host_id, window_id, t_start_ms, t_end_ms, cpu_kwh, ram_kwh, gpu_kwh, total_kwh, ok)`` in window
order, ``proc(host_id, window_id, session_id, span_id, pid, cpu_seconds, rss_bytes, alive, is_baseline)`` and
``ops(host_id, ts_ms, session_id, span_id, op)``.  Windows and pids are those of one machine: nothing of one host
meets anything of another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger import schemas as S
from wattledger.functions import kwh_to_joules, lookup
from wattledger.operators.ordered import last_before, next_after

SPAN = ["host_id", "session_id", "span_id"]
WATCH = [*SPAN, "pid"]
WINDOW = ["host_id", "window_id"]


def cpu_deltas(proc: DataFrame) -> DataFrame:
    """CPU milliseconds since the previous reading of each watched pid, never negative.

    The baseline reading of a watch starts the count; without one the first window is zero.  A dead
    pid has no reading.
    """
    seen = F.when(F.col("alive") | F.col("is_baseline"), F.col("cpu_seconds"))
    df = last_before(proc, WATCH, "window_id", seen, "previous")
    gained = F.greatest(F.lit(0.0), F.col("cpu_seconds") - F.coalesce("previous", "cpu_seconds"))
    return df.where(F.col("alive") & ~F.col("is_baseline")).withColumn(
        "cpu_time_delta_ms", F.bround(gained * 1000).cast("bigint")
    ).drop("previous")


def effective_ops(ops: DataFrame, meter: DataFrame) -> DataFrame:
    """Ops with the start of the first window of their host that begins at or after them."""
    marks = ops.select("host_id", "ts_ms", "session_id", "span_id", "op", F.lit(None).cast("bigint").alias("starts")).unionByName(
        meter.select(
            "host_id", (F.col("t_start_ms")).alias("ts_ms"), F.lit(None).cast("string").alias("session_id"),
            F.lit(None).cast("string").alias("span_id"), F.lit(None).cast("string").alias("op"), F.col("t_start_ms").alias("starts"),
        )
    )
    # At one instant ops come before windows, so an op on a window's start takes effect in it.
    ordered = marks.withColumn("at", F.col("ts_ms") * 2 + F.when(F.col("starts").isNotNull(), 1).otherwise(0))
    placed = next_after(ordered, ["host_id"], "at", F.col("starts"), "effective_ms", block=2 * 3_600_000)
    return placed.where("op is not null").select("host_id", "ts_ms", "session_id", "span_id", "op", "effective_ms")


def orphan_tail(deltas: DataFrame, proc: DataFrame, meter: DataFrame, ops: DataFrame, tail_ms: int = S.ORPHAN_TAIL_MS) -> DataFrame:
    """Deltas of watched spans, tagged ``orphan_of`` for a while after their unwatch and then dropped.

    The tail ends early at the first window in which none of the watch's pids is alive.
    """
    unwatch = (
        effective_ops(ops.where("op = 'unwatch'"), meter)
        .where("effective_ms is not null")
        .groupBy(*SPAN).agg(F.min("effective_ms").alias("orphan_since"))
    )
    times = meter.select(*WINDOW, "t_start_ms", "t_end_ms")
    # Only windows inside the tail can end it, so this side is as small as the tails are short.
    dead = (
        proc.where(~F.col("is_baseline")).join(unwatch, SPAN).join(times, WINDOW)
        .where((F.col("t_start_ms") >= F.col("orphan_since")) & (F.col("t_end_ms") - F.col("orphan_since") < tail_ms))
        .groupBy(*SPAN, "window_id").agg(F.bool_or("alive").alias("any_alive"))
        .where("not any_alive")
        .groupBy(*SPAN).agg(F.min("window_id").alias("ended_at"))
    )
    df = deltas.join(times, WINDOW).join(unwatch, SPAN, "left").join(dead, SPAN, "left")
    tail = F.coalesce(F.col("t_start_ms") >= F.col("orphan_since"), F.lit(False))
    expired = F.col("t_end_ms") - F.col("orphan_since") >= tail_ms
    over = F.coalesce(F.col("window_id") >= F.col("ended_at"), F.lit(False))
    return df.withColumn("orphan_of", F.when(tail, F.col("span_id"))).where(~(tail & (expired | over))).drop(
        "orphan_since", "ended_at", "t_start_ms", "t_end_ms"
    )


def session_shares(deltas: DataFrame) -> DataFrame:
    """Share of each session in a window: its CPU over all sessions' CPU, equal parts when there is none."""
    per_session = deltas.groupBy(*WINDOW, "session_id").agg(F.sum("cpu_time_delta_ms").alias("cpu_ms"))
    totals = per_session.groupBy(*WINDOW).agg(F.sum("cpu_ms").alias("total_ms"), F.count(F.lit(1)).alias("sessions"))
    share = F.when(F.col("total_ms") > 0, F.col("cpu_ms") / F.col("total_ms")).otherwise(1.0 / F.col("sessions"))
    return per_session.join(totals, WINDOW).withColumn("share", share)


def meter_method(mode: Column) -> Column:
    return F.coalesce(lookup(mode, S.METER_METHODS), F.lit("other"))


def components(share: Column, cpu_method: Column, has_gpu: Column) -> Column:
    """Joule components of one reading; gpu only when there is one or it used something, total last."""

    def part(name: str, kwh: str, method: Column) -> Column:
        return F.struct(F.lit(name).alias("kind"), F.lit(None).cast("string").alias("label"), (kwh_to_joules(kwh) * share).alias("energy_j"), method.alias("method"))

    gpu = F.when(has_gpu | (F.col("gpu_kwh") > 0), part("gpu", "gpu_kwh", F.when(has_gpu, "nvml").otherwise("other")))
    return F.array_compact(
        F.array(part("cpu", "cpu_kwh", cpu_method), part("dram", "ram_kwh", F.lit("other")), gpu, part("total", "total_kwh", cpu_method))
    )


def energy_samples(meter: DataFrame, deltas: DataFrame, cpu_mode: str = "rapl", has_gpu: bool = False) -> DataFrame:
    """One energy sample per session and good meter window; a failed reading yields none."""
    method = meter_method(F.lit(cpu_mode))
    return session_shares(deltas).join(meter.where("ok"), WINDOW).select(
        *WINDOW, "session_id", "t_start_ms", "t_end_ms", "share", components(F.col("share"), method, F.lit(has_gpu)).alias("components")
    )


def process_samples(meter: DataFrame, deltas: DataFrame, sessions: DataFrame) -> DataFrame:
    """One process sample per watched session and window, whatever the meter did, also when empty.

    ``sessions(host_id, session_id, from_ms, to_ms)`` says when each session was watched on each host.
    """
    from wattledger.operators.intervals import overlap_join

    # The list is one machine's watched pids of one window.
    listed = deltas.groupBy(*WINDOW, "session_id").agg(
        F.array_sort(F.collect_list(F.struct("pid", "cpu_time_delta_ms", "rss_bytes"))).alias("processes")
    )
    watched = overlap_join(
        meter.select(*WINDOW, "t_start_ms", "t_end_ms"), sessions.select("host_id", "session_id", "from_ms", "to_ms"),
        ["host_id"], ("t_start_ms", "t_end_ms"), ("from_ms", "to_ms"),
    )
    empty = F.array().cast("array<struct<pid:bigint,cpu_time_delta_ms:bigint,rss_bytes:bigint>>")
    return watched.join(listed, [*WINDOW, "session_id"], "left").select(
        *WINDOW, "session_id", "t_start_ms", "t_end_ms", F.coalesce("processes", empty).alias("processes")
    )
