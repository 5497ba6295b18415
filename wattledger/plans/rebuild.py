"""Rebuild of derived tables: whole, scoped to sessions, or from stored estimates only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger import schemas as S
from wattledger.operators.estimation import Estimator, calls_of, calls_to_estimate, calls_without_estimate, estimate
from wattledger.operators.impacts import build_joins, join_records
from wattledger.plans.store import Store
from wattledger.session import cut

SAMPLE_TYPES = ("energy_sample", "process_sample")
SAMPLE_WAIT_INTERVALS = 6


@dataclass(frozen=True)
class Settings:
    zone: str = S.DEFAULT_ZONE
    zone_source: str = "default"
    zone_gwp: tuple[float, float] | None = None
    region: str | None = None
    methodology: str | None = None


@dataclass
class Outcome:
    sessions: int = 0
    joins: int = 0
    joins_written: int = 0
    pending: int = 0
    wiped: bool = False
    notes: list[str] = field(default_factory=list)


def in_scope(df: DataFrame, sessions: DataFrame | None) -> DataFrame:
    return df if sessions is None else df.join(sessions.select("session_id").distinct(), "session_id", "left_semi")


def records(facts: DataFrame, estimates: DataFrame, settings: Settings, sessions: DataFrame | None = None) -> DataFrame:
    """Join records of all sessions, or of some, as one plan over sessions."""
    joins = build_joins(
        in_scope(facts, sessions), in_scope(estimates, sessions), settings.zone, settings.zone_source, settings.zone_gwp, settings.region
    )
    return join_records(joins)


def rebuild(
    store: Store, settings: Settings = Settings(), estimator: Estimator | None = None, sessions: DataFrame | None = None,
    wipe: bool = False, force: bool = False,
) -> Outcome:
    """Estimate what is due (when there is an estimator), rebuild the joins and write what changed.

    A wipe without an estimator would lose estimates nobody can make again, so it needs ``force``.
    """
    out = Outcome(wiped=wipe)
    if wipe and estimator is None and not force:
        raise RuntimeError("no estimator: a replay would drop the stored estimates; pass force to do it anyway")
    if wipe:
        store.wipe_derived()
    if settings.zone_gwp is None:
        out.notes.append("no grid factors: local gwp is not reported")
    # Several plans below read the facts of a scope, which are few of the store's.
    facts = store.read("facts") if sessions is None else cut(store.facts_of(sessions))
    calls = calls_of(facts)
    if estimator is None:
        out.notes.append("no estimator: calls without an estimate stay pending")
    else:
        due = calls_to_estimate(calls, store.read("estimates"), settings.methodology)
        fresh = cut(estimate(due, estimator, settings.methodology, settings.region))
        if not fresh.isEmpty():
            store.upsert_estimates(fresh)
    estimates = store.read("estimates")
    built = cut(records(facts, in_scope(estimates, sessions), settings))
    counts = built.agg(
        F.count(F.lit(1)).alias("joins"), F.countDistinct("session_id").alias("sessions")
    ).first()
    out.sessions, out.joins = counts.sessions, counts.joins
    out.joins_written = store.upsert_joins(built)
    out.pending = calls_without_estimate(calls, estimates).count()
    return out


def rebuild_stored(store: Store, settings: Settings = Settings(), sessions: DataFrame | None = None) -> Outcome:
    """Rebuild from stored estimates; the estimator is not called."""
    return rebuild(store, settings, None, sessions)


def batch_kinds(batch: DataFrame) -> DataFrame:
    """Sessions a batch touched, and whether it brought only samples."""
    return batch.groupBy("session_id").agg(F.bool_and(F.col("type").isin(*SAMPLE_TYPES)).alias("samples_only"), F.min("ts_ms").alias("since_ms"))


def due_sessions(touched: DataFrame, rebuilt: DataFrame, now_ms: int, interval_ms: int) -> DataFrame:
    """Sessions to rebuild now: new facts at once, never rebuilt at once, samples alone after six intervals."""
    known = rebuilt.select("session_id", F.lit(True).alias("__known"))
    waited = now_ms - F.col("since_ms") >= SAMPLE_WAIT_INTERVALS * interval_ms
    due = ~F.col("samples_only") | F.col("__known").isNull() | waited
    return touched.join(known, "session_id", "left").where(due).select("session_id")


def zone_scope(touched: DataFrame, every: DataFrame, resolved: str, last_zone: str | None) -> DataFrame:
    """All sessions when the zone changed, else the touched ones."""
    return every.select("session_id").distinct() if resolved != last_zone else touched.select("session_id").distinct()


def sessions_of_estimates(fresh: DataFrame) -> DataFrame:
    """Sessions whose joins new estimates change."""
    return fresh.select("session_id").distinct()
