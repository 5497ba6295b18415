"""Which sessions the resident job still has to rebuild, kept in the store.

A row per session: whether it is dirty, since when, whether only samples came in since then, and the zone its joins were
last built with.  The ledger is a keyed table of the store and changes in the commit that changes the facts or the
joins, so a job that is killed finds after its restart what it still owes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.operators.estimation import Estimator
from wattledger.plans.rebuild import Outcome, Settings, batch_kinds, due_sessions, rebuild, sessions_of_estimates
from wattledger.plans.store import Store
from wattledger.session import cut


def mark(store: Store, touched: DataFrame, now_ms: int) -> None:
    """Note sessions (session_id, samples_only) as dirty from now on; those that are dirty stay so since they became it."""
    touched = cut(touched.groupBy("session_id").agg(F.bool_and("samples_only").alias("fresh")))
    if touched.isEmpty():
        return
    old = store.stored_near("dirty", touched).select(
        "session_id", "since_ms", "samples_only", "zone", F.col("dirty").alias("was"),
    )
    was = F.coalesce("was", F.lit(False))
    rows = touched.join(old, "session_id", "left").select(
        "session_id",
        F.when(was, F.col("since_ms")).otherwise(F.lit(now_ms)).cast("bigint").alias("since_ms"),
        F.when(was, F.col("samples_only") & F.col("fresh")).otherwise(F.col("fresh")).alias("samples_only"),
        "zone", F.lit(True).alias("dirty"),
    )
    store.merge("dirty", rows)


def mark_facts(store: Store, facts: DataFrame, now_ms: int) -> None:
    """Sessions of new facts."""
    mark(store, batch_kinds(facts), now_ms)


def mark_estimates(store: Store, fresh: DataFrame, now_ms: int) -> None:
    """Sessions whose joins new estimates change; they do not wait as samples do."""
    mark(store, sessions_of_estimates(fresh).withColumn("samples_only", F.lit(False)), now_ms)


def due(store: Store, zone: str, now_ms: int, interval_ms: int) -> DataFrame:
    """Sessions to rebuild now: dirty ones by ``due_sessions``, and all that were built with another zone."""
    rows = store.read("dirty")
    built = rows.where("zone is not null")
    waiting = due_sessions(rows.where("dirty"), built, now_ms, interval_ms)
    return waiting.union(built.where(F.col("zone") != zone).select("session_id")).distinct()


def settle(store: Store, sessions: DataFrame, zone: str, now_ms: int) -> None:
    """Note sessions as rebuilt with a zone."""
    store.merge("dirty", sessions.select(
        "session_id", F.lit(now_ms).cast("bigint").alias("since_ms"), F.lit(False).alias("samples_only"), F.lit(zone).alias("zone"),
        F.lit(False).alias("dirty"),
    ))


def catch_up(store: Store, settings: Settings, now_ms: int, interval_ms: int, estimator: Estimator | None = None,
             everything: bool = False) -> Outcome:
    """Rebuild what is due, or all that is dirty, and empty the ledger of it; one commit, or part of the open one."""
    with store.commit():
        # Samples that have to wait for no time are due at once.
        sessions = cut(due(store, settings.zone, now_ms, 0 if everything else interval_ms))
        if sessions.isEmpty():
            return Outcome()
        out = rebuild(store, settings, estimator, sessions)
        settle(store, sessions, settings.zone, now_ms)
        return out
