"""The store over several batches, the resident job's ledger, and keyed state that ends: batch by batch against plain SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger.catalog import query
from wattledger.catalog.impacts import _ALL, joins
from wattledger.catalog.prelude import with_views as V
from wattledger.catalog.store import SETTINGS
from wattledger.catalog.streams import _STATE_STORE, _log, closed, drain, stream_of
from wattledger.operators import estimation as E
from wattledger.operators import impacts as J
from wattledger.operators import validate as X
from wattledger.plans import ledger as L
from wattledger.plans import rebuild as B
from wattledger.plans.store import Store
from wattledger.session import cut, shared_dir
from wattledger.sources import tables as T
from wattledger.streaming import ingest as I
from wattledger.streaming import retire as K
from wattledger.streaming.hold import Hold

#: Small buckets, so that tables of any size have many.
BUCKET_ROWS = 512


def _store(spark: SparkSession, **how) -> Store:
    return Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", **how)


def _digits(rows: str) -> str:
    """SQL for the digits that so many rows are divided by."""
    return f"CASE WHEN {rows} <= 512 THEN 0 WHEN {rows} <= 8192 THEN 1 WHEN {rows} <= 131072 THEN 2 WHEN {rows} <= 2097152 THEN 3 ELSE 4 END"


# ---------------------------------------------------------------- keyed merges

_HUNDREDTH = "CAST(substr(event_id, 5) AS BIGINT) % 100 = 7"


@query("snk3_merged_estimates", V(f"""
SELECT event_id, CASE WHEN {_HUNDREDTH} THEN 'ok' ELSE status END AS status,
  (SELECT count(DISTINCT substr(md5(event_id), 1, (SELECT {_digits('count(*)')} FROM ests))) FROM ests WHERE {_HUNDREDTH}) AS rewritten
FROM ests"""))
def _(spark, sf):
    """All estimates and then one in a hundred again, some ids twice: the rows, and how many buckets the second merge rewrote."""
    store = _store(spark, bucket_rows=BUCKET_ROWS)
    stored = cut(T.estimates(spark, sf))
    store.upsert_estimates(stored)
    again = stored.where(_HUNDREDTH).withColumn("status", F.lit("ok"))
    store.upsert_estimates(again.withColumn("status", F.lit("error")).union(again).coalesce(1))
    return store.read("estimates").select("event_id", "status", F.lit(len(store.rewritten["estimates"])).cast("bigint").alias("rewritten"))


_MOVED = "session_id IN (SELECT session_id FROM calls WHERE k = 10)"


@query("snk4_merged_joins", V(f"""
SELECT unit_key, session_id, true AS filled, (SELECT count(*) FROM units WHERE {_MOVED}) AS changed,
  (SELECT count(DISTINCT substr(md5(unit_key), 1, (SELECT {_digits('count(*)')} FROM units))) FROM units WHERE {_MOVED}) AS rewritten
FROM units""", **{k: _ALL[k] for k in ("units",)}))
def _(spark, sf):
    """Records of which some sessions' are out of date, merged with the current ones: only those are written."""
    store = _store(spark, bucket_rows=BUCKET_ROWS)
    fresh = cut(J.join_records(joins(spark, sf)))
    moved = E.calls_of(T.facts(spark, sf)).where(F.col("usage.output_tokens") == 100).select("session_id").distinct()
    store.upsert_joins(fresh.join(moved.withColumn("moved", F.lit(True)), "session_id", "left").select(
        "unit_key", "session_id", F.when(F.col("moved"), F.lit("{}")).otherwise(F.col("json")).alias("json")
    ))
    changed = store.upsert_joins(fresh)
    return store.read("joins").select(
        "unit_key", "session_id", (F.length("json") > 2).alias("filled"), F.lit(changed).cast("bigint").alias("changed"),
        F.lit(len(store.rewritten["joins"])).cast("bigint").alias("rewritten"),
    )


_FIFTH = "least(4, arrival * 5 // (SELECT max(arrival) + 1 FROM facts))"


@query("snk1_replayed_batch", V(f"""
SELECT event_id, type, arrival, (SELECT count(DISTINCT part) FROM b WHERE part IN (1, 3) AND NOT late) AS opened FROM facts""",
    b=f"SELECT {_FIFTH} AS part, arrival % 97 = 5 AS late FROM facts"))
def _(spark, sf):
    """Five batches, then two of them once more with events that were never stored: each event once, and only the parts
    that hold repeated ids are opened."""
    store = _store(spark)
    facts = cut(T.facts(spark, sf).withColumn("json", F.lit(None).cast("string")))
    most = facts.agg(F.max("arrival") + 1).first()[0] or 1
    part = F.least(F.lit(4), F.expr(f"arrival * 5 div {most}"))
    late = F.col("arrival") % 97 == 5
    for k in range(5):
        store.insert_events(facts.where((part == k) & ~late))
    again = facts.where(part.isin(1, 3) & ~late).withColumn("arrival", F.col("arrival") + 1_000_000_000)
    store.insert_events(again.union(facts.where(late)))
    opened = len({p for p, _ in store.opened["facts"]})
    return store.read("facts").select("event_id", "type", "arrival", F.lit(opened).cast("bigint").alias("opened"))


_EIGHTH = "CAST(substr(session_id, 2) AS BIGINT) % 8"
_ASKED = "CAST(substr(session_id, 2) AS BIGINT) % 24 IN (1, 3)"


@query("src12_facts_of_sessions", V(f"""
SELECT event_id, session_id, type, (SELECT count(DISTINCT substr(md5(session_id), 1, (SELECT {_digits('count(*)')} FROM facts WHERE {_EIGHTH} < 4)))
  FROM facts WHERE {_ASKED}) AS visited FROM facts WHERE {_ASKED}"""))
def _(spark, sf):
    """Facts stored in eight batches of other sessions each, of which every four are merged: some sessions of one merged
    part are read, and no bucket is opened but theirs."""
    store = _store(spark, bucket_rows=BUCKET_ROWS, merge_parts=4)
    facts = cut(T.facts(spark, sf).withColumn("json", F.lit(None).cast("string")))
    for k in range(8):
        store.insert_events(facts.where(f"{_EIGHTH} = {k}"))
    found = store.facts_of(facts.where(_ASKED))
    return found.select("event_id", "session_id", "type", F.lit(len(store.visited)).cast("bigint").alias("visited"))


# ---------------------------------------------------------------- the ledger

_THIRD = "least(2, arrival * 3 // (SELECT max(arrival) + 1 FROM facts))"


def _thirds(facts: DataFrame) -> list[DataFrame]:
    most = facts.agg(F.max("arrival") + 1).first()[0] or 1
    third = F.least(F.lit(2), F.expr(f"arrival * 3 div {most}"))
    return [facts.where(third == k) for k in range(3)]


@query("rb6_ledger_steps", V("""
SELECT 1 AS step, session_id FROM b WHERE NOT samples_only OR session_id NOT IN (SELECT session_id FROM a)
UNION ALL SELECT 2, session_id FROM (
  SELECT session_id FROM b WHERE samples_only AND session_id IN (SELECT session_id FROM a)
  UNION SELECT session_id FROM c WHERE NOT samples_only OR session_id NOT IN (SELECT session_id FROM a UNION SELECT session_id FROM b))
UNION ALL SELECT 3, session_id FROM (SELECT DISTINCT session_id FROM facts)""",
    thirds=f"SELECT session_id, {_THIRD} AS third, bool_and(type IN ('energy_sample','process_sample')) AS samples_only FROM facts GROUP BY 1, 2",
    a="SELECT * FROM thirds WHERE third = 0", b="SELECT * FROM thirds WHERE third = 1", c="SELECT * FROM thirds WHERE third = 2"))
def _(spark, sf):
    """Three batches: never built sessions at once, samples alone after six intervals, all sessions when the zone changes."""
    store = _store(spark, bucket_rows=BUCKET_ROWS)
    first, second, third = _thirds(cut(T.facts(spark, sf)))
    steps = []
    for now, batch in ((0, first), (100, second), (700, third)):
        L.mark_facts(store, batch, now)
        sessions = cut(L.due(store, "FRA", now, 100))
        L.settle(store, sessions, "FRA", now)
        steps.append(sessions)
    steps.append(L.due(store, "WOR", 700, 100))
    return steps[1].select(F.lit(1).alias("step"), "session_id").union(steps[2].select(F.lit(2), "session_id")).union(
        steps[3].select(F.lit(3), "session_id"))


@query("rb8_resident_rebuild", V("""
SELECT u.unit_key, coalesce(n.n, 0) AS llm_calls, coalesce(n.ok, 0) AS ok_estimates, 'FRA' AS zone FROM units u LEFT JOIN (
  SELECT p.unit_key, count(*) AS n, count(*) FILTER (e.status = 'ok') AS ok FROM pairs p LEFT JOIN ests e USING (event_id) GROUP BY 1) n USING (unit_key)""", **_ALL))
def _(spark, sf):
    """Two batches under one zone, then estimates, another zone and a clean stop: the stored joins are those of a full rebuild."""
    store = _store(spark)
    facts = cut(T.facts(spark, sf).withColumn("json", F.lit(None).cast("string")))
    half = facts.agg(F.expr("max(arrival) div 2")).first()[0] or 0
    before = B.Settings("WOR", "default", SETTINGS.zone_gwp, SETTINGS.region)
    for now, batch in ((0, facts.where(F.col("arrival") < half)), (1_000, facts.where(F.col("arrival") >= half))):
        with store.commit("job", now):
            store.insert_events(batch)
            L.mark_facts(store, batch, now)
            if now == 0:
                L.catch_up(store, before, now, 60_000)
    with store.commit():
        store.upsert_estimates(T.estimates(spark, sf))
        L.mark_estimates(store, T.estimates(spark, sf), 2_000)
    I.drain(store, SETTINGS, now_ms=3_000)
    v = F.try_parse_json("json")
    return store.read("joins").select(
        "unit_key", F.coalesce(F.try_variant_get(v, "$.remote_estimated.llm_calls", "bigint"), F.lit(0).cast("bigint")).alias("llm_calls"),
        F.coalesce(F.try_variant_get(v, "$.remote_estimated.estimate_status_counts.ok", "bigint"), F.lit(0).cast("bigint")).alias("ok_estimates"),
        F.try_variant_get(v, "$.zone.id", "string").alias("zone"),
    )


# ---------------------------------------------------------------- a store that refuses


class _Refusing(Store):
    """Refuses some of its commits, counted from the first that is tried."""

    def __init__(self, spark: SparkSession, root: str, refused: range):
        super().__init__(spark, root)
        self.refused, self.tried = refused, 0

    def _publish(self, state: dict) -> None:
        self.tried += 1
        if self.tried - 1 in self.refused:
            raise RuntimeError("refused")
        super()._publish(state)


def _held(spark: SparkSession, sf: str, refused: range, keep=None) -> tuple[Store, dict[str, int]]:
    """Four batches of event lines through a hold, each delivered after the one before; the store and the last counts."""
    base = f"{shared_dir(spark)}/hold-{uuid.uuid4().hex}"
    lines = cut(X.event_lines(T.balanced(T.facts(spark, sf))).select(F.col("value").alias("line"), F.col("arrival").alias("byte_offset")))
    most = lines.agg(F.max("byte_offset") + 1).first()[0] or 1
    store, counts = _Refusing(spark, f"{base}/store", refused), {}
    write, rows = I.writing(store, "job"), lines.count()
    for k in range(4):
        hold = Hold(spark, f"{base}/queue", **({} if keep is None else {"keep": keep(rows)}))
        counts = hold.deliver(lines.where(F.least(F.lit(3), F.expr(f"byte_offset * 4 div {most}")) == k), k, write)
    return store, counts


@query("st8_retry_hold", V("SELECT event_id, arrival, 0 AS waiting, 0 AS lost FROM facts"))
def _(spark, sf):
    """Two commits refused, then taken: every fact is stored once, in the order of its batch."""
    store, counts = _held(spark, sf, range(1, 3), lambda rows: rows)
    return store.read("facts").select("event_id", "arrival", F.lit(counts["waiting"]).alias("waiting"), F.lit(counts["lost"]).alias("lost"))


@query("st8_bounded_hold", V("""
SELECT event_id, (SELECT count(*) FROM early) - (SELECT count(*) // 3 FROM facts) AS lost FROM (
  SELECT event_id FROM late UNION ALL SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY arrival DESC) AS n FROM early) WHERE n <= (SELECT count(*) // 3 FROM facts))""",
    quarters="SELECT event_id, arrival, least(3, arrival * 4 // (SELECT max(arrival) + 1 FROM facts)) AS part FROM facts",
    early="SELECT * FROM quarters WHERE part < 3", late="SELECT * FROM quarters WHERE part = 3"))
def _(spark, sf):
    """Three batches refused, of which the hold keeps the newest third of all lines: what it drops is counted."""
    # The first three deliveries try one commit each: the oldest batch that waits.
    store, counts = _held(spark, sf, range(0, 3), lambda rows: rows // 3)
    return store.read("facts").select("event_id", F.lit(counts["lost"]).cast("bigint").alias("lost"))


# ---------------------------------------------------------------- keyed state that ends


@query("st4_retired_sessions", V("""
SELECT session_id, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS events, max(ts_ms) + 600000 AS retired_ms FROM (
  SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY ts_ms) AS n FROM (
    SELECT session_id, ts_ms, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY session_id ORDER BY ts_ms) < 600000 THEN 0 ELSE 1 END AS opens FROM ev))
GROUP BY session_id, n"""))
def _(spark, sf):
    """Sessions let go by timers after ten silent minutes, with what they brought."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)
    events = _log(spark, sf).select("event_time", "session_id", "ts_ms")
    return drain(K.retire_sessions(stream_of(closed(events))))


#: How many arrivals later an id comes again, and how many ids are remembered of each stream.
_LATER, _REMEMBERED = 2_000, 64


@query("ob14_announced_by_count", V(f"""
SELECT event_type AS stream, event_id, arrival * 2 AS seq FROM ev
UNION ALL SELECT event_type, event_id, (arrival + {_LATER}) * 2 + 1 FROM ev WHERE k % 2 = 0 AND arrival + {_LATER} <= (SELECT max(arrival) FROM ev)"""))
def _(spark, sf):
    """Every id comes twice: soon again, which is not announced, or after more other ids than are remembered, which is."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)
    log = cut(_log(spark, sf).select(F.col("event_type").alias("stream"), "event_id", "arrival", "k"))
    most = log.agg(F.max("arrival")).first()[0] or 0
    at = F.col("arrival")
    again = log.select("stream", "event_id", F.when(F.col("k") % 2 == 0, at + _LATER).otherwise(at + 10).alias("arrival"), "k")
    again = again.where((F.col("k") % 2 != 0) | (at <= most)).select("stream", "event_id", (at * 2 + 1).alias("seq"))
    return drain(K.announce_by_count(stream_of(log.select("stream", "event_id", (at * 2).alias("seq")).union(again)), _REMEMBERED))


@query("vw17_bounded_open_spans", V("""
SELECT session_id, event_id AS span_id, arrival * 2 AS seq, 'closed' AS outcome FROM ev WHERE event_type = 'click' AND k % 2 = 0
UNION ALL SELECT session_id, event_id, arrival * 2, 'evicted' FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY arrival DESC) AS n FROM ev WHERE event_type = 'click' AND k % 2 = 1) WHERE n > 3"""))
def _(spark, sf):
    """Closes that come before their openings win; of spans nobody closes three of a session stay open."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)
    clicks = _log(spark, sf).where("event_type = 'click'").select(
        "session_id", F.col("event_id").alias("span_id"), (F.col("k") % 2 == 0).alias("closes"), "arrival"
    )
    opens = clicks.select("session_id", "span_id", F.lit(False).alias("is_closed"), (F.col("arrival") * 2 + F.col("closes").cast("int")).alias("seq"))
    closes = clicks.where("closes").select("session_id", "span_id", F.lit(True), (F.col("arrival") * 2).alias("seq"))
    return drain(K.open_spans(stream_of(opens.union(closes)), 3))
