"""The store over many batches, the ledger across restarts, and keyed state that ends."""

import os
import random

import pytest
from pyspark.sql import functions as F

from wattledger.plans import ledger as L
from wattledger.plans import store as P
from wattledger.plans.store import Store
from wattledger.streaming import retire as K

JOINS = "unit_key string, session_id string, json string"
OPAQUE = "schema_version string, event_id string, ts string, collector string, session_id string, type string, arrival bigint, json string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def joined(spark, rows):
    return spark.createDataFrame([(k, "s", v) for k, v in rows], JOINS)


def held(store):
    return {r.unit_key: r.json for r in store.read("joins").collect()}


def test_merges_rewrite_only_what_they_touch(spark, folder):
    store, rng, want = Store(spark, folder, bucket_rows=4), random.Random(1), {}
    for size in (3, 60, 2, 40, 1):
        rows = {f"key-{rng.randrange(120)}": str(rng.random()) for _ in range(size)}
        before = dict(store._buckets("joins"))
        touched = store.merge("joins", joined(spark, rows.items()))
        want |= rows
        assert held(store) == want
        after = store._buckets("joins")
        # Buckets that no key fell into are the same folders as before.
        assert {b: v for b, v in before.items() if b not in touched} == {b: v for b, v in after.items() if b in before and b not in touched}
        assert sum(v["rows"] for v in after.values()) == len(want)
        assert not any(a != b and b.startswith(a) for a in after for b in after)
    assert len(after) > 16 and max(v["rows"] for v in after.values()) <= 16
    assert store.merge("joins", joined(spark, [])) == [] and held(store) == want
    # Only one bucket for one key, and a null key is a key.
    assert len(store.merge("joins", joined(spark, [("key-1", "new")]))) == 1
    other = Store(spark, folder, bucket_rows=4)
    assert held(other)["key-1"] == "new"
    store.vacuum(1)
    assert held(other) == want | {"key-1": "new"}
    folders = {d for _, v in other._buckets("joins").items() if v["path"] for d in [v["path"].split("/")[0]]}
    assert {n for n in os.listdir(f"{folder}/joins")} == folders


def test_a_table_written_as_a_whole_goes_into_buckets(spark, folder):
    store = Store(spark, folder, bucket_rows=4)
    store.replace("joins", joined(spark, [(f"k{i}", "old") for i in range(20)]))
    store.merge("joins", joined(spark, [("k3", "new"), ("x", "new")]))
    assert held(store) == {f"k{i}": "old" for i in range(20)} | {"k3": "new", "x": "new"} and not store._parts("joins")
    changed = store.upsert_joins(joined(spark, [("k3", "new"), ("k4", "newer")]))
    assert changed == 1 and len(store.rewritten["joins"]) == 1 and held(store)["k4"] == "newer"
    store.wipe_derived()
    assert held(store) == {}


def events(spark, ids, arrival=0):
    return spark.createDataFrame([("0", i, "t", "c", "s", "x", arrival + k, "{}") for k, i in enumerate(ids)], OPAQUE)


@pytest.mark.parametrize("filter_rows", [1_000_000, 10])
def test_filters_name_the_parts_to_open(spark, folder, filter_rows, monkeypatch):
    monkeypatch.setattr(P, "TOGETHER", 7)
    store, rng = Store(spark, folder, filter_rows=filter_rows), random.Random(2)
    batches = [[f"{rng.getrandbits(64):016x}" for _ in range(100)] for _ in range(4)]
    for ids in batches:
        assert store.insert_opaque(events(spark, ids)) == 100
    parts = store._parts("opaque")
    assert store.insert_opaque(events(spark, [f"new-{i}" for i in range(50)])) == 50 and store.opened["opaque"] == []
    assert store.insert_opaque(events(spark, [*batches[1][:3], "fresh", "fresh", *batches[3][:2]], 99)) == 1
    assert {p for p, _ in store.opened["opaque"]} == {parts[1], parts[3]}
    if filter_rows == 10:  # several buckets of a part, of which few are opened
        assert len(store.opened["opaque"]) <= 5
    assert store.read("opaque").count() == 451 == store.read("opaque").select("event_id").distinct().count()
    store.vacuum(1)
    assert store.insert_opaque(events(spark, batches[0])) == 0
    # A part without filters is read whole.
    with store.commit():
        store._state()["tables"]["opaque"].append(store._write("opaque", events(spark, ["bare"]))[0])
    assert store.insert_opaque(events(spark, ["bare", "other"])) == 1


def test_merged_parts_keep_their_filters(spark, folder, monkeypatch):
    monkeypatch.setattr(P, "MERGE", 3)
    store = Store(spark, folder)
    for k in range(7):
        store.insert_opaque(events(spark, [f"id-{k}-{i}" for i in range(5)]))
    assert len(store._parts("opaque")) == 3
    assert store.insert_opaque(events(spark, ["id-0-0", "id-6-4", "id-9-9"])) == 1
    assert len({p for p, _ in store.opened["opaque"]}) == 2
    store.vacuum(1)
    assert sorted(os.listdir(f"{folder}/opaque")) == sorted(os.listdir(f"{folder}/opaque.filters")) == sorted(store._parts("opaque"))


def facts(spark, rows):
    """Facts of (event, session, time)."""
    known = {"event_id", "session_id", "ts_ms", "arrival"}
    empty = spark.createDataFrame([], Store.TABLES["facts"])
    given = spark.createDataFrame([(e, s, t, k) for k, (e, s, t) in enumerate(rows)], "event_id string, session_id string, ts_ms bigint, arrival bigint")
    return given.select(*[F.col(f.name) if f.name in known else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema.fields])


def asked(spark, store, *sessions):
    found = store.facts_of(spark.createDataFrame([(s,) for s in sessions], "session_id string"))
    return sorted(r.event_id for r in found.collect())


def test_facts_of_sessions_come_from_their_buckets(spark, folder):
    store, rng, every = Store(spark, folder, bucket_rows=8, merge_parts=3), random.Random(3), []
    assert asked(spark, store, "s1") == []
    for k in range(7):
        # One session has a third of all, and each batch some sessions of its own.
        rows = [(f"e{k}-{i}", rng.choice(("hot", f"s{k}-{i % 9}", f"s{k}-{i % 9}")), rng.randrange(1000)) for i in range(60)]
        assert store.insert_events(facts(spark, rows)) == 60
        every += rows
    assert [p.split("-")[0] for p in store._parts("facts")] == ["level1", "level1", "level0"]
    assert sorted(r.event_id for r in store.read("facts").collect()) == sorted(e for e, *_ in every)
    for wanted in (("hot",), ("s0-1",), ("s4-2", "s6-3", "hot", "hot", None), ("nobody",), ()):
        assert asked(spark, store, *wanted) == sorted(e for e, s, _ in every if s in wanted and s is not None)
    assert asked(spark, store, "s4-2", "s6-3") and len(store.visited) == 2
    assert {p.split("-")[0] for p, _ in store.visited} == {"level1", "level0"}
    asked(spark, store, "hot")
    assert len(store.visited) == 3
    # Ids of merged parts are known as before, and cleaning leaves what is in use.
    store.vacuum(1)
    assert sorted(os.listdir(f"{folder}/facts.sessions")) == sorted(os.listdir(f"{folder}/facts")) == sorted(store._parts("facts"))
    assert store.insert_events(facts(spark, every[:5] + [("new", "s0-1", 5)])) == 1
    assert "new" in asked(spark, store, "s0-1")


def test_parts_without_session_filters_are_read_whole(spark, folder):
    store = Store(spark, folder)
    with store.commit():
        store._state()["tables"]["facts"] = [store._write("facts", facts(spark, [("a", "s", 1), ("b", "t", 2), ("c", None, 3)]))[0]]
    store.insert_events(facts(spark, [("d", "t", 4), ("e", None, 5)]))
    assert asked(spark, store, "t") == ["b", "d"] and store.read("facts").count() == 5


def marked(spark, store, rows, now):
    L.mark(store, spark.createDataFrame(rows, "session_id string, samples_only boolean"), now)


def names(df):
    return sorted(r.session_id for r in df.collect())


def test_ledger_outlives_the_job(spark, folder):
    store = Store(spark, folder)
    marked(spark, store, [("a", True), ("b", False)], 1_000)
    assert names(L.due(store, "FRA", 1_000, 60)) == ["a", "b"]  # never built
    L.settle(store, L.due(store, "FRA", 1_000, 60), "FRA", 1_000)
    assert names(L.due(store, "FRA", 9_000, 60)) == []
    marked(spark, store, [("a", True), ("a", True)], 2_000)
    again = Store(spark, folder)  # after a restart
    assert names(L.due(again, "FRA", 2_359, 60)) == [] and names(L.due(again, "FRA", 2_360, 60)) == ["a"]
    marked(spark, again, [("a", True)], 2_300)  # does not wait anew
    assert names(L.due(again, "FRA", 2_360, 60)) == ["a"]
    marked(spark, again, [("a", False)], 2_301)
    assert names(L.due(again, "FRA", 2_301, 60)) == ["a"]
    assert names(L.due(again, "WOR", 2_301, 60)) == ["a", "b"]  # another zone
    estimates = spark.createDataFrame([("b",)], "session_id string")
    L.mark_estimates(again, estimates, 3_000)
    assert names(L.due(again, "FRA", 3_000, 60)) == ["a", "b"]
    marked(spark, again, [], 4_000)
    # A commit that fails changes nothing.
    with pytest.raises(ZeroDivisionError):
        with again.commit("job", 1):
            L.settle(again, L.due(again, "FRA", 3_000, 60), "FRA", 3_000)
            raise ZeroDivisionError
    assert names(L.due(again, "FRA", 3_000, 60)) == ["a", "b"]


def streamed(spark, folder, rows, schema, make, name):
    """Run a stream over batches of rows, one file and one drain each; all output and the state rows at the end."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    state = None
    for k, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{folder}/{name}-in/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/{name}-in")
        query = make(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/{name}-cp").option(
            "path", f"{folder}/{name}-out").trigger(availableNow=True).start()
        query.awaitTermination()
        progress = [p for p in query.recentProgress if p["stateOperators"]]
        state = progress[-1]["stateOperators"][0]["numRowsTotal"] if progress else state
    return [tuple(r) for r in spark.read.parquet(f"{folder}/{name}-out").collect()], state


def test_silent_sessions_leave_the_state(spark, folder):
    minute = 60_000
    batches = [
        [("a", 1), ("a", 5 * minute), ("b", 1 * minute), ("c", 1 * minute), ("c", 30 * minute)],
        [("a", 8 * minute), ("d", 40 * minute)],
        [(None, 100 * minute)],
        [("a", 101 * minute), ("e", 100 * minute)],
    ]
    rows = [[(s, ms) for s, ms in b] for b in batches]

    def make(stream):
        return K.retire_sessions(stream.withColumn("event_time", F.timestamp_millis("ts_ms")), delay="0 seconds")

    got, state = streamed(spark, folder, rows, "session_id string, ts_ms bigint", make, "retire")
    # The event of session a at minute 8 comes after the watermark has passed its retirement: it is late.
    assert sorted(r[:4] for r in got) == [
        ("a", 1, 5 * minute, 2), ("b", minute, minute, 1), ("c", minute, minute, 1), ("c", 30 * minute, 30 * minute, 1), ("d", 40 * minute, 40 * minute, 1),
    ]
    assert all(r[4] == r[2] + 600_000 for r in got)
    assert state is not None and state <= 2 * 4  # the two open sessions and their timers


def test_announced_ids_in_order(spark, folder):
    ids = ["a", "b", "a", "c", "d", "a", "b", "d", "e", "a"]
    rows = [("s", i, k) for k, i in enumerate(ids)]
    want, fifo = [], []
    for _, i, k in rows:
        if i not in fifo:
            want.append((i, k))
            fifo = [*fifo, i][-3:]
    got, _ = streamed(spark, folder, [rows[:4], rows[4:7], rows[7:]], "stream string, event_id string, seq bigint", lambda s: K.announce_by_count(s, 3), "ann")
    assert sorted(r[1:] for r in got) == sorted(want)


def test_open_spans_are_bounded(spark, folder):
    updates = [("s", "a", False, 0), ("s", "b", False, 1), ("s", "a", True, 2), ("s", "a", False, 3), ("s", "c", False, 4), ("s", "b", False, 5),
               ("s", "d", False, 6), ("t", "b", False, 7)]
    got, _ = streamed(spark, folder, [updates[:3], updates[3:]], "session_id string, span_id string, is_closed boolean, seq bigint",
                      lambda s: K.open_spans(s, 2), "spans")
    assert sorted(got) == [("s", "a", 2, "closed"), ("s", "b", 5, "evicted")]
