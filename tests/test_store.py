"""Tail source, resident ingest, sinks and rebuild, end to end on spool files."""

import json
import os

import pytest

from wattledger.plans import rebuild as B
from wattledger.plans.store import Store
from wattledger.sources import spool
from wattledger.sources.tail import SpoolTail, SpoolTailReader
from wattledger.streaming import ingest


def lines(session):
    base = {"schema_version": "0.1.0", "session_id": session, "collector": {"name": "cc-hooks", "version": "1"}}
    at = lambda s: f"2026-07-25T12:00:{s:02d}Z"
    made = [
        ("session_meta", 0, {"agent_app": {"name": "a"}, "geo_zone": "FRA"}, {}),
        ("action_span", 0, {"span_id": "boot", "tool_name": "__session__", "tool_kind": "other", "execution_locus": "local", "t_start": at(0), "t_end": at(0), "pids": [10]}, {}),
        ("action_span", 9, {"span_id": "s1", "tool_name": "Bash", "tool_kind": "bash", "execution_locus": "local", "t_start": at(0), "t_end": at(10)}, {"task_id": "t", "tool_call_id": "c"}),
        ("energy_sample", 10, {"t_start": at(0), "t_end": at(10), "components": [{"kind": "cpu", "energy_j": 100, "method": "rapl"}]}, {}),
        ("process_sample", 10, {"t_start": at(0), "t_end": at(10), "processes": [{"pid": 10, "cpu_time_delta_ms": 5000}]}, {}),
        ("llm_call", 11, {"provider": "p", "model_id_requested": "m", "usage": {"output_tokens": 5}, "usage_source": "api_response"}, {"task_id": "t"}),
    ]
    out = []
    for i, (kind, second, payload, attribution) in enumerate(made):
        doc = {**base, "event_id": f"{session}-event-{i:06d}", "ts": at(second), "type": kind, "payload": payload}
        out.append(json.dumps({**doc, "attribution": attribution} if attribution else doc))
    return out


@pytest.fixture(scope="module")
def ingested(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("ingest")
    spool_dir, store_dir = root / "spool", str(root / "store")
    spool_dir.mkdir()
    spark.dataSource.register(SpoolTail)
    store = Store(spark, store_dir)
    settings = B.Settings("FRA", "flag", (0.05, 0.06))
    path = spool_dir / "cc-hooks.s.1.jsonl"

    def drain():
        counts = []
        stream = spark.readStream.format("spool_tail").load(str(spool_dir))
        query = ingest.start(stream, store, str(root / "checkpoint"), settings, every=None, on_batch=counts.append)
        query.awaitTermination()
        return counts

    all_lines = lines("s.1")
    path.write_text("\n".join(all_lines[:3]) + "\nnot json\n\n" + all_lines[3][:20])
    (spool_dir / "notes.txt").write_text("ignored\n")
    first = drain()
    with path.open("a") as f:
        f.write(all_lines[3][20:] + "\n" + "\n".join(all_lines[4:]) + "\n" + all_lines[0] + "\n")
    second = drain()
    return store, settings, first, second, str(spool_dir), drain


def test_appended_lines_arrive_once(ingested):
    store, _, first, second, _, drain = ingested
    assert [c["inserted"] for c in first] == [3]
    assert [c["inserted"] for c in second] == [3]
    assert store.read("facts").count() == 6
    assert [r.origin for r in store.read("rejects").collect()] == ["cc-hooks:s.1"]
    assert drain() == [] or store.read("facts").count() == 6


def test_rebuild_writes_only_changes(ingested):
    store, settings, *_ = ingested
    keys = [r.unit_key for r in store.read("joins").orderBy("unit_key").collect()]
    assert keys == ["session:s.1", "task:s.1:t", "tool_call:s.1:s1"]
    again = B.rebuild_stored(store, settings)
    assert (again.joins, again.joins_written, again.pending) == (3, 0, 1)
    doc = json.loads(store.read("joins").where("unit_key = 'session:s.1'").first().json)
    assert doc["local_measured"]["breakdown_j"] == {"attributed": 50.0, "baseline_idle": 50.0, "orphaned": 0.0, "total": 100.0}
    assert doc["remote_estimated"] == {"estimate_status_counts": {"pending": 1}, "llm_calls": 1}
    assert doc["combined_total"] == {} and doc["attribution_policy"] == "l2_cpu_time"


def test_replay_needs_an_estimator(spark, ingested):
    store, settings, *_ = ingested
    with pytest.raises(RuntimeError):
        B.rebuild(store, settings, wipe=True)

    def estimator(reqs):
        asked = reqs.select("provider", "model", "output_tokens", "region").distinct()
        return asked.selectExpr(
            "*", "'ok' AS status", "array(named_struct('criterion', 'energy', 'unit', 'kWh', 'min', 1.0D, 'max', 2.0D)) AS impacts",
            "'v1' AS response_methodology", "CAST(NULL AS STRING) AS response_region",
        )

    out = B.rebuild(store, settings, estimator, wipe=True)
    assert (out.joins_written, out.pending, out.wiped) == (3, 0, True)
    assert B.rebuild(store, settings, estimator).joins_written == 0
    doc = json.loads(store.read("joins").where("unit_key = 'task:s.1:t'").first().json)
    assert doc["combined_total"]["energy"]["total"]["max"] == pytest.approx(2.0 + 50 / 3.6e6)


def test_batch_scan(spark, ingested):
    spool_dir = ingested[4]
    got = spool.scan(spark, spool_dir)
    assert {(r.collector_file, r.session_file) for r in got.collect()} == {("cc-hooks", "s.1")}
    assert spool.scan(spark, spool_dir + "/missing").count() == 0


def read_all(folder, start, max_read):
    reader = SpoolTailReader(folder, max_read, numbered=True)
    end = reader.latestOffset()
    return [row for piece in reader.partitions(start, end) for row in reader.read(piece)], end


@pytest.mark.parametrize("max_read", [7, 16, 1000])
def test_pieces_give_every_line_once(folder, max_read):
    text = ["a", "bb", "", "cccc", "d" * 6, "é", "x"]
    with open(os.path.join(folder, "c.s.jsonl"), "w") as f:
        f.write("\n".join(text) + "\npartial")
    rows, end = read_all(folder, {}, max_read)
    assert [(r[5], r[6]) for r in rows] == [(i + 1, t) for i, t in enumerate(text) if t]
    assert read_all(folder, end, max_read)[0] == []
    with open(os.path.join(folder, "c.s.jsonl"), "a") as f:
        f.write(" done\n")
    rows, _ = read_all(folder, end, max_read)
    assert [(r[5], r[7]) for r in rows] == [(8, len("partial done") > max_read)]


@pytest.mark.parametrize("max_read", [7, 16, 1000])
def test_lines_are_numbered_from_pieces(spark, folder, max_read):
    from wattledger.sources.tail import number_lines

    def batch(start):
        reader = SpoolTailReader(folder, max_read, pieces=True)
        end = reader.latestOffset()
        rows = [row for piece in reader.partitions(start, end) for row in reader.read(piece)]
        return spark.createDataFrame(rows, SpoolTail({}).schema()), end

    first = ["a", "bb", "", "", "cccc", "d" * 30, "é"]
    for name in ("c.s.jsonl", "c.t.jsonl"):
        with open(os.path.join(folder, name), "w") as f:
            f.write("\n".join(first) + "\n")
    known = spark.createDataFrame([], "file_name string, lines bigint")
    lines, known = number_lines(batch({})[0], known)
    end = batch({})[1]
    want = [(i + 1, t[:7]) for i, t in enumerate(first) if t]
    got = sorted((r.file_name, r.line_number, r.line[:7]) for r in lines.collect())
    assert [g[1:] for g in got if g[0] == "c.s.jsonl"] == want and len(got) == 2 * len(want)
    assert {(r.file_name, r.lines) for r in known.collect()} == {("c.s.jsonl", 7), ("c.t.jsonl", 7)}
    with open(os.path.join(folder, "c.s.jsonl"), "a") as f:
        f.write("\nmore\nlast\n")
    with open(os.path.join(folder, "c.t.jsonl"), "w") as f:
        f.write("new\n")  # begins again
    lines, counts = number_lines(batch(end)[0], known)
    assert sorted((r.file_name, r.line_number, r.line) for r in lines.collect()) == [("c.s.jsonl", 9, "more"), ("c.s.jsonl", 10, "last"), ("c.t.jsonl", 1, "new")]
    assert {(r.file_name, r.lines) for r in counts.collect()} == {("c.s.jsonl", 10), ("c.t.jsonl", 1)}


def test_spool_files_are_whole(spark, folder):
    rows = [(f"c.s{k % 3}.jsonl", f"line {k}", k) for k in range(50)] + [(None, "x", 0), ("c.s0.jsonl", None, 1)]
    df = spark.createDataFrame(rows, "file_name string, line string, arrival int").repartition(5)
    for _ in range(2):  # written again: the same files
        assert spool.write_spool(df, folder) == 3
    assert sorted(os.listdir(folder)) == ["c.s0.jsonl", "c.s1.jsonl", "c.s2.jsonl"]
    with open(os.path.join(folder, "c.s1.jsonl")) as f:
        assert f.read() == "".join(f"line {k}\n" for k in range(1, 50, 3))


def test_long_lines_and_truncation(folder):
    path = os.path.join(folder, "c.s.jsonl")
    with open(path, "w") as f:
        f.write("ok\n" + "z" * 50 + "\nlast\n")
    rows, end = read_all(folder, {}, 20)
    assert [(r[5], r[6][:3], r[7]) for r in rows] == [(1, "ok", False), (2, "zzz", True), (3, "las", False)]
    with open(path, "w") as f:
        f.write("new\n")
    rows, _ = read_all(folder, end, 20)
    assert [(r[6], r[8]) for r in rows] == [("new", True)]


def test_limited_batches_take_whole_lines(folder):
    with open(os.path.join(folder, "c.s.jsonl"), "w") as f:
        f.write("".join(f"line-{i}\n" for i in range(40)) + "z" * 100 + "\nend\n")
    reader = SpoolTailReader(folder, 1000, limit=30)
    start, got, steps = reader.initialOffset(), [], 0
    while (end := reader.latestOffset()) != start:
        got += [row for piece in reader.partitions(start, end) for row in reader.read(piece)]
        start, steps = end, steps + 1
    assert [r[6] for r in got] == [f"line-{i}" for i in range(40)] + ["z" * 100, "end"] and steps > 10


def tail_of(folder, **how):
    """A reader with a clock that is set by hand, and a way to append to its files."""
    reader = SpoolTailReader(folder, 1 << 20, **how)
    now = [0.0]
    reader.clock = lambda: now[0]
    reader.initialOffset()

    def add(name, lines, rest=""):
        with open(f"{folder}/{name}.jsonl", "a") as f:
            f.write("x\n" * lines + rest)

    return reader, now, add


def test_lines_gather_until_a_flush(folder):
    reader, now, add = tail_of(folder, flush_rows=10, flush_seconds=60)
    add("c.a", 1)
    first = reader.latestOffset()
    assert first == {"c.a.jsonl": 2}  # the first batch does not wait
    add("c.a", 8, "half")
    assert reader.latestOffset() == first and reader.latestOffset() == first
    add("c.a", 1)  # ends the half line: nine lines
    assert reader.latestOffset() == first
    add("c.a", 1)
    tenth = reader.latestOffset()
    assert tenth == {"c.a.jsonl": 26}
    add("c.a", 1)
    assert reader.latestOffset() == tenth
    now[0] = 59
    assert reader.latestOffset() == tenth
    now[0] = 60
    assert reader.latestOffset() == {"c.a.jsonl": 28}
    now[0] = 500  # nothing new is no batch
    assert reader.latestOffset() == {"c.a.jsonl": 28}
    now[0] = 60
    add("c.a", 1)
    add("c.b", 0, "no line yet")
    assert reader.latestOffset() == {"c.a.jsonl": 28}  # a file without a whole line is not new
    add("c.c", 1)  # a new file brings everything along
    assert reader.latestOffset() == {"c.a.jsonl": 30, "c.b.jsonl": 0, "c.c.jsonl": 2}
    add("c.b", 1)  # its first whole line
    assert reader.latestOffset()["c.b.jsonl"] == len("no line yet") + 2


def test_each_waiting_byte_is_counted_once(folder, monkeypatch):
    reader, now, add = tail_of(folder, flush_rows=1_000)
    for name in ("c.a", "c.b"):
        add(name, 1)
    reader.latestOffset()
    for k in range(1, 10):
        add("c.a", 60)
        add("c.b", 50)
        reader.latestOffset()
        assert reader.gathered == {"c.a.jsonl": (2 + 120 * k, 60 * k), "c.b.jsonl": (2 + 100 * k, 50 * k)}
    add("c.b", 10)
    assert reader.latestOffset() == {"c.a.jsonl": 2 + 120 * 9, "c.b.jsonl": 2 + 100 * 9 + 20} and reader.gathered == {}


def test_what_a_limit_keeps_back_does_not_wait(folder):
    reader, now, add = tail_of(folder, flush_rows=10, limit=10)
    add("c.a", 12)
    ends = []
    for _ in range(4):
        ends.append(reader.latestOffset()["c.a.jsonl"])
    assert ends == [10, 20, 24, 24]


def test_oversized_lines_are_rejects_of_their_own(spark, folder):
    from wattledger.operators import validate as X

    with open(os.path.join(folder, "c.s.jsonl"), "w") as f:
        f.write("z" * 5000 + "\n")
    rows, _ = read_all(folder, {}, 1000)
    lines = spark.createDataFrame(rows, SpoolTail({}).schema()).withColumnRenamed("byte_offset", "arrival")
    got = X.reject_rows(X.classify(lines)).collect()
    assert [(r.reason_kind, r.bytes) for r in got] == [("oversized", 5000)]


REJECT = "id long, source string, origin string, reason_kind string, reason string, attribute_keys array<string>, bytes long, digest string"


def test_rejects_are_all_kept(spark, folder):
    from wattledger.plans import reads

    store = Store(spark, folder)

    def batch(origin, ids, digest="a"):
        return spark.createDataFrame([(i, "spool", origin, "json", "r", [], 1, digest) for i in ids], REJECT)

    assert store.insert_rejects(batch("o", range(2000)), 1_000) == 2000
    assert store.insert_rejects(batch("p", range(10)), 2_000) == 10
    assert store.insert_rejects(batch("p", range(10)), 3_000) == 0  # the same lines again
    assert store.insert_rejects(batch("p", [3], "b"), 4_000) == 1  # another line at that place
    newest = reads.recent_rejects(store.read("rejects"), 11).collect()
    assert [(r.origin, r.id) for r in newest] == [("p", 3)] + [("p", i) for i in range(9, -1, -1)]
    assert newest[0].ts.startswith("1970-01-01T00:00:04") and store.read("rejects").count() == 2011


def test_one_commit_for_all_tables(spark, folder):
    store, other = Store(spark, folder), Store(spark, folder)
    joins = spark.createDataFrame([("u", "s", "{}")], "unit_key string, session_id string, json string")
    with store.commit("w", 0) as fresh:
        assert fresh
        store.append("joins", joins)
        store.replace("joins", joins.withColumnRenamed("unit_key", "unit_key"))
        assert other.read("joins").count() == 0  # not before the commit
    assert other.read("joins").count() == 1
    with store.commit("w", 0) as fresh:
        assert not fresh  # delivered again
    with pytest.raises(RuntimeError, match="another writer"):
        with store.commit():
            store.append("joins", joins)
            other.append("joins", joins)
    assert store.read("joins").count() == 2
    with pytest.raises(ZeroDivisionError):
        with store.commit():
            store.append("joins", joins)
            raise ZeroDivisionError
    assert store.read("joins").count() == 2


def test_small_parts_are_merged(spark, folder, monkeypatch):
    from wattledger.plans import store as module

    monkeypatch.setattr(module, "MERGE", 3)
    store = Store(spark, folder)
    for i in range(9):
        store.append("joins", spark.createDataFrame([(str(i), "s", "{}")], "unit_key string, session_id string, json string"))
    assert store._parts("joins")[0].startswith("level2-") and len(store._parts("joins")) == 1
    store.vacuum(1)
    assert sorted(r.unit_key for r in store.read("joins").collect()) == [str(i) for i in range(9)]
    assert len([n for n in os.listdir(f"{folder}/joins") if n.startswith("level")]) == 1


def test_last_estimate_of_a_batch_stays(spark, folder):
    store = Store(spark, folder)
    empty = store.read("estimates")
    rows = spark.createDataFrame([("e", "s", "error"), ("e", "s", "ok"), ("f", "s", "ok")], "event_id string, session_id string, status string").coalesce(1)
    for c in empty.columns[3:]:
        rows = rows.selectExpr("*", f"CAST(NULL AS {empty.schema[c].dataType.simpleString()}) AS {c}")
    store.upsert_estimates(rows)
    assert sorted((r.event_id, r.status) for r in store.read("estimates").collect()) == [("e", "ok"), ("f", "ok")]
