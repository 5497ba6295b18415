"""The queue in front of a store that refuses."""

import pytest

from wattledger.streaming.hold import Hold, HoldFull

LINES = "byte_offset bigint, line string"


class Sink:
    """Takes batches by number, each once, but those tries that it refuses."""

    def __init__(self, *refused):
        self.refused, self.tries, self.taken, self.got = refused, 0, [], []

    def __call__(self, lines, number):
        self.tries += 1
        if self.tries in self.refused:
            raise OSError("disk full")
        if number in self.taken:
            return {"inserted": 0}
        rows = [r.line for r in lines.orderBy("byte_offset", "line").collect()]
        self.taken.append(number)
        self.got += rows
        return {"inserted": len(rows)}


def batch(spark, *names):
    return spark.createDataFrame(list(enumerate(names)), LINES)


def test_refused_batches_are_stored_in_order_and_once(spark, folder):
    sink = Sink(2, 3)
    assert Hold(spark, folder).deliver(batch(spark, "a", "b"), 0, sink) == {"inserted": 2, "waiting": 0, "lost": 0}
    hold = Hold(spark, folder)
    assert hold.deliver(batch(spark, "c"), 1, sink) == {"waiting": 1, "lost": 0}
    assert isinstance(hold.refusal, OSError)
    # A new process finds what waits; the older batch is tried first, and nothing overtakes it.
    assert Hold(spark, folder).deliver(batch(spark, "d", "e"), 2, sink) == {"waiting": 3, "lost": 0} and sink.got == ["a", "b"]
    assert Hold(spark, folder).deliver(batch(spark, "f"), 3, sink) == {"inserted": 4, "waiting": 0, "lost": 0}
    assert sink.got == list("abcdef") and sink.taken == [0, 1, 2, 3]


def test_a_batch_that_comes_again(spark, folder):
    sink = Sink(1, 2)
    for _ in range(2):  # held, and the job died before Spark noted the batch
        assert Hold(spark, folder).deliver(batch(spark, "a", "b"), 0, sink) == {"waiting": 2, "lost": 0}
    assert Hold(spark, folder).deliver(batch(spark, "a", "b"), 0, sink) == {"inserted": 2, "waiting": 0, "lost": 0}
    # Committed, and the job died before the queue forgot it: the store skips its number.
    hold = Hold(spark, folder)
    hold._add(batch(spark, "a", "b"), 0)
    assert hold.deliver(batch(spark), 1, sink) == {"inserted": 0, "waiting": 0, "lost": 0} and sink.got == ["a", "b"]


def test_the_oldest_lines_are_dropped_and_counted(spark, folder):
    sink = Sink(1, 2, 3)
    assert Hold(spark, folder, keep=4).deliver(batch(spark, "a", "b", "c"), 0, sink) == {"waiting": 3, "lost": 0}
    assert Hold(spark, folder, keep=4).deliver(batch(spark, "d", "e"), 1, sink) == {"waiting": 4, "lost": 1}
    assert Hold(spark, folder, keep=4).deliver(batch(spark, *"ghijkl"), 2, sink) == {"waiting": 4, "lost": 7}
    hold = Hold(spark, folder, keep=4)
    hold.drain(LINES, sink)
    assert sink.got == list("ijkl") and hold.state()["waiting"] == [] and hold.state()["lost"] == 7


def test_a_full_hold_may_stop_the_stream(spark, folder):
    sink = Sink(1, 2)
    hold = Hold(spark, folder, keep=2, drop=False)
    hold.deliver(batch(spark, "a", "b"), 0, sink)
    with pytest.raises(HoldFull):
        hold.deliver(batch(spark, "c"), 1, sink)
    assert hold.state()["lost"] == 0
    assert hold.deliver(batch(spark, "c"), 1, sink) == {"inserted": 3, "waiting": 0, "lost": 0} and sink.got == list("abc")


def test_drain_raises_and_keeps_the_rest(spark, folder):
    sink = Sink(1, 2, 4)
    hold = Hold(spark, folder)
    hold.deliver(batch(spark, "a"), 0, sink)
    hold.deliver(batch(spark, "b"), 1, sink)
    with pytest.raises(OSError):
        hold.drain(LINES, sink)
    assert sink.got == ["a"] and [w[0] for w in hold.state()["waiting"]] == [1]


def test_the_resident_ingest_goes_on_while_the_store_refuses(spark, folder):
    import json
    import os

    from wattledger.plans.store import Store
    from wattledger.sources.tail import SpoolTail
    from wattledger.streaming import ingest

    spark.dataSource.register(SpoolTail)
    store, seen, publish = Store(spark, f"{folder}/store"), [], Store._publish
    hold = Hold(spark, f"{folder}/queue")
    os.mkdir(f"{folder}/in")

    def refuse(state):
        raise OSError("read-only")

    for k, refused in enumerate((True, False)):
        store._publish = refuse if refused else publish.__get__(store)
        with open(f"{folder}/in/c.s.jsonl", "a") as f:
            event = {"schema_version": "9", "event_id": f"event-{k:016d}", "ts": "t", "collector": "c", "session_id": "s", "type": "x"}
            f.write(json.dumps(event) + "\n")
        lines = spark.readStream.format("spool_tail").load(f"{folder}/in")
        ingest.start(lines, store, f"{folder}/checkpoint", every=None, on_batch=seen.append, hold=hold).awaitTermination()
    assert [(c["waiting"], c["lost"]) for c in seen] == [(1, 0), (0, 0)]
    assert seen[1]["opaque"] + seen[1]["rejected"] + seen[1]["inserted"] == 2
