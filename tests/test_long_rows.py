"""Lines are parsed once, and pairing asks its state once a batch."""

import types

from pyspark.sql import functions as F

from wattledger.operators import validate as X
from wattledger.sources import tables as T
from wattledger.streaming.stateful import HookPairing

SF = "/root/testdata/sf0.001"


def test_lines_are_those_of_two_parses(spark):
    facts = T.facts(spark, SF)
    payload = F.coalesce(*[F.to_json(F.col(n)) for n in X.S.PAYLOADS])
    doc = F.struct("schema_version", "event_id", "ts", "collector", "session_id", "attribution", "type", F.try_parse_json(payload).alias("payload"))
    old = facts.select("event_id", X.canonical_json(F.to_json(doc)).alias("value"))
    new = X.event_lines(facts).select("event_id", "value")
    assert old.exceptAll(new).isEmpty() and new.exceptAll(old).isEmpty()
    plan = X.event_lines(facts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("VariantExpressionEvalUtils.parseJson") == 1


class Opened:
    """A map state that counts the calls out of the worker."""

    def __init__(self):
        self.kept, self.calls = {}, 0

    def _counted(name):
        def call(self, *args):
            self.calls += 1
            return {"iterator": lambda: iter(list(self.kept.items())), "updateValue": lambda k, v: self.kept.__setitem__(k, v),
                    "removeKey": lambda k: self.kept.pop(k, None), "getValue": lambda k: self.kept.get(k),
                    "containsKey": lambda k: k in self.kept, "clear": lambda: self.kept.clear()}[name](*args)
        return call

    iterator, updateValue, removeKey, getValue, containsKey, clear = map(
        _counted, ("iterator", "updateValue", "removeKey", "getValue", "containsKey", "clear"))


def test_pairing_asks_the_state_once_a_batch():
    import pandas as pd

    pairing, state = HookPairing(), Opened()
    pairing.init(types.SimpleNamespace(getMapState=lambda *_: state))
    names = ["arrival", "event", "tool_use_id", "span_id", "tool_name", "is_interrupt", "ts_ms"]
    calls = [(k, e, f"t{k // 2}", f"t{k // 2}", "Bash", False, k) for k, e in enumerate(["PreToolUse", "PostToolUse"] * 50)]
    first = calls + [(100, "PreToolUse", "a", "a", "Edit", False, 100), (101, "PreToolUse", "b", "b", "Edit", False, 101)]
    then = [(102, "PostToolUseFailure", "a", "a", "", True, 102), (103, "Stop", "", "", "", False, 103), (104, "PreToolUse", "b", "b", "Read", False, 104)]
    run = lambda rows: [tuple(r) for d in pairing.handleInputRows(("s",), iter([pd.DataFrame(rows, columns=names)]), None) for r in d.itertuples(index=False)]
    assert len(run(first)) == 50 and set(state.kept) == {("a",), ("b",)}
    assert run(then) == [("s", "a", 102, "Edit", 100, 102, "cancelled", False), ("s", "b", 103, "Edit", 101, 103, "unknown", True)]
    assert state.kept == {("b",): (104, "Read")}
    assert state.calls <= 8
