import json

from wattledger.operators import validate as X

BASE = {
    "schema_version": "0.1.0", "event_id": "0123456789abcdef", "ts": "2026-07-25T12:00:00Z", "session_id": "s",
    "collector": {"name": "c", "version": "1"},
}
CALL = {"provider": "p", "model_id_requested": "m", "usage": {"input_tokens": 5}, "usage_source": "api_response"}
ENERGY = {"t_start": "2026-07-25T12:00:00Z", "t_end": "2026-07-25T12:00:05Z", "components": [{"kind": "cpu", "energy_j": 1.5, "method": "rapl"}]}


def event(kind="llm_call", payload=CALL, **changes):
    return json.dumps({**BASE, "type": kind, "payload": payload, **changes})


VECTORS = [
    (event(), "known", None), (event("energy_sample", ENERGY), "known", None),
    (event("process_sample", {**ENERGY, "components": 0, "processes": [{"pid": 1, "cpu_time_delta_ms": 2, "extra": 1}]}), "known", None),
    ("{not json", "rejected", "json"), ("[1]", "rejected", "schema"),
    (event("energy_sample", {**ENERGY, "components": [{"kind": "cpu", "energy_j": -1, "method": "rapl"}]}), "rejected", "schema"),
    (event("energy_sample", {**ENERGY, "components": []}), "rejected", "schema"),
    (event("energy_sample", {**ENERGY, "t_start": "yesterday"}), "rejected", "schema"),
    (event(event_id="0123456789abcde"), "rejected", "schema"), (event(ts="2026-07-25"), "rejected", "schema"),
    (event(payload={**CALL, "usage": {"input_tokens": -1}}), "rejected", "schema"),
    (event(payload={**CALL, "usage": {"input_tokens": "5"}}), "rejected", "schema"),
    (event(payload={**CALL, "usage": {"tokens": 5}}), "rejected", "schema"),
    (event(attribution={"color": "red"}), "rejected", "schema"), (event(attribution={"task_id": "t"}), "known", None),
    (event(event_id=1234567890123456789), "rejected", "schema"), (event(payload={**CALL, "status": "fine"}), "rejected", "schema"),
    *[(event(schema_version=v), "rejected", "unknown_version") for v in ("9.9.9", "0.2.0", "0.1", "0.1.0.1", "0.1.beta")],
    (event(schema_version=1), "rejected", "schema"), (event("tool_trace", {"a": 1}), "opaque", None),
    (event("tool_trace", {"a": 1}, event_id="short"), "rejected", "schema"), (event("tool_trace", {"a": 1}, session_id=""), "rejected", "schema"),
]


def test_vectors(spark):
    df = spark.createDataFrame([(i, line) for i, (line, _, _) in enumerate(VECTORS)], "arrival bigint, line string")
    got = {r.arrival: (r.outcome, r.reason_kind) for r in X.classify(df).select("arrival", "outcome", "reason_kind").collect()}
    for i, (line, outcome, kind) in enumerate(VECTORS):
        assert got[i] == (outcome, kind), line


def test_round_trip(spark):
    df = spark.createDataFrame([(0, event()), (1, event("energy_sample", ENERGY))], "arrival bigint, line string")
    facts = X.known_facts(X.classify(df))
    lines = [json.loads(r.value) for r in X.event_lines(facts).orderBy("arrival").collect()]
    assert lines == [json.loads(event()), json.loads(event("energy_sample", ENERGY))]
    sample = facts.where("type = 'energy_sample'").first()
    assert sample.t_end_ms - sample.t_start_ms == 5000
