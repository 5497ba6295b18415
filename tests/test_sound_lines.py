"""The sufficient test of sound lines says nothing that the rules would not say."""

import json

from pyspark.sql import functions as F

from wattledger.operators import validate as X

BASE = {
    "schema_version": "0.1.0", "event_id": "evt-000000000001", "ts": "2024-01-05T00:00:00.000Z", "session_id": "s",
    "collector": {"name": "c", "version": "1"}, "type": "energy_sample",
}
SPAN = {"t_start": "2024-01-05T00:00:00.000Z", "t_end": "2024-01-05T00:00:01.000Z"}
PART = {"kind": "cpu", "energy_j": 1, "method": "rapl"}


def line(**payload):
    return json.dumps(BASE | {"payload": SPAN | payload})


def test_sound_lines_hold_and_others_are_left_to_the_rules(spark):
    right = [line(components=[PART]), line(components=[PART, PART | {"energy_j": 1.5, "label": "x"}], host_id="h")]
    left = [
        line(components=[PART, {"kind": "cpu", "method": "rapl"}]), line(components=[PART, PART | {"label": None}]), line(components=[PART, PART | {"energy_j": "1"}]),
        line(components=[]), line(components=[None]), line(components=[PART | {"kind": "sun"}]), line(components=[PART | {"energy_j": -1}]),
        line(components=[PART], t_end="2024-01-05"), line(), line(components=[PART]).replace("0.1.0", "0.2.0"), "{", "7", line(components=[PART])[:-3],
        line(components=[PART], extra=1),  # sound, but not of the contract's fields: the rules say so
    ]
    rows = spark.createDataFrame([(k, text) for k, text in enumerate(right + left)], "k int, line string").withColumn("v", F.try_parse_json("line"))
    said = {r.k: r.s for r in rows.select("k", X.sound(F.col("v"), F.col("line")).alias("s")).collect()}
    assert [said[k] for k in range(len(said))] == [True] * len(right) + [False] * len(left)
    violated = rows.select("k", X.contract_violation(F.col("v")).alias("x"))
    assert all(r.x is None for r in violated.collect() if said[r.k])
    got = {r.k: r.outcome for r in X.classify(rows.drop("v")).collect()}
    assert [k for k, o in got.items() if o == "known"] == [0, 1, len(said) - 1]
