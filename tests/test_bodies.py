import json

import pytest

from wattledger.operators import otlp as O
from wattledger.sources import bodies as B


def export(*names):
    return json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [{"body": {"stringValue": n}} for n in names]}]}]})


@pytest.mark.parametrize("per", ["file", "line"])
def test_bodies_from_files_and_lines(spark, folder, per):
    texts = {"a.json": [export("x", "y")], "b.json": [export("z")], "torn.json": [export("x")[:30]], "long.json": [export("w" * 500)], "empty.json": []}
    if per == "line":
        texts["a.json"] += ["", export("u"), export("u")]
    for name, lines in texts.items():
        with open(f"{folder}/{name}", "w") as out:
            out.write("\n".join(lines))
    got = B.read_bodies(spark, folder, per, max_bytes=300)
    records, refused = O.decode(got)
    want = ["u", "x", "y", "z"] if per == "line" else ["x", "y", "z"]
    assert sorted(r.record_body for r in records.collect()) == want
    bad = {r.origin.rsplit("/", 1)[1]: r.reason for r in B.quarantine(got, refused).collect()}
    assert bad == {"torn.json": "not JSON", "long.json": "over size"}
    out = f"{folder}-out"
    stream = B.stream_bodies(spark, folder, per, max_bytes=300, files=1)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}-cp").trigger(availableNow=True).start().awaitTermination()
    again = spark.read.parquet(out)
    assert {r.body_id for r in again.collect()} == {r.body_id for r in got.collect()}
    with pytest.raises(ValueError):
        B.read_bodies(spark, folder, "page")
