"""Spool files that are announced together arrive together."""

from wattledger.sources import spool
from wattledger.sources.tail import SpoolTailReader


def test_only_announced_files_are_seen(spark, folder):
    place = f"{folder}/published"
    reader = SpoolTailReader(f"{folder}/in", 1 << 20, flush_rows=1, published=place)
    reader.initialOffset()
    assert reader.latestOffset() == {}
    rows = spark.createDataFrame([(f"c.{k % 3}.jsonl", f"line {k}", k) for k in range(9)], "file_name string, line string, arrival int")
    assert spool.write_spool(rows.where("arrival < 6"), f"{folder}/in", publish=place) == 3
    with open(f"{folder}/in/c.0.jsonl", "a") as f:
        f.write("line 6\n")  # another write is under way
    first = reader.latestOffset()
    assert first == {f"c.{k}.jsonl": 14 for k in range(3)}
    assert spool.write_spool(rows, f"{folder}/in", publish=place) == 3
    assert reader.latestOffset() == {f"c.{k}.jsonl": 21 for k in range(3)}
