import numpy as np
import pytest

from wattledger.llm import separators


def plain(data, end, width):
    ids = np.frombuffer(data, f"<u{width}").tolist()
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == end:
            out.append((start, i - start, True))
            start = i + 1
    return out + ([(start, len(ids) - start, False)] if start < len(ids) else [])


@pytest.mark.parametrize("width,end", [(2, 50256), (4, 50256), (1, 255)])
def test_scan_of_files(spark, folder, width, end):
    rng = np.random.default_rng(width)
    files = {}
    for name in ("a", "b", "c"):
        ids = rng.integers(0, 200, 3000)
        ids[rng.integers(0, 3000, 40)] = end
        files[name] = ids
    files["c"][:1500] = 7  # a document over many blocks
    files["a"][-1] = end
    data = {n: x.astype(f"<u{width}").tobytes() for n, x in files.items()} | {"empty": b"", "one": end.to_bytes(width, "little")}
    # An end identifier's bytes at a place that is not aligned are no end.
    if width == 2:
        data["odd"] = bytes([1, 0x50, 0xC4, 1])
    for n, x in data.items():
        with open(f"{folder}/{n}", "wb") as out:
            out.write(x)
    for block in (width * 16, 1 << 20):
        got = {}
        for r in separators.scan(spark, folder, end, width, block).orderBy("file", "doc").collect():
            got.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["start"], r["n_tokens"], r["ended"]))
        assert got == {n: plain(x, end, width) for n, x in data.items() if x}


def test_ragged_file_fails(spark, folder):
    with open(f"{folder}/x", "wb") as out:
        out.write(b"abc")
    with pytest.raises(Exception, match="multiple of the id width"):
        separators.scan(spark, folder).collect()


def test_written_and_counted(spark, make):
    texts = {1: [5, 50000, 80], 2: [], 3: list(range(1000)), 4: None, 5: [0xC450 - 1, 0x50]}
    rows = [(k, None if v is None else np.array(v, "<u2").tobytes()) for k, v in texts.items()] + [(None, b"\x01\x00"), (2, b"")]
    df = spark.createDataFrame(rows, "doc_id long, ids binary").repartition(3)
    got = sorted((tuple(r) for r in separators.count_documents(df).collect()), key=str)
    assert got == sorted([(k, len(v or b"") // 2) for k, v in rows], key=str)
    assert separators.count_documents(spark.createDataFrame([], df.schema)).count() == 0


def test_document_over_whole_blocks(spark, make):
    """At the real block size: texts that cover one block, several blocks and exactly one block."""
    sizes = {1: 3, 2: 600_000, 3: 1_700_000, 4: separators.BLOCK // 2 - 1, 5: separators.BLOCK // 2, 6: 0, 7: 1}
    rows = [(k, np.full(n, 7, "<u2").tobytes()) for k, n in sizes.items()]
    df = spark.createDataFrame(rows, "doc_id long, ids binary").coalesce(1)
    assert {tuple(r) for r in separators.count_documents(df).collect()} == set(sizes.items())
