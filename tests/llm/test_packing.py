import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wattledger.llm import packing


def plain_best_fit(lengths, length):
    rows, rooms = [], []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(r, -k) for k, r in enumerate(rooms) if r >= lengths[item]]
        if not fits:
            rows.append([item])
            rooms.append(length - lengths[item])
        else:
            room = min(fits)[0]
            k = max(k for k, r in enumerate(rooms) if r == room)
            rows[k].append(item)
            rooms[k] -= lengths[item]
    return rows


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 37), max_size=60))
def test_best_fit(lengths):
    got = packing.best_fit(lengths, 37)
    want = plain_best_fit(lengths, 37)
    size = lambda rows: sorted(sorted(lengths[i] for i in r) for r in rows)
    assert sorted(i for r in got for i in r) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in r) <= 37 for r in got)
    assert len(got) == len(want) and sorted(map(sum, size(got))) == sorted(map(sum, size(want)))


def test_lossless(spark):
    rng = np.random.default_rng(1)
    docs = {k: rng.integers(0, 50_000, n).astype("<u4") for k, n in enumerate([0, 1, 15, 16, 17, 500, 31, 32, 33, 7] * 8)}
    rows = [(k, v.tobytes()) for k, v in docs.items()] + [(900, None)]
    df = spark.createDataFrame(rows, "doc_id long, ids binary").repartition(3)
    for pool in (40, 1 << 20):
        back = {}
        for r in packing.pack(df, length=32, pool=pool).collect():
            ids, places = (np.frombuffer(r[c], "<u4") for c in ("ids", "positions"))
            assert len(ids) == len(places) == 32 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] <= 32
            assert (ids[r["cu_seqlens"][-1] :] == 50256).all()
            for a, b, k, s in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["doc_ids"], r["starts"]):
                assert places[a:b].tolist() == list(range(b - a))
                back.setdefault(k, {})[s] = ids[a:b]
        assert set(back) == {*docs, 900}
        for k, parts in back.items():
            whole = np.concatenate([parts[s] for s in sorted(parts)])
            assert whole[-1] == 50256 and whole[:-1].tolist() == docs.get(k, np.array([], int)).tolist()
            assert sorted(parts) == list(range(0, len(whole), 32))
    assert packing.pack(spark.createDataFrame([], df.schema)).count() == 0


def test_matrices_are_read_back(spark, folder, monkeypatch):
    monkeypatch.setattr(packing, "ROWS", 3)
    rng = np.random.default_rng(2)
    docs = [(k, rng.integers(0, 50_000, int(n)).astype("<u4").tobytes()) for k, n in enumerate(rng.integers(0, 90, 60))]
    packed = packing.pack(spark.createDataFrame([*docs, (99, None)], "doc_id long, ids binary").repartition(3), length=32)
    for _ in range(2):  # written twice, it is there once
        manifest = packing.write(packed, folder)
    want = sorted(map(tuple, packed.collect()))
    names = packed.columns
    assert sorted(map(tuple, packing.read(spark, folder, 32).select(*names).collect())) == want
    parts = {r.part: r for r in manifest.collect()}
    assert sum(r.rows for r in parts.values()) == len(want)
    places = sum(len(b) // 4 + 1 for _, b in docs) + 1
    (whole,) = packing.fill(packed, 32).collect()
    assert whole.rows == len(want) and whole.filled == places == sum(r.filled for r in parts.values())
    assert whole.fill == places / (32 * len(want)) > 0.9
    # Flat files that can be mapped: a row begins every 32 ids.
    for part, r in parts.items():
        ids = np.memmap(f"{folder}/ids/part-{part:05d}.u32", "<u4", "r").reshape(-1, 32)
        assert len(ids) == r.rows
        assert [row.tobytes() for row in ids] == [w[names.index("ids")] for w in want if w[0] == part]
    assert not [f for f in os.listdir(f"{folder}/ids") if f.startswith("_")]
    with pytest.raises(Exception, match="rows of 16"):
        packing.read(spark, folder, 16).collect()


def test_no_rows_are_no_matrices(spark, folder):
    packed = packing.pack(spark.createDataFrame([], "doc_id long, ids binary"), length=32)
    assert packing.write(packed, folder).count() == 0 and packing.read(spark, folder, 32).count() == 0
    (whole,) = packing.fill(packed, 32).collect()
    assert tuple(whole) == (0, 0, None)
