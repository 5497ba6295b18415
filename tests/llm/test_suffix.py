import random

import numpy as np
import pytest

from wattledger.llm import suffix


def plain(docs, window):
    """docs: (order, bytes) in order; (n_removed, n_spans, kept) of each."""
    seen, out = set(), []
    for _, data in docs:
        gone = [False] * len(data)
        for s in range(len(data) - window + 1):
            key = data[s : s + window]
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["la", "tion", "é", "中", "the ", "of ", "  ", "\n", "x1"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 160))) for _ in range(25)]
    shared = "".join(rng.choice(words) for _ in range(140))
    for _ in range(12):
        t = rng.choice(texts)
        cut = rng.randint(0, len(t))
        texts.append(t[:cut] + rng.choice(["", "Q", shared, shared[30:]]) + t[cut:])
    texts += ["ab" * 300, "a" * 500, "ba" * 250, texts[0], texts[1], shared * 3]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("window,gram,frequent,chunk", [(100, 20, 20_000, 20_000), (30, 8, 3, 5), (12, 12 - 1, 10_000, 1)])
def test_against_every_window(make, window, gram, frequent, chunk, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 997)
    rows = corpus(window)
    df = make([(k, t) for k, t in rows]).repartition(5)
    got = {
        r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept"]))
        for r in suffix.remove_repeats(df, window=window, gram=gram, frequent=frequent, chunk=chunk).collect()
    }
    want = dict(zip((k for k, _ in rows), plain([(k, t.encode()) for k, t in rows], window)))
    assert got == want


def test_pieces_of_long_texts():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abc ") for _ in range(n)) for n in (5000, 99, 100, 1200, 101)]
    covered = {k: [0] * max(0, len(t) - 99) for k, t in enumerate(texts)}
    for data, who, start, at in suffix._joined(texts, 100, 700):
        for w, s, a, e in zip(who, start, at, [*at[1:], len(data)]):
            assert texts[w][s : s + e - a] == data[a:e]
            for i in range(s, s + (e - a) - 99):
                covered[int(w)][i] += 1
    assert all(set(c) <= {1} for c in covered.values())


def test_odd_tables(odd, make):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in odd.collect()]
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    want = dict(zip(order, plain(order, 100)))
    out = suffix.remove_repeats(odd, carry=("lang", "kept")).collect()
    assert len(out) == len(rows)
    by_key = {k: v for (k, _), v in want.items()}
    for r in out:
        assert (r["n_removed"], r["n_spans"], bytes(r[4])) == by_key[r["doc_id"]]
    assert suffix.remove_repeats(make([])).count() == 0


def test_cut_characters_go(make):
    df = suffix.as_text(make([(1, "x")]).selectExpr("doc_id", "unhex('C3A9C3') AS kept"), "kept", "text")
    assert [tuple(r) for r in df.collect()] == [(1, "é")]


def test_order_of_rows():
    rng = np.random.default_rng(2)
    for shape, high in (((3000, 100), 3), ((500, 9), 256), ((1, 8), 4), ((400, 30), 1)):
        rows = rng.integers(0, high, shape).astype(np.uint8)
        rows[shape[0] // 2 :] = rows[0]
        order = suffix._order(rows)
        assert sorted(order.tolist()) == list(range(shape[0]))
        assert [rows[k].tobytes() for k in order] == sorted(r.tobytes() for r in rows)


@pytest.mark.parametrize("frequent,parts", [(20, 4), (3, 7), (400, 23)])
def test_frequent_passages_are_split_over_buckets(spark, make, monkeypatch, frequent, parts):
    """A passage in very many texts, with other text around it in each, over many buckets: no group larger than ``frequent`` is compared in one go."""
    rng = random.Random(8)
    own = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    footer = own(300)
    rows = [(k, own(rng.randint(0, 150)) + footer[: rng.randint(120, 300)] + own(rng.randint(0, 150))) for k in range(150)]
    rows += [(200 + k, footer[k:] + own(40) + footer) for k in range(5)] + [(300, rows[3][1]), (301, rows[3][1])]
    levels, whole = [], suffix._bucketed

    def watched(*how):
        out = suffix.cut(whole(*how))
        levels.append(out)
        return out

    monkeypatch.setattr(suffix, "_bucketed", watched)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {
            r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept"]))
            for r in suffix.remove_repeats(make(rows).repartition(5), frequent=frequent).collect()
        }
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == dict(zip((k for k, _ in rows), plain([(k, t.encode()) for k, t in rows], 100)))
    kinds = {r["kind"] for level in levels for r in level.select("kind").distinct().collect()}
    assert kinds == ({0, 1, 2} if frequent < 100 else {0, 1}) and (len(levels) > 2) == (frequent < 100)
