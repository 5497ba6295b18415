import itertools
import os

import numpy as np
from pyspark.sql import functions as F

from wattledger.llm import linecrf, queries

DATA = "/root/testdata/sf0.01"


def test_forward_backward_agrees_with_all_paths():
    rng = np.random.default_rng(1)
    sizes = [1, 5, 2, 8, 1]
    score, t = rng.normal(0, 2, sum(sizes)), rng.normal(0, 1, (2, 2))
    first = np.cumsum(sizes) - sizes
    good, pairs = linecrf.marginals(score, first, t)
    want, joint = [], np.zeros((2, 2))
    for at, n in zip(first, sizes):
        total, each, both = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(score[at + i] for i in range(n) if path[i]) + sum(t[a, b] for a, b in zip(path, path[1:])))
            total += w
            each += w * np.array(path)
            for a, b in zip(path, path[1:]):
                both[a, b] += w
        want += (each / total).tolist()
        joint += both / total
    assert np.allclose(good, want) and np.allclose(pairs, joint)


def test_long_chains_and_extreme_scores_stay_finite():
    score = np.tile([30.0, -30.0, 30.0], 70_000)
    good, _ = linecrf.marginals(score, np.array([0]), np.array([[0.0, -6.0], [-6.0, 0.0]]))
    assert np.isfinite(good).all() and ((good >= 0) & (good <= 1)).all()


def test_gradient_is_that_of_the_likelihood():
    texts = [b"One line here.\nAND ONE!! MORE!!\n\nlast", b"", b"a a a a"]
    lines = linecrf.measure(texts)
    rng = np.random.default_rng(2)
    weights, value = rng.normal(0, 0.3, linecrf.WIDTH + linecrf.BUCKETS), rng.normal(0, 1, len(lines.bins))
    grad = linecrf.gradient(lines, value)
    for k in np.flatnonzero(grad)[::3]:
        up = weights.copy()
        up[k] += 1e-3
        change = ((linecrf.scores(lines, up) - linecrf.scores(lines, weights)) * value).sum() / 1e-3
        assert abs(change - grad[k]) < 1e-6


def test_measures_do_not_depend_on_pieces_or_neighbours(monkeypatch):
    rng = np.random.default_rng(3)
    words = [b"the", b"THE!!", "é中".encode(), b"a" * 300, b"|", b"7"]
    texts = [b" ".join(words[i] for i in rng.integers(0, 6, 60)).replace(b"7", b"\n") for _ in range(20)] + [b"", b"\n\n"]
    whole = linecrf.measure(texts)
    monkeypatch.setattr(linecrf, "PIECE", 37)
    small = linecrf.measure(texts)
    for a, b in zip(vars(whole).values(), vars(small).values()):
        assert (a == b).all()
    at = 0
    for t in texts:
        one = linecrf.measure([t])
        n = len(one.bins)
        assert n == t.count(b"\n") + 1 and (whole.bins[at : at + n] == one.bins).all()
        at += n


def test_lines_of_a_mixed_text_are_told_apart():
    clean, noise = b"The cat sat on the mat and slept.", b"BUY!! NOW!! CHEAP!! $$$ ### |"
    texts = [(b"\n".join([clean] * 4 + [b"It was warm there, on day %d." % k]), 1) for k in range(60)]
    texts += [(b"\n".join([noise] * 3 + [b"CALL!! %d" % k]), 0) for k in range(60)]
    model = linecrf.fit([texts[i] for i in np.random.default_rng(4).permutation(120)])
    _, good = linecrf.label_lines([b"\n".join([clean, b"A dog ran by.", clean] * 3 + [noise, b"WIN!! $$$ ###"] * 3)], model)
    assert good[:6].min() > 0.5 > good[-3:].max()
    low, high = linecrf.score_texts([noise * 3, clean], model)
    assert low < 0.3 and high > 0.7


def test_odd_rows(spark, odd, make):
    labels = spark.createDataFrame(
        [(3, 1, 0), (4, 0, 0), (5, 0, None), (7, 1, 1), (9, None, 0), (10, 1, 0), (10, 0, 0), (None, 1, 1), (99, 1, 0), (4, 0, 1)],
        "doc_id long, quality int, toxic int",
    )
    rows = linecrf.sample(odd, labels)
    assert sorted(y for _, y in rows) == [0, 0, 1, 1]
    model = linecrf.fit(rows)
    out = linecrf.predict(odd, model)
    assert out.columns == [c for c in odd.columns if c not in ("text", "score")] + ["score", "predicted"]
    got = out.collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[1] == by[2]  # null and empty
    empty = make([])
    assert linecrf.sample(empty, labels) == [] and linecrf.sample(odd, labels.limit(0)) == []
    assert linecrf.predict(empty, linecrf.fit([])).count() == 0
    assert {r["score"] for r in linecrf.predict(odd, linecrf.fit([])).select("score").collect()} == {0.5}


def test_a_long_text(spark, make):
    rows = [(1, "x" * 5_000_000), (2, "word " * 600_000), (3, "a line of text.\n" * 200_000)]
    got = linecrf.predict(make(rows), linecrf.fit([(b"a line of text.", 1), (b"###", 0)])).collect()
    assert all(0 <= r["score"] <= 1 for r in got)


def test_query_on_held_out_documents(spark):
    out = queries.queries()["op11_line_quality"](spark, DATA)
    labels = spark.read.parquet(os.path.join(DATA, "labels.parquet"))
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and out.count() == 1000
    rows = out.join(labels, "doc_id").filter("held_out and quality is not null").select("score", F.col("quality").alias("y")).collect()
    good, bad = ([r["score"] for r in rows if r["y"] == y] for y in (1, 0))
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert auc > 0.97, auc
    assert np.mean([g >= 0.7 for g in good]) > 0.97 and np.mean([b < 0.7 for b in bad]) > 0.85
