import random

import numpy as np
import pytest

from wattledger.llm import crf

PARTS = {
    "aa": "tion ing the of and re er st".split(), "bb": "chen ung der ein sch ver ge au".split(),
    "cc": "ción que los de ar ll ía es".split(),
}


def word(lang, rng):
    return "".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3)))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(2)
    return crf.fit([([word(y, rng) for _ in range(30)], y) for y in PARTS for _ in range(150)], epochs=3)


def plain_marginals(scores, transitions):
    n, k = scores.shape
    step, e = np.exp(transitions), np.exp(scores)
    total = np.zeros((n, k))
    paths = np.array(np.meshgrid(*[range(k)] * n)).reshape(n, -1).T
    for p in paths:
        weight = step[:, p[0]].sum() / k * e[0, p[0]]
        for i in range(1, n):
            weight *= step[p[i - 1], p[i]] * e[i, p[i]]
        for i in range(n):
            total[i, p[i]] += weight
    return total / total.sum(1, keepdims=True)


@pytest.mark.parametrize("block", [1, 2, 3, 32])
def test_forward_backward_over_all_paths(block):
    rng = np.random.default_rng(block)
    transitions = rng.normal(size=(3, 3))
    lengths = np.array([1, 5, 2, 6])
    scores = rng.normal(size=(lengths.sum(), 3)) * 2
    got = crf.marginals(scores, lengths, transitions, block)
    at = 0
    for n in lengths:
        assert np.allclose(got[at : at + n], plain_marginals(scores[at : at + n], transitions))
        at += n


def test_code_switching(model):
    rng = random.Random(9)
    right = total = 0
    for _ in range(20):
        langs = ["aa"] * 12 + ["cc"] * 9 + ["bb"] * 11
        found = crf.label_words(" ".join(word(y, rng) for y in langs), model)
        right += sum(y == z for y, (_, z, _) in zip(langs, found))
        total += len(langs)
        assert all(0 <= p <= 1 for _, _, p in found)
    assert right / total > 0.9


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    import os

    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    from wattledger.llm import queries

    got = {r["doc_id"]: r for r in queries.queries()["op1_crf_language"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("lang is not null").collect()
    held = [r for r in docs if got[r["doc_id"]]["held_out"] and len(r["text"]) > 200]
    assert held and sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95


def test_odd_tables(odd, make, model):
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in crf.predict(odd.select("doc_id", "text", "score"), model).collect()}
    assert {got[k] for k in (1, 2, 8)} == {("und", 0.0)}
    assert all(0 <= s <= 1 for _, s in got.values()) and got[9] == ("und", 0.0)
    assert crf.predict(make([]), model).count() == 0
    empty = crf.train(make([]))
    assert empty.labels == [] and crf.predict(odd.select("text"), empty).distinct().count() == 1
    kept = crf.predict(odd, model, label="a", score="b", keep_text=True)
    assert kept.columns == [*odd.columns, "a", "b"] and kept.filter("text is null").count() == 1


def test_numerals_alone_are_no_words():
    for n in (1, 63, 64, 200):
        assert crf.words("½ ² " * n) == []
        assert len(crf.words("½ ² " * n + "a")) == 2 * n + 1
