import hashlib
import random
from fractions import Fraction

import pytest

from wattledger.llm import mixing

PATH = ["domain", "lang", "source"]
SCHEMA = "doc_id long, domain string, lang string, source string, n_tokens long"


def level(children, total):
    """Budgets of (name, supply, weight): raise the level until the total is placed."""
    out, left, live = {}, total, [c for c in children if c[2]]
    while True:
        heft = sum(c[2] for c in live)
        full = [c for c in live if Fraction(c[1], c[2]) <= Fraction(left, heft)] if heft else []
        if not full:
            break
        c = min(full, key=lambda c: (Fraction(c[1], c[2]), c[0]))
        out[c[0]] = c[1]
        left -= c[1]
        live.remove(c)
    live.sort(key=lambda c: (Fraction(c[1], c[2]), c[0]))
    heft = sum(c[2] for c in live)
    parts = [left * c[2] // heft for c in live]
    for i, c in enumerate(live):
        out[c[0]] = parts[i] + (i < left - sum(parts))
    return out


def plain(rows, weights, seed, share, epochs):
    weights = dict(weights)
    tokens = {}
    for r in rows:
        leaf = tuple(x or "" for x in r[1:4])
        tokens[leaf] = tokens.get(leaf, 0) + (r[4] or 0)

    def weight(path):
        return weights.get(path, 1)

    supply = {x: t * epochs if all(weight(x[: d + 1]) for d in range(3)) else 0 for x, t in tokens.items()}
    budget = {(): min(sum(supply.values()), int(sum(tokens.values()) * share))}
    for depth in range(3):
        below = {}
        for parent in {x[:depth] for x in tokens}:
            names = {x[: depth + 1] for x in tokens if x[:depth] == parent}
            children = [(n[-1], sum(s for x, s in supply.items() if x[: depth + 1] == n), weight(n)) for n in names]
            for name, b in level(children, budget.get(parent, 0)).items():
                below[(*parent, name)] = b
        budget = below
    out = []
    for leaf, t in tokens.items():
        b = budget.get(leaf, 0)
        whole, rest = divmod(b, t) if t else (0, 0)
        own = [r for r in rows if tuple(x or "" for x in r[1:4]) == leaf]
        own.sort(key=lambda r: (hashlib.md5(f"{seed}:{whole + 1}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[4] or 0))
        for r in own:
            take = max(0, min(r[4] or 0, rest))
            rest -= take
            out.append((r[0], *leaf, r[4] or 0, whole, take))
    return sorted(out, key=str)


@pytest.mark.parametrize("share,epochs", [(1.0, 2), (0.37, 1), (5.0, 3)])
def test_against_raising_the_level(spark, share, epochs):
    rng = random.Random(epochs)
    rows = [
        (k, rng.choice(["a", "a", "b", None]), rng.choice(["x", "x", "x", "y"]), rng.choice(["s", "t", "u'"]), rng.choice([0, 1, 7, 90, None]))
        for k in range(400)
    ] + [(None, "b", "y", "s", 5), (3, "a", "x", "t", 4), (3, "a", "x", "t", 4)]
    weights = [(("a",), 3), (("b",), 7), (("a", "y"), 5), (("a", "x", "t"), 0), (("b", "x", "s"), 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df, PATH, weights, seed=11, share_of_supply=share, max_epochs=epochs)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, weights, 11, share, epochs)


def test_siblings_before_ancestors(spark):
    rows = [(1, "a", "x", "s", 10), (2, "a", "y", "s", 200), (3, "b", "x", "s", 500)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), PATH, [], share_of_supply=200 / 710)
    assert sorted((r["doc_id"], r["n_taken"] + r["epochs"] * r["n_tokens"]) for r in got.collect()) == [(1, 10), (2, 90), (3, 100)]


def test_selected_rows(spark, odd, make):
    rows = [(1, "a", "x", "s", 10), (2, "a", "y", "s", 20)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.selected(df, PATH, [(("a", "y"), 3)], max_epochs=3)
    assert sorted(tuple(r) for r in got.collect()) == [rows[0], rows[1], rows[1]]
    assert got.columns == df.columns
    from pyspark.sql import functions as F

    counted = odd.withColumn("domain", F.lit("d"))
    assert mixing.selected(counted, PATH, []).columns == counted.columns
    assert mixing.mix(make([]).selectExpr("doc_id", "lang domain", "lang", "source", "n_chars n_tokens"), PATH, []).count() == 0
