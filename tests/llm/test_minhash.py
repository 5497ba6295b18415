import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from wattledger.llm import minhash


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(texts):
    sets, root = [plain_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (not a and not b) or 100 * len(a & b) >= 80 * len(a | b) > 0:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def replaced(text, n, rng):
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.getrandbits(30)}"
    return " ".join(words)


def corpus(seed):
    """Texts, and copies of them with some words replaced, on both sides of a similarity of 0.8; chains of copies."""
    rng = random.Random(seed)
    fresh = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    footer = fresh(60)
    texts = []
    for size, changes in ((300, (1, 3, 6, 7, 9, 20)), (1000, (12, 22, 40)), (100, (1, 2, 3, 5)), (4, (1,)), (40, (0, 1, 2))):
        for _ in range(8):
            base = fresh(size)
            texts += [base, base.upper(), *(replaced(base, n, rng) for n in changes)]
    for _ in range(20):
        texts.append(fresh(15) + " " + footer)
    step = fresh(200)
    for _ in range(12):
        texts.append(step)
        step = replaced(step, 3, rng)
    rng.shuffle(texts)
    return texts + ["", None, " "]


@pytest.mark.parametrize("how", [{}, {"block": 3}])
def test_against_all_pairs(make, how):
    texts = corpus(7)
    want = plain_groups(texts)
    df = make([(k, t) for k, t in enumerate(texts)]).repartition(4)
    got = {r["doc_id"]: r["component"] for r in minhash.group(df, **how).collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_stage_finds_what_three_bits_lose(spark, make):
    """Copies with a similarity of 0.82 to 0.97, most of which lie beyond three bits of a three-word fingerprint."""
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(40)]
    rows = list(enumerate(base)) + [(100 * n + k, replaced(t, n, rng)) for n in (1, 3, 6) for k, t in enumerate(base)]
    kept = {r["doc_id"] for r in P.near_copies(spark, make(rows), "").collect()}
    assert kept == set(range(40))


def test_odd_tables(odd, make):
    assert minhash.group(make([])).count() == 0 == minhash.one_of_each_group(make([])).count()
    assert minhash.group(odd).count() == odd.count()
    kept = minhash.one_of_each_group(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "3", "4", "None", "7", "9", "10"])


def test_recall_at_the_limit():
    """Pairs at 0.8 to 0.82 share a key."""
    rng = random.Random(4)
    missed = 0
    for _ in range(2000):
        pool = [rng.getrandbits(64) for _ in range(110)]
        a, b = (minhash.np.unique(minhash.np.array(x, "uint64")) for x in (pool[:100], pool[:90] + pool[100:]))
        missed += not set(minhash.band_keys(a)) & set(minhash.band_keys(b))
    assert missed <= 4


def test_keys_are_not_broadcast(spark):
    # 3,000 short texts have 72,000 keys, some 4 MB.
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text"))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "2m")
    try:
        rows = minhash.group(docs).collect()
        assert len(rows) == 3000 and all(r["doc_id"] == r["component"] for r in rows)
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
