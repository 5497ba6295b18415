import random
import re

import xxhash
from pyspark.sql import functions as F

from wattledger.llm import simhash
from wattledger.llm.components import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def flipped(fp, n, rng):
    for b in rng.sample(range(64), n):
        fp ^= 1 << b
    return fp


def test_links_connect_what_is_near(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for fp in list(fps)[:20]:
        for n in (1, 2, 3, 3, 4, 5):
            fps.add(flipped(fp, n, rng))
    core = rng.getrandbits(64)  # one dense group
    fps |= {flipped(core, rng.randint(0, 4), rng) for _ in range(150)}
    fps = sorted(fps)
    want = plain_components(fps)
    for how in ({}, {"segments": 4}, {"block": 8}):
        df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
        got = {r["node"]: r["component"] for r in components(simhash.links(df, **how)).collect()}
        groups = {}
        for f, w in zip(fps, want):
            groups.setdefault(got.get(signed(f), signed(f)), set()).add(w)
        assert all(len(g) == 1 for g in groups.values())
        assert len(groups) == len(set(want))


def test_groups_of_texts(spark, odd):
    rng = random.Random(3)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta".split()) for _ in range(120)) for _ in range(15)]
    rows = [(100 + i, t) for i, t in enumerate(base)] + [(200 + i, t + " Tail") for i, t in enumerate(base)]
    rows += [(r["doc_id"], r["text"]) for r in odd.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fps = [plain_fingerprint(t) for _, t in rows]
    groups = plain_components(fps)
    least = {}
    for (k, _), g in zip(rows, groups):
        if k is not None:
            least[g] = min(least.get(g, k), k)
    want = sorted(((k, signed(f), least.get(g)) for (k, _), f, g in zip(rows, fps, groups)), key=str)
    got = sorted((tuple(r) for r in simhash.group(df).collect()), key=str)
    assert got == want
    assert simhash.group(odd).count() == odd.count()


def test_empty_and_kept(odd, make):
    assert simhash.group(make([])).count() == 0
    assert simhash.one_of_each_group(make([])).count() == 0
    kept = simhash.one_of_each_group(odd)
    assert kept.columns == odd.columns
    # 1, 2 and 8 have no words; 4 and 5 are equal; the row without an id stays.
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "3", "4", "None", "7", "9", "10"])


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_lookups_are_not_broadcast(spark):
    # 3,000 fingerprints are 24 KB and have 102,000 lookups, some 4 MB.
    fps = spark.range(3000).select(F.xxhash64("id").alias("fp"))
    fps = fps.union(fps.select(F.col("fp").bitwiseXOR(F.lit(5))))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "256k")
    try:
        assert simhash.links(fps).distinct().count() == 3000
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
