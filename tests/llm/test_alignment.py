import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from wattledger.llm import alignment, queries

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain(rows, libraries):
    """Whole texts through the libraries, byte by byte; pairs counted in a dictionary."""
    tok, sp = libraries
    back = {c: b for c, b in alignment._byte_letters().items()}
    docs = []
    for key, text in rows:
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        raw_a = [bytes(back[c] for c in tok.id_to_token(i)) for i in a]
        raw_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        want = (" " + text).encode() if text else b""
        if b"".join(raw_a) != want or b"".join(raw_b) != want:
            a, b, raw_a, raw_b = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        both = sorted(set(ends_a) & set(ends_b))
        links = [(b[ends_b.index(e)], a[ends_a.index(e)]) for e in both]
        groups = [
            ",".join(str(i) for i, e in zip(a, ends_a) if low < e <= high) + "|" + ",".join(str(i) for i, e in zip(b, ends_b) if low < e <= high)
            for low, high in zip([0, *both], both)
        ]
        docs.append((key, len(a), len(b), links, ";".join(groups)))
    counts = Counter(x for d in docs for x in d[3])
    most = Counter()
    for (b, _), n in counts.items():
        most[b] = max(most[b], n)
    return sorted((
        (key, n_a, n_b, len(links), len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(g.encode()).hexdigest() if g else "") for key, n_a, n_b, links, g in docs
    ), key=str)


TEXTS = [
    "The cat sat on the mat.", "the the the cat", " leading space", "two  spaces\n\nand lines\t", "naïve café 中文 🙂 ½", "",
    None, "<|endoftext|> and <s> </s> <unk> <0x41>", "a▁b", "ﬁ ligature Å", "x", " ", "don't you'll 12345 ...!!!", "The cat sat on the mat.",
    "Der Hund läuft über die Straße und bellt laut.", "\x00\x01 control\r\n", "zero​width space　wide",
]


def test_agrees_with_the_libraries(spark, make, libraries):
    rows = [(k if k != 3 else None, t) for k, t in enumerate(TEXTS)] + [(1, TEXTS[1]), (1, TEXTS[1])]
    want = plain(rows, libraries)
    assert any(r[1] == 0 for r in want) and sum(r[1] > 0 for r in want) > 10
    docs = make(rows).repartition(3)
    for how in ({}, {"records": 20, "docs": 3, "radix": 4, "fan": 2}):
        got = alignment.alignments(docs, **how)
        assert got.columns == COLUMNS
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert alignment.alignments(make([])).count() == 0
    assert sum(r["n_a"] for r in alignment.alignments(make([(1, None), (2, "")])).collect()) == 0


def test_segments_give_the_ids_of_the_whole_text(spark, libraries):
    tok, sp = libraries
    a, b = alignment.byte_side(public_tokenizers.path("byte_bpe_50k.json")), alignment.piece_side(public_tokenizers.path("piece_bpe_32k.model"))
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r["text"]]
    texts = [t for t in TEXTS if t] + docs[:150]
    for size in (1, 7, 40):
        for text, (x, y) in zip(texts, alignment.encode(texts, a, b, size)):
            assert x.tolist() == tok.encode(" " + text, add_special_tokens=False).ids, text
            assert y.tolist() == sp.encode(text), text


def test_long_and_odd_rows(spark, odd, make):
    got = alignment.alignments(odd).collect()
    assert len(got) == odd.count()
    rows = [(1, "x" * 300_000), (2, "word " * 200_000 + "end"), (3, "中" * 100_000)]
    for r in alignment.alignments(make(rows)).collect():
        assert r["n_groups"] > 0 and r["n_best"] <= r["n_links"] <= r["count_sum"]


def test_runs_merge_to_the_counts():
    rng = np.random.default_rng(1)
    heads, want = [], Counter()
    for _ in range(9):
        pair = np.unique(rng.integers(0, 5, 40) << 32 | rng.integers(0, 9, 40))
        sums = rng.integers(1, 300, len(pair))
        heads.append(alignment._heads(pair, sums))
        want.update(dict(zip(pair.tolist(), sums.tolist())))
    assert list(alignment.merged(heads)) == sorted(want.items())


def test_query_on_whole_table(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = queries.queries()["op12_tokenizer_alignment"](spark, "/root/testdata/sf0.001").collect()
    want = plain(rows, libraries)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_both_libraries_give_the_same_ids(libraries):
    tok, _ = libraries
    side = alignment.byte_side(public_tokenizers.path("byte_bpe_50k.json"))
    settled = "".join(chr(c) for c in range(1, 0x250))
    rng = np.random.default_rng(8)
    texts = ["".join(settled[i] for i in rng.integers(0, len(settled), 40)) for _ in range(300)] + [settled, "", " ", "x\u3000y", "<|endoftext|>"]
    texts += ["".join("a1 .\n\x85\xa0'st"[i] for i in rng.integers(0, 10, 30)) for _ in range(300)]
    assert side.encode(texts) == [tok.encode(t, add_special_tokens=False).ids for t in texts]
