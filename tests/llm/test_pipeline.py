import os

import pytest

import corpus_pipeline as P
from wattledger.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark, odd, make):
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (odd, plain, make([])):
        for name, stage in P.STAGES[:-1]:
            got = stage(spark, docs, SF)
            assert got.columns == docs.columns, name
            assert {r["doc_id"] for r in got.collect()} <= {r["doc_id"] for r in docs.collect()}
        assert P.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_language_stage(spark, odd):
    kept = {r["doc_id"] for r in P.language(spark, odd, SF).collect()}
    assert not kept & {1, 2, 8, 9} and {3, 4, 5} <= kept


def test_repeats_stage(spark, make):
    body = "".join(f"{i * 7919 % 1000:03d} " for i in range(60))
    docs = make([(1, body), (2, body), (3, "begin " + body + " end"), (4, ""), (5, None), (6, "short")])
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in P.repeated_passages(spark, docs, SF).collect()}
    assert got == {1: (body, 240), 3: ("begin  end", 10), 4: ("", 0), 5: ("", 0), 6: ("short", 5)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_whole_pipeline(spark):
    out = P.run(spark, SF)
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(ids) == sorted(r["doc_id"] for r in docs.collect()) and ids


def test_every_query_has_its_number():
    names = list(queries.queries())
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
    assert len(names) == 14 and set(queries.oracle_sql()) <= set(names)
