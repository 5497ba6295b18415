import corpus_pipeline as P
from wattledger.llm import minhash


def test_near_copies_are_the_groups_of_operator_10(spark, make):
    # More than half of both texts' three-word shingles are one, so their fingerprints are equal; of their five-word
    # shingles they share one in five.
    docs = make([(3, "x " * 50), (7, "x " * 50 + "a b c d"), (8, "some other words are here")])
    assert {r["doc_id"] for r in P.near_copies(spark, docs, "").collect()} == {3, 8}
    assert {r["doc_id"] for r in minhash.one_of_each_group(docs).collect()} == {3, 7, 8}
