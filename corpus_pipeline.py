"""From documents to token ids in five stages, each a call of one operator.

Every stage takes (spark, docs, sf_dir) and returns the rows it keeps, with the columns of documents; the last returns
token ids.  Null columns, empty texts and empty tables pass through each stage as its operator's docstring says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger.llm import bpe, crf, minhash, mixing, simhash, suffix
from wattledger.llm.common import documents, domain_of, fresh, prepare, word_count
from wattledger.session import cut

#: A document whose likeliest language has less than this mean probability is rejected, as is one without letters.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without letters and those in no language that the labels know."""
    prepare(spark)
    model = crf.train(docs)
    label, score = fresh(docs, "lang_pred", "lang_score")
    marked = crf.predict(docs, model, label=label, score=score, keep_text=True)
    return marked.filter((F.col(label) != crf.UNDETERMINED) & (F.col(score) >= LEAST_SCORE)).drop(label, score)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group that operator 10 links.

    Its three words and three bits leave most near copies of longer texts, so of what it keeps only one of each group
    that shares 0.8 of its five-word shingles from one to the next stays.
    """
    return minhash.one_of_each_group(cut(simhash.one_of_each_group(docs)))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated bytes from texts, and documents of which nothing is left.

    A character of which a repeat took only some bytes goes whole.  ``n_chars`` follows the new text.
    """
    named = {f"carried_{i}": c for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    plain = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for n, c in named.items()])
    out = suffix.remove_repeats(plain, carry=tuple(named)).filter("n_removed = 0 or n_removed < n_bytes")
    out = suffix.as_text(out.drop("n_bytes", "n_removed", "n_spans"), "kept", "text").withColumnsRenamed(named)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, shared by weight over domains, languages and sources; up to two epochs of each.

    Tokens are words between white space here, so a text in a script without spaces counts as one or a few.
    """
    domain, count = fresh(docs, "domain", "n_tokens")
    counted = docs.withColumn(domain, domain_of("source")).withColumn(count, word_count("text"))
    path = [domain, *mixing.PATH[1:]]
    chosen = mixing.selected(counted, path, mixing.WEIGHTS, tokens=count, seed=mixing.SEED, max_epochs=mixing.MAX_EPOCHS)
    return chosen.drop(domain, count)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (little-endian unsigned 32-bit), and digests of them and of what they stand for."""
    prepare(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path)
    return bpe.decode(ids, path).select(
        "doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Trained weights and 64-bit sums of hashes have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
