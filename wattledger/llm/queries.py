"""One query per operator over its whole tables, and the SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from wattledger.llm import alignment, bpe, cdc, crf, fertility, licenses, linecrf, mixing, negatives, packing, separators, simhash, suffix
from wattledger.llm.common import documents, domain_of, map_batches, prepare, word_count
from wattledger.session import configure

QueryFn = Callable[[SparkSession, str], DataFrame]

#: Learning uses the documents whose crc32(doc_id as text) mod FOLDS is not HELD_OUT.
FOLDS, HELD_OUT = 4, 2


def held_out() -> Column:
    """Whether a document takes no part in learning; one without an id does."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def op1_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from three quarters of the labelled documents."""
    docs = documents(spark, sf_dir).withColumn("held_out", held_out())
    model = crf.train(docs.filter("not held_out"))
    return crf.predict(docs.select("doc_id", "held_out", "text"), model)


def op2_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files by their separators."""
    docs = documents(spark, sf_dir)
    ids = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))

    def narrow(batch: pa.RecordBatch) -> pa.RecordBatch:
        small = [np.frombuffer(v.as_py(), "<u4").astype("<u2").tobytes() for v in batch.column("ids")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(small, pa.binary())], names=["doc_id", "ids"])

    return separators.count_documents(map_batches(ids, narrow, ids.schema), keys=docs)


def op3_content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk fingerprints of every text and of its edited text."""
    return cdc.compare(documents(spark, sf_dir)).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint",
        "edited_fingerprint", "near_edited", "near_next",
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the bytes they stand for."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), path)
    return bpe.decode(ids, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates met in every text."""
    return licenses.scan(documents(spark, sf_dir))


def op6_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and line counts of every text, and the tokenisers' verdict."""
    return fertility.measure(documents(spark, sf_dir).select("doc_id", "text"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that remain of every text once 100-byte repeats are removed."""
    return suffix.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts' ids, packed in rows of 2,048."""
    ids = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packing.pack(ids)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many epochs and which part of the last take each document."""
    docs = documents(spark, sf_dir).select(
        "doc_id", "lang", "source", domain_of("source").alias("domain"), word_count("text").alias("n_tokens")
    )
    return mixing.mix(docs, mixing.PATH, mixing.WEIGHTS, seed=mixing.SEED, max_epochs=mixing.MAX_EPOCHS)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every text and the group it is linked to."""
    return simhash.group(documents(spark, sf_dir)).select(
        "doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), F.col("component").alias("component_id")
    )


def op11_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text by its lines, learned from three quarters of the labels."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    model = linecrf.train(docs, labels)
    return linecrf.predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and corpus-wide link counts of every text's tokens under two tokenizers."""
    return alignment.alignments(documents(spark, sf_dir).select("doc_id", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all; every seventh has its label moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    vectors = prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", moved)
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0)


_QUERIES: dict[str, QueryFn] = {
    "pipeline": corpus_pipeline.run,
    "op1_crf_language": op1_crf_language,
    "op2_separator_scan": op2_separator_scan,
    "op3_content_chunks": op3_content_chunks,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_license_join": op5_license_join,
    "op6_fertility": op6_fertility,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_mixing": op9_mixing,
    "op10_simhash": op10_simhash,
    "op11_line_quality": op11_line_quality,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_hard_negatives": op13_hard_negatives,
}

_SQL: dict[str, str] = {
    "op5_license_join": licenses.sql(),
    "op9_mixing": mixing.sql(mixing.WEIGHTS, mixing.SEED, mixing.MAX_EPOCHS),
    "op13_hard_negatives": negatives.sql(),
}


def queries() -> dict[str, QueryFn]:
    return {name: (lambda spark, sf_dir, fn=fn: fn(configure(spark), sf_dir)) for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
