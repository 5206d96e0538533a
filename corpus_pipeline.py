"""The corpus pipeline: quality, language, near-duplicates, benchmark passages, then token ids.

Each stage takes ``(spark, docs, sf_dir)`` and all that its predecessor kept; ``run`` writes each stage's result as
Parquet in the shared folder and reads it again for the next.

Nulls: a null text fails the quality rules and has no language; after those stages it would be like no other text, clean,
and without ids. A null identifier is kept, the last of its group. Equal rows are near copies of each other, so one
stays. Tables without rows give none; further columns stay until the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import bpe, common, decontam, langid, quality, simhash


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules keep, and the soft rules by what their host may have."""
    return quality.keep_good(docs)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned from the labelled ones, and no stranger than those by far."""
    common.small_batches(spark)
    return langid.keep_identified(docs, public_tokenizers.path("piece_bpe_32k.model"))


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest identifier, of each group of texts that five-word shingles link at 0.8."""
    common.small_batches(spark)
    return simhash.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No contaminated documents; benchmark passages too short to condemn a document are cut out of it."""
    common.small_batches(spark)
    return decontam.decontaminate(docs, spark.read.parquet(common.table_path(sf_dir, "benchmark")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids themselves."""
    common.small_batches(spark)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.bpe_encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN, with_ids=True).drop("text")


STAGES = [
    ("quality rules", good_quality),
    ("language id", known_language),
    ("near-duplicates", no_near_duplicates),
    ("decontamination", no_benchmark),
    ("token ids", token_ids),
]

#: Fingerprints, lattices and BPE have no SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(common.table_path(sf_dir, "documents"))
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
