"""Corpus pipeline: documents to token counts, each stage on all that the one before it kept.

Every stage is ``f(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``. Null and
empty texts, repeated rows and empty tables are handled as each operator's docstring says:
quality scores an empty text as the curve does at 0; near-duplicates and repeats leave it alone;
the mix leaves it as it is; it has no tokens.

Whole texts go to Python in small Arrow batches. These are a setting of the session while a job runs, so a
stage that would hand its Python step on unfinished writes its result itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm import bpe, minhash, mixing, quality, suffix
from tidepanel.llm.common import small_batches, table
from tidepanel.session import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is high enough; the model is fitted on labelled rows of ``docs``."""
    with small_batches(spark):
        return written(quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels"))), "accepted")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8."""
    return minhash.one_of_each(docs, words=5, percent=80)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that occur at several places."""
    return suffix.without_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of token numbers and decoded text."""
    import public_tokenizers

    with small_batches(spark):
        return written(bpe.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"), tokens=False), "tokens")


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", repeat_stage),
    ("mixing to target weights", mixing_stage),
    ("bpe encoding and decoding", token_stage),
]

ORACLE_SQL = None  # SQL cannot express the classifier or the tokenizer; the tests compare run() and its stages with plain Python (the mix: its rows with its takings)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
