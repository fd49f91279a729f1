"""Corpus pipeline: quality, exact copies, near copies, benchmark leaks, token ids.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next stage's ``docs``. All but
the last return the columns of ``documents``. Each stage's module defines the results for
nulls, empty and very long texts, repeated rows and empty tables; ``sf_dir`` only serves the
side tables (``labels``, ``benchmark``) and the classifier's training texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from polargrain.llm import decontaminate, exact_dedup, near_copies as similar_texts, piece_codec, quality_crf
from polargrain.llm.common import cut, release, table


def _small_batches(spark: SparkSession) -> None:
    """From now on the session hands texts to Python workers in batches of about 4 MB.

    All stages run in the same workers and JVMs, which keep the memory of their largest batch.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF, trained on the labelled documents, does not reject."""
    _small_batches(spark)
    model = quality_crf.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_crf.accepted(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts, that with the largest doc_id."""
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by five-word Jaccard >= 0.8, that with the least doc_id."""
    return similar_texts.representatives(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    _small_batches(spark)
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document, and whether they decode to its text."""
    import public_tokenizers

    _small_batches(spark)
    return piece_codec.encoded_documents(docs, str(public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark_leaks),
    ("sentencepiece", token_ids),
]
#: Trained weights, XXH64 and the tokenizer have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs, held = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}", lean=True)
        if held is not None:
            release(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
