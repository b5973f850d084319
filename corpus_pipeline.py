"""A cleaning pipeline of the corpus operators; each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reconweave.llm import decontaminate, langid, minhash, packing, substring
from reconweave.llm.queries import WORD_BPE, tokenizer_path
from reconweave.llm.scratch import Scratch, bounded_batches

#: A document goes if the language of most of its letters has a smaller part of them.
LEAST_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or with no language that half of their letters are in, go.

    Null and empty texts have no letters.  Each row is judged by its own text, so rows
    that repeat go or stay together; an empty table stays empty.
    """
    bounded_batches(spark)
    return langid.with_language(docs, langid.train(docs.filter(~langid.held_out())), LEAST_LANGUAGE_SCORE)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, 0.8.

    Of rows with one id and text one stays; texts without words all stay.
    """
    bounded_batches(spark)
    return minhash.keep_one(docs, spark)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages stay in the first document that has them and are cut out of the others.

    A document of which nothing is left goes; null and empty texts stay.  Rows that
    share an id are each cut by their own text.
    """
    bounded_batches(spark)
    return substring.without_repeats(docs, spark)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go, each row by its own text; null and empty texts stay."""
    bounded_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that stay, packed into sequences of 4096 tokens.

    A null or empty text is a piece of the end token alone; repeated rows are
    documents of their own; an empty table gives no pieces.
    """
    bounded_batches(spark)
    return packing.pack_documents(docs, spark, tokenizer_path(WORD_BPE))


STAGES = [
    ("language_id", language_id),
    ("minhash_dedup", minhash_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Language models, hash signatures and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
