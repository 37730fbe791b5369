"""The corpus pipeline: documents through five stages, each written and read again before the next.

Every stage but the last returns the columns of documents. Stages that run Python take Arrow batches of few rows, so that
the workers of an executor, which live on from stage to stage, hold little beside its heap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetops.llm import jaccard, lang_id, mixing, packing, substring
from fleetops.llm.runtime import carried, small_batches, stored, unpacked


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; the others go. Learned from the labels of two thirds of them."""
    small_batches(spark)
    model = lang_id.fit(lang_id.labelled_part(docs))
    return lang_id.known_documents(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: at least 0.8 alike in five-word shingles."""
    small_batches(spark)
    return jaccard.one_of_each(docs, n=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words or more that repeat; documents made of nothing else go."""
    small_batches(spark)
    used = ["doc_id", "text"]
    done = substring.remove_repeats(carried(docs, used))
    left = done.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return unpacked(left, docs.columns, used).withColumn("n_chars", F.char_length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeated or left out by systematic sampling."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language", known_language),
    ("near copies", near_copies),
    ("passages", passages),
    ("mixing", mixed),
    ("packing", packed),
]

# Language models, similarity joins and packing are not SQL; the tests hold the stages against brute force, and that
# of languages by its decoder and by texts in languages that were and were not learned.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
