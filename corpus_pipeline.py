"""A training-data pipeline over ``documents``: five stages, each one operator of textloom.llm.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but
the last return the columns of ``documents``.  Their results are written to
the shared folder and read again, so a lost executor never reaches back past the stage
before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import neardup, packing, quality, rules, substrings
from textloom.llm.common import BATCH_BYTES, discard, stored
from textloom.llm.queries import vocabulary

#: Near-duplicates: shingles of five words, Jaccard likeness of 0.8 or more.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session stay small: a stage holds whole texts on both sides of the pipe."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier, learnt from the labelled rows, scores as good."""
    bound_batches(spark)
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what passes the document rules and whose host passes."""
    bound_batches(spark)
    return rules.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near-duplicates."""
    bound_batches(spark)
    return neardup.keep_one(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut byte strings of 50 that an earlier document has; the documents stay."""
    bound_batches(spark)
    return substrings.strip(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised texts with their sequences of 2048."""
    bound_batches(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality", classify),
    ("rules", apply_rules),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("packing", pack),
]

#: No SQL: the classifier, the signatures and the tokenizer have none; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
            discard(before)
    return docs
