"""Corpora, questions, facts and labels derived from the fixture tables.

The fixtures hold prose without headings, so Markdown is built from them: a document
per conversation (short sibling sections) and a document per text (one long section).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T

RUNS = [("A-300", 300, 30), ("A-500", 500, 50), ("A-800", 800, 80)]
#: Every row whose id is divisible by this is a query of a search.
QUERY_EVERY = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversations_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): # Conversation, ## Turn, text; one document per conversation."""
    turns = table(spark, sf_dir, "conversations")
    part = F.concat(F.lit("## Turn "), F.col("turn").cast("string"), F.lit(" "), F.col("role"), F.lit("\n\n"), F.col("text"), F.lit("\n\n"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", part.alias("part"))))
    docs = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "").alias("body"))
    return docs.select("doc_id", T.normalized(F.concat(F.lit("# Conversation "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.col("body"))).alias("text"))


def documents_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): # source, ## lang, ### Doc, text; one document per text."""
    docs = table(spark, sf_dir, "documents")
    text = F.concat(F.lit("# "), F.col("source"), F.lit("\n\n## "), F.col("lang"), F.lit("\n\n### Doc "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.col("text"), F.lit("\n"))
    return docs.select("doc_id", T.normalized(text).alias("text"))


def dirty_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with foreign line ends, trailing blanks and long runs of empty lines."""
    text = F.concat(F.replace(F.col("text"), F.lit("\n"), F.lit(" \t\r\n\r\n\n\r")), F.lit("  \n\n\n\n\n end\t\r"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, queries): all vectors as chunks, those with an id divisible by QUERY_EVERY as queries."""
    rows = table(spark, sf_dir, "embeddings")
    chunks = rows.select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("vector"), "label")
    queries = rows.where(F.col("vec_id") % QUERY_EVERY == 0).select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"), "label")
    return chunks, queries


def benchmark_key(spark: SparkSession, sf_dir: str, per_question: int = 4) -> tuple[DataFrame, DataFrame]:
    """(questions, facts): benchmark passages as facts, ``per_question`` of them to a question; every seventh has no answer."""
    items = table(spark, sf_dir, "benchmark")
    question = F.floor(F.col("item_id") / per_question).cast("long")
    answerable = F.lit(7) != question % 7 + 1
    facts = items.where(answerable).select(
        F.concat(F.lit("Q"), question.cast("string")).alias("question_id"),
        (F.col("item_id") % per_question).cast("int").alias("fact_ord"),
        F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("name"),
        F.concat(F.lit("S"), (F.col("item_id") % 2).cast("string")).alias("section"),
        F.array("text").alias("accept"),
    )
    questions = items.select(question.alias("n"), (F.col("item_id") % 2).alias("s")).groupBy("n").agg(F.array_sort(F.collect_set(F.concat(F.lit("S"), F.col("s").cast("string")))).alias("found"))
    can = F.lit(7) != F.col("n") % 7 + 1
    return questions.select(
        F.concat(F.lit("Q"), F.col("n").cast("string")).alias("question_id"),
        F.concat(F.lit("What does passage group "), F.col("n").cast("string"), F.lit(" say?")).alias("question"),
        can.alias("answerable"),
        F.when(can, F.col("found")).otherwise(F.array().cast("array<string>")).alias("source_sections"),
        F.when(can, F.lit(2)).otherwise(F.lit(0)).alias("min_facts_for_yes"),
    ), facts


def answers(spark: SparkSession, sf_dir: str, generation: int = 1) -> DataFrame:
    """Assistant turns as answers; every third is a refusal, and the second generation changes every fifth."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    said = F.when(F.col("turn") % 3 == 0, F.lit("The document does not contain this information.")).otherwise(F.col("text"))
    if generation == 2:
        said = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("Again: "), F.col("text"))).otherwise(said)
    return rows.select(
        F.concat(F.lit("run"), (F.col("conv_id") % 3).cast("string")).alias("run_id"),
        F.concat(F.lit("Q"), (F.col("conv_id") * 100 + F.col("turn")).cast("string")).alias("question_id"),
        said.alias("answer"),
        F.array(F.col("conv_id").cast("string")).alias("context_ids"),
    )


def review_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review table over documents: labels of three layers, some blank."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    pick = lambda n, k: F.element_at(F.array(*[F.lit(x) for x in ("yes", "partial", "no")]), ((n + k) % 3 + 1).cast("int"))
    final = F.when(F.col("quality") == 1, F.lit("yes")).when(F.col("quality") == 0, F.lit(" no ")).otherwise(F.lit(""))
    return rows.select(
        F.col("source").alias("run_id"),
        F.col("lang"),
        F.col("doc_id").alias("question_id"),
        final.alias("retrieval_label_final"),
        F.when(F.col("doc_id") % 4 == 0, pick(F.col("doc_id"), 1)).otherwise(F.lit(" ")).alias("retrieval_label_suggested"),
        pick(F.col("doc_id"), 0).alias("retrieval_auto"),
        F.when(F.col("doc_id") % 6 == 0, F.lit("no")).otherwise(F.lit("")).alias("answer_label"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("partial")).otherwise(F.lit("")).alias("answer_label_suggested"),
        pick(F.col("doc_id"), 2).alias("answer_auto"),
    )
