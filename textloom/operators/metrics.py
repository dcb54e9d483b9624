"""Metrics over labels, hits and answers (AGG-3 to AGG-9, AGG-11, AGG-19, AGG-20, EV-9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T

LAYERS = ["final", "suggested", "auto"]


def rounded(value: Column, digits: int) -> Column:
    """SC-18: half to even on the decimal form (ties differ from binary rounding only in reports)."""
    return F.bround(value, digits)


def first_relevant(hits: DataFrame, by: list[str]) -> DataFrame:
    """WIN-3: rank of the first relevant hit per question, null without one."""
    return hits.groupBy(*by).agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_rank"))


def hit_at_1(rank: Column) -> Column:
    """AGG-5."""
    return F.avg(F.when(rank == 1, 1.0).otherwise(0.0))


def mean_reciprocal_rank(rank: Column) -> Column:
    """AGG-6."""
    return F.avg(F.coalesce(1.0 / rank, F.lit(0.0)))


def accuracy(label: Column) -> Column:
    """AGG-7: mean score in percent; null without rows or if any label has no score."""
    score = T.label_score(label)
    return F.when((F.count_if(score.isNull()) == 0) & (F.count(F.lit(1)) > 0), 100 * F.avg(score))


def label_sources(source: Column) -> list[Column]:
    """AGG-8: how many labels each layer decided."""
    return [F.count_if(source == s).alias(f"{s}_labels") for s in LAYERS]


def resolved(review: DataFrame) -> DataFrame:
    """SC-27 for a review table: retrieval and answer labels with the layer they come from."""
    r = T.first_label(("final", F.col("retrieval_label_final")), ("suggested", F.col("retrieval_label_suggested")), ("auto", F.col("retrieval_auto")))
    a = T.first_label(("final", F.col("answer_label")), ("suggested", F.col("answer_label_suggested")), ("auto", F.col("answer_auto")))
    return review.withColumn("retrieval", r[0]).withColumn("retrieval_source", r[1]).withColumn("answer_resolved", a[0]).withColumn("answer_source", a[1])


def run_metrics(review: DataFrame, questions: DataFrame, hits: DataFrame, stats: DataFrame, contexts: DataFrame, by: str = "run_id") -> DataFrame:
    """EV-9: one row per run.

    ``hits`` carry ``relevant``; accuracy of retrieval and its rank metrics run over the answerable
    questions, accuracy of answers over all, and the mean context over all questions.
    """
    rows = resolved(review).join(questions.select("question_id", "answerable"), "question_id")
    can = F.col("answerable")
    scored = lambda label, which: F.when((F.count_if(which & T.label_score(label).isNull()) == 0) & (F.count_if(which) > 0), 100 * F.avg(F.when(which, T.label_score(label))))
    answered = F.bool_or(F.coalesce("answer", F.lit("")) != "")
    out = rows.groupBy(by).agg(
        scored(F.col("retrieval"), can).alias("retrieval_accuracy"),
        scored(F.col("retrieval_auto"), can).alias("retrieval_accuracy_auto"),
        F.when(answered, accuracy(F.col("answer_resolved"))).alias("answer_accuracy"),
        F.when(answered, accuracy(F.col("answer_auto"))).alias("answer_accuracy_auto"),
        *[F.count_if(can & (F.col("retrieval_source") == s)).alias(f"retrieval_{s}") for s in LAYERS],
        *[F.when(answered, F.count_if(F.col("answer_source") == s)).alias(f"answer_{s}") for s in LAYERS],
        answered.alias("answered"),
        F.bool_or((can & (F.col("retrieval_source") != "final"))).alias("__open"),
        F.bool_or(F.col("answer_source") != "final").alias("__open_answers"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("question_id", F.struct("retrieval", F.nullif("answer_resolved", F.lit("")).alias("answer")))))).alias("per_question"),
    )
    out = out.withColumn("provisional", F.col("__open") | (F.col("answered") & F.col("__open_answers"))).drop("__open", "__open_answers")
    ranks = first_relevant(hits.join(questions.where("answerable").select("question_id"), "question_id"), [by, "question_id"])
    out = out.join(ranks.groupBy(by).agg(hit_at_1(F.col("first_rank")).alias("hit_at_1"), mean_reciprocal_rank(F.col("first_rank")).alias("mrr")), by, "left")
    out = out.join(contexts.groupBy(by).agg(F.avg("context_tokens").alias("mean_context_tokens")), by, "left")
    return out.join(stats, by, "left")
