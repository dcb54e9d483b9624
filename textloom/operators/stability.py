"""Two generations of answers compared (EV-10, JN-12, AGG-12, AGG-13, FLT-11, FLT-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import labels, metrics


def paired(first: DataFrame, second: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Answers of both generations side by side; runs that lack one are left out.

    Fails when a run's contexts differ: then it is not the answers that are compared.
    """
    by = by or ["run_id", "question_id"]
    a = first.select(*by, F.col("answer").alias("answer_1"), F.col("context_ids").alias("context_1"))
    b = second.select(*by, F.col("answer").alias("answer_2"), F.col("context_ids").alias("context_2"))
    out = a.join(b, by)
    same = F.assert_true(F.col("context_1").eqNullSafe(F.col("context_2")), F.concat(F.lit("contexts differ: "), F.concat_ws(" ", *by)))
    return out.where(same.isNull()).drop("context_1", "context_2")


def compare(first: DataFrame, second: DataFrame, questions: DataFrame, facts: DataFrame, forbidden: str | None = None, by: str = "run_id") -> DataFrame:
    """Per run: accuracy of each generation, their difference, changed texts and flipped labels."""
    key = [by, "question_id"]
    rows = paired(first, second, key)
    for n in ("1", "2"):
        got = labels.answer_labels(rows.select(*key, F.col(f"answer_{n}").alias("answer")), questions, facts, key, forbidden=forbidden)
        rows = rows.join(got.select(*key, F.col("label").alias(f"label_{n}")), key)
    flips = F.array_sort(F.collect_list(F.when(F.col("label_1") != F.col("label_2"), F.concat("question_id", F.lit(" "), F.col("label_1"), F.lit("→"), F.col("label_2")))))
    out = rows.groupBy(by).agg(
        metrics.accuracy(F.col("label_1")).alias("accuracy_1"),
        metrics.accuracy(F.col("label_2")).alias("accuracy_2"),
        F.count_if(F.trim("answer_1") != F.trim("answer_2")).alias("changed_texts"),
        F.count(F.lit(1)).alias("questions"),
        F.array_join(flips, ", ").alias("flips"),
    )
    return out.withColumn("delta", F.bround("accuracy_2", 1) - F.bround("accuracy_1", 1))
