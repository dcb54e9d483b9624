"""Review table: automatic labels, suggestions and manual labels (EV-6 to EV-8, JN-3 to JN-8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import labels

#: Columns of a review file, in order; all are strings.
COLUMNS = [
    "question_id", "question", "context_ids", "context_tokens", "retrieval_auto", "facts_in_context", "answer", "answer_auto",
    "facts_in_answer", "retrieval_label_suggested", "answer_label_suggested", "suggestion_reason", "retrieval_label_final", "answer_label", "notes",
]
MANUAL = ["retrieval_label_final", "answer_label", "notes"]
MANUAL_LABELS = ["", "yes", "partial", "no", "N/A"]


def context_bodies(contexts: DataFrame, chunks: DataFrame, by: list[str]) -> DataFrame:
    """JN-3, JN-4: the bodies of each context in rank order."""
    parts = contexts.select(*by, F.posexplode("context_ids").alias("position", "chunk_id"))
    return parts.join(chunks.select(*[c for c in by if c in chunks.columns], "chunk_id", "body"), [*[c for c in by if c in chunks.columns], "chunk_id"])


def build_rows(contexts: DataFrame, chunks: DataFrame, questions: DataFrame, facts: DataFrame, answers: DataFrame | None, by: list[str] | None = None, forbidden: str | None = None) -> DataFrame:
    """EV-6: a review row per question with its automatic labels; other columns empty."""
    by = by or ["run_id", "question_id"]
    bodies = context_bodies(contexts, chunks, by)
    ctx = labels.retrieval_labels(bodies, questions, facts, by).select(*by, F.col("label").alias("retrieval_auto"), F.array_join("matched", "; ").alias("facts_in_context"))
    out = contexts.select(*by, F.array_join("context_ids", " ").alias("context_ids"), F.col("context_tokens").cast("string").alias("context_tokens"))
    out = out.join(questions.select("question_id", "question"), "question_id").join(ctx, by, "left")
    if answers is None:
        out = out.withColumns({c: F.lit("") for c in ("answer", "answer_auto", "facts_in_answer")})
    else:
        judged = labels.answer_labels(answers, questions, facts, by, forbidden=forbidden).select(*by, F.col("label").alias("answer_auto"), F.array_join("matched", "; ").alias("facts_in_answer"))
        out = out.join(answers.select(*by, "answer"), by, "left").join(judged, by, "left")
    for c in COLUMNS:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in out.columns else out.withColumn(c, F.lit(""))
    return out.select(*[c for c in by if c not in COLUMNS], *COLUMNS)


def apply_suggestions(rows: DataFrame, suggestions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """EV-7: suggested labels where the context and the answer are still those that were judged.

    A suggestion that no longer fits is left out and its reason says what changed.
    """
    by = by or ["run_id", "question_id"]
    given = suggestions.select(*by, *[F.col(c).alias(f"__{c}") for c in ("retrieval", "answer", "reason", "context_ids", "answer_sha256")])
    out = rows.join(given, by, "left")
    same_context = F.col("context_ids").eqNullSafe(F.col("__context_ids"))
    same_answer = T.digest(F.col("answer")).eqNullSafe(F.col("__answer_sha256"))
    r, a = F.coalesce("__retrieval", F.lit("")), F.coalesce("__answer", F.lit(""))
    changed = F.concat_ws(" and ", F.when((r != "") & ~same_context, F.lit("context")), F.when((a != "") & ~same_answer, F.lit("answer")))
    reason = F.coalesce("__reason", F.lit(""))
    reason = F.when(changed != "", F.concat(F.lit("[not applied: the "), changed, F.lit(" changed since review] "), reason)).otherwise(reason)
    known = F.col("__reason").isNotNull()
    out = out.withColumn("retrieval_label_suggested", F.when(known, F.when(same_context, r).otherwise(F.lit(""))).otherwise(F.col("retrieval_label_suggested")))
    out = out.withColumn("answer_label_suggested", F.when(known, F.when(same_answer, a).otherwise(F.lit(""))).otherwise(F.col("answer_label_suggested")))
    out = out.withColumn("suggestion_reason", F.when(known, reason).otherwise(F.col("suggestion_reason")))
    return out.select(*rows.columns)


def keep_manual(rows: DataFrame, previous: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """EV-8: manual columns of the previous review kept; and warnings where what they judged changed."""
    by = by or ["run_id", "question_id"]
    old = previous.select(*by, *[F.col(c).alias(f"__{c}") for c in [*MANUAL, "context_ids", "answer"]])
    joined = rows.join(old, by, "left")
    out = joined.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in MANUAL})
    context = (F.coalesce("__retrieval_label_final", F.lit("")) != "") & (F.col("__context_ids") != F.col("context_ids"))
    answer = (F.coalesce("__answer_label", F.lit("")) != "") & (F.col("__answer") != F.col("answer"))
    warned = joined.where(context | answer).select(*by, F.array_compact(F.array(F.when(context, F.lit("context")), F.when(answer, F.lit("answer")))).alias("changed"))
    return out.select(*rows.columns), warned


def bad_manual_labels(review: DataFrame) -> DataFrame:
    """Rows whose manual labels are outside the domain."""
    bad = F.lit(False)
    for c in ("retrieval_label_final", "answer_label"):
        bad |= ~F.trim(F.coalesce(c, F.lit(""))).isin(MANUAL_LABELS)
    return review.where(bad)
