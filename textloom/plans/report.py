"""Report tables and documents from the tables of an experiment (RP-1 to RP-8, AGG-9, JN-17, JN-18).

Tables are built as DataFrames; only their few rows (one per run or question) come to
the driver to be written as Markdown.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import inspection, metrics


def markdown(rows: Iterable[Sequence[Any]], head: Sequence[str]) -> str:
    """A Markdown table; nulls as a dash, bars escaped."""
    cell = lambda v: "—" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"| {' | '.join(head)} |", f"|{'---|' * len(head)}"]
    return "\n".join([*lines, *(f"| {' | '.join(cell(v) for v in r)} |" for r in rows)])


def rows_of(df: DataFrame) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def summary(found: DataFrame, runs: DataFrame) -> DataFrame:
    """RP-1: chunks, sizes and metrics of each run, in the order of the runs."""
    pct = lambda c: T.percentage(F.bround(c, 1))
    return runs.select("run_id", "strategy").join(found, "run_id").orderBy("run_id").select(
        "run_id", "strategy", "chunks", F.bround("mean_tokens", 1).alias("avg_tokens"), F.concat_ws("–", "min_tokens", "max_tokens").alias("range"), F.bround("redundancy", 2).alias("redundancy"),
        F.bround("mean_context_tokens", 1).alias("context_tokens"), pct("retrieval_accuracy").alias("retrieval"), F.bround("hit_at_1", 3).alias("hit_at_1"), F.bround("mrr", 3).alias("mrr"), pct("answer_accuracy").alias("answers"),
    )


SUMMARY_HEAD = ["Run", "Strategy", "Chunks", "Avg size (tok)", "Range", "Redundancy", "Context (tok)", "Retrieval acc.", "Hit@1", "MRR", "Answer acc."]


def boundaries(cuts: DataFrame) -> DataFrame:
    """RP-2: where chunks were cut, sentence ends pooled with other places in running text."""
    found = inspection.cut_summary(cuts, ["run_id"])
    return found.select("run_id", "clean", "heading", "list_item", "table_row", (F.col("mid_sentence") + F.col("sentence_end")).alias("in_prose"), "mid_word").orderBy("run_id")


BOUNDARY_HEAD = ["Run", "Clean", "Heading", "List item", "Table row", "In prose", "Mid-word"]


def question_labels(review: DataFrame, columns: Sequence[str] = ("context_ids",)) -> DataFrame:
    rows = metrics.resolved(review)
    return rows.select("run_id", "question_id", *columns, T.shown_label(F.nullif("retrieval", F.lit(""))).alias("retrieval"), T.shown_label(F.nullif("answer_resolved", F.lit(""))).alias("answer"))


def headline(review: DataFrame, a: str, b: str) -> DataFrame:
    """RP-3, JN-17: two runs side by side, question by question."""
    rows = question_labels(review)
    side = lambda run, n: rows.where(F.col("run_id") == run).select("question_id", *[F.col(c).alias(f"{c}_{n}") for c in ("context_ids", "retrieval", "answer")])
    return side(a, 1).join(side(b, 2), "question_id", "full").orderBy("question_id")


def ablation(review: DataFrame, run_ids: Sequence[str]) -> DataFrame:
    """RP-4, JN-18: retrieval and answer labels of several runs per question."""
    rows = question_labels(review).where(F.col("run_id").isin(list(run_ids)))
    cell = F.concat_ws(" / ", "retrieval", "answer")
    return rows.groupBy("question_id").pivot("run_id", list(run_ids)).agg(F.first(cell)).orderBy("question_id")


def appendix(review: DataFrame, width: int = 160) -> DataFrame:
    """RP-5: every answer on a line, with the reviewer's note before the suggestion's reason."""
    note = F.coalesce(F.nullif(F.trim("notes"), F.lit("")), F.nullif(F.trim("suggestion_reason"), F.lit("")))
    rows = metrics.resolved(review).where("answer <> ''")
    return rows.select("question_id", "run_id", T.one_line(F.col("answer"), width, True).alias("answer"), F.col("answer_resolved").alias("label"), T.one_line(note, width, True).alias("note")).orderBy("question_id", "run_id")


def provenance(found: DataFrame) -> str:
    """RP-6, AGG-9: one sentence on who gave the labels."""
    sums = found.agg(*[F.sum(F.coalesce(f"retrieval_{s}", F.lit(0)) + F.coalesce(f"answer_{s}", F.lit(0))).alias(s) for s in metrics.LAYERS]).first()
    final, suggested, auto = (int(sums[s] or 0) for s in metrics.LAYERS)
    if not suggested and not auto:
        return f"All {final} labels were given by a reviewer."
    if not final:
        return f"No label has been reviewed yet: {suggested} are suggested and {auto} automatic, so the figures are provisional."
    return f"{final} labels were given by a reviewer, {suggested} are suggested and {auto} automatic; figures are provisional until all are reviewed."


def comparison(found: DataFrame, runs: DataFrame, cuts: DataFrame, review: DataFrame, pair: tuple[str, str], ablations: dict[str, Sequence[str]]) -> str:
    """RP-7: the comparison document; the same tables give the same bytes."""
    a, b = pair
    parts = ["# Comparison of chunking runs", provenance(found), "## Summary", markdown(rows_of(summary(found, runs)), SUMMARY_HEAD), "## Boundaries", markdown(rows_of(boundaries(cuts)), BOUNDARY_HEAD)]
    parts += [f"## {a} and {b}", markdown(rows_of(headline(review, a, b)), ["Question", f"{a}: chunks (rank order)", "Retrieval", "Answer", f"{b}: chunks (rank order)", "Retrieval", "Answer"])]
    for title, ids in ablations.items():
        parts += [f"## {title}", markdown(rows_of(ablation(review, ids)), ["Question", *ids])]
    parts += ["## Answers", markdown(rows_of(appendix(review)), ["Question", "Run", "Answer", "Label", "Note"])]
    return "\n\n".join(parts) + "\n"


def readme_block(found: DataFrame, runs: DataFrame, review: DataFrame, pair: tuple[str, str]) -> str:
    """RP-7: the summary and the headline table for a README."""
    a, b = pair
    return "\n\n".join([provenance(found), markdown(rows_of(summary(found, runs)), SUMMARY_HEAD), markdown(rows_of(headline(review, a, b)), ["Question", f"{a}: chunks (rank order)", "Retrieval", "Answer", f"{b}: chunks (rank order)", "Retrieval", "Answer"])])


def stability_document(compared: DataFrame) -> str:
    """SNK-10: accuracy of two generations per run."""
    signed = F.format_string("%+.1f", "delta")
    rows = compared.orderBy("run_id").select("run_id", T.percentage(F.col("accuracy_1")), T.percentage(F.col("accuracy_2")), signed, F.concat_ws("/", "changed_texts", "questions"), F.when(F.col("flips") == "", F.lit("none")).otherwise(F.col("flips")))
    return "# Answer stability\n\n" + markdown(rows_of(rows), ["Run", "First", "Second", "Δ", "Changed texts", "Label flips"]) + "\n"


def walkthrough(found: DataFrame, runs: DataFrame, cuts: DataFrame, review: DataFrame, question_id: str) -> str:
    """RP-8, SNK-11: a read-only tour of an experiment on one question."""
    rows = metrics.resolved(review).where(F.col("question_id") == question_id).orderBy("run_id")
    shown = rows_of(rows.select("run_id", "question", "context_ids", "retrieval", T.one_line(F.col("answer"), 70), "answer_resolved"))
    lines = ["Summary", markdown(rows_of(summary(found, runs)), SUMMARY_HEAD), "", "Cuts", markdown(rows_of(boundaries(cuts)), BOUNDARY_HEAD), ""]
    if shown:
        lines += [f"Question {question_id}: {shown[0][1]}", *(f"  {r[0]}: {r[2]} -> {r[3]}; {r[4]} -> {r[5]}" for r in shown), ""]
    best = found.orderBy(F.desc_nulls_last("retrieval_accuracy"), "run_id").select("run_id", T.percentage(F.bround("retrieval_accuracy", 1))).first()
    lines += ["Takeaways", f"- best retrieval: {best[0]} with {best[1]}" if best else "- no runs", f"- {provenance(found)}"]
    return "\n".join(lines) + "\n"
