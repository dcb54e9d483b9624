"""Fact matching and automatic labels (EV-1 to EV-5, AGG-10, JN-9, JN-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T

#: Facts up to this count are broadcast (a key is written by hand; about 1 KB a fact).
BROADCAST_FACTS = 20_000


def small(facts: DataFrame) -> DataFrame:
    """Facts, broadcast if there are few; the count is checked."""
    return F.broadcast(facts) if facts.limit(BROADCAST_FACTS + 1).count() <= BROADCAST_FACTS else facts


def holds(text: Column, accepted: Column) -> Column:
    """FLT-14: a normalised text holds any of the accepted strings (normalised too)."""
    return F.exists(accepted, lambda a: F.contains(text, a))


def prepared_facts(facts: DataFrame) -> DataFrame:
    """Facts with their accepted strings in match form."""
    return facts.withColumn("accept_norm", F.transform("accept", T.match_normalized))


def fact_matches(texts: DataFrame, facts: DataFrame, by: list[str], text_col: str = "text") -> DataFrame:
    """EV-1 over texts that belong to a question: one row per (by, fact_ord) that any text holds.

    ``texts``: by columns (question_id among them) and a text; ``facts``: question_id, fact_ord, name,
    section, accept.  A text is normalised once; facts never match across two texts.
    """
    hay = texts.select(*by, T.match_normalized(F.coalesce(text_col, F.lit(""))).alias("__hay"))
    pairs = hay.join(small(prepared_facts(facts)), "question_id")
    return pairs.where(holds(F.col("__hay"), F.col("accept_norm"))).groupBy(*by, "fact_ord").agg(F.first("name").alias("name"), F.first("section").alias("section"))


def matched_facts(matches: DataFrame, by: list[str]) -> DataFrame:
    """AGG-10: number, sections and names (in key order) of the matched facts."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("fact_ord", "name"))), lambda x: x["name"])
    return matches.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("n_matched"), F.array_sort(F.collect_set("section")).alias("sections"), names.alias("matched"))


def rule(n_matched: Column, sections: Column, min_facts: Column, source_sections: Column) -> Column:
    """EV-2: yes if enough facts match and every source section is covered, partial if any does."""
    covered = F.size(F.array_except(source_sections, F.coalesce(sections, F.array().cast("array<string>")))) == 0
    n = F.coalesce(n_matched, F.lit(0))
    return F.when((n >= min_facts) & covered, F.lit("yes")).when(n >= 1, F.lit("partial")).otherwise(F.lit("no"))


def _rows(texts: DataFrame, questions: DataFrame, facts: DataFrame, by: list[str], text_col: str) -> DataFrame:
    found = matched_facts(fact_matches(texts, facts, by, text_col), by)
    every = texts.select(*by).distinct().join(F.broadcast(questions.select("question_id", "answerable", "min_facts_for_yes", "source_sections")) if questions.limit(BROADCAST_FACTS + 1).count() <= BROADCAST_FACTS else questions, "question_id")
    return every.join(found, by, "left").withColumn("matched", F.coalesce("matched", F.array().cast("array<string>")))


def retrieval_labels(bodies: DataFrame, questions: DataFrame, facts: DataFrame, by: list[str] | None = None, body_col: str = "body") -> DataFrame:
    """EV-3: label of each question's context (one row per chunk body); N/A if it has no answer."""
    by = by or ["question_id"]
    rows = _rows(bodies, questions, facts, by, body_col)
    label = F.when(~F.col("answerable"), F.lit("N/A")).otherwise(rule(F.col("n_matched"), F.col("sections"), F.col("min_facts_for_yes"), F.col("source_sections")))
    return rows.select(*by, label.alias("label"), "matched")


def answer_labels(answers: DataFrame, questions: DataFrame, facts: DataFrame, by: list[str] | None = None, answer_col: str = "answer", forbidden: str | None = None) -> DataFrame:
    """EV-4: label of each answer; ``forbidden`` is the pattern a refusal must not quote (SC-20)."""
    by = by or ["question_id"]
    rows = _rows(answers, questions, facts, by, answer_col).join(answers.select(*by, F.coalesce(answer_col, F.lit("")).alias("__answer")), by)
    refused = T.refuses(F.col("__answer"))
    clean = refused & ~F.col("__answer").rlike(forbidden) if forbidden else refused
    label = (
        F.when(~F.col("answerable"), F.when(clean, F.lit("yes")).otherwise(F.lit("no")))
        .when(refused, F.lit("no"))
        .otherwise(rule(F.col("n_matched"), F.col("sections"), F.col("min_facts_for_yes"), F.col("source_sections")))
    )
    none = F.array().cast("array<string>")  # a refusal states no facts
    return rows.select(*by, label.alias("label"), F.when(refused | ~F.col("answerable"), none).otherwise(F.col("matched")).alias("matched"))


def relevant_hits(hits: DataFrame, bodies: DataFrame, facts: DataFrame, by: list[str]) -> DataFrame:
    """EV-5, JN-10: hits with ``relevant``: the chunk's body holds a fact of the question."""
    rows = hits.join(bodies.select("chunk_id", "body"), "chunk_id")
    found = fact_matches(rows, facts, [*by, "chunk_id"], "body").select(*by, "chunk_id").distinct().withColumn("relevant", F.lit(True))
    return hits.join(found, [*by, "chunk_id"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))
