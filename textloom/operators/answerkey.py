"""Answer key: structural rules and validation against a document (EV-11, EV-12, JN-13, JN-14, AGG-18)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.labels import small


def tables(key: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions, facts) of a key read by ``sources.files.read_answer_key``."""
    each = key.select(F.posexplode("questions").alias("question_ord", "q"))
    questions = each.select("question_ord", F.col("q.id").alias("question_id"), "q.question", "q.answerable", "q.source_sections", F.col("q.min_facts_for_yes").alias("min_facts_for_yes"), "q.expected_answer", "q.notes")
    facts = each.select(F.col("q.id").alias("question_id"), F.posexplode("q.required_facts").alias("fact_ord", "f")).select("question_id", "fact_ord", "f.name", "f.section", "f.accept")
    return questions, facts


def structural_errors(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """EV-12: (question_id, error) for every rule of a key that is broken."""
    n_facts = facts.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_facts"))
    q = questions.join(n_facts, "question_id", "left").withColumn("n_facts", F.coalesce("n_facts", F.lit(0)))
    n, sections, least = F.col("n_facts"), F.size(F.coalesce("source_sections", F.array().cast("array<string>"))), F.coalesce("min_facts_for_yes", F.lit(0))
    rules = [
        (F.coalesce(F.trim("question"), F.lit("")) == "", "question is empty"),
        (~F.col("answerable") & ((n > 0) | (sections > 0) | (least > 0)), "unanswerable question has facts, sections or a minimum"),
        (F.col("answerable") & (n == 0), "no required facts"),
        (F.col("answerable") & (sections == 0), "no source sections"),
        (F.col("answerable") & (n > 0) & ((least < 1) | (least > n)), "min_facts_for_yes is out of range"),
    ]
    found = q.select("question_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in rules]))).alias("error"))
    twice = questions.groupBy("question_id").count().where("count > 1").select("question_id", F.lit("duplicate id").alias("error"))
    bad_accept = facts.where((F.size(F.coalesce("accept", F.array().cast("array<string>"))) == 0) | F.exists("accept", lambda a: F.coalesce(F.trim(a), F.lit("")) == "")).select("question_id", F.concat(F.lit("fact without accepted strings: "), F.col("name")).alias("error"))
    listed = questions.where("answerable").select("question_id", F.explode("source_sections").alias("section"))
    used = facts.select("question_id", "section").distinct()
    unlisted = used.join(questions.where("answerable").select("question_id"), "question_id").join(listed, ["question_id", "section"], "left_anti").select("question_id", F.concat(F.lit("fact of an unlisted section: "), F.col("section")).alias("error"))
    idle = listed.join(used, ["question_id", "section"], "left_anti").select("question_id", F.concat(F.lit("section without a fact: "), F.col("section")).alias("error"))
    return found.unionByName(twice).unionByName(bad_accept).unionByName(unlisted).unionByName(idle)


def document_errors(facts: DataFrame, sections: DataFrame) -> DataFrame:
    """EV-11: facts whose section has no text, and accepted strings that no text of their section holds.

    ``sections``: heading, text (``operators.sections.section_texts``); a heading may have
    several texts.  The key's strings are the query set: they meet the texts of their
    section only, and a text is normalised once.
    """
    wanted = facts.select("question_id", "section", F.explode("accept").alias("accepted"))
    texts = sections.where("text is not null").select(F.col("heading").alias("section"), T.match_normalized(F.col("text")).alias("__hay"))
    known = texts.select("section").distinct()
    needles = wanted.where("accepted is not null").select("section", "accepted", T.match_normalized(F.col("accepted")).alias("__needle")).distinct()
    found = texts.join(small(needles), "section").where(F.contains("__hay", "__needle")).select("section", "accepted").distinct()
    missing = wanted.join(known, "section", "left_anti").select("question_id", F.concat(F.lit("no section: "), F.col("section")).alias("error")).distinct()
    absent = wanted.where("accepted is not null").join(known, "section", "left_semi").join(found, ["section", "accepted"], "left_anti")
    return missing.unionByName(absent.select("question_id", F.concat_ws("", F.lit("not in section "), F.col("section"), F.lit(": "), F.col("accepted")).alias("error")))
