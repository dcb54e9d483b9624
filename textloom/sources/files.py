"""Readers and writers of documents, keys and run artefacts (SRC-*, SNK-*).

Tables are Parquet, partitioned by run where there are runs; the small reviewable
artefacts keep their text formats.  Writers that need one byte-stable file take rows
that fit a driver by nature (a review has one row per question).
"""

from __future__ import annotations

import csv
import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import review as review_ops

KEY_SCHEMA = (
    "version int, status string, scoring struct<labels:map<string,double>,yes_rule:string,partial_rule:string,matching:string>, "
    "questions array<struct<id:string,question:string,answerable:boolean,source_sections:array<string>,"
    "required_facts:array<struct<name:string,accept:array<string>,section:string>>,min_facts_for_yes:int,expected_answer:string,notes:string>>"
)
SUGGESTION = "struct<retrieval:string,answer:string,reason:string,context_ids:string,answer_sha256:string>"
ANSWERS_SCHEMA = "run_id string, model string, temperature double, system_prompt_sha256 string, answers array<struct<id:string,question:string,context_ids:array<string>,sources:map<string,string>,answer:string,latency_s:double>>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1: whole text files, normalised: (path, text)."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    return raw.select("path", T.normalized(F.col("raw")).alias("text"))


def read_answer_key(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: the key as one row; a malformed file fails."""
    return spark.read.schema(KEY_SCHEMA).json(path, multiLine=True, mode="FAILFAST")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4: one row per answer of the answer files below ``path``."""
    each = spark.read.schema(ANSWERS_SCHEMA).json(path, multiLine=True, mode="FAILFAST", recursiveFileLookup=True, pathGlobFilter="answers.json")
    return each.select("run_id", "model", F.explode("answers").alias("a")).select("run_id", "model", F.col("a.id").alias("question_id"), "a.question", "a.context_ids", "a.sources", "a.answer", "a.latency_s")


def read_artefact(spark: SparkSession, path: str, schema: str, optional: bool = False) -> DataFrame:
    """SRC-4, SRC-7: a JSON artefact with a stated schema; a missing optional one is empty."""
    if optional and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: a review file, all columns strings, empty instead of null; manual labels checked."""
    schema = ", ".join(f"{c} string" for c in review_ops.COLUMNS)
    rows = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False, mode="FAILFAST").na.fill("")
    bad = review_ops.bad_manual_labels(rows).select("question_id").limit(5).collect()
    if bad:
        raise ValueError(f"{path}: manual labels outside {review_ops.MANUAL_LABELS}: {', '.join(r[0] for r in bad)}")
    return rows


def read_suggestions(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6: one row per (run, question); a missing file is empty, an incomplete suggestion an error."""
    schema = "run_id string, question_id string, retrieval string, answer string, reason string, context_ids string, answer_sha256 string"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,map<string,{SUGGESTION}>>", {"mode": "FAILFAST"}).alias("m"))
    rows = raw.select(F.explode("m").alias("run_id", "by")).select("run_id", F.explode("by").alias("question_id", "s")).select("run_id", "question_id", "s.*")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    ok = lambda c: blank(c) | F.col(c).isin(review_ops.MANUAL_LABELS)
    broken = rows.where(~ok("retrieval") | ~ok("answer") | blank("reason") | (~blank("retrieval") & F.col("context_ids").isNull()) | (~blank("answer") & blank("answer_sha256")))
    first = broken.select("run_id", "question_id").limit(5).collect()
    if first:
        raise ValueError(f"{path}: incomplete suggestions: {', '.join(f'{r[0]}/{r[1]}' for r in first)}")
    return rows


def write_table(df: DataFrame, path: str, by_run: bool = True) -> None:
    """SNK-2 to SNK-4, SNK-6: the canonical store, replaced partition by partition."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy("run_id") if by_run else writer).parquet(path)


def append_missing(cache: str, rows: DataFrame, key: str = "cache_key") -> None:
    """SNK-8: append cache entries that are not there yet; the committer makes the job atomic."""
    if exists(rows.sparkSession, cache):
        rows = rows.join(rows.sparkSession.read.parquet(cache).select(key), key, "left_anti")
    rows.dropDuplicates([key]).write.mode("append").parquet(cache)


class Cache:
    """A cache table that grows as a run goes on."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        return self.spark.read.parquet(self.path) if exists(self.spark, self.path) else None

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)


def write_json(path: str, data: Any) -> None:
    """SNK-1: byte-stable JSON."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(data, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def write_review(path: str, rows: DataFrame) -> None:
    """SNK-5: one review file in question order."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(review_ops.COLUMNS)
        out.writerows([r[c] or "" for c in review_ops.COLUMNS] for r in rows.orderBy("question_id").toLocalIterator())


def replace_block(path: str, name: str, block: str) -> bool:
    """SNK-9, SRC-11: replace what stands between <!-- name:start --> and <!-- name:end -->; false without both."""
    text = Path(path).read_text(encoding="utf-8")
    start, end = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    head, found, rest = text.partition(start)
    _, closed, tail = rest.partition(end)
    if not found or not closed:
        return False
    after = f"{head}{start}\n{block.strip()}\n{end}{tail}"
    if after != text:
        Path(path).write_text(after, encoding="utf-8")
    return True
