"""All runs of an experiment in one plan: chunk, embed, retrieve, generate, review, measure.

Distinct chunking parameters are chunked once and joined back to their runs; the tables
chunks, hits, contexts, answers and review are the restart points.
"""

from __future__ import annotations

import subprocess
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import inspection, labels, metrics, models, retrieval, review, sections, windows
from textloom.sources import files
from textloom.sources.config import Config


def make_chunks(docs: DataFrame, run: dict[str, Any]) -> DataFrame:
    """CH-1: the chunks of one run's strategy; fixed and structure chunks have the same columns."""
    if run["strategy"] == "structure":
        return sections.structure_chunks(docs, run["min_tokens"], run["max_tokens"], run["overlap_tokens"], run["prefix"])
    if run["strategy"] != "fixed":
        raise ValueError(f"unknown strategy {run['strategy']!r}")
    out = windows.fixed_windows(docs, run["size_chars"], run["overlap_chars"])
    none = F.lit(None)
    return out.select("doc_id", "seq", "id", F.array().cast("array<string>").alias("heading_path"), "start_char", "end_char", "est_tokens", F.struct(none.cast("array<string>").alias("merged_from"), none.cast("string").alias("part"), none.cast("boolean").alias("repeated_header")).alias("meta"), F.col("body").alias("text"), "body")


PARAMS = ("strategy", "size_chars", "overlap_chars", "min_tokens", "max_tokens", "overlap_tokens", "prefix")


def chunks_of_runs(docs: DataFrame, runs: list[dict[str, Any]]) -> DataFrame:
    """Chunks of all runs; runs with the same parameters share one chunking."""
    groups: dict[tuple, list[str]] = {}
    for run in runs:
        groups.setdefault(tuple(run.get(p) for p in PARAMS), []).append(run["id"])
    out = None
    for key, ids in groups.items():
        one = make_chunks(docs, dict(zip(PARAMS, key, strict=True))).withColumn("run_id", F.explode(F.array(*[F.lit(i) for i in ids])))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("chunk_id", F.concat_ws("/", F.col("doc_id").cast("string"), "id"))


@dataclass
class Outcome:
    """Tables of an experiment, stage by stage, and what the manifest records."""

    chunks: DataFrame
    cuts: DataFrame
    stats: DataFrame
    hits: DataFrame
    contexts: DataFrame
    answers: DataFrame
    review: DataFrame
    metrics: DataFrame
    manifest: dict[str, Any] = field(default_factory=dict)


def git_state(path: str = ".") -> dict[str, Any]:
    """SNK-7: commit and whether the tree has changes; nulls outside a repository."""

    def git(*args: str) -> str | None:
        try:
            return subprocess.run(["git", "-C", path, *args], capture_output=True, text=True, check=True, timeout=10).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    status = git("status", "--porcelain")
    return {"commit": git("rev-parse", "HEAD"), "dirty": None if status is None else bool(status)}


def median_ms(call: Callable[[], Any], repeats: int = 50) -> float:
    """AGG-14: median wall time of a call in milliseconds."""
    import statistics

    times = []
    for _ in range(repeats):
        began = time.perf_counter()
        call()
        times.append((time.perf_counter() - began) * 1000)
    return round(statistics.median(times), 3)


def execute(spark: SparkSession, config: Config, docs: DataFrame, questions: DataFrame, facts: DataFrame, embed_with: Callable, answer_with: Callable, embed_cache: Any = None, answer_cache: Any = None, store: Callable[[str, DataFrame], DataFrame] = lambda name, df: df, suggestions: DataFrame | None = None, previous: DataFrame | None = None, forbidden: str | None = None) -> Outcome:
    """The whole experiment.

    ``store(name, table)`` may write a table and return it re-read; finished stages then survive.
    """
    began, times = time.time(), {}

    def staged(name: str, df: DataFrame) -> DataFrame:
        t = time.time()
        out = store(name, df)
        times[name] = round(time.time() - t, 3)
        return out

    s, e, profile = config.settings, config.embedding, config.profile
    # a quota is kept by one caller; a model of one's own is asked by all tasks
    parts = lambda quota: 1 if quota else int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = staged("chunks", chunks_of_runs(docs, config.runs))
    cuts = staged("cuts", inspection.find_cuts(chunks, docs, ["doc_id"], keep=["run_id", "doc_id", "id"]))
    doc_tokens = docs.agg(F.sum(T.estimated_tokens(F.col("text")))).first()[0] or 0
    stats = chunks.groupBy("run_id").agg(F.count(F.lit(1)).alias("chunks"), F.avg("est_tokens").alias("mean_tokens"), F.min("est_tokens").alias("min_tokens"), F.max("est_tokens").alias("max_tokens"), F.sum("est_tokens").alias("total_tokens"))
    stats = stats.withColumn("redundancy", F.col("total_tokens") / F.nullif(F.lit(doc_tokens), F.lit(0)))
    embedded, new_vectors = models.embed(chunks, "text", embed_with, e["model"], e["dimensions"], e["document_template"], embed_cache, e["batch_size"], e["requests_per_minute"], e["tokens_per_minute"], parts(e["requests_per_minute"]))
    asked, new_queries = models.embed(questions, "question", embed_with, e["model"], e["dimensions"], e["query_template"], embed_cache, e["batch_size"], e["requests_per_minute"], e["tokens_per_minute"], parts(e["requests_per_minute"]))
    embedded, asked = staged("chunk_vectors", embedded.select("run_id", "chunk_id", "doc_id", "seq", "vector")), staged("question_vectors", asked.select("question_id", "vector"))
    for rows in (embedded, asked):
        if retrieval.unit_violations(rows, e["dimensions"]).limit(1).count():
            raise ValueError("vectors that are not of unit length")
    hits = None
    numbered = embedded.withColumn("seq", F.col("doc_id") * 1_000_000 + F.col("seq")).drop("doc_id")
    for run in config.runs:  # modes differ by run; the search itself is one plan per run's chunks
        found = retrieval.ranked(numbered.where(F.col("run_id") == run["id"]), asked, None if run["retrieval"] == "token_budget" else max(s["k"], s["retrieve_n"]))
        found = found.join(chunks.where(F.col("run_id") == run["id"]).select("chunk_id", "est_tokens"), "chunk_id")
        found = retrieval.with_context(found, run["retrieval"], s["k"], s["token_budget"])
        found = retrieval.logged(found, s["retrieve_n"]).withColumn("run_id", F.lit(run["id"])).select("run_id", "question_id", "chunk_id", "rank", "score", "est_tokens", "in_context")
        hits = found if hits is None else hits.unionByName(found)
    hits = staged("hits", hits)
    contexts = staged("contexts", retrieval.contexts(hits, ["run_id", "question_id"]))
    making = [r["id"] for r in config.runs if r["generate"]]
    texts = hits.where("in_context").where(F.col("run_id").isin(making)).join(chunks.select("run_id", "chunk_id", "text"), ["run_id", "chunk_id"])
    asks = models.prompts(models.context_text(texts, ["run_id", "question_id"]), questions)
    answered, new_answers = models.generate(asks, answer_with, profile["provider"], profile["model"], config.generation["temperature"], answer_cache, requests_per_minute=profile["requests_per_minute"], partitions=parts(profile["requests_per_minute"]))
    answered = answered.join(contexts.select("run_id", "question_id", "context_ids"), ["run_id", "question_id"])
    answered = staged("answers", answered.select("run_id", "question_id", "question", "context_ids", T.citations(F.col("context_ids")).alias("sources"), "answer", "latency_s", "cache_key"))
    rows = review.build_rows(contexts, chunks, questions, facts, answered, forbidden=forbidden)
    if suggestions is not None:
        rows = review.apply_suggestions(rows, suggestions)
    if previous is not None:
        rows, _ = review.keep_manual(rows, previous)
    rows = staged("review", rows)
    judged = _relevant(hits, chunks, facts)
    found = staged("metrics", metrics.run_metrics(rows, questions, judged, stats, contexts))
    manifest = {"created_at": datetime.now(UTC).isoformat(timespec="seconds"), "git": git_state(), "config": {"settings": s, "embedding": e, "generation": config.generation, "runs": config.runs}, "seconds": {**times, "total": round(time.time() - began, 3)}}
    asked_for = answered.agg(F.count(F.lit(1)), F.sum("latency_s"), F.countDistinct("cache_key")).first()
    manifest["generation"] = {"answers": asked_for[0], "distinct": asked_for[2], "latency_s": round(asked_for[1] or 0.0, 2)}
    manifest["chunks"] = {r["run_id"]: r["chunks"] for r in stats.select("run_id", "chunks").collect()}
    out = Outcome(chunks, cuts, stats, hits, contexts, answered, rows, found, manifest)
    out.manifest["new"] = {"vectors": new_vectors, "queries": new_queries, "answers": new_answers}
    return out


def _relevant(hits: DataFrame, chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """Hits with ``relevant`` by the body of their own run's chunk."""
    rows = hits.join(chunks.select("run_id", "chunk_id", "body"), ["run_id", "chunk_id"])
    by = ["run_id", "question_id", "chunk_id"]
    found = labels.fact_matches(rows, facts, by, "body").select(*by).distinct().withColumn("relevant", F.lit(True))
    return hits.join(found, by, "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))


def save_new(cache: str, outcome: Outcome) -> None:
    """Append what this run embedded and generated to the cache tables below ``cache``, where the caches did not save it themselves."""
    new = outcome.manifest.pop("new")
    for name, folder in (("vectors", "embeddings"), ("queries", "embeddings"), ("answers", "answers")):
        if new[name] is not None:
            files.append_missing(f"{cache}/{folder}", new[name])


def write_manifest(path: str, outcome: Outcome) -> None:
    files.write_json(str(Path(path)), {k: v for k, v in outcome.manifest.items() if k != "new"})
