"""Command line: list, chunk, run, review, report, stability, demo (CT-7).

Errors of configuration, key or data go to stderr with exit code 1.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import answerkey, inspection, metrics, models, review, sections, stability
from textloom.plans import experiment, report
from textloom.sources import config as config_module
from textloom.sources import files


def session() -> SparkSession:
    return SparkSession.builder.appName("textloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def loaded(spark: SparkSession, config: config_module.Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, questions and facts; every fault of the key is reported at once."""
    docs = files.read_documents(spark, config.settings["document"]).select(F.lit(1).cast("long").alias("doc_id"), "text")
    questions, facts = answerkey.tables(files.read_answer_key(spark, config.settings["answer_key"]))
    found = sections.section_texts(docs).drop("doc_id")
    errors = answerkey.structural_errors(questions, facts).unionByName(answerkey.document_errors(facts, found)).orderBy("question_id", "error").collect()
    if errors:
        raise ValueError("answer key:\n" + "\n".join(f"  {r[0]}: {r[1]}" for r in errors))
    return docs, questions, facts


def _make(config: config_module.Config):
    e, p = config.embedding, config.profile
    key = lambda name: config_module.secret(name) if name else None
    embed = models.embedder_for("offline", dimensions=e["dimensions"]) if e["provider"] == "offline" else models.embedder_for(e["provider"], model=e["model"], dimensions=e["dimensions"], key=key(e["api_key_env"]))
    if p["provider"] == "offline":
        return embed, models.completer_for("offline")
    options = {"model": p["model"], "temperature": config.generation["temperature"], "key": key(p["api_key_env"])}
    if p["provider"] == "openai_compat":
        options["base_url"] = p["base_url"]
    return embed, models.completer_for(p["provider"], **options)


def run(spark: SparkSession, config: config_module.Config) -> None:
    docs, questions, facts = loaded(spark, config)
    out, cache = config.settings["results_dir"], config.settings["cache_dir"]
    embed, answer = _make(config)

    def store(name: str, df: DataFrame) -> DataFrame:
        files.write_table(df, f"{out}/{name}", "run_id" in df.columns)
        return spark.read.parquet(f"{out}/{name}")

    suggestions = files.read_suggestions(spark, f"{out}/review_suggestions.json")
    outcome = experiment.execute(spark, config, docs, questions, facts, embed, answer, files.Cache(spark, f"{cache}/embeddings"), files.Cache(spark, f"{cache}/answers"), store, suggestions)
    experiment.write_manifest(f"{out}/manifest.json", outcome)
    for r in config.runs:
        files.write_review(f"{out}/{r['id']}/review.csv", outcome.review.where(F.col("run_id") == r["id"]))


def refresh(spark: SparkSession, config: config_module.Config) -> None:
    """Read the manual labels back and measure again."""
    _, questions, facts = loaded(spark, config)
    out = config.settings["results_dir"]
    rows = spark.read.parquet(f"{out}/review")
    old = None
    for r in config.runs:
        path = f"{out}/{r['id']}/review.csv"
        if Path(path).exists():
            one = files.read_review(spark, path).withColumn("run_id", F.lit(r["id"]))
            old = one if old is None else old.unionByName(one)
    rows = review.apply_suggestions(rows, files.read_suggestions(spark, f"{out}/review_suggestions.json"))
    if old is not None:
        rows, warned = review.keep_manual(rows, old)
        for w in warned.collect():
            print(f"warning: {w['run_id']}/{w['question_id']}: the {' and '.join(w['changed'])} changed under a manual label", file=sys.stderr)
    chunks, hits, contexts = (spark.read.parquet(f"{out}/{n}") for n in ("chunks", "hits", "contexts"))
    stats = spark.read.parquet(f"{out}/metrics").select("run_id", "chunks", "mean_tokens", "min_tokens", "max_tokens", "total_tokens", "redundancy")
    found = metrics.run_metrics(rows, questions, experiment._relevant(hits, chunks, facts), stats, contexts)
    files.write_table(rows, f"{out}/reviewed")
    files.write_table(found, f"{out}/measured")
    for r in config.runs:
        files.write_review(f"{out}/{r['id']}/review.csv", spark.read.parquet(f"{out}/reviewed").where(F.col("run_id") == r["id"]))


def tables_of(spark: SparkSession, config: config_module.Config):
    out = config.settings["results_dir"]
    pick = lambda new, old: spark.read.parquet(f"{out}/{new if Path(out, new).exists() else old}")
    return pick("measured", "metrics"), config_module.runs_table(spark, config), spark.read.parquet(f"{out}/cuts"), pick("reviewed", "review")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="textloom", description=__doc__)
    parser.add_argument("--config", default="experiments.toml")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("list", "run", "review", "report", "demo"):
        commands.add_parser(name)
    commands.add_parser("chunk").add_argument("--run", required=True)
    commands.add_parser("stability").add_argument("--other", required=True)
    args = parser.parse_args(argv)
    try:
        config = config_module.load(args.config)
        if args.command == "list":
            for r in config.runs:
                print(r["id"], r["strategy"], r["retrieval"], *(f"{k}={v}" for k, v in r.items() if k in experiment.PARAMS[1:]))
            return 0
        spark = session()
        out = config.settings["results_dir"]
        if args.command == "chunk":
            docs, _, _ = loaded(spark, config)
            chosen = [r for r in config.runs if r["id"] == args.run]
            if not chosen:
                raise ValueError(f"no run {args.run}")
            chunks = experiment.chunks_of_runs(docs, chosen)
            cuts = inspection.find_cuts(chunks, docs, ["doc_id"], keep=["run_id", "doc_id", "id"])
            print(report.markdown(report.rows_of(inspection.inspection_table(chunks)), ["Chunk", "Start", "End", "Tokens", "Text"]))
            print(report.markdown(report.rows_of(report.boundaries(cuts)), report.BOUNDARY_HEAD))
            print(report.markdown(report.rows_of(inspection.noteworthy(cuts).select("id", "kind", "context")), ["Chunk", "Cut", "Context"]))
        elif args.command == "run":
            run(spark, config)
        elif args.command == "review":
            refresh(spark, config)
        elif args.command == "stability":
            _, questions, facts = loaded(spark, config)
            both = [spark.read.parquet(f"{d}/answers") for d in (out, args.other)]
            Path(out, "answer_stability.md").write_text(report.stability_document(stability.compare(*both, questions, facts)), encoding="utf-8")
        else:
            found, runs, cuts, rows = tables_of(spark, config)
            ids = [r["id"] for r in config.runs]
            if args.command == "report":
                text = report.comparison(found, runs, cuts, rows, (ids[0], ids[-1]), {"All runs": ids})
                Path(out, "comparison.md").write_text(text, encoding="utf-8")
                if Path("README.md").exists():
                    files.replace_block("README.md", "results", report.readme_block(found, runs, rows, (ids[0], ids[-1])))
            else:
                first = rows.select("question_id").orderBy("question_id").first()
                print(report.walkthrough(found, runs, cuts, rows, first[0] if first else ""))
        return 0
    except (ValueError, OSError, models.RetryError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
