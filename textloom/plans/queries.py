"""The engine's queries over the fixture tables, one per operator group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import answerkey, inspection, labels, metrics, models, retrieval, review, sections, splitter, stability, windows
from textloom.plans import corpora
from textloom.plans.corpora import table


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("est_tokens"))


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.normalized(F.col("text"))
    return corpora.dirty_documents(spark, sf_dir).select("doc_id", T.digest(out).alias("sha"), F.length(out).alias("n_chars"))


def match_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("text"), F.lit("  5 – 7%  to 9 − 11 to  12 x"))
    return table(spark, sf_dir, "documents").select("doc_id", T.digest(T.match_normalized(text)).alias("sha"))


def text_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.digest(F.col("text")).alias("sha"))


def text_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs, one-line previews, shown newlines, templates and safe names."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        T.digest(T.slug(text)).alias("slug"),
        T.one_line(text, 70).alias("preview"),
        T.digest(T.newlines_shown(text)).alias("shown"),
        T.digest(T.filled("title: none | text: {text}", text)).alias("filled"),
        T.path_safe(F.concat("lang", F.lit("/model:"), "source")).alias("safe"),
    )


def _fixed(size: int, overlap: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = windows.fixed_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), size, overlap)
        return out.select("doc_id", "seq", "id", "start_char", "end_char", "est_tokens", T.digest(F.col("body")).alias("sha"))

    return query


fixed_chunks_500_50, fixed_chunks_300_30, fixed_chunks_800_80 = _fixed(500, 50), _fixed(300, 30), _fixed(800, 80)


def fixed_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.fixed_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), 500, 50)
    return windows.rebuilt(out, ["doc_id"], 50).select("doc_id", T.digest(F.col("text")).alias("sha"))


def all_runs(docs: DataFrame) -> DataFrame:
    """The windows of every fixed run in one table."""
    out = None
    for run, size, overlap in corpora.RUNS:
        one = windows.fixed_windows(docs, size, overlap).withColumn("run_id", F.lit(run))
        out = one if out is None else out.unionByName(one)
    return out


def chunk_stats_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    out = inspection.chunk_stats(all_runs(docs), docs, ["run_id", "lang"], ["lang"])
    return out.select("run_id", "lang", "chunks", "min_tokens", "max_tokens", "total_tokens", "doc_tokens", "mean_tokens", "redundancy")


def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return inspection.find_cuts(windows.fixed_windows(docs, 500, 50), docs.drop("lang"), ["doc_id"], keep=["doc_id", "lang", "id"])


def cut_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cuts(spark, sf_dir).select("doc_id", "id", "side", "position", "kind", "mid_word", "context")


def cut_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspection.cut_summary(_cuts(spark, sf_dir), ["lang"])


def noteworthy_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspection.noteworthy(_cuts(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("mid_word").alias("in_word"))


def markdown_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpora.conversations_markdown(spark, sf_dir)
    cuts = inspection.find_cuts(windows.fixed_windows(docs, 300, 30), docs, ["doc_id"])
    return inspection.cut_summary(cuts.withColumn("run_id", F.lit("A-300")), ["run_id"])


def md_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.sections(corpora.conversations_markdown(spark, sf_dir)).select("doc_id", "sec_no", "level", "title", "heading_start", "body_start", "body_end")


def md_heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.sections(corpora.documents_markdown(spark, sf_dir)).select("doc_id", "sec_no", F.array_join("path", " > ").alias("path"))


def section_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sections.section_texts(corpora.conversations_markdown(spark, sf_dir))
    return out.select("doc_id", "heading", F.length("text").alias("n_chars"))


def _merged(least: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = sections.merged_units(sections.sections(corpora.conversations_markdown(spark, sf_dir)), least)
        return out.select("doc_id", "unit_no", "sections", F.array_join("path", " > ").alias("path"), F.col("start").alias("start_char"), F.col("end").alias("end_char"))

    return query


md_merge_min100, md_merge_min40 = _merged(100), _merged(40)


def _chunk_digest(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", "seq", "id", F.array_join("heading_path", " > ").alias("path"), "start_char", "end_char", "est_tokens", T.digest(F.col("text")).alias("sha"))


def structure_chunks_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_digest(sections.structure_chunks(corpora.conversations_markdown(spark, sf_dir), 100, 512, split=False))


def prefix_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with and without heading paths have the same bounds; the tokens differ by the path."""
    docs = corpora.conversations_markdown(spark, sf_dir)
    a = sections.structure_chunks(docs, 100, split=False, prefix=True).select("doc_id", "seq", "start_char", "end_char", F.col("est_tokens").alias("with_path"))
    b = sections.structure_chunks(docs, 100, split=False, prefix=False).select("doc_id", "seq", F.col("start_char").alias("s2"), F.col("end_char").alias("e2"), F.col("est_tokens").alias("without_path"))
    return a.join(b, ["doc_id", "seq"]).select("doc_id", "seq", ((F.col("start_char") == F.col("s2")) & (F.col("end_char") == F.col("e2"))).alias("same_bounds"), "with_path", "without_path")


def structure_chunks_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long sections split: each chunk with whether it keeps to its bounds."""
    docs = corpora.documents_markdown(spark, sf_dir)
    out = sections.structure_chunks(docs, 100, 512, 40).join(docs.select("doc_id", F.col("text").alias("doc")), "doc_id")
    exact = T.between(F.col("doc"), F.col("start_char"), F.col("end_char")) == F.col("body")
    return out.select("doc_id", "seq", "id", "start_char", "end_char", "est_tokens", F.col("meta.part").alias("part"), (F.col("est_tokens") <= 512).alias("fits"), exact.alias("exact"))


def split_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The splitter without overlap: pieces that fit and hold every character that is not blank."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = docs.withColumn("p", splitter.split_column(F.col("text"), F.lit(1200), F.lit(0)))
    held = F.aggregate("p", F.lit(0), lambda s, x: s + F.length(F.regexp_replace(x["text"], "\\s", "")))
    longest = F.aggregate("p", F.lit(0), lambda s, x: F.greatest(s, F.length(x["text"])))
    return out.select("doc_id", (longest <= 1200).alias("fits"), held.alias("n_solid"))


def split_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indented tables of 1 to 60 equal rows, seven rows to a piece at most, the header above each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 60 + 1).cast("int").alias("n"))
    rows = F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.concat(F.lit("  | "), F.lpad(k.cast("string"), 6, "0"), F.lit(" | value |\n")))
    text = F.concat(F.lit("| id | v |\n|----|---|\n"), F.array_join(rows, ""))
    pieces = docs.withColumn("p", splitter.split_column(text, F.lit(22 + 7 * 21), F.lit(0)))
    out = pieces.select("doc_id", "n", F.posexplode("p").alias("k", "p"))
    # a table within the budget stays as it is, with its last line
    held = F.regexp_extract_all(F.col("p.text"), F.lit("\\| (\\d{6}) \\|"), F.lit(1))
    return out.select("doc_id", F.col("k").cast("int").alias("k"), F.element_at(held, 1).cast("int").alias("first"), F.element_at(held, -1).cast("int").alias("last"), F.col("p.repeated_header").alias("repeated"), F.col("p.text").startswith("| id | v |\n|----|---|\n").alias("headed"), F.col("p.start").alias("start"), F.col("p.end").alias("end"))


def split_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced code of 2 to 41 equal paragraphs, packed five to a piece in a fence of its own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 40 + 2).cast("int").alias("n"))
    parts = F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.concat(F.lit("line_"), F.lpad(k.cast("string"), 5, "0")))
    text = F.concat(F.lit("```py\n"), F.array_join(parts, "\n\n"), F.lit("\n```\n"))
    pieces = docs.withColumn("p", splitter.split_column(text, F.lit(5 + 3 + 2 + 5 * 12 - 2), F.lit(0)))
    return pieces.select("doc_id", F.posexplode("p").alias("k", "p")).select("doc_id", F.col("k").cast("int").alias("k"), F.col("p.text").alias("text"), F.col("p.repeated_header").alias("repeated"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, queries = corpora.vectors(spark, sf_dir)
    return retrieval.ranked(chunks, queries.drop("label"), 5).select("question_id", "chunk_id", "rank")


def _hits(spark: SparkSession, sf_dir: str, n: int | None) -> DataFrame:
    chunks, queries = corpora.vectors(spark, sf_dir)
    hits = retrieval.ranked(chunks, queries.drop("label"), n)
    sizes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), T.tokens_of_length(F.col("n_chars")).alias("est_tokens"))
    return hits.join(sizes, "chunk_id", "left").withColumn("est_tokens", F.coalesce("est_tokens", F.lit(1)))


def context_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.with_context(_hits(spark, sf_dir, 5), "top_k", k=3)
    return retrieval.contexts(hits).select("question_id", F.array_join("context_ids", " ").alias("context_ids"), "context_tokens")


def context_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.with_context(_hits(spark, sf_dir, None), "token_budget", budget=4000)
    return retrieval.contexts(hits).select("question_id", F.array_join("context_ids", " ").alias("context_ids"), "context_tokens")


def logged_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.with_context(_hits(spark, sf_dir, None), "token_budget", budget=4000)
    return retrieval.logged(hits, 5).select("question_id", "chunk_id", "rank", "est_tokens", "in_context")


def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit at 1 and reciprocal ranks over the hits after a query's own vector."""
    chunks, queries = corpora.vectors(spark, sf_dir)
    hits = retrieval.ranked(chunks, queries.drop("label"), 6).where("chunk_id <> question_id")
    hits = hits.join(chunks.select("chunk_id", F.col("label").alias("cl")), "chunk_id").join(queries.select("question_id", F.col("label").alias("ql")), "question_id")
    first = metrics.first_relevant(hits.withColumn("relevant", F.col("cl") == F.col("ql")).withColumn("rank", F.col("rank") - 1), ["question_id"])
    return first.agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("first_rank") == 1).alias("hits_at_1"), metrics.hit_at_1(F.col("first_rank")).alias("hit_at_1"), metrics.mean_reciprocal_rank(F.col("first_rank")).alias("mrr"))


def _document_texts(spark: SparkSession, sf_dir: str, questions: DataFrame) -> DataFrame:
    """Every document as a text of the question that its id falls to."""
    n = questions.count()
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("Q"), (F.col("doc_id") % max(1, n)).cast("string")).alias("question_id"), "doc_id", F.col("text").alias("body"))


def fact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, facts = corpora.benchmark_key(spark, sf_dir)
    texts = _document_texts(spark, sf_dir, questions)
    return labels.fact_matches(texts, facts, ["question_id", "doc_id"], "body").select("question_id", "doc_id", "fact_ord", "name", "section")


def fact_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, facts = corpora.benchmark_key(spark, sf_dir)
    out = labels.retrieval_labels(_document_texts(spark, sf_dir, questions), questions, facts)
    return out.select("question_id", "label", F.array_join("matched", "; ").alias("facts"))


def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of answers to facts, with refusals; an unanswerable question wants one."""
    questions, facts = corpora.benchmark_key(spark, sf_dir)
    refused = F.lit("The document does not contain this information.")
    said = F.when(F.col("doc_id") % 7 == 6, refused).otherwise(F.col("body"))
    given = _document_texts(spark, sf_dir, questions).select("question_id", "doc_id", said.alias("answer"))
    out = labels.answer_labels(given, questions, facts, ["question_id", "doc_id"])
    return out.select("question_id", "doc_id", "label")


def refusal_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpora.answers(spark, sf_dir)
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("answers"), F.count_if(T.refuses(F.col("answer"))).alias("refusals"))


def accuracy_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.resolved(corpora.review_layers(spark, sf_dir))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(T.label_score(F.col("retrieval"))).alias("score"), metrics.accuracy(F.col("retrieval")).alias("accuracy"))


def label_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.resolved(corpora.review_layers(spark, sf_dir)).select("question_id", "retrieval", "retrieval_source", F.col("answer_resolved").alias("answer"), "answer_source")


def label_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.resolved(corpora.review_layers(spark, sf_dir))
    return rows.groupBy("run_id").agg(*metrics.label_sources(F.col("retrieval_source")), F.bool_or(F.col("retrieval_source") != "final").alias("provisional"))


def stale_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions judged on the first generation, applied to the second."""
    now = corpora.answers(spark, sf_dir, 2)
    rows = now.select("run_id", "question_id", F.array_join("context_ids", " ").alias("context_ids"), "answer", *[F.lit("").alias(c) for c in ("retrieval_label_suggested", "answer_label_suggested", "suggestion_reason")])
    then = corpora.answers(spark, sf_dir, 1)
    number = F.substring("question_id", 2, 20).cast("long")
    given = then.select(
        "run_id", "question_id", F.lit("partial").alias("retrieval"), F.when(number % 4 == 0, F.lit("")).otherwise(F.lit("yes")).alias("answer"), F.lit("read").alias("reason"),
        F.when(number % 9 == 0, F.lit("other")).otherwise(F.array_join("context_ids", " ")).alias("context_ids"), T.digest(F.col("answer")).alias("answer_sha256"),
    )
    return review.apply_suggestions(rows, given).select("run_id", "question_id", "retrieval_label_suggested", "answer_label_suggested", "suggestion_reason")


def manual_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual labels whose answer has changed since."""
    cols = ["run_id", "question_id", "context_ids", "answer"]
    make = lambda n: corpora.answers(spark, sf_dir, n).select("run_id", "question_id", F.array_join("context_ids", " ").alias("context_ids"), "answer")
    rows = make(2).select(*cols, *[F.lit("").alias(c) for c in review.MANUAL])
    number = F.substring("question_id", 2, 20).cast("long")
    old = make(1).select(*cols, F.lit("").alias("retrieval_label_final"), F.when(number % 2 == 0, F.lit("yes")).otherwise(F.lit("")).alias("answer_label"), F.lit("n").alias("notes"))
    _, warned = review.keep_manual(rows, old)
    return warned.select("run_id", "question_id", F.array_join("changed", ",").alias("changed"))


def key_validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark facts looked up in all documents: those of even ids are section S0, the others S1."""
    _, facts = corpora.benchmark_key(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    return answerkey.document_errors(facts, docs.select(F.concat(F.lit("S"), (F.col("doc_id") % 2).cast("string")).alias("heading"), "text"))


def key_rule_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key with broken rules: minimums out of range, sections without facts, unlisted sections."""
    questions, facts = corpora.benchmark_key(spark, sf_dir)
    n = F.substring("question_id", 2, 20).cast("long")
    questions = questions.withColumn("min_facts_for_yes", F.when(n % 3 == 0, F.lit(9)).otherwise(F.col("min_facts_for_yes")))
    questions = questions.withColumn("source_sections", F.when(F.col("answerable") & (n % 4 == 1), F.array(F.lit("S0"), F.lit("S9"))).otherwise(F.col("source_sections")))
    return answerkey.structural_errors(questions, facts)


def stability_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = stability.paired(corpora.answers(spark, sf_dir, 1), corpora.answers(spark, sf_dir, 2))
    label = lambda c: F.when(T.refuses(F.col(c)), F.lit("no")).otherwise(F.lit("yes"))
    return both.groupBy("run_id").agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.trim("answer_1") != F.trim("answer_2")).alias("changed_texts"), F.count_if(label("answer_1") != label("answer_2")).alias("flips"))


def ablation_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document under each run, side by side."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = all_runs(docs).groupBy("doc_id").pivot("run_id", [r[0] for r in corpora.RUNS]).agg(F.count(F.lit(1)))
    return out.select("doc_id", *[F.coalesce(f"`{r[0]}`", F.lit(0)).alias(r[0].replace("-", "_").lower()) for r in corpora.RUNS])


def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered sources of each query's context."""
    hits = _hits(spark, sf_dir, 3)
    chunks = hits.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id")
    return models.context_text(chunks, ["question_id"]).select("question_id", T.digest(F.col("context")).alias("sha"), F.length("context").alias("n_chars"))


def embed_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts to embed, per language."""
    rows = models.keyed(table(spark, sf_dir, "documents"), "text", "offline", 64, "title: none | text: {text}")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.countDistinct("cache_key").alias("to_embed"))


def cache_hit_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    keys = models.keyed(docs, "text", "offline", 64, "{text}")
    return models.cache_use(keys, keys.where("lang = 'en'").select("cache_key").distinct())


def rate_window_60s(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "ts", F.floor(F.col("value")).cast("long").alias("tokens"))
    return models.request_window(rows).select("event_id", "requests_60s", "tokens_60s")


def closed_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk, embed, retrieve and answer offline: benchmark passages asked of the conversations."""
    docs = corpora.conversations_markdown(spark, sf_dir)
    chunks = sections.structure_chunks(docs, 100, 512, split=False).withColumn("chunk_id", F.concat_ws("/", F.col("doc_id").cast("string"), "id"))
    make = models.embedder_for("offline", dimensions=64)
    embedded, _ = models.embed(chunks, "text", make, "offline", 64, partitions=8)
    asked = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("Q"), F.col("item_id").cast("string")).alias("question_id"), F.col("text").alias("question"))
    queries, _ = models.embed(asked, "question", make, "offline", 64, partitions=2)
    numbered = embedded.select("chunk_id", (F.col("doc_id") * 100_000 + F.col("seq")).alias("seq"), "vector")
    hits = retrieval.ranked(numbered, queries.select("question_id", "vector"), 5, dims=64).join(chunks.select("chunk_id", "text", "est_tokens"), "chunk_id")
    chosen = retrieval.with_context(hits, "top_k", k=3).where("in_context")
    asks = models.prompts(models.context_text(chosen, ["question_id"]), asked)
    out, _ = models.generate(asks, models.completer_for("offline"), "offline", "extractive", 0.0, partitions=4)
    return out.select("question_id", T.refuses(F.col("answer")).alias("refused"), F.length("answer").alias("n_chars"))


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors scaled by three and brought back to length 1."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", T.unit_length(F.transform("embedding", lambda x: x * 3)).alias("v"))
    return rows.select("vec_id", F.size("v").alias("dims"), (F.abs(F.sqrt(T.dot(F.col("v"), F.col("v"))) - 1) < 1e-3).alias("unit"))


def citation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation numbers of each query's context."""
    ids = retrieval.contexts(retrieval.with_context(_hits(spark, sf_dir, 5), "top_k", k=3))
    cited = T.citations(F.transform("context_ids", lambda x: x.cast("string")))
    return ids.select("question_id", F.array_join(F.map_keys(cited), " ").alias("numbers"), F.array_join(F.map_values(cited), " ").alias("chunk_ids"))


def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review rows of one run: every document is in the context of its question, the first is the answer."""
    questions, facts = corpora.benchmark_key(spark, sf_dir)
    texts = _document_texts(spark, sf_dir, questions).withColumn("run_id", F.lit("r"))
    chunks = texts.select("run_id", F.col("doc_id").cast("string").alias("chunk_id"), "body")
    ordered = F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string"))
    contexts = texts.groupBy("run_id", "question_id").agg(ordered.alias("context_ids"), F.sum(T.estimated_tokens(F.col("body"))).alias("context_tokens"), F.min_by("body", "doc_id").alias("first"), F.min("doc_id").alias("n"))
    answers = contexts.select("run_id", "question_id", F.when(F.col("n") % 3 == 0, F.lit("The document does not contain this information.")).otherwise(F.col("first")).alias("answer"))
    rows = review.build_rows(contexts.drop("first", "n"), chunks, questions, facts, answers)
    return rows.select("question_id", "question", T.digest(F.col("context_ids")).alias("context_sha"), "context_tokens", "retrieval_auto", "facts_in_context", "answer_auto", "facts_in_answer")


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of runs made of the label layers; every tenth question has no answer."""
    rows = corpora.review_layers(spark, sf_dir).withColumn("answer", F.when(F.col("run_id") == "src1", F.lit("")).otherwise(F.lit("said")))
    docs = table(spark, sf_dir, "documents")
    questions = docs.select(F.col("doc_id").alias("question_id"), (F.col("doc_id") % 10 != 0).alias("answerable"))
    hits = docs.select(F.col("source").alias("run_id"), F.col("doc_id").alias("question_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rank"))
    hits = hits.withColumn("relevant", (F.col("question_id") + F.col("rank")) % 7 == 0)
    contexts = docs.select(F.col("source").alias("run_id"), T.tokens_of_length(F.col("n_chars")).alias("context_tokens"))
    stats = docs.groupBy(F.col("source").alias("run_id")).agg(F.count(F.lit(1)).alias("chunks"))
    out = metrics.run_metrics(rows, questions, hits, stats, contexts)
    return out.select("run_id", "chunks", "retrieval_accuracy", "retrieval_accuracy_auto", "answer_accuracy", "answered", "retrieval_final", "retrieval_suggested", "retrieval_auto", "hit_at_1", "mrr", "mean_context_tokens", "provisional", F.size("per_question").alias("questions"))


QUERIES = {
    name: query
    for name, query in list(globals().items())
    if callable(query) and getattr(query, "__module__", "") == __name__ and not name.startswith("_") and name != "all_runs"
}
