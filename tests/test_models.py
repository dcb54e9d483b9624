import json

import numpy as np
import pytest

from textloom import cli
from textloom.operators import models
from textloom.sources import config, files

TOML = """
[settings]
document = "{dir}/guide.md"
answer_key = "{dir}/key.json"
results_dir = "{dir}/results"
cache_dir = "{dir}/cache"
k = 3
retrieve_n = 5
token_budget = 120
[embedding]
provider = "offline"
model = "hash"
dimensions = 64
document_template = "title: none | text: {{text}}"
query_template = "query: {{text}}"
requests_per_minute = 100000
tokens_per_minute = 100000000
batch_size = 4
[generation]
active = "local"
temperature = 0.0
[llm.local]
provider = "offline"
model = "extractive"
requests_per_minute = 100000
[[runs]]
id = "A-120"
strategy = "fixed"
retrieval = "top_k"
size_chars = 120
overlap_chars = 20
[[runs]]
id = "B-30"
strategy = "structure"
retrieval = "token_budget"
min_tokens = 30
max_tokens = 80
overlap_tokens = 5
prefix = true
"""
KEY = {
    "version": 1,
    "status": "final",
    "questions": [
        {"id": "Q1", "question": "How many frames must be full before you add a super?", "answerable": True, "source_sections": ["Summer"], "required_facts": [{"name": "frames", "accept": ["eight frames"], "section": "Summer"}], "min_facts_for_yes": 1, "expected_answer": "eight", "notes": ""},
        {"id": "Q2", "question": "What does a hive cost?", "answerable": False, "source_sections": [], "required_facts": [], "min_facts_for_yes": 0, "expected_answer": "", "notes": ""},
    ],
}


@pytest.fixture
def place(tmp_path):
    from pathlib import Path

    (tmp_path / "guide.md").write_text((Path(__file__).parent / "guide.md").read_text(encoding="utf-8"), encoding="utf-8")
    (tmp_path / "key.json").write_text(json.dumps(KEY), encoding="utf-8")
    (tmp_path / "experiments.toml").write_text(TOML.format(dir=tmp_path), encoding="utf-8")
    return tmp_path


def test_config(spark, place):
    import tomllib

    raw = tomllib.loads((place / "experiments.toml").read_text())
    good = config.parse(raw)
    assert config.runs_table(spark, good).count() == 2 and good.profile["model"] == "extractive"

    def broken(change):
        copy = json.loads(json.dumps(raw))
        change(copy)
        with pytest.raises(config.ConfigError):
            config.parse(copy)

    broken(lambda c: c.pop("settings"))
    broken(lambda c: c["settings"].update(k=0))
    broken(lambda c: c["settings"].update(k=True))
    broken(lambda c: c["settings"].update(retrieve_n=1))
    broken(lambda c: c["settings"].update(other=1))
    broken(lambda c: c["embedding"].update(query_template="none"))
    broken(lambda c: c["generation"].update(active="none"))
    broken(lambda c: c["llm"]["local"].update(provider="openai_compat"))
    broken(lambda c: c["runs"][1].update(id="A-120"))
    broken(lambda c: c["runs"][0].update(overlap_chars=120))
    broken(lambda c: c["runs"][0].update(strategy="other"))
    broken(lambda c: c["runs"][1].pop("prefix"))
    broken(lambda c: c.update(more={}))
    with pytest.raises(config.ConfigError):
        config.secret("TEXTLOOM_NO_SUCH_KEY")


def test_whole_experiment_by_command_line(spark, place, capsys):
    run = lambda *a: cli.main(["--config", str(place / "experiments.toml"), *a])
    assert run("list") == 0 and "A-120" in capsys.readouterr().out
    assert run("chunk", "--run", "A-120") == 0 and "A-000" in capsys.readouterr().out
    assert run("run") == 0
    found = {r.run_id: r for r in spark.read.parquet(f"{place}/results/metrics").collect()}
    assert set(found) == {"A-120", "B-30"} and found["B-30"].retrieval_accuracy is not None and found["B-30"].provisional
    first = spark.read.parquet(f"{place}/results/answers").count()
    assert first == 4 and json.loads((place / "results/manifest.json").read_text())["seconds"]["total"] > 0
    path = place / "results/B-30/review.csv"
    rows = files.read_review(spark, str(path))
    assert rows.count() == 2
    text = path.read_text(encoding="utf-8")
    assert text.startswith("question_id,question,")
    import csv

    with open(path, encoding="utf-8", newline="") as f:
        table = list(csv.DictReader(f))
    table[0]["answer_label"], table[0]["notes"] = "partial", 'a "note",\nwith lines'
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.DictWriter(f, table[0].keys(), lineterminator="\n")
        out.writeheader()
        out.writerows(table)
    assert run("review") == 0
    assert files.read_review(spark, str(path)).where("notes <> ''").first().notes == 'a "note",\nwith lines'
    assert run("report") == 0
    text = (place / "results/comparison.md").read_text(encoding="utf-8")
    assert "## Summary" in text and "B-30" in text
    assert run("report") == 0 and (place / "results/comparison.md").read_text(encoding="utf-8") == text
    assert run("demo") == 0 and "Takeaways" in capsys.readouterr().out
    assert run("stability", "--other", str(place / "results")) == 0
    assert "none" in (place / "results/answer_stability.md").read_text(encoding="utf-8")
    assert run("chunk", "--run", "nope") == 1 and "error" in capsys.readouterr().err


def test_embedding_cache_and_batches(spark):
    rows = spark.createDataFrame([(k, f"text {k % 3}") for k in range(9)], "n int, text string")
    calls = spark.sparkContext.accumulator(0)

    class Counting(models.HashingEmbedder):
        def embed(self, texts):
            calls.add(len(texts))
            return super().embed(texts)

    out, fresh = models.embed(rows, "text", lambda: Counting(16), "m", 16, "q {text} {x}", batch_size=2)
    got = out.collect()
    assert len(got) == 9 and calls.value == 3
    assert all(abs(np.linalg.norm(r.vector) - 1) < 1e-3 for r in got)
    cache = spark.createDataFrame(fresh.collect(), fresh.schema)
    assert calls.value == 3, "reading the new entries asks the model again"
    before = calls.value
    again, more = models.embed(rows, "text", lambda: Counting(16), "m", 16, "q {text} {x}", cache)
    assert again.count() == 9 and more.count() == 0 and calls.value == before
    assert tuple(models.cache_use(models.keyed(rows, "text", "m", 16, "q {text} {x}"), cache).first()) == (3, 0)


def test_a_saving_cache_keeps_finished_rounds(spark, tmp_path, monkeypatch):
    from textloom.sources import files

    monkeypatch.setattr(models, "answered", lambda *a, f=models.answered: f(*a, per_round=5))
    rows = spark.createDataFrame([(k, f"text {k}") for k in range(40)], "n int, text string")
    cache, calls = files.Cache(spark, str(tmp_path / "c")), spark.sparkContext.accumulator(0)

    class Failing(models.HashingEmbedder):
        def embed(self, texts):
            calls.add(len(texts))
            if "text 17" in texts:
                raise KeyError("no")
            return super().embed(texts)

    with pytest.raises(Exception, match="no"):
        models.embed(rows, "text", lambda: Failing(16), "m", 16, cache=cache, batch_size=1)
    held = cache.read()
    kept = 0 if held is None else held.count()
    out, fresh = models.embed(rows, "text", models.embedder_for("offline", dimensions=16), "m", 16, cache=cache)
    assert fresh is None and out.count() == 40 and cache.read().count() == 40 and kept % 1 == 0
    again, _ = models.embed(rows, "text", lambda: Failing(16), "m", 16, cache=cache)
    before = calls.value
    assert again.count() == 40 and calls.value == before


def test_limiter_and_retries():
    now = [0.0]
    limiter = models.RateLimiter(2, 100, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(4):
        limiter.acquire(30)
    assert now[0] == 60.0
    with pytest.raises(ValueError):
        limiter.acquire(101)

    class Busy(Exception):
        code = 429

    tries = []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise Busy("slow down")
        return "ok"

    assert models.with_retries(call, models.transient, sleep=lambda s: None) == "ok"
    with pytest.raises(models.RetryError):
        models.with_retries(lambda: (_ for _ in ()).throw(Busy("x")), models.transient, sleep=lambda s: None)
    assert not models.transient(Busy("quota per day"))
    with pytest.raises(KeyError):
        models.with_retries(lambda: {}["x"], models.transient)


def test_completer_and_factories():
    c = models.ExtractiveCompleter()
    assert c.complete("", "[1]\nFrames are full at eight. Other.\n\nQuestion: When are frames full?").endswith("[1]")
    assert "not contain this information" in c.complete("", "[1]\nnothing\n\nQuestion: When are frames full?")
    for make in (models.embedder_for, models.completer_for):
        with pytest.raises(ValueError):
            make("other")


def test_files(spark, tmp_path):
    assert files.read_suggestions(spark, str(tmp_path / "none.json")).count() == 0
    good = {"r": {"Q1": {"retrieval": "yes", "answer": "no", "reason": "x", "context_ids": "a", "answer_sha256": "b"}}}
    (tmp_path / "s.json").write_text(json.dumps(good))
    assert files.read_suggestions(spark, str(tmp_path / "s.json")).first().reason == "x"
    good["r"]["Q1"]["reason"] = ""
    (tmp_path / "t.json").write_text(json.dumps(good))
    with pytest.raises(ValueError):
        files.read_suggestions(spark, str(tmp_path / "t.json"))
    files.write_json(str(tmp_path / "a/b.json"), {"é": 1})
    assert (tmp_path / "a/b.json").read_text(encoding="utf-8") == '{\n  "é": 1\n}\n'
    (tmp_path / "r.md").write_text("x\n<!-- results:start -->\nold\n<!-- results:end -->\ny\n")
    assert files.replace_block(str(tmp_path / "r.md"), "results", r"new \1") and files.replace_block(str(tmp_path / "r.md"), "results", r"new \1")
    assert (tmp_path / "r.md").read_text() == "x\n<!-- results:start -->\nnew \\1\n<!-- results:end -->\ny\n"
    assert not files.replace_block(str(tmp_path / "r.md"), "other", "z")
    (tmp_path / "d.md").write_text("a \r\nb\r\n\r\n")
    assert files.read_documents(spark, str(tmp_path / "d.md")).first().text == "a\nb\n"
    assert files.read_artefact(spark, str(tmp_path / "no.json"), "a int", optional=True).count() == 0
    rows = spark.createDataFrame([("k1", 1), ("k1", 1)], "cache_key string, v int")
    files.append_missing(str(tmp_path / "cache"), rows)
    files.append_missing(str(tmp_path / "cache"), rows)
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 1


def test_streams(spark, tmp_path):
    from textloom.operators import sections, windows
    from textloom.streaming import chunks

    text = "# A\n\n" + "word " * 40 + "\n\n## B\n\nmore text here\n"
    docs = spark.createDataFrame([(k, text) for k in range(5)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = chunks.document_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    chunks.write_windows(stream, str(tmp_path / "w"), str(tmp_path / "cw"), 50, 5).awaitTermination()
    chunks.write_structure(stream, str(tmp_path / "s"), str(tmp_path / "cs"), 10, 60).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "w")).count() == windows.fixed_windows(docs.selectExpr("doc_id", "text"), 50, 5).count()
    assert spark.read.parquet(str(tmp_path / "s")).count() == sections.structure_chunks(docs, 10, 60).count()
