import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import answerkey, labels, metrics, review, stability

QUESTIONS = [
    ("Q1", "How many frames?", True, ["Summer"], 1),
    ("Q2", "When do plants flower?", True, ["Willow", "Clover"], 2),
    ("Q3", "What is the price?", False, [], 0),
]
FACTS = [("Q1", 0, "frames", "Summer", ["eight frames", "8 frames"]), ("Q2", 0, "willow", "Willow", ["3-4"]), ("Q2", 1, "clover", "Clover", ["6 to 8"])]
REFUSAL = "The guide does not contain this information."


@pytest.fixture(scope="module")
def key(spark):
    q = spark.createDataFrame(QUESTIONS, "question_id string, question string, answerable boolean, source_sections array<string>, min_facts_for_yes int")
    return q, spark.createDataFrame(FACTS, "question_id string, fact_ord int, name string, section string, accept array<string>")


def test_match_normalization(spark):
    cases = {"3 – 4": "3-4", "6 to 8": "6-8", "5%  TO 7%": "5%-7%", "1 - 2 - 3": "1-2-3", " A\u00a0B ": "a b", "7to9": "7-9"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.match_normalized(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == cases


def test_retrieval_labels(spark, key):
    bodies = [("Q1", "add when EIGHT  frames"), ("Q2", "Willow 3 – 4"), ("Q2", "Clover 6-8"), ("Q3", "anything")]
    rows = {r.question_id: (r.label, r.matched) for r in labels.retrieval_labels(spark.createDataFrame(bodies, "question_id string, body string"), *key).collect()}
    assert rows == {"Q1": ("yes", ["frames"]), "Q2": ("yes", ["willow", "clover"]), "Q3": ("N/A", [])}
    split = [("Q1", "eight"), ("Q1", "frames"), ("Q2", "3-4 only")]
    rows = {r.question_id: r.label for r in labels.retrieval_labels(spark.createDataFrame(split, "question_id string, body string"), *key).collect()}
    assert rows == {"Q1": "no", "Q2": "partial"}


def test_answer_labels(spark, key):
    given = [("a", "Q1", "8 frames"), ("b", "Q1", REFUSAL + " eight frames"), ("c", "Q3", REFUSAL), ("d", "Q3", "it costs 9 euros"), ("e", "Q3", REFUSAL + " Perhaps 9 euros."), ("f", "Q1", None)]
    rows = labels.answer_labels(spark.createDataFrame(given, "run_id string, question_id string, answer string"), *key, ["run_id", "question_id"], forbidden=r"\d+ euros")
    got = {r.run_id: r for r in rows.collect()}
    assert {k: r.label for k, r in got.items()} == {"a": "yes", "b": "no", "c": "yes", "d": "no", "e": "no", "f": "no"}
    assert got["a"].matched == ["frames"] and got["b"].matched == []


def test_key_errors(spark, key):
    q, f = key
    assert answerkey.structural_errors(q, f).count() == 0
    worse = q.withColumn("min_facts_for_yes", F.when(F.col("question_id") == "Q1", 5).otherwise(F.col("min_facts_for_yes"))).unionByName(q.where("question_id = 'Q3'"))
    extra = spark.createDataFrame([("Q2", 2, "odd", "Nowhere", [" "])], f.schema)
    errors = {r.error for r in answerkey.structural_errors(worse, f.unionByName(extra)).collect()}
    assert {"min_facts_for_yes is out of range", "duplicate id", "fact without accepted strings: odd", "fact of an unlisted section: Nowhere"} <= errors
    doc = spark.createDataFrame([("Summer", "when eight frames are full"), ("Willow", "in 3 – 4")], "heading string, text string")
    errors = {(r.question_id, r.error) for r in answerkey.document_errors(f, doc).collect()}
    assert errors == {("Q1", "not in section Summer: 8 frames"), ("Q2", "no section: Clover")}
    texts = doc.unionByName(spark.createDataFrame([("Summer", "of 8  FRAMES"), ("Clover", None)], doc.schema))
    assert {(r.question_id, r.error) for r in answerkey.document_errors(f, texts).collect()} == {("Q2", "no section: Clover")}


def test_accuracy_and_layers(spark):
    rows = spark.createDataFrame([("a", "yes"), ("a", "partial"), ("b", "yes"), ("b", "N/A"), ("c", "no")], "g string, l string")
    got = {r.g: r.a for r in rows.groupBy("g").agg(metrics.accuracy(F.col("l")).alias("a")).collect()}
    assert got == {"a": 75.0, "b": None, "c": 0.0}
    label, source = T.first_label(("final", F.col("f")), ("suggested", F.col("s")), ("auto", F.col("a")))
    rows = spark.createDataFrame([("yes", "no", "no"), (" ", "no", "yes"), (None, "", "partial"), ("", "", "")], "f string, s string, a string").select(label.alias("l"), source.alias("s")).collect()
    assert [tuple(r) for r in rows] == [("yes", "final"), ("no", "suggested"), ("partial", "auto"), ("", "")]


def test_suggestions_and_manual_labels(spark):
    cols = "run_id string, question_id string, context_ids string, answer string, retrieval_label_suggested string, answer_label_suggested string, suggestion_reason string"
    rows = spark.createDataFrame([("r", "Q1", "a b", "yes it is", "", "", ""), ("r", "Q2", "c", "changed", "", "", ""), ("r", "Q3", "d", "x", "", "", "")], cols)
    digest = "sha2(answer, 256)"
    given = rows.where("question_id <> 'Q3'").selectExpr("run_id", "question_id", "'yes' retrieval", "'partial' answer", "'why' reason", "if(question_id = 'Q2', 'z', context_ids) context_ids", f"if(question_id = 'Q2', 'old', {digest}) answer_sha256")
    got = {r.question_id: (r.retrieval_label_suggested, r.answer_label_suggested, r.suggestion_reason) for r in review.apply_suggestions(rows, given).collect()}
    assert got == {"Q1": ("yes", "partial", "why"), "Q2": ("", "", "[not applied: the context and answer changed since review] why"), "Q3": ("", "", "")}
    fresh = rows.selectExpr("run_id", "question_id", "context_ids", "answer", "'' retrieval_label_final", "'' answer_label", "'' notes")
    old = fresh.selectExpr("run_id", "question_id", "if(question_id = 'Q1', 'other', context_ids) context_ids", "answer", "'yes' retrieval_label_final", "'no' answer_label", "'n' notes")
    kept, warned = review.keep_manual(fresh, old)
    assert {r.answer_label for r in kept.collect()} == {"no"}
    assert [(r.question_id, r.changed) for r in warned.collect()] == [("Q1", ["context"])]
    assert review.bad_manual_labels(fresh.withColumn("answer_label", F.lit("maybe"))).count() == 3


def test_stability(spark, key):
    cols = "run_id string, question_id string, answer string, context_ids array<string>"
    first = spark.createDataFrame([("r", "Q1", "8 frames", ["a"]), ("r", "Q3", REFUSAL, ["b"]), ("s", "Q1", "x", ["a"])], cols)
    second = spark.createDataFrame([("r", "Q1", "none", ["a"]), ("r", "Q3", REFUSAL + " ", ["b"])], cols)
    row = stability.compare(first, second, *key).collect()
    assert len(row) == 1 and (row[0].accuracy_1, row[0].accuracy_2, row[0].delta, row[0].changed_texts, row[0].flips) == (100.0, 50.0, -50.0, 1, "Q1 yes→no")
    with pytest.raises(Exception, match="contexts differ"):
        stability.compare(first, second.withColumn("context_ids", F.array(F.lit("z"))), *key).collect()
