import brute
import numpy as np
import pytest

from textloom.llm import quality, rules


def test_pipeline_equals_stages_by_hand(spark, sf_dir, vocabulary):
    import corpus_pipeline as cp
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality", "rules", "near_duplicates", "repeats", "packing"]
    rows = {r.doc_id: r.text for r in docs.collect()}
    # the classifier is learnt, so its own scores stand for the first stage
    scores = {r.doc_id: r.score for r in quality.classify(docs, marks).collect()}
    left = {i: t for i, t in rows.items() if scores[i] >= 0.3}
    left = {i: t for i, t in left.items() if not brute.rules(t)[-1]}
    left = {i: left[i] for i, _, _, kept in brute.near_duplicates(list(left.items()), 5, 80) if kept}
    removed = {i: (n, cut) for i, n, cut, _, _ in brute.repeats(list(left.items()))}
    whole = Tokenizer.from_file(str(vocabulary("word_bpe_49k.json")))
    out = cp.run(spark, sf_dir).collect()
    assert {r.doc_id for r in out} == set(left)
    for i, (_, cut) in removed.items():
        if not cut:
            assert next(r.doc_tokens for r in out if r.doc_id == i) == len(whole.encode(left[i], add_special_tokens=False).ids) + 1
    assert sum(c for _, c in removed.values()) > 0 and np.sum([r.length for r in out]) > 0


def test_stages_keep_the_columns(spark, odd, sf_dir):
    import corpus_pipeline as cp

    docs = odd.drop("block")
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
    assert rules.keep(docs.limit(0)).count() == 0


def test_entry_lists_all(spark):
    import __spark_entry__ as e

    names = set(e.queries())
    assert {"pipeline", *(f"op{k}" for k in range(1, 11))} <= {n.split("_")[0] for n in names}
    assert set(e.oracle_sql()) <= names
    with pytest.raises(KeyError):
        e.queries()["none"]
