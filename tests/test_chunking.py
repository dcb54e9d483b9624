import random
from pathlib import Path

import pytest
from naive import merge, normalize
from naive import sections as naive_sections
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import inspection, sections, splitter, windows

GUIDE = normalize((Path(__file__).parent / "guide.md").read_text(encoding="utf-8"))


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def random_markdown(rng):
    lines = []
    for _ in range(rng.randint(0, 25)):
        lines.append(rng.choice(["", "", "text " * rng.randint(1, 60), "# A", "## B b", "### C #", "#### D", "## Ü", "#no", "```", "~~~", "  ```x", "- item", "| a |", "   ", "###### six"]))
    return normalize("\n".join(lines))


def test_normalize(spark):
    rng = random.Random(4)
    texts = ["", "\r\n", "a \t\r\nb\r\rc  ", "x\n\n\n\n\ny\n\n"] + ["".join(rng.choice("ab \t\r\n") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalized(F.col("t")).alias("n"), T.normalized(T.normalized(F.col("t"))).alias("twice")).collect()
    assert all(r.n == normalize(r.t) and r.twice == r.n for r in rows)


@pytest.mark.parametrize("size,overlap", [(5, 0), (7, 3), (4, 3)])
def test_windows(spark, size, overlap):
    rows = spark.createDataFrame([(n, "".join(chr(97 + k % 26) for k in range(n))) for n in range(40)], "doc_id long, text string")
    got = windows.fixed_windows(rows, size, overlap).collect()
    for n in range(40):
        mine = sorted((r for r in got if r.doc_id == n), key=lambda r: r.seq)
        want, start = [], 0
        while n and (not want or start < n - overlap):
            want.append((start, min(start + size, n)))
            if start + size >= n:
                break
            start += size - overlap
        assert [(r.start_char, r.end_char) for r in mine] == want
        assert all(r.text[r.start_char : r.end_char] == r.body and r.id == f"A-{r.seq:03d}" for r in mine)
    back = {r.doc_id: r.text for r in windows.rebuilt(windows.fixed_windows(rows, size, overlap), ["doc_id"], overlap).collect()}
    assert all(back[n] == "".join(chr(97 + k % 26) for k in range(n)) for n in range(1, 40))


def test_windows_reject_overlap(spark):
    with pytest.raises(ValueError):
        windows.fixed_windows(one(spark, "x"), 5, 5)


def test_sections_and_merging_equal_loops(spark):
    rng = random.Random(7)
    texts = [GUIDE] + [random_markdown(rng) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    found = sections.sections(docs)
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, []).append((r.sec_no, r.level, r.title, tuple(r.path), r.heading_start, r.body_start, r.body_end))
    for k, t in enumerate(texts):
        assert sorted(got.get(k, [])) == naive_sections(t), t
    for least in (10, 40):
        units = {}
        for r in sections.merged_units(found, least).collect():
            units.setdefault(r.doc_id, []).append((r.unit_no, r.sections, r.start, r.end))
        for k, t in enumerate(texts):
            s = naive_sections(t)
            want = [(n + 1, len(u), s[u[0]][5] if len(u) == 1 else s[u[0]][4], s[u[-1]][6]) for n, u in enumerate(merge(s, least))]
            assert sorted(units.get(k, [])) == want, t


def test_structure_chunks_of_guide(spark):
    docs = one(spark, GUIDE)
    rows = sections.structure_chunks(docs, 30, 60).orderBy("seq").collect()
    assert len({r.id for r in rows}) == len(rows)
    for r in rows:
        assert r.est_tokens <= 60 and r.text.endswith(r.body) and r.est_tokens == -(-len(r.text) // 4)
        if not r.meta.repeated_header:
            assert GUIDE[r.start_char : r.end_char] == r.body
    ids = [r.id for r in rows]
    assert ids[:2] == ["B-keeping-bees", "B-hive-care"] and "B-keeping-bees-2" in ids and ids[-1] == "B-caf-notes"
    assert any(r.meta.merged_from == ["Spring", "Summer"] for r in sections.structure_chunks(docs, 100, 512).collect())
    plain = sections.structure_chunks(docs, 30, 60, prefix=False).collect()
    assert all(r.text == r.body for r in plain)


def test_documents_without_headings(spark):
    docs = one(spark, "just text\n")
    assert sections.structure_chunks(docs, 10).count() == 0
    rows = sections.structure_chunks(docs, 10, preamble=True).collect()
    assert [r.body for r in rows] == ["just text"] and rows[0].id == "B-root"


def test_section_texts(spark):
    rows = {r.heading: r.text for r in sections.section_texts(one(spark, GUIDE)).collect()}
    assert "look for eggs" in rows["Hive care"] and "Deep note ##" in rows and "not a heading" in rows


@pytest.mark.parametrize("budget,overlap", [(60, 0), (60, 20), (25, 5)])
def test_split_pieces_fit_and_cover(budget, overlap):
    rng = random.Random(budget + overlap)
    for _ in range(150):
        text = "".join(rng.choice(["word ", "longer words ", "End. ", "Why? ", "\n", "\n\n", "x" * rng.randint(1, 40) + " "]) for _ in range(rng.randint(1, 60)))
        pieces = splitter.split_text(text, budget, overlap)
        assert all(len(p[0]) <= budget and text[p[1] : p[2]] == p[0] for p in pieces)
        covered = set()
        for p in pieces:
            covered.update(range(p[1], p[2]))
        assert all(ch.isspace() or k in covered for k, ch in enumerate(text))
        if not overlap:
            assert all(a[2] <= b[1] for a, b in zip(pieces, pieces[1:], strict=False))


def test_split_prefers_paragraphs_and_is_even():
    text = "\n\n".join(f"Paragraph {k} " + "word " * 10 for k in range(12))
    pieces = splitter.split_text(text, 300)
    assert all(p[0].startswith("Paragraph") for p in pieces)
    assert max(len(p[0]) for p in pieces) - min(len(p[0]) for p in pieces) <= 130


def test_split_tables_and_code():
    table = "| a | b |\n|---|---|\n" + "".join(f"| row {k} | {k} |\n" for k in range(20))
    pieces = splitter.split_text(table, 100)
    assert len(pieces) > 1 and all(p[0].startswith("| a | b |\n|---|---|\n") for p in pieces)
    assert [p[3] for p in pieces] == [False] + [True] * (len(pieces) - 1)
    assert sum(p[0].count("| row") for p in pieces) == 20
    code = "```python\n" + "\n\n".join(f"value_{k} = {k}" for k in range(20)) + "\n```\n"
    pieces = splitter.split_text(code, 90)
    assert len(pieces) > 1 and all(p[0].startswith("```python\n") and p[0].endswith("\n```") and p[3] for p in pieces)
    whole = splitter.split_text("Intro text here.\n" + "| a |\n|---|\n| 1 |\n" + "More words follow here.\n" * 3, 60)
    assert any("| a |\n|---|\n| 1 |" in p[0] for p in whole)
    with pytest.raises(splitter.SplitError):
        splitter.split_text("| a |\n|---|\n| " + "x" * 200 + " |\n", 50)
    with pytest.raises(splitter.SplitError):
        splitter.split_text("text", 0)


def test_indented_tables_are_not_cut_inside_a_row():
    table = "".join(f"  | row {k} | {k} |\n" for k in range(20))
    pieces = splitter.split_text("Words before.\n" + table, 120)
    rows = [line for p in pieces for line in p[0].split("\n") if "row" in line]
    assert all(line.strip().startswith("| row") and line.strip().endswith("|") for line in rows)
    assert [b[0] for b in splitter.blocks_of("a\n  | x |\n\t| y |\nb")] == ["text", "table", "text"]


def test_blocks_partition():
    text = "a\n| x |\n| y |\n```\n# c\n| z |\n```\nb\n~~~\nopen"
    blocks = splitter.blocks_of(text)
    assert [b[0] for b in blocks] == ["text", "table", "code", "text", "code"]
    assert "".join(text[a:b] for _, a, b in blocks) == text


@pytest.mark.parametrize(
    "text,at,kind",
    [("ab", 0, "clean"), ("ab\ncd", 2, "clean"), ("ab\ncd", 3, "clean"), ("| a | b", 4, "table-row"), (" - item", 5, "list-item"), ("## Head", 4, "heading"), ("One. Two", 5, "sentence-end"), ("One two", 4, "mid-sentence"), ("One two", 2, "mid-sentence")],
)
def test_cut_kinds(spark, text, at, kind):
    row = one(spark, text).select(T.cut_kind(F.col("text"), F.lit(at)).alias("k")).first()
    assert row.k == kind


def test_cuts_stats_and_tables(spark):
    docs = one(spark, GUIDE)
    chunks = windows.fixed_windows(docs, 120, 20)
    cuts = inspection.find_cuts(chunks, docs, ["doc_id"])
    assert all(0 < r.position < len(GUIDE.rstrip("\n")) and "|" in r.context for r in cuts.collect())
    row = inspection.cut_summary(cuts, ["doc_id"]).first()
    assert sum(row[k.replace("-", "_")] for k in inspection.KINDS) == cuts.count()
    both = docs.unionByName(spark.createDataFrame([(2, "")], "doc_id long, text string"))
    stats = {r.doc_id: r for r in inspection.chunk_stats(chunks, both, ["doc_id"]).collect()}
    assert stats[2].chunks == 0 and stats[1].chunks == chunks.count()
    assert inspection.inspection_table(chunks).first().preview
    structure = sections.structure_chunks(docs, 30, 512)
    assert all(r.kind == "clean" for r in inspection.find_cuts(structure, docs, ["doc_id"]).collect())


def test_plans_have_no_python_and_one_exchange(spark):
    from pyspark.sql import SparkSession  # noqa: F401

    docs = one(spark, GUIDE)
    plan = sections.merged_units(sections.sections(docs), 100)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    fixed = windows.fixed_windows(docs, 50, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in fixed and "Python" not in fixed
