"""Markdown sections, sibling merging and structure chunks (CH-3 to CH-6, CH-14).

A document is split into lines and each heading's place in the outline comes from
windows over its document, so the whole strategy is one exchange by document; only
sections over the ceiling go through the splitter (``operators.splitter``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T

HEADING = "^(#{1,6})[ \\t]+(.+?)[ \\t]*#*[ \\t]*\\z"
FENCE = f"^[{T.UNICODE_SPACE}]*(```|~~~)"
KEY_HEADING = "^(#{1,6})[ \\t]+(.+?)[ \\t]*\\z"
LEVELS = range(1, 7)


def _fences(lines: Column) -> Column:
    """Fenced ranges of line numbers: a fence is closed by its own marker only."""
    marks = F.filter(F.transform(lines, lambda line, i: F.struct(i.alias("i"), F.regexp_extract(line, FENCE, 1).alias("m"))), lambda x: x["m"] != "")
    start = F.struct(F.lit("").alias("m"), F.lit(-1).alias("s"), F.array().cast("array<struct<s:int,e:int>>").alias("done"))

    def step(state: Column, mark: Column) -> Column:
        opened = F.struct(mark["m"].alias("m"), mark["i"].alias("s"), state["done"].alias("done"))
        closed = F.struct(F.lit("").alias("m"), F.lit(-1).alias("s"), F.concat(state["done"], F.array(F.struct(state["s"].alias("s"), mark["i"].alias("e")))).alias("done"))
        return F.when(state["m"] == "", opened).when(state["m"] == mark["m"], closed).otherwise(state)

    def finish(state: Column) -> Column:
        rest = F.array(F.struct(state["s"].alias("s"), F.lit(2**31 - 1).alias("e")))
        return F.when(state["m"] == "", state["done"]).otherwise(F.concat(state["done"], rest))

    return F.aggregate(marks, start, step, finish)


def _lines(docs: DataFrame, key: list[str], text_col: str, fenced: bool) -> DataFrame:
    """One row per line: n, line, start, and whether it stands in a fence."""
    lines = F.split(F.col(text_col), "\n")
    rows = docs.select(*key, F.length(text_col).alias("doc_length"), lines.alias("lines"))
    rows = rows.withColumn("fences", _fences(F.col("lines")) if fenced else F.array().cast("array<struct<s:int,e:int>>"))
    out = rows.select(*key, "doc_length", "fences", F.posexplode("lines").alias("n", "line"))
    order = Window.partitionBy(*key).orderBy("n")
    out = out.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    return out.withColumn("in_fence", F.exists("fences", lambda z: (F.col("n") >= z["s"]) & (F.col("n") <= z["e"]))).drop("fences")


def sections(docs: DataFrame, key: list[str] | None = None, text_col: str = "text", preamble: bool = False) -> DataFrame:
    """CH-3: sections of normalised Markdown texts.

    key columns, sec_no, level, title, path, heading_start, body_start, body_end (trimmed; equal if
    the body is blank).  What stands before the first heading belongs to no section unless
    ``preamble`` asks for a root section (level 0, empty path).
    """
    key = key or ["doc_id"]
    lines = _lines(docs, key, text_col, fenced=True)
    level = F.length(F.regexp_extract("line", HEADING, 1))
    heads = lines.where((level > 0) & ~F.col("in_fence")).select(
        *key, "doc_length", F.col("start").alias("heading_start"), (F.col("start") + F.length("line") + 1).alias("raw_start"), level.alias("level"), F.regexp_extract("line", HEADING, 2).alias("title")
    )
    if preamble:
        root = docs.select(*key, F.length(text_col).alias("doc_length"), F.lit(0).alias("heading_start"), F.lit(0).alias("raw_start"), F.lit(0).alias("level"), F.lit("").alias("title"))
        heads = heads.unionByName(root)
    order = Window.partitionBy(*key).orderBy("heading_start", "level")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    heads = heads.select(
        "*",
        (F.row_number().over(order) - 1).alias("sec_no"),
        F.coalesce(F.lead("heading_start").over(order), F.col("doc_length")).alias("raw_end"),
        *[F.last(F.when(F.col("level") == k, F.struct("heading_start", "title")), ignorenulls=True).over(upto).alias(f"l{k}") for k in LEVELS],
    )
    # a level is on the path if no lower one came after it
    on_path = []
    for k in LEVELS:
        here = F.col(f"l{k}")
        alive = (F.lit(k) <= F.col("level")) & here.isNotNull()
        for lower in range(1, k):
            alive &= F.col(f"l{lower}").isNull() | (F.col(f"l{lower}")["heading_start"] < here["heading_start"])
        on_path.append(F.when(alive, here["title"]))
    heads = heads.withColumn("path", F.array_compact(F.array(*on_path)))
    texts = docs.select(*key, F.col(text_col).alias("__text"))
    out = heads.join(texts, key)
    raw = T.between(F.col("__text"), F.least("raw_start", "raw_end"), F.col("raw_end"))
    out = out.withColumn("__raw", raw).withColumn("__body", T.unicode_trim(F.col("__raw")))
    body_start = F.when(F.col("__body") == "", F.col("raw_end")).otherwise(F.least("raw_start", "raw_end") + T.leading_space(F.col("__raw"))).cast("int")
    body_end = F.when(F.col("__body") == "", F.col("raw_end")).otherwise(body_start + F.length("__body")).cast("int")
    return out.select(*key, "sec_no", "level", "title", "path", F.col("heading_start").cast("int").alias("heading_start"), body_start.alias("body_start"), body_end.alias("body_end"))


def merged_units(found: DataFrame, min_tokens: int, key: list[str] | None = None) -> DataFrame:
    """CH-4, CH-5: non-empty sections with small neighbours of one parent merged.

    One row per unit: unit_no, path (the parent's where merged), titles, start, end and sections.
    The repeated merging of the smallest-first kind is a window: merges never leave a run of
    neighbours with one parent, and spans only grow.
    """
    key = key or ["doc_id"]
    rows = found.where("body_end > body_start")  # FLT-2
    order = Window.partitionBy(*key).orderBy("sec_no")
    parent = F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0)))
    rows = rows.withColumn("parent", F.array_join(F.transform(parent, lambda p: F.concat(F.length(p).cast("string"), F.lit(":"), p)), "/"))
    before = F.lag("parent").over(order)
    rows = rows.withColumn("__new_run", F.when(before.isNotNull() & (before == F.col("parent")), 0).otherwise(1))
    rows = rows.withColumn("__run", F.sum("__new_run").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*key, "__run").orderBy("sec_no")
    rows = rows.select("*", F.row_number().over(run).alias("__pos"), F.first("heading_start").over(run).alias("__h0"), F.first("body_start").over(run).alias("__b0"), F.lag("body_end").over(run).alias("__prev_end"))
    span = F.col("__prev_end") - F.when(F.col("__pos") == 2, F.col("__b0")).otherwise(F.col("__h0"))
    big = (T.tokens_of_length(F.col("body_end") - F.col("body_start")) >= min_tokens) & (T.tokens_of_length(span) >= min_tokens)
    rows = rows.withColumn("__first", F.when((F.col("__pos") == 1) | big, 1).otherwise(0))
    rows = rows.withColumn("unit_no", F.sum("__first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.array_sort(F.collect_list(F.struct("sec_no", "title", "path", "heading_start", "body_start", "body_end")))
    units = rows.groupBy(*key, "unit_no").agg(held.alias("sections"))
    one = F.size("sections") == 1
    head, tail = F.col("sections")[0], F.element_at("sections", -1)
    return units.select(
        *key,
        F.col("unit_no").cast("int").alias("unit_no"),
        F.size("sections").alias("sections"),
        F.when(one, head["path"]).otherwise(F.slice(head["path"], F.lit(1), F.greatest(F.size(head["path"]) - 1, F.lit(0)))).alias("path"),
        F.transform("sections", lambda s: s["title"]).alias("titles"),
        F.when(one, head["body_start"]).otherwise(head["heading_start"]).alias("start"),
        tail["body_end"].alias("end"),
    )


META = "struct<merged_from:array<string>,part:string,repeated_header:boolean>"


def structure_chunks(docs: DataFrame, min_tokens: int, max_tokens: int = 512, overlap_tokens: int = 0, prefix: bool = True, key: list[str] | None = None, text_col: str = "text", preamble: bool = False, split: bool = True) -> DataFrame:
    """CH-6: chunks that follow the outline.

    key, seq, id, heading_path, start_char, end_char, est_tokens, meta, text, body.  A unit whose text
    with its heading path is over ``max_tokens`` is split by ``operators.splitter``
    (``split=False`` leaves it whole, so the plan has no Python node).
    """
    from textloom.operators import splitter

    if min_tokens < 0 or max_tokens <= 0 or overlap_tokens < 0:
        raise ValueError("min_tokens and overlap_tokens must not be negative, max_tokens must be positive")
    key = key or ["doc_id"]
    units = merged_units(sections(docs, key, text_col, preamble), min_tokens, key)
    rows = units.join(docs.select(*key, F.col(text_col).alias("__text")), key)
    rows = rows.withColumn("__body", T.between(F.col("__text"), F.col("start"), F.col("end"))).withColumn("__header", T.header(F.col("path"), F.lit(prefix))).drop("__text")
    last = F.when(F.size("path") > 0, F.element_at("path", -1)).otherwise(F.lit("root"))
    rows = rows.withColumn("__slug", T.slug(last))
    again = F.row_number().over(Window.partitionBy(*key, "__slug").orderBy("unit_no"))
    rows = rows.withColumn("__base", F.concat(F.lit("B-"), F.col("__slug"), F.when(again > 1, F.concat(F.lit("-"), again.cast("string"))).otherwise(F.lit(""))))
    over = T.estimated_tokens(F.concat("__header", "__body")) > max_tokens
    piece = "array<struct<text:string,start:int,end:int,repeated_header:boolean>>"
    whole = F.array(F.struct(F.col("__body").alias("text"), F.lit(0).alias("start"), F.length("__body").alias("end"), F.lit(False).alias("repeated_header"))).cast(piece)
    if split:
        body = splitter.split_column(F.when(over, F.col("__body")), (F.lit(max_tokens * 4) - F.length("__header")).cast("int"), F.lit(overlap_tokens * 4))
        whole = F.coalesce(body, whole)
    rows = rows.withColumn("__pieces", whole).withColumn("__n", F.size("__pieces"))
    rows = rows.select(*key, "unit_no", "path", "titles", "start", "__header", "__base", "__n", F.posexplode("__pieces").alias("__k", "__p"))
    part = F.col("__n") > 1
    meta = F.struct(
        F.when(F.size("titles") > 1, F.col("titles")).alias("merged_from"),
        F.when(part, F.concat_ws("/", (F.col("__k") + 1).cast("string"), F.col("__n").cast("string"))).alias("part"),
        F.when(F.col("__p")["repeated_header"], F.lit(True)).alias("repeated_header"),
    )
    text = F.concat("__header", F.col("__p")["text"])
    seq = F.row_number().over(Window.partitionBy(*key).orderBy("unit_no", "__k")) - 1
    return rows.select(
        *key,
        seq.alias("seq"),
        F.concat("__base", F.when(part, F.concat(F.lit("-p"), (F.col("__k") + 1).cast("string"))).otherwise(F.lit(""))).alias("id"),
        F.col("path").alias("heading_path"),
        (F.col("start") + F.col("__p")["start"]).cast("int").alias("start_char"),
        (F.col("start") + F.col("__p")["end"]).cast("int").alias("end_char"),
        T.estimated_tokens(text).alias("est_tokens"),
        meta.alias("meta"),
        text.alias("text"),
        F.col("__p")["text"].alias("body"),
    )


def section_texts(docs: DataFrame, key: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """CH-14: heading -> text below it up to the next heading; fences do not count, the last of equal headings wins."""
    key = key or ["doc_id"]
    lines = _lines(docs, key, text_col, fenced=False)
    heads = lines.where(F.col("line").rlike(KEY_HEADING)).select(*key, "doc_length", "start", (F.col("start") + F.length("line")).alias("after"), F.regexp_extract("line", KEY_HEADING, 2).alias("heading"))
    stop = F.coalesce(F.lead("start").over(Window.partitionBy(*key).orderBy("start")), F.col("doc_length"))
    heads = heads.withColumn("stop", stop).groupBy(*key, "heading").agg(F.max(F.struct("start", "after", "stop")).alias("at"))
    return heads.join(docs.select(*key, F.col(text_col).alias("__text")), key).select(*key, "heading", T.between(F.col("__text"), F.col("at.after"), F.col("at.stop")).alias("text"))
