"""Chunk statistics and where chunks were cut (CH-15, AGG-1, AGG-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T

KINDS = ["table-row", "list-item", "heading", "mid-sentence", "sentence-end", "clean"]


def chunk_stats(chunks: DataFrame, docs: DataFrame, key: list[str], doc_key: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """AGG-1: count, mean, least, most and total tokens and redundancy per key.

    Documents without chunks stay, with a count of 0 (the rest null).
    """
    doc_key = doc_key or key
    held = chunks.groupBy(*key).agg(F.count(F.lit(1)).alias("chunks"), F.avg("est_tokens").alias("mean_tokens"), F.min("est_tokens").alias("min_tokens"), F.max("est_tokens").alias("max_tokens"), F.sum("est_tokens").alias("total_tokens"))
    sizes = docs.groupBy(*doc_key).agg(F.sum(T.estimated_tokens(F.col(text_col))).alias("doc_tokens"))
    out = sizes.join(held, doc_key, "left") if key == doc_key else held.join(sizes, doc_key)
    return out.withColumn("chunks", F.coalesce("chunks", F.lit(0))).withColumn("redundancy", F.col("total_tokens") / F.nullif(F.col("doc_tokens"), F.lit(0)))


def find_cuts(chunks: DataFrame, docs: DataFrame, key: list[str], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """CH-15: every chunk boundary inside its document: side, position, kind, mid_word, context."""
    keep = keep or [*key, "id"]
    ends = chunks.select(*keep, F.expr("stack(2, 'start', start_char, 'end', end_char) as (side, position)")).where("position > 0")
    # the length counts once a document; a cut looks at the text up to it and at a few characters around it, each once
    texts = docs.select(*key, F.col(text_col).alias("__text"), F.length(F.regexp_replace(text_col, "\n+\\z", "")).alias("__solid"))
    inside = ends.join(texts, key).where("position < __solid")
    text, at = F.col("__text"), F.col("position")
    inside = inside.select(*keep, "side", "position", "__text", F.substring_index(F.substring(text, F.lit(1), at), "\n", -1).alias("__before"), T.between(text, F.greatest(at - T.AROUND, F.lit(0)), at + T.AROUND).alias("__around"))
    left = F.least(at, F.lit(T.AROUND))
    around, after = F.col("__around"), F.substring(F.col("__around"), left + 1, F.lit(T.AROUND))
    pair = F.concat(F.substring(around, left, F.lit(1)), F.substring(after, 1, 1))
    kind = T.cut_kind_of(F.col("__before"), after, F.substring_index(F.substring(text, at + 1, F.length(text)), "\n", 1))
    return inside.select(*keep, "side", "position", kind.alias("kind"), pair.rlike(T.IN_WORD).alias("mid_word"), T.newlines_shown(F.concat(F.substring(around, F.lit(1), left), F.lit("|"), after)).alias("context"))


def cut_summary(cuts: DataFrame, by: list[str]) -> DataFrame:
    """AGG-2: cuts of each kind (zeros kept) and cuts inside a word."""
    counts = [F.count_if(F.col("kind") == k).alias(k.replace("-", "_")) for k in KINDS]
    return cuts.groupBy(*by).agg(*counts, F.count_if("mid_word").alias("mid_word"))


def noteworthy(cuts: DataFrame) -> DataFrame:
    """FLT-13: chunk ends that are not clean."""
    return cuts.where((F.col("side") == "end") & ((F.col("kind") != "clean") | F.col("mid_word")))


def inspection_table(chunks: DataFrame, width: int = 60) -> DataFrame:
    """CH-16: a chunk per row, its text on one line."""
    return chunks.select("id", "start_char", "end_char", "est_tokens", T.one_line(F.col("body"), width).alias("preview"))
