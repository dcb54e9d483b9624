"""Fixed windows over texts (CH-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T


def fixed_windows(docs: DataFrame, size: int, overlap: int, text_col: str = "text") -> DataFrame:
    """Windows of ``size`` characters, each starting ``size - overlap`` after the last.

    One row per window with the document's columns and seq, id, start_char, end_char,
    body and est_tokens; a text no longer than a window is one window, an empty one none.
    No shuffle: a document unfolds where it lies.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step, length = size - overlap, F.length(text_col)
    count = F.when(length <= size, F.lit(1)).otherwise(1 + F.ceil((length - size) / F.lit(float(step)))).cast("int")
    numbers = F.when(length > 0, F.sequence(F.lit(0), count - 1))
    out = docs.withColumn("seq", F.explode(numbers)).withColumn("start_char", (F.col("seq") * step).cast("int"))
    out = out.withColumn("end_char", F.least(F.col("start_char") + size, length).cast("int"))
    out = out.withColumn("body", T.between(F.col(text_col), F.col("start_char"), F.col("end_char")))
    return out.withColumn("id", T.window_id(F.col("seq"))).withColumn("est_tokens", T.estimated_tokens(F.col("body")))


def rebuilt(windows: DataFrame, key: list[str], overlap: int) -> DataFrame:
    """The texts that windows were cut from: each window without what the one before has."""
    from pyspark.sql import Window

    by = Window.partitionBy(*key).orderBy("seq")
    seen = F.coalesce(F.lag("end_char").over(by), F.lit(0))
    parts = windows.select(*key, "seq", F.substring("body", F.greatest(seen - F.col("start_char"), F.lit(0)) + 1, F.length("body")).alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "part")))
    return parts.groupBy(*key).agg(F.array_join(F.transform(ordered, lambda p: p["part"]), "").alias("text"))
