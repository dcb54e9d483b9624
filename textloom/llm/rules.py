"""Quality rules with a host-level verdict.

Every document is measured over its whole text and judged by fixed rules; the
failures are aggregated by host (``source``), each host's failure rate is shrunk
towards the corpus by an empirical beta prior, and a host whose shrunk rate is
above ``max_host_rate`` takes its remaining documents with it.

Defined results: a null text counts as empty (0 words, so it fails); a null host
gets no host verdict; repeated rows are judged and counted one by one; an empty
table gives an empty result; columns of any other name pass through ``keep`` (names that
start with two underscores are kept for the operators).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import _pieces, mix, stored, words_of

#: Window of words that counts as a repeat when it is found twice.
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: A host above this shrunk failure rate is rejected as a whole.
MAX_HOST_RATE = 0.5
#: Rejected hosts are broadcast up to so many bytes of names; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(codes: np.ndarray, rows: np.ndarray, n_rows: int, window: int = WINDOW) -> np.ndarray:
    """Words per row that lie in a ``window``-word sequence found twice or more in that row."""
    out = np.zeros(n_rows, np.int64)
    n = len(codes) - window + 1
    if n < 2:
        return out
    h, rolling = mix(codes.astype(np.uint64) + np.uint64(1)), np.zeros(n, np.uint64)
    for j in range(window):
        rolling = rolling * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    starts = np.flatnonzero(rows[:n] == rows[window - 1 : window - 1 + n])
    key = mix(rolling[starts]) + mix(rows[starts].astype(np.uint64) + np.uint64(7))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(starts), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = starts[twice]
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    covered = np.cumsum(cover[:-1]) > 0
    return np.bincount(rows[covered], minlength=n_rows).astype(np.int64)


def measure(text: pa.Array) -> dict[str, np.ndarray]:
    """The five counts and ``base_failed`` of every text."""
    text = pc.fill_null(text, "")
    n = len(text)
    flat, rows = words_of(text, lower=False)
    n_words = np.bincount(rows, minlength=n).astype(np.int64)
    chars = np.bincount(rows, pc.utf8_length(flat).to_numpy(zero_copy_only=False), minlength=n).astype(np.int64) if len(flat) else np.zeros(n, np.int64)
    codes, _ = _codes(flat)
    repeat = repeated_words(codes, rows, n)
    symbols = pc.count_substring_regex(text, "[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64)
    lists = pc.split_pattern(text, "\n")
    line_rows = np.repeat(np.arange(n, dtype=np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    lines = lists.flatten()
    full = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    line_codes, kinds = _codes(lines)
    line_rows, line_codes = line_rows[full], line_codes[full]
    distinct = np.unique(line_rows * max(kinds, 1) + line_codes) // max(kinds, 1)
    dup = np.bincount(line_rows, minlength=n) - np.bincount(distinct, minlength=n)
    failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup.astype(np.int64), "n_repeat_words": repeat, "base_failed": failed}


def _codes(flat: pa.Array) -> tuple[np.ndarray, int]:
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(d.dictionary)


def measured(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """``carry`` columns of ``docs`` plus the counts under ``__``-prefixed names (no clash)."""
    keep = docs.select(*carry, *([] if text_col in carry else [text_col]))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema if f.name in carry] + [f"__{c} long" for c in STATS] + ["__base_failed boolean"])

    def run(batches):
        for batch in batches:
            for piece in _pieces(batch, text_col, 4 << 20):
                got = measure(piece.column(text_col))
                names = [c for c in piece.schema.names if c in carry]
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in names] + [pa.array(got[c]) for c in [*STATS, "base_failed"]], names=names + [f"__{c}" for c in [*STATS, "base_failed"]])

    return keep.mapInArrow(run, schema)


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Beta prior of host failure rates by moments: between-host variance net of sampling noise."""
    total = hosts.agg(F.sum("n").alias("n"), F.sum("fails").alias("f"), F.count(F.lit(1)).alias("h")).first()
    if not total["n"]:
        return 1.0, 1.0
    n, h = float(total["n"]), float(total["h"])
    m = min(max(float(total["f"]) / n, 1e-6), 1 - 1e-6)
    spread = float(hosts.agg(F.sum(F.col("n") * F.pow(F.col("fails") / F.col("n") - m, 2))).first()[0] or 0.0) / n
    between = max(spread - m * (1 - m) * h / n, 1e-9)
    strength = min(max(m * (1 - m) / between - 1, 1.0), 1e6)
    return m * strength, (1 - m) * strength


def host_verdicts(failures: DataFrame, host_col: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n, fails, rate, rejected) from rows of (host, __base_failed)."""
    hosts = stored(
        failures.where(F.col(host_col).isNotNull())
        .groupBy(F.col(host_col).alias("host"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__base_failed").cast("long")).alias("fails"))
    )
    a, b = beta_prior(hosts)
    rate = (F.col("fails") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    return hosts.withColumn("rate", rate).withColumn("rejected", rate > F.lit(max_host_rate))


def with_verdict(rows: DataFrame, verdicts: DataFrame, host_col: str = "source") -> DataFrame:
    """Add ``__kept``: the document's own rules, then its host's verdict."""
    bad = verdicts.where("rejected").select(F.col("host").alias("__host"), F.lit(True).alias("__bad"))
    if (bad.agg(F.sum(F.octet_length("__host") + 32)).first()[0] or 0) <= BROADCAST_BYTES:
        bad = F.broadcast(bad)
    return rows.join(bad, F.col(host_col) == F.col("__host"), "left").withColumn("__kept", ~F.col("__base_failed") & F.col("__bad").isNull()).drop("__host", "__bad")


def keep(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents that pass, with their own columns."""
    rows = stored(measured(docs, docs.columns, text_col))
    verdicts = host_verdicts(rows.select(host_col, "__base_failed"), host_col, max_host_rate)
    return with_verdict(rows, verdicts, host_col).where("__kept").select(*docs.columns)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per document: its counts, ``base_failed`` and ``kept``."""
    rows = stored(measured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("source")), ["doc_id", "source"]))
    out = with_verdict(rows, host_verdicts(rows.select("source", "__base_failed"), "source", max_host_rate))
    return out.select("doc_id", *[F.col(f"__{c}").alias(c) for c in STATS], F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))
