"""Quality classifier learned from trusted positives and unlabelled text.

Positive-unlabelled learning: a small network on features of style and of content
(hashed words and word pairs) minimises the non-negative unbiased risk
pi R+(f) + max(0, Ru-(f) - pi R-(f))  with logistic losses.  Labels enter as trusted
positives only.  pi, the share of good documents among the unlabelled ones, is estimated
from the two samples: a linear separator is fitted on one half of them, and on the other
half the unlabelled share above a threshold, over the positive share above it, bounds pi
from above; the least bound, with its sampling error, is taken.  The network never sees
label, language, source or id.

The training sample is bounded (``max_positive`` and ``max_unlabelled`` documents, drawn
by a hash of the id from all partitions); the score of every document uses its whole
text.  Defined results: a null or empty text is scored by its (zero) features; ties
and repeated rows get equal scores; without positives every score is 0.5; ids are cast
to long; an empty table gives an empty result; other columns pass through ``keep``
untouched (names that start with two underscores are kept for the operators).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import _pieces, hash_array, mix, words_of
from textloom.llm.rules import _codes, measure

#: Bounds of the training sample.
MAX_POSITIVE, MAX_UNLABELLED = 12_000, 24_000
THRESHOLD, FOLDS, HELD_OUT = 0.3, 5, 0
#: Features of style; of words and of word pairs, each hashed to so many.
STYLE, CONTENT = 26, 48
N_FEATURES = STYLE + 2 * CONTENT


def features(text: pa.Array) -> np.ndarray:
    """Style features of whole texts, one float32 row per text."""
    text = pc.fill_null(text, "")
    n = len(text)
    got = measure(text)
    words = np.maximum(got["n_words"], 1).astype(float)
    chars = np.maximum(pc.utf8_length(text).to_numpy(zero_copy_only=False), 1).astype(float)
    count = lambda p: pc.count_substring_regex(text, p).to_numpy(zero_copy_only=False).astype(float)
    flat, rows = words_of(text, lower=False)
    codes, kinds = _codes(flat)
    key, times = np.unique(rows * max(kinds, 1) + codes, return_counts=True)
    owner = key // max(kinds, 1)
    distinct = np.bincount(owner, minlength=n).astype(float)
    top = np.zeros(n)
    np.maximum.at(top, owner, times)
    again = np.zeros(n)
    if len(codes) > 1:
        same = (codes[1:] == codes[:-1]) & (rows[1:] == rows[:-1])
        again = np.bincount(rows[1:][same], minlength=n).astype(float)
    ends = pc.match_substring_regex(flat, r"[.!?]$").to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, bool)
    word_len = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(float) if len(flat) else np.zeros(0)
    long_words = np.bincount(rows, word_len > 15, minlength=n)
    second = np.bincount(rows, word_len**2, minlength=n) / words
    mean = got["word_chars"] / words
    lines = 1 + count("\n")
    upper, symbols, bang = count(r"\p{Lu}") / chars, got["n_symbols"] / words, count("!") / words
    digits, pipes = count(r"\p{Nd}") / chars, count(r"\|") / words
    shares = [upper, symbols, bang, digits, pipes, again / words, top / words, 1 - distinct / words, got["n_repeat_words"] / words, got["n_dup_lines"] / lines]
    parts = [np.sqrt(s) for s in shares] + [np.log10(s + 1e-3) for s in shares[:9]]
    parts += [np.log(words), mean / 10, np.sqrt(np.maximum(second - mean**2, 0)) / 10, np.bincount(rows, ends, minlength=n) / words, long_words / words, np.log(words / lines), count(r"[@/\\{}\[\]]") / words]
    return np.column_stack([*parts, content(flat, rows, codes, n)]).astype(np.float32)


def content(flat: pa.Array, rows: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """Signed shares of words, lower-cased, and of pairs of neighbours, each by hash in CONTENT columns."""
    out = np.zeros((n, 2 * CONTENT))
    if not len(codes):
        return out
    h = hash_array(pc.utf8_lower(flat.dictionary_encode().dictionary))[codes]
    pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    inside = rows[1:] == rows[:-1]
    size = np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))[:, None]
    for k, (key, row) in enumerate(((mix(h), rows), (pairs[inside], rows[1:][inside]))):
        slot = row * CONTENT + (key % np.uint64(CONTENT)).astype(np.int64)
        sign = 1.0 - 2.0 * (key >> np.uint64(63)).astype(float)
        out[:, k * CONTENT : (k + 1) * CONTENT] = np.bincount(slot, sign, minlength=n * CONTENT).reshape(n, CONTENT) / size
    return out


def separator(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights of a logistic regression of positive against unlabelled rows (gradient descent with momentum)."""
    x = np.concatenate([positive, unlabelled])
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.concatenate([np.full(len(positive), 0.5 / len(positive)), np.full(len(unlabelled), 0.5 / len(unlabelled))])
    y = np.arange(len(x)) < len(positive)
    w, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        speed = 0.9 * speed - 0.3 * (x.T @ (weight * (p - y)) + 1e-4 * w)
        w += speed
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled rows, from the two samples alone."""
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    w = separator(p[::2], u[::2])
    p, u = (x[1::2] @ w[:-1] for x in (p, u))
    cuts = np.quantile(p, np.linspace(0.02, 0.98, 97))
    above_p, above_u = ((x[:, None] >= cuts).mean(0) for x in (p, u))
    error = np.sqrt(np.log(8) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = np.argmin((above_u + error) / np.maximum(above_p, 1e-9))
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


class Network:
    """One hidden layer on standardised features; ``fit`` minimises the nnPU risk with Adam."""

    def __init__(self, hidden: int = 24, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.rng, self.mean, self.scale = rng, np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.w = [rng.normal(0, N_FEATURES**-0.5, (N_FEATURES, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(z @ self.w[0] + self.w[1])
        return z, h, h @ self.w[2] + self.w[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._forward(x)[2], -30, 30)))

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 30, batch: int = 512, rate: float = 6e-3, decay: float = 1e-5) -> Network:
        self.mean, self.scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.w]
        sigma = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
        step, steps = 0, max(1, len(unlabelled) // batch)
        for _ in range(epochs):
            order = self.rng.permutation(len(unlabelled))
            for at in range(steps):
                u = unlabelled[order[at * batch : (at + 1) * batch]]
                p = positive[self.rng.integers(0, len(positive), batch)]
                z, h, f = self._forward(np.concatenate([p, u]))
                fp, fu = f[: len(p)], f[len(p) :]
                negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
                slope = np.concatenate([-prior * sigma(-fp) / len(p), np.zeros(len(u))])  # of pi R+
                other = np.concatenate([-prior * sigma(fp) / len(p), sigma(fu) / len(u)])  # of Ru- - pi R-
                slope = slope + other if negative >= 0 else -other  # below 0: climb back
                back = np.outer(slope, self.w[2]) * (1 - h**2)
                grads = [z.T @ back + decay * self.w[0], back.sum(0), h.T @ slope + decay * self.w[2], slope.sum(keepdims=True)]
                step += 1
                for k, g in enumerate(grads):
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.w[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


def fold(id_col: str = "doc_id"):
    """True for the held-out fold; an id that is null is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _drawn(rows: DataFrame, id_col: str, most: int, salt: int) -> DataFrame:
    """About ``most`` rows at random by a hash of the id; all of them if there are fewer."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(salt), id_col), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> tuple[Network | None, float]:
    """Network and class prior from the training fold; (None, 0.5) without positives or without other documents."""
    train = labels.where(F.col(id_col).isNotNull() & (F.col("quality") == 1) & ~fold(id_col)).select(F.col(id_col).cast("long").alias("doc_id"))
    good = _drawn(train.distinct(), "doc_id", max_positive, 1)
    texts = docs.where(F.col(id_col).isNotNull() & ~fold(id_col)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    web = _drawn(texts.select("doc_id").distinct(), "doc_id", max_unlabelled, 2)
    # at most max_positive + max_unlabelled ids (and a few, by chance): under 1 MB to broadcast
    wanted = good.select("doc_id", F.lit(1).alias("trusted")).unionByName(web.select("doc_id", F.lit(0).alias("trusted")))

    def run(batches):
        for batch in batches:
            for piece in _pieces(batch, "text", 4 << 20):
                x = features(piece.column("text"))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("trusted"), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "trusted", "x"])

    rows = texts.join(F.broadcast(wanted), "doc_id").select("doc_id", "trusted", "text").mapInArrow(run, "doc_id long, trusted int, x array<float>")
    # an id counts once, however often its row repeats
    got = rows.groupBy("doc_id", "trusted").agg(F.max(F.struct(F.hash("x"), "x")).alias("one")).select("trusted", F.col("one.x").alias("x")).toArrow()
    x = np.array(got["x"].to_pylist(), np.float32).reshape(len(got), N_FEATURES)
    trusted = got["trusted"].to_numpy() == 1
    order = np.lexsort([*x.T, trusted])  # independent of the order of partitions
    x, trusted = x[order], trusted[order]
    if not trusted.any() or trusted.all():
        return None, 0.5
    prior = class_prior(x[trusted], x[~trusted])
    return Network().fit(x[trusted], x[~trusted], prior), prior


def scored(docs: DataFrame, network: Network | None, prior: float, carry: list[str], text_col: str = "text") -> DataFrame:
    """``carry`` columns and ``__score``."""
    rows = docs.select(*carry, *([] if text_col in carry else [text_col]))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in carry] + ["__score double"])

    def run(batches):
        for batch in batches:
            for piece in _pieces(batch, text_col, 4 << 20):
                x = features(piece.column(text_col))
                score = network.score(x) if network else np.full(len(x), prior)
                names = [c for c in piece.schema.names if c in carry]
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in names] + [pa.array(score.astype(float))], names=[*names, "__score"])

    return rows.mapInArrow(run, schema)


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``, with their own columns."""
    network, prior = fit(docs, labels, id_col, text_col)
    return scored(docs, network, prior, docs.columns, text_col).where(F.col("__score") >= threshold).select(*docs.columns)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    network, prior = fit(docs, labels, id_col, text_col)
    out = scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), network, prior, ["doc_id"])
    return out.select("doc_id", fold("doc_id").alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))
