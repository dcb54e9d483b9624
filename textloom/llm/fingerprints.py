"""Document fingerprints: improbable byte features in chained Bloom filters.

Every ``SPAN``-byte window of a text has an entropy; windows are ranked by how rare
their entropy is in the corpus (a histogram over all texts, 1001 numbers), and a
window is a feature if it is the rarest of its neighbours often enough.  The distinct
features of a text, in order, are inserted with five hashes into 2048-bit filters; a
filter takes ``CAPACITY`` features, then the next one is chained on.  Two fingerprints
are as alike as their filters' bits overlap beyond chance, each filter against its
best partner, weighted by bits, from both sides.

Defined results: a null text is empty; a text without features (empty) is like (1)
another one without, and unlike (0) any other; a text with few windows takes them all
(and a very short one its small windows too); equal texts have equal fingerprints;
rows that repeat an id stand in the order of their texts; a null id comes first; an
empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import _pieces, discard, docs_view, hash_strings, mix, spread, stored
from textloom.llm.suffixes import loads

SPAN, NEIGHBOURS, POPULAR = 16, 32, 10
#: Texts under SHORT bytes also give all their TINY-byte windows as features.
SHORT, TINY = 64, 4
BITS, HASHES, CAPACITY = 2048, 5, 160
#: Overlaps below this share are taken for chance.
NOISE = 0.1
#: Parts that a crowded cell of the id histogram is cut into, and bytes of text that a range of ids holds at most.
SPLIT, MOST_BYTES = 64, 256 << 20
PIECE = 2 << 20
_SCALE = 1 << 20
_F = np.round(np.arange(SPAN + 2) * np.log2(np.maximum(np.arange(SPAN + 2), 1)) * _SCALE).astype(np.int64)
_STEP = np.concatenate([[0], np.diff(_F)])  # what the k-th equal byte adds to the sum of n log n
NULL_ID = -(1 << 63)


def texts_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other (with spare bytes), and their bounds."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])
    return np.frombuffer(b"".join(raw) + b"\0" * (SPAN + 16), np.uint8), bounds


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy of the window at every position, 0 to 1000, from sliding byte counts."""
    n = len(data) - SPAN + 1
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for lag in range(1, SPAN):
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    first = int(_F[np.bincount(data[:SPAN], minlength=256)].sum())
    change = _STEP[1 + before[SPAN : SPAN + n - 1]] - _STEP[1 + after[: n - 1]]
    total = first + np.concatenate([[0], np.cumsum(change)])
    return ((np.log2(SPAN) * SPAN * _SCALE - total) * (1000 / (np.log2(SPAN) * SPAN * _SCALE)) + 1e-6).astype(np.int16)


def window_rows(bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows inside a text, and their rows."""
    counts = np.maximum(np.diff(bounds) - SPAN + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(row)) + np.repeat(bounds[:-1] - np.cumsum(counts) + counts, counts), row


def rarity(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy, 0 for the rarest in the corpus."""

    def run(batches):
        seen = np.zeros(1001, np.int64)
        for batch in batches:
            for piece in _pieces(batch, "text", PIECE):
                data, bounds = texts_bytes(piece.column("text").to_pylist())
                seen += np.bincount(entropies(data)[window_rows(bounds, len(data))[0]], minlength=1001)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(seen[used])], names=["entropy", "n"])

    counts = np.zeros(1001)
    for r in docs_view(docs).select("text").mapInArrow(run, "entropy int, n long").groupBy("entropy").agg(F.sum("n").alias("n")).collect():
        counts[r["entropy"]] = r["n"]
    rank = np.zeros(1001, np.int64)
    rank[np.lexsort((np.arange(1001), counts))] = np.arange(1001)
    return rank


class Prints:
    """Fingerprints of a list of texts."""

    def __init__(self, texts: list[str], rank: np.ndarray) -> None:
        data, bounds = texts_bytes(texts)
        row, feature = self._features(texts, data, bounds, rank)
        first = self._distinct(row, feature)
        row, feature = row[first], feature[first]
        self.n_features = np.bincount(row, minlength=len(texts)).astype(np.int64)
        ordinal = np.arange(len(row)) - np.repeat(np.cumsum(self.n_features) - self.n_features, self.n_features)
        n_filters = -(-self.n_features // CAPACITY)
        self.begin = np.concatenate([[0], np.cumsum(n_filters)])
        at = self.begin[row] + ordinal // CAPACITY
        bits = np.zeros(int(self.begin[-1]) * BITS, np.uint8)
        for k in range(HASHES):
            bits[at * BITS + ((feature >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
        self.filters = np.packbits(bits).view(np.uint64).reshape(-1, BITS // 64)

    @staticmethod
    def _distinct(row: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """Positions of each row's features where they come first, in order."""
        order = np.lexsort((np.arange(len(row)), feature, row))
        r, f = row[order], feature[order]
        fresh = np.concatenate([[True], (r[1:] != r[:-1]) | (f[1:] != f[:-1])]) if len(order) else np.zeros(0, bool)
        return np.sort(order[fresh])

    @staticmethod
    def _features(texts: list[str], data: np.ndarray, bounds: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, row = window_rows(bounds, len(data))
        counts = np.bincount(row, minlength=len(texts))
        chosen = counts[row] < NEIGHBOURS  # few windows: all of them
        if len(start):
            n = len(start)
            key = rank[entropies(data)[start]] * np.int64(n) + np.arange(n)  # the leftmost of the rarest
            reach = 1
            least = key
            while reach < NEIGHBOURS:
                least = np.minimum(least[:-reach], least[reach:])
                reach *= 2
            inside = row[: len(least)] == row[NEIGHBOURS - 1 : NEIGHBOURS - 1 + len(least)]
            wins = np.bincount(least[inside] % n, minlength=n)
            chosen |= wins >= POPULAR
            some = np.bincount(row[chosen], minlength=len(texts))
            chosen |= some[row] == 0  # nothing stands out: all of them
        at = np.flatnonzero(chosen)
        w = loads(data)
        feature = mix(w[start[at]] * np.uint64(0x9E3779B97F4A7C15) + w[start[at] + 8] * np.uint64(0xC2B2AE3D27D4EB4F))
        size = np.diff(bounds)
        tiny = np.flatnonzero((size < TINY) & (size > 0))
        counts = np.where(size < SHORT, np.maximum(size - TINY + 1, 0), 0)
        short = np.repeat(np.arange(len(size)), counts)
        place = np.arange(len(short)) + np.repeat(bounds[:-1] - np.cumsum(counts) + counts, counts)
        row = np.concatenate([row[at], short, tiny])
        feature = np.concatenate([feature, mix((w[place] & np.uint64(0xFFFFFFFF)) + np.uint64(1 << 40)), hash_strings([texts[k] for k in tiny])])
        order = np.argsort(row, kind="stable")
        return row[order], feature[order]

    def of(self, k: int) -> np.ndarray:
        return self.filters[self.begin[k] : self.begin[k + 1]]

    def text(self, k: int) -> str:
        """Number of features, then the filters."""
        return f"{self.n_features[k]}:{base64.b64encode(self.of(k).tobytes()).decode()}"


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Bit overlap beyond chance of two chains of filters, 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and (a == b).all():
        return 1.0
    na, nb = np.bitwise_count(a).sum(1).astype(float), np.bitwise_count(b).sum(1).astype(float)
    best_a, best_b = np.zeros(len(a)), np.zeros(len(b))
    step = max(1, 4096 // len(b))
    for at in range(0, len(a), step):
        shared = np.bitwise_count(a[at : at + step, None] & b[None]).sum(2).astype(float)
        chance = na[at : at + step, None] * nb[None] / BITS
        over = np.maximum(shared - chance, 0)
        best_a[at : at + step] = (over / np.maximum(na[at : at + step, None] - chance, 1e-9)).max(1)
        best_b = np.maximum(best_b, (over / np.maximum(nb[None] - chance, 1e-9)).max(0))
    best_a[best_a < NOISE] = 0
    best_b[best_b < NOISE] = 0
    return float(min(1.0, ((na * best_a).sum() + (nb * best_b).sum()) / (na.sum() + nb.sum())))


def ranges(rows: DataFrame, wanted: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first id, bytes) of the cells of an id histogram, none over its share unless it is one id.

    ``rows``: okey, n_bytes.  Cells that hold too much are cut into SPLIT equal parts until none
    does; so many cells are needed as there are shares of all bytes.
    """
    low, high, total = rows.agg(F.min("okey"), F.max("okey"), F.sum("n_bytes")).first()
    if total is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    share, narrow = max(1, min(total // wanted, most)), rows
    # a cell is its first and last id; null ids (the least number) stand apart
    cells, size = [(low, low), (low + 1, high)] if low == NULL_ID else [(low, high)], {}
    while cells:
        found = rows.withColumn("cell", cell_of(np.array([c[0] for c in cells], np.int64))(F.col("okey"))).groupBy("cell").agg(F.sum("n_bytes").alias("n"), F.min("okey").alias("first"), F.max("okey").alias("last")).collect()
        cells = []
        for r in sorted(found, key=lambda r: r["cell"]):
            a, b = r["first"], r["last"]
            if r["n"] <= share or a == b:
                size[a] = r["n"]
                continue
            width = -(-(b - a + 1) // SPLIT)
            cells += [(x, min(x + width - 1, b)) for x in range(a, b + 1, width)]
        if cells:  # only what lies in the open cells is counted again
            rows = narrow.where(within(np.array([c[0] for c in cells], np.int64), np.array([c[1] for c in cells], np.int64))(F.col("okey")))
    firsts = np.array(sorted(size), np.int64)
    return firsts, np.array([size[x] for x in firsts.tolist()], np.int64)


def cell_of(starts: np.ndarray):
    """Number of the last of ``starts`` that is not above an id."""

    @F.pandas_udf("long")
    def number(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, ids.to_numpy(np.int64), side="right") - 1)

    return number


def within(starts: np.ndarray, stops: np.ndarray):
    """Whether an id lies in one of the cells."""

    @F.pandas_udf("boolean")
    def inside(ids: pd.Series) -> pd.Series:
        ids = ids.to_numpy(np.int64)
        at = np.searchsorted(starts, ids, side="right") - 1
        return pd.Series((at >= 0) & (ids <= stops[np.maximum(at, 0)]))

    return inside


def in_id_order(docs: DataFrame) -> DataFrame:
    """(bucket, extra, okey, doc_id, text): ranges of ids, each followed by the next row.

    A partition holds whole buckets sorted by id; rows with ``extra`` = 1 are copies of the
    first row(s) of the following bucket (of the first one, after the last).  Buckets hold
    about equal bytes, MOST_BYTES at most unless one id alone has more.
    """
    spark = docs.sparkSession
    rows = docs_view(docs).withColumn("okey", F.coalesce("doc_id", F.lit(NULL_ID)))
    wanted = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = stored(rows.select("okey", (F.octet_length("text") + 64).cast("long").alias("n_bytes")))
    firsts, size = ranges(narrow, 4 * wanted, MOST_BYTES)
    discard(narrow)
    share = max(1, min(int(size.sum()) // wanted, MOST_BYTES))
    starts, held = [], 0
    for first, n in zip(firsts.tolist(), size.tolist(), strict=True):
        if not starts or held + n // 2 >= share:
            starts.append(first)
            held = 0
        held += n
    rows = rows.withColumn("bucket", cell_of(np.array(starts or [0], np.int64))(F.col("okey")).cast("int"))
    # the first id of each bucket goes to the bucket before it as well: one row for each MOST_BYTES of text
    ahead = F.broadcast(spark.createDataFrame(pa.table({"okey": pa.array(starts, pa.int64()), "to": pa.array([(b - 1) % len(starts) for b in range(len(starts))], pa.int32())})))
    extra = rows.join(ahead, "okey").withColumn("bucket", F.col("to")).drop("to")
    both = rows.withColumn("extra", F.lit(0)).unionByName(extra.withColumn("extra", F.lit(1)))
    return spread(both, "bucket", wanted).sortWithinPartitions("bucket", "extra", "okey", "text")


def edit(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first ones of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compare_neighbours(docs: DataFrame, rank: np.ndarray | None = None) -> DataFrame:
    """Fingerprint of each text and of its edited text, and their likenesses."""
    rank = rarity(docs) if rank is None else rank

    def work(ids, extra, texts, following):
        edited = [edit(a, b) for a, b in zip(texts, [*texts[1:], following], strict=True)]
        own, other = Prints([*texts, following], rank), Prints(edited, rank)
        keep = [k for k in range(len(texts)) if not extra[k]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([ids[k] for k in keep], pa.int64()),
                pa.array([len(texts[k]) for k in keep], pa.int64()),
                pa.array([hashlib.sha256(edited[k].encode("utf-8", "surrogatepass")).hexdigest() for k in keep], pa.string()),
                pa.array([own.text(k) for k in keep], pa.string()),
                pa.array([other.text(k) for k in keep], pa.string()),
                pa.array([likeness(own.of(k), other.of(k)) for k in keep], pa.float64()),
                pa.array([likeness(own.of(k), own.of(k + 1)) for k in keep], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches):
        held = None
        for batch in batches:
            for piece in _pieces(batch, "text", PIECE):
                cols = [piece.column(c).to_pylist() for c in ("doc_id", "extra", "text")]
                if held:
                    yield work(*held, cols[2][0])
                held = cols
        if held:  # the last row of a partition is an extra one
            yield work(*held, "")

    return in_id_order(docs).select("doc_id", "extra", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
