"""Packing token sequences into fixed windows by best-fit decreasing.

A document is tokenised whole and closed by an end id; what is longer than a
window is first cut into full windows, which are sequences of their own, and only the
remainder is packed.  The remainders, one to a document at most, are dealt over cells
of bounded size; in a cell a segment tree indexed by remaining capacity finds the
tightest open window for each piece, longest first, in O(log window).  A cell wastes at
most part of its last windows, so the padding per token does not grow with the corpus,
and no task sees more than one cell at a time.

Defined results: a null or empty text is one piece (its end id); repeated rows are
packed one by one; ties in length go by (doc_id, start); an empty table gives an
empty result.  Names of other columns cannot clash: only id and text are read.
"""

from __future__ import annotations

import math
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import _pieces, docs_view, stored, tidy, words_of

WINDOW, END_ID = 2048, 1
#: Remainders dealt to one packing cell (about 5 MB of piece rows).
CELL_PIECES = 50_000
#: Sequence ids of full windows start here; below it stand cell and window number.
FULL = 1 << 62
#: Distinct words a worker remembers the ids of.
REMEMBERED = 400_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordTokenizer:
    """Whole-text ids of a tokenizer that drops white space and never joins across it.

    Such a tokenizer encodes a text as the concatenation of its words' ids, so every
    distinct word is encoded once and remembered.  A word of Latin letters, with or
    without one mark after it, is the ids of its lower-case letters and of the mark.
    Words are encoded in joined groups with a digit between them, which the tokenizer
    always makes an id of its own.  Whether a vocabulary is of this kind is tried out on
    PROBES when it is loaded; texts of any other one are encoded whole.
    """

    MARKS, JOIN, GROUP = ".,!?;:", "0", 256
    PROBES = ("Word word, WORD! a.b c0d 00 10,000", "l'été don't I'm ÀÉ.", "  x\ty\n\nz  0 ", "ΣΑΣ. ß ẞ é", "日本語。 ½ Ⅷ", "::: . ; <a> #b", "über-All 3.14 e.g., x=1", "aB?! Cd;: (e)")

    def __init__(self, spec: str) -> None:
        # a task has one core; threads would only add memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_str(spec)
        self.inner.encode_special_tokens = True  # their strings in a text are ordinary text
        mark = self.inner.encode(self.JOIN, add_special_tokens=False).ids
        self.mark, self.by_word = mark[0] if mark else -1, len(mark) == 1
        self._forget()
        if self.by_word:
            try:
                ids, counts = self(pa.array(self.PROBES))
                whole = self._whole(pa.array(self.PROBES))
                self.by_word = counts.tolist() == whole[1].tolist() and ids.tolist() == whole[0].tolist()
            except (ValueError, IndexError):  # marks were lost among the ids
                self.by_word = False
            self._forget()

    def _whole(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.inner.encode_batch(pc.fill_null(text, "").to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *[np.array(x, np.uint32) for x in got]]), np.fromiter(map(len, got), np.int64, len(got))

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.first, self.size = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.held = 0

    def _learn(self, words: list[str]) -> None:
        """Ids of words that are not known yet."""
        plain = [w for w in words if self.JOIN not in w]
        odd = [w for w in words if self.JOIN in w] if len(plain) < len(words) else []
        ids, sizes = [], []
        groups = [plain[at : at + self.GROUP] for at in range(0, len(plain), self.GROUP)]
        for at in range(0, len(groups), 64):
            texts = [f" {self.JOIN} ".join(g) + f" {self.JOIN}" for g in groups[at : at + 64]]
            for got in self.inner.encode_batch(texts, add_special_tokens=False):
                got = np.array(got.ids, np.uint32)
                marks = np.flatnonzero(got == self.mark)
                sizes.append(np.diff(marks, prepend=-1) - 1)
                ids.append(np.delete(got, marks))
        for got in self.inner.encode_batch(odd, add_special_tokens=False):
            ids.append(np.array(got.ids, np.uint32))
            sizes.append(np.array([len(got.ids)]))
        sizes = np.concatenate(sizes)
        n = len(self.known)
        self.known.update(zip(plain + odd, range(n, n + len(words)), strict=True))
        self.pool.append(np.concatenate(ids))
        self.size.append(sizes)
        self.first.append(self.held + np.cumsum(sizes) - sizes)
        self.held += int(sizes.sum())

    def _numbers(self, words: list[str]) -> np.ndarray:
        fresh = [w for w in words if w not in self.known]
        if fresh:
            self._learn(fresh)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat uint32 ids of all texts, and the number of ids of each."""
        if not self.by_word:
            return self._whole(text)
        flat, rows = words_of(text, lower=False)
        if not len(flat):
            return np.zeros(0, np.uint32), np.zeros(len(text), np.int64)
        if len(self.known) > REMEMBERED:
            self._forget()
        d = flat.dictionary_encode()
        codes, words = d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary
        stem = pc.utf8_rtrim(words, self.MARKS)
        cut = pc.subtract(pc.utf8_length(words), pc.utf8_length(stem)).to_numpy(zero_copy_only=False)
        simple = (cut <= 1) & pc.match_substring_regex(stem, "^[a-zA-ZÀ-ÖØ-öø-ÿ]+$").to_numpy(zero_copy_only=False)
        keys = pc.if_else(pa.array(simple), pc.utf8_lower(stem), words).dictionary_encode()
        number = self._numbers(keys.dictionary.to_pylist())[keys.indices.to_numpy(zero_copy_only=False)]
        last = np.full(len(number), -1)
        marked = np.flatnonzero(simple & (cut == 1))
        if len(marked):
            marks = pc.utf8_slice_codeunits(words.take(pa.array(marked)), -1).dictionary_encode()
            last[marked] = self._numbers(marks.dictionary.to_pylist())[marks.indices.to_numpy(zero_copy_only=False)]
        pool, first, size = (np.concatenate(x) for x in (self.pool, self.first, self.size))
        self.pool, self.first, self.size = [pool], [first], [size]
        tail = np.where(last >= 0, size[last], 0)
        # a distinct word is two runs of the pool, its letters and its mark; a text is runs of words
        own = _runs(pool, np.column_stack([first[number], first[last]]).ravel(), np.column_stack([size[number], tail]).ravel())
        each = size[number] + tail
        ids = _runs(own, (np.cumsum(each) - each)[codes], each[codes])
        return ids, np.bincount(rows, each[codes], minlength=len(text)).astype(np.int64)


def _runs(pool: np.ndarray, begin: np.ndarray, each: np.ndarray) -> np.ndarray:
    """The runs ``pool[begin : begin + each]``, one after the other."""
    ends = np.cumsum(each)
    at = np.repeat((begin - ends + each).astype(np.int32), each)
    at += np.arange(len(at), dtype=np.int32)
    return pool[at]


def cut(docs: DataFrame, spec: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: full windows and one remainder, with the CRC of their ids."""

    def run(batches):
        tokenizer = WordTokenizer(spec)
        for batch in batches:
            for piece in _pieces(batch, "text", 2 << 20):
                ids, counts = tokenizer(piece.column("text"))
                ends, rows = np.cumsum(counts), []
                tail = np.array([end_id], "<u4").tobytes()
                raw = ids.astype("<u4").tobytes()
                for doc, end, n in zip(piece.column("doc_id").to_pylist(), ends.tolist(), counts.tolist(), strict=True):
                    data, total = raw[4 * (end - n) : 4 * end] + tail, n + 1
                    rows += [(doc, at, min(window, total - at), zlib.crc32(data[4 * at : 4 * (at + window)]), total) for at in range(0, total, window)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        del tokenizer  # what it remembers goes with the task, not with the worker
        tidy()

    return docs_view(docs).mapInArrow(run, PIECES)


class CapacityTree:
    """Segment tree over capacities 0..size: does a window with that much room exist."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        at, count = capacity + self.leaves, self.count
        while at:
            count[at] += by
            at >>= 1

    def tightest(self, need: int) -> int:
        """The least capacity >= need that is present, or -1."""
        at, count = need + self.leaves, self.count
        if count[at]:
            return need
        while at > 1:
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each length; lengths come longest first."""
    tree, open_at, bins, offsets, n = CapacityTree(window), {}, [], [], 0
    for length in lengths:
        room = tree.tightest(length) if length < window else -1
        if room < 0:
            number, room, n = n, window, n + 1
        else:
            number = open_at[room].pop()
            tree.add(room, -1)
        bins.append(number)
        offsets.append(window - room)
        if room - length:
            open_at.setdefault(room - length, []).append(number)
            tree.add(room - length, 1)
    return bins, offsets


def pack_pieces(pieces: DataFrame, cells: int, window: int = WINDOW) -> DataFrame:
    """Best-fit decreasing within each of ``cells`` cells."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        table = table.take(order)
        bins, offsets = best_fit(table["length"].to_pylist(), window)
        base = key[0].as_py() << 32
        return table.drop_columns(["cell"]).append_column("sequence_id", pa.array([base + b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    # by the place of the row as well: rows that repeat go to many cells
    dealt = pieces.withColumn("cell", F.pmod(F.xxhash64("doc_id", "ids_crc32", "start", F.monotonically_increasing_id()), F.lit(cells)).cast("long"))
    return dealt.groupBy("cell").applyInArrow(run, f"{PIECES}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    The tokenizer file (a few MB) is read by the driver and sent with the task.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    pieces = stored(cut(docs, spec, window, end_id))
    full, rest = pieces.where(F.col("length") == window), pieces.where(F.col("length") < window)
    cells = max(1, math.ceil(rest.count() / CELL_PIECES))
    full = full.withColumn("sequence_id", F.lit(FULL) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return full.unionByName(pack_pieces(rest, cells, window))
