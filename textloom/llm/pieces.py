"""SentencePiece encoding and decoding by an Aho-Corasick automaton and Viterbi.

All pieces of the vocabulary are the patterns of one automaton; a single pass over a
text follows its output links, and each piece that ends at a position relaxes the best
score of that position.  The segmentation is the one of the greatest sum of piece
scores; a character that no piece covers becomes its UTF-8 bytes (byte pieces), at a
score below any piece.  Ties go to the longer last piece.

A text gets a space before it and every space becomes U+2581, as the vocabulary's own
normaliser does; nothing else is normalised, and a U+2581 of the text itself goes by
bytes, so decoding gives back every text exactly.  No piece holds a space mark after
another character, so the best segmentation never joins what a mark starts with what
stands before it: texts fall apart into words, and a word is segmented once per task.

Defined results: a null text is encoded as empty (no ids) and decodes to an empty text;
repeated rows are encoded one by one; an empty table gives an empty result; names of
other columns cannot clash.  The vocabulary file (under 1 MB) is read by the driver
and sent with the task.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from textloom.llm.common import _pieces, docs_view
from textloom.llm.packing import _runs

MARK = "▁"
WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Score of a character in bytes: below the worst piece by this much.
UNCOVERED = 10.0
#: Words a worker remembers the ids of.
REMEMBERED = 300_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def vocabulary(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = [(model.is_unknown, UNKNOWN), (model.is_control, CONTROL), (model.is_unused, UNUSED), (model.is_byte, BYTE)]
    out = []
    for k in range(model.get_piece_size()):
        out.append((model.id_to_piece(k), model.get_score(k), next((kind for test, kind in kinds if test(k)), NORMAL)))
    return out


class Automaton:
    """Aho-Corasick automaton over strings: goto, failure and output links as arrays of dicts."""

    def __init__(self, patterns: list[tuple[str, int, float]]) -> None:
        self.goto: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, int, float] | None] = [None]  # (length, id, score)
        for text, number, score in patterns:
            state = 0
            for ch in text:
                following = self.goto[state].get(ch)
                if following is None:
                    following = len(self.goto)
                    self.goto[state][ch] = following
                    self.goto.append({})
                    self.ends.append(None)
                state = following
            if self.ends[state] is None:
                self.ends[state] = (len(text), number, score)
        self.fail, self.output = [0] * len(self.goto), [0] * len(self.goto)
        queue = list(self.goto[0].values())
        for state in queue:
            for ch, following in self.goto[state].items():
                back = self.fail[state]
                while back and ch not in self.goto[back]:
                    back = self.fail[back]
                self.fail[following] = self.goto[back].get(ch, 0)
                queue.append(following)
            # the nearest shorter pattern that ends here too
            back = self.fail[state]
            self.output[state] = back if self.ends[back] else self.output[back]


class Pieces:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, entries: list[tuple[str, float, int]]) -> None:
        self.texts = [t for t, _, _ in entries]
        self.bytes = {int(t[3:5], 16): k for k, (t, _, kind) in enumerate(entries) if kind == BYTE}
        self.byte_of = {k: b for b, k in self.bytes.items()}
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        usable = [(t, k, s) for k, (t, s, kind) in enumerate(entries) if kind in (NORMAL, USER) and t]
        self.uncovered = min((s for _, _, s in usable), default=0.0) - UNCOVERED
        self.automaton = Automaton(usable)
        #: Whether texts fall apart at space marks.
        self.by_word = not any(MARK in t.lstrip(MARK) for t, _, _ in usable)
        #: What each id stands for in a decoded text.
        self.raw = [bytes([self.byte_of[k]]) if k in self.byte_of else t.replace(MARK, " ").encode("utf-8", "surrogatepass") for k, t in enumerate(self.texts)]
        self.known: dict[str, tuple[np.ndarray, float]] = {}

    def viterbi(self, text: str) -> tuple[list[int], float]:
        """Best segmentation of a text in which marks stand for spaces."""
        goto, fail, ends, output = self.automaton.goto, self.automaton.fail, self.automaton.ends, self.automaton.output
        best, back = [0.0], [(0, -1)]
        state = 0
        for at, ch in enumerate(text, 1):
            while state and ch not in goto[state]:
                state = fail[state]
            state = goto[state].get(ch, 0)
            top, link = best[at - 1] + self.uncovered, (1, -1)
            hit = state if ends[state] else output[state]
            while hit:  # the longest pattern first
                length, number, score = ends[hit]
                score += best[at - length]
                if score > top or link[1] < 0 and score >= top:
                    top, link = score, (length, number)
                hit = output[hit]
            best.append(top)
            back.append(link)
        ids, at = [], len(text)
        while at:
            length, number = back[at]
            if number < 0:
                raw = text[at - 1].encode("utf-8", "surrogatepass")
                ids += [self.bytes[b] for b in reversed(raw)]
            else:
                ids.append(number)
            at -= length
        return ids[::-1], best[-1]

    def encode(self, text: str) -> tuple[np.ndarray, float]:
        """Ids and score of a whole text."""
        if not text:
            return np.zeros(0, np.int32), 0.0
        parts, total = [], 0.0
        for k, part in enumerate(text.split(MARK)):
            if k:  # a literal mark matches no piece
                parts.append(np.array([self.bytes[b] for b in MARK.encode()], np.int32))
                total += self.uncovered
            if part or not k:
                ids, score = self._words((MARK if not k else "") + part.replace(" ", MARK))
                parts.append(ids)
                total += score
        return np.concatenate(parts), total

    def _words(self, marked: str) -> tuple[np.ndarray, float]:
        parts, total = [], 0.0
        for word in WORDS.findall(marked) if self.by_word else [marked]:
            ids, score = self._word(word)
            parts.append(ids)
            total += score
        return np.concatenate(parts), total

    def _word(self, word: str) -> tuple[np.ndarray, float]:
        got = self.known.get(word)
        if got is None:
            ids, score = self.viterbi(word)
            got = (np.array(ids, np.int32), score)
            if len(word) < 100:
                self.known[word] = got
        return got

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids of all texts, how many each has, and their scores.

        Texts whose words are parted by single spaces are taken apart and put together as
        arrays; the rest, and those with literal marks, go one by one.
        """
        n = len(texts)
        odd = pc.match_substring_regex(texts, f"^$|^ |  | $|{MARK}").to_numpy(zero_copy_only=False) if self.by_word else np.ones(n, bool)
        lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        rows = np.repeat(np.flatnonzero(~odd), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        d = lists.flatten().dictionary_encode()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        got = [self._word(MARK + w) for w in d.dictionary.to_pylist()]
        codes = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pool = [g[0] for g in got]
        size = np.fromiter(map(len, pool), np.int64, len(pool))
        first = np.cumsum(size) - size
        score = np.bincount(rows, np.array([g[1] for g in got], float)[codes], minlength=n).astype(float)
        counts = np.bincount(rows, size[codes], minlength=n).astype(np.int64)
        begin, each, pool, held = [first[codes]], [size[codes]], [*pool, np.zeros(0, np.int32)], int(size.sum())
        order = [rows]
        for k in np.flatnonzero(odd).tolist():
            ids, score[k] = self.encode(texts[k].as_py())
            counts[k] = len(ids)
            pool.append(ids)
            begin.append(np.array([held]))
            each.append(np.array([len(ids)]))
            order.append(np.array([k]))
            held += len(ids)
        by_row = np.argsort(np.concatenate(order), kind="stable")
        return _runs(np.concatenate(pool), np.concatenate(begin)[by_row], np.concatenate(each)[by_row]), counts, score

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of ids; bytes that form no character become U+FFFD."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        try:
            text = raw.decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_loaded: list[tuple[list, Pieces]] = []


def encoder(entries: list[tuple[str, float, int]]) -> Pieces:
    """This worker's encoder of a vocabulary; what it has learnt serves the next tasks of the same one too."""
    if not _loaded or _loaded[0][0] != entries:
        _loaded[:] = [(entries, Pieces(entries))]
    return _loaded[0][1]


def _ids_array(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, score) of every text."""
    entries = vocabulary(path)
    sent = docs.sparkSession.sparkContext.broadcast(entries)

    def run(batches):
        model = encoder(sent.value)
        for batch in batches:
            for piece in _pieces(batch, "text", 2 << 20):
                ids, counts, score = model.encode_batch(piece.column("text"))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), _ids_array(ids, counts), pa.array(score)], names=["doc_id", "ids", "score"])

    return docs_view(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, score double")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``text``; null ids give an empty text."""
    entries = vocabulary(path)
    sent = encoded.sparkSession.sparkContext.broadcast(entries)
    names = [c for c in encoded.columns if c != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name in names] + ["text string"])

    def run(batches):
        model = encoder(sent.value)
        for batch in batches:
            texts = [model.decode(x or []) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(texts, pa.string())], names=[*names, "text"])

    return encoded.select(*names).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_chars, n_ids, ids, score, exact): every text's ids, and whether they decode to it."""
    entries = vocabulary(path)
    sent = docs.sparkSession.sparkContext.broadcast(entries)

    def run(batches):
        model = encoder(sent.value)
        for batch in batches:
            for piece in _pieces(batch, "text", 2 << 20):
                texts = piece.column("text").to_pylist()
                ids, counts, score = model.encode_batch(piece.column("text"))
                ends = np.cumsum(counts).tolist()
                exact = [model.decode(ids[e - n : e].tolist()) == t for e, n, t in zip(ends, counts.tolist(), texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts), _ids_array(ids, counts), pa.array(score), pa.array(exact, pa.bool_())],
                    names=["doc_id", "n_chars", "n_ids", "ids", "score", "exact"],
                )

    return docs_view(docs).mapInArrow(run, "doc_id long, n_chars long, n_ids long, ids array<int>, score double, exact boolean")
