"""Removal of repeated byte strings across documents, by shard suffix arrays.

A byte goes if it lies in a ``length``-byte string that also starts in a document
with a smaller id; strings are judged on the input and never cross documents.

1. Documents are packed into blocks; every window of ``length`` bytes has a minimizer
   (the least hash of its ``SEED``-byte substrings).  Blocks exchange the distinct
   minimizer values; those found in one document only cannot belong to a repeat.
2. Runs of windows that share a minimizer seen in two documents are cut out as pieces
   of a few dozen bytes.  Equal pieces of a block go out once, for its smallest id;
   for the block's other documents the answer is known already.  A minimizer decides
   the shard, so equal windows meet in one shard whatever document they are from.
3. A shard takes equal pieces for one string, of the smallest id that has it, and builds
   the suffix array of its strings by induced sorting; permuted common
   prefixes of at least ``length`` bytes delimit groups of equal windows, and all but those
   of a group's smallest document are marked.
4. The marked byte ranges return to their block, which joins them and cuts the texts.

The hashes only route and preselect (a chance collision adds work, never a removal);
equality is decided on bytes.  Equal pieces of one block are one before the shuffle, so a
passage in a third of all documents is one piece per block.  Pieces are at most ``MOST_WINDOWS`` windows, so endless runs stay small.

Defined results: a null text is empty (nothing removed); ids that are equal never
count as smaller, so repeated rows keep each other; a null id is smaller than any
other; an empty table gives an empty result; other columns are carried unchanged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common
from textloom.llm.common import from_ipc, mix, packed, reply_to, spread, stored, text_bytes
from textloom.llm.suffixes import loads, permuted_lcp, suffix_array

LENGTH, SEED = 50, 20
MOST_WINDOWS = 200
#: Text positions handled at once when minimizers are computed.
CHUNK = 1 << 17
#: Text bytes per bucket of the minimizer exchange, and per shard of pieces.
TEXT_PER_BUCKET, TEXT_PER_SHARD = 8 << 20, 3 << 19
NULL_ID = -(1 << 63)
#: Ranges that a block knows already pass the shards by, spread over so many groups.
SETTLED, KNOWN = 1 << 20, 1 << 30


def block_text(payload: bytes) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A block's rows, ids, texts joined by a spare byte (and more at the end), and text starts."""
    table = from_ipc(payload)
    text = pc.fill_null(table["__text"].combine_chunks().cast(pa.large_binary()), b"")
    sizes = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    data = np.frombuffer(b"\0".join(text.to_pylist()) + b"\0" * 64, np.uint8)
    ids = pc.fill_null(table["__id"].combine_chunks().cast(pa.int64()), NULL_ID).to_numpy(zero_copy_only=False)
    return table, ids, data, bounds


def runs(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of windows with one minimizer: (row, first window, windows, minimizer)."""
    total, span = int(bounds[-1]), length - SEED + 1
    out: list[tuple] = []
    for a in range(0, total, CHUNK):
        b = min(a + CHUNK, total)
        part = data[a : b + length + 8]
        w = loads(part)
        n = min(len(w) - 12, b - a + span - 1)
        if n < span:
            continue
        h = mix(w[:n] * np.uint64(0x9E3779B97F4A7C15) + w[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F) + w[12 : n + 12] * np.uint64(0x165667B19E3779F9))
        wide, reach = h, 1
        while 2 * reach <= span:
            wide = np.minimum(wide[:-reach], wide[reach:])
            reach *= 2
        if reach < span:
            wide = np.minimum(wide[: len(wide) - (span - reach)], wide[span - reach :])
        starts = np.arange(a, a + min(len(wide), b - a))
        row = np.searchsorted(bounds, starts, side="right") - 1
        valid = starts + length < bounds[row + 1]
        starts, row, least = starts[valid], row[valid], wide[: len(valid)][valid]
        if not len(starts):
            continue
        fresh = np.concatenate([[True], (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1) | (row[1:] != row[:-1])])
        lead = np.flatnonzero(fresh)
        position = np.arange(len(starts)) - np.repeat(lead, np.diff(np.append(lead, len(starts))))
        lead = np.flatnonzero(fresh | (position % MOST_WINDOWS == 0))
        out.append((row[lead], starts[lead], np.diff(np.append(lead, len(starts))), least[lead]))
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Even buckets by the upper half of a hash."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def minimizer_keys(least: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (bucket, low half) keys, and each run's index among them."""
    return np.unique((bucket_of(least, n).astype(np.uint64) << np.uint64(32)) | (least & np.uint64(0xFFFFFFFF)), return_inverse=True)


def _own_repeats(ids: np.ndarray, row: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """Keys that two different ids of this block have."""
    least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(least, index, ids[row])
    np.maximum.at(most, index, ids[row])
    return least != most


def _send_minimizers(n: int, length: int):
    def run(batches):
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                _, ids, data, bounds = block_text(payload)
                row, _, _, least = runs(data, bounds, length)
                keys, index = minimizer_keys(least, n)
                if not len(keys):
                    continue
                twice = _own_repeats(ids, row, index, len(keys))
                edges = np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
                low = keys.astype("<u4")
                used = np.flatnonzero(np.diff(edges))
                out = [low[edges[k] : edges[k + 1]].tobytes() + np.packbits(twice[edges[k] : edges[k + 1]]).tobytes() for k in used]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([block] * len(used), pa.int64()), pa.array(out, pa.binary())], names=["bucket", "block", "payload"])
                common.tidy()

    return run


def _flag_minimizers(key: tuple, table: pa.Table) -> pa.Table:
    """For every block's keys: one bit each, set if another document has the key."""
    values, flags, sizes = [], [], []
    for data in table["payload"].to_pylist():
        n = len(data) * 8 // 33
        values.append(np.frombuffer(data, "<u4", n))
        flags.append(np.unpackbits(np.frombuffer(data, np.uint8, offset=4 * n), count=n).astype(bool))
        sizes.append(n)
    distinct, index, times = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    repeated = times > 1
    repeated[index[np.concatenate(flags)]] = True
    mine = np.split(repeated[index], np.cumsum(sizes)[:-1])
    return pa.table({"block": table["block"], "bucket": table["bucket"], "payload": pa.array([np.packbits(m).tobytes() for m in mine], pa.binary())})


def _pieces_out(n: int, shards: int, length: int):
    """Block + flags -> pieces for the shards (bucket >= 0) and ranges known already (below)."""

    def answer(block: int, payload: bytes, got: dict[int, bytes]) -> pa.Table:
        _, ids, data, bounds = block_text(payload)
        row, start, windows, least = runs(data, bounds, length)
        keys, index = minimizer_keys(least, n)
        flags = np.zeros(len(keys), bool)
        edges = np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
        for k, bits in got.items():
            flags[edges[k] : edges[k + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=edges[k + 1] - edges[k])
        chosen = np.flatnonzero(flags[index])
        row, start, windows, least = row[chosen], start[chosen], windows[chosen], least[chosen]
        order = np.argsort(ids[row], kind="stable")  # the smallest id first
        row, start, windows, least = row[order], start[order], windows[order], least[order]
        raw, known, number = data.tobytes(), {}, np.zeros(len(row), np.int64)
        stops = start + windows + length - 1
        for k, (s, e) in enumerate(zip(start.tolist(), stops.tolist(), strict=True)):
            number[k] = known.setdefault(raw[s:e], len(known))
        first = np.zeros(len(known), np.int64)
        first[number[::-1]] = np.arange(len(number))[::-1]
        owner = ids[row[first]]
        settled = ids[row] != owner[number]
        rows_out = [(-2 - int(mix(np.array([block]))[0] % np.uint64(SETTLED)), ranges(start[settled], stops[settled]).tobytes())] if settled.any() else []
        places = np.flatnonzero(~settled)
        places = places[np.argsort(number[places], kind="stable")]
        times = np.bincount(number[places], minlength=len(known))
        shard = bucket_of(mix(least[first]), shards)
        begin = np.concatenate([[0], np.cumsum(times)])
        by_shard = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[by_shard], np.arange(shards + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            mine = by_shard[cuts[k] : cuts[k + 1]]
            at = np.concatenate([places[begin[m] : begin[m + 1]] for m in mine])
            head = np.array([len(mine), len(at)], "<i8")
            f = first[mine]
            parts = [head, owner[mine], (windows[f] + length - 1).astype("<i4"), times[mine].astype("<i4"), row[at].astype("<i4"), start[at].astype("<i4")]
            rows_out.append((k, squeeze(b"".join(p.tobytes() for p in parts) + b"".join(raw[s:e] for s, e in zip(start[f].tolist(), stops[f].tolist(), strict=True)))))
        return pa.table({"block": pa.array([block] * len(rows_out), pa.int64()), "bucket": pa.array([r[0] for r in rows_out], pa.int32()), "payload": pa.array([r[1] for r in rows_out], pa.binary())})

    return answer


def squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.compress(data, 1)


def unsqueeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(data)


def ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Byte ranges (start, stop) in block coordinates; those that touch are one."""
    if not len(start):
        return np.zeros((0, 2), "<i4")
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    fresh = np.concatenate([[True], start[1:] > reach[:-1]])
    lead = np.flatnonzero(fresh)
    return np.column_stack([start[lead], reach[np.append(lead[1:], len(start)) - 1]]).astype("<i4")


def mark(owner: np.ndarray, sizes: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of pieces that also start in a piece of a smaller id: sorted (piece, offset)."""
    if not len(sizes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # symbol 0 ends each piece
    whole = np.cumsum(sizes + 1)
    begin = whole - sizes - 1
    place = np.int32 if whole[-1] < 1 << 30 else np.int64
    piece = np.repeat(np.arange(len(sizes), dtype=place), sizes + 1)
    left = whole.astype(place)[piece] - np.arange(whole[-1], dtype=place)  # with the end
    text = np.zeros(whole[-1], np.uint16)
    text[left > 1] = data.astype(np.uint16) + 1
    sa = suffix_array(text, int(sizes.max()) + 1)
    common_ = permuted_lcp(text, sa, left)
    # windows are the suffixes with ``length`` bytes before the end; equal ones stand together
    order = sa[left[sa] > length]
    group = np.cumsum(common_[order] < length)
    least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    mine = owner[piece[order]]
    np.minimum.at(least, group, mine)
    hit = np.sort(order[mine > least[group]]).astype(np.int64)
    return piece[hit].astype(np.int64), hit - begin[piece[hit]]


def _shard(length: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return table.set_column(table.schema.get_field_index("bucket"), "bucket", pa.array([KNOWN] * table.num_rows, pa.int32())).select(["block", "bucket", "payload"])
        own, sizes, places, blocks = [], [], [], table["block"].to_pylist()
        known: dict[bytes, int] = {}
        number = []  # of each piece among the distinct ones
        for data in map(unsqueeze, table["payload"].to_pylist()):
            n, m = np.frombuffer(data, "<i8", 2)
            at = 16 + 8 * n
            own.append(np.frombuffer(data, "<i8", n, 16))
            sizes.append(np.frombuffer(data, "<i4", n, at).astype(np.int64))
            places.append(np.frombuffer(data, "<i4", n + 2 * m, at + 4 * n).astype(np.int64))
            ends = (at + 8 * n + 8 * m + np.cumsum(sizes[-1])).tolist()
            number += [known.setdefault(data[e - k : e], len(known)) for e, k in zip(ends, sizes[-1].tolist(), strict=True)]
        number, owner = np.array(number, np.int64), np.concatenate(own)
        least = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(least, number, owner)
        size = np.zeros(len(known), np.int64)
        size[number] = np.concatenate(sizes)
        first = mark(least, size, np.frombuffer(b"".join(known), np.uint8), length)
        known.clear()
        # a piece has the marks of its string, or all windows if a smaller id has the string
        later = owner > least[number]
        begin, windows = np.searchsorted(first[0], np.arange(len(size) + 1)), size - length + 1
        each = np.where(later, windows[number], (begin[1:] - begin[:-1])[number])
        piece = np.repeat(np.arange(len(number)), each)
        step = np.arange(len(piece)) - np.repeat(np.cumsum(each) - each, each)
        offset = np.where(later[piece], step, 0)
        kept = ~later[piece]
        offset[kept] = first[1][(begin[number[piece]] + step)[kept]]
        base = np.cumsum([0, *map(len, own)])
        cuts = np.searchsorted(piece, base)
        out_block, out = [], []
        for k, block in enumerate(blocks):
            mine, off, n = piece[cuts[k] : cuts[k + 1]] - base[k], offset[cuts[k] : cuts[k + 1]], len(own[k])
            if not len(mine):
                continue
            fresh = np.flatnonzero(np.concatenate([[True], (mine[1:] != mine[:-1]) | (off[1:] > off[:-1] + length)]))
            p, lo, hi = mine[fresh], off[fresh], off[np.append(fresh[1:], len(mine)) - 1] + length
            times = places[k][:n]
            starts = places[k][n + (len(places[k]) - n) // 2 :]
            begin = np.concatenate([[0], np.cumsum(times)])
            each = times[p]
            at = starts[np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - begin[p], each)]
            out_block.append(block)
            out.append(ranges(at + np.repeat(lo, each), at + np.repeat(hi, each)).tobytes())
        common.tidy()
        return pa.table({"block": pa.array(out_block, pa.int64()), "bucket": pa.array([key[0].as_py()] * len(out), pa.int32()), "payload": pa.array(out, pa.binary())})

    return run


def _cut(carry: list[str], with_text: bool):
    def answer(block: int, payload: bytes, got: dict[int, bytes]) -> pa.Table:
        table, _, data, bounds = block_text(payload)
        spans = [np.frombuffer(x, "<i4").reshape(-1, 2).astype(np.int64) for x in got.values()]
        spans = np.concatenate(spans) if spans else np.zeros((0, 2), np.int64)
        row = np.searchsorted(bounds, spans[:, 0], side="right") - 1
        out: dict[int, np.ndarray] = {}
        order = np.argsort(row, kind="stable")
        for k, part in zip(*_groups(row[order], spans[order]), strict=True):
            # ranges() joins ranges that touch: a removed run is maximal
            out[k] = ranges(part[:, 0], part[:, 1]).astype(np.int64)
        raw, sizes = data.tobytes(), np.diff(bounds) - 1
        removed, n_spans, sha, kept = [], [], [], []
        for k in range(table.num_rows):
            cut = out.get(k)
            if cut is None:
                left = raw[bounds[k] : bounds[k + 1] - 1]
            else:
                edges = [int(bounds[k]), *cut.ravel().tolist(), int(bounds[k + 1]) - 1]
                left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            removed.append(int(sizes[k]) - len(left))
            n_spans.append(0 if cut is None else len(cut))
            sha.append(hashlib.sha256(left).hexdigest())
            if with_text:
                kept.append(left.decode("utf-8", "ignore"))
        cols = [table[c] for c in carry] + [pa.array(sizes), pa.array(removed), pa.array(n_spans), pa.array(sha), *([pa.array(kept, pa.string())] if with_text else [])]
        return pa.table(cols, names=[*carry, "__n_bytes", "__n_removed", "__n_spans", "__kept_sha256", *(["__kept"] if with_text else [])])

    return answer


def _groups(keys: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    if not len(keys):
        return [], []
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at].tolist(), np.split(rows, at[1:])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """``carry`` columns plus ``__n_bytes, __n_removed, __n_spans, __kept_sha256`` (and ``__kept``)."""
    if length < SEED + 1:
        raise ValueError(f"length must be over {SEED}")
    spark, carry = docs.sparkSession, [id_col] if carry is None else carry
    rows = docs.select(*carry, F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    size = text_bytes(rows, "__text")
    blocks = packed(rows, "__text")
    n, shards = (common.buckets_for(size, each, spark) for each in (TEXT_PER_BUCKET, TEXT_PER_SHARD))
    three = "bucket int, block long, payload binary"
    sent = blocks.mapInArrow(_send_minimizers(n, length), three)
    flags = stored(spread(sent, "bucket", n).groupBy("bucket").applyInArrow(_flag_minimizers, "block long, bucket int, payload binary"))
    del sent
    pieces = reply_to(blocks, flags, _pieces_out(n, shards, length), "block long, bucket int, payload binary")
    found = stored(spread(pieces, "bucket", shards).groupBy("bucket").applyInArrow(_shard(length), "block long, bucket int, payload binary"))
    del pieces
    common.discard(flags)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in carry]
    schema = ", ".join([*kept, "__n_bytes long, __n_removed long, __n_spans long, __kept_sha256 string", *(["__kept string"] if with_text else [])])
    return reply_to(blocks, found, _cut(carry, with_text), schema)


def strip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The documents with their kept text (a character cut in half goes as a whole) and its length."""
    carry = [c for c in docs.columns if c != text_col]
    out = dedup(docs, id_col, text_col, carry, with_text=True).withColumn(text_col, F.col("__kept"))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.length(text_col).cast(docs.schema[n_chars].dataType))
    return out.select(*docs.columns)


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    out = dedup(docs, "doc_id", "text", ["doc_id"], length)
    return out.select("doc_id", *[F.col(f"__{c}").alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")])
