"""Suffix arrays by induced sorting, and permuted common prefixes, on whole arrays.

The steps are the classical ones: suffixes are classified as L or S, leftmost-S (LMS)
substrings are sorted by a first induction and named, the string of their names is sorted,
and a second induction from the sorted LMS suffixes gives all others.

An induction goes through the buckets of the first symbol, L suffixes upwards and S
suffixes downwards; each sorted suffix puts the one before it in the text at the head or
the tail of its bucket.  A bucket is one step on whole arrays: all it holds is sorted when
its turn comes, but for runs of its own symbol, which follow in rounds.

The string of names is not induced again: its alphabet is too large for buckets as arrays,
and item by item the recursion costs ten times the rest.  Its suffixes are told apart by
doubling, as far as the longest piece of the text reaches, which bounds the rounds.
"""

from __future__ import annotations

import numpy as np

def classify(text: np.ndarray) -> np.ndarray:
    """True for S-type suffixes; a virtual smallest symbol follows the end."""
    n = len(text)
    rises, falls = text[:-1] < text[1:], text[:-1] > text[1:]
    decided = np.append(rises | falls, True)
    at = np.where(decided, np.arange(n), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(rises, False)[following]


def _deal(found: np.ndarray, symbols: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Append positions to the buckets of their symbols, in order."""
    if not len(found):
        return
    order = np.argsort(symbols, kind="stable")
    found, counts = found[order], np.bincount(symbols)
    ends = np.cumsum(counts)
    for c in np.flatnonzero(counts).tolist():
        into[c].append(found[ends[c] - counts[c] : ends[c]])


def _by_bucket(text: np.ndarray, kinds: int, lms: list[np.ndarray]) -> np.ndarray:
    """All suffixes in order, given the LMS suffixes of each bucket in order."""
    n, none = len(text), np.zeros(0, lms[0].dtype)
    larger: list[list[np.ndarray]] = [[] for _ in range(kinds)]
    larger[int(text[-1])].append(np.array([n - 1], lms[0].dtype))  # before the virtual end
    lower = []
    for c in range(kinds):
        mine, now = [], np.concatenate(larger[c]) if larger[c] else none
        while len(now):
            mine.append(now)
            before = now[now > 0] - 1
            symbol = text[before]
            up = symbol > c
            _deal(before[up], symbol[up], larger)
            now = before[symbol == c]
        lower.append(np.concatenate(mine) if mine else none)
        larger[c] = []
        if len(lms[c]):
            before = lms[c] - 1  # an LMS suffix always has one before it, of type L
            _deal(before, text[before], larger)
    smaller: list[list[np.ndarray]] = [[] for _ in range(kinds)]
    out = []
    for c in range(kinds - 1, -1, -1):
        mine, now = [], np.concatenate(smaller[c]) if smaller[c] else none
        while len(now):  # the largest first
            mine.append(now)
            before = now[now > 0] - 1
            symbol = text[before]
            down = symbol < c
            _deal(before[down], symbol[down], smaller)
            now = before[symbol == c]
        smaller[c] = []
        now = lower[c][::-1]
        before = now[now > 0] - 1
        symbol = text[before]
        down = symbol < c
        _deal(before[down], symbol[down], smaller)
        out += [*mine, now]
    return np.concatenate(out)[::-1]


def _induce(text: np.ndarray, kinds: int, lms: np.ndarray) -> np.ndarray:
    parts: list[list[np.ndarray]] = [[] for _ in range(kinds)]
    _deal(lms, text[lms], parts)
    return _by_bucket(text, kinds, [p[0] if p else np.zeros(0, lms.dtype) for p in parts])


def _names(text: np.ndarray, ordered: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings in their order: equal ones, which stand together, share a name.

    ``stop`` is the last place of each; the one that ends with the text is like no other.
    """
    length = stop - ordered
    same = (length[1:] == length[:-1]) & (stop[1:] < len(text)) & (stop[:-1] < len(text))
    at, depth = np.flatnonzero(same), 0
    while len(at):
        differ = text[ordered[at] + depth] != text[ordered[at + 1] + depth]
        same[at[differ]] = False
        depth += 1
        at = at[~differ & (length[at] >= depth)]
    return np.append(0, np.cumsum(~same))


def _ordered(name: np.ndarray, reach: int) -> np.ndarray:
    """The suffixes of a string of names in order, as far as ``reach`` names tell them apart.

    Ranks by 1, 2, 4, ... names; each round takes up only those that are still tied.
    """
    n = len(name)
    sizes = np.bincount(name)
    rank = np.append((np.cumsum(sizes) - sizes)[name] + 1, 0).astype(np.int64)  # one more than the suffixes below the group
    open_, known = np.flatnonzero(sizes[name] > 1), 1
    while len(open_) and known < reach:
        key = rank[open_] * (n + 2) + rank[np.minimum(open_ + known, n)]
        order = np.argsort(key, kind="stable")
        key, place = key[order], np.arange(len(order))
        group = key // (n + 2)
        base = np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), place, 0))
        fresh = np.append(True, key[1:] != key[:-1])
        lead = np.maximum.accumulate(np.where(fresh, place, 0))
        rank[open_[order]] = group + lead - base
        size = np.bincount(np.cumsum(fresh) - 1)
        open_, known = np.sort(open_[order][np.repeat(size, size) > 1]), 2 * known
    return np.argsort(rank[:-1], kind="stable")


def suffix_array(text: np.ndarray, reach: int | None = None) -> np.ndarray:
    """Suffixes of an array of numbers from 0 to 1023 in order, by ``reach`` symbols at least (all)."""
    text = np.asarray(text).astype(np.uint16)
    n = len(text)
    if not n:
        return np.zeros(0, np.int32)
    kinds, place = int(text.max()) + 1, np.int32 if n < 1 << 30 else np.int64
    s_type = classify(text)
    lms = (np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1).astype(place)
    if len(lms) > 1:
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = _induce(text, kinds, lms)
        order = order[is_lms[order]]
        following = np.zeros(n, place)
        following[lms] = np.append(lms[1:], n)
        name = np.zeros(n, place)
        name[order] = _names(text, order, following[order])
        lms = lms[_ordered(name[lms], n if reach is None else reach)]
    return _induce(text, kinds, lms)


def loads(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as integers; ``data`` has 8 spare bytes at its end."""
    return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))


def permuted_lcp(text: np.ndarray, sa: np.ndarray, left: np.ndarray) -> np.ndarray:
    """In text order: the common prefix of each suffix and the one before it in the array, up to ``left``.

    ``left`` is how many symbols of a suffix count: it falls by one from place to place within a
    piece.  Where the symbols before the two suffixes agree (in one piece), the prefix is that of
    the place before less one; only the others are compared, four symbols at a time.
    """
    n = len(text)
    out = np.zeros(n, sa.dtype)
    if n < 2:
        return out
    before = np.full(n, -1, sa.dtype)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n, dtype=sa.dtype)
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] > 0) & (left[1:] == left[:-1] - 1)
    at = np.flatnonzero(follows)
    follows[at] = text[at - 1] == text[before[at] - 1]
    wide = np.concatenate([text.astype("<u2"), np.full(8, 0xFFFF, "<u2")])
    words = np.ndarray((len(wide) - 3,), "<u8", wide, 0, (2,))
    this = np.flatnonzero(~follows & (before >= 0) & (left > 0))
    other, depth = before[this], 0
    while len(this):
        x = words[np.minimum(this + depth, n)] ^ words[np.minimum(other + depth, n + 1)]
        differ = (x != 0) | (depth + 4 >= left[this])
        low = x[differ] & (~x[differ] + np.uint64(1))
        equal = np.where(x[differ] == 0, 4, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) >> 4)
        out[this[differ]] = np.minimum(depth + equal, left[this[differ]])
        this, other, depth = this[~differ], other[~differ], depth + 4
    first = np.maximum.accumulate(np.where(follows, 0, place))
    return np.maximum(out[first] - (place - first), 0)
