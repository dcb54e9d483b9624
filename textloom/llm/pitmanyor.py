"""Language-model scores from a hierarchical Pitman-Yor model of word pairs.

Every word (and the start of a text) is a context with a restaurant of its own; all
context restaurants send their tables as customers to one shared parent, the restaurant
of single words, whose own tables are drawn as well; its base gives every known word and
"a word never seen" the same chance.  Seatings are sampled by Gibbs sweeps (``seating``):
a sweep takes the customers of a dish out of their restaurant and seats them anew given
all others, for every dish of every restaurant, then the parent's.  After each sweep the
strengths are drawn from their posteriors on a grid.  The first BURN_IN sweeps are
dropped; the predictive probabilities of the last two are averaged.

Dishes are seated at the same time, each given the others as the sweep before left them,
and the parent's chances stand still while a context's dish is seated.  The discounts come
from counts of counts and stay.

Documents are packed into blocks; blocks exchange counts of words and of word pairs
with buckets of the key space (see ``common``).  A pair seen once has one table, so only
pairs seen twice or more are seated, each by the first block that has it in training;
after the last sweep all other blocks get its tables through the buckets.  Between sweeps
blocks exchange tables by word, so a context that precedes a third of all words costs one
entry per block.  Random numbers are hashes of the pair's place in its bucket and the
sweep, so results depend neither on blocks nor on retries.

Words are keyed by 64-bit hashes, pairs by 40 bits of one within a bucket.  Defined
results: a null or empty text is its end token; rows that repeat are counted and
scored one by one; a null id is in the training part; without training rows every
probability is 1 (score 0); an empty table gives an empty result; only id and text
are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common
from textloom.llm.common import coded, docs_view, from_ipc, mix, packed, reply_to, spread, stored, text_bytes, words_of
from textloom.llm.seating import log_gamma_ratio, seat, uniform
from textloom.llm.substrings import bucket_of, squeeze, unsqueeze

FOLDS, HELD_OUT = 7, 2
END, START = np.uint64(0x0E17D), np.uint64(0x057A27)
BURN_IN, SWEEPS = 2, 4
STRENGTHS = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 128.0, 512.0, 2048.0)
TEXT_PER_BUCKET = 8 << 20
#: Buckets of pairs are numbered from PAIRS when counted, from ASKS and TELLS when tables are passed on.
PAIRS, ASKS, TELLS = 1 << 28, 1 << 29, 3 << 28
#: A block's own rows.
OWN, COUNTS, SEATED, BEGAN, LIKELY = -1, -2, -3, -4, -5
GOLD, SILVER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * GOLD + mix(second) * SILVER)


class Tokens:
    """The words and word pairs of a block, in an order every pass repeats; pairs by their hash."""

    def __init__(self, payload: bytes) -> None:
        table = from_ipc(payload)
        self.doc_id, self.held = table["doc_id"], table["held"].to_numpy(zero_copy_only=False).astype(bool)
        n = table.num_rows
        flat, rows = words_of(table["text"])
        codes, words = coded(flat)
        hashes = np.concatenate([words, [END, START]]).astype(np.uint64)
        self.words, inverse = np.unique(hashes, return_inverse=True)
        end, start = inverse[-2], inverse[-1]
        self.end, self.start = int(end), int(start)
        self.sizes = np.bincount(rows, minlength=n) + 1
        stops = np.cumsum(self.sizes) - 1
        self.token = np.full(int(self.sizes.sum()), end, np.int64)
        inside = np.ones(len(self.token), bool)
        inside[stops] = False
        self.token[inside] = inverse[codes]
        self.doc = np.repeat(np.arange(n), self.sizes)
        train = ~self.held[self.doc]
        self.counts = np.bincount(self.token[train], minlength=len(self.words))
        context = np.concatenate([[start], self.token[:-1]])
        context[np.concatenate([[0], stops[:-1] + 1])] = start
        key, pair = np.unique(context * len(self.words) + self.token, return_inverse=True)
        u, w = key // len(self.words), key % len(self.words)
        h = pair_hash(self.words[u], self.words[w])
        order = np.argsort(h)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pair, self.u, self.w, self.pair_hash = place[pair], u[order], w[order], h[order]
        self.pair_counts = np.bincount(self.pair[train], minlength=len(key))


def edges_of(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """Bounds of the buckets in sorted hashes."""
    return np.searchsorted(bucket_of(sorted_hashes, n), np.arange(n + 1))


def each_bucket(edges: np.ndarray):
    """(bucket, first, end) of the buckets that hold something."""
    return ((k, a, b) for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if b > a)


def put(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, each as its byte planes (most are zero and shrink to nothing)."""
    parts = [np.array([len(arrays), *[len(a) for a in arrays]], "<i8").tobytes()]
    for a in arrays:
        planes = np.ascontiguousarray(a, "<i8").view(np.uint8).reshape(-1, 8)
        used = max([p + 1 for p in range(8) if planes[:, p].any()], default=1)
        parts += [bytes([used]), *[planes[:, p].tobytes() for p in range(used)]]
    return squeeze(b"".join(parts))


def take(data: bytes) -> list[np.ndarray]:
    data = unsqueeze(data)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    sizes, at, out = np.frombuffer(data, "<i8", n, 8), 8 + 8 * n, []
    for size in sizes.tolist():
        used, values = data[at], np.zeros(size, np.int64)
        planes = values.view(np.uint8).reshape(-1, 8)
        for p in range(used):
            planes[:, p] = np.frombuffer(data, np.uint8, size, at + 1 + p * size)
        out.append(values)
        at += 1 + used * size
    return out


def steps(rising: np.ndarray) -> np.ndarray:
    """A rising series as its first value and its steps, which are small."""
    return np.diff(rising, prepend=rising.dtype.type(0)).view(np.int64)


def risen(values: np.ndarray, kind=np.int64) -> np.ndarray:
    return np.cumsum(values.view(kind))


def _rows(block: int, rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"block": pa.array([block] * len(rows), pa.int64()), "bucket": pa.array([r[0] for r in rows], pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())})


THREE = "block long, bucket int, payload binary"


def key_shift(n: int) -> np.uint64:
    """Bits of a pair's hash that are left out: 40 stay beyond those that choose the bucket."""
    return np.uint64(max(0, 24 - int(n).bit_length()))


def _send(n: int):
    """Counts of words (buckets 0..n) and of pairs (PAIRS..) of every block."""

    def run(batches):
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                t = Tokens(payload)
                rows = [(k, put(steps(t.words[a:b]), t.counts[a:b])) for k, a, b in each_bucket(edges_of(t.words, n))]
                short = t.pair_hash >> key_shift(n)
                rows += [(PAIRS + k, put(steps(short[a:b]), t.pair_counts[a:b])) for k, a, b in each_bucket(edges_of(t.pair_hash, n))]
                del t
                yield from _rows(block, rows).to_batches()
                common.tidy()

    return run


def _count(key: tuple, table: pa.Table) -> pa.Table:
    """Corpus counts, aligned to what each block sent; totals of the bucket under block -1.

    Words get (count, number in the bucket, own); pairs (count, own, numbers of those seen twice
    or more, as steps).  A block owns what it is the first to have in training.
    """
    bucket = key[0].as_py()
    sent = sorted(zip(table["block"].to_pylist(), table["payload"].to_pylist(), strict=True), reverse=True)
    blocks, got = [b for b, _ in sent], [take(x) for _, x in sent]
    keys, counts = np.concatenate([risen(g[0], np.uint64) for g in got]), np.concatenate([g[1] for g in got])
    distinct, index = np.unique(keys, return_inverse=True)
    total = np.bincount(index, counts, minlength=len(distinct)).astype(np.int64)
    parts = np.split(index, np.cumsum([len(g[0]) for g in got])[:-1])
    owner = np.zeros(len(distinct), np.int64)
    for k, (mine, g) in enumerate(zip(parts, got, strict=True)):  # the first block comes last and stays
        owner[mine[g[1] > 0]] = k
    number, answers = np.cumsum(total > 1) - 1, []
    for k, (mine, g) in enumerate(zip(parts, got, strict=True)):
        own = ((owner[mine] == k) & (g[1] > 0)).astype(np.int64)
        answers.append(put(total[mine], mine, own) if bucket < PAIRS else put(total[mine], own, steps(number[mine][total[mine] > 1])))
    sums = put(np.array([total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum(), 0]))
    del got, keys, counts, distinct, index, parts
    common.tidy()
    return pa.table({"block": pa.array([*blocks, -1], pa.int64()), "bucket": pa.array([bucket] * (len(answers) + 1), pa.int32()), "payload": pa.array([*answers, sums], pa.binary())})


def _gather(edges: np.ndarray, got: dict[int, list[np.ndarray]], base: int, column: int) -> np.ndarray:
    out = np.zeros(int(edges[-1]), np.int64)
    for k, a, b in each_bucket(edges):
        out[a:b] = got[base + k][column]
    return out


def _kitchen(n: int):
    """A block's restaurants: what the sweeps need of it, its word ids for the exchange (bucket 0..n) and the pairs whose tables it will ask for."""

    def answer(block: int, payload: bytes, got: dict[int, bytes]) -> pa.Table:
        t = Tokens(payload)
        got = {k: take(v) for k, v in got.items()}
        edges, pair_edges = edges_of(t.words, n), edges_of(t.pair_hash, n)
        count, number, first = (_gather(edges, got, 0, k) for k in range(3))
        c, own = (_gather(pair_edges, got, PAIRS, k) for k in range(2))
        size, own = len(t.words), own.astype(bool)
        single, many = own & (c == 1), own & (c > 1)
        customers = count.copy()
        # a text has one of each; nothing follows an end
        customers[t.start], customers[t.end], first[t.start] = count[t.end], 0, first[t.end]
        asks, keys, shares = [], [np.zeros(0, np.int64)], np.zeros(n, np.int64)
        for k, a, b in each_bucket(pair_edges):
            numbers, mine = got[PAIRS + k][2], own[a:b][c[a:b] > 1]
            if len(numbers):
                asks.append((ASKS + k, put(numbers, mine)))
                keys.append((np.int64(k) << np.int64(40)) | risen(numbers)[mine])
                shares[k] = mine.sum()
        held = put(count, customers, number, np.diff(edges), first, np.bincount(t.u[single], minlength=size), np.bincount(t.w[single], minlength=size), t.u[many], t.w[many], c[many], np.concatenate(keys), shares)
        # before any sweep a pair has one table
        rows = _tables(edges, number, np.bincount(t.u[own], minlength=size), np.bincount(t.w[own], minlength=size))
        return _rows(block, [(OWN, held), (COUNTS, put(c)), *asks, *rows])

    return answer


def _tables(edges: np.ndarray, number: np.ndarray, by_context: np.ndarray, by_word: np.ndarray) -> list[tuple[int, bytes]]:
    """What a block adds to the tables of its words, per bucket: (numbers as steps, tables)."""
    return [(k, put(steps(number[a:b]), by_context[a:b], by_word[a:b])) for k, a, b in each_bucket(edges)]


class Model:
    """Numbers every block shares; ``at`` holds, for each state, (parent customers, parent tables, parent strength, strength)."""

    def __init__(self, tokens: int, types: int, discount: float) -> None:
        self.tokens, self.types, self.discount = tokens, types, discount
        self.base_discount, self.base = 0.5, 1.0 / (types + 1.0)
        self.at: list[tuple[int, int, float, float]] = []

    def parent(self, dish: np.ndarray, tables: np.ndarray, state: int, out: np.ndarray | int = 0) -> np.ndarray:
        """Parent probability of words with ``dish`` customers at ``tables`` tables, ``out`` of all customers being away."""
        customers, all_tables, strength, _ = self.at[state]
        held = np.maximum(dish - self.base_discount * np.minimum(tables, dish), 0)
        return (held + (strength + self.base_discount * all_tables) * self.base) / (strength + customers - out)

    def draw_strength(self, likely: np.ndarray, draw: int) -> float:
        """One value of the grid by its posterior (a flat prior on the grid)."""
        w = np.cumsum(np.exp(likely - likely.max()))
        return STRENGTHS[int(np.searchsorted(w, uniform(np.array([draw], np.uint64), 99)[0] * w[-1]))]

    def parent_likelihoods(self, customers: int, tables: int) -> np.ndarray:
        return strength_likelihoods(np.array([tables]), np.array([customers]), self.base_discount)


def strength_likelihoods(tables: np.ndarray, customers: np.ndarray, discount: float) -> np.ndarray:
    """log of how likely restaurants with so many tables and customers are, for each strength."""
    out = []
    for s in STRENGTHS:
        rise = tables * np.log(discount) + log_gamma_ratio(s / discount + tables, s / discount)
        out.append(float((rise - log_gamma_ratio(s + customers, s)).sum()))
    return np.array(out)


def _sum_tables(model: Model, sweep: int):
    """Tables of each word as a context and as a dish, summed over blocks, and its tables in the parent, drawn here."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        got = [take(x) for x in table["payload"].to_pylist()]
        numbers = [risen(g[0]) for g in got]
        size = max(int(x.max()) for x in numbers) + 1
        context, dish, parent = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        for number, g in zip(numbers, got, strict=True):
            context[number] += g[1]
            dish[number] += g[2]
        known = np.flatnonzero(dish)
        parent[known] = 1
        if sweep:
            _, all_tables, strength, _ = model.at[-1]
            lead = np.full(len(known), (strength + model.base_discount * (all_tables - 1)) * model.base)
            ids = mix((known + (np.int64(bucket) << np.int64(40))).astype(np.uint64) + SILVER)
            parent[known] = seat(dish[known], lead, np.full(len(known), model.base_discount * model.base), model.base_discount, ids, sweep)
        answers = [put(context[x], dish[x], parent[x]) for x in numbers]
        total = put(np.array([dish.sum(), (dish > 0).sum(), (dish == 1).sum(), (dish == 2).sum(), parent.sum()]))
        del got, numbers
        common.tidy()
        return pa.table({"block": pa.array([*table["block"].to_pylist(), -1], pa.int64()), "bucket": pa.array([bucket] * (len(answers) + 1), pa.int32()), "payload": pa.array([*answers, total], pa.binary())})

    return run


def _state(got: dict[int, bytes], sizes: np.ndarray) -> list[np.ndarray]:
    edges = np.concatenate([[0], np.cumsum(sizes)])
    got = {k: take(v) for k, v in got.items() if 0 <= k < len(sizes)}
    return [_gather(edges, got, 0, k) for k in range(3)]


def _sweep(model: Model, sweep: int):
    """One Gibbs sweep over a block's own pairs: tables to add up, where the dishes are now, how likely the strengths are.

    The last sweep also keeps the state it began with and tells the tables of the last two.
    """

    def answer(block: int, payload: bytes, got: dict[int, bytes]) -> pa.Table:
        _, customers, number, sizes, first, single_u, single_w, u, w, c, keys, shares = take(payload)
        context, dish, parent = state = _state(got, sizes)
        before = take(got[SEATED])[0] if SEATED in got else np.ones(len(c), np.int64)
        strength, d = model.at[sweep][3], model.discount
        # the dish's own tables are away, but for the first that it always has
        p = model.parent(dish[w] - before + 1, parent[w], sweep, before - 1)
        lead = (strength + d * (context[u] - before)) * p
        now = seat(c, lead, d * p, d, mix(keys.astype(np.uint64)), sweep + 1, before if sweep else None)
        by_context, by_word = single_u + np.bincount(u, now, minlength=len(number)).astype(np.int64), single_w + np.bincount(w, now, minlength=len(number)).astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        mine = np.flatnonzero((first == 1) & (customers > 1))
        likely = strength_likelihoods(context[mine], customers[mine], d)
        rows = [(SEATED, put(now)), (LIKELY, likely.tobytes()), *_tables(edges, number, by_context, by_word)]
        if sweep == SWEEPS - 1:
            ends = np.concatenate([[0], np.cumsum(shares)])
            rows += [(BEGAN, put(*state)), *[(TELLS + k, put(before[a:b], now[a:b])) for k, a, b in each_bucket(ends)]]
        return _rows(block, rows)

    return answer


def _pass_on(key: tuple, table: pa.Table) -> pa.Table:
    """Tables of the last two sweeps, from the blocks that seated the pairs to all that have them."""
    asked, told = {}, {}
    for block, bucket, payload in zip(table["block"].to_pylist(), table["bucket"].to_pylist(), table["payload"].to_pylist(), strict=True):
        (asked if bucket < TELLS else told)[block] = take(payload)
    numbers = {b: risen(x[0]) for b, x in asked.items()}
    size = max(int(x[-1]) for x in numbers.values()) + 1
    tables = np.ones((2, size), np.int64)
    for block, both in told.items():
        tables[:, numbers[block][asked[block][1] == 1]] = both
    answers = [put(*tables[:, x]) for x in numbers.values()]
    common.tidy()
    return pa.table({"block": pa.array(list(numbers), pa.int64()), "bucket": pa.array([key[0].as_py()] * len(answers), pa.int32()), "payload": pa.array(answers, pa.binary())})


def _score(model: Model, n: int):
    def answer(block: int, payload: bytes, got: dict[int, bytes]) -> pa.Table:
        t = Tokens(payload)
        (c,) = take(got[COUNTS])
        edges = edges_of(t.words, n)
        own = take(got[OWN])
        count, customers = own[0], own[1]
        tables = np.tile((c > 0).astype(np.int64), (2, 1))
        passed = [take(got[ASKS + k]) for k in range(n) if ASKS + k in got]
        if passed:
            tables[:, c > 1] = np.concatenate([np.stack(x) for x in passed], axis=1)
        p = np.zeros(len(c))
        for k, (context, dish, parent) in enumerate([take(got[BEGAN]), _state(got, np.diff(edges))]):
            at = SWEEPS - 1 + k
            strength, d = model.at[at][3], model.discount
            back = (strength + d * context[t.u]) * model.parent(dish, parent, at)[t.w]
            p += (np.maximum(c - d * tables[k], 0) + back) / (strength + customers[t.u]) / 2
        rows = len(t.sizes)
        score = np.bincount(t.doc, np.log10(p)[t.pair], minlength=rows)
        base = np.log10((count + 1.0) / (model.tokens + (model.types + 1.0)))
        return pa.table(
            {
                "doc_id": t.doc_id,
                "held_out": pa.array(t.held),
                "n_tokens": pa.array(t.sizes.astype(np.int64)),
                "n_known": pa.array(np.bincount(t.doc, count[t.token] > 0, minlength=rows).astype(np.int64)),
                "train_tokens": pa.array(np.full(rows, model.tokens)),
                "base_score": pa.array(np.bincount(t.doc, base[t.token], minlength=rows)),
                "score": pa.array(score),
                "perplexity": pa.array(10 ** np.minimum(-score / t.sizes, 300)),
            }
        )

    return answer


def _totals(replies: DataFrame, low: int, high: int) -> list[int]:
    """Sums of the bucket totals (five numbers per bucket) of a range of buckets."""

    def run(batches):
        total = np.zeros(5, np.int64)
        for batch in batches:
            for x in batch.column("payload").to_pylist():
                total += take(x)[0]
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["sums"])

    rows = replies.where(f"block = -1 and bucket >= {low} and bucket < {high}").select("payload").mapInArrow(run, "sums array<long>")
    got = rows.select(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(5)]).first()
    return [int(x or 0) for x in got]


def _likelihoods(swept: DataFrame) -> np.ndarray:
    """Sums over all blocks of how likely the strengths are."""

    def run(batches):
        total = np.zeros(len(STRENGTHS))
        for batch in batches:
            for x in batch.column("payload").to_pylist():
                total += np.frombuffer(x, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    rows = swept.where(f"bucket = {LIKELY}").select("payload").mapInArrow(run, "sums array<double>")
    got = rows.select(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(len(STRENGTHS))]).first()
    return np.array([x or 0.0 for x in got])


def discount_of(once: int, twice: int) -> float:
    return float(min(max(once / max(once + 2 * twice, 1), 0.05), 0.9))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row."""
    spark = docs.sparkSession
    rows = docs_view(docs, id_col, text_col)
    rows = rows.withColumn("held", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False)))
    n = common.buckets_for(text_bytes(rows), TEXT_PER_BUCKET, spark)
    blocks = packed(rows)
    counted = stored(spread(blocks.mapInArrow(_send(n), THREE), "bucket", 2 * n).groupBy("bucket").applyInArrow(_count, THREE))
    words, pairs = _totals(counted, 0, n), _totals(counted, PAIRS, PAIRS + n)
    model = Model(words[0], words[1], discount_of(pairs[2], pairs[3]))
    kitchens = stored(reply_to(blocks, counted.where("block >= 0"), _kitchen(n), THREE))
    common.discard(counted)
    own = kitchens.where(f"bucket = {OWN}").select("block", "payload")

    def added_up(sent: DataFrame, sweep: int, strength: float) -> DataFrame:
        """The state after a sweep: tables by word, and what the model holds of it."""
        out = stored(spread(sent.where(f"bucket >= 0 and bucket < {PAIRS}"), "bucket", n).groupBy("bucket").applyInArrow(_sum_tables(model, sweep), THREE))
        sums = _totals(out, 0, n)
        if not sweep:
            model.base_discount = discount_of(sums[2], sums[3])
        base = model.draw_strength(model.parent_likelihoods(max(sums[0], 1), max(sums[4], 1)), 2 * sweep)
        model.at.append((sums[0], sums[4], base, strength))
        return out

    state, swept = added_up(kitchens, 0, 8.0), None
    for sweep in range(SWEEPS):
        replies = state.where("block >= 0")
        if swept is not None:
            replies = replies.unionByName(swept.where(f"bucket = {SEATED}"))
        after = stored(reply_to(own, replies, _sweep(model, sweep), THREE))
        strength = model.draw_strength(_likelihoods(after), 2 * sweep + 1)
        common.discard(state, *([swept] if swept is not None else []))
        state, swept = added_up(after, sweep + 1, strength), after
    asks = kitchens.where(f"bucket >= {ASKS}").unionByName(swept.where(f"bucket >= {TELLS}"))
    asks = asks.withColumn("pairs", F.when(F.col("bucket") >= TELLS, F.col("bucket") - TELLS + ASKS).otherwise(F.col("bucket")))
    passed = stored(spread(asks, "pairs", n).groupBy("pairs").applyInArrow(_pass_on, THREE))
    replies = kitchens.where(f"bucket in ({OWN}, {COUNTS})").unionByName(swept.where(f"bucket = {BEGAN}")).unionByName(state.where("block >= 0")).unionByName(passed)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return reply_to(blocks, replies, _score(model, n), schema)
