"""Near-duplicate documents by one-permutation MinHash, exact within its buckets.

Documents whose shingle sets have a Jaccard likeness of at least ``percent`` / 100 are
linked; a component is what links reach.

1. One hash per shingle: the least in each of ``BINS`` bins is the signature, and an
   empty bin borrows from the bins of a fixed random order of its own (optimal
   densification).  Equal sets are one node from here on: copies never meet.
2. Bands of a few values make buckets, as many as ``bands_for`` the limit.  A bucket is a
   star: its members are compared with its smallest id, so candidates grow with members,
   not pairs.
3. Candidates are confirmed on the full shingle sets; confirmed links give components.
4. A bucket that still holds several components is gone through once more: members
   outside its largest component are compared with all its members on full sets, in
   cells of bounded size.  So the star shape loses no link that a bucket holds; at the
   limit itself all bands miss a pair with a probability below MISSED.

Defined results: words are lower-cased (A-Z) runs of non-blanks; fewer words than a
shingle make one shingle; null, empty and blank texts have no shingles and no links;
a null id is its own document (component null, kept); rows that repeat an id are one
document, linked by any of its texts; ids are cast to long; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common
from textloom.llm.common import _pieces, coded, docs_view, join_groups, mix, stored, words_of

BINS = 128
#: Chance that a pair at the limit shares no bucket, at most.
MISSED = 1e-6
#: Shingles on either side of one cell of the second round.
CELL = 1_500_000
#: Up to so many ids (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Odd multipliers, one for each place in a shingle or a band.
SEEDS = mix(np.arange(1, BINS + 2, dtype=np.uint64)) | np.uint64(1)


def bands_for(percent: int) -> tuple[int, int]:
    """(bands, values to a band): the longest bands that miss a pair at the limit with a chance below MISSED."""
    for rows in range(BINS, 0, -1):
        if (1 - (percent / 100) ** rows) ** (BINS // rows) <= MISSED:
            return BINS // rows, rows
    raise ValueError(f"{BINS} values cannot find pairs at {percent} percent")


def shingles(text: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted by (row, hash): (row, hash)."""
    if not 1 <= words <= BINS:
        raise ValueError(f"a shingle has 1 to {BINS} words")
    flat, rows = words_of(text)
    codes, distinct = coded(flat)
    h = mix(distinct + np.uint64(1))[codes] if len(codes) else np.zeros(0, np.uint64)
    sizes = np.bincount(rows, minlength=len(text))
    out_rows, out = [], []
    if len(h) >= words:
        n = len(h) - words + 1
        whole = rows[:n] == rows[words - 1 :]
        sums = np.zeros(n, np.uint64)
        for j in range(words):
            sums += h[j : j + n] * SEEDS[j]
        out_rows.append(rows[:n][whole])
        out.append(mix(sums[whole]))
    for length in range(1, words):  # short texts: the sequence as a whole
        first = (np.cumsum(sizes) - sizes)[sizes == length]
        if len(first):
            sums = np.full(len(first), length, np.uint64)
            for j in range(length):
                sums += h[first + j] * SEEDS[j]
            out_rows.append(rows[first])
            out.append(mix(sums))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, key = np.concatenate(out_rows), np.concatenate(out)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])
    return row[fresh], key[fresh]


def _donors() -> np.ndarray:
    rng = np.random.default_rng(20240229)
    return np.stack([rng.permutation(np.delete(np.arange(BINS), j)) for j in range(BINS)])


DONORS = _donors()


def signatures(row: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """(n, BINS) densified one-permutation signatures; rows without shingles stay 0."""
    bins = (key >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    slot = row * BINS + bins
    first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
    sig, full = np.zeros(n * BINS, np.uint64), np.zeros(n * BINS, bool)
    sig[slot[first]], full[slot[first]] = key[first], True
    some = np.repeat(full.reshape(n, BINS).any(1), BINS)
    open_ = np.flatnonzero(~full & some)
    for t in range(BINS - 1):
        if not len(open_):
            break
        donor = open_ - open_ % BINS + DONORS[open_ % BINS, t]
        hit = full[donor]
        sig[open_[hit]] = sig[donor[hit]]
        open_ = open_[~hit]
    return sig.reshape(n, BINS)


def _sign(words: int, percent: int):
    n_bands, n_rows = bands_for(percent)

    def run(batches):
        for batch in batches:
            for piece in _pieces(batch, "text", 2 << 20):
                n = piece.num_rows
                row, key = shingles(piece.column("text"), words)
                size = np.bincount(row, minlength=n).astype(np.int64)
                edges = np.concatenate([[0], np.cumsum(size)])
                total = np.concatenate([[0], np.cumsum(mix(key + SEEDS[0]))]).astype(np.uint64)
                total2 = np.concatenate([[0], np.cumsum(mix(key ^ SEEDS[1]))]).astype(np.uint64)
                sig = signatures(row, key, n)
                bands = np.zeros((n, n_bands), np.uint64)
                for j in range(n_rows):
                    bands += sig[:, j : n_bands * n_rows : n_rows] * SEEDS[j]
                bands = mix(bands + np.arange(n_bands, dtype=np.uint64) * SEEDS[n_rows]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        pa.array(size),
                        pa.array((total[edges[1:]] - total[edges[:-1]]).view(np.int64)),
                        pa.array((total2[edges[1:]] - total2[edges[:-1]]).view(np.int64)),
                        pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), n_bands).cast(pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
                )

    return run


def signed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands) of every document."""
    return docs_view(docs).mapInArrow(_sign(words, percent), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def small(ids: DataFrame) -> DataFrame:
    """Broadcast ids if there are few; the size is checked."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(doc_id, members) for the given ids: the whole set as sorted 8-byte hashes."""

    def run(batches):
        for batch in batches:
            for piece in _pieces(batch, "text", 2 << 20):
                row, key = shingles(piece.column("text"), words)
                edges = np.searchsorted(row, np.arange(piece.num_rows + 1))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([key[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], names=["doc_id", "members"])

    return docs_view(docs).join(small(ids), "doc_id", "left_semi").mapInArrow(run, "doc_id long, members binary")


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs (a, b) whose full sets reach the limit."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([p, q])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(shared > 0 and 100 * shared >= percent * (len(p) + len(q) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = edges.join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y")), "b")
    two = one.join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x")), "a")
    return two.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of undirected ``edges`` (a, b): large and small stars in turn.

    Component is the smallest node reachable.  Each round is aggregated by node with
    map-side combining and stored, so a star of any size is no single task.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:  # each round at least halves what hangs below a root
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, before = stored(large), now
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        after = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = stored(after)
        common.discard(large, before)
        # done when every node hangs on one root, and no root on anything
        edges_, nodes = now.agg(F.count(F.lit(1)), F.countDistinct("u")).first()
        if edges_ == nodes and not now.select(F.col("v").alias("u")).distinct().join(now.select("u"), "u", "left_semi").limit(1).count():
            break
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components that share a bucket.

    ``members``: (band, key, doc_id, component) of the buckets with several components.
    What the buckets of one largest component hold is gone through together: members
    outside that component ask, and all are asked, on full sets, by an inverted index of
    the asked.  Cells of about CELL shingles on either side bound a task; one link from an
    asker to a component is enough.
    """
    by = ["band", "key"]
    counts = members.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("n"))
    roots = counts.groupBy(*by).agg(F.max(F.struct("n", "component")).alias("top")).select(*by, F.col("top.component").alias("root"))
    rows = stored(members.join(roots, by).select("root", "doc_id", "component").distinct().join(sets, "doc_id"))
    size = F.octet_length("members") / 8
    stats = rows.groupBy("root").agg(F.ceil(F.sum(size) / CELL).cast("int").alias("k"), F.ceil(F.sum(F.when(F.col("component") != F.col("root"), size).otherwise(0)) / CELL).cast("int").alias("q"))
    rows = rows.join(small(stored(stats)), "root").withColumn("h", F.xxhash64("doc_id"))
    asked = rows.withColumn("j", F.pmod("h", "k").cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("q") - 1))).withColumn("asks", F.lit(False))
    askers = rows.where("component <> root").withColumn("i", F.pmod("h", "q").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("asks", F.lit(True))
    cols = ["root", "i", "j", "asks", "doc_id", "component", "members"]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        ids, comp = table["doc_id"].to_numpy(), table["component"].to_numpy()
        each = [np.frombuffer(x, np.uint64) for x in table["members"].to_pylist()]
        to = np.flatnonzero(~asks)
        sizes = np.fromiter((len(each[k]) for k in to), np.int64, len(to))
        keys = np.concatenate([np.zeros(0, np.uint64), *[each[k] for k in to]])
        order = np.argsort(keys)
        keys, owner = keys[order], np.repeat(np.arange(len(to)), sizes)[order]
        a, b = [], []
        for one in np.flatnonzero(asks):
            low, high = np.searchsorted(keys, each[one]), np.searchsorted(keys, each[one], side="right")
            n = high - low
            at = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
            shared = np.bincount(owner[at], minlength=len(to))
            near = np.flatnonzero((shared > 0) & (100 * shared >= percent * (sizes + len(each[one]) - shared)) & (comp[to] != comp[one]))
            near = near[np.unique(comp[to[near]], return_index=True)[1]]
            a.append(np.minimum(ids[to[near]], ids[one]))
            b.append(np.maximum(ids[to[near]], ids[one]))
        return pa.table({"a": pa.array(np.concatenate([np.zeros(0, np.int64), *a])), "b": pa.array(np.concatenate([np.zeros(0, np.int64), *b]))})

    # dealt by cell: a partitioning by root alone would do for the grouping, but put a root into one task
    cells = asked.select(*cols).unionByName(askers.select(*cols)).repartition("root", "i", "j")
    return cells.groupBy("root", "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = stored(signed(docs, words, percent))
    with_set = rows.where("doc_id is not null and n_shingles > 0")
    key = ["n_shingles", "set_a", "set_b"]
    nodes = stored(with_set.groupBy(*key).agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("__n")))
    # copies hang on their node: links between equal sets, as a star
    copies = join_groups(with_set.select(*key, "doc_id"), nodes.where("__n > 1"), key, "__n", rows.count(), "inner")
    copies = stored(copies.where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b")).distinct())
    heads = with_set.join(nodes.select(*key, F.col("node").alias("doc_id")), [*key, "doc_id"], "left_semi").dropDuplicates(["doc_id", *key])
    heads = stored(heads.select("doc_id", "bands"))
    band = heads.select("doc_id", F.posexplode("bands").alias("band", "key"))
    shared = band.groupBy("band", "key").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    buckets = stored(band.join(shared, ["band", "key"]))  # members of the buckets with two sets or more
    stars = stored(buckets.where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct())
    ids = stored(stars.select(F.col("a").alias("doc_id")).unionByName(stars.select(F.col("b").alias("doc_id"))).distinct())
    sets = stored(shingle_sets(docs.where("doc_id is not null"), ids, words))
    links = stored(confirmed(stars, sets, percent))
    found = stored(components(links))
    placed = buckets.select("band", "key", "doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = placed.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi and n > 2").select("band", "key")
    more = stored(across(placed.join(mixed, ["band", "key"], "left_semi"), sets, percent))
    found = stored(components(links.unionByName(more).unionByName(copies)))
    common.discard(nodes, copies, heads, buckets, stars, ids, sets, links, more)
    out = rows.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    own = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component: the one with the smallest id; all columns."""
    gone = near_duplicates(docs, words, percent, id_col, text_col).where("not kept").select("doc_id").distinct()
    gone = small(stored(gone))
    return docs.join(gone.withColumnRenamed("doc_id", "__gone"), F.col(id_col) == F.col("__gone"), "left_anti")
