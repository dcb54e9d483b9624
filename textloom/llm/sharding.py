"""K-d tree sharding: equal bytes per leaf, cut along the widest metadata dimension.

Rows with equal text form one weighted point (they share all coordinates), so copies
stay in one shard unless a single group is too heavy for that.  A node is cut at the
weighted median of its widest dimension; the median is found by refining a histogram
of at most 2**BINS_BITS sums per node, so the driver only ever holds a bounded number of
sums.  Cutting ends when a leaf holds its share of the bytes (``shards`` leaves, or as
many as ``target_bytes`` asks for).  Everything runs on narrow rows as DataFrame
operations; texts never move.

Law: ``bytes`` - every shard gets the same number of bytes, up to ``TOLERANCE`` of a
node per cut.  Defined results: a null text has size 1 and the CRC of the empty text;
rows that repeat are separate rows of one point; ties on a dimension fall back to the
group's hash and then the row's hash; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import join_groups, stored

#: Bits of a histogram pass, and of the three parts of a row's key.
BINS_BITS, BITS = 11, (33, 32, 32)
#: A cut may miss the wanted byte share by this part of its node.
TOLERANCE = 0.0005
#: A group of equal texts is kept whole if that costs at most this part of its node.
GROUP_TOLERANCE = 0.01
#: Sums that a pass brings to the driver.
MOST_SUMS = 1 << 18
#: Rows of one numbering task.
ROWS_PER_SLOT_TASK = 200_000


def points(docs: DataFrame, id_col: str, text_col: str, dims: list[str]) -> DataFrame:
    """One row per document: size, CRC, group hash, row hash and unit-range coordinates.

    ``dims`` are metadata columns, placed by hash; the logarithm of the size is always
    dimension 0 (scaled by the caller).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    unit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.octet_length(text)).alias("gid"),
        *[unit(F.coalesce(F.col(d).cast("string"), F.lit(""))).alias(f"d_{i + 1}") for i, d in enumerate(dims)],
        F.log2((F.octet_length(text) + F.lit(1)).cast("double")).alias("d_0"),
    ).withColumn("rid", F.xxhash64(F.lit(17), "doc_id"))
    return rows


def _u32(c: Column) -> Column:
    """The first 32 bits of a hash, unsigned."""
    return F.shiftrightunsigned(c, 32)


def keys(coordinate: Column) -> list[Column]:
    """The order of rows along a dimension: coordinate, group hash, row hash as integers of BITS bits."""
    return [F.floor(coordinate * F.lit(float(1 << BITS[0]))).cast("long"), _u32(F.col("gid")), _u32(F.col("rid"))]


def _small(rows: DataFrame, values: list[tuple], names: str) -> DataFrame:
    """A table with one row to a node at most, so as many rows as there are shards, ready to be joined."""
    kinds = {"node": pa.int32(), "dim": pa.int32(), "upper": pa.int32()}
    columns = [pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names.split(), zip(*values, strict=True), strict=True)]
    return F.broadcast(rows.sparkSession.createDataFrame(pa.table(columns, names=names.split())))


def along(rows: DataFrame, n_dims: int) -> Column:
    """The coordinate along ``dim``."""
    return F.element_at(F.array(*[F.col(f"d_{i}") for i in range(n_dims)]), F.col("dim") + 1)


def widest(rows: DataFrame, n_dims: int) -> dict[int, tuple[int, float]]:
    """node -> (widest dimension, bytes)."""
    spans = [(F.max(f"d_{i}") - F.min(f"d_{i}")).alias(f"s_{i}") for i in range(n_dims)]
    return {r["node"]: (max(range(n_dims), key=lambda i: (r[f"s_{i}"], -i)), float(r["w"])) for r in rows.groupBy("node").agg(F.sum("size").alias("w"), *spans).collect()}


def medians(rows: DataFrame, n_dims: int, weight: dict[int, float], dims: dict[int, int], want: dict[int, float]) -> dict[int, list[int]]:
    """node -> keys of the first row above its cut, for all nodes at once.

    The keys are refined some bits at a time: a pass sums the bytes of the next digit below
    each open node's prefix, and the bin that holds the median becomes the prefix.  A pass
    brings at most MOST_SUMS sums to the driver.
    """
    below, prefix, open_ = dict.fromkeys(dims, 0.0), {n: [0, 0, 0] for n in dims}, set(dims)
    for part, bits in enumerate(BITS):
        left = bits
        while left > 0 and open_:
            take = min(BINS_BITS, left, max(1, (MOST_SUMS // len(open_)).bit_length() - 1))
            left -= take
            table = _small(rows, [(n, dims[n], *prefix[n]) for n in sorted(open_)], "node dim p0 p1 p2")
            key = keys(along(rows, n_dims))
            inside = F.shiftright(key[part], left + take) == F.col(f"p{part}")
            for p in range(part):
                inside &= key[p] == F.col(f"p{p}")
            sums: dict[int, list[tuple[int, float]]] = {}
            for r in rows.join(table, "node").where(inside).groupBy("node", F.shiftright(key[part], left).alias("digit")).agg(F.sum("size").alias("w")).collect():
                sums.setdefault(r["node"], []).append((int(r["digit"]), float(r["w"])))
            for n in sorted(open_):
                slack = weight[n] * (GROUP_TOLERANCE if part == 1 and left == 0 else TOLERANCE)
                for value, w in sorted(sums[n]):
                    if below[n] + w < want[n]:
                        below[n] += w
                        continue
                    over, short = below[n] + w - want[n], want[n] - below[n]
                    prefix[n][part] = value
                    if min(over, short) <= slack:
                        prefix[n][part] = (value + (over <= short)) << left
                        open_.discard(n)
                    break
    return prefix


def assign(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` of ``points`` with a column ``shard``: all nodes of a level are cut at once, by a table of cuts."""
    n_dims, nodes, level = sum(c.startswith("d_") for c in rows.columns), {0: shards}, 0
    columns, rows = rows.columns, rows.withColumn("node", F.lit(0))
    while any(n > 1 for n in nodes.values()):
        wide = {k: x for k, x in widest(rows, n_dims).items() if nodes[k] > 1}
        dims, weight = {k: d for k, (d, _) in wide.items()}, {k: w for k, (_, w) in wide.items()}
        cuts = medians(rows, n_dims, weight, dims, {k: w * (nodes[k] // 2) / nodes[k] for k, w in weight.items()}) if dims else {}
        if cuts:
            table = _small(rows, [(k, dims[k], *cuts[k], k + nodes[k] // 2) for k in cuts], "node dim p0 p1 p2 upper")
            joined = rows.join(table, "node", "left")
            k0, k1, k2 = keys(along(rows, n_dims))
            low = (k0 < F.col("p0")) | ((k0 == F.col("p0")) & ((k1 < F.col("p1")) | ((k1 == F.col("p1")) & (k2 < F.col("p2")))))
            rows = joined.select(*columns, F.when(F.col("upper").isNull() | low, F.col("node")).otherwise(F.col("upper")).alias("node"))
        following = {}
        for k, n in nodes.items():
            following[k] = max(1, n // 2)
            if n > 1:
                following[k + n // 2] = n - n // 2
        nodes, level = following, level + 1
        if level % 4 == 0:
            rows = stored(rows)
    return rows.withColumnRenamed("node", "shard")


def numbered(rows: DataFrame, total: int) -> DataFrame:
    """Add ``slot``: gapless from 0 in each shard, without a task that holds a whole shard."""
    parts = max(1, math.ceil(total / ROWS_PER_SLOT_TASK))
    rows = rows.withColumn("__part", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(parts)).cast("int"))
    counts = rows.groupBy("shard", "__part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "__part", (F.sum("n").over(Window.partitionBy("shard").orderBy("__part")) - F.col("n")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("shard", "__part").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("__rank", rank).join(before, ["shard", "__part"]).withColumn("slot", (F.col("__before") + F.col("__rank") - 1).cast("long")).drop("__part", "__rank", "__before")


def shard(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    rows = stored(points(docs, id_col, text_col, [d for d in dims if d in docs.columns]))
    total, size, most = rows.agg(F.count(F.lit(1)), F.sum("size"), F.max("d_0")).first()
    meta = sorted(c for c in rows.columns if c.startswith("d_") and c != "d_0")
    # copies take their group's least coordinates, so a cut on metadata leaves them together
    least = stored(rows.groupBy("gid").agg(F.count(F.lit(1)).alias("__n"), *[F.min(c).alias(f"m_{c}") for c in meta]).where("__n > 1"))
    rows = join_groups(rows, least, ["gid"], "__n", total, "left").select("doc_id", "size", "text_crc32", "gid", "rid", (F.col("d_0") / F.lit((most or 0.0) + 1e-6)).alias("d_0"), *[F.coalesce(f"m_{c}", c).alias(c) for c in meta])
    rows = stored(rows)
    if target_bytes:
        shards = max(1, math.ceil((size or 0) / target_bytes))
    out = numbered(assign(rows, shards or 1), total)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
