"""Shared pieces: intermediate tables, block packing and the block exchange.

Several operators need one fact about every window, word or word pair of the
corpus (how often does it occur, does it occur in another document).  Exploding
one Spark row per occurrence costs far more than the work itself, so documents
are packed into *blocks* (a few MB of text in one Arrow IPC payload), each block
sends at most one packed array per bucket of the key space, a reducer answers
with an array aligned to the one it got, and the answers are grouped back with
their block.  A key contributes at most one entry per block, so a key that holds
a third of all rows is already pre-aggregated before the shuffle, and a block or
a bucket has a bounded size whatever the corpus looks like.
"""

from __future__ import annotations

import atexit
import contextlib
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes packed into one block.
BLOCK_BYTES = 4 << 20
#: Bytes of an Arrow batch that goes to a worker while tables are written.
BATCH_BYTES = 4 << 20

#: Bytes of a row group of stored tables.
GROUP_BYTES = 8 << 20

_left_behind: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where it is unset, a local master (one machine, as in tests) gets a fresh folder; on a
    cluster that is an error, as executors do not see each other's disks.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='textloom-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone at interpreter exit
        pass


@atexit.register
def _clean() -> None:
    while _left_behind:
        _delete(*_left_behind.pop())


@contextlib.contextmanager
def writing(spark: SparkSession):
    """Settings while a table is written.

    Arrow batches are a few MB, as both sides of the pipe hold one per task, and Spark
    deletes the shuffle files of the write when it is done.
    """
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def stored(df: DataFrame, rows_per_group: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    A lost executor then costs a re-read, not a recomputation.  Tables are removed by
    ``discard``, or when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom/{uuid.uuid4().hex}"
    _left_behind.append((spark, path))
    writer = df.write.option("parquet.block.size", GROUP_BYTES)  # what a writer holds in memory
    if rows_per_group:
        writer = writer.option("parquet.block.row.count.limit", rows_per_group)
    with writing(spark):
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    for table in tables:
        path = getattr(table, "stored_at", None)
        if path:
            _delete(table.sparkSession, path)
            _left_behind[:] = [x for x in _left_behind if x[1] != path]


def docs_view(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id long, text string), text never null; other columns cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


#: Groups that are joined by broadcast: no more can hold this share of all rows.
HOT_GROUPS = 50_000


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], n: str, total: int, how: str) -> DataFrame:
    """``rows`` (read twice, so stored) joined with one row to a group, without a task for a large group.

    ``n`` is the number of rows of a group.  At most HOT_GROUPS groups can have more than their
    share of ``total`` rows: those are broadcast, the rest meet by a shuffle.
    """
    most = max(1000, total // HOT_GROUPS)
    hot, cold = F.broadcast(groups.where(F.col(n) > most)), groups.where(F.col(n) <= most)
    return rows.join(hot, key).unionByName(rows.join(hot.select(*key), key, "left_anti").join(cold, key, how))


def tidy() -> None:
    """Give back memory that a worker has freed: it lives as long as its executor."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


try:
    import ctypes

    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018 - present in glibc only
    _libc.mallopt(-3, 16 << 20)  # arrays over 16 MB are mapped, and unmapped when they go
except (OSError, AttributeError):
    _libc = None


# --------------------------------------------------------------------- blocks
def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all().combine_chunks()


def _pieces(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``most`` bytes of text (a row stays whole).

    Each run is copied to arrays that start at offset 0: some string kernels misread slices.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch if stop - start == batch.num_rows and not batch.column(column).offset else batch.take(pa.array(np.arange(start, stop)))
        start = stop
    tidy()


def packer(column: str = "text", most: int = BLOCK_BYTES) -> Callable:
    """mapInArrow function: rows -> (block, payload) rows, block ids unique by task."""

    def pack(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 24
        held, size = [], 0

        def flush():
            nonlocal held, size, number
            table = pa.Table.from_batches(held).combine_chunks()
            out = pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "payload": pa.array([to_ipc(table.to_batches()[0])], pa.binary())})
            held, size, number = [], 0, number + 1
            return out

        for batch in batches:
            for piece in _pieces(batch, column, most):
                own = int(pc.sum(pc.binary_length(piece.column(column))).as_py() or 0)
                if held and size + own > most:
                    yield flush()
                held.append(piece)
                size += own
        if held:
            yield flush()

    return pack


def scale(spark: SparkSession) -> int:
    """spark.textloom.scale: how many times the usual size blocks and buckets have (1).

    An exchange moves up to blocks x buckets rows; with 16 GB executors and 100 TB of text,
    16 or more keeps rows large.  Memory of a task grows with it; results do not change.
    """
    return max(1, int(spark.conf.get("spark.textloom.scale", "1")))


def packed(docs: DataFrame, column: str = "text", most: int | None = None) -> DataFrame:
    """A stored table (block long, payload binary); a block is a few MB of rows."""
    most = most or BLOCK_BYTES * scale(docs.sparkSession)
    return stored(docs.mapInArrow(packer(column, most), "block long, payload binary"), rows_per_group=4)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return int(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def buckets_for(size: int, each: int, spark: SparkSession) -> int:
    """Buckets of an exchange over ``size`` bytes of text, ``each`` bytes to one."""
    return max(4, math.ceil(size / (each * scale(spark))))


def spread(rows: DataFrame, by: str, n: int) -> DataFrame:
    """Hash rows over as many partitions as there are buckets, within reason."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, min(n, 4 * least)), by)


def reply_to(blocks: DataFrame, replies: DataFrame, answer: Callable, schema: str) -> DataFrame:
    """Bring every block together with the replies to it.

    ``answer(block, payload, {bucket: reply})`` gets one block at a time and returns
    a pyarrow table of ``schema``.
    """

    def both(key: tuple, table: pa.Table) -> pa.Table:
        payload, got = None, {}
        for bucket, data in zip(table["bucket"].to_pylist(), table["payload"].to_pylist(), strict=True):
            if bucket is None:
                payload = data
            else:
                got[bucket] = data
        out = answer(key[0].as_py(), payload, got)
        del payload, got
        tidy()
        return out

    rows = blocks.select("block", F.lit(None).cast("int").alias("bucket"), "payload").unionByName(replies.select("block", "bucket", "payload"))
    return rows.groupBy("block").applyInArrow(both, schema)


# --------------------------------------------------------------------- hashing
def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), applied elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_strings(values: list[str]) -> np.ndarray:
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(v.encode("utf-8", "surrogatepass")) for v in values), np.uint64, len(values))


def hash_array(values: pa.Array) -> np.ndarray:
    """64-bit hashes of a string array, eight bytes of all strings at a time."""
    values = values.cast(pa.large_string())
    if not len(values):
        return np.zeros(0, np.uint64)
    _, offsets, data = values.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(values) + 1, 8 * values.offset)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    raw = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    at, left = bounds[:-1] - bounds[0], np.diff(bounds)
    h = mix(left.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D))
    active = np.flatnonzero(left > 0)
    while len(active):
        rest = np.minimum(left[active], 8).astype(np.uint64)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest)
        h[active] = mix((h[active] ^ (words[at[active]] & mask)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))
        at[active] += 8
        left[active] -= 8
        active = active[left[active] > 0]
    return h


def words_of(text: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a string array, flat, and each one's row."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text.cast(pa.large_string()), "")
    if lower:
        text = pc.ascii_lower(text)
    lists = pc.ascii_split_whitespace(text)
    rows = np.repeat(np.arange(len(lists), dtype=np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    flat = lists.flatten()
    full = pc.not_equal(flat, "")
    if not pc.all(full).as_py() and len(flat):
        flat = flat.filter(full)
        rows = rows[full.to_numpy(zero_copy_only=False)]
    return flat, rows


def coded(flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Dictionary codes of a flat string array, and the hashes of the distinct strings."""
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), hash_array(d.dictionary)
