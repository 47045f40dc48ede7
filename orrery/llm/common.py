"""What the training-data operators share: worker setup, cut points, text batches, packed blocks."""

from __future__ import annotations

import os
import pickle
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: The same class in a Spark SQL string literal handed over through the DataFrame API.
SPACES = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package however the driver found it, each computing on one thread: a worker has
    one core, and small products gain nothing from threads that wait for each other."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
    env["OPENBLAS_NUM_THREADS"] = "1"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    A local session that names none (a test) gets one of its own; on a cluster that is an error, as executors would
    each write to a disk of their own.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            base = known.get()
        elif not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="orrery-")
            sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later failures restart from there."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_place(docs: DataFrame, file: str, row: str) -> DataFrame:
    """docs with the name of each row's file and its number there, which tell the order they were written in: readers
    deal a table out by size of file. Rows that come from no Parquet file are numbered as they stand, file null."""
    meta = None
    if docs.inputFiles():
        meta = docs.metadataColumn("_metadata")
    if meta is None:
        return docs.withColumns({file: F.lit(None).cast("string"), row: F.monotonically_increasing_id()})
    return docs.withColumns({file: meta["file_name"], row: meta["row_index"]})


def parts(spark: SparkSession, times: int = 2) -> int:
    """How many groups packed blocks are dealt into; follows the session's shuffle partitions."""
    return max(16, times * int(spark.conf.get("spark.sql.shuffle.partitions")))


def texts(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """The key columns and the text, null read as empty."""
    return df.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("text"))


def slices(batches, most_bytes: int = 24 << 20, most_rows: int = 4096):
    """The batches cut so that none holds much more than most_bytes; a longer row stands alone."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.zeros(n, np.int64)
        for column in batch.columns:
            if pa.types.is_binary(column.type) or pa.types.is_string(column.type):
                off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
                size += np.diff(off)
        ends = np.cumsum(size)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, base + most_bytes, "right"))
            to = min(max(to, at + 1), at + most_rows, n)
            yield batch.slice(at, to - at)
            at = to


def pack(**arrays) -> bytes:
    """Arrays (and lists of bytes) in one compressed block."""
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def unpack(block) -> dict:
    """Blocks come only from pack() in the same job."""
    return pickle.loads(zstandard.ZstdDecompressor().decompress(bytes(block)))


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def held_out(column: str, divisor: int) -> "F.Column":
    """crc32 of the id as text leaves remainder 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % divisor == 2, F.lit(False))


def dealt_keys(n: int) -> np.ndarray:
    """n int keys of which Spark's hash partitioning into n puts exactly one in each partition."""
    x = np.arange(n * 40 + 1000, dtype=np.uint32)

    def rotl(v, r):
        return (v << np.uint32(r)) | (v >> np.uint32(32 - r))

    # murmur3 of one int, seed 42, as Spark's HashPartitioning computes it
    k = rotl(x * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = rotl(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    at = h.view(np.int32).astype(np.int64) % n
    keys, first = np.unique(at, return_index=True)
    out = np.arange(n, dtype=np.int64)
    out[keys] = first
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + l)."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)


def pieces(first: np.ndarray, n: int):
    """(start, end) of each run, given where runs start among n rows."""
    return zip(first.tolist(), [*first[1:].tolist(), n], strict=True) if len(first) else iter(())


def tidied(kernel):
    """The kernel, giving freed memory back to the system when a task ends: workers outlive tasks."""

    def run(batches):
        try:
            yield from kernel(batches)
        finally:
            tidy()

    return run


def tidy() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)
