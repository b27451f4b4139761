"""Shared plumbing: durable intermediate tables, whole-text word splitting, packed binary columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters outside these six; everything else, Unicode spaces included, belongs to words.
BLANKS = r"[\x20\x09-\x0D]+"
#: Texts are cut into slices of about this many bytes before they are turned into arrays, so memory follows the slice, not the batch.
SLICE_BYTES = 2 << 20
#: A small table gets one file for so many bytes of the operator's input.
SMALL_FILES_EACH = 256 << 20
#: Catalyst's sizes from here on stand for tables of unknown size.
UNKNOWN = 1 << 62
#: Stands for a null doc_id where ids are packed into arrays: nulls sort after every id.
NULL_ID = np.iinfo(np.int64).max


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local master, whose executors are the driver, may do without one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="verbatrix-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Durable:
    """Intermediate tables of one operator, written as Parquet to the shared folder and read back.

    A written table survives the loss of executors and cuts the lineage. Tables that the result still reads stay
    until the folder is cleaned; the others go with ``drop``.
    """

    def __init__(self, spark: SparkSession, operator: str, like: DataFrame | None = None):
        """``like`` is the operator's input: tables that are written as small have few files for each of its gigabytes."""
        self.spark, self.root = spark, f"{shared_dir(spark)}/{operator}-{uuid.uuid4().hex}"
        self.few, self.held = max(3, (planned_bytes(like) or 0) // SMALL_FILES_EACH if like is not None else 0), 0

    def write(self, df: DataFrame, name: str, small: bool = False) -> DataFrame:
        """The table as it reads back. What makes it keeps its partitions; a small one is dealt into few files after that."""
        path = f"{self.root}/{name}"
        if small:
            df = df.repartition(self.few)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def hold(self, df: DataFrame, small: bool = True) -> DataFrame:
        """``write`` under a number, mostly of a small table; for those of iterations, whose plans would grow otherwise."""
        self.held += 1
        return self.write(df, f"held-{self.held}", small)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def forget_shuffles(self) -> None:
        """Let Spark delete the shuffle files that no plan can read any more, between phases that each shuffle more than their input.

        Spark does so when the driver's collector finds that their plans are gone. On a driver that has little to do that may take
        half an hour, and the disks then hold all phases' files together. The first collection lets go of what Python's names
        stood for, the second of the plans; files are deleted in the background, for which there is a moment.
        """
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)


def planned_bytes(df: DataFrame) -> int | None:
    """Catalyst's sizes of the tables that df reads, from file sizes; nothing runs. None if one of them is unknown.

    The sum over tables is no estimate of df itself, which a join may multiply, but of the work that it stands for.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return None if any(n >= UNKNOWN for n in sizes) else sum(sizes)


def buckets_for(df: DataFrame, column: str = "text", bytes_each: int = 16 << 20) -> int:
    """How many buckets to deal work from df into: in proportion to its size, so that one bucket's share stays the same.

    Where Catalyst has no size, the bytes of ``column`` are summed up.
    """
    size = planned_bytes(df)
    if size is None:
        size = df.agg(F.sum(F.octet_length(column)).alias("n")).head().n or 0
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // bytes_each)


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: int = 8 << 20):
    """Jobs that run inside send Python batches of about ``most`` bytes; so many rows a batch, as is usual, may be long texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def hot_keys(df: DataFrame, key: str, rows_each: int = 50_000) -> DataFrame:
    """key and parts (two or more) of the keys with more than ``rows_each`` rows, or more than a 4096th of all: at most 4096 rows."""
    counts = df.groupBy(key).agg(F.count("*").alias("__vx_n"))
    limit = max(rows_each, df.count() // 4096)
    return counts.filter(F.col("__vx_n") > limit).select(key, F.ceil(F.col("__vx_n") / limit).cast("int").alias("__vx_parts"))


def spread_join(left: DataFrame, right: DataFrame, key: str, spread: list[str], how: str = "inner") -> DataFrame:
    """left joined to right, which has few rows a key, where a key may hold a large share of left.

    Rows of such keys are dealt out by a hash of ``spread``, and met by a copy of right's rows in each part. Rows without a
    key meet nothing, and are dealt out too.
    """
    hot = F.broadcast(hot_keys(left, key))
    parts = F.coalesce("__vx_parts", F.lit(1))
    dealt = left.join(hot, key, "left").withColumn("__vx_part", F.pmod(F.xxhash64(*spread), F.when(F.col(key).isNull(), F.lit(4096)).otherwise(parts)).cast("int")).drop("__vx_parts")
    copies = right.join(hot, key, "left").withColumn("__vx_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__vx_parts")
    return dealt.join(copies, [key, "__vx_part"], how).drop("__vx_part")


def tidy() -> None:
    """Give free memory back to the system; workers stay for a while after their task, and then hold little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """A function over batches that leaves its worker with little memory."""

    def batches(source):
        yield from run(source)
        tidy()

    return batches


def lean_group(run):
    """A function of a group that leaves its worker with little memory."""

    def group(table):
        out = run(table)
        tidy()
        return out

    return group


def row_slices(lengths: np.ndarray, most: int = SLICE_BYTES):
    """Consecutive row ranges of about ``most`` bytes; a longer text gets a range of its own."""
    ends, start = np.cumsum(lengths), 0
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield start, stop
        start = stop


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int | None = None):
    """Slices of a batch; each is (rows, texts) with nulls as empty texts."""
    texts = pc.fill_null(batch.column(column), "")
    lengths = np.asarray(pc.binary_length(texts)).astype(np.int64) + 1
    for start, stop in row_slices(lengths, most or SLICE_BYTES):
        yield batch.slice(start, stop - start), texts.slice(start, stop - start)
        tidy()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in one array, and where each text's words start (one more entry than texts)."""
    lists = pc.ascii_split_whitespace(texts)
    offsets = np.asarray(lists.offsets).astype(np.int64)
    flat = lists.flatten()
    offsets -= offsets[0]
    full = np.asarray(pc.binary_length(flat)) > 0
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        flat = flat.filter(pa.array(full))
    return flat, offsets


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word is hashed once."""
    coded = words.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    distinct = np.fromiter((digest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return distinct[np.asarray(coded.indices)] if len(words) else distinct


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values, so that any of their bits can serve as a bucket or key."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Rabin-Karp hashes of all windows of ``width`` words, modulo 2**64, for one odd base."""

    def __init__(self, base: int, width: int):
        self.base, self.inverse, self.width = base, pow(base, -1, 1 << 64), width
        self.up = self.down = np.empty(0, np.uint64)

    def __call__(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if len(self.up) < len(hashes):
            self.up, self.down = powers(self.base, len(hashes)), powers(self.inverse, len(hashes))
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.up[: len(hashes)], out=total[1:])
        return (total[starts + self.width] - total[starts]) * self.down[starts]


def window_starts(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window that lies within one text, and the text it is in."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - first[owner] + offsets[:-1][owner], owner


def run_starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """For keys sorted together: True where a new key begins."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary column: row i holds the bytes of values[cuts[i]:cuts[i + 1]]."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def unpacked(column: pa.Array | pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and how many each row has."""
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), dtype), np.fromiter((len(c) for c in cells), np.int64, len(cells)) // np.dtype(dtype).itemsize


def filled_ids(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(column, int(NULL_ID))).astype(np.int64)


def doc_key(name: str = "doc_id"):
    """The id as packed arrays hold it."""
    return F.coalesce(F.col(name).cast("long"), F.lit(int(NULL_ID)))


def least_hashed(df: DataFrame, by: str, key: str, most: int, shares: int = 256) -> DataFrame:
    """For each value of ``by``, the ``most`` rows of the least hash of ``key``; ties go to the lesser key.

    Each share of a group is ranked by itself first, so that no task sees more of a group than its share, or what shares kept.
    """
    h = F.xxhash64(key)
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(h, key))
    first = df.withColumn("__vx_share", F.pmod(h, F.lit(shares))).withColumn("__vx_r", rank(by, "__vx_share")).filter(F.col("__vx_r") <= most)
    return first.withColumn("__vx_r", rank(by)).filter(F.col("__vx_r") <= most).drop("__vx_share", "__vx_r")


def hash_fold(name: str, parts: int):
    """crc32 of the id as text, modulo ``parts``: the fold a document falls into."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % parts
