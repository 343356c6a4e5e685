"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of bytes other than these, the space and \x09 to \x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that are turned into arrays at a time; a longer text is taken alone, in pieces of this size.
CHUNK = 256 << 10

_TABLES: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.  Where it is unset, a local session, as in tests, gets one
    of its own; a cluster has no folder that we could choose, so there it's an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        set_dir = f"file://{tempfile.gettempdir()}/checkpoints"
    return set_dir.rstrip("/")


def written(df: DataFrame, instead: DataFrame | None = None) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, which outlives any executor.

    The tables of a session lie in one folder named after the application and go when the driver exits; a table that
    this one comes instead of (an earlier round of a loop) goes at once.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    root = f"{shared_dir(spark)}/drafthaus-{app}"
    if app not in _TABLES:
        _TABLES.add(app)
        atexit.register(_drop, spark, root)
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if instead is not None:
        _drop(spark, instead.written_path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def _drop(spark: SparkSession, root: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended; the folder is the cluster's to clear
        pass


def in_batches(df: DataFrame) -> DataFrame:
    """df, of whose rows an Arrow batch for Python holds 4 MB, or one row that is longer.

    Spark's own default, 64 MB, counts several times for each task, in the JVM and in Python.  The setting is of the session;
    one that differs from the default is left alone.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) in ("67108864b", "64MB", "67108864"):
        conf.set(key, "4194304b")
    return df


def give_back() -> None:
    """Returns to the system what a task has freed, as Spark keeps its Python workers for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to be no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has at most so many rows; beyond that Spark shuffles both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node that can be reached.  edges: two long columns.

    Large-star and small-star steps in turn until nothing changes.  The smallest neighbours are a minimum with map-side
    combine and are written, so that Spark can split the partition of a node with many edges where they meet it in a
    join; no node's neighbours need meet in one task, and no links reach the driver.  Nodes without an edge to
    another node have no row.
    """
    a, b = edges.columns
    e = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = least = large = None
    while True:
        state = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.hash("v", "u").cast("long"))).first())
        if state == seen or not state[0]:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
        both = e.union(e.select("v", "u"))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), least)
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), large)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), least)
        joined = large.join(least, "u")
        small_star = joined.select("u", F.col("m").alias("v")).union(joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        e = written(small_star, e)


# --- hashes of words and word shingles over Arrow buffers ---


def _splitmix(n: int, seed: int) -> np.ndarray:
    z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return mixed(z)


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


BYTE = _splitmix(256, 11)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[0x41:0x5B] = BYTE[0x61:0x7B]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins (and the last ends); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    raw = column.buffers()
    at = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array):
    """(first row, bytes, offsets) of pieces of a string column of about CHUNK bytes."""
    if not len(column):
        return
    data, at = buffers(column)
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK, "right")) - 1)
        yield first, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


class Words:
    """The words of a chunk: where each begins and ends, the words of each text, and hash sums of the bytes."""

    def __init__(self, data: np.ndarray, at: np.ndarray, spaces: np.ndarray = SPACES, values: np.ndarray = BYTE_LOWER):
        inside = ~spaces[data]
        n = len(data)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[at[:-1][at[:-1] < n]] = False
        after[at[1:][at[1:] > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, at)  # of each text's words
        self.count = np.diff(self.first)
        size = self.end - self.start
        place = np.zeros(n, np.int64)  # of a byte in its word
        if len(self.start):
            place[self.start[0] :] = np.arange(self.start[0], n) - np.repeat(self.start, np.diff(np.append(self.start, n)))
        powers = _splitmix(int(size.max()) + 1 if len(size) else 1, 23) | np.uint64(1)
        np.minimum(place, len(powers) - 1, out=place)
        part = values[data] * powers[place]
        part[~inside] = 0
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(part, out=self.sums[1:])
        self.size = size

    def hashes(self) -> np.ndarray:
        return mixed((self.sums[self.end] - self.sums[self.start]) + self.size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def pieces(data: np.ndarray, spaces: np.ndarray = SPACES):
    """(begin, end) of pieces of a long text of about CHUNK bytes, cut where a word has ended."""
    first, n = 0, len(data)
    while first < n:
        last = min(n, first + CHUNK)
        while last < n:
            gaps = np.flatnonzero(spaces[data[last : last + CHUNK]])
            if len(gaps):
                last += int(gaps[0])
                break
            last = min(n, last + CHUNK)
        yield first, last
        first = last


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a chunk, and how many words each text has; a long text piece by piece."""
    if len(data) <= CHUNK:
        w = Words(data, at)
        return w.hashes(), w.count
    h = np.concatenate([Words(data[a:b], np.array([0, b - a])).hashes() for a, b in pieces(data)])
    return h, np.array([len(h)])


def shingles(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash), sorted and distinct, of the k-word shingles of each text; of fewer words, the whole sequence."""
    h, count = word_hashes(data, at)
    begin = np.concatenate([[0], np.cumsum(count)])
    factor = _splitmix(k, 37) | np.uint64(1)
    n = len(h)
    text = np.repeat(np.arange(len(at) - 1), count)
    full = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        full += h[j : n - k + 1 + j] * factor[j] if n >= k else 0
    last = begin[1:][text[: len(full)]]
    inside = np.arange(len(full)) + k <= last
    texts, values = [text[: len(full)][inside]], [mixed(full[inside])]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        total = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            total[has] += h[begin[short[has]] + j] * factor[j]
        texts.append(short)
        values.append(mixed(total + count[short].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
    text, value = np.concatenate(texts), np.concatenate(values)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]
