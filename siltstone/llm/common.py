"""Helpers that the corpus operators share: tables in the shared folder, size-checked broadcasts, byte-level words."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For str.translate and bytes.translate: A-Z to a-z and nothing else.
FOLD_TEXT = str.maketrans(UPPER, LOWER)
FOLD_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


#: Most rows, and most bytes, of a batch that goes to a Python worker: rows are whole documents here, some of them long.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20
_BOUNDS = (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES))


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of an Arrow batch to BATCH_ROWS and BATCH_BYTES, so that a batch of long documents fits a worker.

    They are read when a plan runs, which is after the operator has returned: so they stay. A lower bound isn't raised.
    """
    for name, most in _BOUNDS:
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
        if not 1 <= now <= most:
            spark.conf.set(name, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Unset, it is a temporary one if all tasks run in this process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage there, and outlives lost executors.

    It is there until the session ends, or until ``forget`` is called for it.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_folder(spark)}/siltstone-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


GARBAGE_SECONDS = 10.0
_looked = float("-inf")


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that no plan will read again; other DataFrames are left alone.

    Then, every GARBAGE_SECONDS at most, the driver looks for garbage: with plans that are done Spark
    deletes their shuffle files too, which else stay on the executors' disks until the driver's heap fills.
    """
    global _looked
    spark = None
    for table in tables:
        path = getattr(table, "_written_at", None)
        if path:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if spark is not None and time.monotonic() - _looked > GARBAGE_SECONDS:
        gc.collect()
        spark._jvm.System.gc()
        _looked = time.monotonic()


def small_or_plain(df: DataFrame, most: int) -> DataFrame:
    """A broadcast copy of df if it has at most ``most`` rows, else df itself for an ordinary join."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


#: Rows of a key from which on it is hot, at least; hot keys that are broadcast, at most.
HOT_ROWS, HOT_KEYS = 2_000, 20_000


def hot_join(rows: DataFrame, table: DataFrame, key: str | list[str], total: int, count: str = "n") -> DataFrame:
    """rows joined with a table of one row a key and its ``count`` of rows; total: how many rows there are, or more.

    A hot key's row is broadcast, so that its rows stay where they are; there are at most
    HOT_KEYS of them, as what is hot grows with the total. The others meet by hash.
    """
    keys = [key] if isinstance(key, str) else key
    hot = max(HOT_ROWS, -(-total // HOT_KEYS))
    many, few = (table.where(c).drop(count) for c in (F.col(count) > hot, F.col(count) <= hot))
    return rows.join(F.broadcast(many), keys).unionByName(rows.join(F.broadcast(many.select(*keys)), keys, "left_anti").join(few, keys))


def free_name(columns: Iterable[str], wanted: str) -> str:
    """``wanted``, with as many underscores as make it differ from all ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def plain_names(docs: DataFrame, *named: str) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """docs with its columns that begin like helper columns (``__``) under other names; what the columns ``named`` are called now; and

    a function that gives such columns their names back, and leaves all others of its table as they are.
    """
    new: dict[str, str] = {}
    for c in docs.columns:
        if c.startswith("__"):
            new[c] = free_name([*docs.columns, *new.values()], f"kept{c.rstrip('_')}")
    old = {n: c for c, n in new.items()}
    back = lambda df: df.select(*(F.col(f"`{c}`").alias(old.get(c, c)) for c in df.columns))
    return docs.withColumnsRenamed(new) if new else docs, [new.get(c, c) for c in named], back if new else lambda df: df


def folded(column: Column) -> Column:
    """A-Z lower-cased, other letters as they are."""
    return F.translate(column, UPPER, LOWER)


def text_or_empty(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column], F.lit(""))


class WordHashes(dict):
    """Word bytes to a 64-bit hash, remembering a bounded number of words."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: Iterable[bytes], k: int, words: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of the texts, and offsets[i]:offsets[i + 1] of the i-th text's.

    Words are the runs without space or control white space, A-Z lower-cased. A text with fewer
    than k words has its whole sequence as one shingle; one without words has none.
    """
    hashes, counts = [], []
    for text in texts:
        found = text.translate(FOLD_BYTES).split()
        counts.append(len(found))
        hashes.append(np.fromiter(map(words.__getitem__, found), np.uint64, len(found)))
    n = np.array(counts, np.int64)
    offsets = np.zeros(len(n) + 1, np.int64)
    np.cumsum(np.where(n >= k, n - k + 1, np.minimum(n, 1)), out=offsets[1:])
    flat = np.empty(offsets[-1], np.uint64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    for h, a, b in zip(hashes, offsets[:-1], offsets[1:], strict=True):
        width = min(k, len(h))
        if a == b:
            continue
        out = flat[a:b]
        out[:] = width
        for j in range(width):
            out *= odd
            out += h[j : j + b - a]
    return mixed(flat), offsets
