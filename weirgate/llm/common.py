"""What the operators share: scratch tables on shared storage, and vectorised reading of words.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; texts are UTF-8, so those bytes never
fall inside a character.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_PLAIN = np.arange(1, 257, dtype=np.uint64)  # what a byte counts in a word's hash
_LOWER = _PLAIN.copy()
_LOWER[65:91] += np.uint64(32)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CHUNK = 1 << 20  # bytes of texts that are read at once, about


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a folder of our own only where it is unset and all runs on one machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that the whole cluster shares in spark.checkpoint.dir")
        root = tempfile.mkdtemp(prefix="weirgate-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to a table in the shared folder and read it back.

    The table outlives lost executors; the file system removes it when the driver ends."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/weirgate/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    back = spark.read.schema(df.schema).parquet(path)
    back._weirgate_path = path
    return back


def fresh_name(what: str) -> str:
    """A column name that no table of a caller has."""
    return f"{what}_{uuid.uuid4().hex}"


def discard(*tables: DataFrame) -> None:
    """Remove scratch tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._weirgate_path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with a table that has one row a key and in `count` how many of the `total` rows have it.

    Keys with over a thousandth of the rows, a thousand at most, are broadcast; the others are shuffled. So no key is hot."""
    limit = max(1000, total // 1000)
    extra = [c for c in table.columns if c != key]
    hot = table.where(F.col(count) > limit).select(F.col(key).alias("hot_key"), *(F.col(c).alias(f"hot_{c}") for c in extra))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left")
    found = marked.where("hot_key IS NOT NULL").select(*rows.columns, *(F.col(f"hot_{c}").alias(c) for c in extra))
    rest = marked.where("hot_key IS NULL").select(*rows.columns).join(table.where(F.col(count) <= limit), key, how)
    return found.unionByName(rest.select(*rows.columns, *extra))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)


def text_chunks(texts: pa.Array, limit: int = _CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `limit` bytes; one long row is a run of its own. Null is empty."""
    arr = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None and arr.buffers()[2].size else np.empty(0, np.uint8)
    lo = 0
    while lo < len(arr):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, len(arr))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the index of its first word (one more at the end)."""
    inside = _IS_WORD[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


@lru_cache(2)
def _powers_to(base: int, n: int) -> np.ndarray:
    return powers(np.uint64(base), n)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased if asked.

    A running sum of byte times power of its place gives each word's part, which the inverse power of the word's place shifts
    to its beginning."""
    if not len(starts):
        return np.empty(0, np.uint64)
    n = len(data)
    up, down = ((_powers_to if n <= _CHUNK else powers)(base, max(n, _CHUNK)) for base in (_BASE, _INVERSE))
    sums = np.zeros(n + 1, np.uint64)
    np.multiply((_LOWER if lower else _PLAIN)[data], up[:n], out=sums[1:])
    np.cumsum(sums, out=sums)
    value = sums[ends]
    value -= sums[starts]
    value *= down[starts]
    value *= _BASE
    value += (ends - starts).astype(np.uint64)
    return mix(value)


def _multipliers(k: int) -> list[np.uint64]:
    return [np.uint64(x) for x in (mix(np.arange(1, k + 1, dtype=np.uint64) * _BASE) | np.uint64(1)).tolist()]


def rolled_shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The k-word shingles that begin at each word, as hashes, across the borders of rows too."""
    n = max(0, len(words) - k + 1)
    rolled = np.zeros(n, np.uint64)
    for j, m in enumerate(_multipliers(k)):
        rolled += words[j : j + n] * m
    return mix(rolled + np.uint64(k))


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row its k-word shingles as hashes, in order; the whole sequence as one if it has fewer words; none without words."""
    mult, rolled = _multipliers(k), rolled_shingles(words, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(rolled[a : b - k + 1])
        elif b > a:
            short = np.array([b - a], np.uint64)
            for j in range(b - a):
                short += words[a + j : a + j + 1] * mult[j]
            out.append(mix(short))
        else:
            out.append(np.empty(0, np.uint64))
    return out
