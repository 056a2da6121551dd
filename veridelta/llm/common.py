"""Shared pieces: vectorised tokenising and hashing, Arrow mapping, durable cuts."""

from __future__ import annotations

import atexit
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

#: Text bytes that one vectorised step takes at a time; it bounds a Python worker's memory.
STEP_BYTES = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


_BYTES = _byte_values()
#: The six ASCII white-space bytes; words are the runs between them.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SPACE_RE = r"[ \t\n\x0B\f\r]+"
#: Letters, digits, apostrophes and every byte beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): equal in, equal out, and every bit depends on all others."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_POW: dict[int, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64, for i < n, grown by doubling and kept."""
    size = 1 << max(12, int(n).bit_length())
    if size not in _POW:
        inverse = np.uint64(pow(int(_ODD), -1, 2**64))
        tables = []
        for base in (_ODD, inverse):
            t = np.ones(size, np.uint64)
            t[1:] = base
            np.multiply.accumulate(t, out=t)
            tables.append(t)
        _POW.clear()
        _POW[size] = tuple(tables)
    return _POW[size]


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def word_hashes(raw: np.ndarray, off: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each document's first word and the end).

    keep: of the 256 bytes, those that belong to words (by default all but white space)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    power, inverse = _powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTES[raw] * power[:n], out=total[1:])
    inside = keep[raw] if keep is not None else ~SPACE[raw]
    first = np.zeros(n + 1, bool)
    first[off[:-1][off[:-1] < n]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    h = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
    return h, np.searchsorted(s, off)


def gram_hashes(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each n-gram of words, document of each). A document of fewer than n words, but at least one, has one gram of them all."""
    count = np.diff(at)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(count)), grams)
    start = at[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(grams) - grams, grams)
    size = np.minimum(n, count)[doc]
    h = size.astype(np.uint64) * _ODD
    for i in range(n):
        ok = i < size
        if ok.all():
            h = mix(h * np.uint64(31) + words[start + i])
        else:
            h[ok] = mix(h[ok] * np.uint64(31) + words[start[ok] + i])
    return h, doc


def steps(off: np.ndarray, most: int = STEP_BYTES):
    """(first, last + 1) of runs of documents of at most so many bytes, or one longer document."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Without it there is an error, as executors could not read what others wrote."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isEmpty():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = have.get()
    return at.rstrip("/")


_written: "weakref.WeakKeyDictionary[SparkSession, list[str]]" = weakref.WeakKeyDictionary()


def table(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder, and read from there: its lineage ends, and lost executors cost nothing. The files go when the
    session's process ends, or by remove_tables."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_tables(spark: SparkSession) -> None:
    """Deletes the tables that were written so far; results that were not yet stored can't be read afterwards."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written.pop(spark, []):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(hadoop).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark in list(_written):
        if spark.sparkContext._jsc is not None:
            remove_tables(spark)


#: Bytes that go to a Python worker at a time.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Batches of texts are bounded by bytes, for rows can be of any length, unless the session sets a bound of its own. As plans run later, the setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).lower().rstrip("b") == str(64 << 20):  # Spark's own default
        spark.conf.set(key, str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that df has no column of, whatever its own are called."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        x = f"_{n}"
        while x.lower() in have:
            x = f"_{x}"
        out.append(x)
    return out


def with_fields(df: DataFrame, kinds: dict[str, str]) -> StructType:
    """df's schema and some more columns."""
    return StructType([*df.schema.fields, *[StructField(n, StructType.fromDDL(f"x {k}")[0].dataType) for n, k in kinds.items()]])


#: Keys of 8 bytes that a join may broadcast.
BROADCAST_KEYS = 1 << 21


def keyed(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """A written table of keys, ready to join with texts: broadcast where it has at most so many rows, else both sides are shuffled."""
    from pyspark.sql import functions as F

    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys.hint("shuffle_hash")
