"""Token ids as binary shards with a minimal perfect hash index.

Documents go to shards by a hash of their key. A shard is one row: the raw ids of its documents, end to end, and an index of
a displacement per bucket of keys, which sends every key to a slot of its own among as many slots as there are keys. A slot
stores the key's fingerprint, where its entries begin, and how many there are; so a look-up is two hashes and one
comparison whatever the shard holds, and a key that is not there is refused but for one in 2**32.

A key with more bytes or rows than a shard should have is spread over as many shards as it needs, the one where it belongs and those after it; its slot says how many.

Edge cases: rows of one key are entries one after another under that key, in the order of their ids, shard after shard; rows without a key are
spread over all shards, stored after the others, and no key reaches them; null and empty texts are entries without ids; a very long text is one entry; an empty table
gives no shard; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import codec
from .common import bound_batches, keyed, mix, table

#: Bytes of text that a shard gets about, rows of one key that it takes at most about, and keys of an index bucket.
SHARD_BYTES, KEY_ROWS, LAMBDA = 8 << 20, 1 << 18, 4
_S1, _S2, _S3 = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344), np.uint64(0xA4093822299F31D0)


def _slots(h: np.ndarray, d: np.ndarray | int, n: int) -> np.ndarray:
    return (mix(h + np.asarray(d).astype(np.uint64) * _S2) % np.uint64(max(1, n))).astype(np.int64)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(displacements, slot of each key, fingerprints by slot) for different int64 keys. A displacement d < 0 is slot -d - 1 itself, for a bucket of one key."""
    n = len(keys)
    h = mix(keys.view(np.uint64) ^ _S1)
    buckets = max(1, (n + LAMBDA - 1) // LAMBDA)
    of = (h >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(of, kind="stable")
    begin = np.searchsorted(of[order], np.arange(buckets + 1).astype(np.uint64))
    size = np.diff(begin)
    shift, slot, free = np.zeros(buckets, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    for b in np.argsort(-size, kind="stable"):
        mine = order[begin[b] : begin[b + 1]]
        if len(mine) < 2:
            break
        d = 0
        while True:
            tried = np.arange(d, d + 32)
            at = _slots(h[mine][None, :], tried[:, None], n)
            ok = free[at].all(1)
            for k in np.flatnonzero(ok):
                if len(set(at[k].tolist())) == len(mine):
                    break
            else:
                d += 32
                continue
            shift[b], slot[mine], free[at[k]] = tried[k], at[k], False
            break
    spare = iter(np.flatnonzero(free))
    for b in np.flatnonzero(size == 1):
        i = order[begin[b]]
        slot[i] = next(spare)
        shift[b] = -slot[i] - 1
    marks = np.zeros(n, np.uint32)
    marks[slot] = (mix(h ^ _S3) >> np.uint64(32)).astype(np.uint32)
    return shift.astype(np.int32), slot, marks


def _slot(key: int, row: dict) -> int | None:
    """The slot of a key in a shard's index, None where its fingerprint is another."""
    shift, marks = np.frombuffer(row["displacements"], np.int32), np.frombuffer(row["fingerprints"], np.uint32)
    if not len(marks):
        return None
    h = mix(np.array([key], np.int64).view(np.uint64) ^ _S1)
    d = int(shift[int((h[0] >> np.uint64(20)) % np.uint64(len(shift)))])
    s = -d - 1 if d < 0 else int(_slots(h, d, len(marks))[0])
    return s if marks[s] == np.uint32(mix(h ^ _S3)[0] >> np.uint64(32)) else None


def slices(key: int, row: dict) -> tuple[list[tuple[int, int]], int]:
    """([(first byte, bytes)] of the key's entries in a shard's payload, over how many shards the key is spread); a row without its payload will do."""
    s = _slot(key, row)
    if s is None:
        return [], 1
    first, many = int(np.frombuffer(row["entries"], np.int32)[s]), int(np.frombuffer(row["counts"], np.int32)[s])
    off = np.frombuffer(row["offsets"], np.int64) * np.dtype(row["dtype"]).itemsize
    return [(int(off[e]), int(off[e + 1] - off[e])) for e in range(first, first + many)], int(np.frombuffer(row["spread"], np.int32)[s])


def find(key: int, row: dict) -> list[np.ndarray]:
    """The ids of each entry of a key in a shard's row; empty where the shard has no such key."""
    return [np.frombuffer(row["payload"][a : a + n], np.dtype(row["dtype"])) for a, n in slices(key, row)[0]]


_INDEX = "displacements binary, fingerprints binary, entries binary, counts binary, spread binary"


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(shard, shards, n_docs, n_tokens, dtype, payload, offsets, displacements, fingerprints, entries, counts, spread), a row for each shard that has documents; shards: how many there are, with empty ones."""
    bound_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("key"), F.col(text).alias("text"))
    by_key = table(rows.groupBy("key").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("c")), "binary-keys")
    shards = max(1, round((by_key.agg(F.sum("bytes")).first()[0] or 0) / SHARD_BYTES))
    spread = F.least(F.lit(shards), F.ceil(F.greatest(F.col("bytes") / SHARD_BYTES, F.col("c") / KEY_ROWS))).cast("int")
    hot = keyed(table(by_key.where("key IS NOT NULL").select("key", spread.alias("spread")).where("spread > 1"), "binary-hot"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        kind = np.uint16 if len(c.bytes_of) <= 1 << 16 else np.uint32
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                blobs = [np.array(c.whole(t), kind).tobytes() if t else b"" for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(blobs, pa.binary())], ["shard", "key", "spread", "ids"])

    def build(key: tuple, t: pa.Table) -> pa.Table:
        kind = np.uint16 if len(codec(path).bytes_of) <= 1 << 16 else np.uint32
        t = t.sort_by([("key", "ascending"), ("ids", "ascending")])  # nulls are last
        blobs = t["ids"].to_pylist()
        off = np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64) // np.dtype(kind).itemsize
        keys = t["key"].drop_null().to_numpy().astype(np.int64)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        shift, slot, marks = build_index(keys[first])
        entries, counts, wide = (np.zeros(len(first), np.int32) for _ in range(3))
        entries[slot], counts[slot], wide[slot] = first, np.diff(np.append(first, len(keys))), t["spread"].to_numpy()[first]
        one = {"shard": key[0].as_py(), "shards": shards, "n_docs": len(blobs), "n_tokens": int(off[-1]), "dtype": np.dtype(kind).name, "payload": b"".join(blobs), "offsets": off.tobytes(), "displacements": shift.tobytes(), "fingerprints": marks.tobytes(), "entries": entries.tobytes(), "counts": counts.tobytes(), "spread": wide.tobytes()}
        return pa.table({k: pa.array([v], pa.int64() if isinstance(v, int) else pa.string() if isinstance(v, str) else pa.binary()) for k, v in one.items()})

    row = F.monotonically_increasing_id()
    wide = F.coalesce(F.col("spread"), F.lit(1))
    home = F.when(F.col("key").isNull(), F.xxhash64(row)).otherwise(F.xxhash64(F.lit(1), "key") + F.when(wide > 1, F.pmod(F.xxhash64(row), wide)).otherwise(0))
    ids = rows.join(hot, "key", "left").select(_home(home, shards).alias("shard"), "key", wide.alias("spread"), "text").mapInArrow(encode, "shard long, key long, spread int, ids binary")
    return ids.groupBy("shard").applyInArrow(build, f"shard long, shards long, n_docs long, n_tokens long, dtype string, payload binary, offsets binary, {_INDEX}")


def _home(h: Column, shards: int) -> Column:
    return F.pmod(h, F.lit(shards).cast("long"))


def look_up(shards: DataFrame, keys: list[int]) -> dict[int, list[np.ndarray]]:
    """The entries of some keys. The indexes of the shards that can hold them come to the driver, then only the slices of payload that these name."""
    spark = shards.sparkSession
    keys = sorted(set(keys))
    size = shards.select("shards").first()
    if size is None or not keys:
        return {k: [] for k in keys}
    n = size[0]
    where = {r.key: r.shard for r in spark.createDataFrame([(k,) for k in keys], "key long").select("key", _home(F.xxhash64(F.lit(1), "key"), n).alias("shard")).collect()}
    light = ["shard", "dtype", "offsets", *[x.split()[0] for x in _INDEX.split(", ")]]
    indexes: dict[int, dict] = {}

    def fetch(wanted: set[int]) -> None:
        for r in shards.select(*light).where(F.col("shard").isin(sorted(wanted - set(indexes)))).collect():
            indexes[r.shard] = r.asDict()

    fetch(set(where.values()))
    homes = {k: [(s + j) % n for j in range(slices(k, indexes[s])[1] if s in indexes else 1)] for k, s in where.items()}
    if more := {s for v in homes.values() for s in v} - set(indexes):
        fetch(more)
    want = [(s, k, i, j, a, m) for k, v in homes.items() for i, s in enumerate(v) if s in indexes for j, (a, m) in enumerate(slices(k, indexes[s])[0])]
    out: dict[int, list[np.ndarray]] = {k: [] for k in keys}
    if want:
        cut = spark.createDataFrame(want, "shard long, key long, i int, j int, a long, m long").join(shards.select("shard", "dtype", "payload"), "shard")
        for r in cut.select("key", "i", "j", "dtype", F.expr("substring(payload, cast(a + 1 as int), cast(m as int))").alias("ids")).orderBy("key", "i", "j").collect():
            out[r.key].append(np.frombuffer(bytes(r.ids), np.dtype(r.dtype)))
    return out
