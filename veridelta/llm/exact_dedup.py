"""Exact dedup with a cuckoo-filter index of live digests.

A filter holds 16-bit fingerprints of 64-bit digests, four to a bucket, each in one of two buckets; it is looked up, filled and emptied by arrays of
digests at a time. One that overflows is built again, twice as large, from the stored digests, which are kept sorted beside it and are what a lookup's hits
are verified against.

For dedup, each input partition counts its own digests, so a text that a third of all rows hold travels once from each. Partitions by digest then insert
them into a filter; a digest that came more than once, or that the filter seems to know, is a hit. Only rows with such a digest are grouped
by their whole text, so two texts whose digests collide stay apart, and so does what the filter takes for known wrongly.

The index can be kept as a table, a row for each part of the digests: build_index, insert and delete give a new one, contains looks rows up.

Edge cases: a null text is no content, its row stays, and no index knows it; the empty text is content like any other, as is a very long one; repeated
rows are copies of each other; among equal texts the lowest doc_id stays (null last; of repeated rows with this id any one); other columns are
carried along whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, keyed, mix, table

#: Places of a bucket, rounds of displacement before a filter grows, and digests of a part of an index.
SLOTS, ROUNDS, PART = 4, 60, 1 << 22


class CuckooFilter:
    """Fingerprints of a set of digests (uint64), by buckets; 0 is an empty place."""

    def __init__(self, digests: np.ndarray | None = None, bits: int = 8, prints: np.ndarray | None = None) -> None:
        self.digests = np.zeros(0, np.uint64)
        self._new: list[np.ndarray] = []
        self.bits = bits
        self.prints = np.zeros((1 << bits, SLOTS), np.uint16)
        if prints is not None:
            self.prints, self.digests = prints.reshape(-1, SLOTS).copy(), digests
        elif digests is not None:
            self.insert(digests)

    def _at(self, d: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(d)
        return np.maximum(h >> np.uint64(48), 1).astype(np.uint16), (h & np.uint64((1 << bits) - 1)).astype(np.int64)

    def _other(self, i: np.ndarray, mark: np.ndarray, bits: int) -> np.ndarray:
        return i ^ (mix(mark.astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)

    def seems(self, d: np.ndarray) -> np.ndarray:
        """Which digests the filter may hold: all that it does, and about one in 8,000 of the others."""
        mark, i = self._at(d, self.bits)
        j = self._other(i, mark, self.bits)
        return ((self.prints[i] == mark[:, None]) | (self.prints[j] == mark[:, None])).any(1)

    def stored(self) -> np.ndarray:
        """The digests, sorted."""
        if self._new:
            self.digests = np.union1d(self.digests, np.concatenate(self._new))
            self._new = []
        return self.digests

    def contains(self, d: np.ndarray) -> np.ndarray:
        """Which digests are live: the filter's hits, verified against the stored ones."""
        out = self.seems(d)
        hits, all_ = d[out], self.stored()
        at = np.minimum(np.searchsorted(all_, hits), max(0, len(all_) - 1))
        out[out] = all_[at] == hits if len(all_) else False
        return out

    def _place(self, mark: np.ndarray, i: np.ndarray) -> bool:
        """Puts fingerprints into their buckets, displacing others for so many rounds; False if some are left."""
        turn = np.random.default_rng(7)
        for _ in range(ROUNDS):
            for side in (0, 1):
                home = self._other(i, mark, self.bits) if side else i
                order = np.argsort(home, kind="stable")  # one newcomer after another in a bucket's free places
                b = home[order]
                rank = np.arange(len(b)) - np.searchsorted(b, b)
                free = self.prints[b] == 0
                ok = rank < free.sum(1)
                slot = (np.cumsum(free[ok], 1) == (rank[ok] + 1)[:, None]).argmax(1)
                self.prints[b[ok], slot] = mark[order[ok]]
                left = order[~ok]
                keep = np.zeros(len(mark), bool)
                keep[left] = True
                mark, i = mark[keep], i[keep]
                if not len(mark):
                    return True
            # Each bucket takes one of those that found no place, and gives one of its own, which goes to its other bucket.
            i = np.where(turn.random(len(i)) < 0.5, i, self._other(i, mark, self.bits))
            b, first = np.unique(i, return_index=True)
            slot = turn.integers(0, SLOTS, len(b))
            gone = self.prints[b, slot]
            self.prints[b, slot] = mark[first]
            mark, i = mark.copy(), i.copy()
            mark[first], i[first] = gone, self._other(b, gone, self.bits)
        return False

    def insert(self, d: np.ndarray) -> np.ndarray:
        """Which of some different digests were not there; these are."""
        new = ~self.contains(d)
        self.add(d[new])
        return new

    def add(self, d: np.ndarray) -> None:
        """Inserts digests that are known not to be there."""
        self._new.append(d)
        bits = self.bits
        n = len(self.digests) + sum(map(len, self._new))
        while n > 0.9 * (SLOTS << bits):
            bits += 1
        if bits == self.bits and self._place(*self._at(d, bits)):
            return
        every = self.stored()  # the overflowing filter is built again from the stored digests
        while True:
            self.bits, self.prints = bits, np.zeros((1 << bits, SLOTS), np.uint16)
            if self._place(*self._at(every, bits)):
                return
            bits += 1

    def delete(self, d: np.ndarray) -> np.ndarray:
        """Which of some different digests were there; these are no longer."""
        live = self.contains(d)
        mark, i = self._at(d[live], self.bits)
        for side in (0, 1):  # equal fingerprints of one bucket stand for as many digests
            home = self._other(i, mark, self.bits) if side else i
            order = np.lexsort((mark, home))
            b, m = home[order], mark[order]
            lead = np.append(True, (b[1:] != b[:-1]) | (m[1:] != m[:-1])) if len(b) else np.zeros(0, bool)
            rank = np.arange(len(b)) - np.flatnonzero(lead)[np.cumsum(lead) - 1]
            same = self.prints[b] == m[:, None]
            ok = rank < same.sum(1)
            slot = (np.cumsum(same[ok], 1) == (rank[ok] + 1)[:, None]).argmax(1)
            self.prints[b[ok], slot] = 0
            keep = np.zeros(len(mark), bool)
            keep[order[~ok]] = True
            mark, i = mark[keep], i[keep]
            if not len(mark):
                break
        self.digests = np.setdiff1d(self.stored(), d[live], assume_unique=True)
        return live

    def __len__(self) -> int:
        return len(self.stored())


# The index as a table


_INDEX = "part long, parts long, bits int, prints binary, digests binary"


def _digests(df: DataFrame, text: str) -> DataFrame:
    """Different digests of the texts, first within each input partition."""
    return df.where(F.col(text).isNotNull()).select(F.xxhash64(F.col(text)).alias("digest")).distinct()


def _open(row: dict) -> CuckooFilter:
    return CuckooFilter(np.frombuffer(row["digests"], np.uint64), row["bits"], np.frombuffer(row["prints"], np.uint16))


def _close(part: int, parts: int, f: CuckooFilter) -> pa.Table:
    return pa.table({"part": pa.array([part], pa.int64()), "parts": pa.array([parts], pa.int64()), "bits": pa.array([f.bits], pa.int32()), "prints": pa.array([f.prints.tobytes()], pa.binary()), "digests": pa.array([f.stored().tobytes()], pa.binary())})


def _changed(index: DataFrame | None, df: DataFrame, text: str, parts: int, change: str) -> DataFrame:
    d = _digests(df, text).select(F.pmod("digest", F.lit(parts)).alias("part"), "digest")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        f = _open(left.to_pylist()[0]) if len(left) else CuckooFilter()
        if len(right):
            getattr(f, change)(right["digest"].to_numpy().view(np.uint64))
        return _close(key[0].as_py(), parts, f)

    have = df.sparkSession.createDataFrame([], _INDEX) if index is None else index
    return table(have.groupBy("part").cogroup(d.groupBy("part")).applyInArrow(run, _INDEX), "cuckoo-index")


def build_index(df: DataFrame, text: str = "text", parts: int | None = None) -> DataFrame:
    """An index of the texts' digests, a row for each of its parts (by default as many as hold PART digests each)."""
    return _changed(None, df, text, parts or max(1, -(-_digests(df, text).count() // PART)), "insert")


def _parts(index: DataFrame) -> int:
    row = index.select("parts").first()
    return row[0] if row else 1


def insert(index: DataFrame, df: DataFrame, text: str = "text") -> DataFrame:
    """The index with df's texts as well."""
    return _changed(index, df, text, _parts(index), "insert")


def delete(index: DataFrame, df: DataFrame, text: str = "text") -> DataFrame:
    """The index without df's texts."""
    return _changed(index, df, text, _parts(index), "delete")


def contains(index: DataFrame, df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """df with a column that says whether the index holds the row's text, and its name."""
    digest, known = fresh(df, "digest", "known")
    parts = _parts(index)
    d = _digests(df, text).select(F.pmod("digest", F.lit(parts)).alias("part"), "digest")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({digest: pa.array([], pa.int64())})
        x = right["digest"].to_numpy()
        return pa.table({digest: pa.array(x[_open(left.to_pylist()[0]).contains(x.view(np.uint64))])})

    live = keyed(table(index.groupBy("part").cogroup(d.groupBy("part")).applyInArrow(run, f"{digest} long"), "cuckoo-hits").withColumn(known, F.lit(True)))
    own = [F.col(f"`{c}`") for c in df.columns]
    return df.withColumn(digest, F.xxhash64(F.col(text))).join(live, digest, "left").select(*own, (F.coalesce(F.col(known), F.lit(False)) & F.col(text).isNotNull()).alias(known)), known


# Dedup


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, several): each batch's digests once."""
    for batch in batches:
        d, n = np.unique(batch.column(0).to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(n > 1)], ["digest", "several"])


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests that came before, as far as the filter knows, or several times; some of them more than once."""
    seen = CuckooFilter()
    for batch in batches:
        d, several = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        one, at, n = np.unique(d, return_index=True, return_counts=True)
        twice = n > 1
        np.logical_or.at(twice, np.searchsorted(one, d[several]), True)
        known = seen.seems(one.view(np.uint64))
        seen.add(one[~known].view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(one[twice | known])], ["digest"])


def repeated_digests(df: DataFrame, text: str = "text") -> DataFrame:
    """The 64-bit digests that occur in more than one row, and some few others, as a table in the shared folder."""
    d = df.where(F.col(text).isNotNull()).select(F.xxhash64(F.col(text)).alias("digest"))
    return table(d.mapInArrow(_tally, "digest long, several boolean").repartition("digest").mapInArrow(_hits, "digest long").distinct(), "digests")


def copied_texts(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, list[str]]:
    """(df with two digests of the text, null for a null text; a row for each text of several rows with its digests, the lowest id and the number of rows; the names
    of these four columns). Texts are grouped whole; their rows are told by both digests, 128 bits."""
    names = fresh(df, "digest", "second", "keeper", "copies")
    digest, second, keeper, copies = names
    some = F.col(text).isNotNull()
    tagged = df.withColumns({digest: F.when(some, F.xxhash64(F.col(text))), second: F.when(some, F.xxhash64(F.lit(0x5851F42D), F.col(text)))})
    many = tagged.join(keyed(repeated_digests(df, text).withColumnRenamed("digest", digest)), digest, "left_semi")
    (whole,) = fresh(tagged, "whole")
    groups = many.groupBy(digest, second, F.col(text).alias(whole)).agg(F.min(id_col).alias(keeper), F.count(F.lit(1)).alias(copies)).where(F.col(copies) > 1)
    return tagged, table(groups.drop(whole), "copied-texts"), names


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """df without the copies: of equal texts one row with the lowest id stays."""
    tagged, groups, (digest, second, keeper, copies) = copied_texts(df, id_col, text)
    own = [F.col(f"`{c}`") for c in df.columns]
    lone = tagged.join(keyed(groups.select(digest, second)), [digest, second], "left_anti").select(*own)
    first = tagged.join(keyed(groups), [digest, second]).where(F.col(id_col).eqNullSafe(F.col(keeper))).dropDuplicates([digest, second])
    return lone.unionByName(first.select(*own))


def copies(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, copy_of): each row that goes, and the lowest id that holds its text. A repeated row is a copy of its own id."""
    tagged, groups, (digest, second, keeper, _) = copied_texts(df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")))
    rows = tagged.join(keyed(groups), [digest, second]).select("doc_id", keeper, digest, second)
    own = F.col("doc_id").eqNullSafe(F.col(keeper))
    again = rows.where(own).groupBy(digest, second, keeper).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.explode(F.sequence(F.lit(2), F.col("n"))), F.col(keeper))
    return rows.where(~own).select("doc_id", F.col(keeper).alias("copy_of")).unionByName(again.select(F.col(keeper).alias("doc_id"), F.col(keeper).alias("copy_of")))
