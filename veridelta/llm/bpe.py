"""Byte-level BPE encoding and decoding as a tree reduction.

A text is halved until its parts are small, each part is encoded, and neighbours are joined up the tree. A join
looks outward from the seam, in windows that double, for the nearest place on each side where a character that is
not white space meets a blank or a line feed. No token spans such a place and no rule of the pre-tokeniser looks
across it, so what lies outside these two places keeps its tokens, and only what lies between is encoded again. The
result equals the encoding of the whole text. Decoding concatenates bytes up the same kind of tree.

Edge cases: a null text has null ids and no token count; the empty text has no ids; repeated rows are encoded each;
special tokens' strings are ordinary text; an empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bound_batches, fresh, with_fields

#: The published pre-tokeniser of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a leaf, and of the first window.
LEAF, WINDOW = 2048, 64
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
_kept: dict[str, "Codec"] = {}


class Codec:
    def __init__(self, path: str, leaf: int = LEAF) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.leaf = leaf
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.whole = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self.leaf:
            return self.whole(text[a:b])
        m = (a + b) // 2
        return self._join(text, self._encode(text, a, m), self._encode(text, m, b), a, m, b)

    def _join(self, text: str, left: list[int], right: list[int], a: int, m: int, b: int) -> list[int]:
        p, q, w = a, b, WINDOW
        while True:  # the last cut before the seam; a cut needs the character before it
            low = max(a, m - w)
            found = [x.end() for x in _CUT.finditer(text, low, m + 1) if low < x.end() < m]
            if found:
                p = found[-1]
            if found or low == a:
                break
            w *= 2
        w = WINDOW
        while True:  # the first cut after the seam
            high = min(b, m + w)
            hit = _CUT.search(text, m + 1, high)
            if hit and m < hit.end() < high and not text[hit.end() - 1].isspace():
                q = hit.end()
                break
            if high == b:
                break
            w *= 2
        i, need = len(left), len(text[p:m].encode())
        while need > 0:
            i -= 1
            need -= len(self.bytes_of[left[i]])
        j, more = 0, len(text[m:q].encode())
        while more > 0:
            more -= len(self.bytes_of[right[j]])
            j += 1
        if need or more:
            raise AssertionError("a cut lies within a token")
        return left[:i] + self.whole(text[p:q]) + right[j:]

    def decode_bytes(self, ids: list[int] | np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join([self.bytes_of[i] for i in ids])
        m = len(ids) // 2
        return self.decode_bytes(ids[:m]) + self.decode_bytes(ids[m:])

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """The codec of a vocabulary file, read once by each worker. The file has to be at this path on every executor."""
    if path not in _kept:
        _kept[path] = Codec(path)
    return _kept[path]


def encode_column(df: DataFrame, path: str, text: str = "text") -> tuple[DataFrame, list[str]]:
    """df with (ids, n_tokens, exact), and their names. exact: decoding gives the text again."""
    bound_batches(df.sparkSession)
    names = fresh(df, "ids", "n_tokens", "exact")
    k, carried = df.columns.index(text), list(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # bounds what a worker holds
                part = batch.slice(at, 256)
                ids, exact = [], []
                for t in part.column(k).to_pylist():
                    got = None if t is None else c.encode(t)
                    ids.append(got)
                    exact.append(None if t is None else c.decode_bytes(got) == t.encode())
                size = np.array([0 if x is None else len(x) for x in ids], np.int64)
                flat = np.concatenate([np.array(x, np.int32) for x in ids if x is not None] or [np.zeros(0, np.int32)])
                off = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), mask=np.append([x is None for x in ids], False))
                null = np.array([x is None for x in ids], bool)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(off, pa.array(flat)), pa.array(size, pa.int64(), mask=null), pa.array(exact, pa.bool_())], [*carried, *names]
                )

    return df.mapInArrow(run, with_fields(df, dict(zip(names, ("array<int>", "long", "boolean"))))), names
