"""N-gram Jaccard join by a token-group matrix.

Words are lower-cased runs of letters, digits and apostrophes; a document is the set of its word n-grams, called tokens. Documents
of equal sets are one set with a count. The steps, all of them exact:

1. Every token is counted over the corpus. Tokens travel as sorted, delta-coded blocks, one for each batch of texts and each range of
   token hashes; a token that is frequent in a batch travels once, so a token that every document holds is no hot spot. Only tokens of
   two sets or more come back. A set that has fewer of these than its least overlap (threshold times its size) has no partner and is left out.
2. The other sets are partitioned into groups of similar ones, by the least of two hashes of their shared tokens and by a class of their size (one
   hash would bring together all that hold one frequent token, and such groups grow with the corpus); a large group is cut into blocks.
3. The matrix has a row for each token and group: of each group the union of its members' prefixes, that is, of their rarest tokens, as many as
   a similar set can't miss all of (the prefix principle, with one order of tokens for all); a shorter part of it is enough where the partner is not smaller.
   Two groups are compared only where a short prefix of the one has a token of a prefix of the other, whose sizes are as large or larger but not too large.
4. A query's overlap with the union of a group's whole sets bounds what it can have in common with any member. The group is opened only
   to queries whose bound reaches the threshold; in an open group overlaps are counted exactly, by products of token matrices.

Where only classes are asked for (dedup_near), sets are first compared with a few leaders of those that have the same least hash. What is connected by that forms
groups of its own in steps 2 to 4, and is not compared among itself again, so a class of near copies costs no square of its size; no other pair is left out.

Tokens are compared by 48 bits of their hashes. Nothing is capped: a hot passage makes frequent tokens, which come last in every prefix; a
large group makes more blocks. What grows faster than the input is the number of links themselves, which are counted, not listed.

Edge cases: null texts and texts without words have no tokens and no row; a text of fewer than n words has one n-gram of them all; a very long
text is a batch of its own; repeated rows (equal id and set) are one row; a null id is an id like any other in counts, and comes last for
the class id; equal sets are partners with Jaccard 1; a similarity equal to the threshold counts; other columns are not looked at, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bound_batches, fresh, gram_hashes, keyed, mix, steps, table, text_buffers, word_hashes

N, THRESHOLD = 3, 0.5
#: Text bytes of a batch, tokens of a range of hashes, sets of a block of a group, and sets that a task compares.
BATCH, RANGE, BLOCK, HELD = 8 << 20, 1 << 20, 1024, 4096
#: Bits of a hash that are dropped; documents of a batch at most, and what stands for several of them.
DROP, MOST_DOCS, SEVERAL = 16, 1 << 15, 0xFFFF
#: Sets at most that the others of a bucket are compared with before groups are made.
LEADERS = 8
#: Low bits of a group's id, for the class of its sets' sizes.
CLASS = 0xFF
#: So many sets are looked up in an inverted group; more are multiplied.
FEW = 64
_TILE = 2048
_SECOND = np.uint64(0x5DEECE66D)


def gram_sets(raw: np.ndarray, off: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(document, its sorted different n-grams) for those that have words."""
    for i, j in steps(off):
        w, at = word_hashes(raw[off[i] : off[j]], off[i : j + 1] - off[i], WORD)
        g, d = gram_hashes(w, at, n)
        cut = np.searchsorted(d, np.arange(j - i + 1))
        for k in range(j - i):
            if cut[k + 1] > cut[k]:
                yield i + k, np.unique(g[cut[k] : cut[k + 1]])


def set_key(g: np.ndarray) -> bytes:
    return np.array([mix(g).sum(), mix(g ^ _SECOND).sum()], np.uint64).tobytes()


def pack(x: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte plane by byte plane (planes of zeros are left out)."""
    if not len(x):
        return b""
    d = np.diff(x.astype(np.uint64), prepend=np.uint64(0))
    planes = d.astype("<u8").view(np.uint8).reshape(-1, 8).T
    some = planes.any(1)
    return bytes([int(np.packbits(some, bitorder="little")[0])]) + planes[some].tobytes()


def unpack(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.uint64)
    some = np.unpackbits(np.frombuffer(b[:1], np.uint8), bitorder="little").astype(bool)
    n = (len(b) - 1) // max(1, int(some.sum()))
    planes = np.zeros((8, n), np.uint8)
    planes[some] = np.frombuffer(b, np.uint8, offset=1).reshape(-1, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().cumsum(dtype=np.uint64)


def squeeze(b: bytes) -> bytes:
    return len(b).to_bytes(8, "little") + pa.compress(b, "zstd", asbytes=True)


def expand(b: bytes) -> bytes:
    return pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True)


def least_shared(n: np.ndarray, threshold: float) -> np.ndarray:
    """How many tokens a set of n has to share with one partner at least."""
    return np.ceil(np.asarray(n) * threshold - 1e-9).astype(np.int64)


def least_upward(n: np.ndarray, threshold: float) -> np.ndarray:
    """The same where the partner is as large or larger."""
    return least_shared(n, 2 * threshold / (1 + threshold))


def size_class(n: np.ndarray) -> np.ndarray:
    """Four classes for each doubling of the size; they fit into CLASS."""
    return np.floor(4 * np.log2(n) + 1e-9).astype(np.int64)


def classes_up(threshold: float) -> int:
    """By how many classes the larger of two similar sets can be higher."""
    return int(np.ceil(4 * np.log2(1 / threshold) - 1e-9))



_RAW = "part long, batch long, a binary, b binary, c binary, d binary"
_BACK = "batch long, a binary, b binary, c binary, d binary"
_SETS = "rid long, doc_id long, d1 long, d2 long, key binary, n int, grp long, m1 long, m2 long, toks binary, prefix binary, short binary"


def _range_of(token: np.ndarray, ranges: int) -> np.ndarray:
    return ((token >> np.uint64(16)) * np.uint64(ranges)) >> np.uint64(32)


def _rows(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _send(n: int, ranges: int):
    """Blocks of tokens for the ranges of hashes, and what a batch keeps for itself."""
    names, kinds = ["part", "batch", "a", "b", "c", "d"], [pa.int64(), pa.int64(), *[pa.binary()] * 4]

    def close(batch: int, docs: list[tuple], sets: list[np.ndarray]) -> pa.RecordBatch:
        token = np.concatenate(sets) >> np.uint64(DROP)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets]).astype(np.uint16)
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        lead = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        many = np.diff(np.append(lead, len(token)))
        one = token[lead]
        who = np.where(many == 1, owner[lead], np.uint16(SEVERAL)).astype("<u2")
        multi = many > 1
        inside = np.repeat(multi, many)
        info = _rows(["doc_id", "d1", "d2", "key", "n", "set"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32()], docs)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, info.schema) as w:
            w.write_batch(info)
        rows = [(ranges + batch, batch, pack(one[multi]), owner[inside].astype("<u2").tobytes(), many[multi].astype("<u4").tobytes(), sink.getvalue().to_pybytes())]
        part = _range_of(one, ranges)
        for a, b in zip(*_runs(part)):
            c = many[a:b]
            rows.append((int(part[a]), batch, squeeze(pack(one[a:b])), squeeze(who[a:b].view(np.uint8).reshape(-1, 2).T.tobytes()), c[c > 1].astype("<u4").tobytes(), None))
        return _rows(names, kinds, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        batch = (task.partitionId() if task else 0) << 24
        docs, sets, known, size = [], [], {}, 0
        for rb in batches:
            raw, off = text_buffers(rb.column(3))
            for i, g in gram_sets(raw, off, n):
                key = set_key(g)
                at = known.setdefault(key, len(sets))
                if at == len(sets):
                    sets.append(g)
                docs.append((*[rb.column(c)[i].as_py() for c in range(3)], key, len(g), at))
                size += int(off[i + 1] - off[i])
                if size >= BATCH or len(docs) >= MOST_DOCS:
                    yield close(batch, docs, sets)
                    batch += 1
                    docs, sets, known, size = [], [], {}, 0
        if docs:
            yield close(batch, docs, sets)

    return run


def _runs(x: np.ndarray) -> tuple[list[int], list[int]]:
    cut = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return cut.tolist(), np.append(cut[1:], len(x)).tolist() if len(x) else []


def _count(ranges: int):
    """Of each block the tokens that two sets hold, with a class of their frequency. What a batch keeps passes through."""
    names, kinds = ["batch", "a", "b", "c", "d"], [pa.int64(), *[pa.binary()] * 4]

    def run(key: tuple, t: pa.Table) -> pa.Table:
        if key[0].as_py() >= ranges:
            return t.select(names).cast(pa.schema(list(zip(names, kinds))))
        batch, a, b, c = (t[x].to_pylist() for x in ("batch", "a", "b", "c"))
        tokens, who, counts = [], [], []
        for x, y, z in zip(a, b, c):
            tokens.append(unpack(expand(x)))
            w = np.ascontiguousarray(np.frombuffer(expand(y), np.uint8).reshape(2, -1).T).view("<u2").ravel()
            m = np.ones(len(w), np.int64)
            m[w == SEVERAL] = np.frombuffer(z, "<u4")
            who.append(w)
            counts.append(m)
        cut = np.concatenate([[0], np.cumsum([len(x) for x in tokens])])
        token, many = np.concatenate(tokens), np.concatenate(counts)
        order = np.argsort(token, kind="stable")
        lead = np.append(True, token[order][1:] != token[order][:-1])
        group = np.cumsum(lead) - 1
        total = np.bincount(group, weights=many[order])
        df = np.empty(len(token))
        df[order] = total[group]
        level = np.minimum(255, np.log2(df) * 4).astype(np.uint8)
        rows = []
        for i in range(len(batch)):
            mine = slice(cut[i], cut[i + 1])
            keep = df[mine] >= 2
            if keep.any():
                rows.append((batch[i], squeeze(pack(token[mine][keep])), squeeze(who[i][keep].view(np.uint8).reshape(-1, 2).T.tobytes()), squeeze(level[mine][keep].tobytes()), None))
        return pa.Table.from_batches([_rows(names, kinds, rows)])

    return run


def _gather(threshold: float):
    """The documents of a batch; with its shared tokens, their prefix and the group, each set that can have a partner."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        info, kept = None, None
        tokens, who, level = [], [], []
        for a, b, c, d in zip(*(t[x].to_pylist() for x in "abcd")):
            if d is not None:
                info, kept = pa.ipc.open_stream(d).read_all(), (unpack(a), np.frombuffer(b, "<u2"), np.frombuffer(c, "<u4"))
            else:
                tokens.append(unpack(expand(a)))
                who.append(np.ascontiguousarray(np.frombuffer(expand(b), np.uint8).reshape(2, -1).T).view("<u2").ravel())
                level.append(np.frombuffer(expand(c), np.uint8))
        tok = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        own = np.concatenate(who) if who else np.zeros(0, np.uint16)
        lev = np.concatenate(level) if level else np.zeros(0, np.uint8)
        several = own == SEVERAL
        at = np.argsort(tok[several], kind="stable")  # every token that is frequent in the batch came back, so these are kept[0]
        tok = np.concatenate([tok[~several], np.repeat(kept[0], kept[2])])
        lev = np.concatenate([lev[~several], np.repeat(lev[several][at], kept[2])])
        own = np.concatenate([own[~several], kept[1]]).astype(np.int64)
        n = np.zeros(int(info["set"].to_numpy().max()) + 1, np.int64)
        n[info["set"].to_numpy()] = info["n"].to_numpy()
        shared = np.bincount(own, minlength=len(n))
        least = least_shared(n, threshold)
        open_ = (shared >= least)[own]
        tok, own, lev = tok[open_], own[open_], lev[open_]
        order = np.lexsort((tok, lev, own))
        tok, own = tok[order], own[order]
        first = np.searchsorted(own, np.arange(len(n) + 1))
        rest = (n - shared)[own]  # tokens of this set alone come first in its order
        place = np.arange(len(own)) - first[own] + rest
        hashed, again, kind = mix(tok), mix(tok ^ _SECOND), size_class(n)
        inside, upward = place < (n - least + 1)[own], place < (n - least_upward(n, threshold) + 1)[own]
        groups, m1, m2, toks, prefix, short = ([None] * len(n) for _ in range(6))
        for k in np.flatnonzero(np.diff(first)).tolist():
            x = slice(first[k], first[k + 1])
            o = np.argsort(tok[x])
            one, two = hashed[x].min(keepdims=True), again[x].min(keepdims=True)
            groups[k] = int(mix(one + mix(two)).view(np.int64)[0]) & ~CLASS | int(kind[k])
            m1[k], m2[k] = int(one.view(np.int64)[0]), int(two.view(np.int64)[0])
            toks[k], prefix[k], short[k] = pack(tok[x][o]), np.packbits(inside[x][o]).tobytes(), np.packbits(upward[x][o]).tobytes()
        lead = set()
        pick = []
        for s in info["set"].to_pylist():
            pick.append(-1 if s in lead else s)
            lead.add(s)
        rid = (key[0].as_py() << 16) + np.arange(len(info))
        at = lambda v, kind: pa.array([None if s < 0 else v[s] for s in pick], kind)
        return pa.table({"rid": pa.array(rid, pa.int64()), **{c: info[c] for c in ("doc_id", "d1", "d2", "key", "n")}, "grp": at(groups, pa.int64()), "m1": at(m1, pa.int64()), "m2": at(m2, pa.int64()), "toks": at(toks, pa.binary()), "prefix": at(prefix, pa.binary()), "short": at(short, pa.binary())})

    return run


def token_sets(docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """(rid, doc_id, d1, d2, key, n, grp, m1, m2, toks, prefix, short), a written table: every document that has words, d1 and d2 the hashes of its text, key
    that of its set. The last six are there for sets that can have a partner, on one row of each batch: group, the two least hashes, shared tokens, and which of these are its prefix, and its short one."""
    bound_batches(docs.sparkSession)
    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), *text_digest("text"), F.lower("text").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(1, -(-size // (6 * RANGE)))
    sent = rows.mapInArrow(_send(n, ranges), _RAW)
    back = sent.groupBy("part").applyInArrow(_count(ranges), _BACK)
    return table(back.groupBy("batch").applyInArrow(_gather(threshold), _SETS), "jaccard-sets")


def text_digest(text: str) -> tuple:
    """128 bits of hash of a text."""
    return F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(0x5851F42D), text).alias("d2")


def overlaps(pairs: np.ndarray, grams: list[np.ndarray]) -> np.ndarray:
    """The exact overlap of each pair of positions."""
    total = sum(map(len, grams))
    if len(pairs) * 25e-6 < 1e-3 + total * 2e-7 + len(grams) * total * 2e-10:
        return np.array([len(np.intersect1d(grams[i], grams[j], True)) for i, j in pairs], np.int64)
    _, code, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    where = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    shared = times[code] > 1
    new = np.cumsum(times > 1) - 1
    code, where = new[code[shared]], where[shared]
    order = np.argsort(code, kind="stable")
    code, where = code[order], where[order]
    queries, row = np.unique(pairs[:, 1], return_inverse=True)
    out = np.zeros((len(queries), len(grams)), np.float32)
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, _TILE):
        i, j = np.searchsorted(code, [low, low + _TILE])
        dense = np.zeros((len(grams), _TILE), np.float32)
        dense[where[i:j], code[i:j] - low] = 1
        out += dense[queries] @ dense.T
    return out[row, pairs[:, 0]].astype(np.int64)


def spanning(pairs: np.ndarray) -> np.ndarray:
    """Which pairs join two parts that were not yet joined."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = np.zeros(len(pairs), bool)
    for low in range(0, len(pairs), 10_000):  # lists of all pairs would be large
        for k, (x, y) in enumerate(pairs[low : low + 10_000].tolist(), low):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
                keep[k] = True
    return keep


def opened(query: list[np.ndarray], n_query: np.ndarray, group: list[np.ndarray], n_group: np.ndarray, threshold: float, union: np.ndarray | None = None) -> np.ndarray:
    """Which queries a group is opened to: those whose overlap with the union of its sets (if it is known, it is not made again) can reach the threshold with a member of any size."""
    if union is None:
        union = np.unique(np.concatenate(group))
    flat = np.concatenate(query)
    at = np.minimum(np.searchsorted(union, flat), len(union) - 1)
    cut = np.concatenate([[0], np.cumsum([len(x) for x in query])])
    hits = np.concatenate([[0], np.cumsum(union[at] == flat)])
    least = np.maximum(n_group.min(), least_shared(n_query, threshold))  # a partner is not smaller than this
    return hits[cut[1:]] - hits[cut[:-1]] >= threshold / (1 + threshold) * (n_query + least) - 1e-9


def inverted(group: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a group the union of its sets; their tokens in order, and whose they are."""
    token = np.concatenate(group)
    order = np.argsort(token, kind="stable")
    token = token[order]
    return token[np.append(True, token[1:] != token[:-1])], token, np.repeat(np.arange(len(group)), [len(x) for x in group])[order]


def overlaps_with(query: np.ndarray, token: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """The overlap of one set with each of an inverted group."""
    low, high = np.searchsorted(token, query), np.searchsorted(token, query, "right")
    many = high - low
    at = np.arange(many.sum()) + np.repeat(low - np.cumsum(many) + many, many)
    return np.bincount(owner[at], minlength=size)


def compare(a: np.ndarray, b: np.ndarray | None, sets: list[np.ndarray], n: np.ndarray, threshold: float, index: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The similar pairs of positions between groups a and b, or within a. index: of b, inverted, if it is known."""
    if b is None:
        i, j = np.triu_indices(len(a), 1)
        p = np.stack([a[i], a[j]], 1)
    else:
        a = a[opened([sets[i] for i in a], n[a], [sets[i] for i in b], n[b], threshold, index and index[0])]
        if index and len(a) <= FEW:
            out = [np.zeros((0, 2), np.int64)]
            for i in a:
                both = overlaps_with(sets[i], *index[1:], len(b))
                near = b[both / (n[i] + n[b] - both) >= threshold - 1e-12]
                out.append(np.stack([np.full(len(near), i), near], 1))
            return np.concatenate(out)
        p = np.stack([np.repeat(a, len(b)), np.tile(b, len(a))], 1)
    low, high = np.minimum(n[p[:, 0]], n[p[:, 1]]), np.maximum(n[p[:, 0]], n[p[:, 1]])
    p = p[low >= threshold * high - 1e-9]
    if not len(p):
        return p
    used, q = np.unique(p, return_inverse=True)
    both = overlaps(q.reshape(p.shape), [sets[i] for i in used])
    return p[both / (n[p[:, 0]] + n[p[:, 1]] - both) >= threshold - 1e-12]


def different_sets(every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key, sid, docs, first), (sid, grp, m1, m2, docs)): every different set, with the number of its documents (different ids) and the lowest id; and those that can have partners."""
    keys = every.groupBy("key", "doc_id").agg(F.min(F.when(F.col("toks").isNotNull(), F.col("rid"))).alias("sid"))
    keys = table(keys.groupBy("key").agg(F.min("sid").alias("sid"), F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first")), "jaccard-keys")
    some = keyed(table(keys.where("sid IS NOT NULL").select("sid", "docs"), "jaccard-heads"))
    return keys, every.where("toks IS NOT NULL").select(F.col("rid").alias("sid"), "grp", "m1", "m2").join(some, "sid")


def led(sets: list[np.ndarray], n: np.ndarray, threshold: float) -> np.ndarray:
    """Similar pairs of positions, each of a set and a leader: the first set leads, then the first of those that are not similar to it, and so on, LEADERS times."""
    rest, out = np.arange(len(n)), [np.zeros((0, 2), np.int64)]
    for _ in range(LEADERS):
        if len(rest) < 2:
            break
        lead, rest = rest[0], rest[1:]
        own = sets[lead]
        flat = np.concatenate([sets[i] for i in rest])
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        hits = np.concatenate([[0], np.cumsum(own[at] == flat)])
        cut = np.concatenate([[0], np.cumsum([len(sets[i]) for i in rest])])
        both = hits[cut[1:]] - hits[cut[:-1]]
        near = both / (n[lead] + n[rest] - both) >= threshold - 1e-12
        out.append(np.stack([rest[near], np.full(int(near.sum()), lead)], 1))
        rest = rest[~near]
    return np.concatenate(out)


def star_pairs(every: DataFrame, heads: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a written table: some of the similar pairs, found among sets of the same least hash, by the one hash and by the other. They are as many as the sets at most, twice."""
    of = heads.select("sid", F.explode(F.array(F.xxhash64(F.lit(1), "m1"), F.xxhash64(F.lit(2), "m2"))).alias("hash"))
    many = of.groupBy("hash").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    slice_ = F.xxhash64("hash", F.pmod(F.xxhash64("hash", "sid"), F.ceil(F.col("c") / BLOCK)))
    buckets = table(of.join(many, "hash").select("sid", slice_.alias("bucket")), "jaccard-buckets")
    parts = max(1, -(-buckets.count() // HELD))
    cells = every.where("toks IS NOT NULL").select(F.col("rid").alias("sid"), "n", "toks").join(keyed(buckets), "sid")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("bucket")
        sid, n, bucket = (t[x].to_numpy().astype(np.int64) for x in ("sid", "n", "bucket"))
        toks, pairs = t["toks"].to_pylist(), [np.zeros((0, 2), np.int64)]
        for i, j in zip(*_runs(bucket)):
            if j > i + 1:
                pairs.append(i + led([unpack(x) for x in toks[i:j]], n[i:j], threshold))
        pairs = np.concatenate(pairs)
        return pa.table({"a": pa.array(sid[pairs[:, 0]]), "b": pa.array(sid[pairs[:, 1]])})

    return table(cells.groupBy(F.pmod("bucket", F.lit(parts)).alias("part")).applyInArrow(run, "a long, b long"), "jaccard-stars")


def similar_sets(every: DataFrame, heads: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links), a written table: of the sets that have partners the number of documents on the other side, in parts, and (links null) pairs that connect what is similar.
    If heads has a column root, sets of the same root (not null) are known to be connected, and are not compared; then links are not all."""
    kind = F.col("grp").bitwiseAND(CLASS)
    if "root" in heads.columns:
        heads = heads.withColumn("grp", F.when(F.col("root").isNull(), F.col("grp")).otherwise(F.xxhash64("root").bitwiseAND(~CLASS).bitwiseOR(kind)))
    else:
        heads = heads.withColumn("root", F.lit(None).cast("long"))
    blocks = heads.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).where("blocks > 1")
    block = F.when(F.col("blocks").isNull(), F.col("grp")).otherwise(F.xxhash64("grp", F.pmod(F.xxhash64("sid"), F.col("blocks"))).bitwiseAND(~CLASS).bitwiseOR(kind))
    heads = table(heads.join(blocks, "grp", "left").select("sid", "docs", block.alias("gid"), "root"), "jaccard-groups")
    sets = every.where("toks IS NOT NULL").select(F.col("rid").alias("sid"), "n", "toks", "prefix", "short").join(keyed(heads), "sid")

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tok, gid, low = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for t, m, u, g in zip(*(b.column(c).to_pylist() for c in range(4))):
                x = unpack(t)
                m, u = (np.unpackbits(np.frombuffer(y, np.uint8))[: len(x)].astype(bool) for y in (m, u))
                tok.append(x[m])
                gid.append(np.full(int(m.sum()), g))
                low.append(u[m])
            tok, gid, low = np.concatenate(tok), np.concatenate(gid), np.concatenate(low)
            order = np.lexsort((~low, gid, tok))
            tok, gid, low = tok[order], gid[order], low[order]
            new = np.append(True, (tok[1:] != tok[:-1]) | (gid[1:] != gid[:-1])) if len(tok) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(tok[new].view(np.int64)), pa.array(gid[new]), pa.array(low[new])], ["token", "gid", "low"])

    matrix = sets.select("toks", "prefix", "short", "gid").mapInArrow(union, "token long, gid long, low boolean").repartition("token").groupBy("token", "gid").agg(F.max("low").alias("low"))
    up = F.col("h").bitwiseAND(CLASS) - F.col("g").bitwiseAND(CLASS)
    across = matrix.where("low").select("token", F.col("gid").alias("g")).join(matrix.select("token", F.col("gid").alias("h")), "token").where((F.col("g") != F.col("h")) & up.between(0, classes_up(threshold)))
    across = across.select(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h")).distinct()
    one = (F.count("root") == F.count(F.lit(1))) & (F.min("root") == F.max("root"))  # hashes of two roots may be equal
    sizes = heads.groupBy("gid").agg(F.when(one, F.min("root")).alias("root"), F.count(F.lit(1)).alias("c"))
    pairs = table(across.unionByName(sizes.where("c > 1").select(F.col("gid").alias("g"), F.col("gid").alias("h"))), "jaccard-pairs")
    # A pair is compared where its larger group is, so that a group which many small ones meet is sent once; if they are too many for a task, it is sent again for each slice of them.
    c, d = sizes.toDF("g", "rg", "cg"), sizes.toDF("h", "rh", "ch")
    first = (F.col("cg") > F.col("ch")) | ((F.col("cg") == F.col("ch")) & (F.col("g") <= F.col("h")))
    pairs = pairs.join(c, "g").join(d, "h").where(F.coalesce(F.col("rg") != F.col("rh"), F.lit(True))).select(F.when(first, F.col("g")).otherwise(F.col("h")).alias("hub"), F.when(first, F.col("h")).otherwise(F.col("g")).alias("other"), F.least("cg", "ch").alias("c"))
    pairs = table(pairs, "jaccard-hubs")
    slices = pairs.groupBy("hub").agg(F.ceil(F.sum("c") / HELD).alias("slices"))
    parts = max(1, -(-pairs.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0] // HELD))
    pairs = pairs.join(slices, "hub").select(F.pmod(F.xxhash64("hub", F.pmod(F.xxhash64("other"), F.col("slices"))), F.lit(parts)).alias("part"), "hub", "other")
    pairs = table(pairs, "jaccard-parts")
    sent = pairs.select("part", F.explode(F.array("hub", "other")).alias("gid")).distinct()
    cells = sets.select("sid", "n", "docs", "toks", "gid", "root").join(keyed(table(sent, "jaccard-sent")), "gid")

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("gid")
        gid, sid, n, docs = (right[x].to_numpy().astype(np.int64) for x in ("gid", "sid", "n", "docs"))
        sets_ = [unpack(x) for x in right["toks"].to_pylist()]
        at = {int(gid[i]): np.arange(i, j) for i, j in zip(*_runs(gid))}
        links, trees = np.zeros(len(sid), np.int64), [np.zeros((0, 2), np.int64)]
        rooted = right["root"].null_count < len(right)
        _, first, root = np.unique(right["root"].fill_null(-1).to_numpy(), return_index=True, return_inverse=True)
        same = np.where(right["root"].is_null().to_numpy(), np.arange(len(sid)), first[root])  # one of each root stands for it
        left, hub, index = left.sort_by("hub"), None, None
        for g, h in zip(left["hub"].to_pylist(), left["other"].to_pylist()):
            if g != h and g != hub:
                hub, index = g, inverted([sets_[i] for i in at[g]])
            p = compare(at[h], None if g == h else at[g], sets_, n, threshold, index)
            np.add.at(links, p[:, 0], docs[p[:, 1]])
            np.add.at(links, p[:, 1], docs[p[:, 0]])
            if rooted and len(p):
                p = np.unique(same[p], axis=0)
            trees.append(p[spanning(p)])
        tree, some = np.concatenate(trees), np.flatnonzero(links)
        tree = tree[spanning(tree)]
        a = np.concatenate([sid[some], sid[tree[:, 0]]])
        null = np.arange(len(a))
        return pa.table({"a": pa.array(a), "b": pa.array(np.concatenate([sid[some], sid[tree[:, 1]]]), mask=null < len(some)), "links": pa.array(np.concatenate([links[some], np.zeros(len(tree), np.int64)]), mask=null >= len(some))})

    found = pairs.groupBy("part").cogroup(cells.groupBy("part")).applyInArrow(verify, "a long, b long, links long")
    return table(found, "jaccard-found")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b), by large and small stars; the root is the lowest node of its component."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(low, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    e = table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "stars")
    state = None
    while True:
        e = table(star(star(e, True), False), "stars")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def jaccard_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links), a row for each document that has words (for an id and set, if rows repeat): the lowest id of all documents that similar pairs
    connect it to, and to how many other documents it is similar itself, that is, their n-gram sets have at least this Jaccard similarity."""
    every = token_sets(docs, n, threshold)
    keys, heads = different_sets(every)
    found = similar_sets(every, heads, threshold)
    of = table(components(found.where("b IS NOT NULL").select("a", "b")), "jaccard-components")
    some = keys.where("sid IS NOT NULL").select("sid", "first")
    low = of.join(some, F.col("node") == F.col("sid")).groupBy("root").agg(F.min("first").alias("class_id"))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = of.join(low, "root").join(links, "node", "left").select(F.col("node").alias("sid"), "class_id", "links")
    by_key = keys.join(classes, "sid", "left").select("key", F.coalesce("class_id", "first").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("links"))
    return every.select("doc_id", "key").distinct().join(by_key, "key").select("doc_id", "class_id", "links")


def dedup_near(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each group of near duplicates: of rows connected by similar pairs, the one of lowest doc_id (null last). Null texts and texts without words stay, each of their rows."""
    every = token_sets(docs, n, threshold)
    keys, heads = different_sets(every)
    known = table(components(star_pairs(every, heads, threshold)), "jaccard-known")
    found = similar_sets(every, heads.join(known.select(F.col("node").alias("sid"), "root"), "sid", "left"), threshold)
    of = components(found.where("b IS NOT NULL").select("a", "b").unionByName(known.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    group = table(keys.join(of, F.col("sid") == F.col("node"), "left").select("key", F.coalesce(F.col("root").cast("string"), F.hex("key")).alias("group")), "jaccard-classes")
    rows = every.select("doc_id", "d1", "d2", "key").join(group, "key")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "d1", "d2")).alias("first")
    groups = rows.groupBy("group").agg(F.count(F.lit(1)).alias("c"), best).where("c > 1").select("group", F.struct("first.d1", "first.d2").alias("keep"))
    # By text: all rows of a text go, or one of them stays, or (texts of no group, and the only row of a keeper) nothing happens.
    texts = rows.join(groups, "group").groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("d1", "d2") == F.col("keep")).alias("stays")).where("NOT stays OR c > 1")
    texts = table(texts, "jaccard-texts")
    d1, d2, place = fresh(docs, "d1", "d2", "place")
    tagged = docs.withColumns(dict(zip((d1, d2), text_digest("text"))))
    own = [F.col(f"`{c}`") for c in docs.columns]
    rest = tagged.join(keyed(texts.select(F.col("d1").alias(d1), F.col("d2").alias(d2))), [d1, d2], "left_anti").select(*own)
    first = Window.partitionBy(d1, d2).orderBy(F.col("doc_id").asc_nulls_last())
    one = tagged.join(keyed(table(texts.where("stays").select(F.col("d1").alias(d1), F.col("d2").alias(d2)), "jaccard-keepers")), [d1, d2], "left_semi")
    return rest.unionByName(one.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).select(*own))
