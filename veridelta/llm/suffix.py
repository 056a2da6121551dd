"""Passages that repeat, by sharded suffix arrays.

A passage is a run of at least 50 words (between white space) that occurs more than once in the corpus. Every start of 50
words is sent to the shard of its anchor, the run of 32 words of lowest hash among those within: equal 50 words have equal
anchors, so no repeat is split between shards. Starts in a row of one anchor travel as one segment with its words. Anchors that
occur once are dropped. Equal segments are one, with a count (they agree in two 64-bit hashes, the anchor's and their own). A shard's segments make one string, whose suffix array is
induced in linear time: suffixes are classified, the leftmost-smaller substrings sorted by recursion, and the rest
induced. Permuted common prefixes then tell which starts have 50 words in common with a neighbour. Of equal starts the first by
(doc_id, word) stays; the others can be removed.

A hot anchor, such as a licence line in a third of all documents, is counted in parts before the shuffle. If its different segments have more words than a shard, they are
split into their starts, which are grouped by two hashes of their 50 words, again in parts before the shuffle; so no task holds all of a hot passage.

Edge cases: null and empty texts and those under 50 words have no passage; documents without a repeated passage are not in the
result; of copies under one id (repeated rows) all are the first occurrence, none is removed; a null id sorts first; long texts
are read in whole; columns other than doc_id and text are not looked at, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _powers, bound_batches, keyed, mix, steps, table, text_buffers, word_hashes

WORDS, ANCHOR = 50, 32
#: Words of a shard's string.
SHARD_WORDS = 1 << 19
_NONE = np.uint64(2**64 - 1)


def suffix_array(s: np.ndarray) -> list[int]:
    """Suffix array of non-negative integers by induced sorting; the end of the string is less than everything."""
    n = len(s)
    if n < 2:
        return list(range(n))
    up = np.zeros(n, bool)  # the suffix is less than the next
    differs = np.flatnonzero(s[:-1] != s[1:])
    at = np.searchsorted(differs, np.arange(n - 1))
    known = at < len(differs)
    up[:-1][known] = (s[:-1] < s[1:])[differs[at[known]]]
    count = np.bincount(s)
    ends = np.cumsum(count)
    starts = (ends - count).tolist()
    ends = ends.tolist()
    least = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    text, climbs = s.tolist(), up.tolist()

    def induce(order: list[int]) -> list[int]:
        sa = [-1] * n
        tail = ends.copy()
        for i in reversed(order):
            c = text[i]
            tail[c] -= 1
            sa[tail[c]] = i
        head = starts.copy()
        c = text[n - 1]
        sa[head[c]] = n - 1
        head[c] += 1
        for k in range(n):
            j = sa[k] - 1
            if j >= 0 and not climbs[j]:
                c = text[j]
                sa[head[c]] = j
                head[c] += 1
        tail = ends.copy()
        for k in range(n - 1, -1, -1):
            j = sa[k] - 1
            if j >= 0 and climbs[j]:
                c = text[j]
                tail[c] -= 1
                sa[tail[c]] = j
        return sa

    if not len(least):
        return induce([])
    sa = np.array(induce(least.tolist()))
    rank = np.full(n + 1, -1)
    rank[least] = np.arange(len(least))
    order = sa[rank[sa] >= 0]
    end = np.append(least[1:], n - 1)
    names = np.zeros(len(least), np.int64)
    name = 0
    before = None
    for i in order.tolist():
        k = rank[i]
        this = text[i : end[k] + 1]
        if before is not None and (this != before or k == len(least) - 1 or last_one):
            name += 1
        last_one = k == len(least) - 1
        names[k] = name
        before = this
    if name + 1 < len(least):
        order = least[np.array(suffix_array(names))]
    return induce(order.tolist())


def common_prefixes(s: np.ndarray, sa: list[int]) -> np.ndarray:
    """For each position, what its suffix has in common with the one before it in the suffix array."""
    n, text = len(s), s.tolist()
    before = np.full(n, -1)
    a = np.array(sa, np.int64)
    before[a[1:]] = a[:-1]
    out, k = [0] * n, 0
    for i, j in enumerate(before.tolist()):
        if j < 0:
            k = 0
            continue
        most = n - max(i, j)
        while k < most and text[i + k] == text[j + k]:
            k += 1
        out[i] = k
        k = k - 1 if k else 0
    return np.array(out, np.int64)


def segments(words: np.ndarray, at: np.ndarray, size: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(anchor's hash, hash of the segment's words, document, first start, number of starts) of each row of starts with one anchor."""
    none = tuple(np.zeros(0, np.uint64) for _ in range(2)) + tuple(np.zeros(0, np.int64) for _ in range(3))
    if len(words) < size:
        return none
    w = mix(words)
    power, inverse = _powers(len(w) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(w * power[: len(w)])])
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    n = len(w) - anchor + 1
    h = mix((total[anchor:] - total[:-anchor]) * inverse[:n])
    h[doc[:n] != doc[anchor - 1 :]] = _NONE
    starts = len(w) - size + 1
    choices = size - anchor + 1
    low, where = h[:starts].copy(), np.arange(starts)
    for k in range(1, choices):  # the first of the lowest
        less = h[k : k + starts] < low
        low[less] = h[k : k + starts][less]
        where[less] = np.flatnonzero(less) + k
    ok = np.flatnonzero(doc[:starts] == doc[size - 1 :])
    if not len(ok):
        return none
    cut = np.flatnonzero(np.append(True, (where[ok][1:] != where[ok][:-1])))
    first, last = ok[cut], ok[np.append(cut[1:] - 1, len(ok) - 1)]
    end = last + size
    seg = mix((total[end] - total[first]) * inverse[first] + (end - first).astype(np.uint64))
    return h[where[first]], seg, doc[first], first - at[doc[first]], last - first + 1


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = text_buffers(batch.column(2))
        for i, j in steps(off):
            h, seg, doc, first, starts = segments(*word_hashes(raw[off[i] : off[j]], off[i : j + 1] - off[i]), WORDS, ANCHOR)
            rows = pa.array(doc + i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(seg.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first.astype(np.int32)), pa.array(starts.astype(np.int32))],
                ["h", "seg", "doc_id", "digest", "first", "starts"],
            )


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the wanted segments of each text."""
    for batch in batches:
        raw, off = text_buffers(batch.column(0))
        for i, j in steps(off):
            words, at = word_hashes(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            rows = [(x["h"], x["seg"], words[at[k] + x["first"] : at[k] + x["first"] + x["starts"] + WORDS - 1].tobytes()) for k, want in enumerate(batch.column(1).slice(i, j - i).to_pylist()) for x in want]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["h", "seg", "words"])


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of every 50 words of each segment."""
    for batch in batches:
        rows, at, one, two = [], [], [], []
        for i, blob in enumerate(batch.column(2).to_pylist()):
            words = np.frombuffer(blob, np.uint64)
            n = len(words) - WORDS + 1
            for seed, out in ((np.uint64(0), one), (np.uint64(0x2545F4914F6CDD1D), two)):
                w = mix(words ^ seed)
                power, inverse = _powers(len(w) + 1)
                total = np.concatenate([[np.uint64(0)], np.cumsum(w * power[: len(w)])])
                out.append(mix((total[WORDS:] - total[:n]) * inverse[:n]))
            rows += [i] * n
            at.append(np.arange(n, dtype=np.int32))
        where = pa.array(rows, pa.int64())
        cat = lambda x, kind: pa.array(np.concatenate(x).view(kind) if x else np.zeros(0, kind))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), cat(at, np.int32), cat(one, np.int64), cat(two, np.int64)], ["h", "seg", "at", "k1", "k2"])


def sort_shard(strings: list[np.ndarray], counts: np.ndarray, first: list[tuple], size: int = WORDS) -> list[tuple[int, int, int, object, int]]:
    """(string, from, to, first id, first word less the start) for rows of starts that repeat and whose first occurrence moves along. first: (id, word) of each string's own first occurrence."""
    n = sum(map(len, strings))
    if not n:
        return []
    _, code = np.unique(np.concatenate(strings), return_inverse=True)
    m = len(strings)
    ends = np.cumsum([len(x) + 1 for x in strings]) - 1
    s = np.zeros(n + m, np.int64)
    inside = np.ones(n + m, bool)
    inside[ends] = False
    s[inside] = code + m
    s[ends] = np.arange(m)  # each end differs, so no common prefix goes across
    sa = suffix_array(s)
    lcp = common_prefixes(s, sa)
    order = np.array(sa)
    new = np.append(True, lcp[order[1:]] < size)
    kind = np.zeros(n + m, np.int64)
    kind[order] = np.cumsum(new) - 1
    of = np.zeros(n + m, np.int64)
    of[ends[:-1] + 1] = 1
    of = np.cumsum(of)
    begin = np.append(0, ends[:-1] + 1)
    offset = np.arange(n + m) - begin[of]
    start = np.flatnonzero(offset <= np.array([len(x) for x in strings])[of] - size)
    ids = np.array([-(2**63) if f[0] is None else f[0] for f in first], np.int64)
    word = np.array([f[1] for f in first], np.int64)
    at = np.lexsort((word[of[start]] + offset[start], ids[of[start]], kind[start]))
    k = kind[start][at]
    lead = np.append(True, k[1:] != k[:-1])
    group = np.cumsum(lead) - 1
    many = np.bincount(group, weights=counts[of[start][at]])[group] > 1
    head = at[lead][group]
    out = []
    lead_of, repeated = np.empty(len(start), np.int64), np.zeros(len(start), bool)
    lead_of[at], repeated[at] = start[head], many
    move = word[of[lead_of]] + offset[lead_of] - offset[start]
    run = np.flatnonzero(repeated)
    if not len(run):
        return []
    same = (np.diff(run) == 1) & (of[start[run]][1:] == of[start[run]][:-1]) & (ids[of[lead_of[run]]][1:] == ids[of[lead_of[run]]][:-1]) & (move[run][1:] == move[run][:-1])
    cut = np.flatnonzero(np.append(True, ~same))
    for a, b in zip(run[cut].tolist(), run[np.append(cut[1:] - 1, len(run) - 1)].tolist()):
        f = first[of[lead_of[a]]][0]
        out.append((int(of[start[a]]), int(offset[start[a]]), int(offset[start[b]]) + 1, f, int(move[a])))
    return out


def _merged(spans: str) -> str:
    """SQL that joins sorted spans that meet."""
    return f"""aggregate(array_sort({spans}), cast(array() as array<struct<first:int,end:int>>),
        (acc, x) -> CASE WHEN size(acc) > 0 AND element_at(acc, -1).end >= x.first
            THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', element_at(acc, -1).first, 'end', greatest(element_at(acc, -1).end, x.end))))
            ELSE concat(acc, array(x)) END)"""


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, repeated, removable): word spans [first, end) of each document that occur more than once, and what of these starts is not the first occurrence."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text").where("text IS NOT NULL")
    found = rows.mapInArrow(_occurrences, "h long, seg long, doc_id long, digest long, first int, starts int")
    found = table(found, "suffix-occurrences")
    anchors = found.groupBy("h").agg(F.count(F.lit(1)).alias("c"), (F.min("seg") != F.max("seg")).alias("several")).where("c > 1").drop("c")
    found = table(found.join(anchors, "h"), "suffix-repeated")
    kinds = found.groupBy("h", "seg").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "first", "digest")).alias("f"), F.max("starts").alias("starts"), F.max("several").alias("several"))
    kinds = table(kinds, "suffix-segments")
    plain = kinds.where("NOT several").select("h", "seg", F.lit(0).alias("low"), F.col("starts").alias("high"), F.col("f.doc_id").alias("f_doc"), F.col("f.first").alias("move"))
    sorted_ = kinds.where("several")
    size = F.coalesce(F.sum(F.col("starts") + WORDS), F.lit(0))
    total = sorted_.agg(size).first()[0]
    shards = max(1, -(-total // SHARD_WORDS))
    hot = keyed(table(sorted_.groupBy("h").agg(size.alias("words")).where(F.col("words") > SHARD_WORDS).select("h"), "suffix-hot"))
    # Each segment is cut out of one row that holds it.
    owner = F.coalesce(F.col("f.doc_id"), F.lit(-(2**63))).alias("owner")
    want = sorted_.select(F.col("f.digest").alias("digest"), owner, F.struct("h", "seg", F.col("f.first").alias("first"), "starts").alias("x")).groupBy("digest", "owner").agg(F.collect_list("x").alias("want"))
    texts = rows.select("digest", F.coalesce("doc_id", F.lit(-(2**63))).alias("owner"), "text").join(keyed(table(sorted_.select(F.col("f.digest").alias("digest"), owner).distinct(), "suffix-texts")), ["digest", "owner"], "left_semi")
    words = table(texts.join(want.hint("shuffle_hash"), ["digest", "owner"]).select("text", "want").mapInArrow(_cut_out, "h long, seg long, words binary"), "suffix-words")
    cells = words.join(hot, "h", "left_anti").join(sorted_.select("h", "seg", "c", "f"), ["h", "seg"]).select(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"), "h", "seg", "words", "c", F.col("f.doc_id").alias("doc"), F.col("f.first").alias("first"))
    starts = words.join(hot, "h", "left_semi").dropDuplicates(["h", "seg"]).mapInArrow(_starts, "h long, seg long, at int, k1 long, k2 long")
    starts = starts.join(sorted_.select("h", "seg", "c", "f"), ["h", "seg"]).select("h", "seg", "at", "k1", "k2", "c", F.struct("f.doc_id", (F.col("f.first") + F.col("at")).alias("first")).alias("f"))
    again = starts.groupBy("k1", "k2").agg(F.sum("c").alias("n"), F.min("f").alias("lead")).where("n > 1").drop("n")
    split = starts.join(again, ["k1", "k2"]).select("h", "seg", F.col("at").alias("low"), (F.col("at") + 1).alias("high"), F.col("lead.doc_id").alias("f_doc"), (F.col("lead.first") - F.col("at")).alias("move"))

    def sort(t: pa.Table) -> pa.Table:
        h, seg, blobs = t["h"].to_pylist(), t["seg"].to_pylist(), t["words"].to_pylist()
        once: dict[tuple, int] = {}
        for i, key in enumerate(zip(h, seg)):  # copies of a text cut the same segment out
            once.setdefault(key, i)
        pick = list(once.values())
        c, doc, first = t["c"].to_pylist(), t["doc"].to_pylist(), t["first"].to_pylist()
        out = sort_shard([np.frombuffer(blobs[i], np.uint64) for i in pick], np.array([c[i] for i in pick], float), [(doc[i], first[i]) for i in pick])
        return pa.table({
            "h": pa.array([h[pick[x[0]]] for x in out], pa.int64()), "seg": pa.array([seg[pick[x[0]]] for x in out], pa.int64()), "low": pa.array([x[1] for x in out], pa.int32()),
            "high": pa.array([x[2] for x in out], pa.int32()), "f_doc": pa.array([x[3] for x in out], pa.int64()), "move": pa.array([x[4] for x in out], pa.int32()),
        })

    ranges = cells.groupBy("shard").applyInArrow(sort, "h long, seg long, low int, high int, f_doc long, move int").unionByName(plain).unionByName(split)
    spans = found.join(ranges, ["h", "seg"]).select(
        "doc_id", "digest", F.struct((F.col("first") + F.col("low")).alias("first"), (F.col("first") + F.col("high") + WORDS - 1).alias("end")).alias("span"),
        (F.col("f_doc").eqNullSafe(F.col("doc_id")) & (F.col("move") == F.col("first"))).alias("stays"),
    )
    lists = spans.groupBy("doc_id", "digest").agg(F.collect_set("span").alias("all"), F.collect_set(F.when(~F.col("stays"), F.col("span"))).alias("others"))
    return lists.select("doc_id", F.expr(_merged("all")).alias("repeated"), F.expr(_merged("others")).alias("removable"))
