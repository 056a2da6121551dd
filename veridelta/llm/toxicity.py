"""Toxic passages by maximum-scoring segment search.

Words score by their log-odds between toxic and other labelled documents, in numbers of documents that hold
them, under an informative Dirichlet prior (the words' frequencies in the sample): positive and negative, in full where a word is significant and in proportion to the square of its standard score where it is
less so, and of a word's occurrences in a text the k-th adds its weight over the root of k (weights are learnt from texts that hold a word, not from repetitions), less a drift that keeps the expected score of clean text negative. Each language has weights of its own, to which the other languages' documents
add a little. A document is tested by its language's weights and by those of all languages together, and its p-value is twice the lower one. A linear-time scan finds every maximal scoring segment of a text. A segment
of score S in a text of n words has the extreme-value p-value 1 - exp(-K n e^(-L S)): L is the root of
sum p_s e^(L s) = 1 under the scores of clean documents, and K is estimated from clean documents by maximum likelihood, each scored by weights that were fitted without it. A document's p-value is that of its best segment.

Edge cases: null and empty texts have no passage and are absent from the result; labels of unknown documents, null labels and null
ids are not trained on; a document with both labels counts as both; repeated rows score alike and each is returned; a very long text is scanned in whole; a p-value equal to the limit counts as toxic; of equal scores each is a passage; without labels of
both kinds nothing is toxic; columns other than doc_id, text and lang are not looked at, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bound_batches, mix, steps, table, text_buffers, word_hashes

#: Bound of the labelled sample, for each label; languages have equal shares of it, as far as they have documents.
TRAIN_PER_LABEL = 10_000
#: Total of the Dirichlet prior, as a share of the counts; the standard score from which a word's log-odds count in full; and what a document counts in another language.
PRIOR, FULL_Z, FOREIGN = 0.5, 3.5, 0.1
#: The expected score of a clean word is at most this, and the largest p-value of a toxic document and of the passages that are listed.
MARGIN, ALPHA = -0.02, 1e-2


@dataclass
class Model:
    words: np.ndarray
    weights: np.ndarray
    scale: float
    drift: float = 0.0
    k: float = 1.0
    by: dict[str, Model] = field(default_factory=dict)

    def p_value(self, score: np.ndarray, words: np.ndarray) -> np.ndarray:
        return -np.expm1(-self.k * words * np.exp(np.minimum(700, -self.scale * np.asarray(score, float))))

    def score(self, hashes: np.ndarray, turn: np.ndarray | None = None) -> np.ndarray:
        """Each word's score; turn: which occurrence of the word in its text it is, of which the k-th adds the weight over the root of k."""
        i = np.minimum(np.searchsorted(self.words, hashes), max(0, len(self.words) - 1))
        if not len(self.words):
            return np.zeros(len(hashes))
        weight = np.where(self.words[i] == hashes, self.weights[i], 0.0)
        return (weight if turn is None else weight / np.sqrt(turn)) - self.drift


def turns(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which occurrence in its document each word is, from 1. at: each document's first word, and the end."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at)).astype(np.uint64)
    order = np.argsort(mix(hashes + mix(doc + np.uint64(1))), kind="stable")
    h, d = hashes[order], doc[order]
    lead = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(h) else np.zeros(0, bool)
    out = np.empty(len(h), np.int64)
    out[order] = np.arange(len(h)) - np.flatnonzero(lead)[np.cumsum(lead) - 1] + 1
    return out


def highest(score: np.ndarray) -> float:
    """The score of the best segment."""
    total = np.concatenate([[0.0], np.cumsum(score)])
    return float((total - np.minimum.accumulate(total)).max())


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score), in order; Ruzzo and Tompa's scan over the positive words alone."""
    total = np.concatenate([[0.0], np.cumsum(score)])
    stack: list[list] = []  # [sum before, sum after, first, end]
    for i in np.flatnonzero(score > 0):
        low, high, first, end = total[i], total[i + 1], int(i), int(i) + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= high:
                stack.append([low, high, first, end, j])
                break
            low, first = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, float(y - x)) for x, y, a, b, _ in stack]


def log_odds(toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds, standard score) of each word from its two counts."""
    every = toxic + clean
    prior = PRIOR * every
    total = prior.sum()
    a, b = toxic + prior, clean + prior
    seen = every > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = np.where(seen, np.log(a / (toxic.sum() + total)) - np.log(b / (clean.sum() + total)), 0.0)
        z = np.where(seen, odds / np.sqrt(1 / a + 1 / b), 0.0)
    return odds, z


def scale_of(values: np.ndarray, weight: np.ndarray) -> float:
    """The positive root L of sum weight e^(L value) = 1, for a negative mean."""
    low, high = 0.0, 1.0
    f = lambda x: float(weight @ np.exp(np.minimum(700, x * values)))
    while f(high) < 1 and high < 100:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 1 else (low, mid)
    return high


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = text_buffers(batch.column(0))
        label = batch.column(1).to_numpy(zero_copy_only=False)
        tongue = batch.column(2).to_numpy(zero_copy_only=False)
        for i, j in steps(off):
            h, at = word_hashes(raw[off[i] : off[j]], off[i : j + 1] - off[i], WORD)
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
            order = np.lexsort((doc, h))
            first = np.ones(len(h), bool)
            first[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
            h, doc = h[order][first], doc[order][first]
            toxic, g = label[i:j][doc] == 1, tongue[i:j][doc].astype(np.int64)
            order = np.lexsort((g, h))
            h, g, toxic = h[order], g[order], toxic[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            group = np.cumsum(new) - 1
            t = np.bincount(group[toxic], minlength=int(new.sum()))
            c = np.bincount(group, minlength=int(new.sum())) - t
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(g[new]), pa.array(t.astype(np.int64)), pa.array(c.astype(np.int64))], ["h", "g", "toxic", "clean"])


def quotas(counts: dict[str, int], most: int) -> dict[str, int]:
    """How many documents of each language a sample of at most so many takes: equal numbers, and what a small language leaves goes to the others."""
    out, left = {}, most
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, left // (len(counts) - k))
        left -= out[lang]
    return out


def fit(h: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> Model:
    """Weights of words, without calibration."""
    if not toxic.sum() or not clean.sum():
        return Model(np.zeros(0, np.uint64), np.zeros(0), 1.0)
    odds, z = log_odds(toxic, clean)
    weight = odds * np.minimum(1.0, (z / FULL_Z) ** 2)
    share = clean + PRIOR * (toxic + clean)
    share /= share.sum()
    drift = max(0.0, float(share @ weight) - MARGIN)
    scale = scale_of(weight - drift, share)
    if len(h) > 1 and not (h[1:] > h[:-1]).all():
        order = np.argsort(h)
        h, weight = h[order], weight[order]
    return Model(h, weight.astype(np.float32), scale, drift)  # models of one vocabulary share it, in memory and when they are sent


def balanced(toxic: np.ndarray, clean: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """The counts of a language with the larger of the two reduced, so that their totals have this ratio and its plain words tell nothing."""
    t, c = toxic.sum(), clean.sum()
    return (toxic * min(1.0, ratio * c / t), clean * min(1.0, t / (ratio * c))) if t and c and ratio else (toxic, clean)


def tongue(df: DataFrame) -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in df.columns else F.lit("")


def _models(h: np.ndarray, own: list[list[np.ndarray]], langs: list[str]) -> Model:
    """The model of all languages together, and in it that of each, from their counts of toxic and clean documents by word."""
    ratio = sum(t.sum() for t, _ in own) / max(1.0, sum(c.sum() for _, c in own))
    model = fit(h, *(sum(x) for x in zip(*(balanced(t, c, ratio) for t, c in own))))
    for k, lang in enumerate(langs):
        t, c = own[k]
        if t.sum() and c.sum():
            others = [balanced(*x, t.sum() / c.sum()) for y, x in enumerate(own) if y != k]
            model.by[lang] = fit(h, t + FOREIGN * sum(x for x, _ in others), c + FOREIGN * sum(x for _, x in others))
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_PER_LABEL) -> Model:
    """Fits the word weights and their calibration on at most so many documents of each label (those of the lowest hash of the id)."""
    spark = docs.sparkSession
    bound_batches(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), tongue(docs).alias("lang"), F.lower("text").alias("text"))
    known = table(known.join(texts.select("id", "lang"), "id").distinct(), "toxic-ids")
    counts: dict[int, dict[str, int]] = {}
    for r in known.groupBy("toxic", "lang").count().collect():
        counts.setdefault(r[0], {})[r[1]] = r[2]
    if len(counts) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 1.0)
    langs = sorted({x for c in counts.values() for x in c})
    bounds = spark.createDataFrame([(y, x, n, langs.index(x)) for y, c in counts.items() for x, n in quotas(c, most).items()], "toxic int, lang string, quota int, g int")
    rank = F.row_number().over(Window.partitionBy("toxic", "lang").orderBy(F.xxhash64(F.lit(3), F.col("id")), "id"))
    ranked = known.withColumn("rank", rank).where(F.col("rank") <= most)  # a bound that Spark applies before the shuffle
    fold = F.pmod(F.xxhash64(F.lit(9), F.col("id")), F.lit(2)).cast("int").alias("fold")
    chosen = table(ranked.join(F.broadcast(bounds), ["toxic", "lang"]).where(F.col("rank") <= F.col("quota")).select("id", "lang", "toxic", "g", fold), "toxic-sample")
    rows = table(texts.join(F.broadcast(chosen), ["id", "lang"]).select("text", "toxic", (F.col("g") * 2 + F.col("fold")).alias("g")), "toxic-texts")  # at most twice the bound of ids
    got = rows.mapInArrow(_words, "h long, g long, toxic long, clean long").groupBy("h", "g").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
    h, at = np.unique(got["h"].to_numpy().view(np.uint64), return_inverse=True)
    g = got["g"].to_numpy()
    part = [[np.bincount(at[g == k], got[x].to_numpy()[g == k], len(h)) for x in ("toxic", "clean")] for k in range(2 * len(langs))]
    model = _models(h, [[x + y for x, y in zip(part[2 * k], part[2 * k + 1])] for k in range(len(langs))], langs)
    halves = [_models(h, part[f::2], langs) for f in (0, 1)]
    held = spark.sparkContext.broadcast(halves)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of clean documents scored by the other half's weights: how many, and their sum of n e^(-L S), by language and for all (-1)."""
        sums: dict[int, list[float]] = {}
        for batch in batches:
            raw, off = text_buffers(batch.column(0))
            of = batch.column(1).to_numpy()
            for i, j in steps(off):
                w, cut = word_hashes(raw[off[i] : off[j]], off[i : j + 1] - off[i], WORD)
                turn = turns(w, cut)
                for d in range(j - i):
                    x, own = w[cut[d] : cut[d + 1]], int(of[i + d])
                    other = held.value[1 - own % 2]
                    for name, m in ((-1, other), (own // 2, other.by.get(langs[own // 2]))):
                        if m is not None and len(m.words) and len(x):
                            total = sums.setdefault(name, [0, 0.0])
                            total[0] += 1
                            total[1] += len(x) * float(np.exp(-m.scale * highest(m.score(x, turn[cut[d] : cut[d + 1]]))))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.float64())], ["g", "n", "s"])

    for r in rows.where("toxic = 0").select("text", "g").mapInArrow(clean, "g long, n long, s double").groupBy("g").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        m = model if r.g < 0 else model.by.get(langs[r.g])
        if m is not None and r.s > 0:
            m.k = min(1.0, r.n / r.s)
    return model


def passages(docs: DataFrame, model: Model, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, n_words, p_value, passages of (first word, last + 1, score, p_value)) of the toxic documents."""
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    inner = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = held.value
        for batch in batches:
            raw, off = text_buffers(batch.column(1))
            lang = np.array(batch.column(2).to_pylist(), object)
            ids, size, ps, lists = [], [], [], []
            for i, j in steps(off):
                h, at = word_hashes(raw[off[i] : off[j]], off[i : j + 1] - off[i], WORD)
                turn = turns(h, at)
                whole, own = every.score(h, turn), np.zeros(len(h))
                for x in set(lang[i:j]) & set(every.by):
                    mine = np.repeat(lang[i:j] == x, np.diff(at))
                    own[mine] = every.by[x].score(h[mine], turn[mine])
                for d in np.flatnonzero(np.diff(at)) if len(every.words) else ():
                    tests = [(every, whole), *([(every.by[lang[i + d]], own)] if lang[i + d] in every.by else [])]
                    results = []
                    for m, s in tests:
                        one = s[at[d] : at[d + 1]]
                        if len(tests) * m.p_value(highest(one), len(one)) <= alpha * (1 + 1e-9) and (found := segments(one)):
                            p = np.minimum(1, len(tests) * m.p_value(np.array([x[2] for x in found]), len(one)))
                            results.append((float(p.min()), found, p))
                    if results and min(r[0] for r in results) <= alpha:
                        least, found, p = min(results, key=lambda r: r[0])
                        ids.append(batch.column(0)[i + int(d)].as_py())
                        size.append(int(at[d + 1] - at[d]))
                        ps.append(least)
                        lists.append([{"first": a, "end": b, "score": x, "p_value": float(q)} for (a, b, x), q in zip(found, p) if q <= alpha])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(ps, pa.float64()), pa.array(lists, inner)], ["doc_id", "n_words", "p_value", "passages"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"), tongue(docs).alias("lang")).where("text IS NOT NULL")
    return rows.mapInArrow(run, "doc_id long, n_words long, p_value double, passages array<struct<first:long,end:long,score:double,p_value:double>>")
