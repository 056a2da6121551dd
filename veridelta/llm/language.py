"""Language ID by string-kernel classification.

The kernel of two texts is the normalised count of the byte n-grams (n = 1, 2, 3 of the lower-cased UTF-8)
that are present in both: |N(x) & N(y)| / sqrt(|N(x)| |N(y)|). Landmarks drawn evenly from the labelled languages
give the Nystroem features K(x, landmarks) K(landmarks, landmarks)^-1/2, on which ridge regression fits one
classifier against the rest for each language. Presence of n-grams times landmarks' n-grams times weights
is one matrix product per batch. Every text is read whole.

A text is accepted by its best score, its lead over the second and the share of its n-grams that landmarks hold. The limits of
the three are low quantiles of what labelled documents, and their beginnings, reach under a model fitted without them, by
number of n-grams, and looser for a language whose own documents reach less.

Edge cases: a null or empty text, or one without a letter, has no language and is rejected; where too few labelled
documents are at hand to set limits, a text is rejected if its best score is not min_gain above that of a text that tells nothing; ties go to the language that comes first by name; repeated rows score alike;
rows without a language label are not trained on; without any labelled row every document is rejected; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, fresh, keyed, table, text_buffers, with_fields

#: Bound of the labelled sample: so many documents of each language, by lowest hash of the id.
TRAIN_PER_LANGUAGE = 300
LANDMARKS_PER_LANGUAGE = 40
RIDGE = 1e-2
#: A one-versus-rest decision is learnt as +1 or -1, so a text that tells nothing scores 2 / languages - 1; the best language has to be above that by this much.
MIN_GAIN = 0.1
#: The quantile of held-out documents that is a limit, how far the limit lies under it (in distances from the median), and how many documents set one.
LOW, SLACK, LEAST_HELD = 0.002, 0.25, 40
#: Characters of the beginnings that stand for short texts, and the classes of texts by the logarithm of their number of n-grams.
BEGINNINGS, CLASSES = (8, 16, 32, 64, 128, 256), 9
CODES = (1 << 24) + (1 << 16) + (1 << 8)
_marks: np.ndarray | None = None
_tables: dict[int, np.ndarray] = {}


def presence(b: np.ndarray) -> np.ndarray:
    """The codes of the different 1-, 2- and 3-grams of some bytes."""
    global _marks
    if _marks is None:
        _marks = np.zeros(CODES, np.int32)
    x = b.astype(np.int32)
    code = [x + ((1 << 24) + (1 << 16))]
    if len(x) > 1:
        two = (x[:-1] << 8) | x[1:]
        code.append(two + (1 << 24))
    if len(x) > 2:
        code.append((two[:-1] << 8) | x[2:])
    c = np.concatenate(code)
    n = np.arange(len(c), dtype=np.int32)
    _marks[c] = n
    return c[_marks[c] == n]


def forget() -> None:
    """Frees the tables of all codes, which a worker would keep for its next task of any kind."""
    global _marks
    _marks = None
    _tables.clear()


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The kernel between two lists of texts, given as present codes."""
    vocabulary = np.unique(np.concatenate(b)) if b else np.zeros(0, np.int64)
    right = np.zeros((len(b), len(vocabulary)), np.float32)
    for i, x in enumerate(b):
        right[i, np.searchsorted(vocabulary, x)] = 1
    out = np.zeros((len(a), len(b)))
    for i, x in enumerate(a):
        j = np.searchsorted(vocabulary, x)
        j = j[(j < len(vocabulary)) & (vocabulary[np.minimum(j, len(vocabulary) - 1)] == x)]
        out[i] = right[:, j].sum(1) / np.sqrt(max(1, len(x)) * np.maximum(1, [len(y) for y in b]))
    return out


class Model:
    """languages; the codes that count; for each code its weight for each language; what is added; least score, lead and share for each language and class of length."""

    def __init__(self, texts: list[str], langs: list[str]) -> None:
        self.languages = sorted(set(langs))
        self.limits = np.full((len(self.languages), CLASSES, 3), -np.inf)
        if not texts:
            self.codes, self.weights, self.shift = np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros(0)
            return
        grams = [presence(np.frombuffer(t.lower().encode(), np.uint8)) for t in texts]
        seen: dict[str, int] = {}
        marks = []
        for i, lang in enumerate(langs):
            seen[lang] = seen.get(lang, 0) + 1
            if seen[lang] <= LANDMARKS_PER_LANGUAGE:
                marks.append(i)
        landmarks = [grams[i] for i in marks]
        k = overlaps(grams, landmarks)
        value, vector = np.linalg.eigh(k[marks])
        keep = value > 1e-8 * value.max()
        root = vector[:, keep] / np.sqrt(value[keep])
        phi = k @ root
        y = np.where(np.array(langs)[:, None] == np.array(self.languages)[None], 1.0, -1.0)
        weight = 1 / np.array([seen[x] for x in langs])
        weight /= weight.sum()
        centre, target = weight @ phi, weight @ y
        p, q = phi - centre, y - target
        w = np.linalg.solve((p * weight[:, None]).T @ p + RIDGE / len(texts) * np.eye(p.shape[1]), (p * weight[:, None]).T @ q)
        self.shift = target - centre @ w
        per_landmark = root @ w
        self.codes = np.unique(np.concatenate(landmarks))
        weights = np.zeros((len(self.codes), len(self.languages)))
        for g, row in zip(landmarks, per_landmark):
            weights[np.searchsorted(self.codes, g)] += row / np.sqrt(max(1, len(g)))
        self.weights = weights.astype(np.float32)

    def scores(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """One row of scores for each text, whose lower-cased bytes are raw[off[i]:off[i + 1]]."""
        return self.measures(raw, off)[0]

    def measures(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, class by number of n-grams, (best score, lead, share of n-grams that landmarks hold)), a row for each text."""
        key = hash(self.codes.tobytes())
        if key not in _tables:
            _tables.clear()
            t = np.full(CODES, -1, np.int16 if len(self.codes) < 1 << 15 else np.int32)
            t[self.codes] = np.arange(len(self.codes))
            _tables[key] = t
        table = _tables[key]
        out = np.empty((len(off) - 1, len(self.languages)))
        size, known = np.zeros(len(out)), np.zeros(len(out))
        for a in range(0, len(out), 128):
            n = min(128, len(out) - a)
            flags = np.zeros((n, len(self.codes)), np.float32)
            norm = np.ones(n)
            for i in range(n):
                c = presence(raw[off[a + i] : off[a + i + 1]])
                norm[i] = max(1, len(c))
                j = table[c]
                j = j[j >= 0]
                flags[i, j] = 1
                size[a + i], known[a + i] = len(c), len(j)
            out[a : a + n] = (flags @ self.weights) / np.sqrt(norm)[:, None] + self.shift
        two = np.sort(np.column_stack([np.full((len(out), 2), -np.inf), out]), 1)[:, -2:]
        lead = np.subtract(two[:, 1], two[:, 0], where=len(self.languages) > 1, out=np.zeros(len(out)))
        size = np.maximum(1, size)
        return out, np.minimum(CLASSES - 1, np.log2(size).astype(int)), np.column_stack([two[:, 1], lead, known / size])

    def accepts(self, s: np.ndarray, kind: np.ndarray, got: np.ndarray, min_gain: float) -> np.ndarray:
        """Which of the texts with these measures are accepted."""
        chance = (s.max(1) >= 2 / len(self.languages) - 1 + min_gain) | (len(self.languages) == 1)
        return chance & (got >= self.limits[s.argmax(1), kind]).all(1)


def sample(df: DataFrame, label: Column, most: int, id_col: str = "doc_id", text: str = "text") -> list[tuple[str, str]]:
    """At most so many (label, text) of each label: those of the lowest hash of the id and the text. Hashes alone are ranked, then only the chosen texts are read."""
    rows = df.select(label.alias("label"), F.xxhash64(F.lit(5), F.col(id_col)).alias("h"), F.xxhash64(F.lit(7), F.col(text)).alias("d"), F.col(text).alias("text")).where("label IS NOT NULL AND text IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("h", "d"))  # Spark cuts each input partition to so many before the shuffle
    chosen = rows.select("label", "h", "d", rank.alias("rank")).where(F.col("rank") <= most).groupBy("label", "h", "d").agg(F.count(F.lit(1)).alias("times"))
    got = [(r.label, r.h, r.d, r.text, r.times) for r in rows.join(keyed(table(chosen, "language-sample")), ["label", "h", "d"]).groupBy("label", "h", "d", "times").agg(F.min("text").alias("text")).collect()]
    return [(label, t) for label, _, _, t, times in sorted(got) for _ in range(times)]


def limits(texts: list[str], langs: list[str]) -> np.ndarray:
    """Limits of a model of these texts: each half is measured by a model of the other, whole and by its beginnings; of those that find their label, the low quantile less some slack."""
    languages = sorted(set(langs))
    turn: dict[str, int] = {}
    half = np.zeros(len(langs), int)
    for i, x in enumerate(langs):
        turn[x] = turn.get(x, -1) + 1
        half[i] = turn[x] % 2
    held: dict[tuple[int, int], list[np.ndarray]] = {}
    for side in (0, 1):
        near = np.flatnonzero(half != side)
        m = Model([texts[i] for i in near], [langs[i] for i in near])
        parts = [] if m.languages != languages else [(langs[i], x) for i in np.flatnonzero(half == side) for x in (texts[i], *(texts[i][:n].rpartition(" ")[0] for n in BEGINNINGS if n < len(texts[i]))) if any(map(str.isalpha, x))]
        if not parts:
            continue
        raw = [x.lower().encode() for _, x in parts]
        s, kind, got = m.measures(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(int))
        for (label, _), top, k, row in zip(parts, s.argmax(1).tolist(), kind.tolist(), got):
            if languages[top] == label:
                held.setdefault((top, k), []).append(row)
    out = np.full((len(languages), CLASSES, 3), -np.inf)
    for k in range(CLASSES):
        own = [held.get((x, k), []) for x in range(len(languages))]
        for x, rows in enumerate(own):
            if len(rows) >= LEAST_HELD:
                out[x, k] = np.minimum(lower(rows), lower([r for y in own for r in y]))
    return out


def lower(rows: list[np.ndarray]) -> np.ndarray:
    low, middle = np.quantile(rows, [LOW, 0.5], axis=0)
    return low - SLACK * (middle - low)


def train(df: DataFrame, lang: str = "lang") -> Model:
    rows = sample(df, F.col(lang).cast("string"), TRAIN_PER_LANGUAGE)
    texts, langs = [t for _, t in rows], [k for k, _ in rows]
    model = Model(texts, langs)
    model.limits = limits(texts, langs)
    forget()
    return model


def identify(df: DataFrame, model: Model, min_gain: float = MIN_GAIN) -> tuple[DataFrame, list[str]]:
    """df with (language, score, accepted), and the names of these three."""
    names = fresh(df, "language", "score", "accepted")
    low, letters = fresh(df, "low", "letters")
    bound_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)
    carried = list(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            n, k = batch.num_rows, len(carried)
            ok = batch.column(k + 1).to_numpy(zero_copy_only=False).astype(bool)
            best, top, good = np.full(n, None, object), np.full(n, np.nan), np.zeros(n, bool)
            if m.languages and n:
                raw, off = text_buffers(batch.column(k))
                s, kind, got = m.measures(raw, off)
                best, top = np.array(m.languages, object)[s.argmax(1)], s.max(1)
                good = ok & m.accepts(s, kind, got, min_gain)
            best[~ok] = None
            forget()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:k], pa.array(best, pa.string()), pa.array(top, pa.float64(), mask=~ok | np.isnan(top)), pa.array(good)], [*carried, *names]
            )

    schema = with_fields(df, dict(zip(names, ("string", "double", "boolean"))))
    wide = df.withColumns({low: F.lower(F.col("text")), letters: F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))})
    return wide.mapInArrow(run, schema), names
