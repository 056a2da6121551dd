"""Vector metrics as higher-order expressions over array<double>, a registry of them, and the sequence metrics that need numpy."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

from veridelta.functions.opinion import let

Metric = Callable[[Column, Column], Column]


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def _pairs(a: Column, b: Column, f: Callable) -> Column:
    same = F.when(F.size(a) == F.size(b), b).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("array<double>"))
    return F.zip_with(a.cast("array<double>"), same.cast("array<double>"), f)


def dot(a: Column, b: Column) -> Column:
    return _total(_pairs(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a.cast("array<double>"), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    return let(norm(a) * norm(b), lambda n: F.when(n == 0, F.raise_error(F.lit("a zero vector has no cosine")).cast("double")).otherwise(dot(a, b) / n))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_total(_pairs(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return _total(_pairs(a, b, lambda x, y: F.abs(x - y)))


def chebyshev(a: Column, b: Column) -> Column:
    return F.coalesce(F.array_max(_pairs(a, b, lambda x, y: F.abs(x - y))), F.lit(0.0))


def hamming(a: Column, b: Column) -> Column:
    return F.size(F.filter(_pairs(a, b, lambda x, y: F.abs(x - y)), lambda d: d != 0)).cast("double")


def jaccard(a: Column, b: Column) -> Column:
    both = _total(_pairs(a, b, lambda x, y: F.when((x != 0) & (y != 0), 1.0).otherwise(0.0)))
    either = _total(_pairs(a, b, lambda x, y: F.when((x != 0) | (y != 0), 1.0).otherwise(0.0)))
    return let(either, lambda n: F.when(n == 0, 1.0).otherwise(both / n))


def canberra(a: Column, b: Column) -> Column:
    return _total(_pairs(a, b, lambda x, y: F.when(F.abs(x) + F.abs(y) > 0, F.abs(x - y) / (F.abs(x) + F.abs(y))).otherwise(0.0)))


def bray_curtis(a: Column, b: Column) -> Column:
    return let(_total(_pairs(a, b, lambda x, y: F.abs(x) + F.abs(y))), lambda low: F.when(low == 0, 0.0).otherwise(manhattan(a, b) / low))


def haversine(a: Column, b: Column) -> Column:
    """Kilometres between (latitude, longitude) in degrees."""
    p, q = F.radians(a[0]), F.radians(b[0])
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(b[1] - a[1]) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def kl_divergence(a: Column, b: Column) -> Column:
    return _total(_pairs(a, b, lambda p, q: F.when(p == 0, 0.0).when(q == 0, float("inf")).otherwise(p * F.log(p / F.when(q == 0, 1.0).otherwise(q)))))


def wasserstein(a: Column, b: Column) -> Column:
    """Earth mover's distance of two weightings of 0, 1, 2, ..."""
    def moved(p: Column, q: Column) -> Column:
        gap = F.aggregate(_pairs(a, b, lambda x, y: x / p - y / q), F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("t")), lambda s, x: F.struct((s["s"] + x).alias("s"), (s["t"] + F.abs(s["s"] + x)).alias("t")))
        return let(gap, lambda g: g["t"] - F.abs(g["s"]))

    return let(F.struct(_total(a.cast("array<double>")).alias("p"), _total(b.cast("array<double>")).alias("q")), lambda n: moved(n["p"], n["q"]))


def shares(a: Column) -> Column:
    """The numbers as parts of their total."""
    return let(a, lambda a: let(_total(a), lambda n: F.transform(a, lambda x: x / n)))


def mahalanobis(inverse: list[list[float]]) -> Metric:
    def f(a: Column, b: Column) -> Column:
        d = _pairs(a, b, lambda x, y: x - y)
        rows = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in inverse])
        return F.sqrt(_total(F.zip_with(d, rows, lambda x, r: x * _total(F.zip_with(d, r, lambda y, m: y * m)))))

    return f


def soft_cosine(similarity: list[list[float]]) -> Metric:
    def form(a: Column, b: Column) -> Column:
        rows = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in similarity])
        return _total(F.zip_with(a.cast("array<double>"), rows, lambda x, r: x * _total(F.zip_with(b.cast("array<double>"), r, lambda y, m: y * m))))

    return lambda a, b: form(a, b) / F.sqrt(form(a, a) * form(b, b))


@pandas_udf(DoubleType())
def dtw(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: np.ndarray, y: np.ndarray) -> float:
        row = np.full(len(y) + 1, np.inf)
        row[0] = 0
        for v in x:
            new = np.full(len(y) + 1, np.inf)
            cost = np.abs(np.asarray(y, float) - v)
            step = np.minimum(row[:-1], row[1:])
            for j in range(len(y)):
                new[j + 1] = cost[j] + min(step[j], new[j])
            row = new
        return float(row[-1])

    return pd.Series([one(x, y) for x, y in zip(a, b)])


@pandas_udf(DoubleType())
def spearman(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: list, y: list) -> float:
        p, q = pd.Series(x).rank().to_numpy(), pd.Series(y).rank().to_numpy()
        return 0.0 if p.std() == 0 or q.std() == 0 else float(np.corrcoef(p, q)[0, 1])

    return pd.Series([one(x, y) for x, y in zip(a, b)])


@pandas_udf(DoubleType())
def kendall(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: np.ndarray, y: np.ndarray) -> float:
        i, j = np.triu_indices(len(x), 1)
        p, q = np.sign(np.asarray(x)[i] - np.asarray(x)[j]), np.sign(np.asarray(y)[i] - np.asarray(y)[j])
        n = np.sqrt(float((p != 0).sum()) * float((q != 0).sum()))
        return 0.0 if n == 0 else float((p * q).sum() / n)

    return pd.Series([one(x, y) for x, y in zip(a, b)])


#: name -> (metric, higher is nearer, facts)
BUILT_IN: dict[str, tuple[Metric, bool, dict]] = {
    "cosine": (cosine, True, {"range": (-1, 1), "metric_space": False, "zero": "error"}), "euclidean": (euclidean, False, {"range": (0, None), "metric_space": True}), "dot_product": (dot, True, {"range": (None, None), "metric_space": False}),
    "manhattan": (manhattan, False, {"range": (0, None), "metric_space": True}), "chebyshev": (chebyshev, False, {"range": (0, None), "metric_space": True}), "hamming": (hamming, False, {"range": (0, None), "metric_space": True}), "jaccard": (jaccard, True, {"range": (0, 1), "metric_space": False}),
}
EXAMPLES: dict[str, tuple[Metric, bool, dict]] = {"canberra": (canberra, False, {}), "bray_curtis": (bray_curtis, False, {}), "haversine": (haversine, False, {}), "dtw": (dtw, False, {}), "kl_divergence": (kl_divergence, False, {}), "wasserstein": (wasserstein, False, {}), "spearman": (spearman, True, {}), "kendall": (kendall, True, {})}
_registry = dict(BUILT_IN)


def register(name: str, metric: Metric, higher_is_nearer: bool = True, facts: dict | None = None, force: bool = False) -> None:
    if name in _registry and not force:
        raise ValueError(f"{name} is registered")
    _registry[name] = (metric, higher_is_nearer, facts or {})


def unregister(name: str) -> None:
    if name in BUILT_IN:
        raise ValueError(f"{name} is built in")
    del _registry[name]


def reset() -> None:
    _registry.clear()
    _registry.update(BUILT_IN)


def names() -> list[str]:
    return sorted(_registry)


def metric(name: str) -> Metric:
    return _registry[name][0]


def facts(name: str) -> dict | None:
    return _registry[name][2] if name in _registry else None


def higher_is_nearer(name: str) -> bool:
    return _registry[name][1]


def similarity(a: Column, b: Column, name: str | None = None, term: dict | None = None) -> Column:
    """By the given metric, or the term's own, or cosine."""
    return metric(name or (term or {}).get("@similarity") or "cosine")(a, b)


def is_vector(v: Column, dimensions: int | None = None) -> Column:
    """Not empty, of finite numbers, and of the given size."""
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok & (F.size(v) == dimensions) if dimensions is not None else ok, F.lit(False))


def term_definition(name: str, iri: str, dimensions: int | None = None, similarity: str | None = None) -> dict:
    """A context term that says a property holds vectors, of how many dimensions, and by which metric they are compared."""
    if dimensions is not None and (isinstance(dimensions, bool) or not isinstance(dimensions, int) or dimensions < 1):
        raise ValueError("dimensions have to be a positive integer")
    return {name: {"@id": iri, "@container": "@vector"} | ({"@dimensions": dimensions} if dimensions is not None else {}) | ({"@similarity": similarity} if similarity is not None else {})}


def vector_errors(v: Column, dimensions: int | None = None) -> Column:
    """What is wrong with a vector, as an array of messages; none for a valid one."""
    checks = [(v.isNull(), "no vector"), (F.size(v) == 0, "empty"), (F.exists(v, lambda x: x.isNull()), "not a number"), (F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "not finite")]
    if dimensions is not None:
        checks.append((F.size(v) != dimensions, f"not of {dimensions} dimensions"))
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), why) for bad, why in checks]), lambda x: x.isNotNull())


def extract_vectors(document: Column, props: list[str]) -> Column:
    """A map from property to vector, of those properties of a JSON node that are lists of numbers."""
    v = F.try_parse_json(document)
    got = F.map_from_entries(F.array(*[F.struct(F.lit(p), F.try_variant_get(v, f'$["{p}"]', "array<double>")) for p in props]))
    return F.map_filter(got, lambda k, x: (F.size(x) > 0) & F.forall(x, lambda y: y.isNotNull()))


@pandas_udf(StringType())
def _without(text: pd.Series, props: pd.Series) -> pd.Series:
    def strip(x: object, gone: set[str]) -> object:
        if isinstance(x, dict):
            return {k: strip(y, gone) for k, y in x.items() if k not in gone}
        return [strip(y, gone) for y in x] if isinstance(x, list) else x

    return pd.Series([None if t is None else json.dumps(strip(json.loads(t), set(p))) for t, p in zip(text, props)])


def strip_vectors(document: Column, props: list[str]) -> Column:
    """The JSON document without its vector properties, at any depth."""
    return _without(document, F.array(*[F.lit(p) for p in props]).cast("array<string>"))
