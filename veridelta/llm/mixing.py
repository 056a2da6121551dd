"""Mixing sources to target weights by entropy balancing.

Document rates r_i = exp(a[source] + b[language] + c z_i), z the standardised log of the token count, minimise
the token-weighted relative entropy to the corpus under token constraints: each source and each language
has its target share of the tokens, and the token-weighted mean of z stays as it is. Newton iterations
on the convex dual need a sum per (source, language) cell each, taken by the executors over the written table
of counts. The driver holds one number for each source, language and cell; as the sources' block of the system is diagonal, it is eliminated, and what is solved
has as many unknowns as there are languages (or sources, if these are fewer). Rates are
rounded into copies by a hash of the id, so that their expectation is the rate.

Edge cases: null source or language is a value of its own; null and empty texts have no tokens and weigh nothing,
their rate is that of their cell; repeated rows get equal copies; a target for a source that is absent is dropped and
the others are scaled; very long texts are documents like any other; ties do not arise; columns of other names, whatever they are, are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, keyed, table

NONE = "\x00none"


def token_count(text: Column) -> Column:
    """Runs of other than white space: each becomes one letter, and the white space goes."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, r"[^ \t\n\x0B\f\r]++", "x"), " \t\n\x0b\f\r", "")), F.lit(0))


def shares(tokens: dict[str, float], target: dict[str, float] | None, power: float) -> dict[str, float]:
    """Target shares that sum to 1 over the values that have tokens; without target, shares to the given power."""
    have = {k: v for k, v in tokens.items() if v > 0}
    want = {k: target.get(k, 0.0) for k in have} if target is not None else {k: v**power for k, v in have.items()}
    total = sum(want.values())
    if have and total <= 0:
        raise ValueError("no target weight falls on a value that has tokens")
    return {k: v / total for k, v in want.items()}


def balance(stats: DataFrame, source_target: dict[str, float] | None, lang_target: dict[str, float] | None, power: float, most: int = 60, tol: float = 1e-8) -> dict:
    """The dual's solution over stats(source, lang, tokens): {source: a}, {lang: b}, c, centre and spread of z, and the largest constraint error as a share."""
    z0 = F.log1p("tokens")
    w = F.col("tokens").cast("double")
    first = stats.groupBy("source", "lang").agg(F.sum(w).alias("m"), F.sum(w * z0).alias("z"), F.sum(w * z0 * z0).alias("zz")).collect()
    total = sum(r.m or 0 for r in first)
    if not total:
        return {"source": {}, "lang": {}, "z": 0.0, "mean": 0.0, "sd": 1.0, "error": 0.0, "iterations": 0}
    mean = sum(r.z for r in first) / total
    sd = max(1e-6, sum(r.zz for r in first) / total - mean**2) ** 0.5
    by: tuple[dict, dict] = ({}, {})
    for r in first:
        by[0][r.source] = by[0].get(r.source, 0) + r.m
        by[1][r.lang] = by[1].get(r.lang, 0) + r.m
    targets = shares(by[0], source_target, power), shares(by[1], lang_target, power)
    names = [(k, n) for k in (0, 1) for n in sorted(targets[k]) if targets[k][n] > 0]
    at = {x: i for i, x in enumerate(names)}
    wide = int(sum(k == 1 for k, _ in names) > sum(k == 0 for k, _ in names))  # the larger family is eliminated
    far = np.array([k == wide for k, _ in names] + [False])
    place = np.cumsum(far) - 1, np.cumsum(~far) - 1
    goal = np.array([targets[k][n] for k, n in names] + [0.0])
    dead = {(k, n) for k in (0, 1) for n in by[k] if targets[k].get(n, 0) <= 0}
    z = (z0 - F.lit(mean)) / F.lit(sd)

    def sums(x: np.ndarray) -> tuple[float, np.ndarray, list]:
        """Dual value, gradient and the Hessian's cells (source, language, their second moments) at x, in shares of the total."""
        spark = stats.sparkSession
        cells = spark.createDataFrame(
            [(s, l, float(x[at[0, s]] + x[at[1, l]])) for s, l in {(r.source, r.lang) for r in first} if (0, s) in at and (1, l) in at],
            "source string, lang string, level double",
        )
        m = w * F.exp(F.col("level") + F.lit(float(x[-1])) * z)
        rows = stats.join(cells, ["source", "lang"]).groupBy("source", "lang").agg(F.sum(m).alias("m"), F.sum(m * z).alias("z"), F.sum(m * z * z).alias("zz")).collect()
        g, h = np.zeros(len(x)), []
        for r in rows:
            i, j = at[0, r.source], at[1, r.lang]
            p, q, s = r.m / total, r.z / total, r.zz / total
            g[[i, j, -1]] += p, p, q
            h.append((i, j, p, q, s))
        return sum(r.m for r in rows) / total - float(goal @ x), g - goal, h

    def newton(g: np.ndarray, h: list) -> np.ndarray:
        """-H^-1 g: the larger family's block is diagonal, so the rest is solved by its Schur complement."""
        d, rest = np.zeros(int(far.sum())), np.zeros((int((~far).sum()),) * 2)
        rows: list[dict[int, float]] = [{} for _ in d]
        for i, j, p, q, s in h:
            a, b = (i, j) if wide == 0 else (j, i)
            a, b, k = int(place[0][a]), int(place[1][b]), len(rest) - 1
            d[a] += p
            rows[a][b] = rows[a].get(b, 0.0) + p
            rows[a][k] = rows[a].get(k, 0.0) + q
            rest[b, b] += p
            rest[b, k] += q
            rest[k, b] += q
            rest[k, k] += s
        d = np.maximum(d, 1e-300)
        gf, gr = g[far], g[~far].copy()
        for a, row in enumerate(rows):
            b, v = np.fromiter(row, int), np.fromiter(row.values(), float)
            rest[np.ix_(b, b)] -= np.outer(v, v) / d[a]
            gr[b] -= v * gf[a] / d[a]
        y = np.linalg.lstsq(rest + 1e-14 * np.eye(len(rest)), -gr, rcond=1e-12)[0]
        step = np.zeros(len(g))
        step[~far] = y
        step[far] = [-(gf[a] + sum(v * y[b] for b, v in row.items())) / d[a] for a, row in enumerate(rows)]
        return step

    x = np.zeros(len(goal))
    value, g, h = sums(x)
    done = 0
    while np.abs(g).max() > tol and done < most:
        done += 1
        step = newton(g, h)
        t = min(1.0, 3 / max(1e-9, float(np.abs(step).max())))
        while True:
            new = sums(x + t * step)
            if new[0] <= value + 1e-4 * t * float(g @ step) + 1e-12 or t < 1e-4:
                break
            t /= 2
        x = x + t * step
        value, g, h = new
        if abs(float(g @ step)) < 1e-16:
            break
    return {
        "source": {n: float(x[i]) for (k, n), i in at.items() if k == 0} | {n: None for k, n in dead if k == 0},
        "lang": {n: float(x[i]) for (k, n), i in at.items() if k == 1} | {n: None for k, n in dead if k == 1},
        "z": float(x[-1]), "mean": mean, "sd": sd, "error": float(np.abs(g).max()), "iterations": done,
    }


def rates(df: DataFrame, source_target: dict[str, float] | None = None, lang_target: dict[str, float] | None = None, power: float = 0.7, seed: int = 11) -> tuple[DataFrame, list[str], dict]:
    """df with (tokens, rate, copies), the names of these three, and the solution."""
    spark = df.sparkSession
    src, lng = F.coalesce(F.col("source").cast("string"), F.lit(NONE)), F.coalesce(F.col("lang").cast("string"), F.lit(NONE))
    stats = table(df.select(src.alias("source"), lng.alias("lang"), token_count(F.col("text")).alias("tokens")), "mix-counts")
    got = balance(stats, source_target, lang_target, power)
    tokens, rate, copies, s, l, a, b, sk, lk = fresh(df, "tokens", "rate", "copies", "source", "lang", "a", "b", "sk", "lk")
    kinds = "k string, v double, known boolean"
    left = spark.createDataFrame([(k, v, True) for k, v in got["source"].items()], kinds).toDF(s, a, sk)
    right = spark.createDataFrame([(k, v, True) for k, v in got["lang"].items()], kinds).toDF(l, b, lk)
    out = df.withColumns({s: src, l: lng, tokens: token_count(F.col("text"))})
    out = out.join(keyed(left), s, "left").join(keyed(right), l, "left")
    z = (F.log1p(F.col(tokens)) - F.lit(got["mean"])) / F.lit(got["sd"])
    known = F.coalesce(F.exp(F.col(a) + F.col(b) + F.lit(got["z"]) * z), F.lit(0.0))
    weightless = F.col(sk).isNull() | F.col(lk).isNull()  # values that have no tokens at all
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out = out.withColumn(rate, F.when(weightless, F.lit(1.0)).otherwise(known))
    out = out.withColumn(copies, F.floor(F.col(rate) + u).cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], tokens, rate, copies), [tokens, rate, copies], got


def mix(df: DataFrame, **options: object) -> DataFrame:
    """df with each row as often as its copies say."""
    out, (tokens, rate, copies), _ = rates(df, **options)
    (n,) = fresh(out, "n")
    return out.where(F.col(copies) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(n, tokens, rate, copies)
