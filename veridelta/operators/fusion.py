"""Fusion of opinions by group.

The cumulative and averaging forms are sums, so Spark combines them before the shuffle; only base rates, and groups with dogmatic
opinions (u = 0), depend on order. Robust fusion removes agents one at a time and runs by group over its array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from veridelta.functions import opinion as O

KINDS = "struct<b:double,d:double,u:double,a:double>"


def cumulative_sums(o: Column) -> dict[str, Column]:
    """The mergeable parts of cumulative fusion, for groupBy().agg()."""
    inverse = F.when(o["u"] > 0, 1 / o["u"])
    return {"n": F.count(o["u"]), "zeros": F.count_if(o["u"] == 0), "iu": F.sum(inverse), "b": F.sum(o["b"] * inverse), "d": F.sum(o["d"] * inverse), "zb": F.avg(F.when(o["u"] == 0, o["b"])), "zd": F.avg(F.when(o["u"] == 0, o["d"])), "a": F.avg(o["a"])}


def cumulative_fuse(df: DataFrame, by: list[str], opinion: str = "opinion", order: str | None = None) -> DataFrame:
    """(by..., opinion): one cumulative opinion for each group.

    With an order the result equals the left fold in that order whatever the group holds. Without, groups are combined in sums: the base
    rate is then the mean, which is the fold's if base rates are equal or the group has two, and dogmatic opinions are averaged."""
    o = F.col(opinion)
    if order is not None:
        rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), o.alias("_x"))))
        return df.where(o.isNotNull()).groupBy(*by).agg(rows.alias("_r")).select(*by, O.cumulative_array(F.transform("_r", lambda r: r["_x"])).alias(opinion))
    s = df.where(o.isNotNull()).groupBy(*by).agg(*[c.alias(f"_{k}") for k, c in cumulative_sums(o).items()])
    u = 1 / (1 + F.col("_iu") - F.col("_n"))
    fused = F.when(F.col("_zeros") > 0, O.opinion(F.col("_zb"), F.col("_zd"), 0.0, F.col("_a"))).otherwise(O.opinion(u * F.col("_b"), u * F.col("_d"), u, F.col("_a")))
    return s.select(*by, fused.alias(opinion))


def averaging_fuse(df: DataFrame, by: list[str], opinion: str = "opinion") -> DataFrame:
    """(by..., opinion): one averaging opinion for each group, whatever the order."""
    o = F.col(opinion)
    s = df.where(o.isNotNull()).groupBy(*by).agg(*[c.alias(f"_{k}") for k, c in cumulative_sums(o).items()])
    fused = F.when(F.col("_zeros") > 0, O.opinion(F.col("_zb"), F.col("_zd"), 0.0, F.col("_a"))).otherwise(O.opinion(F.col("_b") / F.col("_iu"), F.col("_d") / F.col("_iu"), F.col("_n") / F.col("_iu"), F.col("_a")))
    return s.select(*by, fused.alias(opinion))


def fuse_scalars(df: DataFrame, by: list[str], score: str, fusion: str = "cumulative", order: str | None = None, base_rate: float = 0.5, uncertainty: float = 0.0) -> DataFrame:
    """Scores lifted to opinions and fused. Cumulative fusion of scores without an uncertainty reads what a score is short of 1 as uncertainty: (p, 0, 1 - p)."""
    c = F.col(score).cast("double")
    lifted = O.opinion(c, 0.0, 1 - c, base_rate) if fusion == "cumulative" and uncertainty == 0 else O.from_confidence(c, uncertainty, base_rate)
    rows = df.withColumn("opinion", lifted)
    return cumulative_fuse(rows, by, "opinion", order) if fusion == "cumulative" else averaging_fuse(rows, by, "opinion")


def meet(df: DataFrame, by: list[str], opinion: str = "opinion") -> DataFrame:
    """(by..., opinion): lawful where all are, violated where any is."""
    o = F.col(opinion)
    s = df.where(o.isNotNull()).groupBy(*by).agg(F.product(o["b"]).alias("_b"), F.product(1 - o["d"]).alias("_k"), F.product(o["a"]).alias("_a"))
    return s.select(*by, O.opinion(F.col("_b"), 1 - F.col("_k"), F.greatest(F.lit(0.0), F.col("_k") - F.col("_b")), F.col("_a")).alias(opinion))


def contamination(df: DataFrame, by: list[str], opinion: str = "opinion") -> DataFrame:
    """(by..., opinion): the residual risk from any of the ancestors; base rates are averaged."""
    o = F.col(opinion)
    s = df.where(o.isNotNull()).groupBy(*by).agg(F.product(o["b"]).alias("_b"), F.product(1 - o["d"]).alias("_k"), F.avg(o["a"]).alias("_a"))
    return s.select(*by, O.opinion(F.col("_b"), 1 - F.col("_k"), F.greatest(F.lit(0.0), F.col("_k") - F.col("_b")), F.col("_a")).alias(opinion))


def trust_chain(df: DataFrame, by: list[str], trust: str, final: str, order: str) -> DataFrame:
    """(by..., opinion): the last row's final opinion discounted by every trust opinion of the group."""
    t = F.col(trust)
    s = df.groupBy(*by).agg(F.product(t["b"]).alias("_t"), F.max_by(F.col(final), F.col(order)).alias("_o"))
    b, d = F.col("_t") * F.col("_o")["b"], F.col("_t") * F.col("_o")["d"]
    return s.select(*by, O.opinion(b, d, 1 - b - d, F.col("_o")["a"]).alias("opinion"))


def conflicts(df: DataFrame, by: list[str], key: str, opinion: str = "opinion", how: str | Callable | list[str] = "conflict", spread: int = 1) -> DataFrame:
    """(by..., i, j, score) for every pair of a group, i before j by key: conflict, or a distance by name; for a list of names, a column of each instead of score.

    spread: in so many parts a group's pairs are made, for groups that are few and large; one side is copied for each."""
    o = F.col(opinion)
    left = df.select(*by, F.col(key).alias("i"), o.alias("_x"), F.pmod(F.xxhash64(key), F.lit(spread)).alias("_s"))
    right = df.select(*[F.col(c).alias(f"_r{n}") for n, c in enumerate(by)], F.col(key).alias("j"), o.alias("_y"))
    if spread > 1:
        right = right.withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))
        left = left.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "_s")  # given, or few bytes with many pairs would be one task
    score = lambda h: O.pairwise_conflict(F.col("_x"), F.col("_y")) if h == "conflict" else O.distance(F.col("_x"), F.col("_y"), h)
    same = [F.col(c) == F.col(f"_r{n}") for n, c in enumerate(by)] + ([F.col("_s") == F.col("_t")] if spread > 1 else [])
    joined = left.join(right, reduce(lambda x, y: x & y, same, F.col("i") < F.col("j")))
    return joined.select(*by, "i", "j", *([score(h).alias(h) for h in how] if isinstance(how, list) else [score(how).alias("score")]))


def _hull(b: np.ndarray, d: np.ndarray) -> list[int]:
    """Positions of the corners of the points' convex hull."""
    order = np.lexsort((d, b)).tolist()
    xs, ys = b.tolist(), d.tolist()
    out: list[int] = []
    for way in (order, order[::-1]):
        chain: list[int] = []
        for k in way:
            x, y = xs[k], ys[k]
            while len(chain) > 1 and (xs[chain[-1]] - xs[chain[-2]]) * (y - ys[chain[-2]]) <= (ys[chain[-1]] - ys[chain[-2]]) * (x - xs[chain[-2]]):
                chain.pop()
            chain.append(k)
        out += chain[: max(1, len(chain) - 1)]
    return out


def _outer(b: np.ndarray, d: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Positions among which every row has the one of another key (h) that it conflicts with most: conflict is linear in either opinion, so that is a corner of the hull of the rows of other
    keys. Those are corners of all, or of what is left without the corners; or where a corner's key has further rows, of the hull without them. A part's outer rows contain those of the whole."""
    if len(b) <= 8:
        return np.arange(len(b))
    ok = np.isfinite(b) & np.isfinite(d)
    at, odd = np.flatnonzero(ok), np.flatnonzero(~ok)
    keep = [odd[:1], odd[h[odd] != h[odd[:1]]][:1]] if len(odd) else []
    if len(at):
        first = at[np.unique(_hull(b[at], d[at]))]
        left = np.setdiff1d(at, first)
        keep += [first, left[_hull(b[left], d[left])] if len(left) else left]
        keys, n = np.unique(h[at], return_counts=True)
        for k in np.intersect1d(h[first], keys[n > 1]):
            rest = at[h[at] != k]
            keep.append(rest[_hull(b[rest], d[rest])] if len(rest) else rest)
    return np.unique(np.concatenate(keep))


def _worst(b: np.ndarray, d: np.ndarray, h: np.ndarray) -> float | None:
    """The largest conflict of two rows of different keys."""
    tops = []
    for i in range(0, len(b), 512):
        j = slice(i, i + 512)
        apart = h[j, None] != h[None, :]
        if apart.any():
            tops.append(np.where(apart, b[j, None] * d[None, :] + d[j, None] * b[None, :], -np.inf).max())
    return float(np.max(tops)) if tops else None


def _outer_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        b, d, h = (x.column(c).to_numpy(zero_copy_only=False) for c in ("_b", "_d", "_h"))
        group = x.column("_g").to_numpy(zero_copy_only=False)
        order = np.argsort(group, kind="stable")
        edges = np.flatnonzero(np.diff(group[order])) + 1
        kept = [p if len(p) <= 8 else p[_outer(b[p], d[p], h[p])] for p in np.split(order, edges)]
        yield x.take(pa.array(np.sort(np.concatenate(kept)))) if len(order) else x


def _outer_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        lists = x.column("_r")
        rows, ends = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        b, d, h = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("_b", "_d", "_h"))
        kept, worst = [], []
        for i, j in zip(ends[:-1], ends[1:]):
            p = i + _outer(b[i:j], d[i:j], h[i:j])
            kept.append(p)
            worst.append(_worst(b[p], d[p], h[p]))
        at = np.concatenate([[0], np.cumsum([len(p) for p in kept])]).astype(np.int32)
        outer = pa.ListArray.from_arrays(pa.array(at), rows.take(pa.array(np.concatenate(kept))) if kept else rows)
        rest = [n for n in x.schema.names if n != "_r"]
        yield pa.RecordBatch.from_arrays([*[x.column(n) for n in rest], outer, pa.array(worst, pa.float64())], [*rest, "_r", "worst"])


def extremes(df: DataFrame, by: list[str], key: str, opinion: str = "opinion") -> DataFrame:
    """(by..., outer, worst): of each group the rows (k, b, d) among which any of its opinions has the one of another key that it conflicts with most, and the largest conflict of a pair.

    As conflicts(...) aggregated, without the pairs: batches are thinned out before the shuffle."""
    o = F.col(opinion)
    named = [F.col(c).alias(f"_by{n}") for n, c in enumerate(by)]
    rows = df.select(*named, F.xxhash64(*by).alias("_g"), F.col(key).alias("_k"), F.xxhash64(key).alias("_h"), o["b"].alias("_b"), o["d"].alias("_d"))
    rows = rows.dropna(subset=[c for c in rows.columns])
    thin = rows.mapInArrow(_outer_rows, rows.schema)
    groups = thin.groupBy(*[f"_by{n}" for n in range(len(by))]).agg(F.collect_list(F.struct("_k", "_h", "_b", "_d")).alias("_r"))
    got = groups.mapInArrow(_outer_groups, StructType([*groups.schema.fields, StructField("worst", DoubleType())]))
    outer = F.transform("_r", lambda r: F.struct(r["_k"].alias("k"), r["_b"].alias("b"), r["_d"].alias("d")))
    return got.select(*[F.col(f"_by{n}").alias(c) for n, c in enumerate(by)], outer.alias("outer"), "worst")


def cohesion(df: DataFrame, by: list[str], key: str, opinion: str = "opinion", how: str | Callable = "euclidean") -> DataFrame:
    """(by..., cohesion): 1 less the mean distance between a group's opinions; 1 for one opinion."""
    mean = conflicts(df, by, key, opinion, how).groupBy(*by).agg(F.avg("score").alias("_m"))
    every = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return every.join(mean, by, "left").select(*by, (1 - F.coalesce(F.col("_m"), F.lit(0.0))).alias("cohesion"))


def discord(df: DataFrame, by: list[str], opinion: str = "opinion") -> DataFrame:
    """df with each opinion's mean conflict with the others of its group, from sums alone."""
    o = F.col(opinion)
    s = df.groupBy(*by).agg(F.sum(o["b"]).alias("_sb"), F.sum(o["d"]).alias("_sd"), F.count(F.lit(1)).alias("_n"))
    total = o["b"] * (F.col("_sd") - o["d"]) + o["d"] * (F.col("_sb") - o["b"])
    return df.join(s, by).withColumn("discord", F.when(F.col("_n") > 1, total / (F.col("_n") - 1)).otherwise(0.0)).drop("_sb", "_sd", "_n")


STRATEGIES = ("most_conflicting", "least_trusted", "combined")


@dataclass(frozen=True)
class ByzantineConfig:
    """threshold: the discord from which an agent goes; max_removals: by default half of the agents; trust: the column of trust weights that the strategies least_trusted and combined need;
    min_agents: as many stay; distance: by which cohesion is measured."""

    threshold: float = 0.15
    max_removals: int | None = None
    strategy: str = "most_conflicting"
    trust: str | None = None
    min_agents: int = 2
    distance: str = "euclidean"

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"no strategy {self.strategy}")
        if self.strategy != "most_conflicting" and self.trust is None:
            raise ValueError(f"the strategy {self.strategy} needs trust weights")
        if self.distance not in O.DISTANCES:
            raise ValueError(f"no distance {self.distance}")


def _fold(x: np.ndarray) -> tuple[float, float, float, float]:
    b, d, u, a = x[0]
    for c in x[1:]:
        a = (a + c[3]) / 2
        if u == 0 and c[2] == 0:
            b, d = (b + c[0]) / 2, (d + c[1]) / 2
            continue
        k = u + c[2] - u * c[2]
        b, d, u = (b * c[2] + c[0] * u) / k, (d * c[2] + c[1] * u) / k, u * c[2] / k
    return float(b), float(d), float(u), float(a)


def remove_discordant(x: np.ndarray, trust: np.ndarray | None, config: ByzantineConfig) -> list[tuple[int, float, str]]:
    """(position, score, reason) of the agents that go, in that order."""
    left, gone = list(range(len(x))), []
    most = len(x) // 2 if config.max_removals is None else config.max_removals
    while len(left) > config.min_agents and len(left) > 1 and len(gone) < most:
        y = x[left]
        discord = (y[:, 0] * (y[:, 1].sum() - y[:, 1]) + y[:, 1] * (y[:, 0].sum() - y[:, 0])) / (len(left) - 1)
        score = discord
        if config.strategy == "least_trusted":
            k = int(np.lexsort((-discord, trust[left]))[0])
        elif config.strategy == "combined":
            score = discord * (1 - trust[left])
            k = int(np.argmax(score))
        else:
            k = int(np.argmax(discord))
        if discord[k] < config.threshold:
            break
        gone.append((left.pop(k), float(score[k]), config.strategy))
    return gone


def _apart(y: np.ndarray, how: str) -> float:
    """The mean distance of all pairs, taken in blocks of rows."""
    total, n = 0.0, len(y)
    for i in range(0, n - 1, 256):
        p, q = y[i : i + 256, None, :], y[None, i + 1 :, :]
        if how == "manhattan":
            d = np.abs(p - q).sum(2) / 2
        elif how == "hellinger":
            d = np.sqrt(((np.sqrt(p) - np.sqrt(q)) ** 2).sum(2) / 2)
        elif how == "jsd":
            m = (p + q) / 2
            with np.errstate(divide="ignore", invalid="ignore"):
                half = lambda z: np.where(z > 0, z * np.log2(z / m), 0.0).sum(2)
                d = np.sqrt(np.maximum(0, (half(p + 0 * q) + half(q + 0 * p)) / 2))
        else:
            d = np.sqrt(((p - q) ** 2).sum(2) / 2)
        total += float(np.triu(d).sum())
    return total / (n * (n - 1) / 2) if n > 1 else 0.0


#: What is made of a group, as Spark's and Arrow's types; agents are positions.
MADE = {k: (DoubleType(), pa.float64()) for k in ("b", "d", "u", "a", "cohesion")} | {k: (ArrayType(x), pa.list_(y)) for k, x, y in (("removed", IntegerType(), pa.int32()), ("discords", DoubleType(), pa.float64()), ("reasons", StringType(), pa.string()), ("surviving", IntegerType(), pa.int32()))}


def byzantine_fuse(df: DataFrame, by: list[str], key: str, opinion: str = "opinion", config: ByzantineConfig = ByzantineConfig()) -> DataFrame:
    """(by..., opinion, removed, discords, reasons, surviving, cohesion): agents in conflict with the rest go one by one, the others are fused in the order of key. A strategy that needs trust
    refuses agents without. The matrix of conflicts is conflicts(df, by, key)."""
    weight = F.col(config.trust) if config.trust else F.lit(None)
    if config.strategy != "most_conflicting":
        weight = F.when(weight.isNull(), F.raise_error(F.lit("an agent has no trust weight")).cast("double")).otherwise(weight)
    parts = F.struct(F.col(key).isNull().alias("_n"), F.col(key).alias("k"), *[F.col(opinion)[k].alias(k) for k in "bdua"], weight.cast("double").alias("t"))
    rows = df.where(F.col(opinion).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_list(parts)).alias("_r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # groups come as arrays, many at once: a call for each group takes longer than its agents
        made = pa.struct([(n, k) for n, (_, k) in MADE.items()])
        for batch in batches:
            lists = batch.column("_r")
            agents, ends = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            every = np.stack([agents.field(k).to_numpy(zero_copy_only=False) for k in "bdua"], 1).astype(float)
            trust = agents.field("t").to_numpy(zero_copy_only=False).astype(float)
            out = []
            for i, j in zip(ends[:-1], ends[1:]):
                x = every[i:j]
                gone = remove_discordant(x, trust[i:j], config)
                left = sorted(set(range(j - i)) - {k for k, _, _ in gone})
                b, d, u, a = _fold(x[left])
                out.append({"b": b, "d": d, "u": u, "a": a, "removed": [k for k, _, _ in gone], "discords": [s for _, s, _ in gone], "reasons": [r for _, _, r in gone], "surviving": left, "cohesion": 1 - _apart(x[left][:, :3], config.distance)})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, made)], [*batch.schema.names, "_f"])

    got = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("_f", StructType([StructField(n, k) for n, (k, _) in MADE.items()]))]))
    keys = lambda at: F.transform(F.col(f"_f.{at}"), lambda i: F.col("_r")[i]["k"])
    f = F.col("_f")
    return got.select(*by, O.opinion(f["b"], f["d"], f["u"], f["a"]).alias("opinion"), keys("removed").alias("removed"), f["discords"].alias("discords"), f["reasons"].alias("reasons"), keys("surviving").alias("surviving"), f["cohesion"].alias("cohesion"))


def robust_fuse(df: DataFrame, by: list[str], key: str, opinion: str = "opinion", max_removals: int | None = None, threshold: float = 0.15) -> DataFrame:
    return byzantine_fuse(df, by, key, opinion, ByzantineConfig(threshold, max_removals)).select(*by, "opinion", "removed")


def temporal_fuse(df: DataFrame, by: list[str], timestamp: str, reference: Column, half_life: Column | float, opinion: str = "opinion", method: str = "cumulative", order: str | None = None, decay: O.Decay | str = "exponential") -> DataFrame:
    """Opinions decayed by their age in seconds at the reference time, then fused. A timestamp after the reference is an error."""
    age = (F.unix_micros(reference.cast("timestamp")) - F.unix_micros(F.col(timestamp).cast("timestamp"))) / 1e6
    aged = df.withColumn(opinion, O.decay(F.col(opinion), age, half_life, decay))
    return cumulative_fuse(aged, by, opinion, order) if method == "cumulative" else averaging_fuse(aged, by, opinion)


def temporal_fuse_weighted(df: DataFrame, by: list[str], timestamp: str, source: str, half_lives: dict[str, float], reference: Column, default: float = 86400.0, **options: object) -> DataFrame:
    """temporal_fuse with a half-life for each source."""
    pairs = [F.lit(x) for k, v in half_lives.items() for x in (k, float(v))]
    h = F.coalesce(F.create_map(*pairs)[F.col(source)], F.lit(default)) if pairs else F.lit(default)
    return temporal_fuse(df, by, timestamp, reference, h, **options)


def temporal_byzantine_fuse(df: DataFrame, by: list[str], key: str, timestamp: str, reference: Column, half_life: Column | float, opinion: str = "opinion", config: ByzantineConfig = ByzantineConfig()) -> DataFrame:
    age = (F.unix_micros(reference.cast("timestamp")) - F.unix_micros(F.col(timestamp).cast("timestamp"))) / 1e6
    return byzantine_fuse(df.withColumn(opinion, O.decay(F.col(opinion), age, half_life)), by, key, opinion, config)


def fusion_report(df: DataFrame, by: list[str], key: str, method: str = "cumulative", opinion: str = "opinion", scores: bool = True) -> DataFrame:
    """(by..., opinion, input_count, opinions_fused, method, conflict_scores): fusion with what went into it; conflict scores are those of all pairs, in order of their keys. Without scores,
    which grow with the square of a group, there are pairs and worst, their number and the largest, instead."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("input_count"), F.count(opinion).alias("opinions_fused"))
    known = df.where(F.col(opinion).isNotNull())
    fused = cumulative_fuse(known, by, opinion, key) if method == "cumulative" else averaging_fuse(known, by, opinion)
    out = counts.join(fused, by, "left")
    head = [*by, opinion, "input_count", "opinions_fused", F.lit(method).alias("method")]
    if not scores:
        n = known.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.count(F.lit(1)).alias("_n")).groupBy(*by).agg(((F.sum("_n") * F.sum("_n") - F.sum(F.col("_n") * F.col("_n"))) / 2).cast("long").alias("pairs"))
        return out.join(n, by, "left").join(extremes(known, by, key, opinion).drop("outer"), by, "left").select(*head, F.coalesce("pairs", F.lit(0)).alias("pairs"), "worst")
    pairs = conflicts(known, by, key, opinion).groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "j", "score"))), lambda x: x["score"]).alias("conflict_scores"))
    return out.join(pairs, by, "left").select(*head, F.coalesce("conflict_scores", F.array().cast("array<double>")).alias("conflict_scores"))
