"""Scalar confidence: propagation along chains, combination of sources, resolution of conflicting assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridelta.functions import opinion as O

CLAMP = 1e-4


def noisy_or(c: Column) -> Column:
    return 1 - F.product(1 - c)


def propagated(c: Column, method: str = "multiply") -> Column:
    """Aggregate over a chain's confidences."""
    if method == "multiply":
        return F.product(c)
    if method == "min":
        return F.min(c)
    if method == "bayesian":
        p = F.greatest(F.lit(CLAMP), F.least(F.lit(1 - CLAMP), c))
        return 1 / (1 + F.exp(-F.sum(F.log(p / (1 - p)))))
    if method == "dampened":
        p = F.product(c)
        return F.when(p == 0, 0.0).otherwise(F.pow(p, 1 / F.sqrt(F.count(c))))
    raise ValueError(f"unknown method {method}")


def combined(c: Column, method: str = "noisy_or") -> Column:
    """Aggregate over independent sources' confidences. Dempster-Shafer with masses (p, 1 - p) is noisy-OR."""
    if method in ("noisy_or", "dempster_shafer"):
        return noisy_or(c)
    if method in ("average", "max"):
        return F.avg(c) if method == "average" else F.max(c)
    raise ValueError(f"unknown method {method}")


def aggregated(c: Column, strategy: str = "mean", weight: Column | None = None) -> Column:
    """mean, max, min or weighted; 0 for none, and an unknown strategy is the mean."""
    if strategy == "weighted":
        if weight is None:
            raise ValueError("a weighted mean needs weights")
        return F.coalesce(F.sum(c * weight) / F.sum(weight), F.lit(0.0))
    return F.coalesce({"max": F.max, "min": F.min}.get(strategy, F.avg)(c), F.lit(0.0))


def propagate_confidence(df: DataFrame, by: list[str], confidence: str, method: str = "multiply") -> DataFrame:
    return df.groupBy(*by).agg(propagated(F.col(confidence).cast("double"), method).alias("score"))


def combine_sources(df: DataFrame, by: list[str], confidence: str, method: str = "noisy_or") -> DataFrame:
    return df.groupBy(*by).agg(combined(F.col(confidence).cast("double"), method).alias("score"))


def resolve_conflict(df: DataFrame, by: list[str], value: str, confidence: str, order: str, strategy: str = "highest", recency: str | None = None) -> DataFrame:
    """(by..., value, confidence, candidates): the winning assertion of each group.

    highest: greatest confidence; weighted_vote: the value of greatest noisy-OR, which becomes the winner's confidence, and equal votes go to the
    value seen first; recency: greatest recency, then confidence. Other ties go to the first by order."""
    c = F.col(confidence).cast("double")
    every = Window.partitionBy(*by)
    if strategy == "highest":
        rank = [F.desc("_c"), F.asc("_o")]
    elif strategy == "recency":
        rank = [F.desc_nulls_last("_t"), F.desc("_c"), F.asc("_o")]
    elif strategy != "weighted_vote":
        raise ValueError(f"unknown strategy {strategy}")
    rows = df.select(*by, F.col(value).alias("value"), c.alias("_c"), F.col(order).alias("_o"), (F.col(recency) if recency else F.lit(None)).alias("_t"))
    if strategy != "weighted_vote":
        ranked = rows.select("*", F.row_number().over(every.orderBy(*rank)).alias("_k"), F.count(F.lit(1)).over(every).alias("candidates"))
        return ranked.where("_k = 1").select(*by, "value", F.col("_c").alias("confidence"), "candidates")
    votes = rows.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("_n"), F.max("_c").alias("_m"), noisy_or(F.col("_c")).alias("_v"), F.min("_o").alias("_f"))
    votes = votes.withColumn("_s", F.when(F.col("_n") == 1, F.col("_m")).otherwise(F.col("_v")))
    ranked = votes.select("*", F.row_number().over(every.orderBy(F.desc("_s"), F.asc("_f"))).alias("_k"), F.sum("_n").over(every).alias("candidates"))
    return ranked.where("_k = 1").select(*by, "value", F.col("_s").alias("confidence"), "candidates")


def propagate_path(start: DataFrame, edges: DataFrame, chain: list[str], method: str = "multiply") -> DataFrame:
    """(start, node, score): nodes reached from start(node) by edges(source, prop, target, confidence) along a chain of properties; an edge without confidence counts as 1."""
    at = start.select(F.col("node").alias("start"), F.col("node"), F.array().cast("array<double>").alias("_c"))
    for prop in chain:
        step = edges.where(F.col("prop") == prop).select(F.col("source").alias("node"), "target", F.coalesce(F.col("confidence"), F.lit(1.0)).alias("_e"))
        at = at.join(step, "node").select("start", F.col("target").alias("node"), F.array_append("_c", F.col("_e")).alias("_c"))
    logit = lambda x: F.log(F.greatest(F.lit(CLAMP), F.least(F.lit(1 - CLAMP), x)) / (1 - F.greatest(F.lit(CLAMP), F.least(F.lit(1 - CLAMP), x))))
    product = F.aggregate("_c", F.lit(1.0), lambda x, y: x * y)
    score = {"multiply": product, "min": F.array_min("_c"), "bayesian": 1 / (1 + F.exp(-F.aggregate(F.transform("_c", logit), F.lit(0.0), lambda x, y: x + y))), "dampened": F.when(product == 0, 0.0).otherwise(F.pow(product, 1 / F.sqrt(F.size("_c"))))}[method]
    return at.select("start", "node", score.alias("score"))


def propagate_opinions(df: DataFrame, by: list[str], confidence: str, trust_uncertainty: float = 0.0, base_rate: float = 0.0) -> DataFrame:
    """(by..., opinion): certainty seen through a chain of sources, each trusted by its confidence; without uncertainty of trust the projected probability is the product of confidences."""
    b = F.product(F.col(confidence).cast("double") * (1 - trust_uncertainty))
    return df.groupBy(*by).agg(b.alias("_b")).select(*by, O.opinion(F.col("_b"), 0.0, 1 - F.col("_b"), base_rate).alias("opinion"))


def resolve_with_opinions(df: DataFrame, by: list[str], value: str, confidence: str, order: str, strategy: str = "highest", recency: str | None = None) -> DataFrame:
    """resolve_conflict with the winner's confidence as a certain opinion beside it (one half where it has none)."""
    return resolve_conflict(df, by, value, confidence, order, strategy, recency).withColumn("opinion", O.from_confidence(F.coalesce("confidence", F.lit(0.5))))


def conflict_report(df: DataFrame, by: list[str], value: str, confidence: str, order: str, strategy: str = "highest", recency: str | None = None) -> DataFrame:
    """(by..., value, confidence, candidates, scores, reason): the winner with the best confidence of every value, and why it won."""
    best = df.groupBy(*by, F.col(value).alias("_v")).agg(F.max(confidence).alias("_m")).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("_v").alias("value"), F.col("_m").alias("confidence")))).alias("scores"))
    won = resolve_conflict(df, by, value, confidence, order, strategy, recency)
    why = F.when(F.col("candidates") == 1, F.lit("the only candidate")).otherwise(F.lit({"highest": "highest confidence", "weighted_vote": "greatest combined confidence", "recency": "most recent"}[strategy]))
    return won.join(best, by).withColumn("reason", why)
