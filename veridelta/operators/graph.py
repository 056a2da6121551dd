"""Merge, difference and time slices of graphs in the long form of assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridelta.operators.inference import noisy_or

MISSING = 0.5


def merge_graphs(rows: DataFrame, strategy: str = "highest", combine: str = "noisy_or", keys: tuple[str, str] = ("node_id", "prop"), recency: str = "extracted_at") -> DataFrame:
    """(node_id, prop, value, confidence, outcome, candidates) of rows(node_id, prop, value, confidence, src_ord).

    outcome: single; agreed, where several sources state one value, with combined confidence rounded to 10 places; conflicted, settled by highest, weighted_vote or
    recency; or union, which keeps every value. A conflict takes a missing confidence as 0.5. Ties go to the first source."""
    k = list(keys)
    every = Window.partitionBy(*k)
    base = rows.select(*k, "value", F.col("confidence").cast("double").alias("confidence"), "src_ord", (F.col(recency) if recency in rows.columns else F.lit(None).cast("string")).alias("_t"))
    c = F.coalesce("confidence", F.lit(MISSING))
    counted = base.groupBy(*k, "value").agg(
        F.count(F.lit(1)).alias("_n"), F.count("confidence").alias("_m"), F.max("confidence").alias("_best"), F.max(c).alias("_c"),
        (F.max("confidence") if combine == "max" else F.avg("confidence") if combine == "average" else noisy_or(F.col("confidence"))).alias("_all"),
        noisy_or(c).alias("_vote"), F.min("src_ord").alias("_first"), F.min_by("src_ord", F.struct(-c, F.col("src_ord"))).alias("_o"),
        F.max(F.struct("_t", c.alias("c"), (-F.col("src_ord")).alias("o"))).alias("_r"),
    )
    counted = counted.withColumn("_kinds", F.count(F.lit(1)).over(every)).withColumn("candidates", F.sum("_n").over(every))
    agreed = F.when(F.col("_m") >= 2, F.round("_all", 10)).otherwise(F.col("_best"))
    vote = F.when(F.col("_n") == 1, F.col("_c")).otherwise(F.col("_vote"))
    order = {"highest": [F.desc("_c"), F.asc("_o")], "weighted_vote": [F.desc("_s"), F.asc("_first")], "recency": [F.desc_nulls_last("_r")], "union": [F.asc("_first")]}[strategy]
    ranked = counted.withColumn("_s", vote).withColumn("_k", F.row_number().over(every.orderBy(*order)))
    outcome = F.when(F.col("candidates") == 1, "single").when(F.col("_kinds") == 1, "agreed").otherwise("union" if strategy == "union" else "conflicted")
    settled = {"highest": F.col("_c"), "weighted_vote": F.col("_s"), "recency": F.col("_r.c"), "union": F.col("_best")}[strategy]
    confidence = F.when(F.col("candidates") == 1, F.col("_best")).when(F.col("_kinds") == 1, agreed).otherwise(settled)
    kept = ranked if strategy == "union" else ranked.where("_k = 1")
    return kept.select(*k, "value", confidence.alias("confidence"), outcome.alias("outcome"), "candidates")


def merge_report(merged: DataFrame, keys: tuple[str, str] = ("node_id", "prop")) -> DataFrame:
    """(nodes_merged, properties_agreed, properties_conflicted, properties_union); a union counts as conflicted too."""
    per = merged.select(*keys, "outcome").distinct()
    return per.agg(
        F.count_distinct(keys[0]).alias("nodes_merged"), F.count_if(F.col("outcome").isin("single", "agreed")).alias("properties_agreed"),
        F.count_if(F.col("outcome").isin("conflicted", "union")).alias("properties_conflicted"), F.count_if(F.col("outcome") == "union").alias("properties_union"),
    )


def diff_graphs(a: DataFrame, b: DataFrame, keys: tuple[str, str] = ("node_id", "prop"), value: str = "value") -> DataFrame:
    """(node_id, prop, change, old, new): added, removed, modified or unchanged; a null value counts as absent."""
    x = a.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("old"))
    y = b.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("modified")
    return x.join(y, list(keys), "full_outer").select(*keys, change.alias("change"), "old", "new")


def valid_at(start: Column, end: Column, at: Column) -> Column:
    """Within the window, both ends included; an open side is always within."""
    return (start.isNull() | (start <= at)) & (end.isNull() | (end >= at))


def add_temporal(value: Column, valid_from: Column | None = None, valid_until: Column | None = None, as_of: Column | None = None) -> Column:
    if all(x is None for x in (valid_from, valid_until, as_of)):
        raise ValueError("at least one bound is needed")
    none = F.lit(None).cast("timestamp")
    f, u = valid_from if valid_from is not None else none, valid_until if valid_until is not None else none
    ok = F.when(f > u, F.raise_error(F.lit("valid_from is after valid_until")).cast("timestamp")).otherwise(f)
    return F.struct(value.alias("value"), ok.alias("valid_from"), u.alias("valid_until"), (as_of if as_of is not None else none).alias("as_of"))


def query_at_time(rows: DataFrame, at: Column, prop: str | None = None, start: str = "valid_from", end: str = "valid_until") -> DataFrame:
    """The assertions that hold at an instant; with a property, others pass whatever their window."""
    ok = valid_at(F.col(start), F.col(end), at)
    return rows.where(ok if prop is None else (F.col("prop") != prop) | ok)


def temporal_diff(rows: DataFrame, t1: Column, t2: Column, keys: tuple[str, str] = ("node_id", "prop"), value: str = "value", order: str = "src_ord", start: str = "valid_from", end: str = "valid_until") -> DataFrame:
    """diff_graphs between the snapshots at two instants; where several values hold, the last by order stands."""
    snap = lambda t: query_at_time(rows, t, None, start, end).groupBy(*keys).agg(F.max_by(value, order).alias(value))
    return diff_graphs(snap(t1), snap(t2), keys, value)
