"""Opinions over more than two states, as rows (by..., state, b, u, a): u is the same on every row of an opinion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridelta.functions import opinion as O


def from_evidence(counts: DataFrame, by: list[str], state: str, evidence: str) -> DataFrame:
    """The prior's weight falls from k towards 2 as evidence grows: W = (k + 2kR) / (1 + kR); base rates are even."""
    w = Window.partitionBy(*by)
    r, k, t = F.col(evidence).cast("double"), F.count(F.lit(1)).over(w), F.sum(F.col(evidence).cast("double")).over(w)
    rows = counts.select(*by, F.col(state).alias("state"), r.alias("_r"), k.alias("_k"), t.alias("_t"))
    weight = (F.col("_k") + 2 * F.col("_k") * F.col("_t")) / (1 + F.col("_k") * F.col("_t"))
    return rows.select(*by, "state", (F.col("_r") / (F.col("_t") + weight)).alias("b"), (weight / (F.col("_t") + weight)).alias("u"), (1 / F.col("_k")).alias("a"))


def projected(rows: DataFrame) -> DataFrame:
    return rows.withColumn("p", F.col("b") + F.col("a") * F.col("u"))


def coarsen(rows: DataFrame, by: list[str], focus: str) -> DataFrame:
    """(by..., opinion): the focus state against all others."""
    f = F.col("state") == focus
    s = rows.groupBy(*by).agg(F.sum(F.when(f, F.col("b")).otherwise(0.0)).alias("_b"), F.sum(F.when(~f, F.col("b")).otherwise(0.0)).alias("_d"), F.max("u").alias("_u"), F.max(F.when(f, F.col("a"))).alias("_a"))
    return s.select(*by, O.opinion(F.col("_b"), F.col("_d"), F.col("_u"), F.col("_a")).alias("opinion"))


def promote(df: DataFrame, by: list[str], opinion: str = "opinion", true: str = "T", false: str = "F") -> DataFrame:
    o = F.col(opinion)
    pair = F.array(F.struct(F.lit(true).alias("state"), o["b"].alias("b"), o["u"].alias("u"), o["a"].alias("a")), F.struct(F.lit(false).alias("state"), o["d"].alias("b"), o["u"].alias("u"), (1 - o["a"]).alias("a")))
    return df.select(*by, F.inline(pair))


def cumulative_fuse(rows: DataFrame, by: list[str]) -> DataFrame:
    """Fuses several opinions of a group over one domain; each opinion gives one row per state. Order-free: base rates are averaged."""
    w = F.when(F.col("u") > 0, 1 / F.col("u"))
    s = rows.groupBy(*by, "state").agg(F.count(F.lit(1)).alias("_n"), F.sum(w).alias("_iu"), F.sum(F.col("b") * w).alias("_b"), F.count_if(F.col("u") == 0).alias("_z"), F.avg(F.when(F.col("u") == 0, F.col("b"))).alias("_zb"), F.avg("a").alias("a"))
    u = F.when(F.col("_z") > 0, 0.0).otherwise(1 / (1 + F.col("_iu") - F.col("_n")))
    return s.select(*by, "state", F.when(F.col("_z") > 0, F.col("_zb")).otherwise(u * F.col("_b")).alias("b"), u.alias("u"), "a")


def deduce(parents: DataFrame, conditionals: DataFrame, by: list[str]) -> DataFrame:
    """conditionals(parent_state, state, b, u, a): the child's opinion given each state of the parent."""
    c = conditionals.select(F.col("parent_state").alias("_s"), F.col("state").alias("_y"), F.col("b").alias("_b"), F.col("u").alias("_u"), F.col("a").alias("_a"))
    p = parents.select(*by, F.col("state").alias("_s"), (F.col("b") + F.col("u") * F.col("a")).alias("_p"), F.col("a").alias("_w"))
    s = p.join(c, "_s")
    return s.groupBy(*by, F.col("_y").alias("state")).agg(F.sum(F.col("_p") * F.col("_b")).alias("b"), F.sum(F.col("_p") * F.col("_u")).alias("u"), F.sum(F.col("_w") * (F.col("_b") + F.col("_a") * F.col("_u"))).alias("a"))


def to_document(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., json): each opinion as a document, its states by name."""
    m = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("state", F.col(c)))))
    x = rows.groupBy(*by).agg(m("b").alias("beliefs"), F.max("u").alias("uncertainty"), m("a").alias("baseRates"))
    return x.select(*by, F.to_json(F.struct(F.lit("MultinomialOpinion").alias("@type"), "beliefs", "uncertainty", "baseRates")).alias("json"))


def from_document(docs: DataFrame, by: list[str], text: str = "json") -> DataFrame:
    """(by..., state, b, u, a); base rates under baseRates or base_rates, else even."""
    x = F.from_json(text, "beliefs map<string,double>, uncertainty double, baseRates map<string,double>, base_rates map<string,double>")
    rows = docs.select(*by, x.alias("x")).select(*by, F.explode("x.beliefs").alias("state", "b"), F.col("x.uncertainty").alias("u"), F.coalesce("x.baseRates", "x.base_rates").alias("r"), F.size("x.beliefs").alias("k"))
    return rows.select(*by, "state", "b", "u", F.coalesce(F.col("r")[F.col("state")], 1 / F.col("k")).alias("a"))


def is_valid(rows: DataFrame, by: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(by..., valid): two states or more, every part in [0, 1], beliefs and uncertainty summing to 1, and base rates too."""
    parts = F.bool_and(F.col("b").between(0.0, 1.0) & F.col("u").between(0.0, 1.0) & F.col("a").between(0.0, 1.0))
    sums = (F.abs(F.sum("b") + F.max("u") - 1) <= tolerance) & (F.abs(F.sum("a") - 1) <= tolerance) & (F.min("u") == F.max("u"))
    return rows.groupBy(*by).agg(F.coalesce(parts & sums & (F.count(F.lit(1)) >= 2), F.lit(False)).alias("valid"))
