"""Windowed fusion of a stream of opinions: the cumulative form is sums, so it merges in state and needs no buffer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.functions import opinion as O
from veridelta.operators.fusion import cumulative_sums


def windowed_fuse(stream: DataFrame, by: list[str], timestamp: str, window: str, late: str, opinion: str = "opinion", half_life: float | None = None) -> DataFrame:
    """(window, by..., opinion, events). Events later than the watermark are dropped; with a half-life each opinion ages to the end of its window, so that the result doesn't depend on when it is computed."""
    w = F.window(timestamp, window)
    rows = stream.withWatermark(timestamp, late).withColumn("window", w)
    if half_life is not None:
        age: Column = (F.unix_micros(F.col("window.end").cast("timestamp")) - F.unix_micros(F.col(timestamp).cast("timestamp"))) / 1e6
        rows = rows.withColumn(opinion, O.decay(F.col(opinion), age, half_life))
    g = rows.where(F.col(opinion).isNotNull()).groupBy("window", *by).agg(*[c.alias(f"_{k}") for k, c in cumulative_sums(F.col(opinion)).items()])
    u = 1 / (1 + F.col("_iu") - F.col("_n"))
    fused = F.when(F.col("_zeros") > 0, O.opinion(F.col("_zb"), F.col("_zd"), 0.0, F.col("_a"))).otherwise(O.opinion(u * F.col("_b"), u * F.col("_d"), u, F.col("_a")))
    return g.select("window", *by, fused.alias("opinion"), F.col("_n").alias("events"))
