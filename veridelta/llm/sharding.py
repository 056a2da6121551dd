"""Sharding by longest-processing-time scheduling.

Groups that must stay together (rows of equal key) are placed in order of falling size, each on the shard
that has least so far, ties to the lower shard. The driver runs the heap over the histogram of group sizes,
not over groups: while the shards it fills lie within one size of each other they are filled in turn, so a
run of equal groups is a few cycles, however long it is. Executors place each group by its number in its run. There are at most sqrt(2 b) different
sizes where sizes add up to b, and the driver holds one row for each.

Edge cases: rows of a null key are groups of their own, row by row; a null text counts no bytes; groups of equal size are
taken in order of a hash; repeated rows share their group; a very long text or a group larger than a shard's share is placed like any other; more shards than groups leaves shards empty;
columns that are not named are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: Groups of one size that a task numbers.
RUN = 1 << 20


def lpt_runs(histogram: list[tuple[int, int]], shards: int) -> tuple[list[tuple[int, list[tuple[int, list[int]]]]], list[int]]:
    """[(size, [(first rank, shards in turn)])] for [(size, number of groups)], and the loads at the end."""
    loads = [(0, k) for k in range(shards)]
    runs = []
    for size, count in sorted(histogram, reverse=True):
        parts: list[tuple[int, list[int]]] = []
        rank = 0
        if size <= 0:  # groups without weight leave every load as it is
            runs.append((size, [(0, [heapq.nsmallest(1, loads)[0][1]])]))
            continue
        heapq.heapify(loads)
        while rank < count:
            low = loads[0][0]
            if count - rank < 2 * shards:
                load, k = heapq.heappop(loads)
                heapq.heappush(loads, (load + size, k))
                parts.append((rank, [k]))
                rank += 1
                continue
            turn = sorted(x for x in loads if x[0] < low + size)
            rest = [x for x in loads if x[0] >= low + size]
            room = (min(rest)[0] - turn[0][0]) // size if rest else count
            cycles = min((count - rank) // len(turn), max(0, room - 1) if rest else count)
            if cycles < 1:
                load, k = heapq.heappop(loads)
                heapq.heappush(loads, (load + size, k))
                parts.append((rank, [k]))
                rank += 1
                continue
            parts.append((rank, [k for _, k in turn]))
            rank += cycles * len(turn)
            loads = [(x + cycles * size, k) for x, k in turn] + rest
            heapq.heapify(loads)
        runs.append((size, parts))
    return runs, [x for x, _ in sorted(loads, key=lambda p: p[1])]


def shard(df: DataFrame, shards: int, key: Column | None = None, size: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, shard, group_size). key: rows of equal key stay together (by default equal texts); size: a row's weight (by default the bytes of its text)."""
    spark = df.sparkSession
    own = F.sha2(F.col("text"), 256) if key is None else key.cast("string")
    weight = F.octet_length("text") if size is None else size
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("k"), own), F.concat(F.lit("i"), F.monotonically_increasing_id().cast("string"))).alias("key"),
        F.coalesce(weight, F.lit(0)).cast("long").alias("size"),
    )
    rows = table(rows, "shard-rows")
    groups = table(rows.groupBy("key").agg(F.sum("size").alias("group_size")), "shard-groups")
    histogram = [(r[0], r[1]) for r in groups.groupBy("group_size").count().collect()]  # as many rows as there are different sizes
    runs, _ = lpt_runs(histogram, shards)
    plan = spark.createDataFrame(runs, "group_size long, parts array<struct<first:long, turn:array<int>>>")
    # Numbers within a size: hash ranges are counted, and rows of one range are numbered after those of the ranges before it, so a size that many groups share is no one task's.
    slices = {size: -(-count // RUN) for size, count in histogram if count > RUN}
    many = F.coalesce(F.col("slices"), F.lit(1))
    cut = groups.join(spark.createDataFrame(list(slices.items()), "group_size long, slices long"), "group_size", "left").withColumn("slice", F.pmod(F.xxhash64("key"), many)).drop("slices")
    sizes = cut.groupBy("group_size", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("group_size").orderBy("slice")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("group_size", "slice").orderBy(F.xxhash64("key"), "key"))
    ranked = cut.withColumn("within", within).join(before, ["group_size", "slice"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    part = F.element_at(F.filter("parts", lambda p: p["first"] <= F.col("rank")), -1)
    placed = ranked.join(plan, "group_size").withColumn("part", part)
    turn = F.col("part.turn")
    placed = placed.select("key", "group_size", F.element_at(turn, ((F.col("rank") - F.col("part.first")) % F.size(turn) + 1).cast("int")).alias("shard"))
    return rows.join(placed, "key").select("doc_id", "shard", "group_size")
