"""Approximate nearest neighbours by a hierarchical k-means tree.

Each level of the tree is fitted by Lloyd iterations over all vectors: executors sum the vectors of every child, the
driver holds only centroids, of which there are as many as TREE_BYTES hold at most (65,536 of 64 dimensions). A search walks the tree best bin first, with a
priority queue of nodes by distance to their centroid. How many leaves it visits is widened until calibration queries, whose true
neighbours a full scan finds, reach the wanted recall by two standard errors. Queries are sent to the subtrees that hold leaves they
visit, each subtree once, and their best of every subtree are merged. Every row is in the index; a subtree of many vectors (a large table, or many copies of one vector) is
searched in chunks, and many queries in blocks, so no task holds more than a chunk and a block.

Distance is Euclidean, ties go to the lower id. Edge cases: a row without an id is left out; a null, empty, not finite or
odd-sized vector (its size is not the most frequent one) is no neighbour and finds none; rows of one id are queries each and never neighbours of that id, and repeated rows count once as
neighbours; fewer than k others give fewer neighbours; very long vectors make a smaller tree; columns other than these two are not looked at, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

K, RECALL = 10, 0.96
BRANCH, LEAF, ROUNDS = 16, 256, 3
#: Bytes of the leaves' centroids, which are broadcast; beyond them leaves grow.
TREE_BYTES = 16 << 20
#: Vectors that start the Lloyd iterations (for each leaf, and at least), queries that calibrate the search, vectors of a chunk of a subtree, and queries of a block.
SEEDS, LEAST_SEEDS, CALIBRATION, HELD, BLOCK = 2, 8192, 256, 1 << 15, 1 << 15


class Tree:
    """levels[i][p]: centroids of the children of node p of level i, all with as many children."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels

    def descend(self, x: np.ndarray, depth: int | None = None) -> np.ndarray:
        """The node of each vector at a depth (by default its leaf)."""
        node = np.zeros(len(x), np.int64)
        for level in self.levels[:depth]:
            new = np.zeros(len(x), np.int64)
            order = np.argsort(node, kind="stable")
            cut = np.flatnonzero(np.append(True, node[order][1:] != node[order][:-1])) if len(x) else []
            for a, b in zip(cut, np.append(cut[1:], len(x))):
                rows = order[a:b]
                c = level[node[rows[0]]]
                new[rows] = node[rows[0]] * len(c) + ((c**2).sum(1) - 2 * (x[rows] @ c.T)).argmin(1)
            node = new
        return node

    def visits(self, q: np.ndarray, most: int, until: set[int] | None = None) -> list[int]:
        """The first leaves of one query's best-bin-first walk, or as many as there are until all of some leaves were visited."""
        out: list[int] = []
        queue: list[tuple[float, int, int]] = [(0.0, 0, 0)]
        while queue and len(out) < most:
            _, depth, node = heapq.heappop(queue)
            if depth == len(self.levels):
                out.append(node)
                if until is not None:
                    until.discard(node)
                    if not until:
                        break
                continue
            c = self.levels[depth][node]
            for i, d in enumerate(((c - q) ** 2).sum(1).tolist()):
                if d < np.inf:
                    heapq.heappush(queue, (d, depth + 1, node * len(c) + i))
        return out


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(-1, dim)


def _level(rows: DataFrame, tree: Tree, seeds: np.ndarray, dim: int, branch: int) -> np.ndarray:
    """Centroids of the children of each node of the lowest level, after Lloyd iterations over all rows."""
    depth = len(tree.levels)
    nodes = tree.levels[-1].shape[0] * tree.levels[-1].shape[1] if depth else 1
    at = tree.descend(seeds)
    c = np.full((nodes, branch, dim), np.inf, np.float32)
    order = np.argsort(at, kind="stable")
    place = np.arange(len(order)) - np.searchsorted(at[order], at[order])
    some = place < branch
    c[at[order[some]], place[some]] = seeds[order[some]]
    bare = np.flatnonzero(np.isinf(c[:, 0, 0]))
    c[bare, 0] = tree.levels[-1].reshape(nodes, dim)[bare] if depth else 0
    spark = rows.sparkSession
    for _ in range(ROUNDS):
        held = spark.sparkContext.broadcast(Tree([*tree.levels, np.where(np.isinf(c), np.float32(1e15), c)]))

        def sums(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}
            for batch in batches:
                x = _matrix(batch.column(0), dim)
                leaf = held.value.descend(x)
                for n in np.unique(leaf).tolist():
                    part = x[leaf == n]
                    t = total.setdefault(n, [0, np.zeros(dim)])
                    t[0] += len(part)
                    t[1] += part.sum(0, dtype=float)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([t[0] for t in total.values()], pa.int64()), pa.array([t[1].tolist() for t in total.values()], pa.list_(pa.float64()))], ["node", "n", "s"])

        parts = rows.select("v").mapInArrow(sums, "node long, n long, s array<double>")
        got = parts.groupBy("node").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dim)]).alias("s")).collect()
        held.unpersist()
        for r in got:
            c[r.node // branch, r.node % branch] = np.array(r.s) / r.n
        seen = np.zeros((nodes, branch), bool)
        seen.ravel()[[r.node for r in got]] = True
        seen[~seen.any(1), 0] = True
        c[~seen] = np.inf  # a child without vectors is no child
    return c


def best(q: np.ndarray, qid: np.ndarray, v: np.ndarray, vid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances, ids) of each query's k nearest others, by rows; where there are fewer, infinite and -1."""
    n = min(len(v), k + 8)
    d = (v**2).sum(1)[None] - 2 * (q @ v.T)
    d[qid[:, None] == vid[None]] = np.inf
    near = np.argpartition(d, n - 1, 1)[:, :n] if len(v) > n else np.tile(np.arange(len(v)), (len(q), 1))
    exact = ((q[:, None].astype(float) - v[near]) ** 2).sum(2)
    ids = vid[near]
    exact[ids == qid[:, None]] = np.inf
    out = _first(exact, ids, k)
    if len(v) > n:  # rows that float32 can't tell from the k-th are all computed exactly
        top = np.sqrt((v**2).sum(1).max())
        error = np.finfo(np.float32).eps * (v.shape[1] + 8) * (top**2 + 2 * top * np.sqrt((q**2).sum(1)))
        limit = np.sort(np.take_along_axis(d, near, 1), 1)[:, k - 1] + 2 * error
        for i in np.flatnonzero((d <= limit[:, None]).sum(1) > n):
            c = np.flatnonzero((d[i] <= limit[i]) & (vid != qid[i]))
            out[0][i], out[1][i] = (x[0] for x in _first(((q[i].astype(float) - v[c]) ** 2).sum(1)[None], vid[c][None], k))
    return out


def _first(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, d), axis=1)[:, :k]
    d, ids = np.take_along_axis(d, order, 1), np.take_along_axis(ids, order, 1)
    ids = np.where(np.isinf(d), -1, ids)
    short = k - d.shape[1]
    return (np.pad(d, ((0, 0), (0, short)), constant_values=np.inf), np.pad(ids, ((0, 0), (0, short)), constant_values=-1)) if short > 0 else (d, ids)


def _truth(rows: DataFrame, q: np.ndarray, qid: np.ndarray, k: int, dim: int) -> np.ndarray:
    """The vectors of the true neighbours of some queries, by a scan of all rows; queries x k x dim, NaN where there are fewer."""
    held = rows.sparkSession.sparkContext.broadcast((q, qid))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, ids = held.value
        d, i = np.full((len(a), k), np.inf), np.full((len(a), k), -1)
        x: dict[int, np.ndarray] = {}
        for batch in batches:
            vid, v = batch.column(0).to_numpy(), _matrix(batch.column(1), dim)
            if not len(v):
                continue
            nd, ni = best(a, ids, v, vid, k)
            d, i = _first(np.hstack([d, nd]), np.hstack([i, ni]), k)
            x |= dict(zip(vid.tolist(), v))
            keep = set(i.ravel().tolist())
            x = {n: y for n, y in x.items() if n in keep}
        out = [(n, float(d[n, j]), int(i[n, j]), x[int(i[n, j])].tobytes()) for n in range(len(a)) for j in range(k) if i[n, j] >= 0 or d[n, j] < np.inf]
        yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.binary()))], ["q", "d", "id", "v"])

    got = rows.select("vec_id", "v").mapInArrow(scan, "q long, d double, id long, v binary")
    lists = got.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "id", "v"))), 1, k).alias("x")).collect()
    out = np.full((len(q), k, dim), np.nan, np.float32)
    for r in lists:
        for j, y in enumerate(r.x):
            out[r.q, j] = np.frombuffer(y.v, np.float32)
    return out


def nearest(df: DataFrame, k: int = K, recall: float = RECALL, id_col: str = "vec_id", vector: str = "embedding", queries: Column | None = None) -> DataFrame:
    """(vec_id, neighbours, distances): for each row that is a query, by a condition on (vec_id) (by default all), the ids of its k nearest others among all rows, nearest first, and how far they are."""
    asks = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    spark = df.sparkSession
    vec = F.col(vector).cast("array<float>")
    clean = F.col("x").isNotNull() & ~F.exists("x", lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")))
    raw = df.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("x")).where("vec_id IS NOT NULL")
    raw = table(raw.select(F.monotonically_increasing_id().alias("row"), "vec_id", "x", (F.coalesce(clean, F.lit(False)) & (F.size("x") > 0)).alias("ok")), "ann-rows")
    sizes = raw.where("ok").groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return empty_rows(raw.where(asks), F.lit(False))
    dim, n = sizes[0], sizes[1]
    good = F.col("ok") & (F.size("x") == dim)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2)
            flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in flat], pa.binary())], ["row", "vec_id", "v"])

    rows = table(raw.where(good).select("row", "vec_id", "x").mapInArrow(pack, "row long, vec_id long, v binary"), "ann-vectors")
    few = lambda most, seed: rows.where(F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(1 << 30)) < int(min(1.0, 1.2 * most / n) * (1 << 30))).select("vec_id", "v").orderBy(F.xxhash64(F.lit(seed), "vec_id")).limit(most).toArrow()
    leaves = -(-n // LEAF)
    seeds = _matrix(few(max(LEAST_SEEDS, SEEDS * min(leaves, TREE_BYTES // (4 * dim))), 1)["v"].combine_chunks(), dim)
    if not len(seeds):
        seeds = _matrix(rows.limit(1).toArrow()["v"].combine_chunks(), dim)
    tree = Tree([])
    while BRANCH ** len(tree.levels) < leaves and 4 * dim * BRANCH ** (len(tree.levels) + 1) <= max(TREE_BYTES, 4 * dim * BRANCH):
        tree = Tree([*tree.levels, _level(rows, tree, seeds, dim, BRANCH)])
    tree = Tree([np.where(np.isinf(c), np.float32(1e15), c) for c in tree.levels])
    depth = next((i for i in range(len(tree.levels) + 1) if n / BRANCH**i <= HELD), len(tree.levels))
    under = BRANCH ** (len(tree.levels) - depth)

    probe = few(CALIBRATION, 2)
    if len(probe):
        q, qid = _matrix(probe["v"].combine_chunks(), dim), probe["vec_id"].to_numpy()
        truth = _truth(rows, q, qid, k, dim)
        total = BRANCH ** len(tree.levels)
        ranks = []
        for i in range(len(q)):
            there = tree.descend(truth[i][~np.isnan(truth[i, :, 0])]).tolist()
            order = {leaf: r for r, leaf in enumerate(tree.visits(q[i], total, set(there)))} if there else {}
            ranks += [order[x] for x in there]
        ranks.sort()
        sure = min(1.0, recall + 2 * (recall * (1 - recall) / len(q)) ** 0.5)
        visits = ranks[min(len(ranks) - 1, int(np.ceil(sure * len(ranks))))] + 1 if ranks else 1
    else:
        visits = BRANCH ** len(tree.levels)
    held = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = held.value.descend(_matrix(b.column(2), dim))
            yield pa.RecordBatch.from_arrays([pa.array(leaf // under), pa.array(leaf), b.column(1), b.column(2)], ["part", "leaf", "vec_id", "v"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(2), dim)
            part, at, lists = [], [], []
            for i in range(len(x)):
                by: dict[int, list[int]] = {}
                for leaf in held.value.visits(x[i], visits):
                    by.setdefault(leaf // under, []).append(leaf)
                part += by
                at += [i] * len(by)
                lists += by.values()
            rows_ = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *[b.column(c).take(rows_) for c in range(3)], pa.array(lists, pa.list_(pa.int64()))], ["part", "row", "vec_id", "v", "leaves"])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("d", pa.list_(pa.float64()))])
        if not len(left) or not len(right):
            return kind.empty_table()
        v, vid, leaf = _matrix(left["v"].combine_chunks(), dim), left["vec_id"].to_numpy(), left["leaf"].to_numpy()
        q, qid, row = _matrix(right["v"].combine_chunks(), dim), right["vec_id"].to_numpy(), right["row"].to_numpy()
        _, once = np.unique(np.stack([leaf, vid], 1), axis=0, return_index=True)
        v, vid, leaf = v[once], vid[once], leaf[once]
        lists = right["leaves"].combine_chunks()
        owner = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
        goal = lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
        d, ids = np.full((len(q), k), np.inf), np.full((len(q), k), -1)
        for x in np.unique(goal):
            mine, who = leaf == x, owner[goal == x]
            if not mine.any():
                continue
            for a in range(0, len(who), 4096):
                w = who[a : a + 4096]
                nd, ni = best(q[w], qid[w], v[mine], vid[mine], k)
                d[w], ids[w] = _first(np.hstack([d[w], nd]), np.hstack([ids[w], ni]), k)
        have = (~np.isinf(d)).ravel()
        off = pa.array(np.concatenate([[0], np.cumsum((~np.isinf(d)).sum(1))]).astype(np.int32))
        return pa.table([pa.array(row), pa.array(qid), pa.ListArray.from_arrays(off, pa.array(ids.ravel()[have])), pa.ListArray.from_arrays(off, pa.array(np.sqrt(d.ravel()[have])))], schema=kind)

    placed = rows.mapInArrow(place, "part long, leaf long, vec_id long, v binary")
    chunks = table(placed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / HELD).alias("chunks")), "ann-parts")
    asked = rows.where(asks)
    blocks = max(1, -(-asked.count() // BLOCK))
    routed = asked.mapInArrow(route, "part long, row long, vec_id long, v binary, leaves array<long>")
    routed = routed.join(chunks, "part").select("*", F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int"))).alias("chunk"), F.pmod(F.xxhash64("row"), F.lit(blocks).cast("long")).alias("block")).drop("chunks")
    chunk = F.pmod(F.xxhash64("vec_id", "v"), F.col("chunks")).cast("int").alias("chunk")  # repeated rows are in one chunk
    placed = placed.join(chunks, "part").select("part", "leaf", "vec_id", "v", chunk, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    at = ("part", "chunk", "block")
    found = placed.groupBy(*at).cogroup(routed.groupBy(*at)).applyInArrow(search, "row long, vec_id long, ids array<long>, d array<double>")
    each = F.flatten(F.collect_list(F.arrays_zip("d", "ids"))).alias("all")
    merged = found.groupBy("row", "vec_id").agg(each).select("vec_id", F.slice(F.array_sort(F.array_distinct("all")), 1, k).alias("x"))
    return merged.select("vec_id", F.col("x.ids").alias("neighbours"), F.col("x.d").alias("distances")).unionByName(empty_rows(raw.where(asks), good))


def empty_rows(raw: DataFrame, good: object) -> DataFrame:
    return raw.where(~good).select("vec_id", F.array().cast("array<long>").alias("neighbours"), F.array().cast("array<double>").alias("distances"))
