"""Inference over belief networks and trust networks, level by level.

nodes(node, opinion); edges(source, target, given, otherwise): the child's opinion if the parent holds or not. tables(target, parents, states, given): a full conditional table, a row for
each configuration of the parents. trust(source, target, opinion). Each level is written to the shared folder once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridelta.functions import opinion as O
from veridelta.operators.fusion import averaging_fuse, cumulative_fuse
from veridelta.operators.durable import cut


class CycleError(ValueError):
    """The edges are no acyclic graph."""


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): the longest way from a root. A cycle is an error."""
    e = edges.select("source", "target").distinct()
    front = cut(nodes.select("node").join(e.select(F.col("target").alias("node")), "node", "left_anti").distinct())
    out, level, most = front.withColumn("level", F.lit(0)), 0, nodes.select("node").distinct().count()
    while not front.isEmpty():
        level += 1
        if level > most:
            raise CycleError("the edges close a cycle")
        front = cut(front.join(e, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct())
        out = out.unionByName(front.withColumn("level", F.lit(level)))
    got = cut(out.groupBy("node").agg(F.max("level").alias("level")))
    if not nodes.select("node").join(got, "node", "left_anti").isEmpty():  # what no root leads to lies on a cycle or behind one
        raise CycleError("the edges close a cycle")
    return got


def is_tree(edges: DataFrame) -> bool:
    return edges.groupBy("target").count().where("count > 1").isEmpty()


class NodeNotFoundError(KeyError):
    """An edge, or a query, names a node that is not there."""


#: Parents of a full conditional table at most, as 2 to their number rows are needed.
MOST_PARENTS = 20


def infer(nodes: DataFrame, edges: DataFrame, counterfactual: str = "vacuous", method: str = "auto", tables: DataFrame | None = None) -> DataFrame:
    """(node, opinion): roots keep theirs; a node with one parent is deduced; with several, each deduction is made apart and all are fused in the order of the parents (method approximate; exact
    refuses such nodes). A target of tables is found by enumeration of its configurations, each weighted by its parents' projected probabilities."""
    return trace(nodes, edges, counterfactual, method, tables).select("node", "opinion")


def trace(nodes: DataFrame, edges: DataFrame, counterfactual: str = "vacuous", method: str = "auto", tables: DataFrame | None = None) -> DataFrame:
    """(node, step, operation, inputs, opinion): what infer does; step counts the levels, operation is passthrough, deduce, fuse or enumerate, inputs are the parents.

    One pass: opinions travel along the edges of the nodes that were last known, and a node is known when all its parents are."""
    if method == "exact" and (tables is not None or not is_tree(edges)):
        raise ValueError("exact inference needs nodes of one parent at most")
    none = F.lit(None).cast(O.SCHEMA)
    otherwise = F.coalesce("otherwise", O.COUNTERFACTUALS[counterfactual](F.col("given"))) if "otherwise" in edges.columns else O.COUNTERFACTUALS[counterfactual](F.col("given"))
    e = edges.select("source", "target", "given", otherwise.alias("otherwise"))
    if tables is not None:
        e = e.unionByName(tables.select(F.explode("parents").alias("source"), "target", none.alias("given"), none.alias("otherwise")).distinct())
    degree = e.groupBy("target").agg(F.count(F.lit(1)).alias("degree"))
    e = cut(e.join(degree, "target"))
    first = nodes.join(degree.select(F.col("target").alias("node")), "node", "left_anti").select("node", F.lit(0).alias("step"), F.lit("passthrough").alias("operation"), F.array().cast("array<string>").alias("inputs"), "opinion")
    known = cut(first)
    done, waiting, step, n = known, None, 0, nodes.select("node").distinct().count()
    plan = None
    if tables is not None:
        bad = tables.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("parents")).alias("k"), F.min(F.size("parents")).alias("least")).where(f"k <> least OR k > {MOST_PARENTS} OR n <> power(2, k)")
        if not bad.isEmpty():
            raise ValueError(f"a conditional table is not complete, or has more than {MOST_PARENTS} parents")
        plan = tables.groupBy("target").agg(F.collect_list(F.struct("parents", "states", "given")).alias("_rows"))
    while not known.isEmpty():
        step += 1
        sent = known.select(F.col("node").alias("source"), F.col("opinion").alias("_p")).join(e, "source")
        sent = sent.select("target", "degree", "source", F.when(F.col("given").isNotNull(), O.deduce(F.col("_p"), F.col("given"), F.col("otherwise"))).otherwise(F.col("_p")).alias("o"), F.col("given").isNull().alias("raw"))
        sent = cut(sent if waiting is None else sent.unionByName(waiting))
        ready = sent.groupBy("target").agg(F.max("degree").alias("degree"), F.sort_array(F.collect_list(F.struct("source", "o", "raw"))).alias("m")).where(F.size("m") == F.col("degree"))
        pairs = F.filter("m", lambda x: ~x["raw"])
        fused = O.cumulative_array(F.transform(pairs, lambda x: x["o"]))
        found, operation = fused, F.when(F.size("m") == 1, "deduce").otherwise("fuse")
        if plan is not None:
            ready = ready.join(plan, "target", "left")
            by = F.map_from_entries(F.transform(F.filter("m", lambda x: x["raw"]), lambda x: F.struct(x["source"], O.projected(x["o"]))))
            weight = lambda r: F.aggregate(F.zip_with(r["parents"], r["states"], lambda p, s: F.when(s, by[p]).otherwise(1 - by[p])), F.lit(1.0), lambda x, y: x * y)
            sums = lambda f: F.aggregate(F.transform("_rows", lambda r: weight(r) * f(r["given"])), F.lit(0.0), lambda x, y: x + y)
            whole = O.opinion(sums(lambda g: g["b"]), sums(lambda g: g["d"]), sums(lambda g: g["u"]), F.greatest(F.lit(0.0), F.least(F.lit(1.0), sums(O.projected))))
            found = F.when(F.col("_rows").isNotNull(), whole).otherwise(fused)
            operation = F.when(F.col("_rows").isNotNull(), "enumerate").otherwise(operation)
        known = cut(ready.select(F.col("target").alias("node"), F.lit(step).alias("step"), operation.alias("operation"), F.transform("m", lambda x: x["source"].cast("string")).alias("inputs"), found.cast(O.SCHEMA).alias("opinion")))
        waiting = sent.join(known.select(F.col("node").alias("target")), "target", "left_anti")
        done = done.unionByName(known)
    if done.select("node").distinct().count() < n:
        missing = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).join(nodes.select("node"), "node", "left_anti").first()
        if missing is not None:
            raise NodeNotFoundError(missing[0])
        raise CycleError("the edges close a cycle")
    return done


def propagate_trust(trust: DataFrame, agents: DataFrame, method: str = "cumulative") -> DataFrame:
    """(agent, target, opinion, paths): what each of agents(node) may trust over all simple paths, however long, fused in order of the paths. Nothing is cut; as there can be exponentially many
    simple paths in a dense network, that is what bounds its size."""
    e = trust.select(F.col("source").alias("_s"), F.col("target").alias("_t"), F.col("opinion").alias("_o"))
    path = cut(agents.select(F.col("node").alias("agent")).join(e, F.col("agent") == F.col("_s")).where("_s <> _t").select("agent", F.col("_t").alias("target"), F.col("_o").alias("opinion"), F.array("_s", "_t").alias("path")))
    found = path
    while not path.isEmpty():
        step = path.join(e, F.col("target") == F.col("_s")).where(~F.array_contains("path", F.col("_t")))
        path = cut(step.select("agent", F.col("_t").alias("target"), O.trust_discount(F.col("opinion"), F.col("_o")).alias("opinion"), F.array_append("path", F.col("_t")).alias("path")))
        found = found.unionByName(path)
    keyed = found.withColumn("_k", F.struct(F.size("path"), "path"))
    counts = found.groupBy("agent", "target").agg(F.count(F.lit(1)).alias("paths"))
    fused = cumulative_fuse(keyed, ["agent", "target"], "opinion", "_k") if method == "cumulative" else averaging_fuse(keyed, ["agent", "target"])
    return fused.join(counts, ["agent", "target"])


def infer_with_trust(nodes: DataFrame, edges: DataFrame, trust: DataFrame, attestations: DataFrame, agent: str, trust_fusion: str = "cumulative", content_fusion: str = "cumulative", counterfactual: str = "vacuous") -> DataFrame:
    """(node, opinion) of all content as an agent sees it: attestations are discounted by the trust that reaches their agents and fused, take the place of the content's own opinions, and inference goes on from there."""
    me = trust.sparkSession.createDataFrame([(agent,)], "node string")
    seen = attested(attestations, propagate_trust(trust, me, trust_fusion), agent, content_fusion)
    content = nodes.join(seen.select(F.col("content").alias("node"), F.col("opinion").alias("_seen")), "node", "left")
    return infer(content.select("node", F.coalesce("_seen", "opinion").alias("opinion")), edges, counterfactual)


def attested(attestations: DataFrame, trusts: DataFrame, agent: str, method: str = "cumulative") -> DataFrame:
    """(content, opinion): attestations(agent, content, opinion) discounted by the agent's derived trust (its own count in full, unreachable agents' are vacuous) and fused by agent."""
    t = trusts.where(F.col("agent") == agent).select(F.col("target").alias("_a"), F.col("opinion").alias("_t"))
    rows = attestations.join(t, F.col("agent") == F.col("_a"), "left")
    o = F.when(F.col("agent") == agent, F.col("opinion")).when(F.col("_t").isNull(), O.vacuous(F.col("opinion")["a"])).otherwise(O.trust_discount(F.col("_t"), F.col("opinion")))
    rows = rows.select("content", "agent", o.alias("opinion"))
    return cumulative_fuse(rows, ["content"], "opinion", "agent") if method == "cumulative" else averaging_fuse(rows, ["content"])


def at_time(edges: DataFrame, at: Column) -> DataFrame:
    """Edges within their window, both ends included."""
    return edges.where((F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_until").isNull() | (F.col("valid_until") >= at)))


def decay_nodes(nodes: DataFrame, at: Column, half_life: float) -> DataFrame:
    """nodes(node, opinion, timestamp[, half_life]) aged to an instant; those without a time, or of the future, stay."""
    age = (F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("timestamp").cast("timestamp"))) / 1e6
    h = F.coalesce("half_life", F.lit(half_life)) if "half_life" in nodes.columns else F.lit(half_life)
    return nodes.withColumn("opinion", F.when(age >= 0, O.decay(F.col("opinion"), F.greatest(age, F.lit(0.0)), h)).otherwise(F.col("opinion")))


def to_dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line): Graphviz lines of a network, header and footer included."""
    spark = nodes.sparkSession
    n = nodes.select(F.lit(1).alias("o"), F.format_string('  "%s" [label="%s P=%.3f"];', F.col("node").cast("string"), F.col("node").cast("string"), O.projected(F.col("opinion"))).alias("line"))
    e = edges.select(F.lit(2).alias("o"), F.format_string('  "%s" -> "%s";', F.col("source").cast("string"), F.col("target").cast("string")).alias("line"))
    ends = spark.createDataFrame([(0, "digraph network {"), (3, "}")], "o int, line string")
    return ends.unionByName(n).unionByName(e).orderBy("o", "line").select("line")


def topological_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level, position): parents before children, ties by name."""
    lv = levels(nodes, edges)
    sizes = lv.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.alias("x").join(sizes.alias("y"), F.col("y.level") < F.col("x.level"), "left").groupBy("x.level").agg(F.coalesce(F.sum("y.n"), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("level").orderBy("node")) - 1  # one task for each level
    return lv.withColumn("within", within).join(before, "level").select("node", "level", (F.col("before") + F.col("within")).alias("position"))


def enumerate_parents(parents: DataFrame, table: DataFrame) -> DataFrame:
    """(target, opinion) by full conditional tables: table(target, config, parent, state, given) has a row for each parent of each configuration; parents(node, opinion).

    A configuration weighs the product of its parents' projected probabilities; a table that lacks configurations, or parents that have no opinion, is an error."""
    p = parents.select(F.col("node").alias("parent"), O.projected(F.col("opinion")).alias("_p"))
    rows = table.join(p, "parent", "left")
    known = F.when(F.col("_p").isNull(), F.raise_error(F.lit("a parent has no opinion")).cast("double")).otherwise(F.col("_p"))
    w = F.when(F.col("state"), known).otherwise(1 - known)
    each = rows.groupBy("target", "config").agg(F.product(w).alias("_w"), F.first("given").alias("_g"), F.count(F.lit(1)).alias("_k"))
    g = F.col("_g")
    s = each.groupBy("target").agg(F.count(F.lit(1)).alias("_n"), F.max("_k").alias("_k"), *[F.sum(F.col("_w") * g[x]).alias(x) for x in "bdu"], F.sum(F.col("_w") * O.projected(g)).alias("a"))
    full = F.when(F.col("_n") != F.pow(F.lit(2), F.col("_k")), F.raise_error(F.lit("a conditional table is not complete")).cast("double")).otherwise(F.col("b"))
    return s.select("target", O.opinion(full, F.col("d"), F.col("u"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("a")))).alias("opinion"))


def from_probabilities(table: DataFrame, probability: str, samples: str | int = 100) -> DataFrame:
    """table with given: conditional probabilities as opinions of so many samples (a column or a number)."""
    n = F.col(samples) if isinstance(samples, str) else F.lit(samples)
    return table.withColumn("given", O.from_evidence(F.col(probability) * n, (1 - F.col(probability)) * n))


def to_probabilities(edges: DataFrame, base_rate: float = 0.5) -> DataFrame:
    """(source, target, if_true, if_false): conditionals projected; without a counterfactual the base rate stands."""
    other = F.coalesce(O.projected(F.col("otherwise")), F.lit(base_rate)) if "otherwise" in edges.columns else F.lit(base_rate)
    return edges.select("source", "target", O.projected(F.col("given")).alias("if_true"), other.alias("if_false"))


def unroll(nodes: DataFrame, within: DataFrame, between: DataFrame, slices: int, seconds: float, start: Column) -> tuple[DataFrame, DataFrame]:
    """A dynamic network over time slices: nodes(node, opinion) and edges within a slice are repeated, edges between go from each slice to the next and hold for that time."""
    if slices < 2:
        raise ValueError("a dynamic network needs two slices at least")
    t = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    name = lambda c, i: F.concat(F.col(c), F.lit("_t"), i.cast("string"))
    when = lambda i: F.timestamp_micros((F.unix_micros(start.cast("timestamp")) + i * seconds * 1e6).cast("long"))
    n = nodes.withColumn("_i", t).select(name("node", F.col("_i")).alias("node"), "opinion", when(F.col("_i")).alias("timestamp"))
    none = F.lit(None).cast("timestamp")
    a = within.withColumn("_i", t).select(name("source", F.col("_i")).alias("source"), name("target", F.col("_i")).alias("target"), "given", none.alias("valid_from"), none.alias("valid_until"))
    b = between.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(slices - 2)))).select(name("source", F.col("_i")).alias("source"), name("target", F.col("_i") + 1).alias("target"), "given", when(F.col("_i")).alias("valid_from"), when(F.col("_i") + 1).alias("valid_until"))
    return n, a.unionByName(b)


def decay_edges(edges: DataFrame, at: Column, half_life: float) -> DataFrame:
    """edges(given[, otherwise], timestamp[, half_life]) aged to an instant; those without a time, or of the future, stay."""
    age = (F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("timestamp").cast("timestamp"))) / 1e6
    h = F.coalesce("half_life", F.lit(half_life)) if "half_life" in edges.columns else F.lit(half_life)
    old = lambda c: F.when(F.col(c).isNotNull() & (age >= 0), O.decay(F.col(c), F.greatest(age, F.lit(0.0)), h)).otherwise(F.col(c))
    return edges.withColumns({c: old(c) for c in ("given", "otherwise") if c in edges.columns})


def infer_at(nodes: DataFrame, edges: DataFrame, at: Column, half_life: float = 86400.0, what: str = "both", **options: str) -> DataFrame:
    """infer over nodes, edges or both aged to an instant."""
    n = decay_nodes(nodes, at, half_life) if what in ("both", "nodes") else nodes
    e = decay_edges(edges, at, half_life) if what in ("both", "edges") else edges
    return infer(n, e, **options)


def infer_difference(nodes: DataFrame, edges: DataFrame, t1: Column, t2: Column, **options: object) -> DataFrame:
    """(node, delta_belief, delta_disbelief, delta_uncertainty) between two instants."""
    x = infer_at(nodes, edges, t1, **options).withColumnRenamed("opinion", "_x")
    y = infer_at(nodes, edges, t2, **options).withColumnRenamed("opinion", "_y")
    return x.join(y, "node").select("node", *[(F.col("_y")[k] - F.col("_x")[k]).alias(n) for k, n in (("b", "delta_belief"), ("d", "delta_disbelief"), ("u", "delta_uncertainty"))])


def from_assertions(rows: DataFrame, edge_props: list[str], uncertainty: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an assertions table: a node's opinion is of its highest confidence, the values of edge properties name its parents."""
    nodes = rows.groupBy(F.col("node_id").alias("node")).agg(F.max("confidence").alias("_c"), F.max("as_of").alias("timestamp")).select("node", F.when(F.col("_c").isNotNull(), O.from_confidence(F.col("_c"), uncertainty)).otherwise(O.vacuous()).alias("opinion"), F.col("timestamp").cast("timestamp").alias("timestamp"))
    edges = rows.where(F.col("prop").isin(*edge_props)).select(F.col("value").alias("source"), F.col("node_id").alias("target"), O.from_confidence(F.coalesce("confidence", F.lit(1.0)), uncertainty).alias("given"))
    return nodes, edges
