"""A network as one immutable bundle of tables; changes give a new bundle, and every rule is checked by a job, not row by row on the driver.

nodes(node, kind, opinion, timestamp, half_life): kind is content or agent. edges(source, target, given, otherwise, timestamp, half_life, valid_from, valid_until). tables(target, parents, states,
given): full conditional tables. multinomial(source, target, state, outcome, b, u, a): the outcome's opinion for each state of the parent; multinomial_tables(target, parents, states, outcome,
b, u, a). trust(source, target, opinion). attestations(agent, content, opinion).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridelta.functions import opinion as O
from veridelta.operators import network

SCHEMAS = {
    "nodes": f"node string, kind string, opinion {O.SCHEMA}, timestamp timestamp, half_life double",
    "edges": f"source string, target string, given {O.SCHEMA}, otherwise {O.SCHEMA}, timestamp timestamp, half_life double, valid_from timestamp, valid_until timestamp",
    "tables": f"target string, parents array<string>, states array<boolean>, given {O.SCHEMA}",
    "multinomial": "source string, target string, state string, outcome string, b double, u double, a double",
    "multinomial_tables": "target string, parents array<string>, states array<string>, outcome string, b double, u double, a double",
    "trust": f"source string, target string, opinion {O.SCHEMA}",
    "attestations": f"agent string, content string, opinion {O.SCHEMA}",
}
#: Columns that name nodes, and those that tell rows of a table apart.
ENDS = {"edges": ("source", "target"), "tables": ("parents", "target"), "multinomial": ("source", "target"), "multinomial_tables": ("parents", "target"), "trust": ("source", "target"), "attestations": ("agent", "content")}
KEYS = {"nodes": ["node"], "edges": ["source", "target"], "tables": ["target", "states"], "multinomial": ["source", "target", "state", "outcome"], "multinomial_tables": ["target", "states", "outcome"], "trust": ["source", "target"], "attestations": ["agent", "content"]}


class DuplicateError(ValueError):
    """A row of this key is there already."""


def _shaped(df: DataFrame, kind: str) -> DataFrame:
    """df with exactly the columns of a table; those that are absent are null."""
    schema = df.sparkSession.createDataFrame([], SCHEMAS[kind]).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit("content") if f.name == "kind" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


@dataclass(frozen=True)
class Network:
    nodes: DataFrame
    edges: DataFrame
    tables: DataFrame
    multinomial: DataFrame
    multinomial_tables: DataFrame
    trust: DataFrame
    attestations: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, **tables: DataFrame) -> Network:
        """A network of the given tables, checked; those not given are empty."""
        empty = cls(**{k: spark.createDataFrame([], s) for k, s in SCHEMAS.items()})
        return reduce(lambda n, k: n.add(k, tables[k]), [k for k in SCHEMAS if k in tables], empty)

    # Changes

    def add(self, kind: str, rows: DataFrame) -> Network:
        """With more rows of a table. Repeated keys, ends that are no nodes, and cycles of deduction edges are errors; trust may run in cycles."""
        new = replace(self, **{kind: getattr(self, kind).unionByName(_shaped(rows, kind))})
        table = getattr(new, kind)
        if (twice := table.groupBy(*KEYS[kind]).count().where("count > 1").first()) is not None:
            raise DuplicateError(f"{kind}: {[twice[k] for k in KEYS[kind]]} is there already")
        if kind in ENDS:
            ends = [rows.select(F.explode(c).alias("node") if c == "parents" else F.col(c).alias("node")) for c in ENDS[kind]]
            if (lost := ends[0].unionByName(ends[1]).join(new.nodes.select("node"), "node", "left_anti").first()) is not None:
                raise network.NodeNotFoundError(lost[0])
            if kind not in ("trust", "attestations"):
                network.levels(new.content().select("node"), new.arrows())
        return new

    def add_nodes(self, rows: DataFrame) -> Network:
        return self.add("nodes", rows)

    def add_edges(self, rows: DataFrame) -> Network:
        return self.add("edges", rows)

    def add_agents(self, rows: DataFrame) -> Network:
        """rows(node[, opinion]); a kind other than agent is an error."""
        if "kind" in rows.columns and not rows.where("kind <> 'agent'").isEmpty():
            raise ValueError("an agent's kind has to be agent")
        return self.add("nodes", rows.withColumn("kind", F.lit("agent")))

    def add_trust(self, rows: DataFrame) -> Network:
        return self.add("trust", rows)

    def add_attestations(self, rows: DataFrame) -> Network:
        return self.add("attestations", rows)

    def remove_nodes(self, gone: DataFrame) -> Network:
        """Without nodes(node), and without everything that names one."""
        out = {"nodes": self.nodes.join(gone, "node", "left_anti")}
        for kind, ends in ENDS.items():
            df = getattr(self, kind)
            if "parents" in ends:
                hit = df.select("target", F.explode("parents").alias("node")).join(gone, "node", "left_semi").select("target").distinct()
                df = df.join(hit, "target", "left_anti")
                ends = ("target",)
            for c in ends:
                df = df.join(gone.select(F.col("node").alias(c)), c, "left_anti")
            out[kind] = df.select(*getattr(self, kind).columns)
        return replace(self, **out)

    def remove_edges(self, gone: DataFrame) -> Network:
        """Without edges(source, target)."""
        return replace(self, edges=self.edges.join(gone, ["source", "target"], "left_anti").select(*self.edges.columns))

    # What is there

    def arrows(self) -> DataFrame:
        """(source, target) of all edges of deduction, whatever their kind."""
        plain = [self.edges.select("source", "target"), self.multinomial.select("source", "target")]
        wide = [t.select(F.explode("parents").alias("source"), "target") for t in (self.tables, self.multinomial_tables)]
        return reduce(lambda a, b: a.unionByName(b), plain + wide).distinct()

    def agents(self) -> DataFrame:
        return self.nodes.where("kind = 'agent'")

    def content(self) -> DataFrame:
        return self.nodes.where("kind = 'content'")

    def node(self, name: str) -> DataFrame:
        return self.nodes.where(F.col("node") == name)

    def edge(self, source: str, target: str, kind: str = "edges") -> DataFrame:
        return getattr(self, kind).where((F.col("source") == source) & (F.col("target") == target))

    def table(self, target: str, kind: str = "tables") -> DataFrame:
        """The conditional table of a node of several parents (kind multinomial_tables: over several states)."""
        return getattr(self, kind).where(F.col("target") == target)

    def has_node(self, name: str) -> bool:
        return not self.node(name).isEmpty()

    def has_edge(self, source: str, target: str, kind: str = "edges") -> bool:
        return not self.edge(source, target, kind).isEmpty()

    def has_table(self, target: str, kind: str = "tables") -> bool:
        return not self.table(target, kind).isEmpty()

    def parents(self, name: str) -> DataFrame:
        return self.arrows().where(F.col("target") == name).select(F.col("source").alias("node"))

    def children(self, name: str) -> DataFrame:
        return self.arrows().where(F.col("source") == name).select(F.col("target").alias("node"))

    def roots(self) -> DataFrame:
        return self.content().select("node").join(self.arrows().select(F.col("target").alias("node")), "node", "left_anti")

    def leaves(self) -> DataFrame:
        return self.content().select("node").join(self.arrows().select(F.col("source").alias("node")), "node", "left_anti")

    def trust_from(self, agent: str) -> DataFrame:
        return self.trust.where(F.col("source") == agent)

    def attestations_for(self, content: str) -> DataFrame:
        return self.attestations.where(F.col("content") == content)

    def node_count(self) -> int:
        return self.nodes.count()

    def edge_count(self) -> int:
        """Edges of deduction; a conditional table counts once."""
        kinds = [self.edges.select("source", "target"), self.multinomial.select("source", "target").distinct(), self.tables.select("target").distinct(), self.multinomial_tables.select("target").distinct()]
        return sum(k.count() for k in kinds)

    def is_tree(self) -> bool:
        return network.is_tree(self.arrows())

    def is_dag(self) -> bool:
        try:
            network.levels(self.content().select("node"), self.arrows())
        except network.CycleError:
            return False
        return True

    def topological_order(self) -> DataFrame:
        return network.topological_order(self.content().select("node"), self.arrows())

    def trust_subgraph(self) -> Network:
        """Agents and their trust alone."""
        none = {k: getattr(self, k).limit(0) for k in ENDS if k != "trust"}
        return replace(self, nodes=self.agents(), **none)

    def content_subgraph(self) -> Network:
        """Content and its edges alone."""
        return replace(self, nodes=self.content(), trust=self.trust.limit(0), attestations=self.attestations.limit(0))

    # Inference

    def infer(self, counterfactual: str = "vacuous", method: str = "auto") -> DataFrame:
        return network.infer(self.content(), self.edges, counterfactual, method, None if self.tables.isEmpty() else self.tables)

    def steps(self, counterfactual: str = "vacuous", method: str = "auto") -> DataFrame:
        """(node, step, operation, inputs, opinion): how each opinion came about."""
        return network.trace(self.content(), self.edges, counterfactual, method, None if self.tables.isEmpty() else self.tables)

    def infer_at(self, at: Column, half_life: float = 86400.0, what: str = "both", **options: str) -> DataFrame:
        return network.infer_at(self.content(), network.at_time(self.edges, at), at, half_life, what, **options)

    def infer_difference(self, t1: Column, t2: Column, **options: object) -> DataFrame:
        return network.infer_difference(self.content(), self.edges, t1, t2, **options)

    def propagate_trust(self, agent: str, method: str = "cumulative") -> DataFrame:
        return network.propagate_trust(self.trust, self.node(agent).select("node"), method)

    def infer_with_trust(self, agent: str, **options: str) -> DataFrame:
        return network.infer_with_trust(self.content(), self.edges, self.trust, self.attestations, agent, **options)

    def infer_multinomial(self, roots: DataFrame) -> DataFrame:
        """(node, state, b, u, a) of the children of multinomial edges, from their parents' opinions roots(node, state, b, u, a): each outcome's mass is the parents' projected one of the conditionals."""
        p = roots.select(F.col("node").alias("source"), "state", (F.col("b") + F.col("a") * F.col("u")).alias("_p"))
        rows = self.multinomial.join(p, ["source", "state"])
        return rows.groupBy(F.col("target").alias("node"), F.col("outcome").alias("state")).agg(*[F.sum(F.col("_p") * F.col(k)).alias(k) for k in "bua"])

    # Rows of JSON, one for each node or edge: no part of the network has to fit on one machine.

    def to_lines(self) -> DataFrame:
        """(table, json)."""
        return reduce(lambda a, b: a.unionByName(b), [getattr(self, k).select(F.lit(k).alias("table"), F.to_json(F.struct("*")).alias("json")) for k in SCHEMAS])

    @classmethod
    def from_lines(cls, lines: DataFrame) -> Network:
        rows = lambda k: lines.where(F.col("table") == k).select(F.from_json("json", SCHEMAS[k]).alias("x")).select("x.*")
        return cls(**{k: rows(k) for k in SCHEMAS})

    def to_graph(self, inferred: DataFrame | None = None) -> DataFrame:
        """(node, json): linked-data nodes with their opinion and the edges from their parents; inferred(node, opinion) takes the place of the stored opinions."""
        n = self.content().select("node", "opinion")
        if inferred is not None:
            n = n.join(inferred.select("node", F.col("opinion").alias("_i")), "node", "left").select("node", F.coalesce("_i", "opinion").alias("opinion"))
        part = lambda o: F.when(o.isNotNull(), F.struct(F.lit("Opinion").alias("@type"), o["b"].alias("belief"), o["d"].alias("disbelief"), o["u"].alias("uncertainty"), o["a"].alias("baseRate")))
        e = self.edges.groupBy(F.col("target").alias("node")).agg(F.sort_array(F.collect_list(F.struct(F.col("source").alias("@id"), part(F.col("given")).alias("given"), part(F.col("otherwise")).alias("otherwise")))).alias("parentEdges"))
        return n.join(e, "node", "left").select("node", F.to_json(F.struct(F.col("node").alias("@id"), F.lit("SLNode").alias("@type"), part(F.col("opinion")).alias("opinion"), "parentEdges")).alias("json"))

    @classmethod
    def from_graph(cls, graph: DataFrame, text: str = "json") -> Network:
        o = "struct<belief:double,disbelief:double,uncertainty:double,baseRate:double>"
        x = graph.select(F.from_json(text, f"`@id` string, opinion {o}, parentEdges array<struct<`@id`:string,given:{o},otherwise:{o}>>").alias("x")).select("x.*")
        back = lambda c: F.when(c.isNotNull(), O.opinion(c["belief"], c["disbelief"], c["uncertainty"], F.coalesce(c["baseRate"], F.lit(0.5))))
        e = x.select(F.col("`@id`").alias("target"), F.explode("parentEdges").alias("e"))
        empty = cls(**{k: graph.sparkSession.createDataFrame([], s) for k, s in SCHEMAS.items()})
        return replace(empty, nodes=_shaped(x.select(F.col("`@id`").alias("node"), back(F.col("opinion")).alias("opinion")), "nodes"), edges=_shaped(e.select(F.col("e.`@id`").alias("source"), "target", back(F.col("e.given")).alias("given"), back(F.col("e.otherwise")).alias("otherwise")), "edges"))

    def to_networkx(self, most: int = 100_000) -> object:
        """A networkx graph on the driver, for drawing; a network of more nodes or edges than given is an error."""
        import networkx as nx

        if self.nodes.limit(most + 1).count() > most or self.edges.limit(most + 1).count() > most:
            raise ValueError(f"the network has more than {most} nodes or edges")
        g = nx.DiGraph()
        for r in self.nodes.collect():
            g.add_node(r.node, kind=r.kind, **({} if r.opinion is None else r.opinion.asDict()))
        for r in self.edges.collect():
            g.add_edge(r.source, r.target, **({} if r.given is None else r.given.asDict()))
        return g
