"""Registered queries of the analytic core, each with DuckDB SQL that gives the same rows.

Facts are derived from the tables: a confidence is 0.3 + 0.69 * (key % 100) / 100, evidence is a count of a predicate, versions of an order are valid until the customer's next one.
Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridelta.functions import opinion as O
from veridelta.functions import transport as T
from veridelta.functions import vectors as V
from veridelta.operators import fusion, governance, graph, inference, multinomial, network, similarity, validation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
REFERENCE = "2024-02-01 00:00:00"


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__ = f.__name__
        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return register


def r6(c: Column, name: str) -> Column:
    return F.round(c, 6).alias(name)


def r10(c: Column, name: str) -> Column:
    """Where the sixth place can be a tie."""
    return F.round(c, 10).alias(name)


def conf(key: str) -> Column:
    return F.lit(0.3) + F.lit(0.69) * (F.col(key) % 100) / 100.0


CONF = "(0.3::DOUBLE + 0.69::DOUBLE * ({} % 100) / 100.0::DOUBLE)"
FLAT = "round({0}b, 6) AS b, round({0}d, 6) AS d, round({0}u, 6) AS u, round({0}a, 6) AS a, round({0}b + {0}a * {0}u, 6) AS p"
AGE = "(epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us({}))::DOUBLE / 1000000"
EVENTS = f"""e AS (SELECT user_id, event_id, event_type, ts, {CONF.format('event_id')} AS c, 0.1::DOUBLE + 0.8::DOUBLE * (event_id % 7) / 7 AS u FROM events),
    o AS (SELECT user_id, event_id, event_type, ts, c * (1 - u) AS b, (1 - c) * (1 - u) AS d, u, 0.5::DOUBLE AS a FROM e)"""


def event_opinions(t: Callable[[str], DataFrame]) -> DataFrame:
    u = F.lit(0.1) + F.lit(0.8) * (F.col("event_id") % 7) / 7.0
    return t("events").select("user_id", "event_id", "event_type", "ts", "value", O.from_confidence(conf("event_id"), u).alias("opinion"))


def age(ts: str) -> Column:
    return (F.unix_micros(F.lit(REFERENCE).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6


# Flagship: evidence per (user, event type), decayed by its age, fused per user.
@query(f"""WITH g AS (SELECT user_id, event_type, count(*) FILTER (value >= 20) AS r, count(*) FILTER (NOT value >= 20) AS s, max(ts) AS mt FROM events GROUP BY 1, 2),
    o AS (SELECT *, r / (r + s + 2.0::DOUBLE) AS b0, s / (r + s + 2.0::DOUBLE) AS d0, pow(2.0, -({AGE.format('mt')}) / 604800) AS l FROM g),
    x AS (SELECT user_id, b0 * l AS b, d0 * l AS d, 1 - b0 * l - d0 * l AS u FROM o),
    f AS (SELECT user_id, 1 / (1 + sum(1 / u - 1)) AS u, sum(b / u) AS sb, sum(d / u) AS sd FROM x GROUP BY 1)
    SELECT user_id, round(u * sb, 6) AS b, round(u * sd, 6) AS d, round(u, 6) AS u, round(u * sb + 0.5 * u, 6) AS p, round(greatest(0, 1 - abs(u * sb - u * sd) - u), 6) AS conflict FROM f""")
def user_trust(t):
    g = t("events").groupBy("user_id", "event_type").agg(F.count_if(F.col("value") >= 20).alias("r"), F.count_if(~(F.col("value") >= 20)).alias("s"), F.max("ts").alias("mt"))
    o = g.select("user_id", O.decay(O.from_evidence(F.col("r"), F.col("s")), age("mt"), 604800.0).alias("opinion"))
    f, x = fusion.cumulative_fuse(o, ["user_id"]), F.col("opinion")
    return f.select("user_id", r6(x["b"], "b"), r6(x["d"], "d"), r6(x["u"], "u"), r6(O.projected(x), "p"), r6(O.conflict(x), "conflict"))


@query("""WITH g AS (SELECT source, count(*) FILTER (quality = 1) AS r, count(*) FILTER (quality = 0) AS s FROM labels JOIN documents USING (doc_id) GROUP BY 1),
    o AS (SELECT source, r / (r + s + 2.0::DOUBLE) AS b, s / (r + s + 2.0::DOUBLE) AS d, 2.0::DOUBLE / (r + s + 2.0::DOUBLE) AS u, 0.5::DOUBLE AS a FROM g)
    SELECT source, """ + FLAT.format("") + ", round(greatest(0, 1 - abs(b - d) - u), 6) AS conflict FROM o")
def opinion_from_evidence(t):
    g = t("labels").join(t("documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("r"), F.count_if(F.col("quality") == 0).alias("s"))
    o = g.select("source", O.from_evidence(F.col("r"), F.col("s")).alias("o"))
    return o.select("source", *O.flat(F.col("o")), r6(O.conflict(F.col("o")), "conflict"))


@query(f"SELECT o_orderkey, round(c * 0.9, 6) AS b, round((1 - c) * 0.9, 6) AS d, 0.1::DOUBLE AS u, 0.5::DOUBLE AS a, round(c * 0.9 + 0.05, 6) AS p FROM (SELECT o_orderkey, {CONF.format('o_orderkey')} AS c FROM orders)")
def opinion_from_confidence(t):
    return t("orders").select("o_orderkey", *O.flat(O.from_confidence(conf("o_orderkey"), 0.1)))


@query(f"WITH {EVENTS} SELECT user_id, round(u * sb, 6) AS b, round(u * sd, 6) AS d, round(u, 6) AS u, 0.5::DOUBLE AS a, round(u * sb + 0.5 * u, 6) AS p FROM (SELECT user_id, 1 / (1 + sum(1 / u - 1)) AS u, sum(b / u) AS sb, sum(d / u) AS sd FROM o GROUP BY 1)")
def cumulative_fuse(t):
    return fusion.cumulative_fuse(event_opinions(t), ["user_id"]).select("user_id", *O.flat(F.col("opinion")))


@query(f"WITH {EVENTS} SELECT user_id, event_type, round(u * sb, 6) AS b, round(u * sd, 6) AS d, round(u, 6) AS u, 0.5::DOUBLE AS a, round(u * sb + 0.5 * u, 6) AS p FROM (SELECT user_id, event_type, 1 / (1 + sum(1 / u - 1)) AS u, sum(b / u) AS sb, sum(d / u) AS sd FROM o GROUP BY 1, 2)")
def cumulative_fuse_ordered(t):
    return fusion.cumulative_fuse(event_opinions(t), ["user_id", "event_type"], order="event_id").select("user_id", "event_type", *O.flat(F.col("opinion")))


@query(f"WITH {EVENTS} SELECT user_id, round(sum(b / u) / sum(1 / u), 6) AS b, round(sum(d / u) / sum(1 / u), 6) AS d, round(count(*) / sum(1 / u), 6) AS u, 0.5::DOUBLE AS a, round(sum(b / u) / sum(1 / u) + 0.5 * count(*) / sum(1 / u), 6) AS p FROM o GROUP BY 1")
def averaging_fuse(t):
    return fusion.averaging_fuse(event_opinions(t), ["user_id"]).select("user_id", *O.flat(F.col("opinion")))


@query(f"""WITH s AS (SELECT s_suppkey, 0.6::DOUBLE + 0.3 * (s_suppkey % 5) / 5 AS tb FROM supplier),
    l AS (SELECT l_orderkey, l_suppkey, sum({CONF.format('l_partkey')}) / count(*) AS c FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey, l_suppkey, round(tb * c * 0.9, 10) AS b, round(tb * (1 - c) * 0.9, 10) AS d, round((1 - tb) * 0.3 + (1 - tb) * 0.7 + tb * 0.1, 10) AS u, 0.5::DOUBLE AS a, round(tb * c * 0.9 + 0.5 * ((1 - tb) + tb * 0.1), 10) AS p FROM l JOIN s ON l_suppkey = s_suppkey""")
def trust_discount(t):
    tb = F.lit(0.6) + F.lit(0.3) * (F.col("s_suppkey") % 5) / 5.0
    s = t("supplier").select("s_suppkey", O.opinion(tb, (1 - tb) * 0.3, (1 - tb) * 0.7).alias("trust"))
    items = t("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.avg(conf("l_partkey")).alias("c"))
    return items.join(s, items.l_suppkey == s.s_suppkey).select("l_orderkey", "l_suppkey", *O.flat(O.trust_discount(F.col("trust"), O.from_confidence(F.col("c"), 0.1)), 10))


@query(f"""WITH k AS (SELECT DISTINCT o_orderpriority, substr(o_orderpriority, 1, 1)::INT AS k FROM orders),
    o AS (SELECT o_orderkey, {CONF.format('o_orderkey')} AS c, 0.9 - 0.1 * k AS gb, 0.05 * k AS gd, 0.1 + 0.05 * k AS gu, 0.1 * k AS ob, 0.8 - 0.1 * k AS od, 0.2 AS ou FROM orders JOIN k USING (o_orderpriority)),
    x AS (SELECT *, c * 0.8 AS b, (1 - c) * 0.8 AS d FROM o)
    SELECT o_orderkey, round(b * gb + d * ob + 0.2 * (0.5 * gb + 0.5 * ob), 6) AS b, round(b * gd + d * od + 0.2 * (0.5 * gd + 0.5 * od), 6) AS d, round(b * gu + d * ou + 0.2 * (0.5 * gu + 0.5 * ou), 6) AS u,
           round(0.5 * (gb + 0.5 * gu) + 0.5 * (ob + 0.5 * ou), 6) AS a FROM x""")
def deduce(t):
    k = F.substring("o_orderpriority", 1, 1).cast("double")
    given, other = O.opinion(F.lit(0.9) - F.lit(0.1) * k, F.lit(0.05) * k, F.lit(0.1) + F.lit(0.05) * k), O.opinion(F.lit(0.1) * k, F.lit(0.8) - F.lit(0.1) * k, 0.2)
    y = O.deduce(O.from_confidence(conf("o_orderkey"), 0.2), given, other)
    return t("orders").select("o_orderkey", *[r6(y[x], x) for x in "bdua"])


NATIONS = "n AS (SELECT n_nationkey AS k, n_regionkey AS g, c * (1 - u) AS b, (1 - c) * (1 - u) AS d, u FROM (SELECT *, 0.3 + 0.69 * (n_nationkey % 100) / 100.0 AS c, 0.1 + 0.02 * (n_nationkey % 10) AS u FROM nation))"


def nations(t: Callable[[str], DataFrame]) -> DataFrame:
    return t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("g"), O.from_confidence(conf("n_nationkey"), F.lit(0.1) + F.lit(0.02) * (F.col("n_nationkey") % 10)).alias("opinion"))


@query(f"WITH {NATIONS} SELECT x.k AS i, y.k AS j, round(x.b * y.d + x.d * y.b, 6) AS score FROM n x JOIN n y ON x.k < y.k")
def pairwise_conflict(t):
    return fusion.conflicts(nations(t), [], "k").select("i", "j", r6(F.col("score"), "score"))


JSD = "greatest(0, ({}) / 2)".format(" + ".join(f"{p}.{k} * log2(2 * {p}.{k} / (x.{k} + y.{k}))" for k in "bdu" for p in "xy"))


@query(f"""WITH {NATIONS} SELECT x.k AS i, y.k AS j, round(sqrt(pow(x.b - y.b, 2) + pow(x.d - y.d, 2) + pow(x.u - y.u, 2)) / sqrt(2), 6) AS euclidean, round((abs(x.b - y.b) + abs(x.d - y.d) + abs(x.u - y.u)) / 2, 6) AS manhattan,
    round(sqrt(pow(sqrt(x.b) - sqrt(y.b), 2) + pow(sqrt(x.d) - sqrt(y.d), 2) + pow(sqrt(x.u) - sqrt(y.u), 2)) / sqrt(2), 6) AS hellinger, round(sqrt({JSD}), 6) AS jsd FROM n x JOIN n y ON x.k < y.k""")
def opinion_distances(t):
    x, y = nations(t).select(F.col("k").alias("i"), F.col("opinion").alias("x")), nations(t).select(F.col("k").alias("j"), F.col("opinion").alias("y"))
    return x.join(y, F.col("i") < F.col("j")).select("i", "j", *[r6(f(F.col("x"), F.col("y")), n) for n, f in O.DISTANCES.items()])


@query(f"WITH {NATIONS} SELECT x.g, round(1 - avg(sqrt(pow(x.b - y.b, 2) + pow(x.d - y.d, 2) + pow(x.u - y.u, 2)) / sqrt(2)), 6) AS cohesion FROM n x JOIN n y ON x.k < y.k AND x.g = y.g GROUP BY 1")
def cohesion(t):
    return fusion.cohesion(nations(t), ["g"], "k").select("g", r6(F.col("cohesion"), "cohesion"))


@query(f"""WITH {NATIONS} SELECT x.k, x.g, round(avg(x.b * y.d + x.d * y.b), 6) AS discord FROM n x JOIN n y ON x.k <> y.k AND x.g = y.g GROUP BY 1, 2""")
def discord(t):
    return fusion.discord(nations(t), ["g"]).select("k", "g", r6(F.col("discord"), "discord"))


def agents(t: Callable[[str], DataFrame]) -> DataFrame:
    g = t("events").groupBy("user_id", "event_type").agg(F.count_if(F.col("value") >= 20).alias("r"), F.count_if(~(F.col("value") >= 20)).alias("s"))
    return g.select("user_id", "event_type", O.from_evidence(F.col("r"), F.col("s")).alias("opinion"))


@query()
def robust_fuse(t):
    out = fusion.robust_fuse(agents(t), ["user_id"], "event_type", threshold=0.1)
    return out.select("user_id", *O.flat(F.col("opinion")), F.array_join("removed", ",").alias("removed"))


@query()
def byzantine_fuse(t):
    rows = agents(t).withColumn("trust", F.pmod(F.xxhash64("event_type"), F.lit(10)) / 10.0)
    out = fusion.byzantine_fuse(rows, ["user_id"], "event_type", config=fusion.ByzantineConfig(0.05, strategy="combined", trust="trust"))
    return out.select("user_id", *O.flat(F.col("opinion")), F.array_join("removed", ",").alias("removed"), r6(F.col("cohesion"), "cohesion"))


@query(f"""SELECT event_id, round(pow(2.0, -a / 604800), 6) AS exponential, round(greatest(0, 1 - a / (2 * 604800)), 6) AS linear, CASE WHEN a < 604800 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS step,
    round(c * 0.9 * pow(2.0, -a / 604800), 6) AS b, round(1 - 0.9 * pow(2.0, -a / 604800), 6) AS u FROM (SELECT event_id, {AGE.format('ts')} AS a, {CONF.format('event_id')} AS c FROM events)""")
def decay_opinion(t):
    a, h = age("ts"), F.lit(604800.0)
    o = O.decay(O.from_confidence(conf("event_id"), 0.1), a, h)
    return t("events").select("event_id", *[r6(f(a, h), n) for n, f in O.DECAYS.items()], r6(o["b"], "b"), r6(o["u"], "u"))


AGED = f"x AS (SELECT *, pow(2.0, -({AGE.format('ts')}) / {{}}) AS l FROM o), y AS (SELECT user_id, b * l AS b, d * l AS d, greatest(0, 1 - b * l - d * l) AS u FROM x)"
FUSED = "SELECT user_id, round(u * sb, 6) AS b, round(u * sd, 6) AS d, round(u, 6) AS u, 0.5::DOUBLE AS a, round(u * sb + 0.5 * u, 6) AS p FROM (SELECT user_id, 1 / (1 + sum(1 / u - 1)) AS u, sum(b / u) AS sb, sum(d / u) AS sd FROM y GROUP BY 1)"


@query(f"WITH {EVENTS}, {AGED.format('604800')} {FUSED}")
def temporal_fuse(t):
    return fusion.temporal_fuse(event_opinions(t), ["user_id"], "ts", F.lit(REFERENCE), 604800.0).select("user_id", *O.flat(F.col("opinion")))


@query(f"WITH {EVENTS}, {AGED.format(chr(40) + 'CASE event_type WHEN ' + chr(39) + 'view' + chr(39) + ' THEN 86400 WHEN ' + chr(39) + 'purchase' + chr(39) + ' THEN 2592000 ELSE 604800 END' + chr(41))} {FUSED}")
def temporal_fuse_weighted(t):
    return fusion.temporal_fuse_weighted(event_opinions(t), ["user_id"], "ts", "event_type", {"view": 86400, "purchase": 2592000}, F.lit(REFERENCE), 604800.0).select("user_id", *O.flat(F.col("opinion")))


@query(f"""SELECT l_orderkey, round(product(c), 10) AS multiply, round(1 / (1 + exp(-sum(ln(k / (1 - k))))), 10) AS bayesian, round(min(c), 10) AS min, round(pow(product(c), 1 / sqrt(count(*))), 10) AS dampened
    FROM (SELECT l_orderkey, c, greatest(0.0001, least(0.9999, c)) AS k FROM (SELECT l_orderkey, {CONF.format('l_partkey')} AS c FROM lineitem)) GROUP BY 1""")
def propagate_confidence(t):
    return t("lineitem").groupBy("l_orderkey").agg(*[r10(inference.propagated(conf("l_partkey"), m), m) for m in ("multiply", "bayesian", "min", "dampened")])


@query(f"SELECT l_partkey, round(1 - product(1 - c), 10) AS noisy_or, round(avg(c), 10) AS average, round(max(c), 10) AS max, round(1 - product(1 - c), 10) AS dempster_shafer FROM (SELECT l_partkey, {CONF.format('l_suppkey')} AS c FROM lineitem) GROUP BY 1")
def combine_sources(t):
    return t("lineitem").groupBy("l_partkey").agg(*[r10(inference.combined(conf("l_suppkey"), m), m) for m in ("noisy_or", "average", "max", "dempster_shafer")])


@query(f"SELECT l_suppkey, round(avg(c), 6) AS mean, round(max(c), 6) AS max, round(min(c), 6) AS min, round(sum(c * l_quantity) / sum(l_quantity), 6) AS weighted FROM (SELECT l_suppkey, l_quantity, {CONF.format('l_partkey')} AS c FROM lineitem) GROUP BY 1")
def aggregate_confidence(t):
    c = conf("l_partkey")
    return t("lineitem").groupBy("l_suppkey").agg(*[r6(inference.aggregated(c, m, F.col("l_quantity")), m) for m in ("mean", "max", "min", "weighted")])


CLAIMS = f"x AS (SELECT o_custkey, o_orderkey, o_orderstatus AS value, {CONF.format('o_orderkey')} AS c, strftime(o_orderdate, '%Y-%m-%d') AS t, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"


def claims(t: Callable[[str], DataFrame]) -> DataFrame:
    return t("orders").select("o_custkey", "o_orderkey", "o_orderstatus", conf("o_orderkey").alias("c"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("t"))


def settled(df: DataFrame) -> DataFrame:
    return df.select("o_custkey", "value", r6(F.col("confidence"), "confidence"), F.col("candidates").cast("long").alias("candidates"))


@query(f"WITH {CLAIMS} SELECT o_custkey, value, round(c, 6) AS confidence, n AS candidates FROM x QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY c DESC, o_orderkey) = 1")
def resolve_highest(t):
    return settled(inference.resolve_conflict(claims(t), ["o_custkey"], "o_orderstatus", "c", "o_orderkey"))


@query(f"WITH {CLAIMS}, v AS (SELECT o_custkey, value, n, CASE WHEN count(*) = 1 THEN max(c) ELSE 1 - product(1 - c) END AS s, min(o_orderkey) AS f FROM x GROUP BY ALL) SELECT o_custkey, value, round(s, 6) AS confidence, n AS candidates FROM v QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY s DESC, f) = 1")
def resolve_vote(t):
    return settled(inference.resolve_conflict(claims(t), ["o_custkey"], "o_orderstatus", "c", "o_orderkey", "weighted_vote"))


@query(f"WITH {CLAIMS} SELECT o_custkey, value, round(c, 6) AS confidence, n AS candidates FROM x QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY t DESC, c DESC, o_orderkey) = 1")
def resolve_recency(t):
    return settled(inference.resolve_conflict(claims(t), ["o_custkey"], "o_orderstatus", "c", "o_orderkey", "recency", "t"))


SEGMENTS = """s AS (SELECT c_custkey AS node_id, 'segment' AS prop, CASE WHEN (c_custkey + k) % (3 + k) = 0 THEN 'OTHER' ELSE c_mktsegment END AS value, round(0.3 + 0.6 * ((c_custkey * (k + 1)) % 97) / 97.0, 6)::DOUBLE AS confidence, k AS src_ord
    FROM customer, (SELECT unnest([0, 1, 2]) AS k))"""


def segments(t: Callable[[str], DataFrame]) -> DataFrame:
    """Three sources' word on each customer's segment."""
    k = F.col("k")
    rows = t("customer").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    value = F.when((F.col("c_custkey") + k) % (3 + k) == 0, "OTHER").otherwise(F.col("c_mktsegment"))
    return rows.select(F.col("c_custkey").alias("node_id"), F.lit("segment").alias("prop"), value.alias("value"), F.round(F.lit(0.3) + F.lit(0.6) * ((F.col("c_custkey") * (k + 1)) % 97) / 97.0, 6).alias("confidence"), k.alias("src_ord"))


def merge_sql(order: str, settled_: str) -> str:
    return f"""WITH {SEGMENTS}, v AS (SELECT node_id, value, count(*) AS n, max(confidence) AS best, 1 - product(1 - confidence) AS every, min(src_ord) AS first, arg_min(src_ord, -confidence * 1000 + src_ord * 0.0001) AS o FROM s GROUP BY 1, 2),
        w AS (SELECT *, CASE WHEN n = 1 THEN best ELSE every END AS s, count(*) OVER (PARTITION BY node_id) AS kinds FROM v)
        SELECT node_id, 'segment' AS prop, value, round(CASE WHEN kinds = 1 THEN round(every, 10) ELSE {settled_} END, 6) AS confidence, CASE WHEN kinds = 1 THEN 'agreed' ELSE 'conflicted' END AS outcome, 3::BIGINT AS candidates
        FROM w QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY {order}) = 1"""


def merged(df: DataFrame) -> DataFrame:
    return df.select("node_id", "prop", "value", r6(F.col("confidence"), "confidence"), "outcome", F.col("candidates").cast("long").alias("candidates"))


@query(merge_sql("best DESC, o", "best"))
def merge_graphs(t):
    return merged(graph.merge_graphs(segments(t)))


@query(merge_sql("s DESC, first", "s"))
def merge_graphs_vote(t):
    return merged(graph.merge_graphs(segments(t), "weighted_vote"))


@query(f"WITH {SEGMENTS}, v AS (SELECT node_id, value, count(*) AS n, max(confidence) AS best, 1 - product(1 - confidence) AS every, count(*) OVER (PARTITION BY node_id) AS kinds FROM s GROUP BY 1, 2) SELECT node_id, 'segment' AS prop, value, round(CASE WHEN kinds = 1 THEN round(every, 10) ELSE best END, 6) AS confidence, CASE WHEN kinds = 1 THEN 'agreed' ELSE 'union' END AS outcome, 3::BIGINT AS candidates FROM v")
def merge_graphs_union(t):
    return merged(graph.merge_graphs(segments(t), "union"))


@query(f"WITH {SEGMENTS}, k AS (SELECT node_id, count(DISTINCT value) AS kinds FROM s GROUP BY 1) SELECT count(*) AS nodes_merged, count(*) FILTER (kinds = 1) AS properties_agreed, count(*) FILTER (kinds > 1) AS properties_conflicted, 0::BIGINT AS properties_union FROM k")
def merge_report(t):
    return graph.merge_report(graph.merge_graphs(segments(t)))


@query("""WITH b AS (SELECT c_custkey + CASE WHEN c_custkey % 11 = 0 THEN 1000000 ELSE 0 END AS k, CASE WHEN c_custkey % 7 = 0 THEN 'OTHER' ELSE c_mktsegment END AS v FROM customer)
    SELECT coalesce(c_custkey, k) AS node_id, CASE WHEN c_custkey IS NULL THEN 'added' WHEN k IS NULL THEN 'removed' WHEN c_mktsegment = v THEN 'unchanged' ELSE 'modified' END AS change, c_mktsegment AS old, v AS new FROM customer FULL JOIN b ON c_custkey = k""")
def diff_graphs(t):
    c = t("customer")
    a = c.select(F.col("c_custkey").alias("node_id"), F.lit("segment").alias("prop"), F.col("c_mktsegment").alias("value"))
    b = c.select((F.col("c_custkey") + F.when(F.col("c_custkey") % 11 == 0, 1000000).otherwise(0)).alias("node_id"), F.lit("segment").alias("prop"), F.when(F.col("c_custkey") % 7 == 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("value"))
    return graph.diff_graphs(a, b).select("node_id", "change", "old", "new")


def versions(t: Callable[[str], DataFrame]) -> DataFrame:
    """An order holds from its date until the customer's next one."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t("orders").select(F.col("o_custkey").alias("node_id"), F.lit("status").alias("prop"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("src_ord"), F.col("o_orderdate").alias("valid_from"), F.lead("o_orderdate").over(w).alias("valid_until"))


VERSIONS = "v AS (SELECT o_custkey AS node_id, o_orderstatus AS value, o_orderkey AS src_ord, o_orderdate AS f, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS u FROM orders)"


@query(f"WITH {VERSIONS} SELECT node_id, value, src_ord FROM v WHERE f <= TIMESTAMP '1996-06-01' AND (u IS NULL OR u >= TIMESTAMP '1996-06-01')")
def query_at_time(t):
    return graph.query_at_time(versions(t), F.lit("1996-06-01").cast("timestamp_ntz")).select("node_id", "value", "src_ord")


@query(f"""WITH {VERSIONS}, x AS (SELECT node_id, arg_max(value, src_ord) AS v FROM v WHERE f <= TIMESTAMP '1995-01-01' AND (u IS NULL OR u >= TIMESTAMP '1995-01-01') GROUP BY 1), y AS (SELECT node_id, arg_max(value, src_ord) AS v FROM v WHERE f <= TIMESTAMP '1997-01-01' AND (u IS NULL OR u >= TIMESTAMP '1997-01-01') GROUP BY 1)
    SELECT coalesce(x.node_id, y.node_id) AS node_id, CASE WHEN x.v IS NULL THEN 'added' WHEN y.v IS NULL THEN 'removed' WHEN x.v = y.v THEN 'unchanged' ELSE 'modified' END AS change, x.v AS old, y.v AS new FROM x FULL JOIN y ON x.node_id = y.node_id""")
def temporal_diff(t):
    return graph.temporal_diff(versions(t), F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1997-01-01").cast("timestamp_ntz")).select("node_id", "change", "old", "new")


@query(f"SELECT p_partkey, round(c, 6) AS confidence FROM (SELECT *, {CONF.format('p_partkey')} AS c FROM part) WHERE c >= 0.7 AND p_size > 10")
def filter_by_confidence(t):
    return t("part").withColumn("c", conf("p_partkey")).where((F.col("c") >= 0.7) & (F.col("p_size") > 10)).select("p_partkey", r6(F.col("c"), "confidence"))


@query("""SELECT c_custkey, e.path, e.c AS "constraint" FROM customer, unnest([
    CASE WHEN c_acctbal < 0 THEN {'path': 'c_acctbal', 'c': 'minimum'} END, CASE WHEN c_acctbal > 9000 THEN {'path': 'c_acctbal', 'c': 'maximum'} END,
    CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN {'path': 'c_mktsegment', 'c': 'in'} END, CASE WHEN NOT regexp_matches(c_name, '0$') THEN {'path': 'c_name', 'c': 'pattern'} END,
    CASE WHEN NOT (c_nationkey < 5 OR c_nationkey > 20) THEN {'path': 'c_nationkey', 'c': 'or'} END, CASE WHEN c_nationkey >= c_custkey THEN {'path': 'c_nationkey', 'c': 'less_than'} END]) AS x(e) WHERE e IS NOT NULL""")
def validate_node(t):
    shape = {"properties": {"c_acctbal": {"required": True, "minimum": 0, "maximum": 9000}, "c_mktsegment": {"in": ["BUILDING", "MACHINERY", "AUTOMOBILE"]}, "c_name": {"datatype": "xsd:string", "pattern": "0$"}, "c_nationkey": {"or": [{"maximum": 4}, {"minimum": 21}], "less_than": "c_custkey"}}}
    return validation.validate(t("customer"), shape).select("c_custkey", F.explode("errors").alias("e")).select("c_custkey", "e.path", "e.constraint")


def vector_pairs(t: Callable[[str], DataFrame]) -> DataFrame:
    """Each vector with the next by id."""
    v = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"), F.col("label").alias("other"))
    return v.join(nxt, "vec_id")


VECTORS = "v AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), q AS (SELECT a.vec_id, a.v AS v, b.v AS w, a.label = b.label AS same FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)"
_Z = "[{} FOR i IN range(1, len(v) + 1)]"


def hof(x: str) -> str:
    return "list_sum(" + _Z.format(x) + ")"


METRICS = {
    "cosine": f"({hof('v[i] * w[i]')} / sqrt({hof('v[i] * v[i]')} * {hof('w[i] * w[i]')}))", "dot_product": hof("v[i] * w[i]"), "euclidean": f"sqrt({hof('(v[i] - w[i]) * (v[i] - w[i])')})", "manhattan": hof("abs(v[i] - w[i])"),
    "chebyshev": "list_max(" + _Z.format("abs(v[i] - w[i])") + ")", "hamming": hof("CASE WHEN v[i] <> w[i] THEN 1.0::DOUBLE ELSE 0 END"), "jaccard": f"({hof('CASE WHEN v[i] <> 0 AND w[i] <> 0 THEN 1.0::DOUBLE ELSE 0 END')} / {hof('CASE WHEN v[i] <> 0 OR w[i] <> 0 THEN 1.0::DOUBLE ELSE 0 END')})",
    "canberra": hof("CASE WHEN abs(v[i]) + abs(w[i]) > 0 THEN abs(v[i] - w[i]) / (abs(v[i]) + abs(w[i])) ELSE 0 END"), "bray_curtis": f"({hof('abs(v[i] - w[i])')} / {hof('abs(v[i]) + abs(w[i])')})",
}


@query(f"WITH {VECTORS} SELECT vec_id, {', '.join(f'round({x}, 6) AS {n}' for n, x in METRICS.items())} FROM q")
def vector_metrics(t):
    a, b = F.col("v"), F.col("w")
    fs = {n: V.metric(n) for n in V.names()} | {n: V.EXAMPLES[n][0] for n in ("canberra", "bray_curtis")}
    return vector_pairs(t).select("vec_id", *[r6(f(a, b), n) for n, f in fs.items()])


@query()
def sequence_metrics(t):
    a, b = F.col("v"), F.col("w")
    return vector_pairs(t).select("vec_id", *[r6(V.EXAMPLES[n][0](a, b), n) for n in ("dtw", "spearman", "kendall")])


@query("""SELECT count(*) AS n_vectors, max(len(embedding))::BIGINT AS dimensionality, false AS is_binary, round(sum(len(list_filter(embedding, lambda x: x = 0))) / sum(len(embedding)), 6) AS sparsity,
    bool_and(abs(sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])) - 1) <= 1e-6) AS is_unit_normalized, bool_and(list_min(embedding) >= 0) AS all_non_negative FROM embeddings""")
def analyze_vectors(t):
    out = similarity.analyze_vectors(t("embeddings"), "embedding")
    return out.select("n_vectors", "dimensionality", "is_binary", r6(F.col("sparsity"), "sparsity"), "is_unit_normalized", "all_non_negative")


EVALUATED = ("chebyshev", "cosine", "euclidean", "manhattan")


@query(f"""WITH {VECTORS}, s AS ({' UNION ALL '.join(f"SELECT '{n}' AS metric, {'' if n == 'cosine' else '-'}round({METRICS[n]}, 9) AS s, same FROM q" for n in EVALUATED)}),
    r AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY s) + (count(*) OVER (PARTITION BY metric, s) - 1) / 2.0 AS r FROM s)
    SELECT metric, round(avg(s) FILTER (same) - avg(s) FILTER (NOT same), 6) AS separation, round((sum(r) FILTER (same) - count(*) FILTER (same) * (count(*) FILTER (same) + 1) / 2.0) / (count(*) FILTER (same) * count(*) FILTER (NOT same)), 6) AS auc FROM r GROUP BY 1""")
def evaluate_metrics(t):
    pairs = vector_pairs(t).withColumn("y", (F.col("label") == F.col("other")).cast("double"))
    scored = similarity.compare_metrics(pairs, "v", "w", list(EVALUATED)).select("y", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(m, 9).alias("score"), F.lit(V.higher_is_nearer(m)).alias("higher")) for m in EVALUATED])).alias("x")).select("y", "x.*")
    return similarity.evaluate_scores(scored, "metric", "score", "y", "higher").select("metric", r6(F.col("separation"), "separation"), r6(F.col("auc"), "auc"))


MULTI = "c AS (SELECT user_id, event_type AS state, count(*) AS r FROM events GROUP BY 1, 2), m AS (SELECT *, count(*) OVER w AS k, sum(r) OVER w AS t FROM c WINDOW w AS (PARTITION BY user_id)), n AS (SELECT *, (k + 2.0 * k * t) / (1 + k * t) AS w FROM m), o AS (SELECT user_id, state, r / (t + w) AS b, w / (t + w) AS u, 1.0 / k AS a FROM n)"


def user_states(t: Callable[[str], DataFrame]) -> DataFrame:
    return multinomial.from_evidence(t("events").groupBy("user_id", "event_type").count(), ["user_id"], "event_type", "count")


@query(f"WITH {MULTI} SELECT user_id, state, round(b, 6) AS b, round(u, 6) AS u, round(a, 6) AS a, round(b + a * u, 6) AS p FROM o")
def multinomial_evidence(t):
    return multinomial.projected(user_states(t)).select("user_id", "state", *[r6(F.col(c), c) for c in ("b", "u", "a", "p")])


@query(f"WITH {MULTI} SELECT user_id, round(coalesce(sum(b) FILTER (state = 'purchase'), 0), 6) AS b, round(coalesce(sum(b) FILTER (state <> 'purchase'), 0), 6) AS d, round(max(u), 6) AS u FROM o GROUP BY 1")
def multinomial_coarsen(t):
    o = F.col("opinion")
    return multinomial.coarsen(user_states(t), ["user_id"], "purchase").select("user_id", *[r6(o[k], k) for k in "bdu"])


@query(f"WITH {MULTI}, f AS (SELECT user_id % 10 AS g, state, 1 / (1 + sum(1 / u) - count(*)) AS u, sum(b / u) AS sb FROM o GROUP BY 1, 2) SELECT g, state, round(u * sb, 6) AS b, round(u, 6) AS u FROM f")
def multinomial_fuse(t):
    rows = user_states(t).withColumn("g", F.col("user_id") % 10)
    return multinomial.cumulative_fuse(rows, ["g"]).select("g", "state", r6(F.col("b"), "b"), r6(F.col("u"), "u"))


CONDITIONALS = [(s, y, b, u, 0.5) for s, hi, lo, u in (("view", 0.2, 0.5, 0.3), ("click", 0.4, 0.4, 0.2), ("purchase", 0.8, 0.1, 0.1), ("signup", 0.6, 0.2, 0.2), ("error", 0.1, 0.7, 0.2)) for y, b in (("hi", hi), ("lo", lo))]
COND = "(VALUES " + ", ".join(map(str, CONDITIONALS)) + ")"


@query(f"WITH {MULTI}, k(s, y, cb, cu, ca) AS {COND} SELECT user_id, y AS state, round(sum((b + u * a) * cb), 6) AS b, round(sum((b + u * a) * cu), 6) AS u, round(sum(a * (cb + ca * cu)), 6) AS a FROM o JOIN k ON state = s GROUP BY 1, 2")
def multinomial_deduce(t):
    cond = t("events").sparkSession.createDataFrame(CONDITIONALS, "parent_state string, state string, b double, u double, a double")  # noqa: S307
    return multinomial.deduce(user_states(t), cond, ["user_id"]).select("user_id", "state", *[r6(F.col(c), c) for c in "bua"])


@query(f"""WITH o AS (SELECT s_nationkey AS n, 0.7 + 0.29 * (s_suppkey % 100) / 100.0 AS b, 0.01 * (s_suppkey % 3) AS d FROM supplier)
    SELECT n, round(product(b), 6) AS b, round(1 - product(1 - d), 6) AS d, round(greatest(0, product(1 - d) - product(b)), 6) AS u, round(pow(0.5, count(*)), 6) AS a FROM o GROUP BY 1""")
def jurisdictional_meet(t):
    o = F.col("opinion")
    return fusion.meet(supplier_opinions(t), ["n"]).select("n", *[r6(o[k], k) for k in "bdua"])


def supplier_opinions(t: Callable[[str], DataFrame]) -> DataFrame:
    b, d = F.lit(0.7) + F.lit(0.29) * (F.col("s_suppkey") % 100) / 100.0, F.lit(0.01) * (F.col("s_suppkey") % 3)
    return t("supplier").select(F.col("s_nationkey").alias("n"), "s_suppkey", O.opinion(b, d, 1 - b - d).alias("opinion"))


@query(f"""WITH o AS (SELECT s_nationkey AS n, 0.7 + 0.29 * (s_suppkey % 100) / 100.0 AS b, 0.01 * (s_suppkey % 3) AS d FROM supplier)
    SELECT n, round(product(b), 6) AS b, round(1 - product(1 - d), 6) AS d, round(greatest(0, product(1 - d) - product(b)), 6) AS u, 0.5::DOUBLE AS a FROM o GROUP BY 1""")
def residual_contamination(t):
    o = F.col("opinion")
    return fusion.contamination(supplier_opinions(t), ["n"]).select("n", *[r6(o[k], k) for k in "bdua"])


@query(f"""WITH o AS (SELECT o_orderkey, {CONF.format('o_orderkey')} * 0.9 AS b, (1 - {CONF.format('o_orderkey')}) * 0.9 AS d, o_orderdate AS t FROM orders)
    SELECT o_orderkey, round(CASE WHEN t > TIMESTAMP '1996-01-01' THEN b ELSE 0.25 * b END, 6) AS expired_b, round(CASE WHEN t > TIMESTAMP '1996-01-01' THEN d ELSE d + 0.75 * b END, 6) AS expired_d,
           round(CASE WHEN t > TIMESTAMP '1996-01-01' THEN b ELSE b * 0.0 END, 6) AS changed_b FROM o""")
def compliance_triggers(t):
    o, at = O.from_confidence(conf("o_orderkey"), 0.1), F.lit("1996-01-01").cast("timestamp_ntz")
    x, y = O.expiry(o, at, F.col("o_orderdate"), 0.25), O.regulatory_change(o, at, F.col("o_orderdate"), O.opinion(0.0, 0.0, 1.0))
    return t("orders").select("o_orderkey", r6(x["b"], "expired_b"), r6(x["d"], "expired_d"), r6(y["b"], "changed_b"))


@query("""WITH RECURSIVE c(start, node, depth) AS (SELECT 1::BIGINT, 1::BIGINT, 0 UNION ALL SELECT start, doc_id, depth + 1 FROM c JOIN documents ON doc_id // 2 = node AND doc_id > 1) SELECT node, depth FROM c""")
def lineage_closure(t):
    d = t("documents")
    edges = d.where("doc_id > 1").select(F.expr("doc_id div 2").alias("parent"), F.col("doc_id").alias("child"))
    start = d.sparkSession.createDataFrame([(1,)], "node long")
    return governance.closure(edges, start).select("node", "depth")


@query(f"""WITH RECURSIVE c(start, node) AS (SELECT doc_id, doc_id FROM documents UNION ALL SELECT start, doc_id FROM c JOIN documents ON doc_id // 2 = node AND doc_id > 1),
    o AS (SELECT start, 1 - 0.0001 * (node % 10) AS b, 0.00005 * (node % 10) AS d FROM c WHERE node % 13 <> 0)
    SELECT start, round(product(b), 6) AS b, round(1 - product(1 - d), 6) AS d FROM o GROUP BY 1""")
def erasure_scope(t):
    d = t("documents")
    edges = d.where("doc_id > 1").select(F.expr("doc_id div 2").alias("parent"), F.col("doc_id").alias("child"))
    b, v = 1 - F.lit(0.0001) * (F.col("doc_id") % 10), F.lit(0.00005) * (F.col("doc_id") % 10)
    opinions = d.select(F.col("doc_id").alias("node"), O.opinion(b, v, 1 - b - v).alias("opinion"))
    start = d.select(F.col("doc_id").alias("node"))
    o = F.col("opinion")
    return governance.erasure_assessment(edges, start, opinions, d.where("doc_id % 13 = 0").select(F.col("doc_id").alias("node"))).select("start", r6(o["b"], "b"), r6(o["d"], "d"))


SUBJECTS = """p AS (SELECT o_orderkey AS node_id, 'order' AS prop, o_custkey AS data_subject, o_orderstatus AS value, CASE o_orderkey % 4 WHEN 0 THEN 'regular' WHEN 1 THEN 'sensitive' WHEN 2 THEN 'anonymized' ELSE 'special_category' END AS category,
    CASE o_orderkey % 3 WHEN 0 THEN 'consent' WHEN 1 THEN 'contract' ELSE 'legal_obligation' END AS legal_basis, n_name AS jurisdiction, o_orderdate + INTERVAL 730 DAY AS retention_until FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def subjects(t: Callable[[str], DataFrame]) -> DataFrame:
    k = F.col("o_orderkey")
    category = F.when(k % 4 == 0, "regular").when(k % 4 == 1, "sensitive").when(k % 4 == 2, "anonymized").otherwise("special_category")
    basis = F.when(k % 3 == 0, "consent").when(k % 3 == 1, "contract").otherwise("legal_obligation")
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(k.alias("node_id"), F.lit("order").alias("prop"), F.col("o_custkey").alias("data_subject"), F.col("o_orderstatus").alias("value"), category.alias("category"), basis.alias("legal_basis"), F.lit("shop").alias("controller"), F.col("n_name").alias("jurisdiction"), (F.col("o_orderdate") + F.expr("INTERVAL 730 DAY")).alias("retention_until"), F.lit(0).alias("src_ord"))


@query(f"WITH {SUBJECTS}, j AS (SELECT min(n_name) AS j FROM nation) SELECT node_id, data_subject, category FROM p, j WHERE jurisdiction = j AND category IN ('regular', 'sensitive', 'special_category', 'pseudonymized')")
def protection_filters(t):
    name = t("nation").agg(F.min("n_name")).first()[0]
    return governance.filter_personal(governance.filter_by_jurisdiction(subjects(t), "order", name)).select("node_id", "data_subject", "category")


@query(f"WITH {SUBJECTS} SELECT data_subject, count(*) AS total_property_count, count(DISTINCT node_id) AS nodes, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories, array_to_string(list_sort(list(DISTINCT legal_basis)), ',') AS legal_bases FROM p GROUP BY 1")
def access_report(t):
    return governance.access_report(subjects(t)).select("data_subject", "total_property_count", "nodes", F.array_join("categories", ",").alias("categories"), F.array_join("legal_bases", ",").alias("legal_bases"))


@query(f"WITH {SUBJECTS} SELECT node_id, prop, retention_until FROM p WHERE retention_until < TIMESTAMP '1997-01-01'")
def retention_violations(t):
    return governance.retention_violations(subjects(t), F.lit("1997-01-01").cast("timestamp_ntz"))


@query(f"WITH {SUBJECTS} SELECT node_id, CASE WHEN data_subject <> 7 THEN value END AS value, CASE WHEN data_subject = 7 THEN true END AS erased FROM p")
def erasure(t):
    rows = governance.request_erasure(subjects(t), 7, F.lit(REFERENCE))
    return governance.execute_erasure(rows, 7, F.lit(REFERENCE)).select("node_id", "value", F.col("erasure_requested").alias("erased"))


@query("SELECT doc_id, 'sha256-' || base64(unhex(sha256(text))) AS integrity FROM documents")
def integrity(t):
    return t("documents").select("doc_id", T.integrity(F.col("text")).alias("integrity"))


@query(f"SELECT event_id, 'ld/' || event_type || '/' || event_id AS topic, CASE WHEN user_id % 10 = 0 OR c >= 0.9 THEN 2 WHEN c >= 0.5 THEN 1 ELSE 0 END AS qos FROM (SELECT *, {CONF.format('event_id')} AS c FROM events)")
def mqtt_routing(t):
    topic = T.topic(F.concat(F.lit("http://example.org/"), F.col("event_type")), F.concat(F.lit("urn:event:"), F.col("event_id").cast("string")))
    return t("events").select("event_id", topic.alias("topic"), T.quality_of_service(conf("event_id"), F.col("user_id") % 10 == 0).alias("qos"))


@query(f"""WITH s AS (SELECT o_orderkey, o_orderstatus, {CONF.format('o_orderkey')} AS c FROM orders), x AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0.9 WHEN 'O' THEN 0.6 ELSE 0.3 END AS p, least(0.99, 0.15 * CASE o_orderstatus WHEN 'F' THEN 0.8 WHEN 'O' THEN 1.0 ELSE 1.5 END * CASE o_orderkey % 4 WHEN 0 THEN 1.5 WHEN 1 THEN 0.9 WHEN 2 THEN 0.9 ELSE 0.7 END) AS u FROM s)
    SELECT o_orderkey, round(p * (1 - u), 6) AS b, round((1 - p) * (1 - u), 6) AS d, round(u, 6) AS u, round(p, 6) AS a, CASE WHEN p >= 0.6 - 1e-9 THEN 'keep' ELSE 'suppress' END AS alert FROM x""")
def clinical_status(t):
    from veridelta.operators import clinical

    p = F.when(F.col("o_orderstatus") == "F", 0.9).when(F.col("o_orderstatus") == "O", 0.6).otherwise(0.3)
    m = F.when(F.col("o_orderstatus") == "F", 0.8).when(F.col("o_orderstatus") == "O", 1.0).otherwise(1.5)
    o = clinical.scalar_to_opinion(p, status_multiplier=m, basis_count=F.col("o_orderkey") % 4)
    return t("orders").select("o_orderkey", *[r6(o[k], k) for k in "bdua"], clinical.alert(o, 0.6 - 1e-9).alias("alert"))


@query(f"""WITH r AS (SELECT r_regionkey AS k, 0.3 + 0.69 * (r_regionkey % 100) / 100.0 AS c FROM region), x AS (SELECT k, c * 0.8 AS b, (1 - c) * 0.8 AS d, 0.2 AS u, 0.5 AS a FROM r),
    n AS (SELECT n_nationkey AS k, 0.7 * b + 0.0 * d + 0.2 * 0.5 * 0.7 AS b, 0.1 * b + 0.2 * 0.5 * 0.1 AS d, b * 0.2 + d * 1.0 + 0.2 * (0.5 * 0.2 + 0.5 * 1.0) AS u, 0.5 * (0.7 + 0.5 * 0.2) + 0.5 * 0.5 AS a FROM x JOIN nation ON n_regionkey = k),
    s AS (SELECT s_suppkey, 0.7 * b + u * a * 0.7 AS b, 0.1 * b + u * a * 0.1 AS d, b * 0.2 + d + u * (a * 0.2 + (1 - a)) AS u FROM n JOIN supplier ON s_nationkey = k)
    SELECT s_suppkey AS node, round(b, 6) AS b, round(d, 6) AS d, round(u, 6) AS u FROM s""")
def network_inference(t):
    """A tree of regions, nations and suppliers under one conditional."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    roots = t("region").select(key("r", "r_regionkey").alias("node"), O.from_confidence(conf("r_regionkey"), 0.2).alias("opinion"))
    none = F.lit(None).cast(O.SCHEMA)
    inner = t("nation").select(key("n", "n_nationkey").alias("node"), none.alias("opinion")).unionByName(t("supplier").select(key("s", "s_suppkey").alias("node"), none.alias("opinion")))
    given = O.opinion(0.7, 0.1, 0.2)
    edges = t("nation").select(key("r", "n_regionkey").alias("source"), key("n", "n_nationkey").alias("target"), given.alias("given")).unionByName(t("supplier").select(key("n", "s_nationkey").alias("source"), key("s", "s_suppkey").alias("target"), given.alias("given")))
    out, o = network.infer(roots.unionByName(inner), edges), F.col("opinion")
    return out.where(F.col("node").startswith("s")).select(F.substring("node", 2, 20).cast("long").alias("node"), *[r6(o[k], k) for k in "bdu"])


#: Suppliers trust the next one and the third of their group of six, in a ring, so there are cycles and simple paths of up to five edges.
RING = """e AS (SELECT s_suppkey AS s, t, 0.5::DOUBLE + 0.02 * (s_suppkey % 20) - 0.1 * k AS b, 0.02::DOUBLE * (s_suppkey % 3) AS d, 0.2::DOUBLE + 0.1 * (s_suppkey % 7) AS a FROM (SELECT s_suppkey, k, s_suppkey // 6 * 6 + (s_suppkey % 6 + k) % 6 AS t
    FROM supplier, (SELECT unnest([1, 3]) AS k)) WHERE t IN (SELECT s_suppkey FROM supplier))"""


def ring(t: Callable[[str], DataFrame]) -> DataFrame:
    k, s = F.col("s_suppkey"), t("supplier").select("s_suppkey")
    rows = s.withColumn("k", F.explode(F.array(F.lit(1), F.lit(3)))).withColumn("t", F.floor(k / 6).cast("long") * 6 + (k % 6 + F.col("k")) % 6).join(s.toDF("t"), "t", "left_semi")
    return rows.select(k.alias("source"), F.col("t").alias("target"), O.opinion(F.lit(0.5) + F.lit(0.02) * (k % 20) - F.lit(0.1) * F.col("k"), F.lit(0.02) * (k % 3), F.lit(0.5) - F.lit(0.02) * (k % 20) + F.lit(0.1) * F.col("k") - F.lit(0.02) * (k % 3), F.lit(0.2) + F.lit(0.1) * (k % 7)).alias("opinion"))


@query(f"""WITH RECURSIVE {RING}, p(agent, target, b, d, a, path) AS (SELECT s, t, b, d, a, [s, t] FROM e UNION ALL SELECT agent, t, p.b * e.b, p.b * e.d, e.a, list_append(path, t) FROM p JOIN e ON e.s = p.target AND NOT list_contains(path, t)),
    f AS (SELECT agent, target, count(*) AS paths, 1 / (1 + sum(1 / (1 - b - d)) - count(*)) AS u, sum(b / (1 - b - d)) AS sb, sum(d / (1 - b - d)) AS sd FROM p GROUP BY 1, 2)
    SELECT agent, target, paths, round(u * sb, 6) AS b, round(u * sd, 6) AS d, round(u, 6) AS u FROM f""")
def trust_propagation(t):
    """What every supplier may trust over all simple paths of the network."""
    o = F.col("opinion")
    return network.propagate_trust(ring(t), t("supplier").select(F.col("s_suppkey").alias("node"))).select("agent", "target", "paths", *[r6(o[k], k) for k in "bdu"])


@query(f"""WITH x AS (SELECT p_partkey, p_name, {CONF.format('p_partkey')} AS c FROM part)
    SELECT '<http://example.org/part/' || p_partkey || '> <http://schema.org/name> "' || p_name || '" .' AS line FROM x
    UNION ALL SELECT '<< <http://example.org/part/' || p_partkey || '> <http://schema.org/name> "' || p_name || '" >> <http://example.org/ns#source> <http://example.org/source/' || p_partkey % 5 || '> .' FROM x""")
def rdf_star_lines(t):
    from veridelta.sources import rdf

    rows = t("part").select(F.concat(F.lit("http://example.org/part/"), F.col("p_partkey").cast("string")).alias("node_id"), F.lit("http://schema.org/name").alias("prop"), F.col("p_name").alias("value"), F.lit("string").alias("value_kind"), F.concat(F.lit("http://example.org/source/"), (F.col("p_partkey") % 5).cast("string")).alias("source"))
    return rdf.to_ntriples(rows, "http://example.org/ns#", {"source": "iri"})


@query(f"""SELECT n_name, round(avg({CONF.format('o_orderkey')}), 6) AS mean_confidence, count(*) AS facts FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND {CONF.format('o_orderkey')} >= 0.5 GROUP BY 1""")
def confident_facts(t):
    """Filter, join and aggregation with filters in the scan and the small sides broadcast by their size."""
    o = t("orders").where(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")).select("o_custkey", conf("o_orderkey").alias("c")).where("c >= 0.5")
    j = o.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(r6(F.avg("c"), "mean_confidence"), F.count(F.lit(1)).alias("facts"))


@query("SELECT event_id AS doc, 'k' AS prop, CAST(json_extract(props, '$.k') AS DOUBLE) AS value_num, 'number' AS value_kind FROM events")
def document_assertions(t):
    """The JSON of each event as assertions."""
    from veridelta.sources import documents

    return documents.assertions(t("events"), "props", order="event_id").select(F.col("src_ord").alias("doc"), "prop", "value_num", "value_kind")


@query("""WITH x AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0.85 WHEN 'O' THEN 0.5 ELSE 0.1 END AS p, CASE o_orderstatus WHEN 'F' THEN 0.15 WHEN 'O' THEN 0.4 ELSE 0.15 END AS u FROM orders)
    SELECT o_orderkey AS ord, 'Claim' AS type, round(p * (1 - u), 6) AS b, round((1 - p) * (1 - u), 6) AS d, round(u, 6) AS u, round(p, 6) AS a FROM x""")
def clinical_records(t):
    """Orders as claim records in JSON, read back as opinions."""
    from veridelta.sources import clinical_records as records

    status = F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "O", "draft").otherwise("cancelled")
    docs = t("orders").select("o_orderkey", F.to_json(F.struct(F.lit("Claim").alias("resourceType"), F.col("o_orderkey").cast("string").alias("id"), status.alias("status"))).alias("json"))
    o = F.col("opinion")
    return records.from_records(docs, "json", "o_orderkey", ["Claim"]).select("ord", "type", *[r6(o[k], k) for k in "bdua"])


@query(f"""WITH s AS (SELECT p_partkey, p_partkey % 5 AS s FROM part) SELECT 'attributed' AS what, count(*) AS n FROM s UNION ALL SELECT 'agents', count(DISTINCT s) FROM s UNION ALL SELECT 'entities', count(*) FROM s""")
def provenance_statements(t):
    """Provenance of every part's name, counted by kind."""
    from veridelta.sources import rdf

    none = F.lit(None).cast("string")
    rows = t("part").select(F.col("p_partkey").cast("string").alias("node_id"), F.lit("name").alias("prop"), F.col("p_name").alias("value"), conf("p_partkey").alias("confidence"), (F.col("p_partkey") % 5).cast("string").alias("source"), none.alias("method"), none.alias("extracted_at"))
    s = rdf.to_prov(rows)
    what = F.when(F.col("predicate").endswith("wasAttributedTo"), "attributed").when(F.col("object").endswith("SoftwareAgent"), "agents").when(F.col("object").endswith("#Entity"), "entities")
    return s.select(what.alias("what")).where("what IS NOT NULL").groupBy("what").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {VERSIONS}, s AS (SELECT node_id, arg_max(value, src_ord) AS value FROM v WHERE f <= TIMESTAMP '1996-06-01' AND (u IS NULL OR u >= TIMESTAMP '1996-06-01') GROUP BY 1)
    SELECT n_name, count(*) FILTER (value = 'F') AS closed, count(*) AS facts, round((count(*) FILTER (value = 'F')) / (count(*) + 2.0::DOUBLE), 6) AS b, round(2.0::DOUBLE / (count(*) + 2.0::DOUBLE), 6) AS u FROM s JOIN customer ON node_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def evidence_at_time(t):
    """A time slice, joined and counted as evidence: the retrieval path from graph to opinion."""
    now = graph.query_at_time(versions(t), F.lit("1996-06-01").cast("timestamp_ntz")).groupBy("node_id").agg(F.max_by("value", "src_ord").alias("value"))
    rows = now.join(t("customer").select(F.col("c_custkey").alias("node_id"), "c_nationkey"), "node_id").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    g = rows.groupBy("n_name").agg(F.count_if(F.col("value") == "F").alias("closed"), F.count(F.lit(1)).alias("facts"))
    o = O.from_evidence(F.col("closed"), F.col("facts") - F.col("closed"))
    return g.select("n_name", "closed", "facts", r6(o["b"], "b"), r6(o["u"], "u"))


from veridelta.plans import clinical_queries, more_queries  # noqa: E402, F401  these register their queries
