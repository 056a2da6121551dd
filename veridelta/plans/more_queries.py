"""More registered queries: operators one by one, each with SQL written from its formula."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.functions import opinion as O
from veridelta.functions import transport as T
from veridelta.functions import vectors as V
from veridelta.operators import clinical, container, fusion, governance, graph, inference, multinomial, network, similarity, validation
from veridelta.plans.queries import CONF, conf, query, r6, r10, ring
from veridelta.sources import documents, rdf

#: Opinions of unequal base rates with dogmatic rows (u = 0): every fifth event, and of user 1 all.
MIXED = f"""e AS (SELECT event_id, user_id, event_type, ts, {CONF.format('event_id')} AS c, CASE WHEN event_id % 5 = 0 OR user_id = 1 THEN 0.0::DOUBLE ELSE 0.1::DOUBLE + 0.8::DOUBLE * (event_id % 7) / 7 END AS u FROM events),
    o AS (SELECT event_id, user_id, event_type, ts, c * (1 - u) AS b, (1 - c) * (1 - u) AS d, u, 0.1::DOUBLE + 0.2::DOUBLE * (event_id % 4) AS a FROM e)"""
PAIR = """CASE WHEN x.u = 0 AND y.u = 0 THEN {{'b': (x.b + y.b) / 2, 'd': (x.d + y.d) / 2, 'u': 0.0::DOUBLE, 'a': (x.a + y.a) / 2}}
    ELSE {{'b': (x.b * y.u + y.b * x.u) / ({k}), 'd': (x.d * y.u + y.d * x.u) / ({k}), 'u': x.u * y.u / ({k}), 'a': (x.a + y.a) / 2}} END""".format(k="x.u + y.u - x.u * y.u")


def fold(rows: str, by: str, order: str) -> str:
    return f"SELECT {by}, list_reduce(list({{'b': b, 'd': d, 'u': u, 'a': a}} ORDER BY {order}), lambda x, y: {PAIR}) AS f FROM {rows} GROUP BY {by}"


def flat(x: str, digits: int = 6) -> str:
    return f"round({x}.b, {digits}) AS b, round({x}.d, {digits}) AS d, round({x}.u, {digits}) AS u, round({x}.a, {digits}) AS a, round({x}.b + {x}.a * {x}.u, {digits}) AS p"


def mixed(t) -> DataFrame:
    u = F.when((F.col("event_id") % 5 == 0) | (F.col("user_id") == 1), 0.0).otherwise(F.lit(0.1) + F.lit(0.8) * (F.col("event_id") % 7) / 7)
    o = O.from_confidence(conf("event_id"), u, F.lit(0.1) + F.lit(0.2) * (F.col("event_id") % 4))
    return t("events").select("event_id", "user_id", "event_type", "ts", o.alias("opinion"))




# Fusion


@query(f"WITH {MIXED}, f AS ({fold('o', 'user_id', 'event_id')}) SELECT user_id, {flat('f')} FROM f")
def cumulative_fuse_mixed(t):
    """The left fold in order over unequal base rates and dogmatic opinions, one group being dogmatic throughout."""
    return fusion.cumulative_fuse(mixed(t), ["user_id"], order="event_id").select("user_id", *O.flat(F.col("opinion")))


@query(f"WITH {MIXED} SELECT user_id, event_id, " + flat("f") + f" FROM (SELECT x.user_id, x.event_id, {PAIR} AS f FROM o x JOIN o y ON x.user_id = y.user_id AND x.event_id < y.event_id AND y.event_id - x.event_id < 40)")
def cumulative_pairs(t):
    """Fusion of two opinions, as an expression."""
    x = mixed(t).select("user_id", "event_id", F.col("opinion").alias("x"))
    y = mixed(t).select("user_id", F.col("event_id").alias("j"), F.col("opinion").alias("y"))
    rows = x.join(y, "user_id").where((F.col("event_id") < F.col("j")) & (F.col("j") - F.col("event_id") < 40))
    return rows.select("user_id", "event_id", *O.flat(O.cumulative_pair(F.col("x"), F.col("y"))))


@query(f"""WITH c AS (SELECT user_id, {CONF.format('event_id')} AS c FROM events), a AS (SELECT user_id, 1 / (1 + sum(1 / (1 - c)) - count(*)) AS u, sum(c / (1 - c)) AS s FROM c GROUP BY 1), b AS (SELECT user_id, sum(1 / 0.3) AS iu, sum(c * 0.7 / 0.3) AS s, count(*) AS n FROM c GROUP BY 1)
    SELECT user_id, round(a.u * a.s, 6) AS b, 0.0::DOUBLE AS d, round(a.u, 6) AS u, round(a.u * a.s + 0.4 * a.u, 6) AS p, round(b.s / b.iu, 6) AS averaged FROM a JOIN b USING (user_id)""")
def fuse_scalars(t):
    """Scores lifted to opinions and fused: what a score is short of 1 is uncertainty; or averaged, each with an uncertainty of its own."""
    rows = t("events").select("user_id", "event_id", conf("event_id").alias("c"))
    o = F.col("opinion")
    avg = fusion.fuse_scalars(rows, ["user_id"], "c", "averaging", uncertainty=0.3).select("user_id", r6(o["b"], "averaged"))
    return fusion.fuse_scalars(rows, ["user_id"], "c", order="event_id", base_rate=0.4).select("user_id", r6(o["b"], "b"), r6(o["d"], "d"), r6(o["u"], "u"), r6(O.projected(o), "p")).join(avg, "user_id")


@query(f"SELECT l_orderkey, round(product({CONF.format('l_partkey')} * 0.9), 10) AS b, 0.0::DOUBLE AS d, round(1 - product({CONF.format('l_partkey')} * 0.9), 10) AS u, round(product({CONF.format('l_partkey')}), 10) AS certain FROM lineitem GROUP BY 1")
def propagate_opinions(t):
    """Chains of sources, with uncertain and with certain trust."""
    rows = t("lineitem").select("l_orderkey", conf("l_partkey").alias("c"))
    a = inference.propagate_opinions(rows, ["l_orderkey"], "c", 0.1)
    b = inference.propagate_opinions(rows, ["l_orderkey"], "c").select("l_orderkey", r10(O.projected(F.col("opinion")), "certain"))
    return a.select("l_orderkey", r10(F.col("opinion")["b"], "b"), r10(F.col("opinion")["d"], "d"), r10(F.col("opinion")["u"], "u")).join(b, "l_orderkey")


@query(f"""WITH c AS (SELECT o_custkey, o_orderstatus AS value, {CONF.format('o_orderkey')} AS c, o_orderkey FROM orders), w AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY c DESC, o_orderkey) = 1),
    n AS (SELECT o_custkey, count(*) AS n, list(value || '=' || round(m, 4)::VARCHAR ORDER BY value) AS s FROM (SELECT o_custkey, value, count(*) AS n, max(c) AS m FROM c GROUP BY 1, 2) GROUP BY 1), k AS (SELECT o_custkey, count(*) AS k FROM c GROUP BY 1)
    SELECT o_custkey, value, round(c, 6) AS b, round(1 - c, 6) AS d, k AS candidates, CASE WHEN k = 1 THEN 'the only candidate' ELSE 'highest confidence' END AS reason, n AS kinds FROM w JOIN n USING (o_custkey) JOIN k USING (o_custkey)""")
def conflict_report(t):
    """The winner as an opinion, and why it won."""
    rows = t("orders").select("o_custkey", F.col("o_orderstatus").alias("value"), conf("o_orderkey").alias("c"), "o_orderkey")
    won = inference.resolve_with_opinions(rows, ["o_custkey"], "value", "c", "o_orderkey").select("o_custkey", "value", r6(F.col("opinion")["b"], "b"), r6(F.col("opinion")["d"], "d"))
    why = inference.conflict_report(rows, ["o_custkey"], "value", "c", "o_orderkey").select("o_custkey", "candidates", "reason", F.size("scores").cast("long").alias("kinds"))
    return won.join(why, "o_custkey")


AGENTS = f"""a AS (SELECT s_nationkey AS g, s_suppkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, CASE WHEN s_suppkey % 3 = 0 THEN 0.1::DOUBLE ELSE 0.6::DOUBLE + 0.01 * (s_suppkey % 20) END AS b,
    CASE WHEN s_suppkey % 3 = 0 THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END AS d, 0.3::DOUBLE + 0.1 * (s_suppkey % 5) AS a, 0.05::DOUBLE * (s_suppkey % 17) AS w FROM supplier)"""


def agents(t) -> DataFrame:
    bad = F.col("s_suppkey") % 3 == 0
    b, d = F.when(bad, 0.1).otherwise(F.lit(0.6) + F.lit(0.01) * (F.col("s_suppkey") % 20)), F.when(bad, 0.8).otherwise(0.1)
    return t("supplier").select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("k"), (F.lit(0.05) * (F.col("s_suppkey") % 17)).alias("w"), O.opinion(b, d, 1 - b - d, F.lit(0.3) + F.lit(0.1) * (F.col("s_suppkey") % 5)).alias("opinion"))


def removals(score: str, pick: str) -> str:
    """SQL of iterative removal: at most half of a group's agents go, one by one, while the chosen one's mean conflict is 0.15 or more and two are left."""
    step = f"""SELECT r.g, r.n, r.gone + 1, list_filter(r.live, lambda x: x.k <> (list_sort(list_transform(r.live, lambda x: {{'s': -({pick}), 'k': x.k, 'o': {score}}}))[1]).k)
        FROM r WHERE r.gone < r.n // 2 AND len(r.live) > 2 AND (list_sort(list_transform(r.live, lambda x: {{'s': -({pick}), 'k': x.k, 'o': {score}}}))[1]).o >= 0.15"""
    return f"""WITH RECURSIVE {AGENTS}, r(g, n, gone, live) AS (SELECT g, count(*), 0, list({{'k': k, 'b': b, 'd': d, 'u': 1 - b - d, 'a': a, 'w': w}} ORDER BY k) FROM a GROUP BY g UNION ALL {step}),
        z AS (SELECT g, n, gone, live FROM r QUALIFY row_number() OVER (PARTITION BY g ORDER BY gone DESC) = 1),
        f AS (SELECT g, gone, list_reduce(list_transform(live, lambda x: {{'b': x.b, 'd': x.d, 'u': x.u, 'a': x.a}}), lambda x, y: {PAIR}) AS f FROM z)
        SELECT g, gone::BIGINT AS removed, round(f.b, 6) AS b, round(f.d, 6) AS d, round(f.u, 6) AS u, round(f.a, 6) AS a FROM f"""


DISCORD = "(x.b * (list_sum(list_transform(r.live, lambda z: z.d)) - x.d) + x.d * (list_sum(list_transform(r.live, lambda z: z.b)) - x.b)) / (len(r.live) - 1)"


def _removed(t, config: fusion.ByzantineConfig) -> DataFrame:
    return fusion.byzantine_fuse(agents(t), ["g"], "k", config=config).select("g", F.size("removed").cast("long").alias("removed"), *[r6(F.col("opinion")[k], k) for k in "bdua"])


@query(removals(DISCORD, f"round({DISCORD}, 12)"))
def byzantine_most_conflicting(t):
    """Agents that contradict the rest of their nation go one by one."""
    return _removed(t, fusion.ByzantineConfig())


@query(removals(DISCORD, f"round(({DISCORD}) * (1 - x.w), 12)"))
def byzantine_combined(t):
    """Removal by conflict and missing trust together."""
    return _removed(t, fusion.ByzantineConfig(strategy="combined", trust="w"))


@query(f"""WITH {AGENTS} SELECT x.g, x.k AS i, y.k AS j, round(x.b * y.d + x.d * y.b, 6) AS conflict, round((abs(x.b - y.b) + abs(x.d - y.d) + abs((1 - x.b - x.d) - (1 - y.b - y.d))) / 2, 6) AS manhattan FROM a x JOIN a y ON x.g = y.g AND x.k < y.k""")
def conflict_matrix(t):
    """Conflicts and distances of all pairs of a nation."""
    pairs = fusion.conflicts(agents(t), ["g"], "k", how=["conflict", "manhattan"], spread=16)
    return pairs.select("g", "i", "j", r6(F.col("conflict"), "conflict"), r6(F.col("manhattan"), "manhattan"))


@query(f"""WITH {AGENTS}, f AS ({fold("(SELECT g, k, b, d, 1 - b - d AS u, a FROM a)", "g", "k")}), c AS (SELECT x.g, max(x.b * y.d + x.d * y.b) AS m, count(*) AS pairs FROM a x JOIN a y ON x.g = y.g AND x.k < y.k GROUP BY 1), n AS (SELECT g, count(*) AS n FROM a GROUP BY 1)
    SELECT g, n AS input_count, round(f.b, 6) AS b, round(f.u, 6) AS u, coalesce(pairs, 0) AS pairs, round(m, 6) AS worst FROM n JOIN f USING (g) LEFT JOIN c USING (g)""")
def fusion_report(t):
    out = fusion.fusion_report(agents(t), ["g"], "k", scores=False)
    return out.select("g", "input_count", r6(F.col("opinion")["b"], "b"), r6(F.col("opinion")["u"], "u"), "pairs", r6(F.col("worst"), "worst"))


# Opinions


@query(f"WITH {MIXED} SELECT event_id, {flat('o')} FROM o")
def opinion_documents(t):
    """Opinions as documents and back."""
    return mixed(t).select("event_id", O.from_document(O.to_document(F.col("opinion"))).alias("opinion")).select("event_id", *O.flat(F.col("opinion")))


@query(f"""WITH {MIXED} SELECT event_id, 0.0::DOUBLE AS vb, 1.0::DOUBLE AS vu, round(a, 6) AS va, round(d, 6) AS ab, round(b, 6) AS ad, round(1 - a, 6) AS aa, round(a, 6) AS prior FROM o""")
def counterfactuals(t):
    v, a, p = O.vacuous_counterfactual(F.col("opinion")), O.adversarial_counterfactual(F.col("opinion")), O.COUNTERFACTUALS["prior"](F.col("opinion"))
    return mixed(t).select("event_id", r6(v["b"], "vb"), r6(v["u"], "vu"), r6(v["a"], "va"), r6(a["b"], "ab"), r6(a["d"], "ad"), r6(a["a"], "aa"), r6(O.projected(p), "prior"))


@query(f"""WITH {MIXED}, m AS (SELECT event_id, o.*, b * 0.7 * 0.8 AS mb, (1 - d) * 0.9 * 0.95 AS mk, pow(b, 6) AS cb, pow(1 - d, 6) AS ck FROM o)
    SELECT event_id, round(mb, 10) AS pb, round(1 - mk, 10) AS pd, round(a * 0.25, 10) AS pa, round(cb, 10) AS cb, round(1 - ck, 10) AS cd, round(pow(a, 6), 10) AS ca,
    round(CASE WHEN event_id % 10 < 5 THEN b ELSE 0.0 END, 6) AS wb, round(CASE WHEN event_id % 10 < 5 THEN b ELSE b * pow(2.0, -(event_id % 10 - 5) / 4.0) END, 6) AS rb FROM m""")
def compliance_steps(t):
    """Propagation, six conditions of consent, withdrawal and review, for each event."""
    p = O.propagate_compliance(F.col("opinion"), O.opinion(0.7, 0.1, 0.2), O.opinion(0.8, 0.05, 0.15))
    c = O.consent_validity(*[F.col("opinion")] * 6)
    w = O.withdrawal(F.col("opinion"), O.opinion(0.0, 1.0, 0.0), F.col("event_id") % 10, F.lit(5))
    r = O.review_due(F.col("opinion"), F.col("event_id") % 10, F.lit(5), 4.0)
    return mixed(t).select("event_id", r10(p["b"], "pb"), r10(p["d"], "pd"), r10(p["a"], "pa"), r10(c["b"], "cb"), r10(c["d"], "cd"), r10(c["a"], "ca"), r6(w["b"], "wb"), r6(r["b"], "rb"))


@query(f"""WITH s AS (SELECT l_orderkey, {CONF.format('l_partkey')} AS t, 0.9::DOUBLE AS q FROM lineitem), p AS (SELECT l_orderkey, product(t * 0.9 * q) AS b, product(1.0 - 0.05) AS k, count(*) AS n FROM s GROUP BY 1)
    SELECT l_orderkey, round(0.8 * b, 10) AS b, round(1 - 0.9 * k, 10) AS d, round(greatest(0, 0.9 * k - 0.8 * b), 10) AS u FROM p""")
def provenance_chain(t):
    """Compliance of an order passed on by each of its lines, with trust and purpose."""
    c = conf("l_partkey")
    rows = t("lineitem").select("l_orderkey", "l_linenumber", O.opinion(0.8, 0.1, 0.1).alias("source"), O.opinion(c * 0.9, 0.05, 0.95 - c * 0.9).alias("trust"), O.opinion(0.9, 0.0, 0.1).alias("purpose"))
    return governance.provenance_chain(rows, ["l_orderkey"], order="l_linenumber").select("l_orderkey", r10(F.col("opinion")["b"], "b"), r10(F.col("opinion")["d"], "d"), r10(F.col("opinion")["u"], "u"))


@query(f"""WITH o AS (SELECT o_orderkey, {CONF.format('o_orderkey')} * 0.9 AS b, (1 - {CONF.format('o_orderkey')}) * 0.9 AS d, epoch_us(TIMESTAMP '1996-06-01 00:00:00')::DOUBLE / 86400000000 - epoch_us(o_orderdate)::DOUBLE / 86400000000 AS days FROM orders),
    f AS (SELECT o_orderkey, b, d, CASE WHEN o_orderkey % 3 = 0 OR days < 0 THEN 1.0 ELSE pow(2.0, -days / CASE WHEN o_orderkey % 3 = 1 THEN 100.0 / 4 ELSE 365.0 / 4 END) END AS f FROM o) SELECT o_orderkey, round(b * f, 10) AS b, round(d * f, 10) AS d, round(1 - (b + d) * f, 10) AS u FROM f""")
def review_due(t):
    """Assessments past their review date age at a quarter of their half-life; those without a schedule stay."""
    rows = t("orders").select(F.col("o_orderkey").alias("assessment_id"), O.from_confidence(conf("o_orderkey"), 0.1).alias("opinion"))
    plan = t("orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("assessment_id"), F.col("o_orderdate").alias("due"), F.when(F.col("o_orderkey") % 3 == 1, 100.0).alias("half_life"))
    return governance.review_due(rows, plan.dropDuplicates(["assessment_id"]), F.lit("1996-06-01")).select(F.col("assessment_id").alias("o_orderkey"), *[r10(F.col("opinion")[k], k) for k in "bdu"])


# Documents and metadata

ANNOTATED = f"""x AS (SELECT p_partkey, p_name, {CONF.format('p_partkey')} AS c FROM part)"""


@query(f"""WITH {ANNOTATED} SELECT p_partkey, round(c, 6) AS confidence, 'src' || p_partkey % 5 AS source, p_partkey % 2 = 0 AS human_verified, CASE WHEN p_partkey % 3 = 0 THEN 'text/plain' END AS media_type, p_partkey % 100 AS aggregation_count,
    '["a","b' || p_partkey || '"]' AS derived_from, NULL::VARCHAR AS unit, 22 AS fields FROM x""")
def provenance_record(t):
    """Annotated values as JSON, and their record of 22 fields."""
    k = F.col("p_partkey")
    a = documents.annotate(F.col("p_name"), conf("p_partkey"), source=F.concat(F.lit("src"), (k % 5).cast("string")), human_verified=k % 2 == 0, media_type=F.when(k % 3 == 0, "text/plain"), aggregation_count=k % 100, derived_from=F.array(F.lit("a"), F.concat(F.lit("b"), k.cast("string"))))
    names = ["confidence", "source", "human_verified", "media_type", "aggregation_count", "derived_from"]
    r = t("part").select("p_partkey", documents.provenance(documents.to_document(a, names)).alias("r"))
    return r.select("p_partkey", r6(F.col("r.confidence"), "confidence"), "r.source", "r.human_verified", "r.media_type", "r.aggregation_count", "r.derived_from", "r.unit", F.lit(len(documents.PROVENANCE)).alias("fields"))


def part_documents(t) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    doc = F.struct(F.concat(F.lit("part:"), k).alias("@id"), F.lit("Part").alias("@type"), documents.annotate(F.col("p_name"), conf("p_partkey"), source=F.concat(F.lit("src"), (F.col("p_partkey") % 5).cast("string"))).alias("name"), F.struct(F.col("p_size").alias("value"), conf("p_size").alias("confidence")).alias("size"))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.to_json(doc), '"value":', '"@value":'), '"confidence":', '"@confidence":'), '"source":', '"@source":')
    return t("part").select("p_partkey", text.alias("json"))


@query(f"""SELECT p_partkey FROM part WHERE {CONF.format('p_partkey')} >= 0.7 AND {CONF.format('p_size')} >= 0.4""")
def filter_documents_by_confidence(t):
    """Documents parsed to assertions, of which those of confident nodes stay."""
    rows = documents.assertions(part_documents(t), "json", order="p_partkey")
    kept = documents.filter_by_confidence(rows, {"name": 0.7, "size": 0.4})
    return kept.select(F.regexp_extract("node_id", r"(\d+)", 1).cast("long").alias("p_partkey")).distinct()


@query(f"""SELECT p_partkey, 'name' AS prop, p_name AS value, round({CONF.format('p_partkey')}, 6) AS confidence, 'src' || p_partkey % 5 AS source FROM part UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR, round({CONF.format('p_size')}, 6), NULL FROM part""")
def annotated_assertions(t):
    """Every annotated value of the documents with its confidence and source."""
    rows = documents.assertions(part_documents(t), "json", order="p_partkey")
    return rows.select(F.col("src_ord").alias("p_partkey"), "prop", "value", r6(F.col("confidence"), "confidence"), "source")


@query(f"""WITH o AS (SELECT o_orderkey, o_orderdate AS f, o_orderdate + INTERVAL 30 DAY AS u FROM orders) SELECT o_orderkey, f AS valid_from, u AS valid_until, f <= TIMESTAMP '1995-06-01' AND u >= TIMESTAMP '1995-06-01' AS holds FROM o""")
def add_temporal(t):
    """Validity put on assertions, and whether they hold at an instant."""
    rows = t("orders").select("o_orderkey", F.col("o_orderkey").alias("node_id"), F.lit("status").alias("prop"), F.col("o_orderstatus").alias("value"), F.col("o_orderdate").alias("f"))
    x = graph.add_temporal(F.col("value"), F.col("f").cast("timestamp"), (F.col("f") + F.expr("INTERVAL 30 DAY")).cast("timestamp"))
    timed = rows.select("o_orderkey", x.alias("x")).select("o_orderkey", "x.*")
    held = graph.valid_at(F.col("valid_from"), F.col("valid_until"), F.lit("1995-06-01").cast("timestamp"))
    return timed.select("o_orderkey", F.col("valid_from").cast("timestamp_ntz").alias("valid_from"), F.col("valid_until").cast("timestamp_ntz").alias("valid_until"), held.alias("holds"))


@query(f"""WITH a AS (SELECT s_suppkey, s_nationkey, n_regionkey, {CONF.format('s_suppkey')} AS c, {CONF.format('n_nationkey')} AS e FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT s_suppkey, n_regionkey AS region, round(c * e, 10) AS multiply, round(least(c, e), 10) AS "min" FROM a""")
def propagate_path(t):
    """Confidence along a path of two properties through the graph."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = t("supplier").select(key("s", "s_suppkey").alias("source"), F.lit("in").alias("prop"), key("n", "s_nationkey").alias("target"), conf("s_suppkey").alias("confidence"))
    e = e.unionByName(t("nation").select(key("n", "n_nationkey").alias("source"), F.lit("part").alias("prop"), key("r", "n_regionkey").alias("target"), conf("n_nationkey").alias("confidence")))
    start = t("supplier").select(key("s", "s_suppkey").alias("node"))
    one, two = (inference.propagate_path(start, e, ["in", "part"], m).withColumnRenamed("score", m) for m in ("multiply", "min"))
    num = lambda c: F.substring(c, 2, 20).cast("int")
    return one.join(two, ["start", "node"]).select(num("start").cast("long").alias("s_suppkey"), num("node").alias("region"), r10(F.col("multiply"), "multiply"), r10(F.col("min"), "min"))


# Governance

PROTECTED = """p AS (SELECT c_custkey, c_custkey % 50 AS s, ['regular', 'sensitive', 'special_category', 'pseudonymized', 'anonymized', 'synthetic', 'non_personal'][1 + c_custkey % 7] AS category FROM customer)"""


def protected(t) -> DataFrame:
    cats = F.array(*[F.lit(c) for c in governance.CATEGORIES])
    k = F.col("c_custkey")
    m = governance.annotate_protection(F.col("c_name"), category=F.element_at(cats, (k % 7 + 1).cast("int")), legal_basis=F.lit("consent"), access_level=F.lit("internal"), data_subject=(k % 50).cast("string"))
    return t("customer").select("c_custkey", m.alias("m")).select("c_custkey", k.cast("string").alias("node_id"), F.lit("name").alias("prop"), "m.*")


@query(f"WITH {PROTECTED} SELECT c_custkey, category, category IN ('regular', 'sensitive', 'special_category', 'pseudonymized') AS personal, category IN ('sensitive', 'special_category') AS sensitive, 'consent' AS legal_basis FROM p")
def protection_metadata(t):
    """Protection metadata built, checked and read."""
    return protected(t).select("c_custkey", "category", governance.is_personal(F.col("category")).alias("personal"), governance.is_sensitive(F.col("category")).alias("sensitive"), "legal_basis")


@query("""WITH c AS (SELECT event_id, ts AS g, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 5 DAY END AS w FROM events) SELECT event_id, g <= TIMESTAMP '2024-01-15' AND (w IS NULL OR TIMESTAMP '2024-01-15' < w) AS active, w IS NULL AS ever, 2 AS scopes FROM c""")
def consent_records(t):
    """Consents as records, and whether they are active at an instant, or at all."""
    w = F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("INTERVAL 5 DAY"))
    r = t("events").select("event_id", governance.consent_record(F.col("ts"), F.array(F.lit("research"), F.col("event_type")), F.lit("specific"), w).alias("r"))
    at = F.lit("2024-01-15").cast("timestamp_ntz")
    return r.select("event_id", governance.is_consent_active(F.col("r.given_at"), F.col("r.withdrawn_at"), at).alias("active"), governance.is_consent_active(F.col("r.given_at"), F.col("r.withdrawn_at")).alias("ever"), F.size("r.scope").alias("scopes"))


@query(f"WITH {PROTECTED} SELECT s::VARCHAR AS data_subject, count(*) AS planned, count(*) FILTER (s = 7) AS erased, count(*) FILTER (s = 8) AS restricted, min(c_custkey::VARCHAR) AS first FROM p GROUP BY 1")
def subject_rights(t):
    """Plans of erasure for every subject, what was erased of one, and what was restricted of another."""
    rows = protected(t)
    plan = governance.erasure_plan(rows).select("data_subject", F.col("affected_property_count").alias("planned"), F.element_at("affected_node_ids", 1).alias("first"))
    gone = governance.erasure_audit(governance.execute_erasure(governance.request_erasure(rows, "7", F.lit("2024-01-01")), "7", F.lit("2024-01-02"))).select("data_subject", F.col("erased_property_count").alias("erased"))
    kept = governance.restriction_result(governance.request_restriction(rows, "8", "disputed")).select("data_subject", F.col("restricted_property_count").alias("restricted"))
    return plan.join(gone, "data_subject", "left").join(kept, "data_subject", "left").select("data_subject", "planned", F.coalesce("erased", F.lit(0)).alias("erased"), F.coalesce("restricted", F.lit(0)).alias("restricted"), "first")


@query(f"WITH {PROTECTED} SELECT c_custkey::VARCHAR AS node_id, CASE WHEN s = 9 THEN 'corrected' ELSE c_name END AS value, s = 9 AS rectified, CASE WHEN s = 9 THEN '{{\"name\":[\"corrected\"]}}' END AS record FROM p JOIN customer USING (c_custkey)")
def rectification(t):
    """Values of a subject rectified, and what the subject can take along."""
    rows = governance.rectify(protected(t).withColumn("src_ord", F.lit(0)), F.col("data_subject") == "9", F.lit("corrected"), "typo", F.lit("2024-01-01"))
    return rows.join(governance.export_portable(rows, "9"), "node_id", "left").select("node_id", "value", F.col("rectified_at").isNotNull().alias("rectified"), "record")


@query(f"WITH {PROTECTED} SELECT c_custkey::VARCHAR AS node_id, category, CASE WHEN s = 3 THEN true END AS requested FROM p WHERE s = 3")
def audit_trail(t):
    rows = governance.request_erasure(protected(t), "3", F.lit("2024-01-01"))
    return governance.audit_trail(rows, "3").select("node_id", "category", F.col("erasure_requested").alias("requested"))


@query("""WITH RECURSIVE c(start, node) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT start, node // 3 FROM c WHERE node // 3 > 0 AND node > 1), o AS (SELECT s_suppkey AS k, 0.8 + 0.001 * (s_suppkey % 100) AS b, 0.01 * (s_suppkey % 3) AS d FROM supplier)
    SELECT start, count(*) AS ancestors, round(product(coalesce(b, 0)), 10) AS b, round(1 - product(1 - coalesce(d, 0)), 10) AS d FROM c LEFT JOIN o ON node = k GROUP BY 1""")
def contamination_risk(t):
    """What ancestors leave in each node of a tree of suppliers."""
    k = F.col("s_suppkey")
    edges = t("supplier").where("s_suppkey >= 3").select(F.floor(k / 3).cast("long").alias("parent"), k.alias("child"))
    b, d = F.lit(0.8) + F.lit(0.001) * (k % 100), F.lit(0.01) * (k % 3)
    ops = t("supplier").select(k.alias("node"), O.opinion(b, d, 1 - b - d).alias("opinion"))
    start = t("supplier").select(k.alias("node"))
    n = governance.closure(edges, start, "child", "parent").groupBy("start").agg(F.count(F.lit(1)).alias("ancestors"))
    return governance.contamination_risk(edges, start, ops).join(n, "start").select("start", "ancestors", r10(F.col("opinion")["b"], "b"), r10(F.col("opinion")["d"], "d"))


# Vectors

VECS = "q AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings), z AS (SELECT x.vec_id, x.v AS v, y.v AS w FROM q x JOIN q y ON y.vec_id = x.vec_id // 10 * 10)"


def starred(t) -> DataFrame:
    """Every vector beside that of the decade's first."""
    v = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return v.withColumn("_k", F.floor(F.col("vec_id") / 10).cast("long") * 10).join(v.select(F.col("vec_id").alias("_k"), F.col("v").alias("w")), "_k")


ABS = "list_transform(range(1, len(v) + 1), lambda i: abs(v[i]) + 0.001)"
ABSW = "list_transform(range(1, len(w) + 1), lambda i: abs(w[i]) + 0.001)"


@query(f"""WITH {VECS}, n AS (SELECT vec_id, v, w, list_transform({ABS}, lambda x: x / list_sum({ABS})) AS p, list_transform({ABSW}, lambda x: x / list_sum({ABSW})) AS r FROM z)
    SELECT vec_id, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN abs(v[i]) + abs(w[i]) = 0 THEN 0 ELSE abs(v[i] - w[i]) / (abs(v[i]) + abs(w[i])) END)), 6) AS canberra,
    round(list_sum(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - w[i]))) / list_sum(list_transform(range(1, len(v) + 1), lambda i: abs(v[i]) + abs(w[i]))), 6) AS bray_curtis,
    round(list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i] * ln(p[i] / r[i]))), 6) AS kl, round(list_sum(list_transform(range(1, len(p) + 1), lambda i: abs(list_sum(p[1:i]) - list_sum(r[1:i])))), 6) AS wasserstein FROM n""")
def distribution_metrics(t):
    """Metrics of absolute values and of distributions made of them."""
    part = lambda c: V.shares(F.transform(c, lambda x: F.abs(x) + 0.001))
    v, w, p, r = (F.col(c) for c in "vwpr")
    rows = starred(t).select("vec_id", "v", "w", part("v").alias("p"), part("w").alias("r"))
    return rows.select("vec_id", r6(V.canberra(v, w), "canberra"), r6(V.bray_curtis(v, w), "bray_curtis"), r6(V.kl_divergence(p, r), "kl"), r6(V.wasserstein(p, r), "wasserstein"))


@query(f"""WITH {VECS}, g AS (SELECT vec_id, 80 * v[1] AS la, 170 * v[2] AS lo, 80 * w[1] AS lb, 170 * w[2] AS lp, v, w FROM z), h AS (SELECT *, pow(sin(radians(lb - la) / 2), 2) + cos(radians(la)) * cos(radians(lb)) * pow(sin(radians(lp - lo) / 2), 2) AS x FROM g)
    SELECT vec_id, round(2 * 6371.0088 * asin(sqrt(x)), 4) AS haversine, round(sqrt(list_sum(list_transform(range(1, len(v) + 1), lambda i: pow(v[i] - w[i], 2) * (1 + i % 3)))), 6) AS mahalanobis FROM h""")
def shaped_metrics(t):
    """Great-circle distance, and Mahalanobis distance by a diagonal inverse covariance."""
    inverse = [[float(1 + (i + 1) % 3) if i == j else 0.0 for j in range(64)] for i in range(64)]
    at = lambda c: F.array(80 * F.col(c)[0], 170 * F.col(c)[1])
    return starred(t).select("vec_id", F.round(V.haversine(at("v"), at("w")), 4).alias("haversine"), r6(V.mahalanobis(inverse)(F.col("v"), F.col("w")), "mahalanobis"))


@query("""WITH q AS (SELECT vec_id, embedding, vec_id % 4 AS k FROM embeddings) SELECT vec_id, CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 1 END AS errors, k = 0 AS valid, CASE k WHEN 0 THEN 64 WHEN 1 THEN 63 ELSE -1 END AS size FROM q""")
def vector_checks(t):
    """Vectors of the right size, too short, absent, and with a number that is not finite."""
    v, k = F.col("embedding").cast("array<double>"), F.col("vec_id") % 4
    odd = F.when(k == 0, v).when(k == 1, F.slice(v, 1, 63)).when(k == 3, F.transform(v, lambda x, i: F.when(i == 5, F.lit(float("inf"))).otherwise(x)))
    rows = t("embeddings").select("vec_id", odd.alias("v"), k.alias("k"))
    return rows.select("vec_id", F.size(V.vector_errors(F.col("v"), 64)).alias("errors"), V.is_vector(F.col("v"), 64).alias("valid"), F.when(F.col("k") < 2, F.size("v")).otherwise(-1).alias("size"))


@query("SELECT vec_id, len(embedding) AS size, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total, '{\"a\": {\"label\": ' || label || '}}' AS rest FROM embeddings")
def vector_documents(t):
    """Vectors taken out of documents, and documents without them."""
    doc = F.to_json(F.struct(F.col("embedding").alias("vec"), F.struct(F.col("embedding").alias("vec"), F.col("label")).alias("a")))
    got = V.extract_vectors(doc, ["vec", "label"])
    return t("embeddings").select("vec_id", F.size(got["vec"]).alias("size"), F.round(F.aggregate(got["vec"], F.lit(0.0), lambda s, x: s + x), 4).alias("total"), V.strip_vectors(doc, ["vec"]).alias("rest"))


@query("""SELECT * FROM (VALUES ('cosine', 1, 9.0::DOUBLE), ('dot_product', 2, 6.0), ('euclidean', 3, 5.0)) v(metric, rank, points)""")
def recommend_metric(t):
    """What is advised for vectors of unit length and 64 dimensions."""
    rows = similarity.recommend_metric(t("embeddings"), "embedding")
    return t("embeddings").sparkSession.createDataFrame([(m, i + 1, n) for i, (m, n, _) in enumerate(rows)], "metric string, rank int, points double")


@query("""SELECT * FROM (VALUES ('cosine', 1, 11.0::DOUBLE), ('hamming', 2, 10.0), ('jaccard', 3, 10.0), ('dot_product', 4, 6.0), ('euclidean', 5, 4.0)) v(metric, rank, points)""")
def recommend_metric_binary(t):
    """What is advised for binary vectors of unit length: a one for each label."""
    hot = t("embeddings").select(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == F.col("label"), 1.0).otherwise(0.0)).alias("v"))
    rows = similarity.recommend_metric(hot, "v")
    return hot.sparkSession.createDataFrame([(m, i + 1, n) for i, (m, n, _) in enumerate(rows)], "metric string, rank int, points double")


@query("""WITH p AS (SELECT x.vec_id AS i, y.vec_id AS j, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS c FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id) SELECT i, j, round(c, 6) AS cosine FROM p""")
def cosine_within_labels(t):
    """Cosine of all pairs of one label."""
    return similarity.cosine_pairs(t("embeddings"), ["label"], "vec_id", "embedding").select("i", "j", r6(F.col("cosine"), "cosine"))


# Opinions over many states


@query("""WITH c AS (SELECT user_id, event_type AS s, count(*) AS r FROM events GROUP BY 1, 2), k AS (SELECT user_id, count(*) AS k, sum(r) AS t FROM c GROUP BY 1), w AS (SELECT user_id, k, t, (k + 2 * k * t) / (1 + k * t) AS w FROM (SELECT user_id, k::DOUBLE AS k, t::DOUBLE AS t FROM k))
    SELECT user_id, s AS state, round(r / (t + w), 6) AS b, round(w / (t + w), 6) AS u, round(1 / k, 6) AS a, k >= 2 AS valid FROM c JOIN w USING (user_id)""")
def multinomial_documents(t):
    """Opinions over many states as documents and back, checked."""
    rows = multinomial.from_evidence(t("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("r")), ["user_id"], "event_type", "r")
    back = multinomial.from_document(multinomial.to_document(rows, ["user_id"]), ["user_id"])
    return back.join(multinomial.is_valid(back, ["user_id"]), "user_id").select("user_id", "state", r6(F.col("b"), "b"), r6(F.col("u"), "u"), r6(F.col("a"), "a"), "valid")


@query(f"WITH {MIXED} SELECT event_id, 'T' AS state, round(b, 6) AS b, round(u, 6) AS u, round(a, 6) AS a FROM o UNION ALL SELECT event_id, 'F', round(d, 6), round(u, 6), round(1 - a, 6) FROM o")
def multinomial_promote(t):
    return multinomial.promote(mixed(t).select("event_id", "opinion"), ["event_id"]).select("event_id", "state", r6(F.col("b"), "b"), r6(F.col("u"), "u"), r6(F.col("a"), "a"))


# Messages


@query(f"SELECT event_id, 'ld/x' AS topic, round({CONF.format('event_id')}, 6) AS c, event_id % 3 = 0 AS compressed FROM events")
def message_round_trip(t):
    """Documents as messages, compressed or not, and back."""
    doc = F.to_json(F.struct(F.lit("ld/x").alias("topic"), conf("event_id").alias("c"), F.col("props"), F.array(F.lit(1), F.lit(-70000)).alias("n")))
    raw = F.when(F.col("event_id") % 3 == 0, T.to_payload(doc)).otherwise(T.to_payload(doc, False))
    rows = t("events").select("event_id", raw.alias("raw"), (F.col("event_id") % 3 == 0).alias("compressed"))
    back = rows.select("event_id", "compressed", F.when(F.col("compressed"), T.from_payload(F.when(F.col("compressed"), F.col("raw")))).otherwise(T.from_payload(F.col("raw"), False)).alias("j"))
    v = F.from_json("j", "topic string, c double")
    return back.select("event_id", v["topic"].alias("topic"), r6(v["c"], "c"), "compressed")


@query(f"""WITH x AS (SELECT event_id, event_id % 6 AS k, {CONF.format('event_id')} AS c FROM events) SELECT event_id, CASE WHEN k = 0 OR k = 4 THEN 2 WHEN k = 1 THEN 1 WHEN c >= 0.9 THEN 2 WHEN c >= 0.5 THEN 1 ELSE 0 END AS qos, CASE WHEN k IN (0, 2, 3, 5) THEN round(c, 6) END AS confidence_used, k = 0 OR k = 4 AS human_verified,
    CASE WHEN k IN (0) THEN 'human verified (document-level)' WHEN k = 4 THEN 'human verified (property ''b'')' WHEN k = 1 THEN 'no confidence' ELSE 'confidence ' || CASE WHEN c >= 0.9 THEN 'of 0.9 or more' WHEN c >= 0.5 THEN 'from 0.5 below 0.9' ELSE 'below 0.5' END || CASE WHEN k = 2 THEN ' (document-level)' WHEN k = 3 THEN ' (property ''b'')' ELSE ' (property ''z'')' END END AS reasoning FROM x""")
def quality_of_service_detailed(t):
    """Quality of service by a document's own confidence or that of its first property that has one, with the reason."""
    c, k = F.round(conf("event_id"), 6).cast("string"), F.col("event_id") % 6
    doc = F.when(k == 0, F.concat(F.lit('{"@humanVerified":true,"@confidence":'), c, F.lit("}"))).when(k == 1, F.lit('{"a":1,"b":{"x":2}}')).when(k == 2, F.concat(F.lit('{"b":{"@confidence":0.95},"@confidence":'), c, F.lit("}")))
    doc = doc.when(k == 3, F.concat(F.lit('{"a":7,"b":{"@confidence":'), c, F.lit('},"c":{"@confidence":1}}'))).when(k == 4, F.lit('{"b":{"@humanVerified":true},"c":{"@confidence":0.1}}')).otherwise(F.concat(F.lit('{"z":{"@confidence":'), c, F.lit('},"a":{"@humanVerified":true}}')))
    rows = t("events").select("event_id", T.quality_of_service_detailed(doc).alias("q"))
    return rows.select("event_id", "q.qos", r6(F.col("q.confidence_used"), "confidence_used"), "q.human_verified", "q.reasoning")


@query("""SELECT doc_id, true AS whole, doc_id % 4 <> 0 AS altered_passes, lang IN ('en', 'fr') AS allowed, length(text) <= 2000 AS within FROM documents""")
def security_checks(t):
    """Integrity of texts that were altered or not, a list of contexts, and limits of size."""
    text = F.col("text")
    other = F.when(F.col("doc_id") % 4 == 0, F.concat(text, F.lit("x"))).otherwise(text)
    url = F.concat(F.lit("http://example.org/"), "lang", F.lit("/v1"))
    rows = t("documents").select("doc_id", T.verify_integrity(text, T.integrity(text, "sha512")).alias("whole"), T.verify_integrity(other, T.integrity(text)).alias("altered_passes"), T.is_context_allowed(url, ["http://example.org/en/v1"], ["*/fr/*"]).alias("allowed"), T.within_limits(text, 2000, 10_000).alias("within"))
    return rows


@query("""WITH x AS (SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS j, ts FROM events) SELECT event_id, length(j) AS json, CASE WHEN event_id < 24 THEN 1 WHEN event_id < 256 THEN 2 WHEN event_id < 65536 THEN 3 ELSE 5 END + 1 + 9 + 11 + 1 + length(regexp_extract(j, '"event_type":"([a-z]+)"', 1)) AS cbor,
    CASE WHEN ts > TIMESTAMP '2024-01-15' THEN ceil((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15')) / 1000000.0)::BIGINT ELSE 0 END AS expiry FROM x""")
def payload_sizes(t):
    """Bytes of messages as JSON and as CBOR, and their expiry."""
    doc = F.to_json(F.struct("event_id", "event_type"))
    s = T.payload_stats(doc)
    m = T.mqtt5_properties(True, F.col("ts"), F.lit("2024-01-15").cast("timestamp_ntz"))
    return t("events").select("event_id", s["json"].alias("json"), s["cbor"].alias("cbor"), m["message_expiry_interval"].alias("expiry"))


# Networks


def diamond(t) -> tuple[DataFrame, DataFrame]:
    """A diamond under each supplier: two middle nodes, and one below both."""
    k = F.col("s_suppkey").cast("string")
    name = lambda p: F.concat(F.lit(p), k)
    none = F.lit(None).cast(O.SCHEMA)
    nodes = t("supplier").select(F.explode(F.array(*[F.struct(name(p).alias("node"), (O.from_confidence(conf("s_suppkey"), 0.2, 0.3).cast(O.SCHEMA) if p == "a" else none).alias("opinion")) for p in "abcd"])).alias("x")).select("x.*")
    g = {"ab": (O.opinion(0.7, 0.1, 0.2), O.opinion(0.1, 0.6, 0.3, 0.4)), "ac": (O.opinion(0.5, 0.2, 0.3, 0.2), O.opinion(0.2, 0.2, 0.6)), "bd": (O.opinion(0.9, 0.0, 0.1), O.opinion(0.0, 0.5, 0.5)), "cd": (O.opinion(0.6, 0.3, 0.1), O.opinion(0.3, 0.3, 0.4))}
    edges = t("supplier").select(F.explode(F.array(*[F.struct(name(x[0]).alias("source"), name(x[1]).alias("target"), p.cast(O.SCHEMA).alias("given"), q.cast(O.SCHEMA).alias("otherwise")) for x, (p, q) in g.items()])).alias("x")).select("x.*")
    return nodes, edges


def deduced(x: str, g: tuple, h: tuple) -> str:
    """SQL of deduction with conditionals (b, d, u, a)."""
    part = lambda i: f"{x}.b * {g[i]} + {x}.d * {h[i]} + {x}.u * ({x}.a * {g[i]} + (1 - {x}.a) * {h[i]})"
    return f"{{'b': ({part(0)})::DOUBLE, 'd': ({part(1)})::DOUBLE, 'u': ({part(2)})::DOUBLE, 'a': ({x}.a * {g[0] + g[3] * g[2]} + (1 - {x}.a) * {h[0] + h[3] * h[2]})::DOUBLE}}"


ROOT = f"r AS (SELECT s_suppkey AS k, {{'b': {CONF.format('s_suppkey')} * 0.8, 'd': (1 - {CONF.format('s_suppkey')}) * 0.8, 'u': 0.2::DOUBLE, 'a': 0.3::DOUBLE}} AS o FROM supplier)"
DIAMOND = f"""{ROOT}, m AS (SELECT k, {deduced('o', (0.7, 0.1, 0.2, 0.5), (0.1, 0.6, 0.3, 0.4))} AS p, {deduced('o', (0.5, 0.2, 0.3, 0.2), (0.2, 0.2, 0.6, 0.5))} AS q FROM r),
    e AS (SELECT k, {deduced('p', (0.9, 0.0, 0.1, 0.5), (0.0, 0.5, 0.5, 0.5))} AS x, {deduced('q', (0.6, 0.3, 0.1, 0.5), (0.3, 0.3, 0.4, 0.5))} AS y FROM m)"""


@query(f"WITH {DIAMOND}, f AS (SELECT k, {PAIR} AS f FROM e) SELECT 'd' || k AS node, 'fuse' AS operation, 2 AS inputs, {flat('f')} FROM f UNION ALL SELECT 'b' || k, 'deduce', 1, {flat('p')} FROM m UNION ALL SELECT 'c' || k, 'deduce', 1, {flat('q')} FROM m UNION ALL SELECT 'a' || k, 'passthrough', 0, {flat('o')} FROM r")
def network_diamond(t):
    """Inference through diamonds, step by step: two deductions meet and are fused."""
    nodes, edges = diamond(t)
    return network.trace(nodes, edges).select("node", "operation", F.size("inputs").alias("inputs"), *O.flat(F.col("opinion")))


@query(f"""WITH {DIAMOND}, w AS (SELECT k, p.b + p.a * p.u AS x, q.b + q.a * q.u AS y FROM m), c(i, j, b, d, u) AS (VALUES (1, 1, 0.9::DOUBLE, 0.0::DOUBLE, 0.1::DOUBLE), (1, 0, 0.6, 0.2, 0.2), (0, 1, 0.3, 0.3, 0.4), (0, 0, 0.0, 0.8, 0.2)),
    g AS (SELECT k, (CASE i WHEN 1 THEN x ELSE 1 - x END) * (CASE j WHEN 1 THEN y ELSE 1 - y END) AS w, b, d, u FROM w, c)
    SELECT 'd' || k AS node, round(sum(w * b), 6) AS b, round(sum(w * d), 6) AS d, round(sum(w * u), 6) AS u, round(sum(w * (b + 0.5 * u)), 6) AS a FROM g GROUP BY 1""")
def network_enumeration(t):
    """The node below both middle ones by a full conditional table."""
    nodes, edges = diamond(t)
    k = F.col("s_suppkey").cast("string")
    rows = [((True, True), (0.9, 0.0, 0.1)), ((True, False), (0.6, 0.2, 0.2)), ((False, True), (0.3, 0.3, 0.4)), ((False, False), (0.0, 0.8, 0.2))]
    each = [F.struct(F.array(*[F.lit(x) for x in s]).alias("states"), O.opinion(*g).cast(O.SCHEMA).alias("given")) for s, g in rows]
    tables = t("supplier").select(F.concat(F.lit("d"), k).alias("target"), F.array(F.concat(F.lit("b"), k), F.concat(F.lit("c"), k)).alias("parents"), F.explode(F.array(*each)).alias("x")).select("target", "parents", "x.*")
    upper = edges.where(~F.col("target").startswith("d"))
    out = network.infer(nodes, upper, tables=tables).where(F.col("node").startswith("d"))
    return out.select("node", *[r6(F.col("opinion")[x], x) for x in "bdua"])


def bundle(t) -> container.Network:
    nodes, edges = diamond(t)
    spark = nodes.sparkSession
    agents_ = t("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    trust = t("nation").where("n_nationkey < 24").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("source"), F.concat(F.lit("n"), (F.col("n_nationkey") + 1).cast("string")).alias("target"), O.opinion(0.8, 0.1, 0.1).alias("opinion"))
    says = t("supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("agent"), F.concat(F.lit("a"), F.col("s_suppkey").cast("string")).alias("content"), O.from_confidence(conf("s_suppkey"), 0.1).alias("opinion"))
    return container.Network.of(spark, nodes=nodes.unionByName(agents_.withColumn("kind", F.lit("agent")), allowMissingColumns=True).withColumn("kind", F.coalesce("kind", F.lit("content"))), edges=edges, trust=trust, attestations=says)


@query("""WITH s AS (SELECT count(*) AS n FROM supplier), a AS (SELECT count(*) AS n FROM nation) SELECT * FROM (SELECT 'nodes' AS what, 4 * s.n + a.n AS n FROM s, a UNION ALL SELECT 'agents', a.n FROM a UNION ALL SELECT 'content', 4 * s.n FROM s UNION ALL SELECT 'edges', 4 * s.n FROM s UNION ALL SELECT 'roots', s.n FROM s
    UNION ALL SELECT 'leaves', s.n FROM s UNION ALL SELECT 'trust', a.n - 1 FROM a UNION ALL SELECT 'parents of d1', 2 UNION ALL SELECT 'children of a1', 2 UNION ALL SELECT 'trust from n3', 1 UNION ALL SELECT 'tree', 0 UNION ALL SELECT 'dag', 1 UNION ALL SELECT 'edges without b1', 4 * s.n - 2 FROM s UNION ALL SELECT 'nodes without b1', 4 * s.n + a.n - 1 FROM s, a
    UNION ALL SELECT 'edges without a1-b1', 4 * s.n - 1 FROM s UNION ALL SELECT 'lines', 4 * s.n + a.n + 4 * s.n + a.n - 1 + s.n FROM s, a UNION ALL SELECT 'edges of content', 4 * s.n FROM s UNION ALL SELECT 'nodes of trust', a.n FROM a UNION ALL SELECT 'has a1-b1', 1 UNION ALL SELECT 'has b1-a1', 0)""")
def network_container(t):
    """What a network holds, after changes, and through its lines of JSON."""
    n = bundle(t)
    spark = n.nodes.sparkSession
    one = lambda *x: spark.createDataFrame([x], "source string, target string" if len(x) == 2 else "node string")
    less, cut = n.remove_nodes(one("b1")), n.remove_edges(one("a1", "b1"))
    back = container.Network.from_lines(n.to_lines())
    rows = {
        "nodes": back.node_count(), "agents": n.agents().count(), "content": n.content().count(), "edges": back.edge_count(), "roots": n.roots().count(), "leaves": n.leaves().count(), "trust": back.trust.count(), "parents of d1": n.parents("d1").count(), "children of a1": n.children("a1").count(),
        "trust from n3": n.trust_from("n3").count(), "tree": int(n.is_tree()), "dag": int(n.is_dag()), "edges without b1": less.edge_count(), "nodes without b1": less.node_count(), "edges without a1-b1": cut.edge_count(), "lines": n.to_lines().count(), "edges of content": n.content_subgraph().edge_count(), "nodes of trust": n.trust_subgraph().node_count(), "has a1-b1": int(n.has_edge("a1", "b1")), "has b1-a1": int(n.has_edge("b1", "a1")),
    }
    return spark.createDataFrame(list(rows.items()), "what string, n long")


@query(f"WITH {DIAMOND}, f AS (SELECT k, {PAIR} AS f FROM e) SELECT 'd' || k AS node, {flat('f')} FROM f")
def network_graph_round_trip(t):
    """A network as linked-data nodes with their parents' edges, read again, and inferred."""
    nodes, edges = diamond(t)
    n = container.Network.of(nodes.sparkSession, nodes=nodes, edges=edges)
    return container.Network.from_graph(n.to_graph()).infer().where(F.col("node").startswith("d")).select("node", *O.flat(F.col("opinion")))


@query(f"""WITH {ROOT}, t AS (SELECT s_suppkey AS k, s_nationkey AS h, CASE WHEN s_nationkey = 0 THEN 1.0 ELSE pow(0.8, s_nationkey) END AS tb FROM supplier), s AS (SELECT r.k, {{'b': {CONF.format('r.k')} * 0.9 * tb, 'd': (1 - {CONF.format('r.k')}) * 0.9 * tb, 'u': 1 - 0.9 * tb, 'a': 0.5::DOUBLE}} AS o FROM r JOIN t USING (k)),
    m AS (SELECT k, {deduced('o', (0.7, 0.1, 0.2, 0.5), (0.1, 0.6, 0.3, 0.4))} AS p FROM s) SELECT 'b' || k AS node, {flat('p')} FROM m""")
def network_with_trust(t):
    """What the first nation believes of all content: attestations seen through a chain of trust, and deduced from there."""
    n = bundle(t)
    return n.infer_with_trust("n0").where(F.col("node").startswith("b")).select("node", *O.flat(F.col("opinion")))


@query(f"""WITH {ROOT}, f AS (SELECT k, pow(2.0, -(k % 10) / 5.0) AS f FROM r), g AS (SELECT k, pow(2.0, -(k % 10 + 3) / 5.0) AS f FROM r), d AS (SELECT r.k, o.b * f.f AS b1, o.d * f.f AS d1, o.b * g.f AS b2, o.d * g.f AS d2 FROM r JOIN f USING (k) JOIN g USING (k)),
    x AS (SELECT k, {{'b': b1, 'd': d1, 'u': 1 - b1 - d1, 'a': 0.3::DOUBLE}} AS o, {{'b': b2, 'd': d2, 'u': 1 - b2 - d2, 'a': 0.3::DOUBLE}} AS q FROM d), m AS (SELECT k, {deduced('o', (0.7, 0.1, 0.2, 0.5), (0.1, 0.6, 0.3, 0.4))} AS p, {deduced('q', (0.7, 0.1, 0.2, 0.5), (0.1, 0.6, 0.3, 0.4))} AS q FROM x)
    SELECT 'b' || k AS node, round(q.b - p.b, 6) AS delta_belief, round(q.d - p.d, 6) AS delta_disbelief, round(q.u - p.u, 6) AS delta_uncertainty FROM m""")
def network_difference(t):
    """How much belief changes in three days, as roots age."""
    nodes, edges = diamond(t)
    day = lambda n: F.lit(f"2024-01-{n:02}").cast("timestamp")
    age = (F.regexp_extract("node", r"(\d+)", 1).cast("int") % 10)
    timed = nodes.withColumn("timestamp", F.when(F.col("node").startswith("a"), F.timestamp_seconds(F.unix_timestamp(day(20)) - 86400 * age)))
    out = network.infer_difference(timed, edges.where(F.col("target").startswith("b") | F.col("target").startswith("c")), day(20), day(23), half_life=5 * 86400.0, what="nodes")
    return out.where(F.col("node").startswith("b")).select("node", *[r6(F.col(c), c) for c in ("delta_belief", "delta_disbelief", "delta_uncertainty")])


@query(f"""WITH p AS (SELECT s_suppkey AS k, {CONF.format('s_suppkey')} AS p, 10 + s_suppkey % 50 AS n FROM supplier) SELECT k, round(p * n / (n + 2), 6) AS b, round((1 - p) * n / (n + 2), 6) AS d, round(2.0 / (n + 2), 6) AS u, round((p * n + 1) / (n + 2), 6) AS if_true, 0.5::DOUBLE AS if_false FROM p""")
def probability_tables(t):
    """Conditional probabilities of so many samples as opinions, and back."""
    rows = t("supplier").select(F.col("s_suppkey").alias("source"), F.lit("t").alias("target"), conf("s_suppkey").alias("p"), (10 + F.col("s_suppkey") % 50).alias("n"))
    e = network.from_probabilities(rows, "p", "n")
    g = F.col("given")
    return e.join(network.to_probabilities(e), ["source", "target"]).select(F.col("source").alias("k"), r6(g["b"], "b"), r6(g["d"], "d"), r6(g["u"], "u"), r6(F.col("if_true"), "if_true"), r6(F.col("if_false"), "if_false"))


# Consent records, and what was done with clinical documents

CONSENT_JSON = """c AS (SELECT event_id, [0.9, 0.3, 0.5, 0.05][1 + event_id % 4]::DOUBLE AS p, [0.15, 0.25, 0.4, 0.1][1 + event_id % 4]::DOUBLE AS u0, event_id % 3 AS v, event_id % 5 = 0 AS deny, event_id % 2 AS cat FROM events),
    q AS (SELECT event_id, p AS f, v, deny, cat, p * CASE WHEN deny THEN 0.7 ELSE 1 END AS p, u0 * CASE WHEN v > 0 THEN pow(0.75, v) ELSE 1.05 END AS u FROM c)"""


def consent_json(day: str, end: str | None = None) -> Column:
    k = F.col("event_id")
    status = F.element_at(F.array(*[F.lit(x) for x in ("active", "inactive", "draft", "rejected")]), (k % 4 + 1).cast("int"))
    yes = F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: F.struct((i > 0).alias("verified")))
    cats = F.when(k % 2 == 1, F.array(*[F.struct(F.array(F.struct(F.lit("s").alias("system"), F.lit(c).alias("code"))).alias("coding")) for c in ("x", "y")]))
    period = F.struct(F.lit(end).alias("end"))
    return F.to_json(F.struct(F.lit("Consent").alias("resourceType"), status.alias("status"), F.lit(day).alias("dateTime"), yes.alias("verification"), cats.alias("category"), F.struct(F.when(k % 5 == 0, "deny").alias("type"), F.when(k % 7 == 0, F.array(F.struct(F.lit("T").alias("code")))).alias("purpose"), period.alias("period")).alias("provision")))


@query(f"""WITH {CONSENT_JSON}, s AS (SELECT event_id, [f, CASE WHEN event_id % 7 = 0 THEN 0.75 ELSE 0.6 END, CASE WHEN cat = 1 THEN 0.7 ELSE 0.65 END, CASE WHEN deny THEN 0.8 ELSE 0.6 END, CASE v WHEN 2 THEN 0.9 WHEN 1 THEN 0.8 ELSE 0.5 END, CASE WHEN cat = 1 THEN 0.75 ELSE 0.55 END]::DOUBLE[] AS p,
    [0.25, 0.25, 0.25, 0.25, CASE v WHEN 2 THEN 0.1 WHEN 1 THEN 0.15 ELSE 0.35 END, 0.25]::DOUBLE[] AS u FROM q), m AS (SELECT event_id, list_product(list_transform(range(1, 7), lambda i: p[i] * (1 - u[i]))) AS b, list_product(list_transform(range(1, 7), lambda i: 1 - (1 - p[i]) * (1 - u[i]))) AS k, list_product(p) AS a FROM s)
    SELECT event_id, round(b, 10) AS b, round(1 - k, 10) AS d, round(greatest(0, k - b), 10) AS u, round(a, 10) AS a FROM m""")
def consent_record_validity(t):
    """Six conditions inferred from consent records, and their meet."""
    o = clinical.record_validity(consent_json("2024-01-10"))
    return t("events").select("event_id", o.alias("o")).select("event_id", *[r10(F.col("o")[k], k) for k in "bdua"])


@query(f"""WITH {CONSENT_JSON}, o AS (SELECT q.event_id, p * (1 - u) AS b, (1 - p) * (1 - u) AS d, u, p AS a, ts FROM q JOIN events USING (event_id)), w AS (SELECT event_id, b, d, u, ts::DATE < DATE '2024-01-10' AS before FROM o)
    SELECT event_id, round(CASE WHEN before THEN b ELSE b * 0.25 END, 6) AS eb, round(CASE WHEN before THEN d ELSE d + b * 0.75 END, 6) AS ed, round(u, 6) AS eu, round(b, 6) AS wb, round(b, 6) AS rb FROM w""")
def consent_record_events(t):
    """Expiry on a day, withdrawal and a change of law by another record of the same content."""
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    e = clinical.record_expiry(consent_json("2024-01-01", "2024-01-10"), at, 0.25)
    w = clinical.record_withdrawal(consent_json("2024-01-01"), consent_json("2024-01-12"), at)
    r = clinical.record_regulatory_change(consent_json("2024-01-01"), consent_json("2024-01-12"), at)
    e = t("events").select("event_id", e.alias("e"), w.alias("w"), r.alias("r"))
    return e.select("event_id", r6(F.col("e.b"), "eb"), r6(F.col("e.d"), "ed"), r6(F.col("e.u"), "eu"), r6(F.col("w.b"), "wb"), r6(F.col("r.b"), "rb"))


@query(f"""WITH o AS (SELECT event_id, {CONF.format('event_id')} * 0.8 AS b, (1 - {CONF.format('event_id')}) * 0.8 AS d FROM events) SELECT event_id, CASE WHEN d > b AND d > 0.2 THEN 'rejected' WHEN b > d THEN 'active' ELSE 'draft' END AS status, round(b, 6) AS b, 'p' || event_id AS patient FROM o""")
def consent_record_export(t):
    """Opinions as consent records, with the opinion inside."""
    from veridelta.sources.clinical_records import EXTENSION

    o = O.from_confidence(conf("event_id"), 0.2)
    j = clinical.consent_record(o, F.concat(F.lit("p"), F.col("event_id").cast("string")))
    x = F.from_json(j, "status string, patient struct<reference:string>, extension array<struct<url:string,extension:array<struct<url:string,valueDecimal:double>>>>")
    rows = t("events").select("event_id", x.alias("x")).where(F.col("x.extension")[0]["url"] == EXTENSION)
    return rows.select("event_id", "x.status", r6(F.col("x.extension")[0]["extension"][0]["valueDecimal"], "b"), F.col("x.patient.reference").alias("patient"))


@query("""SELECT user_id, count(*) AS total_entries, count(*) FILTER (event_type <> 'error') AS annotated, count(*) FILTER (event_type = 'error') AS skipped FROM events GROUP BY 1""")
def clinical_bundle_report(t):
    """Bundles of each user's events; errors are of a type that is not known."""
    kind = F.when(F.col("event_type") == "error", "Basic").otherwise("Claim")
    rows = t("events").groupBy("user_id").agg(F.to_json(F.struct(F.lit("Bundle").alias("resourceType"), F.collect_list(F.struct(F.struct(kind.alias("resourceType"), F.lit("active").alias("status")).alias("resource"))).alias("entry"))).alias("json"))
    return clinical.bundle_report(rows, order="user_id").select(F.col("ord").alias("user_id"), F.col("total_entries").cast("long"), F.col("annotated").cast("long"), F.col("skipped").cast("long"))


@query(f"""WITH {MIXED}, p AS (SELECT b + a * u AS p FROM o) SELECT count(*) AS total_input, count(*) FILTER (p >= 0.6) AS kept_count, count(*) FILTER (p < 0.6) AS suppressed_count, round(avg(p) FILTER (p >= 0.6), 6) AS kept_projected, round(avg(p) FILTER (p < 0.6), 6) AS suppressed_projected FROM p""")
def clinical_alert_report(t):
    r = clinical.alert_report(mixed(t), threshold=0.6)
    return r.select("total_input", "kept_count", "suppressed_count", r6(F.col("kept_projected"), "kept_projected"), r6(F.col("suppressed_projected"), "suppressed_projected"))


@query(f"""WITH l AS (SELECT event_id, user_id % 20 AS code, event_type AS src, {CONF.format('event_id')} * 0.8 AS b, (1 - {CONF.format('event_id')}) * 0.8 AS d FROM events), g AS (SELECT code, count(*) AS n FROM l GROUP BY 1), c AS (SELECT DISTINCT x.code FROM l x JOIN l y ON x.code = y.code AND x.event_id < y.event_id AND x.b * y.d + x.d * y.b >= 0.3)
    SELECT (SELECT count(DISTINCT src) FROM l) AS input_list_count, (SELECT count(*) FROM l) AS total_input_entries, count(*) FILTER (n > 1) AS matched_groups, count(*) FILTER (n = 1) AS unique_entries, (SELECT count(*) FROM c) AS conflicts, count(*) AS output_count FROM g""")
def clinical_reconciliation_report(t):
    rows = t("events").select(F.lit("urn:codes").alias("system"), (F.col("user_id") % 20).cast("string").alias("code"), F.lit(None).cast("string").alias("text"), O.from_confidence(conf("event_id"), 0.2).alias("opinion"), F.col("event_id").alias("ord"), "event_type")
    return clinical.reconciliation_report(rows, "event_type")


@query(f"""WITH x AS (SELECT event_id, {CONF.format('event_id')} * 0.8 AS b FROM events) SELECT event_id, 3 AS chain_length, round(b + 0.1, 6) AS p0, round(b * 0.9 + 0.5 * (1 - 0.8 * 0.9), 6) AS p1, round(b * 0.45 + 0.5 * (1 - 0.8 * 0.45), 6) AS p2 FROM x""")
def clinical_chain_report(t):
    """What every party of a chain of trust sees."""
    one = O.from_confidence(conf("event_id"), 0.2).cast(O.SCHEMA)
    r = clinical.trust_chain_report(F.array(one, one, one), F.array(O.opinion(0.9, 0.0, 0.1).cast(O.SCHEMA), O.opinion(0.5, 0.0, 0.5).cast(O.SCHEMA)))
    rows = t("events").select("event_id", r.alias("r"))
    return rows.select("event_id", "r.chain_length", *[r6(F.col("r.per_hop_projected")[i], f"p{i}") for i in range(3)])


@query("""WITH k AS (SELECT event_id, event_id % 4 AS k FROM events), p(k, who, cls) AS (VALUES (0, 'Practitioner/', 'Person'), (1, 'Organization/', 'Organization'), (2, 'Device/', 'SoftwareAgent'), (3, 'Group/', 'Agent'))
    SELECT 'urn:activity:' || event_id AS subject, 'wasAssociatedWith' AS predicate, who || event_id % 7 AS object FROM k JOIN p USING (k) UNION ALL SELECT DISTINCT who || event_id % 7, 'type', cls FROM k JOIN p USING (k) UNION ALL SELECT 'urn:activity:' || event_id, CASE WHEN event_id % 2 = 0 THEN 'hadPrimarySource' ELSE 'used' END, 'doc/' || event_id FROM k""")
def clinical_provenance_statements(t):
    """Provenance records as statements: agents by their class, entities by their role."""
    from veridelta.sources import clinical_records as records

    k = F.col("event_id")
    who = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("Practitioner/", "Organization/", "Device/", "Group/")]), (k % 4 + 1).cast("int")), (k % 7).cast("string"))
    ref = lambda c: F.struct(c.alias("reference"))
    j = F.to_json(F.struct(F.lit("Provenance").alias("resourceType"), k.cast("string").alias("id"), F.array(F.struct(ref(who).alias("who"))).alias("agent"), F.array(F.struct(F.when(k % 2 == 0, "source").alias("role"), ref(F.concat(F.lit("doc/"), k.cast("string"))).alias("what"))).alias("entity")))
    s = rdf.record_provenance(records.to_documents(t("events").select("event_id", j.alias("json")), order="event_id", types=["Provenance"]))
    name = F.regexp_extract("predicate", r"[#/]([A-Za-z]+)$", 1)
    rows = s.select("subject", name.alias("predicate"), F.regexp_replace("object", "^http.*#", "").alias("object"))
    return rows.where(F.col("predicate").isin("wasAssociatedWith", "hadPrimarySource", "used") | ((F.col("predicate") == "type") & ~F.col("object").isin("Activity", "Entity")))


# Statements


@query(f"""SELECT count(*) AS nodes_converted, count(*) AS triples_input FROM part""")
def conversion_report(t):
    """How much a conversion to provenance statements took in."""
    none = F.lit(None).cast("string")
    rows = t("part").select(F.col("p_partkey").cast("string").alias("node_id"), F.lit("name").alias("prop"), F.col("p_name").alias("value"), conf("p_partkey").alias("confidence"), (F.col("p_partkey") % 5).cast("string").alias("source"), none.alias("method"), none.alias("extracted_at"))
    return rdf.conversion_report(rows, rdf.to_prov(rows)).where("success AND compression_ratio > 1").select("nodes_converted", "triples_input")


@query("""SELECT 'http://ex.org/part/' || p_partkey AS subject, 'http://schema.org/name' AS predicate, p_name AS object, 'literal' AS kind FROM part UNION ALL SELECT 'http://ex.org/part/' || p_partkey, 'http://schema.org/madeBy', 'http://ex.org/brand/' || replace(p_brand, '#', ''), 'iri' FROM part
    UNION ALL SELECT 'http://ex.org/part/' || p_partkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://schema.org/Product', 'iri' FROM part UNION ALL SELECT DISTINCT 'http://ex.org/brand/' || replace(p_brand, '#', ''), 'http://schema.org/label', p_brand, 'literal' FROM part""")
def processed_statements(t):
    """Documents under a context, flattened to statements, written as nodes and read again."""
    from veridelta.sources.processor import Processor

    p = Processor({"ex": "http://ex.org/", "s": "http://schema.org/", "name": "s:name", "label": "s:label", "Product": "s:Product", "brand": {"@id": "s:madeBy"}})
    b = F.regexp_replace("p_brand", "#", "")
    doc = F.to_json(F.struct(F.concat(F.lit("ex:part/"), F.col("p_partkey").cast("string")).alias("@id"), F.lit("Product").alias("@type"), F.col("p_name").alias("name"), F.struct(F.concat(F.lit("ex:brand/"), b).alias("@id"), F.col("p_brand").alias("label")).alias("brand"), F.lit(1).alias("unknown")))
    s = p.statements(t("part").select(doc.alias("json")), "json")
    return Processor().statements(p.documents(s), "json")


# Shapes: every kind of constraint over whole tables

PEOPLE = "SELECT c_custkey AS k, c_name, c_acctbal, c_nationkey, c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 40 END AS lo, c_custkey % 37 AS hi FROM customer"


def _shape(t, rule: dict[str, dict], name: str) -> DataFrame:
    rows = t("customer").select(F.col("c_custkey").alias("k"), "c_name", "c_acctbal", "c_nationkey", "c_mktsegment", F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 40).alias("lo"), (F.col("c_custkey") % 37).alias("hi"))
    out = validation.validate(rows, {"properties": rule})
    return out.select("k", F.explode(F.concat("errors", "warnings")).alias("e")).select("k", "e.path", F.col("e.constraint").alias("constraint"))


SHAPES: dict[str, tuple[dict, str]] = {
    "required": ({"lo": {"required": True}}, "SELECT k, 'lo' AS path, 'required' AS \"constraint\" FROM p WHERE lo IS NULL"),
    "bounds": ({"hi": {"minimum": 5, "maximum": 30}, "c_acctbal": {"minimum": 0}}, "SELECT k, 'hi' AS path, 'minimum' AS \"constraint\" FROM p WHERE hi < 5 UNION ALL SELECT k, 'hi', 'maximum' FROM p WHERE hi > 30 UNION ALL SELECT k, 'c_acctbal', 'minimum' FROM p WHERE c_acctbal < 0"),
    "lengths": ({"c_mktsegment": {"min_length": 9, "max_length": 9}}, "SELECT k, 'c_mktsegment' AS path, 'min_length' AS \"constraint\" FROM p WHERE length(c_mktsegment) < 9 UNION ALL SELECT k, 'c_mktsegment', 'max_length' FROM p WHERE length(c_mktsegment) > 9"),
    "values": ({"c_mktsegment": {"in": ["BUILDING", "MACHINERY"]}}, "SELECT k, 'c_mktsegment' AS path, 'in' AS \"constraint\" FROM p WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    "pattern": ({"c_name": {"pattern": "^.*[02468]$"}}, "SELECT k, 'c_name' AS path, 'pattern' AS \"constraint\" FROM p WHERE NOT regexp_full_match(c_name, '.*[02468]')"),
    "pairs": ({"lo": {"less_than": "hi"}, "hi": {"disjoint": "lo"}}, "SELECT k, 'lo' AS path, 'less_than' AS \"constraint\" FROM p WHERE lo >= hi UNION ALL SELECT k, 'hi', 'disjoint' FROM p WHERE lo = hi"),
    "equal_pairs": ({"lo": {"less_than_or_equals": "hi"}, "hi": {"equals": "lo"}}, "SELECT k, 'lo' AS path, 'less_than_or_equals' AS \"constraint\" FROM p WHERE lo > hi UNION ALL SELECT k, 'hi', 'equals' FROM p WHERE lo <> hi"),
    "either": ({"hi": {"or": [{"maximum": 3}, {"minimum": 33}]}}, "SELECT k, 'hi' AS path, 'or' AS \"constraint\" FROM p WHERE hi > 3 AND hi < 33"),
    "both": ({"hi": {"and": [{"minimum": 3}, {"maximum": 33}]}}, "SELECT k, 'hi' AS path, 'and' AS \"constraint\" FROM p WHERE hi < 3 OR hi > 33"),
    "neither": ({"hi": {"not": {"minimum": 10}}}, "SELECT k, 'hi' AS path, 'not' AS \"constraint\" FROM p WHERE hi >= 10"),
    "severity": ({"hi": {"maximum": 20, "severity": "warning"}}, "SELECT k, 'hi' AS path, 'maximum' AS \"constraint\" FROM p WHERE hi > 20"),
}


def _register_shape(name: str) -> None:
    rule, sql = SHAPES[name]

    def run(t):
        return _shape(t, rule, name)

    run.__name__ = f"shape_{name}"
    run.__doc__ = f"Constraint of a shape over all customers: {name}."
    query(f"WITH p AS ({PEOPLE}) {sql}")(run)


for _name in SHAPES:
    _register_shape(_name)


# The six stages: lift, fuse, decay, validate, export, filter

SOURCES = "s(j, w) AS (VALUES (0, 0.92::DOUBLE), (1, 0.85), (2, 0.78), (3, 0.81), (4, 0.7))"


@query(f"""WITH {SOURCES}, e AS (SELECT l_orderkey AS node, l_suppkey % 5 AS j, max({CONF.format('l_partkey')}) AS c FROM lineitem GROUP BY 1, 2), o AS (SELECT node, j, c * 0.85 * w AS b, (1 - c) * 0.85 * w AS d FROM e JOIN s USING (j)),
    f AS (SELECT node, count(*) AS n, 1 / (1 + sum(1 / (1 - b - d)) - count(*)) AS u, sum(b / (1 - b - d)) AS sb, sum(d / (1 - b - d)) AS sd FROM o GROUP BY 1), t AS (SELECT o_orderkey AS node, pow(2.0, -(epoch_us(TIMESTAMP '2002-01-01') - epoch_us(min(o_orderdate)))::DOUBLE / 86400000000 / 1000) AS f FROM orders GROUP BY 1),
    g AS (SELECT node, n, u * sb * f AS b, u * sd * f AS d FROM f JOIN t USING (node)), h AS (SELECT node, n, b, d, 1 - b - d AS u, b + 0.5 * (1 - b - d) AS p FROM g) SELECT node, n AS sources, round(b, 6) AS b, round(p, 6) AS p, 'urn:order:' || node AS id FROM h WHERE p >= 0.5 AND n >= 2""")
def six_stages(t):
    """Extractions of five sources lifted to opinions by trust, fused, aged, validated, exported as documents, and filtered by confidence."""
    trust = F.element_at(F.array(*[F.lit(x) for x in (0.92, 0.85, 0.78, 0.81, 0.7)]), (F.col("l_suppkey") % 5 + 1).cast("int"))
    rows = t("lineitem").select(F.col("l_orderkey").alias("node"), (F.col("l_suppkey") % 5).alias("source"), conf("l_partkey").alias("c"), trust.alias("w")).groupBy("node", "source", "w").agg(F.max("c").alias("c"))
    lifted = rows.select("node", "source", O.trust_discount(O.opinion(F.col("w"), 0.0, 1 - F.col("w")), O.from_confidence(F.col("c"), 0.15)).alias("opinion"))
    fused = fusion.cumulative_fuse(lifted, ["node"]).join(lifted.groupBy("node").agg(F.count(F.lit(1)).alias("sources")), "node")
    dates = t("orders").groupBy(F.col("o_orderkey").alias("node")).agg(F.min("o_orderdate").alias("at"))
    days = (F.unix_micros(F.lit("2002-01-01").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 86_400_000_000
    aged = fused.join(dates, "node").select("node", "sources", O.decay(F.col("opinion"), days, 1000.0).alias("opinion"))
    p = aged.withColumn("p", O.projected(F.col("opinion")))
    sound = validation.validate(p, {"properties": {"sources": {"minimum": 2}, "p": {"required": True}}}).where(F.size("errors") == 0)
    out = sound.select("node", "sources", "opinion", "p", F.to_json(F.struct(F.concat(F.lit("urn:order:"), F.col("node").cast("string")).alias("@id"), documents.annotate(F.col("node"), F.col("p")).alias("value"))).alias("document"))
    return out.where("p >= 0.5").select("node", "sources", r6(F.col("opinion")["b"], "b"), r6(F.col("p"), "p"), F.get_json_object("document", "$['@id']").alias("id"))
