"""Conditional tables, time and conversion of networks; clinical and transport helpers."""

import json

import pytest
from pyspark.sql import functions as F

from veridelta.functions import opinion as O
from veridelta.functions import transport as T
from veridelta.operators import clinical, network
from veridelta.sources import documents, rdf

def op(b, d):
    """b, d, what is left, and an even base rate."""
    return b, d, round(1 - b - d, 6), 0.5


NODE = f"node string, opinion {O.SCHEMA}"


def test_enumeration(spark):
    p = spark.createDataFrame([("a", op(0.6, 0.2)), ("b", op(0.1, 0.9))], NODE)
    given = {(1, 1): 0.9, (1, 0): 0.6, (0, 1): 0.5, (0, 0): 0.1}
    rows = [("t", f"{x}{y}", n, bool(s), (g * 0.8, (1 - g) * 0.8, 0.2, 0.5)) for (x, y), g in given.items() for n, s in zip("ab", (x, y))]
    table = spark.createDataFrame(rows, f"target string, config string, parent string, state boolean, given {O.SCHEMA}")
    o = network.enumerate_parents(p, table).first().opinion
    pa, pb = 0.7, 0.1
    want = sum((pa if x else 1 - pa) * (pb if y else 1 - pb) * g for (x, y), g in given.items())
    assert o.b == pytest.approx(0.8 * want) and o.u == pytest.approx(0.2) and o.a == pytest.approx(0.8 * want + 0.1)
    with pytest.raises(Exception, match="not complete"):
        network.enumerate_parents(p, table.where("config <> '11'")).collect()


def test_probabilities_round_trip(spark):
    e = spark.createDataFrame([("a", "b", 0.8)], "source string, target string, p double")
    got = network.to_probabilities(network.from_probabilities(e, "p", 10_000)).first()
    assert got.if_true == pytest.approx(0.8, abs=1e-3) and got.if_false == 0.5


def test_unrolled_network(spark):
    n = spark.createDataFrame([("x", op(0.8, 0.1))], NODE)
    e = spark.createDataFrame([("x", "x")], "source string, target string").withColumn("given", O.opinion(0.9, 0.0, 0.1))
    nodes, edges = network.unroll(n, e.where("false"), e, 3, 60, F.lit("2024-01-01"))
    assert {r.node for r in nodes.collect()} == {"x_t0", "x_t1", "x_t2"}
    assert {(r.source, r.target) for r in network.at_time(edges, F.lit("2024-01-01 00:01:30").cast("timestamp")).collect()} == {("x_t1", "x_t2")}


def test_inference_ages(spark):
    n = spark.createDataFrame([("a", op(0.8, 0.1), "2024-01-01"), ("b", None, None)], NODE + ", timestamp string")
    e = spark.createDataFrame([("a", "b", "2024-01-01")], "source string, target string, timestamp string").withColumn("given", O.opinion(0.9, 0.0, 0.1))
    d = {r.node: r for r in network.infer_difference(n, e, F.lit("2024-01-01"), F.lit("2024-01-03"), half_life=86400.0).collect()}
    assert d["a"].delta_belief == pytest.approx(0.2 - 0.8) and d["b"].delta_uncertainty > 0


def test_network_of_documents(spark):
    doc = {"@graph": [{p: {"@confidence": c, "@value": v}, "@id": i} for i, p, v, c in (("a", "title", "x", 0.9), ("b", "causedBy", "a", 0.7))]}
    nodes, edges = network.from_assertions(documents.assertions(spark.createDataFrame([(json.dumps(doc),)], "json string")), ["causedBy"], 0.1)
    assert {r.node: round(r.opinion.b, 6) for r in nodes.collect()} == {"a": 0.81, "b": 0.63}
    assert [(r.source, r.target) for r in edges.collect()] == [("a", "b")]


def test_clinical_helpers(spark):
    o, t = op(0.8, 0.1), (0.5, 0.2, 0.3, 0.5)
    df = spark.createDataFrame([([o, o, o], [t, t], o, "2023-01-01")], f"os array<{O.SCHEMA}>, ts array<{O.SCHEMA}>, o {O.SCHEMA}, at string")
    r = df.select(
        clinical.trust_chain(F.col("os"), F.col("ts")).alias("chain"), clinical.decayed(F.col("o"), [F.lit(None).cast("string"), F.col("at")], F.lit("2024-01-01")).alias("old"), clinical.decayed(F.col("o"), [F.col("at")], F.lit("2020-01-01")).alias("new"),
        clinical.consent_opinion(F.lit("active"), F.lit(True), F.lit(1), F.lit(0)).alias("c"), clinical.consent_status(F.col("o")).alias("s"),
    ).first()
    assert r.chain.b == pytest.approx(0.2) and r.old.b == pytest.approx(0.4) and tuple(r.new) == o and r.c.u == pytest.approx(0.1125) and r.s == "active"
    with pytest.raises(Exception, match="one trust level"):
        df.select(clinical.trust_chain(F.col("os"), F.col("os"))).collect()
    docs = spark.createDataFrame([("g", 1, 0, o), ("g", 1, 1, t), ("g", 2, 2, o), ("g", 3, 3, None)], f"g string, doc int, ord int, opinion {O.SCHEMA}")
    assert clinical.clinical_fuse(docs, ["g"]).first().opinion.u == pytest.approx(1 / 19)


def test_payloads(spark):
    text = json.dumps({"k": list(range(300))})
    r = spark.createDataFrame([(text,)], "t string").select(T.payload_stats(F.col("t")).alias("s"), T.mqtt5_properties(True, F.lit("2024-01-01 00:01:00"), F.lit("2024-01-01"), source=F.lit("x")).alias("m")).first()
    assert r.s.json == len(text) > r.s.cbor and r.s.gzip_json < r.s.json and r.m.message_expiry_interval == 60 and r.m.user_properties == {"source": "x"}


def test_turtle(spark):
    rows = spark.createDataFrame([("http://e/a", "http://e/p", "v", "string", None)], "node_id string, prop string, value string, value_kind string, source string")
    lines = [r.line for r in rdf.to_turtle(rows, "urn:", {"source": "iri"}, {"e": "http://e/"}).orderBy("ord").collect()]
    assert lines == ["@prefix e: <http://e/> .", 'e:a e:p "v" .']
