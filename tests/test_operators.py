"""Graph, time, validation, vectors, governance, networks and interop on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from veridelta.functions import opinion as O
from veridelta.functions import transport as T
from veridelta.functions import vectors as V
from veridelta.operators import clinical, governance, graph, inference, multinomial, network, similarity, validation
from veridelta.sources import documents, rdf
from veridelta.streaming.fusion import windowed_fuse

DOC = {
    "@graph": [
        {"@id": "n1", "age": 41, "name": {"@method": "ner", "@value": "Ann", "@source": "s1", "@confidence": 0.9}, "@type": "Person"},
        {"@id": "n2", "@type": ["Person", "Staff"], "name": [{"@confidence": c, "@value": v} for v, c in (("Bob", 0.4), ("Rob", 0.8))]},
    ]
}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_documents_to_assertions(spark):
    a = documents.assertions(spark.createDataFrame([(json.dumps(DOC),), ("not json",)], "json string"))
    got = {(r.node_id, r.prop, r.value_idx): (r.value, r.confidence, r.value_kind) for r in a.collect()}
    assert got == {("n1", "name", 0): ("Ann", 0.9, "string"), ("n1", "age", 0): ("41", None, "number"), ("n2", "name", 0): ("Bob", 0.4, "string"), ("n2", "name", 1): ("Rob", 0.8, "string")}
    kept = documents.filter_by_confidence(a, {"name": 0.85})
    assert {r.node_id for r in kept.collect()} == {"n1"}
    back = {r.node_id: json.loads(r.json) for r in documents.to_documents(a).collect()}
    assert back["n2"]["name"][1]["@value"] == "Rob" and back["n1"]["@type"] == ["Person"]


MERGE = "node_id string, prop string, value string, confidence double, src_ord int"


def test_merge_outcomes(spark):
    rows = [("a", "p", "x", 0.5, 0), ("a", "p", "x", 0.5, 1), ("b", "p", "x", 0.9, 0), ("b", "p", "y", None, 1), ("c", "p", "x", 0.4, 0), ("d", "p", "x", 0.5, 0), ("d", "p", "y", 0.5, 1), ("d", "p", "y", 0.4, 2)]
    df = spark.createDataFrame(rows, MERGE)
    got = {r.node_id: (r.value, r.confidence, r.outcome) for r in graph.merge_graphs(df).collect()}
    assert got == {"a": ("x", 0.75, "agreed"), "b": ("x", 0.9, "conflicted"), "c": ("x", 0.4, "single"), "d": ("x", 0.5, "conflicted")}
    assert {r.node_id: r.value for r in graph.merge_graphs(df, "weighted_vote").collect()}["d"] == "y"
    assert graph.merge_graphs(df, "union").count() == 6
    assert tuple(graph.merge_report(graph.merge_graphs(df, "union")).first()) == (4, 2, 2, 2)


def test_diff_ignores_nulls(spark):
    s = "node_id string, prop string, value string"
    a, b = spark.createDataFrame([("n", "p", "1"), ("n", "q", "1"), ("n", "r", None)], s), spark.createDataFrame([("n", "p", "2"), ("n", "r", "3")], s)
    assert {(r.prop, r.change) for r in graph.diff_graphs(a, b).collect()} == {("p", "modified"), ("q", "removed"), ("r", "added")}


def test_time_bounds_are_inclusive(spark):
    df = spark.createDataFrame([("n", "p", "a", 1, 1, 5), ("n", "p", "b", 2, 5, None), ("m", "p", "c", 3, None, None)], "node_id string, prop string, value string, src_ord int, valid_from int, valid_until int")
    assert graph.query_at_time(df, F.lit(5)).count() == 3 and graph.query_at_time(df, F.lit(0)).count() == 1
    assert {(r.node_id, r.change) for r in graph.temporal_diff(df, F.lit(1), F.lit(9)).collect()} == {("n", "modified"), ("m", "unchanged")}


def test_conflict_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(1, "x", 0.5, 0, "2020"), (1, "y", 0.5, 1, "2021"), (1, "y", 0.1, 2, None)], "k int, v string, c double, o int, t string")
    win = lambda *a: inference.resolve_conflict(df, ["k"], "v", "c", "o", *a).first()
    assert (win().value, win("weighted_vote").value, win("recency", "t").value) == ("x", "y", "y")
    assert win("weighted_vote").confidence == pytest.approx(0.55)


def test_path_propagation(spark):
    e = spark.createDataFrame([("a", "knows", "b", 0.5), ("b", "works", "c", None)], "source string, prop string, target string, confidence double")
    r = inference.propagate_path(spark.createDataFrame([("a",)], "node string"), e, ["knows", "works"]).first()
    assert (r.node, r.score) == ("c", 0.5)


def test_shapes(spark):
    df = spark.createDataFrame([(1, ["P"], "ab", 5, [1, 2], ("x",)), (2, ["Q"], None, 50, [], (None,))], "id int, types array<string>, name string, age int, tags array<int>, addr struct<city:string>")
    base = {"properties": {"age": {"minimum": 10, "severity": "warning"}, "name": {"required": True}}}
    shape = {"extends": base, "type": "P", "properties": {"name": {"min_length": 3, "pattern": "^a"}, "tags": {"min_count": 1}, "addr": {"shape": {"properties": {"city": {"required": True}}}}, "age": {"if": {"minimum": 40}, "then": {"maximum": 45}}}}
    got = {r.id: ({e.constraint for e in r.errors}, {w.constraint for w in r.warnings}) for r in validation.validate(df, shape).collect()}
    assert got == {1: ({"min_length"}, {"minimum"}), 2: ({"type", "required", "min_count"}, {"conditional"})}
    assert {tuple(r) for r in validation.validate_document(df.withColumnRenamed("id", "node_id"), [shape]).select("path", "constraint").collect()} == {("1/name", "min_length")}


def test_metrics(spark):
    df = spark.createDataFrame([([1.0, 0.0, 2.0], list(map(float, (0, 0, 1))))], "a array<double>, b array<double>")
    got = similarity.compare_metrics(df, "a", "b").first()
    assert got.euclidean == pytest.approx(2**0.5) and got.jaccard == 0.5 and got.hamming == 2 and got.cosine == pytest.approx(2 / 5**0.5)
    more = df.select(V.dtw("a", "b").alias("dtw"), V.kendall("a", "b").alias("k"), V.wasserstein(F.col("a"), F.col("b")).alias("w"), V.mahalanobis([[1, 0, 0], [0, 1, 0], [0, 0, 1]])(F.col("a"), F.col("b")).alias("m")).first()
    assert more.dtw == 2 and more.m == pytest.approx(2**0.5) and more.w == pytest.approx(2 / 3)
    assert df.select(V.is_vector(F.col("a"), 3).alias("x"), V.is_vector(F.array(F.lit(float("nan")))).alias("y")).first()[:] == (True, False)
    with pytest.raises(ValueError, match="registered"):
        V.register("cosine", V.dot)
    V.register("half", lambda a, b: V.dot(a, b) / 2)
    assert "half" in V.names() and df.select(V.similarity(F.col("a"), F.col("b"), "half").alias("x")).first().x == 1
    V.reset()
    assert "half" not in V.names()


def test_auc_with_ties(spark):
    s = [(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)]
    df = spark.createDataFrame([("m", x, float(y), True) for x, y in s], "metric string, score double, label double, higher boolean")
    assert similarity.evaluate_scores(df, "metric", "score", "label", "higher").first().auc == pytest.approx(3.5 / 4)


def test_recommendation(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 1.0],)], "v array<double>")
    assert similarity.recommend_metric(df, "v")[0][0] == "jaccard"


def test_multinomial(spark):
    c = spark.createDataFrame([(1, "x", 3), (1, "y", 1), (1, "z", 0)], "g int, s string, n int")
    o = multinomial.from_evidence(c, ["g"], "s", "n")
    rows = o.collect()
    w = (3 + 2 * 3 * 4) / (1 + 3 * 4)
    assert {r.state: r.b for r in rows} == pytest.approx({"x": 3 / (4 + w), "y": 1 / (4 + w), "z": 0})
    assert sum(r.p for r in multinomial.projected(o).collect()) == pytest.approx(1)
    b = multinomial.coarsen(o, ["g"], "x").first().opinion
    assert b.b + b.d + b.u == pytest.approx(1)
    same = multinomial.cumulative_fuse(o.unionByName(o), ["g"]).collect()
    assert sum(r.b for r in same) + same[0].u == pytest.approx(1) and same[0].u < rows[0].u
    assert rows_of(multinomial.promote(spark.range(1).select(F.lit(1).alias("g"), O.opinion(0.5, 0.3, 0.2).alias("opinion")), ["g"]).select("state", "b")) == [("F", 0.3), ("T", 0.5)]


def test_closure_with_a_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "parent int, child int")
    got = governance.closure(e, spark.createDataFrame([(1,)], "node int"))
    assert {(r.node, r.depth) for r in got.collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}


def test_rights(spark):
    rows = spark.createDataFrame([("n1", "p", "a", "s1", "regular", "EU", 0), ("n2", "p", "b", "s2", "anonymized", "US", 0), ("n3", "p", "c", None, None, None, 0)], "node_id string, prop string, value string, data_subject string, category string, jurisdiction string, src_ord int")
    done = governance.execute_erasure(governance.request_erasure(rows, "s1", F.lit("t")), "s1", F.lit("t"))
    assert {r.node_id: r.value for r in done.collect()} == {"n1": None, "n2": "b", "n3": "c"}
    assert {r.node_id for r in governance.filter_personal(rows).collect()} == {"n1"}
    assert governance.filter_by_jurisdiction(rows, "p", "US").count() == 1
    assert json.loads(governance.export_portable(rows, "s2").first().record) == {"p": ["b"]}
    assert governance.audit_trail(rows, "s1").count() == 1


def test_network(spark):
    n = spark.createDataFrame([(x,) for x in "abcd"], "node string").withColumn("opinion", F.when(F.col("node") == "a", O.opinion(0.8, 0.1, 0.1)))
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], "source string, target string").withColumn("given", O.opinion(0.9, 0.0, 0.1))
    got = {r.node: r.opinion for r in network.infer(n, e).collect()}
    assert set(got) == set("abcd") and got["d"].u < got["b"].u
    assert [r.node for r in network.topological_order(n, e).orderBy("position").collect()] == list("abcd")
    with pytest.raises(ValueError, match="one parent"):
        network.infer(n, e, method="exact")
    with pytest.raises(network.CycleError):
        network.levels(n, e.unionByName(spark.createDataFrame([("d", "a")], "source string, target string").withColumn("given", O.opinion(0.9, 0.0, 0.1))))
    assert network.to_dot(n, e).count() == 10


def test_trust(spark):
    t = spark.createDataFrame([tuple(x) for x in ("ab", "bc", "ac", "ca")], "source string, target string").withColumn("opinion", O.opinion(0.5, 0.0, 0.5))
    got = {r.target: r for r in network.propagate_trust(t, spark.createDataFrame([("a",)], "node string")).collect()}
    assert set(got) == {"b", "c"} and got["c"].paths == 2 and got["b"].opinion.b == 0.5
    ring = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)] + [("n9", "n0")], "source string, target string").withColumn("opinion", O.opinion(0.9, 0.0, 0.1))
    far = {r.target: r for r in network.propagate_trust(ring, spark.createDataFrame([("n0",)], "node string")).collect()}
    assert len(far) == 9 and far["n9"].paths == 1 and far["n9"].opinion.b == pytest.approx(0.9**9)
    says = spark.createDataFrame([("b", "x"), ("z", "x"), ("a", "y")], "agent string, content string").withColumn("opinion", O.opinion(0.8, 0.1, 0.1))
    out = {r.content: r.opinion for r in network.attested(says, network.propagate_trust(t, spark.createDataFrame([("a",)], "node string")), "a").collect()}
    assert out["y"].b == pytest.approx(0.8) and out["x"].b == pytest.approx(0.4)


def test_transport(spark):
    df = spark.createDataFrame([("http://x/y#Sensor", "urn:dev:1#2", 0.95, None, '{"a":[1,-5,true,null,"é",2.5]}')], "t string, id string, c double, v boolean, j string")
    r = df.select(T.topic(F.col("t"), F.col("id")).alias("topic"), T.quality_of_service(F.col("c"), F.col("v")).alias("q"), T.from_cbor(T.to_cbor("j")).alias("back"), T.integrity(F.lit("abc")).alias("h"), T.within_limits(F.col("j"), most_depth=2).alias("ok"), T.within_limits(F.lit("[[[]]]"), most_depth=2).alias("deep")).first()
    assert r.topic == "ld/Sensor/2" and r.q == 2 and json.loads(r.back) == {"a": [1, -5, True, None, "é", 2.5]}
    assert r.h == "sha256-ungWv48Bz+pBQUDeXa4iI7ADYaOWF3qctBD/YfIAFa0=" and r.ok and not r.deep
    assert df.select(T.verify_integrity(F.lit("abc"), F.lit(r.h)).alias("x"), T.is_context_allowed(F.lit("http://a.org/b"), globs=["http://*.org/?"]).alias("y")).first()[:] == (True, True)


def test_rdf(spark):
    rows = spark.createDataFrame([("n", "p", 'say "hi"\n', "string", 0.5, "s", "m", "2020")], "node_id string, prop string, value string, value_kind string, confidence double, source string, method string, extracted_at string")
    lines = rdf.to_ntriples(rows, "urn:", {"confidence": "double"})
    back = documents.from_ntriples(lines, "line").collect()
    assert {(r.subject, r.annotation) for r in back} == {("<n>", None), ("<n>", "<urn:confidence>")}
    assert tuple(rdf.from_prov(rdf.to_prov(rows)).first()) == ("n", 'say "hi"\n', 0.5, "s", "2020", "m")
    assert rdf.to_sosa(rows).where("predicate LIKE '%madeBySensor'").count() == 1


def test_clinical(spark):
    df = spark.createDataFrame([("g", 1, (0.9, 0.0, 0.1, 0.5)), ("g", 2, (0.0, 0.9, 0.1, 0.5)), ("h", 1, (0.9, 0.0, 0.1, 0.5)), ("i", 1, None)], f"g string, k int, opinion {O.SCHEMA}")
    got = {(r.g, r.k): r.action for r in clinical.escalation(df, ["g"], "k").collect()}
    assert got == {("g", 1): "escalate", ("g", 2): "escalate", ("h", 1): "accept", ("i", 1): "human_review"}
    lists = spark.createDataFrame([("s", "1", "Nut", (0.5, 0.2, 0.3, 0.5), 0), ("s", "1", "nuts", (0.5, 0.2, 0.3, 0.5), 1), (None, None, " Egg", (0.5, 0.2, 0.3, 0.5), 2), (None, None, "egg ", (0.5, 0.2, 0.3, 0.5), 3)], f"system string, code string, text string, opinion {O.SCHEMA}, ord int")
    assert {r.key: r.entries for r in clinical.reconcile(lists).collect()} == {"s|1": 2, "egg": 2}
    o = df.select(clinical.coded(F.lit("final"), {"final": (0.9, 0.1)}).alias("o")).first().o
    assert o.u == pytest.approx(0.1) and o.b == pytest.approx(0.81)


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:10", 0.5), ("a", "2024-01-01 00:00:20", 0.5), ("b", "2024-01-01 00:02:00", 0.9)], "k string, ts string, c double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).withColumn("opinion", O.from_confidence(F.col("c"), 0.5))
    q = windowed_fuse(stream, ["k"], "ts", "1 minute", "1 minute").writeStream.format("memory").queryName("fused").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.k: (r.events, r.opinion.u) for r in spark.table("fused").collect()}
    assert got["a"][0] == 2 and got["a"][1] == pytest.approx(1 / 3) and got["b"][0] == 1
