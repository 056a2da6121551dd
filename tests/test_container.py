"""Networks as bundles of tables: rules of change, and inference over many states; builders and documents that queries don't reach."""

import json

import pytest
from pyspark.sql import functions as F

from veridelta.functions import opinion as O
from veridelta.functions import resources
from veridelta.functions import transport as T
from veridelta.functions import vectors as V
from veridelta.operators import fusion, governance
from veridelta.operators.container import DuplicateError, Network
from veridelta.operators.network import CycleError, NodeNotFoundError
from veridelta.sources import schemas
from veridelta.sources.processor import Processor


def test_rules_of_change(spark):
    df = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    nodes = df([("a",), ("b",), ("c",)], "node string").withColumn("opinion", O.opinion(0.5, 0.2, 0.3))
    edge = lambda *x: df(list(x), "source string, target string").withColumn("given", O.opinion(0.9, 0.0, 0.1))
    n = Network.of(spark, nodes=nodes, edges=edge(("a", "b"), ("b", "c")))
    with pytest.raises(DuplicateError):
        n.add_nodes(nodes.limit(1))
    with pytest.raises(DuplicateError):
        n.add_edges(edge(("a", "b")))
    with pytest.raises(NodeNotFoundError):
        n.add_edges(edge(("a", "z")))
    with pytest.raises(CycleError):
        n.add_edges(edge(("c", "a")))
    with pytest.raises(ValueError, match="agent"):
        n.add_agents(df([("x", "content")], "node string, kind string"))
    m = n.add_agents(df([("x",), ("y",)], "node string")).add_trust(df([("x", "y"), ("y", "x")], "source string, target string").withColumn("opinion", O.opinion(0.8, 0.0, 0.2)))
    assert m.trust.count() == 2 and m.node_count() == 5 and n.node_count() == 3  # trust may run in cycles, and the first bundle is as it was


def test_many_states(spark):
    n = Network.of(spark, nodes=spark.createDataFrame([("w",), ("g",)], "node string"), multinomial=spark.createDataFrame([("w", "g", s, o, b, 0.2, 0.5) for s, o, b in (("sun", "dry", 0.7), ("sun", "wet", 0.1), ("rain", "dry", 0.1), ("rain", "wet", 0.7))], "source string, target string, state string, outcome string, b double, u double, a double"))
    roots = spark.createDataFrame([("w", "sun", 0.5, 0.2, 0.5), ("w", "rain", 0.3, 0.2, 0.5)], "node string, state string, b double, u double, a double")
    got = {r.state: r for r in n.infer_multinomial(roots).collect()}
    assert got["dry"].b == pytest.approx(0.6 * 0.7 + 0.4 * 0.1) and got["wet"].u == pytest.approx(0.2)
    assert n.has_edge("w", "g", "multinomial") and n.edge_count() == 1


def test_bounds_are_errors(spark):
    one = spark.range(1)
    for bad in (governance.annotate_protection(F.lit(1), category=F.lit("odd")), governance.consent_record(F.lit("2024"), F.array().cast("array<string>")), T.to_payload(F.lit('"' + "x" * 300 + '"'), most=100)):
        with pytest.raises(Exception, match="no category|needs a time|too large"):
            one.select(bad).collect()
    with pytest.raises(ValueError, match="trust weights"):
        fusion.ByzantineConfig(strategy="combined")
    with pytest.raises(ValueError, match="positive"):
        V.term_definition("v", "urn:v", 0)
    assert V.term_definition("v", "urn:v", 3, "cosine") == {"v": {"@id": "urn:v", "@container": "@vector", "@dimensions": 3, "@similarity": "cosine"}}


def test_processor(spark):
    p = Processor({"ex": "http://ex.org/", "name": "ex:name", "knows": {"@id": "ex:knows", "@type": "@id"}, "Person": "ex:Person"})
    doc = json.dumps({"@context": {}, "@id": "ex:a", "@type": "Person", "name": ["A", None], "knows": "ex:b", "odd": 1})
    df = spark.createDataFrame([(doc,)], "j string")
    expand, flat, short = (json.loads(x) for x in df.select(p.expand(F.col("j")), p.flatten(F.col("j")), p.compact(F.col("j"))).first())
    want = {"@id": "http://ex.org/a", "@type": ["http://ex.org/Person"], "http://ex.org/name": [{"@value": "A"}, {"@value": None}], "http://ex.org/knows": [{"@id": "http://ex.org/b"}]}
    assert expand == [want] and flat[0]["http://ex.org/knows"] == [{"@id": "http://ex.org/b"}] and short["name"][0] == "A"
    with pytest.raises(Exception, match="limits"):
        df.select(Processor(max_chars=5).expand(F.col("j"))).collect()


def test_cards_contexts_and_texts():
    assert schemas.validate_card({"@type": "Dataset", "name": "d"}) == [] and ("name", "required") in schemas.validate_card({"@type": "Dataset"}) and ("@type", "type") in schemas.validate_card({"name": "d"})
    changes = schemas.context_changes({"a": "x", "b": {"@id": "y", "@type": "t"}, "c": "z"}, {"a": "w", "b": {"@id": "y", "@type": "u"}, "d": "q"})
    assert [(c.term, c.kind, c.breaking) for c in changes] == [("a", "changed", True), ("b", "@type-changed", True), ("c", "removed", True), ("d", "added", False)]
    assert schemas.shape_verbosity({"properties": {"n": {"required": True}}})["bytes_saved_pct"] > 0
    for f in resources.RESOURCES.values():
        assert json.loads(f())
    assert "registry" in resources.annotate_results_guide("registry", 0.7) and "a -> b" in resources.trust_chain_guide(["a", "b"])
