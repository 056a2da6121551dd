"""Clinical records, shape languages, cards, contexts and vocabularies."""

import json

import pytest
from pyspark.sql import functions as F

from veridelta.functions import opinion as O
from veridelta.sources import clinical_records as C
from veridelta.sources import rdf, schemas


def opinions(spark, *resources):
    rows = C.from_records(spark.createDataFrame([(json.dumps(r),) for r in resources], "json string")).collect()
    return {(r.type, r.field): r.opinion for r in rows}


def test_every_type_gives_an_opinion(spark):
    assert len(C.SPEC) == 32
    got = {r.type: r for r in C.from_records(spark.createDataFrame([(json.dumps({"resourceType": k, "prediction": [{"probabilityDecimal": 0.4}], "verificationStatus": {"coding": [{"code": "confirmed"}]}}),) for k in C.SPEC], "json string")).collect()}
    assert set(got) == set(C.SPEC)
    for r in got.values():
        o = r.opinion
        assert o.b + o.d + o.u == pytest.approx(1) and o.b + o.a * o.u == pytest.approx(o.a) and r.source == "reconstructed"


def test_documents_and_back(spark):
    fields = {
        "AllergyIntolerance": {"clinicalStatus": {"coding": [{"code": "active"}]}, "code": {"text": "x"}, "patient": {"reference": "p/1"}, "note": [{"text": "n"}], "category": ["food"]},
        "Provenance": {"recorded": "2024-01-01", "target": [{"reference": "a/1"}], "agent": [{"type": {"coding": [{"code": "author"}]}, "who": {"reference": "p/1"}}], "entity": [{"role": "source", "what": {"reference": "d/1"}}], "reason": [{"coding": [{"code": "T"}]}], "activity": {"coding": [{"code": "CREATE"}]}},
        "Specimen": {"status": "available", "type": {"text": "blood"}, "collection": {"collector": {"reference": "p/1"}, "method": {"text": "m"}}, "processing": [{}, {}], "condition": [{"coding": [{"code": "HEM"}]}]},
        "DocumentReference": {"status": "current", "relatesTo": [{"code": "replaces", "target": {"reference": "d/1"}}], "context": {"encounter": [{"reference": "e/1"}], "period": {"start": "2024"}}},
        "RiskAssessment": {"status": "final", "prediction": [{"probabilityDecimal": 0.25}, {"probabilityDecimal": 0.5}]},
        "Goal": {"lifecycleStatus": "active", "achievementStatus": {"coding": [{"code": "achieved"}]}},
    }
    made = [{"resourceType": k, "id": str(i)} | f for i, (k, f) in enumerate(fields.items())] + [{"resourceType": "Basic", "id": "b"}]
    docs = C.to_documents(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(made)], "i int, json string"), order="i")
    rows = {r.type: r for r in C.to_records(docs.where("warning IS NULL")).collect()}
    for kind, want in fields.items():
        got = json.loads(rows[kind].record)
        bare = {k: [{a: b for a, b in p.items() if a[0] != "_"} for p in v] if k == "prediction" else v for k, v in got.items() if k[0] != "_"}
        assert bare == {"resourceType": kind, "id": got["id"]} | want and rows[kind].nodes_converted == len(json.loads(rows[kind].document)["opinions"])
    odd = docs.where("warning IS NOT NULL").first()
    assert odd.type == "Basic" and json.loads(odd.document) == {"@type": "fhir:Basic", "id": "b", "opinions": []}
    first = {(r.type, r.value, r.opinion) for r in C.from_records(C.to_records(docs.where("warning IS NULL")), "record").collect() if r.source == "extension"}
    assert len(first) == 7


def test_evidence_lowers_uncertainty(spark):
    base = {"resourceType": "DiagnosticReport", "status": "final"}
    few, more = opinions(spark, base | {"result": [1]}), opinions(spark, base | {"result": [1, 2, 3]})
    key = ("DiagnosticReport", "status")
    assert few[key].u == pytest.approx(0.12 * 0.9) and more[key].u == pytest.approx(0.12 * 0.7)


def test_own_extension_wins_and_round_trips(spark):
    o = (0.5, 0.2, 0.3, 0.4)
    ext = spark.createDataFrame([(o,)], f"o {O.SCHEMA}").select(C.to_extension(F.col("o")).alias("x")).first().x
    got = opinions(spark, {"resourceType": "Claim", "status": "active", "_status": {"extension": [json.loads(ext)]}})
    assert tuple(got["Claim", "status"]) == pytest.approx(o)


def test_bundles_and_junk(spark):
    b = {"resourceType": "Bundle", "entry": [{"resource": {"resourceType": "Device", "status": "active"}}, {"resource": {"resourceType": "Unknown"}}, {}]}
    df = spark.createDataFrame([(json.dumps(b),), ("{",), (None,)], "json string")
    assert [r.type for r in C.from_records(C.bundle_entries(df)).collect()] == ["Device"]


SHAPE = {"type": "Person", "properties": {"name": {"required": True, "min_length": 2, "pattern": "^A"}, "age": {"datatype": "xsd:integer", "minimum": 0, "maximum": 150}, "tag": {"max_count": 3, "in": ["x", "y"]}, "start": {"less_than": "end"}, "n": {"if": {"minimum": 5}, "then": {"maximum": 9}}}}


def test_shape_languages():
    assert schemas.shacl_to_shape(schemas.shape_to_shacl(SHAPE)) == (SHAPE, [])
    assert schemas.owl_to_shape(schemas.shape_to_owl(SHAPE)) == SHAPE
    _, warnings = schemas.shacl_to_shape({schemas.SH + "property": [{schemas.SH + "path": {"@id": "p"}, schemas.SH + "sparql": "x"}]})
    assert len(warnings) == 1


def test_contexts_and_cards(spark):
    c = schemas.compare_contexts({"a": "1", "b": "2", "@contextVersion": "1"}, {"a": "9", "c": "3", "@contextVersion": "2"})
    assert (c.added, c.removed, c.changed, c.compatible) == (["c"], ["b"], ["a"], False)
    card = schemas.add_distribution(schemas.dataset_card("d", spark.range(1)), "f", "u", "text/csv")
    (records,) = card["recordSet"]
    assert [f["dataType"] for f in records["field"]] == ["sc:Integer"]
    assert schemas.from_croissant(schemas.to_croissant(card)) == card


def test_privacy_and_sensor_vocabularies(spark):
    rows = spark.createDataFrame([("n", "p", "v", "sensitive", "consent", "c", "s", "EU", None), ("m", "p", "v", None, None, None, None, None, None)], "node_id string, prop string, value string, category string, legal_basis string, controller string, data_subject string, jurisdiction string, retention_until string")
    assert [tuple(r)[1:] for r in rdf.from_dpv(rdf.to_dpv(rows)).collect()] == [("sensitive", "consent", "c", "s", "EU")]
    seen = spark.createDataFrame([("n", "p", "v", "cam", "2020", "m")], "node_id string, prop string, value string, source string, extracted_at string, method string")
    assert tuple(rdf.from_sosa(rdf.to_sosa(seen)).first()) == ("n", "p", "v", "cam", "2020", "m")
