"""What kept queries from growing with their input: shared parts are evaluated once, and groups are not taken apart into pairs where sums or extremes do."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridelta.functions import opinion as O
from veridelta.functions import vectors as V
from veridelta.operators import clinical, fusion, similarity
from veridelta.plans import queries as core
from veridelta.sources import clinical_records as records
from veridelta.sources import rdf
from veridelta.sources.processor import Processor


def optimized(df):
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "100000")
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "1000000")
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_elements_are_read_once(spark):
    """Each part of an opinion read the element's extension and code again."""
    df = spark.createDataFrame([(1, '{"resourceType":"DetectedIssue","severity":"high"}')], "k long, json string")
    plan = optimized(records.from_records(df, order="k", types=["DetectedIssue"]))
    assert plan.count("_severity.extension") == 1 and plan.count("_status.extension") == 1 and plan.count("parseJson") == 1
    back = records.from_records(records.to_records(records.to_documents(df, order="k", types=["DetectedIssue"])), "record", "ord", ["DetectedIssue"])
    assert optimized(back).count("_plain_json(") == 1  # a filter by type made every record twice
    assert back.select("field", "value", "opinion.u", "source").collect() == [("severity", "high", 0.15, "extension")]


def test_shared_factors_of_rules(spark):
    """rules that stand in for others, several codes, elements with an extension of ours, of others, and of none."""
    x = lambda o: '{"url":"urn:veridelta:opinion","extension":[' + ",".join(f'{{"url":"{k}","valueDecimal":{v}}}' for k, v in o.items()) + "]}"
    whole = x({"belief": 0.5, "disbelief": 0.25, "uncertainty": 0.25})
    rows = [
        (1, '{"resourceType":"Observation","status":"final","interpretation":[{"coding":[{"code":"H"},{"system":"s"}]},{}]}'), (2, '{"resourceType":"Observation","status":"final","interpretation":[]}'), (3, '{"resourceType":"Observation","_status":{"extension":[{"url":"urn:other"},' + whole + "]}}"),
        (4, '{"resourceType":"Observation","_status":{"extension":[' + x({"belief": 0.5, "disbelief": 0.6, "uncertainty": 0.25}) + "]}}"), (5, "no JSON"), (6, None), (7, '{"resourceType":"Claim"}'),
    ]
    out = records.from_records(spark.createDataFrame(rows, "k long, json string"), order="k", types=["Observation"]).select("ord", "field", "value", F.round("opinion.u", 6), "source")
    assert sorted(map(tuple, out.collect())) == [(1, "interpretation", "H", 0.1, "reconstructed"), (2, "status", "final", 0.15, "reconstructed"), (3, "status", None, 0.25, "extension"), (4, "status", None, 0.3, "reconstructed")]


def test_provenance_in_one_pass(spark):
    """each kind of statement converted every document again."""
    df = spark.createDataFrame([('{"id":"1","recorded":"2024","targets":[{"reference":"d/1"}],"agents":[{"who":"Device/1","onBehalfOf":"Organization/2"},{"type":"x"}],"entities":[{"role":"source","what":"d/2"},{}]}',), ('{"id":"2"}',)], "document string")
    out = rdf.record_provenance(df)
    assert optimized(out).count("from_json") == 1
    name = lambda x: x.rpartition("#")[2]
    want = {("1", "type", "Activity"), ("1", "endedAtTime", "2024"), ("d/1", "type", "Entity"), ("d/1", "wasGeneratedBy", "urn:activity:1"), ("Device/1", "type", "SoftwareAgent"), ("1", "wasAssociatedWith", "Device/1"), ("Device/1", "actedOnBehalfOf", "Organization/2"), ("d/2", "type", "Entity"), ("1", "hadPrimarySource", "d/2"), ("2", "type", "Activity")}
    got = [(s.removeprefix("urn:activity:"), name(p), name(o)) for s, p, o in out.collect()]
    assert len(got) == len(want) and set(got) == want


def test_consent_records_are_parsed_once(spark):
    """each condition parsed the record, and each part of an opinion each condition."""
    df = spark.createDataFrame([('{"status":"active","dateTime":"2024-01-05","provision":{"period":{"end":"2024-01-10"}},"verification":[{"verified":true}]}', "2024-01-12")], "r string, at string")
    r, at = F.col("r"), F.col("at")
    for o, n in ((clinical.record_opinion(r), 1), (clinical.record_validity(r), 1), (clinical.record_expiry(r, at, 0.25), 1), (clinical.record_withdrawal(r, r, at), 2), (clinical.record_regulatory_change(r, r, at), 2)):
        assert optimized(df.select(o.alias("o"))).count("parseJson") <= n
    got = df.select(clinical.record_expiry(r, at, 0.25).alias("o")).select(*[F.round(F.col("o")[k], 4) for k in "bdu"]).first()
    assert tuple(got) == (0.1997, 0.6878, 0.1125)


def test_let(spark):
    assert spark.range(1).select(O.let(F.col("id") + 1, lambda x: x * x).alias("y")).first().y == 1


def test_outer_rows_against_all_pairs():
    """random, on a line, on a grid, equal, and with keys that have several rows; in one part and in parts of parts."""
    rng = np.random.default_rng(1)
    for n, kind in ((9, "free"), (300, "free"), (300, "line"), (300, "grid"), (40, "equal"), (300, "arc")):
        for keys in (n, 5, 1):
            b = rng.random(n) * 0.8
            d = {"line": 0.8 - b, "arc": np.sqrt(0.64 - b**2)}.get(kind, rng.random(n) * (1 - b))
            if kind == "grid":
                b, d = np.round(b, 1), np.round(d, 1)
            if kind == "equal":
                b, d = b * 0 + 0.3, d * 0 + 0.4
            h = rng.permutation(n) % keys
            parts = [p[fusion._outer(b[p], d[p], h[p])] for p in np.array_split(np.arange(n), 7)]
            at = np.concatenate(parts)
            at = at[fusion._outer(b[at], d[at], h[at])]
            every = np.where(h[:, None] != h[None, :], b[:, None] * d[None, :] + d[:, None] * b[None, :], -1)
            assert np.allclose(every[:, at].max(1), every.max(1), atol=1e-12)
            assert (fusion._worst(b[at], d[at], h[at]) is None) == (keys == 1) and (keys == 1 or abs(fusion._worst(b[at], d[at], h[at]) - every.max()) < 1e-12)


def groups(spark):
    r = random.Random(3)
    rows = []
    for k in range(600):
        b = r.random()
        d = r.random() * (1 - b)
        rows.append((None if k % 50 == 0 else k % 4 if k < 590 else k, None if k % 60 == 7 else k // 2, None if k % 70 == 3 else (b, d, 1 - b - d, 0.5)))
    return spark.createDataFrame(rows, f"g int, k int, opinion {O.SCHEMA}")


def no_pairs(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return not any("< k#" in x or "< _k" in x or "(i#" in x for x in plan.split("\n") if "Join" in x)


def test_extremes_without_pairs(spark):
    """pairs were made, and collected, to know the largest; null groups and keys, and keys of two rows."""
    df = groups(spark)
    pairs = fusion.conflicts(df.where("opinion IS NOT NULL"), ["g"], "k")
    want = {r.g: (r.n, r.m) for r in pairs.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("m")).collect()}
    out = fusion.fusion_report(df, ["g"], "k", scores=False)
    assert no_pairs(out)
    got = {r.g: (r.pairs, r.worst) for r in out.collect()}
    assert len(got) == 15 and {g: x for g, x in got.items() if x[0]} == want and got[595] == (0, None)
    long = fusion.fusion_report(df, ["g"], "k").select("g", F.size("conflict_scores").alias("n"), F.array_max("conflict_scores").alias("m"), "input_count")
    assert {r.g: (r.n, r.m) for r in long.collect() if r.n} == want


def test_escalation_without_pairs(spark):
    """the step it shares with reconciliation."""
    df = groups(spark)
    clash = {(r.g, k) for r in fusion.conflicts(df.where("opinion IS NOT NULL"), ["g"], "k").where("score >= 0.7").collect() for k in (r.i, r.j)}
    out = clinical.escalation(df, ["g"], "k", conflict=0.7)
    assert no_pairs(out)
    rows = out.collect()
    assert len(rows) == 600 and clash and all((r.action == "escalate") == (r.opinion is not None and (r.g, r.k) in clash) for r in rows)


def test_reconciliation_report_without_pairs(spark):
    """all pairs of a code."""
    rows = [("s", str(k % 3), None, (b, 0.8 - b, 0.2, 0.5), k) for k in range(300) for b in ([0.4, 0.1 + k % 7 / 10, 0.41][k % 3],)] + [(None, None, "alone", (0.5, 0.3, 0.2, 0.5), 900)]
    out = clinical.reconciliation_report(spark.createDataFrame(rows, f"system string, code string, text string, opinion {O.SCHEMA}, ord int"), "system", threshold=0.35)
    assert no_pairs(out) and tuple(out.first()) == (1, 301, 3, 1, 1, 4)


def test_totals_are_taken_once(spark):
    """the total was taken again for each element of a distribution."""
    df = spark.createDataFrame([([1.0, 3.0, 0.0], [2.0, 2.0, 4.0])], "v array<double>, w array<double>")
    assert optimized(df.select(V.wasserstein(F.col("v"), F.col("w")).alias("x"))).count("aggregate(") <= 3
    plan = optimized(core.QUERIES["distribution_metrics"](spark, "/root/testdata/sf0.001"))
    assert plan.count("aggregate(") <= 12
    got = df.select(V.shares(F.col("v")).alias("p"), V.wasserstein(F.col("v"), F.col("w")).alias("x")).first()
    assert got.p == [0.25, 0.75, 0.0] and abs(got.x - 0.5) < 1e-12


def test_cosine_pairs(spark):
    """products of blocks against pairs one by one; null elements, null groups, equal keys."""
    r = random.Random(5)
    rows = [(None if k % 97 == 0 else k % 2, k // 2 if k > 150 else k, [None if k == 8 else r.gauss(0, 1) for _ in range(3)]) for k in range(1400)]
    df = spark.createDataFrame(rows, "g int, k int, v array<double>")
    j = df.select("g", F.col("k").alias("i"), F.col("v").alias("x")).join(df.select("g", F.col("k").alias("j"), F.col("v").alias("y")), "g").where("i < j").select("g", "i", "j", F.round(V.cosine(F.col("x"), F.col("y")), 9).alias("c"))
    out = similarity.cosine_pairs(df, ["g"], "k", "v", 2)
    assert "Join" not in optimized(out)
    got = out.select("g", "i", "j", F.round("cosine", 9).alias("c"))
    assert got.count() == j.count() and got.exceptAll(j).isEmpty()
    zero = spark.createDataFrame([(1, 1, [0.0, 0.0]), (1, 2, [1.0, 0.0])], "g int, k int, v array<double>")
    with pytest.raises(Exception, match="zero vector"):
        similarity.cosine_pairs(zero, ["g"], "k", "v").collect()


def test_conflict_matrix_in_one_join(spark):
    """pairs were made for each score, and joined."""
    assert sum("Join" in x for x in optimized(core.QUERIES["conflict_matrix"](spark, "/root/testdata/sf0.001")).split("\n")) == 1
    df = groups(spark).where("opinion IS NOT NULL")
    both = fusion.conflicts(df, ["g"], "k", how=["conflict", "hellinger"], spread=3)
    for how in ("conflict", "hellinger"):
        one, same = fusion.conflicts(df, ["g"], "k", how=how).select("g", "i", "j", "score"), both.select("g", "i", "j", how)
        assert one.exceptAll(same).isEmpty() and same.exceptAll(one).isEmpty()


def test_removal_takes_groups_as_arrays(spark):
    """a call for each group, however small; keys that are null come last, keys of any type come back."""
    rows = [(g, None if k == 3 else f"a{(k * 7) % 5}", (0.9, 0.05, 0.05, 0.5) if k % 3 else (0.05, 0.9, 0.05, 0.5)) for g in (1, 2, None) for k in range(5)]
    out = fusion.byzantine_fuse(spark.createDataFrame(rows, f"g int, k string, opinion {O.SCHEMA}"), ["g"], "k", config=fusion.ByzantineConfig(0.1))
    assert "FlatMapGroups" not in optimized(out)
    got = out.collect()
    assert len(got) == 3 and all(r.removed == ["a0", None] and r.surviving == ["a2", "a3", "a4"] and r.cohesion > 0 and len(r.discords) == 2 for r in got)


def test_statements_are_made_in_parts(spark):
    """One task read a small file and held all statements of it."""
    rows = spark.createDataFrame([("n", "p", "v", "s", None, None, 0.5), ("n", "p", "v", "t", None, None, 0.5)], "node_id string, prop string, value string, source string, method string, extracted_at string, confidence double")
    docs = Processor({"s": "http://s/", "x": "s:x"}).statements(spark.createDataFrame([('{"@id":"s:1","x":[1,2]}',)] * 2, "json string"), "json")
    for out, n in ((rdf.to_prov(rows), 8), (docs, 2)):
        assert "RepartitionByExpression" in optimized(out) and out.count() == n
    assert tuple(rdf.conversion_report(rows, rdf.to_prov(rows)).first())[:4] == (True, 1, 2, 8)
