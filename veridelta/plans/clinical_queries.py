"""Registered queries over clinical records: every event is a resource of some form, in JSON; the SQL has the expected probability and uncertainty of each form as numbers.

The numbers are products of the published tables' entries, written out factor by factor, so they don't share the operator's table.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.functions import opinion as O
from veridelta.operators import clinical
from veridelta.plans.queries import CONF, conf, query, r6
from veridelta.sources import clinical_records as records

REF = lambda *xs: [{"reference": x} for x in xs]
CODED = lambda x: {"coding": [{"code": x}]}

#: type: [(fields of the resource, [(field, probability, uncertainty)])]
CASES: dict[str, list[tuple[dict, list[tuple[str, str, str]]]]] = {
    "RiskAssessment": [
        ({"status": "final", "prediction": [{"probabilityDecimal": 0.3}, {"qualitativeRisk": {}}, {"probabilityDecimal": 0.8}], "basis": REF("a/1", "a/2", "a/3"), "method": {"text": "score"}}, [("prediction[0].probabilityDecimal", "0.3", "0.15*0.5*0.7*0.8"), ("prediction[2].probabilityDecimal", "0.8", "0.15*0.5*0.7*0.8")]),
        ({"status": "preliminary", "prediction": [{"probabilityDecimal": 0.05}], "basis": []}, [("prediction[0].probabilityDecimal", "0.05", "0.15*2.0*1.5")]),
        ({"prediction": [{"probabilityDecimal": 1.0}], "basis": REF("a/1")}, [("prediction[0].probabilityDecimal", "1.0", "0.15*0.9")]),
        ({"status": "entered-in-error", "prediction": [{"probabilityDecimal": 0.5}], "basis": []}, [("prediction[0].probabilityDecimal", "0.5", "0.99")]),
    ],
    "Observation": [
        ({"status": "final", "interpretation": [CODED("H"), {"coding": [{"code": "HH"}, {"code": "odd"}]}]}, [("interpretation", "0.85", "0.2*0.5"), ("interpretation", "0.95", "0.2*0.5"), ("interpretation", "0.5", "0.2*0.5")]),
        ({"status": "registered", "interpretation": [CODED("N")]}, [("interpretation", "0.15", "0.2*1.5")]),
        ({"status": "preliminary"}, [("status", "0.6", "0.35")]),
        ({}, [("status", "0.5", "0.3")]),
    ],
    "DiagnosticReport": [
        ({"status": "final", "conclusion": "sound", "result": REF("o/1")}, [("conclusion", "0.9", "0.12")]),
        ({"status": "partial"}, [("status", "0.55", "0.35*1.3")]),
        ({"status": "amended", "result": REF("o/1", "o/2", "o/3")}, [("status", "0.88", "0.15*0.7")]),
        ({"status": "appended", "result": REF("o/1")}, [("status", "0.85", "0.18*0.9")]),
    ],
    "Condition": [
        ({"verificationStatus": CODED("confirmed"), "evidence": [{}, {}, {}]}, [("verificationStatus", "0.95", "0.1*0.7")]),
        ({"verificationStatus": CODED("refuted"), "evidence": []}, [("verificationStatus", "0.05", "0.1*1.5")]),
        ({"verificationStatus": CODED("differential")}, [("verificationStatus", "0.4", "0.45")]),
        ({"clinicalStatus": CODED("active")}, []),
    ],
    "AllergyIntolerance": [
        ({"verificationStatus": CODED("confirmed"), "criticality": "high"}, [("verificationStatus", "0.95", "0.1"), ("criticality", "0.9", "0.15")]),
        ({"criticality": "low"}, [("criticality", "0.3", "0.15")]),
        ({"verificationStatus": CODED("unconfirmed")}, [("verificationStatus", "0.55", "0.35")]),
    ],
    "MedicationStatement": [
        ({"status": "active", "informationSource": {"reference": "Practitioner/1"}, "derivedFrom": REF("a/1")}, [("status", "0.85", "0.15*0.7*0.9")]),
        ({"status": "stopped", "informationSource": {"reference": "Patient/1"}}, [("status", "0.1", "0.15*1.3")]),
        ({"derivedFrom": []}, [("status", "0.5", "0.45*1.5")]),
    ],
    "ClinicalImpression": [
        ({"status": "completed", "summary": "likely", "finding": [{}, {}, {}]}, [("summary", "0.75", "0.2*0.5*0.7")]),
        ({"status": "entered-in-error"}, [("status", "0.75", "0.99")]),
        ({"finding": [{}]}, [("status", "0.75", "0.2*0.9")]),
    ],
    "DetectedIssue": [
        ({"status": "final", "severity": "high", "evidence": [{}]}, [("severity", "0.9", "0.15*0.5*0.9")]),
        ({"status": "corrected", "severity": "moderate"}, [("severity", "0.6", "0.25*0.6")]),
        ({"status": "preliminary", "evidence": []}, [("status", "0.5", "0.3*2*1.5")]),
    ],
    "Immunization": [({"status": "completed", "protocolApplied": [{}, {}, {}]}, [("status", "0.85", "0.15*0.7")]), ({"status": "not-done"}, [("status", "0.05", "0.1")]), ({"protocolApplied": []}, [("status", "0.85", "0.15*1.3")])],
    "FamilyMemberHistory": [({"status": "partial", "condition": [{}]}, [("status", "0.5", "0.4*0.9")]), ({"status": "health-unknown", "dataAbsentReason": CODED("x")}, [("status", "0.3", "0.55*1.3")]), ({"status": "completed", "condition": []}, [("status", "0.7", "0.25*1.3")])],
    "Procedure": [
        ({"status": "completed", "outcome": {"text": "well"}, "complication": [], "followUp": [{}, {}]}, [("status", "0.85", "0.15*0.7*0.9*0.7")]),
        ({"status": "stopped", "complication": [{}], "followUp": []}, [("status", "0.2", "0.2*1.2*1.2")]),
        ({"status": "preparation", "complication": [{}, {}]}, [("status", "0.5", "0.4*1.5")]),
    ],
    "Consent": [({"status": "active"}, [("status", "0.9", "0.15")]), ({"status": "rejected"}, [("status", "0.05", "0.1")]), ({}, [("status", "0.5", "0.4")]), ({"status": "odd"}, [("status", "0.5", "0.35")])],
    "Provenance": [
        ({"recorded": "2024-01-01", "agent": [{"who": {"reference": "p/1"}}, {}], "entity": [{"role": "source"}]}, [("recorded", "0.75", "0.2*0.8*0.7*1.15*0.8")]),
        ({"agent": [{}]}, [("provenance", "0.75", "0.2*1.4*1.3")]),
        ({"recorded": "2024-01-01"}, [("recorded", "0.75", "0.2*0.8*1.5")]),
    ],
    "Encounter": [({"status": "finished"}, [("status", "0.9", "0.1")]), ({"status": "onleave"}, [("status", "0.6", "0.3")]), ({}, [("status", "0.5", "0.3")])],
    "MedicationRequest": [({"status": "active"}, [("status", "0.85", "0.15")]), ({"status": "cancelled"}, [("status", "0.1", "0.15")]), ({"status": "draft"}, [("status", "0.5", "0.4")])],
    "CarePlan": [({"status": "completed"}, [("status", "0.9", "0.1")]), ({"status": "revoked"}, [("status", "0.1", "0.15")]), ({"status": "on-hold"}, [("status", "0.5", "0.3")])],
    "Goal": [({"lifecycleStatus": "active", "achievementStatus": CODED("improving")}, [("lifecycleStatus", "0.75", "0.25"), ("achievementStatus", "0.7", "0.25")]), ({}, [("lifecycleStatus", "0.5", "0.35")]), ({"lifecycleStatus": "rejected"}, [("lifecycleStatus", "0.1", "0.15")])],
    "CareTeam": [({"status": "suspended"}, [("status", "0.4", "0.25")]), ({"status": "proposed"}, [("status", "0.55", "0.35")])],
    "ImagingStudy": [({"status": "available"}, [("status", "0.9", "0.1")]), ({"status": "registered"}, [("status", "0.6", "0.35")])],
    "Patient": [({"name": [{"family": "x"}], "gender": "female", "birthDate": "1970-01-01", "maritalStatus": CODED("M")}, [("data_quality", "0.75", "0.25*(1-0.6*4/8)")]), ({"name": [], "active": True}, [("data_quality", "0.75", "0.25")])],
    "Organization": [({"active": True}, [("active", "0.9", "0.1")]), ({"active": False}, [("active", "0.2", "0.15")]), ({}, [("active", "0.9", "0.1")])],
    "Practitioner": [({"active": False}, [("active", "0.2", "0.15")]), ({"active": True}, [("active", "0.9", "0.1")])],
    "Device": [({"status": "inactive"}, [("status", "0.25", "0.15")]), ({"status": "unknown"}, [("status", "0.5", "0.45")])],
    "Claim": [({"status": "active"}, [("status", "0.85", "0.15")]), ({"status": "draft"}, [("status", "0.5", "0.4")]), ({"status": "cancelled"}, [("status", "0.1", "0.15")])],
    "ExplanationOfBenefit": [({"status": "active", "outcome": "partial"}, [("status", "0.85", "0.15"), ("outcome", "0.6", "0.3")]), ({"status": "entered-in-error"}, [("status", "0.5", "0.7")])],
    "MedicationAdministration": [({"status": "not-done"}, [("status", "0.05", "0.1")]), ({"status": "in-progress"}, [("status", "0.7", "0.3")])],
    "ServiceRequest": [
        ({"status": "active", "intent": "order", "priority": "stat", "reasonReference": REF("c/1", "c/2", "c/3")}, [("status", "0.85", "0.15*0.7*0.65*0.7")]),
        ({"status": "draft", "intent": "proposal", "reasonReference": []}, [("status", "0.5", "0.4*1.4*1.3")]),
        ({"status": "revoked", "priority": "urgent"}, [("status", "0.1", "0.15*0.85")]),
    ],
    "QuestionnaireResponse": [
        ({"status": "completed", "source": {"reference": "Patient/1"}, "item": [{"item": [{"answer": [1]}, {"answer": [2]}]}, {"answer": [3]}]}, [("status", "0.85", "0.15*1.3*0.8")]),
        ({"status": "in-progress", "item": [{"item": [{"answer": [1]}, {}, {}]}]}, [("status", "0.55", "0.35*1.3")]),
        ({"status": "amended", "source": {"reference": "Practitioner/1"}, "item": [{"answer": [1]}, {}]}, [("status", "0.8", "0.2*0.7*1.0")]),
    ],
    "Specimen": [
        ({"status": "available", "condition": [CODED("HEM"), CODED("SNR")], "processing": [{}, {}, {}], "collection": {"collector": {"reference": "p/1"}, "quantity": {"value": 1}}}, [("status", "0.85", "0.15*1.4*2.0*0.8*0.9*0.9")]),
        ({"status": "unsatisfactory", "processing": [{}]}, [("status", "0.15", "0.25*1.1")]),
        ({"status": "unavailable"}, [("status", "0.3", "0.4*1.3*1.1")]),
    ],
    "DocumentReference": [
        ({"status": "current", "docStatus": "final", "authenticator": {"reference": "p/1"}, "author": REF("p/1", "p/2"), "content": [{}, {}]}, [("status", "0.85", "0.15*0.7*0.8*0.9*0.9")]),
        ({"status": "superseded", "author": [], "content": [{}]}, [("status", "0.25", "0.2*1.2")]),
        ({"status": "entered-in-error", "docStatus": "entered-in-error"}, [("status", "0.5", "0.99")]),
    ],
    "Coverage": [({"status": "active"}, [("status", "0.85", "0.15")]), ({"status": "cancelled"}, [("status", "0.1", "0.15")])],
    "Location": [({"status": "active", "operationalStatus": {"code": "K"}}, [("status", "0.9", "0.1*1.8")]), ({"status": "suspended", "operationalStatus": {"code": "O"}}, [("status", "0.4", "0.4*0.8")]), ({"status": "inactive"}, [("status", "0.1", "0.15")])],
}


def resources(events: DataFrame, kind: str) -> DataFrame:
    """(event_id, json): events take turns in the forms of a type."""
    forms = F.array(*[F.lit(json.dumps({"resourceType": kind, "id": "@"} | extra)) for extra, _ in CASES[kind]])
    return events.select("event_id", F.replace(F.element_at(forms, (F.col("event_id") % len(CASES[kind]) + 1).cast("int")), F.lit('"@"'), F.concat(F.lit('"'), F.col("event_id").cast("string"), F.lit('"'))).alias("json"))


def expected(kind: str) -> str:
    """SQL of the rows that a type's forms give."""
    rows = ", ".join(f"({i}, '{f}', ({p})::DOUBLE, ({u})::DOUBLE)" for i, (_, want) in enumerate(CASES[kind]) for f, p, u in want)
    return f"""WITH v(i, field, p, u) AS (VALUES {rows}) SELECT event_id, field, round(p * (1 - u), 6) AS b, round((1 - p) * (1 - u), 6) AS d, round(u, 6) AS u, round(p, 6) AS a, round(p, 6) AS p
        FROM events JOIN v ON event_id % {len(CASES[kind])} = i"""


def _register(kind: str) -> None:
    def run(t: Callable[[str], DataFrame]) -> DataFrame:
        out = records.from_records(resources(t("events"), kind), order="event_id", types=[kind])
        return out.select(F.col("ord").alias("event_id"), "field", *O.flat(F.col("opinion")))

    run.__name__ = "clinical_" + "".join("_" + c.lower() if c.isupper() else c for c in kind).lstrip("_")
    run.__doc__ = f"Events as records of the type {kind}, read as opinions."
    query(expected(kind))(run)


for _kind in CASES:
    _register(_kind)


def _round_trip(kind: str) -> Callable[[Callable[[str], DataFrame]], DataFrame]:
    def run(t: Callable[[str], DataFrame]) -> DataFrame:
        docs = records.to_documents(resources(t("events"), kind), order="event_id", types=[kind])
        back = records.from_records(records.to_records(docs), "record", "ord", [kind])
        return back.select(F.col("ord").alias("event_id"), "source", *O.flat(F.col("opinion")))

    run.__name__ = "clinical_export_" + kind.lower()
    run.__doc__ = f"Records of the type {kind} as documents, written as resources again: opinions come back from their extensions."
    return run


for _kind in ("Claim", "AllergyIntolerance", "ServiceRequest", "DetectedIssue"):
    query(expected(_kind).replace("SELECT event_id, field,", "SELECT event_id, 'extension' AS source,"))(_round_trip(_kind))


# Consent

CONSENTS = """WITH c AS (SELECT event_id, [0.9, 0.3, 0.5, 0.5, 0.05, 0.5][1 + event_id % 6]::DOUBLE * CASE WHEN user_id % 5 = 0 THEN 0.7 ELSE 1.0 END AS p,
    least(0.99, [0.15, 0.25, 0.4, 0.35, 0.1, 0.45][1 + event_id % 6]::DOUBLE * CASE WHEN user_id % 4 > 0 THEN greatest(0.3, pow(0.75, user_id % 4)) WHEN user_id % 3 > 0 THEN 1.05 ELSE 1.0 END) AS u FROM events),
    o AS (SELECT event_id, p * (1 - u) AS b, (1 - p) * (1 - u) AS d, u, p AS a FROM c)"""


def consents(t: Callable[[str], DataFrame]) -> Column:
    codes = F.array(*[F.lit(x) for x in ("active", "inactive", "draft", "proposed", "rejected", "entered-in-error")])
    return clinical.consent_opinion(F.element_at(codes, (F.col("event_id") % 6 + 1).cast("int")), F.col("user_id") % 5 == 0, F.col("user_id") % 4, F.col("user_id") % 3)


@query(CONSENTS + " SELECT event_id, round(b, 6) AS b, round(d, 6) AS d, round(u, 6) AS u, round(a, 6) AS a, round(b + a * u, 6) AS p FROM o")
def clinical_consent_opinion(t):
    """Consent status, verification and denial as an opinion."""
    return t("events").select("event_id", *O.flat(consents(t)))


@query(f"""WITH x AS (SELECT event_id, {CONF.format('event_id')} AS c, 0.1::DOUBLE + 0.8::DOUBLE * (event_id % 7) / 7 AS u FROM events UNION ALL SELECT -event_id, 0.5, 0.2 FROM events),
    o AS (SELECT event_id, c * (1 - u) AS b, (1 - c) * (1 - u) AS d, u FROM x)
    SELECT event_id, CASE WHEN u >= 0.5 THEN 'draft' WHEN d > b AND d > u THEN 'rejected' WHEN b > d THEN 'active' ELSE 'draft' END AS status FROM o""")
def clinical_consent_status(t):
    """The consent status that an opinion amounts to; half of the opinions are ties."""
    o = O.from_confidence(conf("event_id"), F.lit(0.1) + F.lit(0.8) * (F.col("event_id") % 7) / 7)
    rows = t("events").select("event_id", o.alias("o"))
    rows = rows.unionByName(rows.select((-F.col("event_id")).alias("event_id"), O.from_confidence(0.5, 0.2).alias("o")))
    return rows.select("event_id", clinical.consent_status(F.col("o")).alias("status"))


@query("""WITH m AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0.9 WHEN 'O' THEN 0.6 ELSE 0.3 END::DOUBLE AS p, 0.15::DOUBLE * CASE o_orderstatus WHEN 'F' THEN 0.5 WHEN 'O' THEN 2.0 ELSE 5.0 END * CASE WHEN o_orderkey % 4 = 0 THEN 1.5 WHEN o_orderkey % 4 < 3 THEN 0.9 ELSE 0.7 END * CASE WHEN o_orderkey % 3 = 0 THEN 0.8 ELSE 1 END AS u FROM orders),
    o AS (SELECT o_orderkey, p, least(u, 0.99) AS u FROM m) SELECT o_orderkey, round(p * (1 - u), 6) AS b, round((1 - p) * (1 - u), 6) AS d, round(u, 6) AS u, round(p, 6) AS a, round(p, 6) AS p FROM o""")
def clinical_scalar(t):
    """A probability with a status, a number of pieces of evidence and a method as an opinion; the largest uncertainties meet the bound."""
    status = F.col("o_orderstatus")
    p = F.when(status == "F", 0.9).when(status == "O", 0.6).otherwise(0.3)
    m = F.when(status == "F", 0.5).when(status == "O", 2.0).otherwise(5.0)
    o = clinical.scalar_to_opinion(p, m, F.col("o_orderkey") % 4, F.when(F.col("o_orderkey") % 3 == 0, F.lit("score")))
    return t("orders").select("o_orderkey", *O.flat(o))


@query(f"SELECT event_id, round(c * 0.8, 6) AS b, round((1 - c) * 0.8, 6) AS d, 0.2::DOUBLE AS u, round(c, 6) AS a, round(c, 6) AS p FROM (SELECT event_id, {CONF.format('event_id')} AS c FROM events)")
def clinical_extension(t):
    """An opinion as an element's extension, and read again."""
    o = O.from_confidence(conf("event_id"), 0.2, conf("event_id"))
    text = F.concat(F.lit('{"resourceType":"Claim","_status":{"extension":[{"url":"urn:other"},'), records.to_extension(o), F.lit("]}}"))
    return records.from_records(t("events").select("event_id", text.alias("json")), order="event_id", types=["Claim"]).select(F.col("ord").alias("event_id"), *O.flat(F.col("opinion")))


@query(f"""WITH r AS (SELECT event_id, user_id, {CONF.format('event_id')} AS c, 0.2::DOUBLE AS u FROM events), o AS (SELECT event_id, user_id, c * (1 - u) AS b, (1 - c) * (1 - u) AS d FROM r),
    m AS (SELECT x.event_id, max(x.b * y.d + x.d * y.b) AS k FROM o x JOIN o y ON x.user_id = y.user_id AND x.event_id <> y.event_id GROUP BY 1)
    SELECT event_id, CASE WHEN coalesce(k, 0) >= 0.35 THEN 'escalate' WHEN d >= 0.5 THEN 'reject' WHEN b >= 0.5 THEN 'accept' ELSE 'human_review' END AS action FROM o LEFT JOIN m USING (event_id)""")
def clinical_escalation(t):
    """What to do with each user's findings, by themselves and by their conflicts."""
    rows = t("events").select("event_id", "user_id", O.from_confidence(conf("event_id"), 0.2).alias("opinion"))
    return clinical.escalation(rows, ["user_id"], "event_id", threshold=0.5, conflict=0.35).select("event_id", "action")


@query(f"""WITH o AS (SELECT s_nationkey AS n, {CONF.format('s_suppkey')} * 0.8 AS b, (1 - {CONF.format('s_suppkey')}) * 0.8 AS d, {CONF.format('s_suppkey')} AS a FROM supplier)
    SELECT n, round(product(b), 10) AS b, round(1 - product(1 - d), 10) AS d, round(greatest(0, product(1 - d) - product(b)), 10) AS u, round(product(a), 10) AS a FROM o GROUP BY 1""")
def clinical_multi_site_meet(t):
    """Consent of several sites holds only together."""
    from veridelta.operators import fusion

    o = F.col("opinion")
    rows = t("supplier").select(F.col("s_nationkey").alias("n"), O.from_confidence(conf("s_suppkey"), 0.2, conf("s_suppkey")).alias("opinion"))
    return fusion.meet(rows, ["n"]).select("n", *[F.round(o[k], 10).alias(k) for k in "bdua"])


@query(f"""WITH x AS (SELECT event_id, {CONF.format('event_id')} * 0.8 AS b, (1 - {CONF.format('event_id')}) * 0.8 AS d, (epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(ts))::DOUBLE / 86400000000 AS days FROM events),
    f AS (SELECT event_id, b, d, CASE WHEN days >= 0 THEN pow(2.0, -days / 10) ELSE 1 END AS f FROM x) SELECT event_id, round(b * f, 6) AS b, round(d * f, 6) AS d, round(1 - b * f - d * f, 6) AS u FROM f""")
def clinical_decay(t):
    """Findings aged by days; those of the future stay as they are."""
    o = clinical.decayed(O.from_confidence(conf("event_id"), 0.2), [F.lit(None).cast("timestamp"), F.col("ts")], F.lit("2024-01-20").cast("timestamp"), 10.0)
    return t("events").select("event_id", *[r6(o[k], k) for k in "bdu"])


@query(f"""WITH x AS (SELECT event_id, {CONF.format('event_id')} * 0.8 AS b, (1 - {CONF.format('event_id')}) * 0.8 AS d FROM events), t(tb) AS (VALUES (0.9::DOUBLE * 0.5))
    SELECT event_id, round(b * tb, 6) AS b, round(d * tb, 6) AS d, round(1 - (b + d) * tb, 6) AS u FROM x, t""")
def clinical_trust_chain(t):
    """A finding seen through two parties."""
    trust = lambda b: O.opinion(b, 0.05, 0.95 - b)
    one = O.from_confidence(conf("event_id"), 0.2).cast(O.SCHEMA)
    o = clinical.trust_chain(F.array(one, one, one), F.array(trust(0.9).cast(O.SCHEMA), trust(0.5).cast(O.SCHEMA)))
    return t("events").select("event_id", *[r6(o[k], k) for k in "bdu"])


@query(f"""WITH l AS (SELECT event_id AS ord, user_id % 20 AS code, {CONF.format('event_id')} AS c, 0.1::DOUBLE + 0.8::DOUBLE * (event_id % 7) / 7 AS u FROM events),
    s AS (SELECT code, count(*) AS entries, 1 / (1 + sum(1 / u) - count(*)) AS u, sum(c * (1 - u) / u) AS b, sum((1 - c) * (1 - u) / u) AS d FROM l GROUP BY 1)
    SELECT code, entries, round(b * u, 6) AS b, round(d * u, 6) AS d, round(u, 6) AS u FROM s""")
def clinical_reconcile(t):
    """Lists of substances matched by code, or by their names without one, and fused."""
    o = O.from_confidence(conf("event_id"), F.lit(0.1) + F.lit(0.8) * (F.col("event_id") % 7) / 7)
    code = (F.col("user_id") % 20).cast("string")
    named = F.col("user_id") % 2 == 0  # even codes come as names, in differing spelling
    rows = t("events").select(
        F.when(~named, F.lit("urn:codes")).alias("system"), F.when(~named, code).alias("code"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" Substance "), code)).otherwise(F.concat(F.lit("SUBSTANCE "), code)).alias("text"), o.alias("opinion"), F.col("event_id").alias("ord")
    )
    out, o = clinical.reconcile(rows), F.col("opinion")
    return out.select(F.regexp_extract("key", r"(\d+)$", 1).cast("long").alias("code"), "entries", *[r6(o[k], k) for k in "bdu"])
