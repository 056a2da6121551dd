"""Clinical resources (JSON) to opinions, by a table: which field of which type says what, and how evidence changes its uncertainty; and documents back to resources.

Codes are written as code p/u in hundredths: the probability that the record's statement holds, and its uncertainty. Factors multiply the uncertainty, which stays within [0, 0.99].
The base rate is the probability itself, so the projected probability is the record's own. An opinion in the element's own extension takes the place of the table's.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from veridelta.functions import opinion as O

EXTENSION = "urn:veridelta:opinion"
Factor = tuple  # (kind, path, ...)


@dataclass(frozen=True)
class Rule:
    """field's opinion: from the code at path, or the one given where there is none there.

    each: an array whose items have the path, and an opinion each, under a name with the index at {}. needs: a path without which there is no opinion. instead: only where
    the type's rules before gave none. by: the path of the code, if it is not the value's. missing: the code of an absent one. floor: the least uncertainty."""

    field: str
    path: str
    codes: str = ""
    factors: tuple[Factor, ...] = ()
    otherwise: tuple[float, float] = (0.5, 0.3)
    each: str = ""
    needs: str = ""
    instead: bool = False
    by: str = ""
    missing: str | None = None
    floor: float = 0.0


def many(path: str, none: float = 1.3, few: float = 0.9, more: float = 0.7, edge: int = 3, absent: float = 1.0, inner: str = "") -> Factor:
    """By the number of items (or those that have an inner path)."""
    return ("many", path, none, few, more, edge, absent, inner)


def by(path: str, codes: str) -> Factor:
    return ("by", path, codes)


def kind_of(path: str, codes: str) -> Factor:
    """By the type of the resource that a reference names."""
    return ("kind", path, codes)


def has(path: str, yes: float, no: float = 1.0) -> Factor:
    return ("has", path, yes, no)


VERIFIED = "refuted 5/10, differential 40/45, entered-in-error 50/70, unconfirmed 55/35, provisional 60/35, confirmed 95/10"
BILLING = "cancelled 10/15, draft 50/40, entered-in-error 50/70, active 85/15"
PLANS = "revoked 10/15, draft 50/40, entered-in-error 50/70, unknown 50/45, on-hold 50/30, active 85/15, completed 90/10"
REPORTED = "amended 0.6, appended 0.7, cancelled 3, corrected 0.6, entered-in-error 5, final 0.5, preliminary 2, registered 1.5, unknown 1.2"
REPORTS = "cancelled 15/20, entered-in-error 50/70, registered 50/40, unknown 50/45, partial 55/35, preliminary 60/35, appended 85/18, amended 88/15, corrected 88/15, final 90/12"
IMPRESSION = (by("status", "completed 0.5, entered-in-error 5, in-progress 2"), many("finding", absent=1.3))
SWITCH = "false 20/15, true 90/10"
CODE = "coding[0].code"

SPEC: dict[str, tuple[Rule, ...]] = {
    "RiskAssessment": (Rule("prediction[{}].probabilityDecimal", "probabilityDecimal", "", (by("status", REPORTED), many("basis", 1.5), has("method.text", 0.8)), (-1.0, 0.15), each="prediction"),),
    "Observation": (
        Rule("interpretation", "code", "N 15/20, I 50/20, L 80/20, A 85/20, H 85/20, R 85/20, S 85/20, AA 95/20, HH 95/20, LL 95/20", (by("status", REPORTED),), (0.5, 0.2), each="interpretation.coding"),
        Rule("status", "status", "cancelled 15/20, entered-in-error 50/70, registered 50/40, unknown 50/45, preliminary 60/35, amended 85/15, corrected 85/15, final 85/15", instead=True),
    ),
    "DiagnosticReport": (Rule("conclusion", "conclusion", REPORTS, by="status", needs="conclusion"), Rule("status", "status", REPORTS, (many("result", absent=1.3),), instead=True)),
    "Condition": (Rule("verificationStatus", f"verificationStatus.{CODE}", VERIFIED, (many("evidence", 1.5),), needs=f"verificationStatus.{CODE}"),),
    "AllergyIntolerance": (Rule("verificationStatus", f"verificationStatus.{CODE}", VERIFIED, needs=f"verificationStatus.{CODE}"), Rule("criticality", "criticality", "low 30/15, unable-to-assess 50/45, high 90/15", needs="criticality")),
    "MedicationStatement": (Rule("status", "status", "not-taken 5/10, stopped 10/15, on-hold 40/25, entered-in-error 50/70, unknown 50/45, intended 60/30, active 85/15, completed 90/10", (kind_of("informationSource.reference", "Patient 1.3, Practitioner 0.7, PractitionerRole 0.7, RelatedPerson 1.3"), many("derivedFrom", 1.5)), missing="unknown"),),
    "ClinicalImpression": (Rule("summary", "summary", "", IMPRESSION, (0.75, 0.2), needs="summary"), Rule("status", "status", "", IMPRESSION, (0.75, 0.2), instead=True, missing="in-progress")),
    "DetectedIssue": (Rule("severity", "severity", "low 30/20, moderate 60/25, high 90/15", (by("status", REPORTED), many("evidence", 1.5)), (0.5, 0.25), needs="severity"), Rule("status", "status", "", (by("status", REPORTED), many("evidence", 1.5)), instead=True)),
    "Immunization": (Rule("status", "status", "not-done 5/10, entered-in-error 50/70, completed 85/15", (many("protocolApplied"),), missing="completed"),),
    "FamilyMemberHistory": (Rule("status", "status", "health-unknown 30/55, entered-in-error 50/70, partial 50/40, completed 70/25", (many("condition"), has("dataAbsentReason", 1.3)), missing="completed"),),
    "Procedure": (Rule("status", "status", "not-done 5/10, stopped 20/20, on-hold 40/30, entered-in-error 50/70, preparation 50/40, unknown 50/45, in-progress 60/35, completed 85/15", (has("outcome", 0.7), many("complication", 0.9, 1.2, 1.5, 2), many("followUp", 1.2, 0.9, 0.7, 2)), missing="completed"),),
    "Consent": (Rule("status", "status", "rejected 5/10, inactive 30/25, draft 50/40, entered-in-error 50/45, proposed 50/35, active 90/15", (), (0.5, 0.35), missing="draft"),),
    "Provenance": (
        Rule("recorded", "recorded", "", (has("recorded", 0.8), many("agent", 1.5, 1.0, 0.7, 2, 1.5), ("anonymous", "agent"), ("any", "entity", "role", 0.8)), (0.75, 0.2), needs="recorded"),
        Rule("provenance", "recorded", "", (has("recorded", 0.8, 1.4), many("agent", 1.5, 1.0, 0.7, 2, 1.5), ("anonymous", "agent"), ("any", "entity", "role", 0.8)), (0.75, 0.2), instead=True),
    ),
    "Encounter": (Rule("status", "status", "cancelled 10/15, entered-in-error 50/70, planned 50/35, unknown 50/45, onleave 60/30, arrived 70/25, in-progress 70/30, triaged 75/25, finished 90/10"),),
    "MedicationRequest": (Rule("status", "status", "cancelled 10/15, stopped 15/15, draft 50/40, entered-in-error 50/70, on-hold 50/30, unknown 50/45, active 85/15, completed 90/10"),),
    "CarePlan": (Rule("status", "status", PLANS),),
    "Goal": (
        Rule("lifecycleStatus", "lifecycleStatus", "cancelled 10/15, rejected 10/15, on-hold 40/30, entered-in-error 50/70, proposed 50/40, planned 55/35, accepted 70/25, active 75/25, completed 90/10", (), (0.5, 0.35)),
        Rule("achievementStatus", f"achievementStatus.{CODE}", "not-attainable 5/15, not-achieved 10/15, no-progress 20/25, worsening 25/25, no-change 45/30, in-progress 60/30, improving 70/25, sustaining 85/15, achieved 95/10", needs=f"achievementStatus.{CODE}"),
    ),
    "CareTeam": (Rule("status", "status", "inactive 20/15, suspended 40/25, entered-in-error 50/70, proposed 55/35, active 85/15"),),
    "ImagingStudy": (Rule("status", "status", "cancelled 10/15, entered-in-error 50/70, unknown 50/45, registered 60/35, available 90/10"),),
    "Patient": (Rule("data_quality", "", "", (("filled", ("name", "gender", "birthDate", "telecom", "address", "identifier", "maritalStatus", "communication"), 0.6),), (0.75, 0.25)),),
    "Organization": (Rule("active", "active", SWITCH, (), (0.5, 0.25), missing="true"),),
    "Practitioner": (Rule("active", "active", SWITCH, (), (0.5, 0.25), missing="true"),),
    "Device": (Rule("status", "status", "inactive 25/15, entered-in-error 50/70, unknown 50/45, active 90/10"),),
    "Claim": (Rule("status", "status", BILLING),),
    "ExplanationOfBenefit": (Rule("status", "status", BILLING), Rule("outcome", "outcome", "error 15/20, queued 50/40, partial 60/30, complete 90/10", needs="outcome")),
    "MedicationAdministration": (Rule("status", "status", "not-done 5/10, stopped 15/15, on-hold 40/25, entered-in-error 50/70, unknown 50/45, in-progress 70/30, completed 90/10"),),
    "ServiceRequest": (Rule("status", "status", PLANS, (by("intent", "directive 0.8, filler-order 0.8, instance-order 0.7, option 1.5, order 0.7, original-order 0.7, plan 1.2, proposal 1.4, reflex-order 0.9"), by("priority", "asap 0.75, routine 1, stat 0.65, urgent 0.85"), many("reasonReference", inner="reference")), floor=0.01),),
    "QuestionnaireResponse": (Rule("status", "status", "stopped 30/25, entered-in-error 50/70, in-progress 55/35, amended 80/20, completed 85/15", (kind_of("source.reference", "Patient 1.3, Practitioner 0.7, PractitionerRole 0.7, RelatedPerson 1.2"), ("answered", "item", 0.5, 0.8, 1.3, 1.0, 0.8)), floor=0.01),),
    "Specimen": (Rule("status", "status", "unsatisfactory 15/25, unavailable 30/40, entered-in-error 50/50, available 85/15", (("all", "condition", CODE, "AUT 1.6, CFU 0.9, CLOT 1.5, CON 1.5, COOL 1, FROZ 1, HEM 1.4, LIVE 0.9, ROOM 1.1, SNR 2"), many("processing", 1.3, 1.0, 0.8, absent=1.3), has("collection.collector.reference", 0.9, 1.1), has("collection.quantity", 0.9)), floor=0.01),),
    "DocumentReference": (Rule("status", "status", "superseded 25/20, entered-in-error 50/70, current 85/15", (by("docStatus", "amended 0.8, entered-in-error 2, final 0.7, preliminary 1.4"), has("authenticator.reference", 0.8), many("author", 1.2, 1.0, 0.9, 2, inner="reference"), many("content", 1.3, 1.0, 0.9, 2, 1.3)), floor=0.01),),
    "Coverage": (Rule("status", "status", BILLING),),
    "Location": (Rule("status", "status", "inactive 10/15, suspended 40/40, active 90/10", (by("operationalStatus.code", "C 1.5, H 1.1, I 1.3, K 1.8, O 0.8, U 1"),), floor=0.01),),
}


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, "$." + path, kind)


def _lookup(key: Column, codes: str, of: object) -> Column:
    pairs = [x.rsplit(" ", 1) for x in codes.split(", ")]
    return F.create_map(*[F.lit(x) for k, y in pairs for x in (k, of(y))])[key]


def _items(v: Column, path: str) -> Column:
    return _get(v, path, "array<variant>")


@F.pandas_udf(DoubleType())
def _answered(items: pd.Series) -> pd.Series:
    """The share of a questionnaire's leaf items (of any depth) that have an answer; null without items."""

    def count(xs: list) -> tuple[int, int]:
        total = done = 0
        for x in xs:
            inner, answer = x.get("item"), bool(x.get("answer"))
            if inner:
                t, d = count(inner)
                total, done = total + t + answer, done + d + answer
            else:
                total, done = total + 1, done + answer
        return total, done

    def share(text: str | None) -> float | None:
        total, done = count(json.loads(text)) if text else (0, 0)
        return done / total if total else None

    return items.map(share).astype("float64")


def _factor(v: Column, f: Factor) -> Column:
    kind, path = f[0], f[1]
    if kind == "many":
        kept = lambda xs: F.filter(xs, lambda x: F.coalesce(_get(x, f[7]), F.lit("")) != "") if f[7] else xs
        n = O.let(_items(v, path), lambda xs: F.when(xs.isNotNull(), F.size(kept(xs))))
        return O.let(n, lambda n: F.when(n.isNull(), f[6]).when(n == 0, f[2]).when(n < f[5], f[3]).otherwise(f[4]))
    if kind == "by":
        return F.coalesce(_lookup(_get(v, path), f[2], float), F.lit(1.0))
    if kind == "kind":
        return O.let(_get(v, path), lambda ref: F.when(F.contains(ref, F.lit("/")), F.coalesce(_lookup(F.split_part(ref, F.lit("/"), F.lit(1)), f[2], float), F.lit(1.0))).otherwise(1.0))
    if kind == "has":
        return F.when(_get(v, path, "variant").isNotNull(), f[2]).otherwise(f[3])
    if kind == "all":
        each = F.transform(F.coalesce(_items(v, path), F.array().cast("array<variant>")), lambda x: F.coalesce(_lookup(_get(x, f[2]), f[3], float), F.lit(1.0)))
        return F.aggregate(each, F.lit(1.0), lambda x, y: x * y)
    if kind == "any":
        return F.when(F.coalesce(F.exists(_items(v, path), lambda x: _get(x, f[2]).isNotNull()), F.lit(False)), f[3]).otherwise(1.0)
    if kind == "anonymous":  # the share of agents that no reference identifies
        return O.let(_items(v, path), lambda xs: F.when(F.size(xs) > 0, 1 + F.lit(0.3) * F.size(F.filter(xs, lambda x: F.coalesce(_get(x, "who.reference"), F.lit("")) == "")) / F.size(xs)).otherwise(1.0))
    if kind == "answered":
        share = _answered(F.to_json(_get(v, path, "variant")))
        return O.let(share, lambda share: F.when(share.isNull(), 1.0).when(share < f[2], f[4]).when(share > f[3], f[6]).otherwise(f[5]))
    return 1 - F.lit(f[2]) * _filled(v, path) / len(path)


def _filled(v: Column, paths: tuple[str, ...]) -> Column:
    full = lambda p: F.coalesce(F.to_json(_get(v, p, "variant")), F.lit("null")).isin("null", '""', "[]", "{}", "false", "0")
    return sum((F.when(full(p), 0).otherwise(1) for p in paths), F.lit(0))


def _own(v: Column, field: str) -> Column:
    """The opinion in the extension of an element, if it has one of ours."""
    every = _get(v, f"_{field}.extension", "array<struct<url:string,extension:array<struct<url:string,valueDecimal:double>>>>")

    def found(every: Column) -> Column:
        mine = F.filter(every, lambda e: e["url"] == EXTENSION)
        parts = F.map_from_entries(F.filter(F.try_element_at(mine, F.lit(1))["extension"], lambda p: p["url"].isNotNull()))
        o = O.let(parts, lambda m: O.opinion(m["belief"], m["disbelief"], m["uncertainty"], F.coalesce(m["baseRate"], F.lit(0.5))))
        return O.let(o, lambda o: F.when(O.is_valid(o), o))

    return O.let(every, lambda every: F.when(every.isNotNull(), found(every)))


def _none() -> Column:
    return F.array().cast(f"array<struct<field:string,value:string,opinion:{O.SCHEMA},source:string>>")


def _opinions(v: Column, rule: Rule, before: Column | None = None) -> Column:
    """An array of (field, value, opinion, source). before: those of the type's rules before this one."""
    scale = reduce(lambda x, y: x * y, [_factor(v, f) for f in rule.factors], F.lit(1.0))
    p0, u0 = rule.otherwise

    def entry(at: Column, name: Column, own: Column, scale: Column) -> Column:
        shown = _get(at, rule.path) if rule.path else F.concat(_filled(v, rule.factors[0][1]).cast("string"), F.lit(f"/{len(rule.factors[0][1])}"))
        read = F.struct(shown.alias("shown"), (_get(v, rule.by) if rule.by else F.lit(None).cast("string")).alias("by"), own.alias("own"), scale.alias("scale"))

        def rated(x: Column) -> Column:
            code = F.coalesce(x["by"] if rule.by else x["shown"], F.lit(rule.missing))
            p = _get(at, rule.path, "double") if p0 == -1.0 else F.coalesce(_lookup(code, rule.codes, lambda y: int(y.split("/")[0]) / 100), F.lit(p0)) if rule.codes else F.lit(p0)
            u = F.coalesce(_lookup(code, rule.codes, lambda y: int(y.split("/")[1]) / 100), F.lit(u0)) if rule.codes else F.lit(u0)
            value = x["shown"] if rule.missing is None or rule.field == "active" else F.coalesce(x["shown"], F.lit(rule.missing))
            made = F.struct(p.alias("p"), F.greatest(F.lit(rule.floor), F.least(F.lit(0.99), u * x["scale"])).alias("u"))
            whole = lambda m: F.struct(name.alias("field"), value.alias("value"), F.coalesce(x["own"], O.from_confidence(m["p"], m["u"], m["p"])).alias("opinion"), F.when(x["own"].isNotNull(), "extension").otherwise("reconstructed").alias("source"))
            return O.let(made, lambda m: F.when(m["p"].isNotNull(), whole(m)))

        return O.let(read, rated)

    if rule.each:
        outer, _, inner = rule.each.partition(".")
        xs = _items(v, outer)
        if inner:
            xs = F.flatten(F.transform(xs, lambda x: F.coalesce(_items(x, inner), F.array().cast("array<variant>"))))
            shared = F.struct(scale.alias("scale"), _own(v, rule.field).alias("own"))
            out = O.let(shared, lambda s: F.transform(F.filter(xs, lambda x: _get(x, rule.path).isNotNull()), lambda x: entry(x, F.lit(rule.field), s["own"], s["scale"])))
        else:
            head, _, rest = rule.field.partition("{}")
            out = O.let(scale, lambda s: F.transform(xs, lambda x, i: entry(x, F.concat(F.lit(head), i.cast("string"), F.lit(rest)), _own(x, rule.path), s)))
    else:
        element = "recorded" if rule.field == "provenance" else rule.field
        out = F.array(entry(v, F.lit(rule.field), F.lit(None).cast(O.SCHEMA) if rule.field == "data_quality" else _own(v, element), scale))
    out = F.coalesce(F.filter(out, lambda x: x.isNotNull()), _none())
    if rule.needs:
        out = F.when(F.coalesce(_get(v, rule.needs), F.lit("")) != "", out)
    if rule.instead:
        out = F.when(F.size(before) == 0, out)
    return F.coalesce(out, _none())


def _parsed(df: DataFrame, text: str, order: str | None) -> DataFrame:
    v = df.select((F.col(order) if order else F.lit(0)).alias("ord"), F.try_parse_json(F.col(text)).alias("v"))
    return v.select("ord", "v", _get(F.col("v"), "resourceType").alias("type"), _get(F.col("v"), "id").alias("id"), _get(F.col("v"), "status").alias("status"))


def _all_opinions(types: list[str] | None) -> Column:
    """The opinions of a resource v of a type, as an array; null for other types."""
    also = lambda r: lambda before: F.concat(before, _opinions(F.col("v"), r, before))
    out = F.lit(None)
    for kind, rules in SPEC.items():
        if types is None or kind in types:
            found = _opinions(F.col("v"), rules[0])
            for r in rules[1:]:
                found = O.let(found, also(r))
            out = F.when(F.col("type") == kind, found).otherwise(out)
    return out


def from_records(df: DataFrame, text: str = "json", order: str | None = None, types: list[str] | None = None) -> DataFrame:
    """(ord, type, id, status, field, value, opinion, source): a row for each opinion of a resource of the 32 types; other resources, and text that is no JSON, give none.

    types: compiles the rules of these types alone, which plans faster."""
    # no filter by type: it would be pushed below whatever makes the text and evaluate that again; null gives no rows
    return _parsed(df, text, order).select("ord", "type", "id", "status", F.inline(_all_opinions(types)))


# Documents: what the engine's other operators read; fields of a resource in plain form.

#: name, or name=field; :form says how the resource has it.
FIELDS: dict[str, str] = {
    "RiskAssessment": "status", "Observation": "status, value=valueQuantity, effectiveDateTime", "DiagnosticReport": "status, conclusion, effectiveDateTime, result_references=result:refs",
    "Condition": "clinicalStatus:code, onsetDateTime, recordedDate",
    "AllergyIntolerance": "clinicalStatus:code, code, patient:ref, category, type, recordedDate, onsetDateTime, lastOccurrence, asserter:ref, reaction, note:texts",
    "MedicationStatement": "status, medication=medicationCodeableConcept:text", "ClinicalImpression": "status, summary, finding_references=finding:items", "DetectedIssue": "status, implicated_references=implicated:refs",
    "Immunization": "status, vaccineCode:text, occurrenceDateTime, statusReason:text", "FamilyMemberHistory": "status, relationship:text", "Procedure": "status, outcome:text", "Consent": "status, scope:code",
    "Provenance": "recorded, targets=target, agents=agent:agents, entities=entity:entities, activity:code, reason:codes, policy, location:ref, period",
    "Encounter": "status, period", "MedicationRequest": "status, authoredOn", "CarePlan": "status, period", "Goal": "lifecycleStatus", "CareTeam": "status, period", "ImagingStudy": "status, started", "Patient": "",
    "Organization": "active", "Practitioner": "active", "Device": "status, manufactureDate", "Claim": "status, created", "ExplanationOfBenefit": "status, outcome, created", "MedicationAdministration": "status, effectiveDateTime",
    "ServiceRequest": "status, intent, priority, authoredOn, requester:ref, reason_references=reasonReference:refs", "QuestionnaireResponse": "status, authored, questionnaire, source:ref",
    "Specimen": "status, type:text, subject:ref, receivedTime, request_references=request:refs, parent_references=parent:refs, collector=collection.collector:ref, collectedDateTime=collection.collectedDateTime, collection_quantity=collection.quantity, collection_method=collection.method:text, collection_bodySite=collection.bodySite:text, condition_codes=condition:codes, processing_count=processing:count, note:texts",
    "DocumentReference": "status, docStatus, type:text, subject:ref, authenticator:ref, custodian:ref, author_references=author:refs, date, description, securityLabel_codes=securityLabel:codes, relatesTo:links, context_encounter_references=context.encounter:refs, context_period=context.period",
    "Coverage": "status, period, type:text, beneficiary:ref, subscriber:ref, payor_references=payor:refs, dependent, relationship:code, order, network",
    "Location": "status, operationalStatus, name, description, mode, type, telecom, address, physicalType:text, position, managingOrganization:ref, partOf:ref, hoursOfOperation, availabilityExceptions, endpoint_references=endpoint:refs, identifier, alias",
}
_FIRST = lambda x: next((c["code"] for c in x.get("coding", []) if c.get("code")), None)
#: form: (to plain, to the resource's)
FORMS: dict[str, tuple] = {
    "": (lambda x: x, lambda x: x),
    "code": (_FIRST, lambda x: {"coding": [{"code": x}]}),
    "text": (lambda x: x.get("text") or _FIRST(x), lambda x: {"text": x}),
    "ref": (lambda x: x.get("reference"), lambda x: {"reference": x}),
    "refs": (lambda x: [r["reference"] for r in x if r.get("reference")], lambda x: [{"reference": r} for r in x]),
    "items": (lambda x: [r["itemReference"]["reference"] for r in x if r.get("itemReference", {}).get("reference")], lambda x: [{"itemReference": {"reference": r}} for r in x]),
    "codes": (lambda x: [c for c in map(_FIRST, x) if c], lambda x: [{"coding": [{"code": c}]} for c in x]),
    "texts": (lambda x: [n.get("text", "") for n in x], lambda x: [{"text": t} for t in x]),
    "count": (len, lambda n: [{} for _ in range(n)]),
    "links": (lambda x: [{"code": r.get("code"), "target": r.get("target", {}).get("reference")} for r in x], lambda x: [{"code": r.get("code"), "target": {"reference": r.get("target") or ""}} for r in x]),
    "agents": (
        lambda x: [{k: v for k, v in (("type", _FIRST(a.get("type", {}))), ("who", a.get("who", {}).get("reference")), ("onBehalfOf", a.get("onBehalfOf", {}).get("reference"))) if v} for a in x],
        lambda x: [{k: {"coding": [{"code": v}]} if k == "type" else {"reference": v} for k, v in a.items()} for a in x],
    ),
    "entities": (
        lambda x: [{k: v for k, v in (("role", e.get("role")), ("what", e.get("what", {}).get("reference"))) if v} for e in x],
        lambda x: [{k: v if k == "role" else {"reference": v} for k, v in e.items()} for e in x],
    ),
}


@cache
def _fields(kind: str) -> list[tuple[str, list[str], str]]:
    out = []
    for x in filter(None, FIELDS.get(kind, "").split(", ")):
        name, _, form = x.partition(":")
        name, _, path = name.partition("=")
        out.append((name, (path or name).split("."), form))
    return out


def _plain(resource: dict) -> dict:
    doc = {}
    for name, path, form in _fields(resource.get("resourceType", "")):
        x = reduce(lambda r, k: r.get(k) if isinstance(r, dict) else None, path, resource)
        y = None if x is None else FORMS[form][0](x)
        if y is not None:
            doc[name] = y
    return doc


def _full(doc: dict) -> dict:
    kind = doc.get("@type", "").rpartition(":")[2]
    if kind not in SPEC:
        raise ValueError(f"no resource type: {doc.get('@type')}")
    out: dict = {"resourceType": kind}
    if doc.get("id") is not None:
        out["id"] = doc["id"]
    for name, path, form in _fields(kind):
        if doc.get(name) not in (None, []):
            reduce(lambda r, k: r.setdefault(k, {}), path[:-1], out)[path[-1]] = FORMS[form][1](doc[name])
    names = {r.field for r in SPEC[kind]} | {"status"} & {n for n, _, _ in _fields(kind)}
    for e in doc.get("opinions", []):
        o, field, value = e["opinion"], e.get("field", ""), e.get("value")
        ext = {"extension": [{"url": EXTENSION, "extension": [{"url": k, "valueDecimal": o[x]} for k, x in (("belief", "b"), ("disbelief", "d"), ("uncertainty", "u"), ("baseRate", "a"))]}]}
        if kind == "RiskAssessment":
            out.setdefault("prediction", []).append({"probabilityDecimal": o["b"] + o["a"] * o["u"], "_probabilityDecimal": ext})
        elif kind == "Provenance":
            out["_recorded"] = ext
        elif field in names:
            if field == "interpretation" and value is not None:
                out.setdefault(field, []).append({"coding": [{"code": value}]})
            elif field in ("verificationStatus", "achievementStatus") and value is not None:
                out[field] = {"coding": [{"code": value}]}
            elif field in ("criticality", "severity") and value is not None:
                out[field] = value
            out[f"_{field}"] = ext
    return out


@F.pandas_udf(StringType())
def _plain_json(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else json.dumps(_plain(json.loads(t))))


def to_documents(df: DataFrame, text: str = "json", order: str | None = None, types: list[str] | None = None) -> DataFrame:
    """(ord, type, id, document, nodes_converted, warning): each resource as a document with its fields in plain form and its opinions. An unknown type gives an empty document and a warning;
    text that is no JSON, or has no type, gives no row."""
    rows = _parsed(df, text, order).where("type IS NOT NULL")
    known = F.col("type").isin(*(types or SPEC))
    rows = rows.select("ord", "type", "id", F.when(known, _all_opinions(types)).alias("ops"), F.when(known, _plain_json(F.to_json("v"))).alias("fields"))
    head = F.to_json(F.struct(F.concat(F.lit("fhir:"), "type").alias("@type"), "id"))
    inner = F.regexp_extract(F.col("fields"), r"(?s)^\{(.*)\}$", 1)
    document = F.concat(F.rtrim(head, F.lit("}")), F.when(inner != "", F.concat(F.lit(","), inner)).otherwise(""), F.lit(',"opinions":'), F.coalesce(F.to_json("ops"), F.lit("[]")), F.lit("}"))
    document = F.when(F.col("fields").isNull(), F.concat(F.rtrim(head, F.lit("}")), F.lit(',"opinions":[]}'))).otherwise(document)
    return rows.select("ord", "type", "id", document.alias("document"), F.coalesce(F.size("ops"), F.lit(0)).alias("nodes_converted"), F.when(~known, F.concat(F.lit("unsupported type "), "type")).alias("warning"))


def to_records(df: DataFrame, document: str = "document") -> DataFrame:
    """df with the resource (JSON) of each document in the column record: fields in the resource's form, opinions as extensions of their elements. A document of no known type is an error."""
    kinds = StructType([f for f in df.schema if f.name != "record"] + [StructField("record", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            text = [None if t is None else json.dumps(_full(json.loads(t))) for t in x.column(document).to_pylist()]
            names = [n for n in x.schema.names if n != "record"]
            yield pa.RecordBatch.from_arrays([*[x.column(n) for n in names], pa.array(text, pa.string())], [*names, "record"])

    # not a UDF: what makes the document would be evaluated again for each filter that comes after
    return df.mapInArrow(run, kinds)


def bundle_entries(df: DataFrame, text: str = "json", order: str | None = None) -> DataFrame:
    """(ord, json): the resources of bundles, in their order."""
    v = df.select((F.col(order) if order else F.lit(0)).alias("b"), F.try_parse_json(F.col(text)).alias("v"))
    rows = v.select("b", F.posexplode(F.try_variant_get("v", "$.entry", "array<variant>")).alias("i", "e"))
    return rows.select(F.struct("b", "i").alias("ord"), F.to_json(F.try_variant_get("e", "$.resource", "variant")).alias("json"))


def to_extension(o: Column) -> Column:
    """The opinion as the JSON of an element extension, which from_records reads again."""
    part = lambda n, k: F.struct(F.lit(n).alias("url"), o[k].alias("valueDecimal"))
    return F.to_json(F.struct(F.lit(EXTENSION).alias("url"), F.array(part("belief", "b"), part("disbelief", "d"), part("uncertainty", "u"), part("baseRate", "a")).alias("extension")))
