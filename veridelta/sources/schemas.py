"""Definitions that are small and live on the driver: shapes as SHACL and OWL and back, dataset cards, context versions, privacy terms."""

from __future__ import annotations

from dataclasses import dataclass, field

W3 = "http://www.w3.org/"
SH = W3 + "ns/shacl#"
XSD = W3 + "2001/XMLSchema#"
OWL = W3 + "2002/07/owl#"
SUB = W3 + "2000/01/rdf-schema#subClassOf"
DPV = "https://w3id.org/dpv#"
#: Constraint of a shape -> SHACL term.
TERMS = {"minimum": "minInclusive", "maximum": "maxInclusive", "min_length": "minLength", "max_length": "maxLength", "pattern": "pattern", "min_count": "minCount", "max_count": "maxCount", "less_than": "lessThan", "less_than_or_equals": "lessThanOrEquals", "equals": "equals", "disjoint": "disjoint"}
PATHS = ("less_than", "less_than_or_equals", "equals", "disjoint")


def _local(ref: dict) -> str:
    return ref["@id"].rpartition("#")[2]


def _rule_to_shacl(rule: dict) -> dict:
    out: dict = {}
    if rule.get("required"):
        out[SH + "minCount"] = max(1, rule.get("min_count", 1))
    for k, t in TERMS.items():
        if k in rule and not (k == "min_count" and rule.get("required")):
            out[SH + t] = {"@id": rule[k]} if k in PATHS else rule[k]
    if "datatype" in rule:
        out[SH + "datatype"] = {"@id": XSD + rule["datatype"].rpartition(":")[2]}
    if "in" in rule:
        out[SH + "in"] = {"@list": list(rule["in"])}
    for k in ("or", "and"):
        if k in rule:
            out[SH + k] = {"@list": [_rule_to_shacl(r) for r in rule[k]]}
    if "not" in rule:
        out[SH + "not"] = _rule_to_shacl(rule["not"])
    if "if" in rule:  # not A or B, and A or C
        out[SH + "or"] = {"@list": [{SH + "not": _rule_to_shacl(rule["if"])}, _rule_to_shacl(rule.get("then", {}))], "else": _rule_to_shacl(rule.get("else", {})), "conditional": True}
    if "severity" in rule:
        out[SH + "severity"] = {"@id": SH + rule["severity"].capitalize()}
    if "shape" in rule:
        out[SH + "node"] = shape_to_shacl(rule["shape"])
    return out


def shape_to_shacl(shape: dict, iri: str = "_:shape") -> dict:
    props = [{SH + "path": {"@id": n}} | _rule_to_shacl(r) for n, r in shape.get("properties", {}).items()]
    return {"@id": iri, "@type": SH + "NodeShape", SH + "property": props} | ({SH + "targetClass": {"@id": shape["type"]}} if "type" in shape else {})


def _rule_from_shacl(s: dict) -> dict:
    rule: dict = {}
    back = {SH + t: k for k, t in TERMS.items()}
    for k, v in s.items():
        if k == SH + "minCount" and v == 1:
            rule["required"] = True
        elif k in back:
            rule[back[k]] = v["@id"] if isinstance(v, dict) else v
        elif k == SH + "datatype":
            rule["datatype"] = "xsd:" + _local(v)
        elif k == SH + "in":
            rule["in"] = v["@list"]
        elif k == SH + "or" and v.get("conditional"):
            rule |= {"if": _rule_from_shacl(v["@list"][0][SH + "not"]), "then": _rule_from_shacl(v["@list"][1])}
            if v.get("else"):
                rule["else"] = _rule_from_shacl(v["else"])
        elif k in (SH + "or", SH + "and"):
            rule[k.rpartition("#")[2]] = [_rule_from_shacl(x) for x in v["@list"]]
        elif k == SH + "not":
            rule["not"] = _rule_from_shacl(v)
        elif k == SH + "severity":
            rule["severity"] = _local(v).lower()
        elif k == SH + "node":
            rule["shape"] = shacl_to_shape(v)[0]
    return rule


def shacl_to_shape(doc: dict) -> tuple[dict, list[str]]:
    """(shape, warnings); a minimum count of 1 is read as required, terms without a counterpart are warned of."""
    known = {SH + t for t in TERMS.values()} | {SH + t for t in ("path", "datatype", "in", "or", "and", "not", "severity", "node")}
    warnings = [f"not supported: {k}" for p in doc.get(SH + "property", []) for k in p if k not in known]
    shape: dict = {"properties": {p[SH + "path"]["@id"]: _rule_from_shacl(p) for p in doc.get(SH + "property", [])}}
    if SH + "targetClass" in doc:
        shape["type"] = doc[SH + "targetClass"]["@id"]
    return shape, warnings


def shape_to_owl(shape: dict) -> dict:
    """A class with a restriction for each bound that OWL can state; other constraints stay as annotations."""
    parts, notes = [], {}
    facets = {"minimum": "minInclusive", "maximum": "maxInclusive", "min_length": "minLength", "max_length": "maxLength", "pattern": "pattern"}
    for name, r in shape.get("properties", {}).items():
        on = {"@type": OWL + "Restriction", OWL + "onProperty": {"@id": name}}
        if r.get("required") or "min_count" in r:
            parts.append(on | {OWL + "minCardinality": max(int(bool(r.get("required"))), r.get("min_count", 0))})
        if "max_count" in r:
            parts.append(on | {OWL + "maxCardinality": r["max_count"]})
        used = {k: r[k] for k in facets if k in r}
        base = r.get("datatype", "").rpartition(":")[2]
        if used:
            parts.append(on | {OWL + "allValuesFrom": {OWL + "onDatatype": {"@id": XSD + (base or ("string" if set(used) <= {"min_length", "max_length", "pattern"} else "decimal"))}, OWL + "withRestrictions": {"@list": [{XSD + facets[k]: v} for k, v in used.items()]}}})
        elif base:
            parts.append(on | {OWL + "allValuesFrom": {"@id": XSD + base}})
        if "in" in r:
            parts.append(on | {OWL + "allValuesFrom": {OWL + "oneOf": {"@list": list(r["in"])}}})
        rest = {k: v for k, v in r.items() if k not in (*facets, "required", "min_count", "max_count", "datatype", "in")}
        if rest:
            notes[name] = rest
    return {"@id": shape.get("type", "_:class"), "@type": OWL + "Class", SUB: parts} | ({"annotations": notes} if notes else {})


def owl_to_shape(doc: dict) -> dict:
    props: dict = {}
    names = {"minInclusive": "minimum", "maxInclusive": "maximum", "minLength": "min_length", "maxLength": "max_length", "pattern": "pattern"}
    for r in doc.get(SUB, []):
        rule = props.setdefault(r[OWL + "onProperty"]["@id"], {})
        if OWL + "minCardinality" in r:
            n = r[OWL + "minCardinality"]
            rule |= {"required": True} if n == 1 else {"min_count": n}
        if OWL + "maxCardinality" in r:
            rule["max_count"] = r[OWL + "maxCardinality"]
        v = r.get(OWL + "allValuesFrom", {})
        if "@id" in v:
            rule["datatype"] = "xsd:" + _local(v)
        if OWL + "oneOf" in v:
            rule["in"] = v[OWL + "oneOf"]["@list"]
        for f in v.get(OWL + "withRestrictions", {}).get("@list", []):
            for k, x in f.items():
                rule[names[k.rpartition("#")[2]]] = x
        on = v.get(OWL + "onDatatype")
        base = _local(on) if on else ""
        if base not in ("", "string", "decimal"):
            rule["datatype"] = "xsd:" + base
    for name, rest in doc.get("annotations", {}).items():
        props.setdefault(name, {}).update(rest)
    return {"properties": props} | ({"type": doc["@id"]} if not doc["@id"].startswith("_:") else {})


@dataclass
class Compatibility:
    added: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    changed: list[str] = field(default_factory=list)
    breaking: list[str] = field(default_factory=list)

    @property
    def compatible(self) -> bool:
        return not self.breaking


def compare_contexts(old: dict, new: dict) -> Compatibility:
    """Removed and redefined terms break what was written with the old context; added ones don't. The version entry is no term."""
    a, b = ({k: v for k, v in c.items() if k != "@contextVersion"} for c in (old, new))
    out = Compatibility(sorted(b.keys() - a.keys()), sorted(a.keys() - b.keys()), sorted(k for k in a.keys() & b.keys() if a[k] != b[k]))
    out.breaking = out.removed + out.changed
    return out


CROISSANT, SCHEMA = "http://mlcommons.org/croissant/", "https://schema.org/"
CROISSANT_TERMS = {"@vocab": SCHEMA, "sc": SCHEMA, "cr": CROISSANT}


def dataset_card(name: str, df: object = None, **meta: object) -> dict:
    """A schema.org dataset; with a DataFrame, its columns become fields of a record set."""
    kinds = {"string": "sc:Text", "bigint": "sc:Integer", "int": "sc:Integer", "double": "sc:Float", "float": "sc:Float", "boolean": "sc:Boolean", "date": "sc:Date", "timestamp": "sc:DateTime", "timestamp_ntz": "sc:DateTime"}
    card: dict = {"name": name, "@type": "Dataset", "@context": SCHEMA} | {k: v for k, v in meta.items() if v is not None}
    if df is not None:
        card["recordSet"] = [{"@type": "cr:RecordSet", "name": name, "field": [{"dataType": kinds.get(f.dataType.simpleString(), "sc:Text"), "name": f.name, "@type": "cr:Field"} for f in df.schema]}]
    return card


def add_distribution(card: dict, name: str, url: str, encoding: str, **more: object) -> dict:
    return card | {"distribution": [*card.get("distribution", []), {"@type": "cr:FileObject", "name": name, "contentUrl": url, "encodingFormat": encoding} | more]}


def add_file_set(card: dict, name: str, contained_in: str, encoding: str, includes: str) -> dict:
    return card | {"distribution": [*card.get("distribution", []), {"includes": includes, "encodingFormat": encoding, "containedIn": {"@id": contained_in}, "@type": "cr:FileSet", "name": name}]}


def to_croissant(card: dict) -> dict:
    return card | {"@context": CROISSANT_TERMS, "conformsTo": CROISSANT + "1.0"}


def from_croissant(card: dict) -> dict:
    return {k: v for k, v in card.items() if k != "conformsTo"} | {"@context": SCHEMA}


#: Term of an assertion's protection -> privacy vocabulary.
CATEGORY_TERMS = {"regular": "PersonalData", "sensitive": "SensitivePersonalData", "special_category": "SpecialCategoryPersonalData", "pseudonymized": "PseudonymisedData", "anonymized": "AnonymisedData", "synthetic": "SyntheticData", "non_personal": "NonPersonalData"}
BASIS_TERMS = {"consent": "Consent", "contract": "Contract", "legal_obligation": "LegalObligation", "vital_interest": "VitalInterest", "public_task": "PublicTask", "legitimate_interest": "LegitimateInterest"}


@dataclass(frozen=True)
class TermChange:
    """How one term of a context changed: added, removed, or one of what a definition says (type, container, or the term it stands for)."""

    term: str
    kind: str
    old: object = None
    new: object = None

    @property
    def breaking(self) -> bool:
        return self.kind != "added"


def context_changes(old: dict, new: dict) -> list[TermChange]:
    """Every change, by term. Of two definitions, what differs is told by its keyword: @type-changed, @container-changed, or changed."""
    a, b = ({k: v for k, v in c.items() if k != "@contextVersion"} for c in (old, new))
    out = [TermChange(t, "added", None, b[t]) for t in b.keys() - a.keys()] + [TermChange(t, "removed", a[t]) for t in a.keys() - b.keys()]
    for t in a.keys() & b.keys():
        if a[t] != b[t]:
            x, y = (v if isinstance(v, dict) else {"@id": v} for v in (a[t], b[t]))
            keys = [k for k in ("@type", "@container") if x.get(k) != y.get(k)]
            out.append(TermChange(t, f"{keys[0]}-changed" if keys else "changed", a[t], b[t]))
    return sorted(out, key=lambda c: (c.term, c.kind))


#: What a dataset card has to say: (property, required, kind).
CARD = {"name": (True, str), "description": (False, str), "url": (False, str), "license": (False, str), "creator": (False, object), "version": (False, object), "datePublished": (False, str)}


def validate_card(card: dict) -> list[tuple[str, str]]:
    """(path, constraint) of what is wrong with a dataset card; none for a valid one."""
    out = [] if card.get("@type") in ("Dataset", "sc:Dataset", SCHEMA + "Dataset") else [("@type", "type")]
    for k, (required, kind) in CARD.items():
        if k not in card or card[k] in (None, ""):
            out += [(k, "required")] * required
        elif not isinstance(card[k], kind):
            out.append((k, "datatype"))
    return out


def shape_verbosity(shape: dict) -> dict:
    """Bytes of a shape and of the same in shape statements, and what is saved in percent."""
    import json

    a, b = (len(json.dumps(x, separators=(",", ":")).encode()) for x in (shape, shape_to_shacl(shape)))
    return {"shape_bytes": a, "statement_bytes": b, "bytes_saved_pct": round(100 * (1 - a / b), 2)}
