"""Contexts, schemas and guides that a tool server hands out, as text."""

from __future__ import annotations

import json

from veridelta.sources.documents import META

PREFIX = "urn:veridelta:"


def annotation_context() -> str:
    """The terms of annotated values."""
    kinds = {"double": "xsd:double", "boolean": "xsd:boolean", "string": "xsd:string", "bigint": "xsd:integer", "long": "xsd:integer"}
    return json.dumps({"@context": {"xsd": "http://www.w3.org/2001/XMLSchema#"} | {k: {"@id": PREFIX + k, "@type": kinds.get(t, "xsd:string")} for k, t in META.items()}}, indent=1)


def security_context() -> str:
    return json.dumps({"@context": {"integrity": PREFIX + "integrity", "allowlist": {"@id": PREFIX + "allowlist", "@container": "@set"}, "maxContextDepth": PREFIX + "maxContextDepth", "maxGraphDepth": PREFIX + "maxGraphDepth"}}, indent=1)


def _unit(names: dict[str, str]) -> dict:
    return {k: {"type": "number", "minimum": 0, "maximum": 1, "description": v} for k, v in names.items()}


def opinion_schema() -> str:
    parts = {"belief": "evidence for", "disbelief": "evidence against", "uncertainty": "what evidence leaves open", "baseRate": "prior probability"}
    return json.dumps({"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "Opinion", "type": "object", "properties": _unit(parts), "required": list(parts)[:3], "description": "belief, disbelief and uncertainty sum to 1"}, indent=1)


def compliance_schema() -> str:
    parts = {"lawfulness": "evidence of compliance", "violation": "evidence of violation", "uncertainty": "what evidence leaves open", "baseRate": "prior probability"}
    return json.dumps({"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "ComplianceOpinion", "type": "object", "properties": _unit(parts), "required": list(parts)[:3], "description": "lawfulness, violation and uncertainty sum to 1"}, indent=1)


def compliance_context() -> str:
    names = ("lawfulness", "violation", "uncertainty", "baseRate", "legalBasis", "jurisdiction", "consentScope", "retentionUntil", "erasureRequested")
    return json.dumps({"@context": {n: PREFIX + n for n in names}}, indent=1)


def annotate_results_guide(tool: str, confidence: float) -> str:
    return f"Give every value that {tool} returned a confidence of its own (start from {confidence:g}), name {tool} as its source and the time of extraction, and leave out what could not be checked."


def trust_chain_guide(chain: list[str]) -> str:
    return f"Follow the claim along {' -> '.join(chain)}. For each step state an opinion on the sender, discount by it what was passed on, and report belief, disbelief, uncertainty and the projected probability at the end."


def compliance_guide(activity: str, jurisdictions: list[str]) -> str:
    return f"For {activity}, state an opinion on lawfulness in each of {', '.join(jurisdictions)}; take their meet, pass it along every processing step with trust and purpose, and apply expiry, review and changes of law by their dates."


def consent_guide(purpose: str) -> str:
    return f"For the consent to {purpose}: assess the six conditions of a valid consent and their meet, then its withdrawal, its expiry and the next review, each from the day it takes effect."


RESOURCES = {"annotation-context": annotation_context, "security-context": security_context, "opinion-schema": opinion_schema, "compliance-schema": compliance_schema, "compliance-context": compliance_context}
GUIDES = {"annotate-results": annotate_results_guide, "trust-chain": trust_chain_guide, "compliance": compliance_guide, "consent": consent_guide}
