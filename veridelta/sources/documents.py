"""Annotated JSON documents to and from the long table of assertions.

assertions: graph_id, src_ord, node_id, types, prop, value_idx, value_kind, value (text form), value_num, confidence, source, extracted_at, method, human_verified,
valid_from, valid_until, as_of, invalidated_at. One row per value of a property; src_ord and value_idx keep the document's order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keyword (without @) of every piece of metadata that a value can carry, and its type.
META = {
    "confidence": "double", "source": "string", "extractedAt": "string", "method": "string", "humanVerified": "boolean", "mediaType": "string", "contentUrl": "string", "contentHash": "string", "translatedFrom": "string", "translationModel": "string",
    "measurementUncertainty": "double", "unit": "string", "derivedFrom": "string", "aggregationMethod": "string", "aggregationWindow": "string", "aggregationCount": "long", "calibratedAt": "string", "calibrationMethod": "string", "calibrationAuthority": "string",
    "delegatedBy": "string", "invalidatedAt": "string", "invalidationReason": "string", "validFrom": "string", "validUntil": "string", "asOf": "string",
}
#: The 22 of them that are provenance of a value, in the order of the record.
PROVENANCE = tuple(META)[:22]
NAMES = {k: "".join("_" + c.lower() if c.isupper() else c for c in k) for k in META}


def annotate(value: Column, confidence: Column | None = None, **meta: Column) -> Column:
    """A struct of a value and the metadata that is given, by column name (extracted_at); a confidence out of [0, 1] is an error, and so is a name that is no metadata."""
    if odd := set(meta) - set(NAMES.values()):
        raise ValueError(f"no metadata: {sorted(odd)}")
    parts = [value.alias("value")]
    if confidence is not None:
        ok = confidence.isNull() | (confidence.between(0.0, 1.0) & ~F.isnan(confidence))
        parts.append(F.when(ok, confidence.cast("double")).otherwise(F.raise_error(F.lit("confidence must lie in [0, 1]")).cast("double")).alias("confidence"))
    return F.struct(*parts, *[c.alias(k) for k, c in meta.items()])


def to_document(annotated: Column, names: list[str]) -> Column:
    """JSON of an annotated struct with the given fields beside its value; what is null is left out."""
    back = {v: k for k, v in NAMES.items()}
    return F.to_json(F.struct(annotated["value"].alias("@value"), *[annotated[n].alias("@" + back[n]) for n in names]))


def _meta(v: Column, key: str, kind: str) -> Column:
    """Metadata under its keyword, its plain name, or an IRI that ends in it."""
    at = lambda p: F.try_variant_get(v, f'$["{p}"]', kind)
    text = lambda p: F.to_json(F.try_variant_get(v, f'$["{p}"]', "array<string>"))
    found = F.coalesce(at("@" + key), at(key), at("urn:veridelta:" + key))
    return F.coalesce(found, text("@" + key), text(key)) if kind == "string" else found


def provenance(document: Column) -> Column:
    """The record of 22 fields of an annotated value's JSON; null where they are absent, lists as JSON text."""
    v = F.try_parse_json(document)
    return F.struct(*[_meta(v, k, META[k]).alias(NAMES[k]) for k in PROVENANCE])


def _kind(v: Column) -> Column:
    s = F.lower(F.expr(f"schema_of_variant({v})")) if isinstance(v, str) else F.lower(F.call_function("schema_of_variant", v))
    return F.when(s == "void", "null").when(s == "string", "string").when(s == "boolean", "boolean").when(s.startswith("object"), "object").when(s.startswith("array"), "array").otherwise("number")


def assertions(docs: DataFrame, text: str = "json", graph_id: str | None = None, order: str | None = None) -> DataFrame:
    """The long table of JSON documents: a document is one node, or has its nodes under @graph. Text that isn't JSON gives no rows."""
    v = docs.select((F.col(graph_id) if graph_id else F.lit("")).cast("string").alias("graph_id"), (F.col(order) if order else F.lit(0)).cast("long").alias("src_ord"), F.try_parse_json(F.col(text)).alias("v"))
    nodes = v.select("graph_id", "src_ord", F.coalesce(F.try_variant_get("v", '$["@graph"]', "array<variant>"), F.array("v")).alias("ns")).select("graph_id", "src_ord", F.posexplode("ns").alias("node_ord", "n"))
    types = F.coalesce(F.try_variant_get("n", '$["@type"]', "array<string>"), F.array(F.try_variant_get("n", '$["@type"]', "string")))
    props = nodes.select("graph_id", "src_ord", "node_ord", F.try_variant_get("n", '$["@id"]', "string").alias("node_id"), F.filter(types, lambda x: x.isNotNull()).alias("types"), F.explode(F.try_variant_get("n", "$", "map<string,variant>")).alias("prop", "p"))
    values = props.where(~F.col("prop").startswith("@")).select("*", F.coalesce(F.try_variant_get("p", "$", "array<variant>"), F.array("p")).alias("ps"))
    rows = values.select("graph_id", "src_ord", "node_ord", "node_id", "types", "prop", F.posexplode("ps").alias("value_idx", "x"))
    bare = F.coalesce(F.try_variant_get("x", '$["@value"]', "variant"), F.col("x"))
    rows = rows.withColumn("bare", bare)
    return rows.select(
        "graph_id", "src_ord", "node_ord", "node_id", "types", "prop", "value_idx", _kind(F.col("bare")).alias("value_kind"),
        F.coalesce(F.try_variant_get("bare", "$", "string"), F.to_json("bare")).alias("value"), F.try_variant_get("bare", "$", "double").alias("value_num"),
        *[_meta(F.col("x"), k, t).alias(NAMES[k]) for k, t in META.items()],
    )


def to_documents(rows: DataFrame) -> DataFrame:
    """(node_id, json): a node document for each id of an assertions table, properties in order of name."""
    meta = F.struct(F.col("value").alias("@value"), *[F.col(NAMES.get(k, k)).alias(f"@{k}") for k in META])
    per = rows.groupBy("node_id", "prop").agg(F.sort_array(F.collect_list(F.struct("src_ord", "value_idx", meta.alias("v")))).alias("v"), F.first("types").alias("types"))
    body = F.concat(F.lit(chr(34)), F.col("prop"), F.lit(chr(34) + ":"), F.to_json(F.col("v.v")))
    return per.select("node_id", "types", "prop", body.alias("j")).groupBy("node_id").agg(F.max("types").alias("types"), F.sort_array(F.collect_list("j")).alias("js")).select("node_id", F.concat(F.lit('{"@id":"'), F.col("node_id"), F.lit('","@type":'), F.to_json("types"), F.lit(","), F.array_join("js", ","), F.lit("}")).alias("json"))


def filter_by_confidence(rows: DataFrame, criteria: dict[str, float], keep_invalidated: bool = True) -> DataFrame:
    """The assertions of nodes that have, for every named property, a value of at least that confidence."""
    out = rows
    for prop, least in criteria.items():
        hit = rows.where((F.col("prop") == prop) & (F.col("confidence") >= least)).select("node_id").distinct()
        out = out.join(hit, "node_id", "left_semi")
        if not keep_invalidated:
            gone = rows.where((F.col("prop") == prop) & F.col("invalidated_at").isNotNull()).select("node_id").distinct()
            out = out.join(gone, "node_id", "left_anti")
    return out


def from_ntriples(lines: DataFrame, text: str = "value") -> DataFrame:
    """(subject, predicate, object, annotation, annotation_value) of RDF-star N-Triples lines; annotation lines quote their triple."""
    s = F.trim(F.col(text))
    term = r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z-]+)?)'
    star = rf"^<<\s*{term}\s+(<[^>]*>)\s+{term}\s*>>\s+(<[^>]*>)\s+{term}\s*\.$"
    base = rf"^{term}\s+(<[^>]*>)\s+{term}\s*\.$"
    is_star = s.startswith("<<")
    pick = lambda i, j: F.when(is_star, F.regexp_extract(s, star, i)).otherwise(F.regexp_extract(s, base, j) if j else F.lit(None))
    ok = s.rlike(star) | (~is_star & s.rlike(base))
    return lines.where(ok).select(pick(1, 1).alias("subject"), pick(2, 2).alias("predicate"), pick(3, 3).alias("object"), pick(4, 0).alias("annotation"), pick(5, 0).alias("annotation_value"))
