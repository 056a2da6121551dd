"""RDF-star, provenance and sensor exports of assertions, one row per line or statement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.functions.opinion import let

W3 = "http://www.w3.org/"
RDF_TYPE = W3 + "1999/02/22-rdf-syntax-ns#type"
SOSA = W3 + "ns/sosa/"
XSD = W3 + "2001/XMLSchema#"
PROV = W3 + "ns/prov#"


def escaped(text: Column) -> Column:
    out = text
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def iri(c: Column) -> Column:
    return F.concat(F.lit("<"), c, F.lit(">"))


def literal(value: Column, kind: Column) -> Column:
    quoted = F.concat(F.lit('"'), escaped(value), F.lit('"'))
    typed = lambda t: F.concat(quoted, F.lit(f"^^<{XSD}{t}>"))
    return F.when(kind == "iri", iri(value)).when(kind == "double", typed("double")).when(kind == "integer", typed("integer")).when(kind == "boolean", typed("boolean")).otherwise(quoted)


def to_ntriples(rows: DataFrame, ns: str, meta: dict[str, str]) -> DataFrame:
    """(line): a triple for each assertion, and a quoted one for each piece of metadata it has. meta: column to kind of literal."""
    base = F.concat_ws(" ", iri(F.col("node_id")), iri(F.col("prop")), literal(F.col("value"), F.col("value_kind")))
    lines = [F.concat(base, F.lit(" ."))]
    for c, kind in meta.items():
        lines.append(F.when(F.col(c).isNotNull(), F.concat(F.lit("<< "), base, F.lit(f" >> <{ns}{c}> "), literal(F.col(c).cast("string"), F.lit(kind)), F.lit(" ."))))
    return rows.select(F.explode(F.filter(F.array(*lines), lambda x: x.isNotNull())).alias("line"))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows in spark.sql.shuffle.partitions parts, for rows that are small against what is made of them: a file of a few MB is read by one task, which would hold all of it to tell repetitions."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _statements(rows: DataFrame, parts: list[tuple[Column, str, Column]]) -> DataFrame:
    made = [F.when(s.isNotNull() & o.isNotNull(), F.struct(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"))) for s, p, o in parts]
    return spread(rows, "node_id", "prop", "value").select(F.inline(F.filter(F.array(*made), lambda x: x.isNotNull())))


def blank(kind: str, *parts: Column) -> Column:
    """A node name that depends on nothing but its parts."""
    return F.concat(F.lit(f"_:{kind}"), F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16))


def to_prov(rows: DataFrame) -> DataFrame:
    """(subject, predicate, object): each assertion an entity, its source an agent, its method an activity."""
    key = [F.col(c) for c in ("node_id", "prop", "value")]
    entity, activity = blank("e", *key), F.when(F.col("method").isNotNull(), blank("a", *key, F.col("method")))
    agent = F.when(F.col("source").isNotNull(), F.col("source"))
    return _statements(rows, [
        (F.col("node_id"), "prop", entity), (entity, RDF_TYPE, F.lit(PROV + "Entity")), (entity, PROV + "value", F.col("value")), (entity, PROV + "wasAttributedTo", agent), (agent, RDF_TYPE, F.lit(PROV + "SoftwareAgent")),
        (entity, PROV + "generatedAtTime", F.col("extracted_at")), (entity, PROV + "wasGeneratedBy", activity), (activity, RDF_TYPE, F.lit(PROV + "Activity")), (activity, "method", F.col("method")), (entity, "confidence", F.col("confidence").cast("string")),
    ]).distinct()


def from_prov(statements: DataFrame) -> DataFrame:
    """(node_id, value, confidence, source, extracted_at, method) of entities: the inverse of to_prov."""
    s = statements
    pick = lambda p, n: s.where(F.col("predicate") == p).select(F.col("subject").alias("entity"), F.col("object").alias(n))
    wide = s.where(F.col("predicate") == "prop").select(F.col("object").alias("entity"), F.col("subject").alias("node_id"))
    parts = [pick(PROV + "value", "value"), pick("confidence", "confidence"), pick(PROV + "wasAttributedTo", "source"), pick(PROV + "generatedAtTime", "extracted_at")]
    out = reduce(lambda x, y: x.join(y, "entity", "left"), parts, wide)
    made = pick(PROV + "wasGeneratedBy", "activity").join(s.where(F.col("predicate") == "method").select(F.col("subject").alias("activity"), F.col("object").alias("method")), "activity").drop("activity")
    return out.join(made, "entity", "left").select("node_id", "value", F.col("confidence").cast("double").alias("confidence"), "source", "extracted_at", "method")


def to_sosa(rows: DataFrame) -> DataFrame:
    """(subject, predicate, object): each assertion an observation, its source a sensor, stated once."""
    o, r = blank("o", F.col("node_id"), F.col("prop"), F.col("value"), F.col("extracted_at")), blank("r", F.col("node_id"), F.col("prop"), F.col("value"), F.col("extracted_at"))
    return _statements(rows, [
        (o, RDF_TYPE, F.lit(SOSA + "Observation")), (o, SOSA + "hasFeatureOfInterest", F.col("node_id")), (o, SOSA + "observedProperty", F.col("prop")), (o, SOSA + "hasResult", r), (r, RDF_TYPE, F.lit(SOSA + "Result")), (r, "value", F.col("value")),
        (o, SOSA + "madeBySensor", F.col("source")), (F.col("source"), RDF_TYPE, F.lit(SOSA + "Sensor")), (o, SOSA + "resultTime", F.col("extracted_at")), (o, SOSA + "usedProcedure", F.col("method")),
    ]).distinct()


def to_dpv(rows: DataFrame) -> DataFrame:
    """(subject, predicate, object): a handling of personal data for each protected assertion (those with a category)."""
    from veridelta.sources.schemas import BASIS_TERMS, CATEGORY_TERMS, DPV

    term = lambda c, terms: F.create_map(*[F.lit(x) for k, v in terms.items() for x in (k, DPV + v)])[F.col(c)]
    h = F.when(F.col("category").isNotNull(), blank("h", F.col("node_id"), F.col("prop"), F.col("value")))
    return _statements(rows, [
        (h, RDF_TYPE, F.lit(DPV + "PersonalDataHandling")), (h, DPV + "hasPersonalData", term("category", CATEGORY_TERMS)), (h, DPV + "hasLegalBasis", term("legal_basis", BASIS_TERMS)), (h, DPV + "hasDataController", F.col("controller")),
        (h, DPV + "hasDataSubject", F.col("data_subject").cast("string")), (h, DPV + "hasJurisdiction", F.col("jurisdiction")), (h, DPV + "hasStorageCondition", F.col("retention_until").cast("string")),
    ]).distinct()


def from_dpv(statements: DataFrame) -> DataFrame:
    """(handling, category, legal_basis, controller, data_subject, jurisdiction): the inverse of to_dpv."""
    from veridelta.sources.schemas import BASIS_TERMS, CATEGORY_TERMS, DPV

    back = lambda c, terms: F.create_map(*[F.lit(x) for k, v in terms.items() for x in (DPV + v, k)])[c]
    pick = lambda p: F.max(F.when(F.col("predicate") == DPV + p, F.col("object")))
    return statements.groupBy(F.col("subject").alias("handling")).agg(back(pick("hasPersonalData"), CATEGORY_TERMS).alias("category"), back(pick("hasLegalBasis"), BASIS_TERMS).alias("legal_basis"), pick("hasDataController").alias("controller"), pick("hasDataSubject").alias("data_subject"), pick("hasJurisdiction").alias("jurisdiction"))


def from_sosa(statements: DataFrame) -> DataFrame:
    """(node_id, prop, value, source, extracted_at, method) of observations: the inverse of to_sosa."""
    pick = lambda p: F.max(F.when(F.col("predicate") == SOSA + p, F.col("object")))
    o = statements.groupBy("subject").agg(pick("hasFeatureOfInterest").alias("node_id"), pick("observedProperty").alias("prop"), pick("hasResult").alias("r"), pick("madeBySensor").alias("source"), pick("resultTime").alias("extracted_at"), pick("usedProcedure").alias("method")).where("node_id IS NOT NULL")
    r = statements.where("predicate = 'value'").select(F.col("subject").alias("r"), F.col("object").alias("value"))
    return o.join(r, "r").select("node_id", "prop", "value", "source", "extracted_at", "method")


def to_turtle(rows: DataFrame, ns: str, meta: dict[str, str], prefixes: dict[str, str]) -> DataFrame:
    """(ord, line): Turtle-star lines, the prefixes first; an IRI under a prefix is shortened where the rest is a plain name."""
    def short(line: Column) -> Column:
        for p, base in prefixes.items():
            line = F.regexp_replace(line, "<" + base.replace(".", r"\.") + "([A-Za-z_][A-Za-z0-9_-]*)>", p + ":$1")
        return line

    spark = rows.sparkSession
    head = spark.createDataFrame([(0, f"@prefix {p}: <{b}> .") for p, b in prefixes.items()], "ord int, line string")
    return head.unionByName(to_ntriples(rows, ns, meta).select(F.lit(1).alias("ord"), short(F.col("line")).alias("line")))


def verbosity(rows: DataFrame, statements: DataFrame, text: str = "json") -> DataFrame:
    """One row: documents' bytes and assertions against statements' bytes and number, and what is saved in percent. rows(json): the documents."""
    a = rows.agg(F.sum(F.octet_length(text)).alias("document_bytes"), F.count(F.lit(1)).alias("documents"))
    size = F.octet_length("subject") + F.octet_length("predicate") + F.octet_length("object") + 8
    b = statements.agg(F.sum(size).alias("statement_bytes"), F.count(F.lit(1)).alias("statements"))
    return a.crossJoin(b).withColumn("bytes_saved_pct", F.round(100 * (1 - F.col("document_bytes") / F.col("statement_bytes")), 2))


def conversion_report(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """One row: success, nodes_converted, triples_input (values), triples_output (statements) and compression_ratio, out by in."""
    a = spread(rows.select("node_id"), "node_id").agg(F.count_distinct("node_id").alias("nodes_converted"), F.count(F.lit(1)).alias("triples_input"))
    b = statements.agg(F.count(F.lit(1)).alias("triples_output"))
    return a.join(b, F.lit(True)).select(F.lit(True).alias("success"), "nodes_converted", "triples_input", "triples_output", (F.col("triples_output") / F.nullif(F.col("triples_input"), F.lit(0))).alias("compression_ratio"))


def record_provenance(documents: DataFrame, document: str = "document") -> DataFrame:
    """(subject, predicate, object) of provenance documents (see clinical_records.to_documents): targets are entities that the activity made, agents by the type their reference names, and
    entities by their role."""
    prov, rdf = "http://www.w3.org/ns/prov#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    kinds = "id string, recorded string, targets array<struct<reference:string>>, agents array<struct<type:string,who:string,onBehalfOf:string>>, entities array<struct<role:string,what:string>>"
    d = documents.select(F.from_json(document, kinds).alias("d")).select("d.*").select("*", F.concat(F.lit("urn:activity:"), "id").alias("act"))
    st = lambda s, p, o: F.struct(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"))
    act = F.col("act")
    own = F.array(st(act, rdf, F.lit(prov + "Activity")), F.when(F.col("recorded").isNotNull(), st(act, prov + "endedAtTime", F.col("recorded"))))
    target = lambda t: F.array(st(t, rdf, F.lit(prov + "Entity")), st(t, prov + "wasGeneratedBy", act))

    def agent(a: Column) -> Column:
        def made(kind: Column) -> Column:
            cls = F.when(kind.isin("Practitioner", "PractitionerRole", "Patient", "RelatedPerson"), prov + "Person").when(kind == "Organization", prov + "Organization").when(kind == "Device", prov + "SoftwareAgent").otherwise(prov + "Agent")
            return F.array(st(a["who"], rdf, cls), st(act, prov + "wasAssociatedWith", a["who"]), F.when(a["onBehalfOf"].isNotNull(), st(a["who"], prov + "actedOnBehalfOf", a["onBehalfOf"])))

        return let(F.split_part(a["who"], F.lit("/"), F.lit(1)), made)

    role = F.create_map(*[F.lit(x) for k, v in {"source": "hadPrimarySource", "derivation": "wasDerivedFrom", "revision": "wasRevisionOf", "quotation": "wasQuotedFrom", "removal": "wasInvalidatedBy"}.items() for x in (k, prov + v)])
    entity = lambda e: F.array(st(e["what"], rdf, F.lit(prov + "Entity")), F.struct(act.alias("subject"), F.coalesce(role[e["role"]], F.lit(prov + "used")).alias("predicate"), e["what"].alias("object")))
    each = lambda xs, f: F.coalesce(F.flatten(F.transform(xs, f)), F.array().cast("array<struct<subject:string,predicate:string,object:string>>"))
    agents, entities = F.filter("agents", lambda a: a["who"].isNotNull()), F.filter("entities", lambda e: e["what"].isNotNull())
    # one pass: a branch for each kind of statement would read, parse and convert every document again
    rows = d.select(F.explode(F.concat(own, each(F.col("targets.reference"), target), each(agents, agent), each(entities, entity))).alias("x"))
    return rows.where("x IS NOT NULL").select("x.*").distinct()
