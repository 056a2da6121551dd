"""Lineage closure, erasure scope and contamination; protection filters and the rights of data subjects.

Assertions carry the columns data_subject, category, legal_basis, controller, jurisdiction, retention_until and what the operators below add. Nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.functions import opinion as O
from veridelta.operators import fusion
from veridelta.operators.durable import cut

PERSONAL = ("regular", "sensitive", "special_category", "pseudonymized")
SENSITIVE = ("sensitive", "special_category")
CATEGORIES = (*PERSONAL, "anonymized", "synthetic", "non_personal")
LEGAL_BASES = ("consent", "contract", "legal_obligation", "vital_interest", "public_task", "legitimate_interest")
ACCESS_LEVELS = ("public", "internal", "restricted", "confidential", "secret")
GRANULARITIES = ("broad", "specific", "granular")


def closure(edges: DataFrame, start: DataFrame, parent: str = "parent", child: str = "child") -> DataFrame:
    """(start, node, depth): all that can be reached from start(node), itself at depth 0, each once at its least depth, however deep. Cycles end, as nothing is found twice. Every level is written once."""
    e = edges.select(F.col(parent).alias("node"), F.col(child).alias("next"))
    new = cut(start.select(F.col("node").alias("start"), F.col("node"), F.lit(0).alias("depth")).distinct())
    found, depth = new, 0
    while not new.isEmpty():
        depth += 1
        step = new.join(e, "node").select("start", F.col("next").alias("node")).distinct().join(found.select("start", "node"), ["start", "node"], "left_anti")
        new = cut(step.withColumn("depth", F.lit(depth)))
        found = found.unionByName(new)
        if depth % 32 == 0:  # a deep chain would else make a plan of as many parts
            found = cut(found)
    return found


def descendants(edges: DataFrame, start: DataFrame) -> DataFrame:
    return closure(edges, start).where("depth > 0")


def ancestors(edges: DataFrame, start: DataFrame) -> DataFrame:
    return closure(edges, start, "child", "parent").where("depth > 0")


def erasure_scope(edges: DataFrame, start: DataFrame, exempt: DataFrame | None = None) -> DataFrame:
    """(start, node): the source and all that derives from it, less exempt(node)."""
    scope = closure(edges, start).select("start", "node")
    return scope if exempt is None else scope.join(exempt.select("node"), "node", "left_anti")


def erasure_assessment(edges: DataFrame, start: DataFrame, opinions: DataFrame, exempt: DataFrame | None = None) -> DataFrame:
    """(start, opinion): the meet over the scope; nodes without an opinion are vacuous."""
    rows = erasure_scope(edges, start, exempt).join(opinions.select("node", "opinion"), "node", "left")
    return fusion.meet(rows.withColumn("opinion", F.coalesce("opinion", O.vacuous())), ["start"])


def contamination_risk(edges: DataFrame, start: DataFrame, opinions: DataFrame) -> DataFrame:
    """(start, opinion): residual contamination by the ancestors and the node itself."""
    rows = closure(edges, start, "child", "parent").join(opinions.select("node", "opinion"), "node", "left")
    return fusion.contamination(rows.withColumn("opinion", F.coalesce("opinion", O.vacuous())), ["start"])


def is_consent_active(given: Column, withdrawn: Column, at: Column | None = None) -> Column:
    """From being given until being withdrawn; without an instant: given and not withdrawn."""
    if at is None:
        return given.isNotNull() & withdrawn.isNull()
    return F.coalesce((given <= at) & (withdrawn.isNull() | (at < withdrawn)), F.lit(False))


def is_personal(category: Column) -> Column:
    return F.coalesce(category.isin(*PERSONAL), F.lit(False))


def is_sensitive(category: Column) -> Column:
    return F.coalesce(category.isin(*SENSITIVE), F.lit(False))


def filter_by_jurisdiction(rows: DataFrame, prop: str, jurisdiction: str) -> DataFrame:
    """The assertions of nodes that have a value of the property under the jurisdiction."""
    return rows.join(rows.where((F.col("prop") == prop) & (F.col("jurisdiction") == jurisdiction)).select("node_id").distinct(), "node_id", "left_semi")


def filter_personal(rows: DataFrame, prop: str | None = None) -> DataFrame:
    hit = is_personal(F.col("category")) if prop is None else is_personal(F.col("category")) & (F.col("prop") == prop)
    return rows.join(rows.where(hit).select("node_id").distinct(), "node_id", "left_semi")


def _mark(rows: DataFrame, subject: str, **new: Column) -> DataFrame:
    mine = F.coalesce(F.col("data_subject") == subject, F.lit(False))
    return rows.withColumns({k: F.when(mine, v).otherwise(F.col(k) if k in rows.columns else F.lit(None)) for k, v in new.items()})


def request_erasure(rows: DataFrame, subject: str, at: Column) -> DataFrame:
    return _mark(rows, subject, erasure_requested=F.lit(True), erasure_requested_at=at)


def execute_erasure(rows: DataFrame, subject: str, at: Column) -> DataFrame:
    """Values go where erasure was requested."""
    go = F.coalesce((F.col("data_subject") == subject) & F.col("erasure_requested"), F.lit(False))
    have = F.col("erasure_completed_at") if "erasure_completed_at" in rows.columns else F.lit(None)
    return rows.withColumns({"value": F.when(~go, F.col("value")), "erasure_completed_at": F.when(go, at).otherwise(have)})


def request_restriction(rows: DataFrame, subject: str, reason: str) -> DataFrame:
    return _mark(rows, subject, restricted=F.lit(True), restriction_reason=F.lit(reason))


def rectify(rows: DataFrame, where: Column, new_value: Column, note: str, at: Column) -> DataFrame:
    return rows.withColumns({"value": F.when(where, new_value).otherwise(F.col("value")), "rectification_note": F.when(where, F.lit(note)), "rectified_at": F.when(where, at)})


def export_portable(rows: DataFrame, subject: str) -> DataFrame:
    """(node_id, record): what a subject's nodes say, as JSON objects from property to values."""
    per = rows.where(F.col("data_subject") == subject).groupBy("node_id", "prop").agg(F.sort_array(F.collect_list(F.struct("src_ord", "value"))).alias("v"))
    return per.groupBy("node_id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("prop", F.col("v.value").alias("values")))))).alias("record"))


def access_report(rows: DataFrame, by: str = "data_subject") -> DataFrame:
    """For each subject: number of values and nodes, and the sets of categories, controllers, legal bases and jurisdictions, in order."""
    sets = {"category": "categories", "controller": "controllers", "legal_basis": "legal_bases", "jurisdiction": "jurisdictions"}
    return rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("total_property_count"), F.count_distinct("node_id").alias("nodes"), *[F.sort_array(F.collect_set(c)).alias(n) for c, n in sets.items()])


def retention_violations(rows: DataFrame, as_of: Column) -> DataFrame:
    """Values kept longer than allowed: the deadline is before the instant."""
    return rows.where(F.col("retention_until") < as_of).select("node_id", "prop", "retention_until")


def audit_trail(rows: DataFrame, subject: str) -> DataFrame:
    keep = [c for c in ("node_id", "prop", "data_subject", "value", "category", "legal_basis", "controller", "erasure_requested", "restricted") if c in rows.columns]
    return rows.where(F.col("data_subject") == subject).select(*keep)


# Builders of protection metadata and consent records.


def _one_of(c: Column, allowed: tuple[str, ...], what: str) -> Column:
    return F.when(c.isNull() | c.isin(*allowed), c).otherwise(F.raise_error(F.concat(F.lit(f"no {what}: "), c)).cast("string"))


def annotate_protection(value: Column, **meta: Column) -> Column:
    """A struct of a value and what is given of category, legal_basis, purpose, controller, processor, data_subject, retention_until, jurisdiction, access_level and consent. A category, legal
    basis or access level that is not in its list is an error, as is any other name."""
    checks = {"category": (CATEGORIES, "category"), "legal_basis": (LEGAL_BASES, "legal basis"), "access_level": (ACCESS_LEVELS, "access level")}
    known = {*checks, "purpose", "controller", "processor", "data_subject", "retention_until", "jurisdiction", "consent"}
    if odd := set(meta) - known:
        raise ValueError(f"no protection metadata: {sorted(odd)}")
    return F.struct(value.alias("value"), *[(_one_of(c, *checks[k]) if k in checks else c).alias(k) for k, c in meta.items()])


def consent_record(given_at: Column, scope: Column, granularity: Column | None = None, withdrawn_at: Column | None = None) -> Column:
    """A consent as a struct; scope is an array of purposes, of which there has to be one at least, and granularity one of three."""
    some = F.when(given_at.isNotNull() & (F.size(scope) > 0), scope).otherwise(F.raise_error(F.lit("a consent needs a time and a scope")).cast("array<string>"))
    parts = [given_at.alias("given_at"), some.alias("scope")]
    if granularity is not None:
        parts.append(_one_of(granularity, GRANULARITIES, "granularity").alias("granularity"))
    if withdrawn_at is not None:
        parts.append(withdrawn_at.alias("withdrawn_at"))
    return F.struct(*parts)


# Reports of subject rights: a row for each subject.


def erasure_plan(rows: DataFrame) -> DataFrame:
    """(data_subject, affected_node_ids, affected_property_count) of what would be erased."""
    return rows.where(F.col("data_subject").isNotNull()).groupBy("data_subject").agg(F.sort_array(F.collect_set("node_id")).alias("affected_node_ids"), F.count(F.lit(1)).alias("affected_property_count"))


def erasure_audit(rows: DataFrame) -> DataFrame:
    """(data_subject, erased_node_ids, erased_property_count) of what was erased."""
    return rows.where(F.col("erasure_completed_at").isNotNull()).groupBy("data_subject").agg(F.sort_array(F.collect_set("node_id")).alias("erased_node_ids"), F.count(F.lit(1)).alias("erased_property_count"))


def restriction_result(rows: DataFrame) -> DataFrame:
    """(data_subject, restricted_property_count)."""
    return rows.where("restricted").groupBy("data_subject").agg(F.count(F.lit(1)).alias("restricted_property_count"))


# Chains of processing steps, and reviews.


def provenance_chain(steps: DataFrame, by: list[str], source: str = "source", trust: str = "trust", purpose: str = "purpose", order: str = "ord") -> DataFrame:
    """(by..., opinion): the source's compliance (on the first step's row) passed on by every step, a meet with the step's trust and purpose; a row without trust and purpose is a chain without steps."""
    o = [F.col(trust), F.col(purpose)]
    part = lambda f: F.product(f(o[0]) * f(o[1]))
    real = steps.groupBy(*by).agg(
        F.min_by(F.col(source), F.col(order)).alias("_s"), F.coalesce(part(lambda x: x["b"]), F.lit(1.0)).alias("_b"), F.coalesce(part(lambda x: 1 - x["d"]), F.lit(1.0)).alias("_k"), F.coalesce(part(lambda x: x["a"]), F.lit(1.0)).alias("_a")
    )
    b, k = F.col("_s")["b"] * F.col("_b"), (1 - F.col("_s")["d"]) * F.col("_k")
    return real.select(*by, O.opinion(b, 1 - k, F.greatest(F.lit(0.0), k - b), F.col("_s")["a"] * F.col("_a")).alias("opinion"))


HALF_LIFE_DAYS, ACCELERATION = 365.0, 4.0


def review_due(df: DataFrame, schedule: DataFrame, at: Column, opinion: str = "opinion") -> DataFrame:
    """df(assessment_id, opinion) with opinions aged from their review's due date on. schedule(assessment_id, due[, half_life, accelerated]): an overdue opinion ages with the accelerated
    half-life, by default a quarter of the half-life (365 days); without a schedule it stays."""
    have = lambda c: F.col(c) if c in schedule.columns else F.lit(None).cast("double")
    h = F.coalesce(have("accelerated"), F.coalesce(have("half_life"), F.lit(HALF_LIFE_DAYS)) / ACCELERATION)
    s = schedule.select("assessment_id", F.col("due").alias("_due"), h.alias("_h"))
    days = (F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("_due").cast("timestamp"))) / 86_400_000_000
    o = F.col(opinion)
    aged = F.when(days >= 0, O.decay(o, F.greatest(days, F.lit(0.0)), F.col("_h"))).otherwise(o)
    return df.join(s, "assessment_id", "left").withColumn(opinion, aged).drop("_due", "_h")
