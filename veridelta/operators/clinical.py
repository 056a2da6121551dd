"""Uncertainty of clinical records: status codes to opinions, alerts, escalation and reconciliation.

A record type is data, not code: which field carries the status, and a table from code to (probability, uncertainty multiplier).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.functions import opinion as O
from veridelta.operators.fusion import averaging_fuse, cumulative_fuse, extremes

DEFAULT_UNCERTAINTY = 0.15


def scalar_to_opinion(p: Column, status_multiplier: Column | float = 1.0, basis_count: Column | None = None, method: Column | None = None, default_uncertainty: float = DEFAULT_UNCERTAINTY, a: Column | float | None = None) -> Column:
    """A probability as an opinion whose uncertainty falls with evidence: no basis 1.5 times, one or two 0.9, more 0.7; a stated method 0.8. The base rate is p unless another is given."""
    u = F.lit(default_uncertainty) * O.num(status_multiplier)
    if basis_count is not None:
        u = u * F.when(basis_count.isNull(), 1.0).when(basis_count == 0, 1.5).when(basis_count <= 2, 0.9).otherwise(0.7)
    if method is not None:
        u = u * F.when(method.isNotNull(), 0.8).otherwise(1.0)
    return O.from_confidence(p, F.least(F.greatest(u, F.lit(0.0)), F.lit(0.99)), p if a is None else a)


def coded(status: Column, table: dict[str, tuple[float, float]], otherwise: tuple[float, float] = (0.5, 0.3), factor: Column | float = 1.0) -> Column:
    """A code's opinion by table of (probability, uncertainty), uncertainty times a factor."""
    m = F.create_map(*[F.lit(x) for k, (p, u) in table.items() for x in (k, f"{p},{u}")])[status]
    parts = F.split(F.coalesce(m, F.lit(f"{otherwise[0]},{otherwise[1]}")), ",")
    p = parts[0].cast("double")
    return O.from_confidence(p, F.least(F.lit(0.99), parts[1].cast("double") * O.num(factor)), p)


def counted(n: Column, none: float = 1.3, few: float = 0.9, many: float = 0.7) -> Column:
    """Uncertainty factor of a number of pieces of evidence: none, one or two, more."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, none).when(n <= 2, few).otherwise(many)


def alert(o: Column, threshold: float = 0.5, ceiling: float | None = None) -> Column:
    """keep or suppress: without an opinion, or too uncertain to tell, an alert is kept."""
    keep = o.isNull() | (O.projected(o) >= threshold)
    return F.when(keep | (o["u"] >= ceiling) if ceiling is not None else keep, "keep").otherwise("suppress")


def escalation(df: DataFrame, by: list[str], key: str, opinion: str = "opinion", threshold: float = 0.7, conflict: float = 0.3) -> DataFrame:
    """df with action: escalate where a pair of the group conflicts, reject or accept where d or b is high, else human_review."""
    o = F.col(opinion)
    known = df.where(o.isNotNull())
    clashes = F.exists("outer", lambda x: (x["k"] != F.col(key)) & (o["b"] * x["d"] + o["d"] * x["b"] >= conflict))
    clash = known.join(extremes(known, by, key, opinion).where(F.col("worst") >= conflict), by).where(clashes).select(*by, key).distinct().withColumn("_c", F.lit(True))
    action = F.when(o.isNull(), "human_review").when(F.coalesce("_c", F.lit(False)), "escalate").when(o["d"] >= threshold, "reject").when(o["b"] >= threshold, "accept").otherwise("human_review")
    return df.join(clash, [*by, key], "left").withColumn("action", action).select(*df.columns, "action")


def reconcile(lists: DataFrame, field: str = "opinion", order: str = "ord") -> DataFrame:
    """One row per substance of lists(system, code, text, opinion, ord): rows match by system and code, or else by trimmed lower-case text; rows with neither stay apart."""
    key = F.when(F.col("system").isNotNull() & F.col("code").isNotNull(), F.concat_ws("|", "system", "code")).when(F.col("text").isNotNull(), F.lower(F.trim("text"))).otherwise(F.concat(F.lit("row:"), F.col(order).cast("string")))
    rows = lists.withColumn("key", key)
    fused = cumulative_fuse(rows, ["key"], field, order)
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("entries"), F.min_by("text", order).alias("text")).join(fused, "key", "left")


def bundle_fuse(rows: DataFrame, method: str = "cumulative", order: str = "ord") -> DataFrame:
    """One opinion for each (type, id) of several bundles."""
    return cumulative_fuse(rows, ["type", "id"], "opinion", order) if method == "cumulative" else averaging_fuse(rows, ["type", "id"])


def consent_meet(*opinions: Column) -> Column:
    return reduce(O.meet, opinions)


def decayed(o: Column, recorded: list[Column], at: Column, half_life_days: float = 365.0) -> Column:
    """The opinion aged by days since the first of the given times that is known; of the future or never recorded it stays."""
    t = F.coalesce(*[c.cast("timestamp") for c in recorded])
    days = (F.unix_micros(at.cast("timestamp")) - F.unix_micros(t)) / 86_400_000_000
    return F.when(days >= 0, O.decay(o, F.greatest(days, F.lit(0.0)), half_life_days)).otherwise(o)


def clinical_fuse(df: DataFrame, by: list[str], method: str = "cumulative", order: str = "ord") -> DataFrame:
    """One opinion for each group from the first opinion of each document (by order); documents without are left out."""
    first = df.where(F.col("opinion").isNotNull()).groupBy(*by, "doc").agg(F.min_by("opinion", order).alias("opinion"), F.min(order).alias("_o"))
    return cumulative_fuse(first, by, "opinion", "_o") if method == "cumulative" else averaging_fuse(first, by)


def trust_chain(opinions: Column, trusts: Column) -> Column:
    """opinions[0] discounted by each trust in turn; there has to be one trust less than opinions."""
    ok = F.when(F.size(trusts) == F.size(opinions) - 1, trusts).otherwise(F.raise_error(F.lit("one trust level is needed between each two of the chain")).cast(f"array<{O.SCHEMA}>"))
    return F.aggregate(ok, opinions[0].cast(O.SCHEMA), lambda x, t: O.trust_discount(t, x).cast(O.SCHEMA))


def consent_opinion(status: Column, denied: Column, verified: Column, unverified: Column) -> Column:
    """A consent's opinion: denial lowers the probability, each verification lowers the uncertainty to a floor, unverified entries raise it."""
    codes = {"active": (0.9, 0.15), "draft": (0.5, 0.4), "inactive": (0.3, 0.25), "proposed": (0.5, 0.35), "rejected": (0.05, 0.1), "entered-in-error": (0.5, 0.45)}

    def rated(x: Column) -> Column:
        of = lambda i: F.coalesce(F.create_map(*[F.lit(c) for k, v in codes.items() for c in (k, v[i])])[x["status"]], F.lit((0.5, 0.35)[i]))
        p = of(0) * F.when(x["denied"], 0.7).otherwise(1.0)
        u = of(1) * F.when(x["verified"] > 0, F.greatest(F.lit(0.3), F.pow(F.lit(0.75), x["verified"]))).when(x["unverified"] > 0, 1.05).otherwise(1.0)
        return O.let(F.struct(p.alias("p"), F.least(F.lit(0.99), u).alias("u")), lambda m: O.from_confidence(m["p"], m["u"], m["p"]))

    return O.let(F.struct(status.alias("status"), denied.alias("denied"), verified.alias("verified"), unverified.alias("unverified")), rated)


def consent_status(o: Column) -> Column:
    """The status that an opinion amounts to."""
    return F.when(o["u"] >= 0.5, "draft").when((o["d"] > o["b"]) & (o["d"] > o["u"]), "rejected").when(o["b"] > o["d"], "active").otherwise("draft")


# Consent records (JSON): validity, and what happens to them.


def _parsed(record: Column, f: Callable[[Column], Column]) -> Column:
    """f of the record as a variant, parsed once."""
    return O.let(F.try_parse_json(record), f)


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, "$." + path, kind)


def _verified(v: Column) -> Column:
    """A struct: n, how many verifications hold, and listed, whether the record lists any at all."""
    count = lambda every: F.size(F.filter(every, lambda x: F.coalesce(F.try_variant_get(x, "$.verified", "boolean"), F.lit(False))))
    return O.let(_get(v, "verification", "array<variant>"), lambda every: F.struct(F.coalesce(F.when(every.isNotNull(), count(every)), F.lit(0)).alias("n"), every.isNotNull().alias("listed")))


CONSENT_CODES = {"active": 0.9, "inactive": 0.3, "draft": 0.5, "proposed": 0.5, "rejected": 0.05, "entered-in-error": 0.5}


def _opinion(v: Column) -> Column:
    denied = F.coalesce(_get(v, "provision.type") == "deny", F.lit(False))
    return O.let(_verified(v), lambda x: consent_opinion(F.coalesce(_get(v, "status"), F.lit("draft")), denied, x["n"], F.when(x["listed"] & (x["n"] == 0), 1).otherwise(0)))


def record_opinion(record: Column) -> Column:
    """The opinion of a consent record, by its status, verifications and denial."""
    return _parsed(record, _opinion)


def record_validity(record: Column) -> Column:
    """Whether a consent was freely given, specific, informed, unambiguous, demonstrable and distinguishable, as far as the record tells: the meet of six opinions."""

    def rated(v: Column, n: Column) -> Column:
        some = lambda path: F.coalesce(F.size(_get(v, path, "array<variant>")), F.lit(0))
        status = F.coalesce(_get(v, "status"), F.lit("draft"))
        free = F.coalesce(F.create_map(*[F.lit(x) for kv in CONSENT_CODES.items() for x in kv])[status], F.lit(0.5))
        coded = F.exists(_get(v, "category", "array<variant>"), lambda c: F.exists(F.try_variant_get(c, "$.coding", "array<variant>"), lambda x: (F.coalesce(F.try_variant_get(x, "$.system", "string"), F.lit("")) != "") & (F.coalesce(F.try_variant_get(x, "$.code", "string"), F.lit("")) != "")))
        informed = F.lit(0.65) + F.when(some("provision.data") > 0, 0.1).otherwise(0.0) + F.when(some("category") > 1, 0.05).otherwise(0.0)
        p = [free, F.when(some("provision.purpose") > 0, 0.75).otherwise(0.6), informed, F.when(_get(v, "provision.type").isin("permit", "deny"), 0.8).otherwise(0.6), F.when(n >= 2, 0.9).when(n == 1, 0.8).otherwise(0.5), F.when(F.coalesce(coded, F.lit(False)), 0.75).otherwise(0.55)]
        u = [F.lit(0.25)] * 4 + [F.when(n >= 2, 0.1).when(n == 1, 0.15).otherwise(0.35), F.lit(0.25)]
        every = F.struct(*[x.alias(f"p{i}") for i, x in enumerate(p)], *[x.alias(f"u{i}") for i, x in enumerate(u)])
        made = lambda m: F.struct(*[O.from_confidence(m[f"p{i}"], m[f"u{i}"], m[f"p{i}"]).alias(f"o{i}") for i in range(6)])
        return O.let(O.let(every, made), lambda m: O.consent_validity(*[m[f"o{i}"] for i in range(6)]))

    return _parsed(record, lambda v: O.let(_verified(v)["n"], lambda n: rated(v, n)))


def _day(c: Column, what: str) -> Column:
    """Days count, not hours; a time that is missing is an error."""
    d = F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    return O.let(d, lambda d: F.when(d.isNull(), F.raise_error(F.lit(f"no date: {what}")).cast("date")).otherwise(d))


def _dated(v: Column, what: str) -> Column:
    """The record's opinion; an error without a dateTime."""
    return F.when(_get(v, "dateTime").isNull(), F.raise_error(F.lit(f"no date: {what}")).cast(O.SCHEMA)).otherwise(_opinion(v))


def record_withdrawal(active: Column, withdrawn: Column, at: Column) -> Column:
    """The active consent's opinion until the day of the withdrawn record, that record's from then on; both need a dateTime."""
    return _parsed(active, lambda v: _parsed(withdrawn, lambda w: O.withdrawal(_dated(v, "active"), _opinion(w), _day(at, "at"), _day(_get(w, "dateTime"), "withdrawn"))))


def record_expiry(record: Column, at: Column, residual: float = 0.0) -> Column:
    """A consent's opinion after the end of its provision's period is disbelief but for the residual part; without an end it stays."""

    def aged(v: Column) -> Column:
        end = F.try_to_timestamp(F.substring(_get(v, "provision.period.end"), 1, 10), F.lit("yyyy-MM-dd")).cast("date")
        x = F.struct(end.alias("end"), _opinion(v).alias("o"))
        return O.let(x, lambda x: F.when(x["end"].isNull(), x["o"]).otherwise(O.expiry(x["o"], _day(at, "at"), x["end"], residual)))

    return _parsed(record, aged)


def record_regulatory_change(old: Column, new: Column, at: Column) -> Column:
    """The old consent's opinion until the day of the new record, that record's from then on."""
    return _parsed(old, lambda v: _parsed(new, lambda w: O.regulatory_change(_dated(v, "old"), _day(at, "at"), _day(_get(w, "dateTime"), "new"), _opinion(w))))


def consent_record(o: Column, patient: Column | None = None, scope: str = "patient-privacy", policy: str | None = None, record_id: Column | None = None, date_time: Column | None = None) -> Column:
    """A consent record (JSON) of the status that an opinion amounts to, with the opinion in its extension."""
    from veridelta.sources.clinical_records import to_extension

    coded_ = lambda code, system=None: F.struct(F.array(F.struct(*([F.lit(system).alias("system")] if system else []), F.lit(code).alias("code"))).alias("coding"))
    parts = [F.lit("Consent").alias("resourceType"), consent_status(o).alias("status"), coded_(scope, "http://terminology.hl7.org/CodeSystem/consentscope").alias("scope"), F.array(coded_("59284-0", "http://loinc.org")).alias("category")]
    if record_id is not None:
        parts.append(record_id.alias("id"))
    if date_time is not None:
        parts.append(date_time.alias("dateTime"))
    if patient is not None:
        parts.append(F.struct(patient.alias("reference")).alias("patient"))
    if policy is not None:
        parts.append(coded_(policy).alias("policyRule"))
    body = F.to_json(F.struct(*parts))
    return F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(',"extension":['), to_extension(o), F.lit("]}"))


# Reports: one row for what an operator did.


def bundle_report(bundles: DataFrame, text: str = "json", order: str | None = None) -> DataFrame:
    """(ord, bundle_id, bundle_type, total_entries, annotated, skipped, warnings) of each bundle; entries of a type that is not known are skipped."""
    from veridelta.sources.clinical_records import SPEC

    v = bundles.select((F.col(order) if order else F.lit(0)).alias("ord"), F.try_parse_json(F.col(text)).alias("v"))
    kinds = F.transform(F.coalesce(F.try_variant_get("v", "$.entry", "array<variant>"), F.array().cast("array<variant>")), lambda e: F.try_variant_get(e, "$.resource.resourceType", "string"))
    rows = v.select("ord", F.try_variant_get("v", "$.id", "string").alias("bundle_id"), F.try_variant_get("v", "$.type", "string").alias("bundle_type"), kinds.alias("kinds"))
    known = F.filter("kinds", lambda k: F.coalesce(k.isin(*SPEC), F.lit(False)))
    odd = F.filter("kinds", lambda k: ~F.coalesce(k.isin(*SPEC), F.lit(False)))
    return rows.select("ord", "bundle_id", "bundle_type", F.size("kinds").alias("total_entries"), F.size(known).alias("annotated"), F.size(odd).alias("skipped"), F.transform(odd, lambda k: F.concat(F.lit("unsupported type "), F.coalesce(k, F.lit("none")))).alias("warnings"))


def alert_report(df: DataFrame, opinion: str = "opinion", threshold: float = 0.5, ceiling: float | None = None) -> DataFrame:
    """One row: total_input, kept_count, suppressed_count, and the mean projected probability of what was kept and of what was not."""
    o = F.col(opinion)
    rows = df.select(alert(o, threshold, ceiling).alias("what"), O.projected(o).alias("p"))
    keep = F.col("what") == "keep"
    return rows.agg(F.count(F.lit(1)).alias("total_input"), F.count_if(keep).alias("kept_count"), F.count_if(~keep).alias("suppressed_count"), F.avg(F.when(keep, F.col("p"))).alias("kept_projected"), F.avg(F.when(~keep, F.col("p"))).alias("suppressed_projected"))


def trust_chain_report(opinions: Column, trusts: Column) -> Column:
    """A struct (chain_length, per_hop_opinions, per_hop_projected): the first opinion as each party along the chain sees it."""
    hops = F.transform(F.sequence(F.lit(0), F.size(trusts)), lambda i: F.aggregate(F.slice(trusts, F.lit(1), i), opinions[0].cast(O.SCHEMA), lambda x, t: O.trust_discount(t, x).cast(O.SCHEMA)))
    return F.struct(F.size(opinions).alias("chain_length"), hops.alias("per_hop_opinions"), F.transform(hops, O.projected).alias("per_hop_projected"))


def reconciliation_report(lists: DataFrame, source: str, field: str = "opinion", order: str = "ord", threshold: float = 0.3) -> DataFrame:
    """One row: input_list_count, total_input_entries, matched_groups, unique_entries, conflicts (groups in which a pair conflicts) and output_count of reconcile."""
    key = F.when(F.col("system").isNotNull() & F.col("code").isNotNull(), F.concat_ws("|", "system", "code")).when(F.col("text").isNotNull(), F.lower(F.trim("text"))).otherwise(F.concat(F.lit("row:"), F.col(order).cast("string")))
    rows = lists.withColumn("_key", key)
    pairs = extremes(rows, ["_key"], order, field).select("_key", F.col("worst").alias("_m"))
    groups = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).join(pairs, "_key", "left")
    totals = rows.agg(F.count_distinct(source).alias("input_list_count"), F.count(F.lit(1)).alias("total_input_entries"))
    return totals.join(groups.agg(F.count_if(F.col("_n") > 1).alias("matched_groups"), F.count_if(F.col("_n") == 1).alias("unique_entries"), F.count_if(F.col("_m") >= threshold).alias("conflicts"), F.count(F.lit(1)).alias("output_count")), F.lit(True))
