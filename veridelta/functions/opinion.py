"""Opinions: structs of belief b, disbelief d, uncertainty u and base rate a, all double, b + d + u = 1."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "struct<b:double,d:double,u:double,a:double>"
TOLERANCE = 1e-9


def num(x: Column | float) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, evaluated once: Spark evaluates an expression as often as it is written, in branches and lambdas at least."""
    return F.transform(F.array(x), f)[0]


def opinion(b: Column | float, d: Column | float, u: Column | float, a: Column | float = 0.5) -> Column:
    return F.struct(num(b).alias("b"), num(d).alias("d"), num(u).alias("u"), num(a).alias("a"))


def is_valid(o: Column) -> Column:
    """Every part in [0, 1] and b + d + u = 1; false for null."""
    parts = [o[k].between(0.0, 1.0) for k in "bdua"]
    return F.coalesce(reduce(lambda x, y: x & y, parts) & (F.abs(o["b"] + o["d"] + o["u"] - 1) <= TOLERANCE), F.lit(False))


def checked(o: Column) -> Column:
    """The opinion, or an error where it isn't one."""
    return F.when(o.isNull() | is_valid(o), o).otherwise(F.raise_error(F.lit("not an opinion: b, d, u, a in [0, 1] and b + d + u = 1")))


def vacuous(a: Column | float = 0.5) -> Column:
    return opinion(0.0, 0.0, 1.0, a)


def projected(o: Column) -> Column:
    return o["b"] + o["a"] * o["u"]


def from_confidence(c: Column | float, u: Column | float = 0.0, a: Column | float = 0.5) -> Column:
    c, u = num(c), num(u)
    return opinion(c * (1 - u), (1 - c) * (1 - u), u, a)


def from_evidence(r: Column, s: Column, weight: float = 2.0, a: Column | float = 0.5) -> Column:
    r, s = num(r), num(s)
    total = r + s + F.lit(float(weight))
    return opinion(r / total, s / total, F.lit(float(weight)) / total, a)


def to_document(o: Column) -> Column:
    return F.to_json(F.struct(F.lit("Opinion").alias("@type"), o["b"].alias("belief"), o["d"].alias("disbelief"), o["u"].alias("uncertainty"), o["a"].alias("baseRate")))


def from_document(text: Column) -> Column:
    x = F.from_json(text, "belief double, disbelief double, uncertainty double, baseRate double")
    return F.when(x.isNotNull(), opinion(x["belief"], x["disbelief"], x["uncertainty"], F.coalesce(x["baseRate"], F.lit(0.5))))


def trust_discount(trust: Column, o: Column) -> Column:
    t = trust["b"]
    return opinion(t * o["b"], t * o["d"], trust["d"] + trust["u"] + t * o["u"], o["a"])


def deduce(x: Column, given: Column, otherwise: Column) -> Column:
    """The child's opinion from its parent's and the two conditionals."""
    def part(k: str) -> Column:
        return x["b"] * given[k] + x["d"] * otherwise[k] + x["u"] * (x["a"] * given[k] + (1 - x["a"]) * otherwise[k])

    return opinion(part("b"), part("d"), part("u"), x["a"] * projected(given) + (1 - x["a"]) * projected(otherwise))


def pairwise_conflict(x: Column, y: Column) -> Column:
    return x["b"] * y["d"] + x["d"] * y["b"]


def conflict(o: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(o["b"] - o["d"]) - o["u"])


def cumulative_pair(x: Column, y: Column) -> Column:
    k = x["u"] + y["u"] - x["u"] * y["u"]
    a = (x["a"] + y["a"]) / 2
    return F.when((x["u"] == 0) & (y["u"] == 0), opinion((x["b"] + y["b"]) / 2, (x["d"] + y["d"]) / 2, 0.0, a)).otherwise(
        opinion((x["b"] * y["u"] + y["b"] * x["u"]) / k, (x["d"] * y["u"] + y["d"] * x["u"]) / k, x["u"] * y["u"] / k, a)
    )


def averaging_pair(x: Column, y: Column) -> Column:
    k = x["u"] + y["u"]
    a = (x["a"] + y["a"]) / 2
    return F.when(k == 0, opinion((x["b"] + y["b"]) / 2, (x["d"] + y["d"]) / 2, 0.0, a)).otherwise(
        opinion((x["b"] * y["u"] + y["b"] * x["u"]) / k, (x["d"] * y["u"] + y["d"] * x["u"]) / k, 2 * x["u"] * y["u"] / k, a)
    )


def _typed(o: Column) -> Column:
    return o.cast(SCHEMA)


def cumulative_array(os: Column) -> Column:
    """The left fold over an array of opinions in its order; null for an empty array."""
    return F.when(F.size(os) > 0, F.aggregate(F.slice(os, 2, F.greatest(F.size(os), F.lit(1))), _typed(F.element_at(os, 1)), lambda x, y: _typed(cumulative_pair(x, y))))


# Decay: factors in elapsed time and half-life, of one unit.
def exponential(t: Column, half_life: Column) -> Column:
    return F.pow(F.lit(2.0), -t / half_life)


def linear(t: Column, half_life: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - t / (2 * half_life))


def step(t: Column, half_life: Column) -> Column:
    return F.when(t < half_life, 1.0).otherwise(0.0)


Decay = Callable[[Column, Column], Column]
DECAYS: dict[str, Decay] = {"exponential": exponential, "linear": linear, "step": step}


def decay(o: Column, elapsed: Column, half_life: Column | float, how: Decay | str = "exponential") -> Column:
    """b and d shrink, uncertainty takes what they lose. Negative ages and half-lives that aren't positive are errors."""
    t, h = num(elapsed), num(half_life)
    factor = (DECAYS[how] if isinstance(how, str) else how)(t, h)
    ok = F.when((t < 0) | (h <= 0), F.raise_error(F.lit("elapsed time must not be negative and half-life must be positive")).cast("double")).otherwise(factor)
    b, d = o["b"] * ok, o["d"] * ok
    return opinion(b, d, F.greatest(F.lit(0.0), 1 - b - d), o["a"])


# Distances between opinions on (b, d, u), scaled to [0, 1].
def _parts(x: Column, y: Column) -> list[tuple[Column, Column]]:
    return [(x[k], y[k]) for k in "bdu"]


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in _parts(x, y)), F.lit(0.0))) / F.sqrt(F.lit(2.0))


def manhattan(x: Column, y: Column) -> Column:
    return sum((F.abs(p - q) for p, q in _parts(x, y)), F.lit(0.0)) / 2


def hellinger(x: Column, y: Column) -> Column:
    return F.sqrt(sum(((F.sqrt(p) - F.sqrt(q)) * (F.sqrt(p) - F.sqrt(q)) for p, q in _parts(x, y)), F.lit(0.0))) / F.sqrt(F.lit(2.0))


def jensen_shannon(x: Column, y: Column) -> Column:
    def half(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    total = sum((half(p, (p + q) / 2) + half(q, (p + q) / 2) for p, q in _parts(x, y)), F.lit(0.0))
    return F.sqrt(F.greatest(F.lit(0.0), total / 2))


DISTANCES: dict[str, Callable[[Column, Column], Column]] = {"euclidean": euclidean, "manhattan": manhattan, "jsd": jensen_shannon, "hellinger": hellinger}


def distance(x: Column, y: Column, how: str | Callable[[Column, Column], Column] = "euclidean") -> Column:
    return (DISTANCES[how] if isinstance(how, str) else how)(x, y)


# Compliance: the same struct read as lawfulness b, violation d.
def meet(*os: Column) -> Column:
    """All of the opinions hold: lawful only together, violated by any."""
    b = reduce(lambda x, y: x * y, [o["b"] for o in os])
    kept = reduce(lambda x, y: x * y, [1 - o["d"] for o in os])
    a = reduce(lambda x, y: x * y, [o["a"] for o in os])
    return opinion(b, 1 - kept, F.greatest(F.lit(0.0), kept - b), a)


def propagate_compliance(source: Column, trust: Column, purpose: Column) -> Column:
    return meet(source, trust, purpose)


def consent_validity(freely_given: Column, specific: Column, informed: Column, unambiguous: Column, demonstrable: Column, distinguishable: Column) -> Column:
    return meet(freely_given, specific, informed, unambiguous, demonstrable, distinguishable)


def withdrawal(consent: Column, withdrawn: Column, at: Column, withdrawal_time: Column) -> Column:
    return F.when(at < withdrawal_time, consent).otherwise(withdrawn)


def expiry(o: Column, at: Column, trigger: Column, residual: float = 0.0) -> Column:
    return F.when(at < trigger, o).otherwise(opinion(residual * o["b"], o["d"] + (1 - residual) * o["b"], o["u"], o["a"]))


def review_due(o: Column, at: Column, trigger: Column, half_life: Column | float) -> Column:
    return F.when(at < trigger, o).otherwise(decay(o, F.greatest(num(at) - num(trigger), F.lit(0.0)), half_life))


def regulatory_change(o: Column, at: Column, trigger: Column, new: Column) -> Column:
    return F.when(at < trigger, o).otherwise(new)


# Counterfactuals for edges that state only the positive conditional.
def vacuous_counterfactual(c: Column) -> Column:
    return vacuous(c["a"])


def adversarial_counterfactual(c: Column) -> Column:
    return opinion(c["d"], c["b"], c["u"], 1 - c["a"])


COUNTERFACTUALS: dict[str, Callable[[Column], Column]] = dict(adversarial=adversarial_counterfactual, **dict.fromkeys(("vacuous", "prior"), vacuous_counterfactual))


def flat(o: Column, digits: int = 6) -> list[Column]:
    """b, d, u, a and p as rounded columns."""
    return [*[F.round(o[k], digits).alias(k) for k in "bdua"], F.round(projected(o), digits).alias("p")]
