"""Opinion algebra and fusion against plain-Python folds."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veridelta.functions import opinion as O
from veridelta.operators import fusion
from veridelta.operators.fusion import _fold

KIND = f"g int, i int, opinion {O.SCHEMA}"


def groups(seed, n, dogmatic=0.15):
    r = random.Random(seed)
    out = []
    for g in range(n):
        for i in range(r.randint(1, 7)):
            u = 0.0 if r.random() < dogmatic else r.uniform(0.05, 1)
            b = r.uniform(0, 1 - u)
            out.append((g, i, (b, 1 - u - b, u, r.random())))
    return out


def by_group(rows):
    out = {}
    for g, i, o in rows:
        out.setdefault(g, []).append(o)
    return out


def test_ordered_cumulative_is_the_fold(spark):
    rows = groups(1, 60)
    got = {r.g: tuple(r.opinion) for r in fusion.cumulative_fuse(spark.createDataFrame(rows, KIND), ["g"], order="i").collect()}
    for g, os in by_group(rows).items():
        assert got[g] == pytest.approx(_fold(os), abs=1e-9)


def test_sums_equal_the_fold_without_dogmatic(spark):
    rows = groups(2, 60, 0)
    got = {r.g: tuple(r.opinion) for r in fusion.cumulative_fuse(spark.createDataFrame(rows, KIND), ["g"]).collect()}
    for g, os in by_group(rows).items():
        assert got[g][:3] == pytest.approx(_fold(os)[:3], abs=1e-9)


def test_averaging(spark):
    rows = groups(3, 60)
    got = {r.g: tuple(r.opinion) for r in fusion.averaging_fuse(spark.createDataFrame(rows, KIND), ["g"]).collect()}
    for g, os in by_group(rows).items():
        zero = [o for o in os if o[2] == 0]
        if zero:
            want = [sum(o[k] for o in zero) / len(zero) for k in (0, 1)] + [0.0]
        else:
            w = [1 / o[2] for o in os]
            want = [sum(o[k] * x for o, x in zip(os, w)) / sum(w) for k in (0, 1)] + [len(os) / sum(w)]
        assert got[g][:3] == pytest.approx(want, abs=1e-9)


def test_fusion_of_nothing(spark):
    df = spark.createDataFrame([(1, 1, None)], KIND)
    assert fusion.cumulative_fuse(df, ["g"]).count() == 0
    assert fusion.averaging_fuse(df.where("false"), ["g"]).count() == 0


def test_robust_removes_the_liar(spark):
    rows = [(1, i, (0.85, 0.05, 0.1, 0.5)) for i in range(4)] + [(1, 9, (0.05, 0.9, 0.05, 0.5))]
    r = fusion.robust_fuse(spark.createDataFrame(rows, KIND), ["g"], "i").first()
    assert r.removed == [9] and r.opinion.b > 0.9


def test_byzantine_strategies(spark):
    o = lambda b: (b, 0.9 - b, 0.1, 0.5)
    rows = [(1, i, o(0.8), 0.9) for i in range(3)] + [(1, 8, o(0.1), 0.8), (1, 9, o(0.6), 0.1)]
    df = spark.createDataFrame(rows, KIND + ", trust double")
    first = lambda s: fusion.byzantine_fuse(df, ["g"], "i", config=fusion.ByzantineConfig(0.1, 1, s, "trust")).first().removed
    assert first("most_conflicting") == [8] and first("least_trusted") == [9]


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_scalar_rules(spark):
    o = O.opinion(0.5, 0.3, 0.2, 0.4)
    assert one(spark, O.projected(o)) == pytest.approx(0.58)
    assert tuple(one(spark, O.trust_discount(O.opinion(0.5, 0.2, 0.3), o))) == pytest.approx((0.25, 0.15, 0.6, 0.4))
    assert tuple(one(spark, O.from_evidence(F.lit(8), F.lit(0)))) == pytest.approx((0.8, 0, 0.2, 0.5))
    assert one(spark, O.conflict(O.opinion(0.5, 0.5, 0.0))) == 1
    assert tuple(one(spark, O.from_document(O.to_document(o)))) == pytest.approx((0.5, 0.3, 0.2, 0.4))
    assert tuple(one(spark, O.decay(o, F.lit(10), 10.0))) == pytest.approx((0.25, 0.15, 0.6, 0.4))
    assert one(spark, O.is_valid(O.opinion(0.5, 0.5, 0.5))) is False
    with pytest.raises(Exception, match="must not be negative"):
        one(spark, O.decay(o, F.lit(-1), 10.0))


def test_deduction_of_certain_parents(spark):
    yes, no = O.opinion(0.7, 0.1, 0.2), O.opinion(0.1, 0.8, 0.1)
    assert tuple(one(spark, O.deduce(O.opinion(1.0, 0.0, 0.0), yes, no)))[:3] == pytest.approx((0.7, 0.1, 0.2))
    assert tuple(one(spark, O.deduce(O.opinion(0.0, 1.0, 0.0), yes, no)))[:3] == pytest.approx((0.1, 0.8, 0.1))


def test_meet_and_contamination(spark):
    rows = [(1, k, (b, d, d, 0.5)) for k, (b, d) in enumerate(((0.9, 0.05), (0.8, 0.1)))]
    df = spark.createDataFrame(rows, KIND)
    assert tuple(fusion.meet(df, ["g"]).first().opinion) == pytest.approx((0.72, 0.145, 0.135, 0.25))
    assert tuple(fusion.contamination(df, ["g"]).first().opinion) == pytest.approx((0.72, 0.145, 0.135, 0.5))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.floats(0.01, 1)), min_size=2, max_size=5))
def test_fused_opinions_are_opinions(spark, parts):
    rows = [(1, i, (x * (1 - u), (1 - x) * (1 - u), u, 0.5)) for i, (x, u) in enumerate(parts)]
    o = fusion.cumulative_fuse(spark.createDataFrame(rows, KIND), ["g"]).first().opinion
    assert math.isclose(o.b + o.d + o.u, 1, abs_tol=1e-9) and o.u <= min(u for _, u in parts) + 1e-9
