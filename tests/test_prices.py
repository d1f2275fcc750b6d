"""Golden values and invariants of price math, display and settlement."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricelens.functions import pricing as P
from pricelens.functions import text as T
from pricelens.operators import performance


def values(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def test_conversions(spark):
    a = lambda x: F.lit(x)
    got = values(spark, P.american_to_decimal(a(150)), P.american_to_decimal(a(-200)), P.american_to_decimal(a(50)), P.american_to_decimal(a(float("nan"))), P.american_to_decimal(a(float("inf"))), P.decimal_to_american(a(1.0)), P.probability_to_american(a(0.5)), P.break_even_probability(a(-110)))
    assert got[:2] == (2.5, 1.5) and got[2:6] == (None,) * 4 and got[6] == 100 and got[7] == pytest.approx(110 / 210)


def test_expected_profit_has_no_negative_zero(spark):
    got = values(spark, P.expected_profit(F.lit(0.48), F.lit(120), F.lit(100.0)), P.expected_profit(F.lit(0.4), F.lit(100), F.lit(0.0)), P.expected_profit(F.lit(0.4), F.lit(100), F.lit(-1.0)))
    assert got[0] == pytest.approx(5.6) and math.copysign(1, got[1]) == 1 and got[2] is None


@settings(max_examples=20, deadline=None)
@given(odds=st.lists(st.one_of(st.integers(100, 100_000), st.integers(-100_000, -101)), min_size=1, max_size=30))
def test_round_trip(spark, odds):
    df = spark.createDataFrame([(x,) for x in odds], "a int")
    back = P.decimal_to_american(P.american_to_decimal(F.col("a")))
    assert all(r["b"] == pytest.approx(r["a"], rel=1e-9) for r in df.select("a", back.alias("b")).collect())


def test_display_rounds_halves_away_from_zero(spark):
    got = values(spark, P.display("money", F.lit(1.005)), P.display("money", F.lit(-0.285)), P.display("american", F.lit(150)), P.display("american", F.lit(-110)), P.display("probability", F.lit(0.5)), P.display("decimal", F.lit(2.0005)))
    assert tuple(got) == ("1.01", "-0.29", "+150", "-110", "50.00%", "2.001")


def test_bands_and_settlement(spark):
    bands = [P.odds_band(F.lit(x)) for x in (-200, -199, -110, -109, 109, 110, 199, 200)]
    assert tuple(values(spark, *bands)) == ("heavy-favorite", "favorite", "favorite", "near-even", "near-even", "underdog", "underdog", "longshot")
    won = P.settle_bet(F.lit("won"), F.lit(333), F.lit(-110), F.lit(None))
    open_ = P.settle_bet(F.lit("open"), F.lit(333), F.lit(-110), F.lit(None))
    assert tuple(tuple(x) for x in values(spark, won, open_)) == ((636, 303, 303 / 333), (0, 0, None))


def test_labels(spark):
    m = lambda a, b: T.labels_match(F.lit(a), F.lit(b))
    assert tuple(values(spark, m("New York Yankees", "yankees"), m("Red Sox", "White Sox"), m("A.B", "a b"), m("Boston Red Sox", "Red Sox"))) == (True, False, True, True)
    assert values(spark, T.selection_key(F.lit("a b/é"), F.lit("over")))[0] == "participant:a%20b%2F%C3%A9:over"


def test_performance_example(spark):
    """Five decisions: units -0.2, roi -0.0667 over three exposed, drawdown 1."""
    rows = [("a", 1, "lost", -1.0), ("b", 2, "won", 0.8), ("c", 3, "push", 0.0), ("d", 4, "void", 0.0), ("e", 5, "unresolved", 0.0)]
    df = spark.createDataFrame([(k, at, o, p, 0.5, 100, 1) for k, at, o, p in rows], "id string, created_ms long, outcome string, profit double, p double, american int, account int")
    got = performance.counts(df).first()
    assert (got["decisions"], got["exposure"]) == (2, 3) and got["units"] == pytest.approx(-0.2) and got["roi"] == pytest.approx(-0.2 / 3)
    assert performance.cumulative(df, ["account"], ["created_ms", "id"]).agg(F.max("drawdown")).first()[0] == pytest.approx(1)
    low, high = performance.wilson(F.lit(8), F.lit(10))
    assert tuple(values(spark, low, high)) == pytest.approx((0.490162, 0.943318), abs=1e-5)
    low, high = performance.wilson(F.lit(0), F.lit(0))
    assert tuple(values(spark, low, high)) == (None, None) or tuple(values(spark, low, high)) == (0.0, 1.0)
