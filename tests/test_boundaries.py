"""Values on a boundary, where a query of the same rule could go another way than its SQL."""

from types import SimpleNamespace

import pytest

from pricelens.operators import board as B
from pricelens.plans import series

QUOTE = "snapshot_id long, game long, market string, book string, selection string, american int, provider_rank int, observed_ms long"


def decimal(american):
    return 1 + american / 100 if american >= 100 else 1 + 100 / abs(american)


def test_clv_summary_counts_values_as_they_are(spark):
    """Entries at the closing price of a market without margin: their value is the last bit of a double, above 0 or not."""
    prices = range(100, 300)
    rows, values = [], []
    for game, a in enumerate(prices):
        for k, (selection, american) in enumerate((("home", a), ("away", -a))):
            rows += [(4 * game + k, game, "moneyline", "draftkings", selection, american, 0, 9), (4 * game + 2 + k, game, "moneyline", "hardrock", selection, american, 0, 5)]
        p, q = 1 / decimal(a), 1 / decimal(-a)
        values += [x / (p + q) * decimal(american) - 1 for x, american in ((p, a), (q, -a))]
    positive = sum(v > 0 for v in values)
    assert 0 < positive < len(values) and max(map(abs, values)) < 1e-12
    [got] = series.clv_summary(SimpleNamespace(quotes=spark.createDataFrame(rows, QUOTE))).collect()
    assert (got["market"], got["n"], got["median_clv"], got["positive"]) == ("moneyline", len(values), pytest.approx(0), positive)


def test_evidence_gaps_names_only_what_a_price_has(spark):
    """Cells of fresh active prices that are all alternate lines are partial; none of the named reasons holds."""
    cells = [
        ("partial", [("active", 9, False, True)]), ("partial", [("active", 9, False, True), ("active", 9, False, True)]), ("stale", [("active", 1, False, True)]), ("suspended", [("suspended", 1, False, False)]),
        ("closed", [("unavailable", 1, False, False), ("suspended", 9, False, False)]), ("unsupported", [("unavailable", 9, False, False), ("active", 9, True, True)]), ("incomplete-market", [("active", 9, False, False), ("active", 9, True, True)]), ("missing", []),
    ]
    rows = [(game, "b", "moneyline", *price) for game, (_, prices) in enumerate(cells) for price in prices]
    quotes = spark.createDataFrame(rows, "game long, book string, market string, state string, observed_ms long, unsupported boolean, alternate boolean")
    got = B.evidence_gaps(spark.range(len(cells)).withColumnRenamed("id", "game"), quotes, {"b": ["moneyline"]}, 2, 10, 5).collect()
    assert {r["game"]: r["gap"] for r in got} == dict(enumerate(gap for gap, _ in cells))
