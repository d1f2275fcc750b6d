"""As-of joins, movement, clusters, consensus and matching against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from pricelens.operators import board, closing, consensus, matching, movement, ranking
from pricelens.operators.latest import current_quotes, latest_by

QUOTE = "game long, market string, selection string, book string, observed_ms long, retrieved_ms long, snapshot_id long, american int, point double, state string, provider_rank int"


def quotes(rng, n=300):
    return [(rng.randint(0, 3), "moneyline", rng.choice(["away", "home"]), rng.choice(["a", "b", "c", "d"]), rng.randint(0, 60) * 60_000, 10**7, k, rng.choice([-150, -110, 100, 130]), None, rng.choice(["active", "active", "suspended"]), k % 3) for k in range(n)]


def test_asof(spark):
    rng = random.Random(1)
    left = [(k, rng.randint(0, 2) if rng.random() > 0.1 else None, rng.randint(0, 50)) for k in range(80)]
    right = [(rng.randint(0, 2), rng.randint(0, 50), k) for k in range(60)]
    l, r = spark.createDataFrame(left, "id int, g int, at long"), spark.createDataFrame(right, "g int, seen long, v int")
    got = {x["id"]: x["closing_v"] for x in closing.asof_backward(l, r, ["g"], "at", "seen", 5, ["v"], ["v"]).collect()}
    want = {i: max(((s, v) for h, s, v in right if h == g and at - 5 <= s <= at), default=(0, None))[1] for i, g, at in left}
    assert got == want


def test_current_is_independent_of_order(spark):
    rng = random.Random(2)
    rows = quotes(rng)
    first = sorted(map(tuple, current_quotes(spark.createDataFrame(rows, QUOTE)).collect()), key=repr)
    rng.shuffle(rows)
    assert first == sorted(map(tuple, current_quotes(spark.createDataFrame(rows, QUOTE)).collect()), key=repr)
    again = sorted(map(tuple, latest_by(spark.createDataFrame(rows, QUOTE), ["game", "market", "selection", "book"], ["observed_ms", "provider_rank", "snapshot_id"], keep=2).collect()), key=repr)
    assert set(first) <= set(again)


def test_movement_golden(spark):
    rows = [(1, "moneyline", "home", "a", 0, 1, 1, 105, None, "active", 0), (1, "moneyline", "home", "a", 60_000, 60_001, 2, -105, None, "active", 0)]
    got = movement.movement(spark.createDataFrame(rows, QUOTE), 0.02, 5).first()
    assert (got["status"], got["direction"], got["significant"], got["american_delta"], got["issues"]) == ("available", "shortened", True, -210, [])
    got = movement.movement(spark.createDataFrame(rows, QUOTE), 0.02, 0.5).first()
    assert got["issues"] == ["history-gap-exceeded"] and got["gap_minutes"] == 1


def test_downsample_keeps_ends_and_turns(spark):
    rng = random.Random(3)
    rows = [(1, "m", "s", "b", k, k, k, 100, None, "active" if rng.random() > 0.05 else "suspended", 0) for k in range(500)]
    got = sorted(r["snapshot_id"] for r in movement.downsample(spark.createDataFrame(rows, QUOTE), 60).collect())
    turns = {k for k in range(1, 500) if rows[k][9] != "active" and rows[k - 1][9] == "active"}
    assert len(got) == 60 and {0, 499} | turns <= set(got)


def test_clusters_are_anchored(spark):
    rng = random.Random(4)
    rows = [(rng.choice("xy"), rng.randint(0, 400), k) for k in range(200)]
    got = {r["id"]: r["cluster"] for r in matching.anchored_clusters(spark.createDataFrame(rows, "k string, at long, id long"), ["k"], "at", ["id"], 30).collect()}
    want = {}
    for key in "xy":
        anchor = None
        for _, at, i in sorted(r for r in rows if r[0] == key):
            if anchor is None or at - anchor > 30:
                anchor = at
            want[i] = anchor
    assert got == want


def test_range_join_finds_all_pairs(spark):
    rng = random.Random(5)
    a, b = ([(k, rng.choice("xy"), rng.randint(-500, 500)) for k in range(90)] for _ in range(2))
    l, r = (spark.createDataFrame(x, "id int, k string, at long") for x in (a, b))
    got = sorted((x["id"], x["r_id"]) for x in matching.near_in_time(l, r, ["k"], "at", "at", 40).collect())
    assert got == sorted((i, j) for i, k, t in a for j, m, u in b if k == m and abs(t - u) <= 40)


def test_outliers_and_upper_median(spark):
    rows = [(1, "m", b, s, p if s == "h" else 1 - p) for b, p in (("a", 0.5), ("b", 0.5), ("c", 0.52), ("d", 0.7)) for s in ("h", "x")]
    df = spark.createDataFrame(rows, "game int, market string, book string, selection string, fair double")
    assert {r["book"] for r in consensus.outliers(df, 0.08).where("outlier").collect()} == {"d"}
    assert spark.range(1).select(consensus.upper_median(F.array(*map(F.lit, (4, 1, 3, 2))))).first()[0] == 3


def test_policy_is_validated():
    with pytest.raises(ValueError):
        consensus.ConsensusPolicy(minimum_books=9)
    with pytest.raises(ValueError):
        consensus.ConsensusPolicy(outlier_threshold=1.0)
    with pytest.raises(ValueError):
        consensus.ConsensusPolicy(weights={"A ": 1.0, "b": 1.0, "c": 1.0})


def test_empty_tables(spark):
    none = spark.createDataFrame([], QUOTE)
    assert current_quotes(none).count() == movement.movement(none, 0.1, 1).count() == movement.markers(none).count() == movement.downsample(none, 5).count() == 0


def test_explorer_order(spark):
    games = spark.createDataFrame([(3, "Águila", "B", 5, "l1", "scheduled", None), (1, "Aguila", "C", 5, "l2", "started", 9), (2, "x", "águila", 7, "l1", "unknown", 8), (4, "other", "one", 1, "l0", "scheduled", 1)], "game long, home string, away string, start_ms long, league string, status string, fresh_ms long")
    ids = lambda *a, **k: [r["game"] for r in board.explore(games, *a, **k).collect()]
    assert ids("ÁGUILA", "kickoff") == [1, 3, 2] and ids("aguila", "kickoff", descending=True) == [2, 1, 3]
    assert ids(None, "lifecycle") == [3, 4, 1, 2] and ids("aguila", "freshness", descending=True) == [1, 2, 3]


def test_ranked_filters(spark):
    rows = [(1, "m", "a", "l1", ["w"], 10, 0.1, 3, 90), (2, "m", "b", "l2", [], 20, 0.2, 2, 50), (3, "s", "a", "l1", [], 30, -0.1, 4, 99)]
    df = spark.createDataFrame(rows, "id int, market string, book string, league string, warnings array<string>, start_ms long, ev double, books int, oldest_ms long")
    ids = lambda **k: sorted(r["id"] for r in ranking.filtered(df, **k).collect())
    assert ids() == [1, 2, 3] and ids(market="m", book="a") == [1] and ids(competition="l1", minimum_ev=0.0) == [1] and ids(warning="w") == [1]
    assert ids(from_ms=20, until_ms=30) == [2] and ids(minimum_books=3) == [1, 3] and ids(maximum_age_ms=10, now_ms=100) == [1, 3]
