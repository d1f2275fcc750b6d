"""Served markets, cells, experiments, provenance, cursors and labels against rules written out as plain loops."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pricelens.functions.text import composed
from pricelens.operators import experiments as E
from pricelens.operators import ranking as R
from pricelens.operators import serving as S
from pricelens.sources.index import reread, scan_index, write_base, write_index

GAME = "game long, version int, status string, start_ms long"
QUOTE = "game long, version int, market string, book string, selection string, american int, point double, state string, observed_ms long, retrieved_ms long"
CLOSE = "game long, version int, market string, selection string, book string, american int, point double, final boolean, state string"


def serve(spark, games, quotes, closes, roster=("b1", "b2")):
    rows = lambda x, kind: spark.createDataFrame(x, kind)
    got = S.served_markets(rows(games, GAME), rows(quotes, QUOTE), rows(closes, CLOSE), list(roster), 1000, 100).collect()
    return {(r["game"], r["market"]): (r["source"], r["book"], [p["american"] for p in r["prices"] or []]) for r in got}


def pair(game, market="moneyline", book="b1", version=2, points=(None, None), odds=(110, -120), observed=5, state="active", sides=("away", "home")):
    return [(game, version, market, book, s, o, p, state, observed, 10) for s, o, p in zip(sides, odds, points)]


def close(game, book="b1", version=2, odds=(300, -400), final=True, state="ok"):
    return [(game, version, "moneyline", s, book, o, None, final, state) for s, o in zip(("away", "home"), odds)]


def test_served_book_is_the_first_complete_one(spark):
    games = [(k, 2, "scheduled", 2000) for k in range(1, 13)]
    quotes = [
        *pair(1, book="b2"), *pair(1, odds=(101, -101)), *pair(2)[:1], *pair(2, book="b2"), *pair(3, version=1), *pair(4, version=0), *pair(5, state="suspended"), *pair(6, observed=11),
        *pair(7, "spread", points=(1.5, -1.5)), *pair(7, "total", points=(8.0, 8.0), sides=("over", "under")), *pair(8, "spread", points=(1.5, -2.5)), *pair(9, "total", points=(8.0, 8.5), sides=("over", "under")),
        *pair(10, "spread"), *pair(11), *pair(11)[:1], *pair(12, book="other"),
    ]
    got = serve(spark, games, quotes, [])
    assert len(got) == 36  # a row for each market of each game
    served = {k: v[:2] for k, v in got.items() if v[0] != "none"}
    assert served == {(1, "moneyline"): ("current", "b1"), (2, "moneyline"): ("current", "b2"), (3, "moneyline"): ("current", "b1"), (7, "spread"): ("current", "b1"), (7, "total"): ("current", "b1")}
    assert got[1, "moneyline"][2] == [101, -101]


def test_closes_count_from_the_start_on(spark):
    games = [(1, 2, "started", 900), (2, 2, "scheduled", 2000), (3, 2, "started", 900), (4, 2, "completed", 900), (5, 2, "started", 900), (6, 2, "scheduled", 2000), (7, 2, "started", 900)]
    quotes = [row for k in (1, 2, 3, 4, 5, 6) for row in pair(k)]
    closes = [*close(1), *close(2), *close(3, version=1), *close(4, final=False), *close(5, state="failed"), *close(6, state="failed"), *close(7, "b2"), *close(7)[:1]]
    got = {k[0]: v for k, v in serve(spark, games, quotes, closes).items() if k[1] == "moneyline"}
    assert got == {
        1: ("close", "b1", [300, -400]), 2: ("current", "b1", [110, -120]), 3: ("current", "b1", [110, -120]), 4: ("current", "b1", [110, -120]), 5: ("withheld", None, []), 6: ("current", "b1", [110, -120]), 7: ("close", "b2", [300, -400]),
    }


def test_old_games_without_prices_are_hidden(spark):
    games = [(1, 2, "scheduled", 899), (2, 2, "scheduled", 900), (3, 2, "scheduled", 3000), (4, 2, "started", 1), (5, 2, "scheduled", 1)]
    got = serve(spark, games, pair(5), [])
    assert {k for k, _ in got} == {2, 3, 4, 5} and serve(spark, [], [], []) == {}


def test_blockers_come_before_age(spark):
    kind = "id int, sport string, market string, american int, point double, observed_ms long, own struct<state:string,observed_ms:long>, group struct<state:string,observed_ms:long>, game int, book string, status string, complete boolean"
    cell = lambda i, own=("active", 1), group=("active", 1), market="moneyline", sport="s", odds=110, point=None, at=990, game=1, book="b", status="scheduled", complete=True: (i, sport, market, odds, point, at, own, group, game, book, status, complete)
    rows = [
        cell(1), cell(2, own=("suspended", 1), group=("active", 999)), cell(3, group=("unavailable", 1)), cell(4, own=None, group=None, at=1), cell(5, at=1), cell(6, own=("suspended", 1), at=1), cell(7, odds=None, at=None, own=("suspended", 1)),
        cell(8, at=1200), cell(9, own=("active", 1200)), cell(10, market="spread"), cell(11, market="spread", point=1.5), cell(12, market="btts"), cell(13, market="btts", sport="soccer"), cell(14, own=None), cell(15, market="team_total"), cell(16, at=1050),
    ]
    got = {r["id"]: (r["shown"], r["reason"]) for r in S.cell_states(spark.createDataFrame(rows, kind), 1000, 500, 100).collect()}
    good = ("active", None)
    assert got == {
        1: good, 2: ("suspended", "market-blocked"), 3: ("unavailable", "market-blocked"), 4: ("unavailable", "availability-evidence-missing"), 5: ("stale", "quote-stale"), 6: ("suspended", "market-blocked"), 7: ("unavailable", "quote-missing"),
        8: ("unavailable", "evidence-ahead"), 9: ("unavailable", "evidence-ahead"), 10: ("unavailable", "point-missing"), 11: good, 12: ("unavailable", "market-unsupported"), 13: good, 14: good, 15: ("unavailable", "point-missing"), 16: good,
    }
    rows = [cell(1), cell(2), cell(3, game=2), cell(4, game=2, at=1), cell(5, game=2, book="c"), cell(6, game=3, status="started"), cell(7, game=4, complete=False), cell(8, game=5, book="c")]
    judged = S.target_qualifies(S.cell_states(spark.createDataFrame(rows, kind), 1000, 500, 100), "b")
    assert dict(map(tuple, judged.collect())) == {1: True, 2: False, 3: False, 4: False, 5: False}


EXPERIMENT = "experiment int, created_ms long, train_end long, tune_start long, tune_end long, holdout_start long, frozen_ms long, baseline string, baseline_evidence string, challenger string, challenger_evidence string"


def test_experiment_failures(spark):
    """Random sets of ids against set algebra; every failure occurs, and so does an experiment without any."""
    rng, rows, members, want, digests = random.Random(4), [], [], {}, {}
    for e in range(120):
        sets = {(r, k): {f"{r[:2]}{e}-{k}{i}" for i in range(3)} for r in ("train", "tune", "holdout") for k in ("event", "member")}
        sets |= {(r, k): set(sets["holdout", k]) for r in ("baseline", "challenger") for k in ("event", "member")} | {(r, "result"): {"r1", "r2"} for r in ("baseline", "challenger")}
        odd = {rng.choice(range(-3, 10)) for _ in range(rng.choice((0, 1, 1, 2)))}
        if 0 in odd:
            sets["train", "event"].add(next(iter(sets["holdout", "event"])))
        if 1 in odd:
            sets["tune", "member"] |= sets["train", "member"]
        if 2 in odd:
            sets[rng.choice(("baseline", "challenger")), "event"].add("more")
        if 3 in odd:
            sets[rng.choice(("baseline", "challenger")), "member"].pop()
        if 4 in odd:
            sets["challenger", "result"] = {"r1"}
        if 5 in odd:
            sets["baseline", "result"] = sets["challenger", "result"] = set()
        if 6 in odd:
            for k in ("event", "member"):
                sets["tune", k] = {f"same {k}"}
        row = (e, e, 10, 10 - (7 in odd), 20, 20, 20 + (8 in odd), "a", "a", "c", "x" if 9 in odd else "c")
        rows.append(row)
        members += [(e, r, k, i) for (r, k), own in sets.items() for i in own for _ in range(rng.choice((1, 1, 2)))]
        pairs = [("train", "tune"), ("train", "holdout"), ("tune", "holdout")]
        want[e] = sorted(name for name, yes in (
            ("window-overlap", any(sets[a, k] & sets[b, k] for a, b in pairs for k in ("event", "member"))), ("holdout-universe-mismatch", any(sets["holdout", "event"] != sets[r, "event"] for r in ("baseline", "challenger"))),
            ("holdout-member-manifest-mismatch", any(sets["holdout", "member"] != sets[r, "member"] for r in ("baseline", "challenger"))), ("result-evidence-mismatch", sets["baseline", "result"] != sets["challenger", "result"] or not sets["baseline", "result"]),
            ("tune-evidence-reused", 6 in odd and e > 20), ("window-chronology", 7 in odd), ("challenger-frozen-late", 8 in odd), ("strategy-evidence-mismatch", 9 in odd),
        ) if yes)
        digests[e] = sets
    m = spark.createDataFrame(members, "experiment int, role string, kind string, id string").repartition(5)
    same = spark.createDataFrame([(999, "tune", k, f"same {k}") for k in ("event", "member")], "experiment int, role string, kind string, id string")
    used = E.id_bits(same).groupBy("experiment").agg(E.manifest("tune").alias("digest"), E.manifest("holdout").alias("none"))
    assert used.select("none").first()[0] is None
    ledger = used.select("digest", F.explode(F.array(F.lit(20), F.lit(70))).alias("used_ms"))  # experiments up to 20 came first
    got = E.failures(spark.createDataFrame(rows, EXPERIMENT), m, ledger).collect()
    assert {r["experiment"]: r["failures"] for r in got} == want
    assert {n for own in want.values() for n in own} >= {"window-overlap", "holdout-universe-mismatch", "tune-evidence-reused", "window-chronology", "strategy-evidence-mismatch"} and [] in want.values()
    same = {r["tune_digest"] for r in got if {("tune", k): digests[r["experiment"]]["tune", k] for k in ("event", "member")} == {("tune", k): {f"same {k}"} for k in ("event", "member")}}
    assert len(same) == 1 and len({r["holdout_digest"] for r in got}) == 120


def test_provenance(spark):
    """A root stands for all below it; two components of one algorithm are refused; a change is traced to where it began."""
    sha = lambda *x: hashlib.sha256("\n".join(x).encode()).hexdigest()
    nodes = [
        ("r", None, 2, "sum", "1", "in"), ("m", "r", 1, "mid", "1", ""), ("n", "r", 1, "other", "2", ""), ("a", "m", 0, "x", "1", "5"), ("b", "m", 0, "w", "1", "6"),
        ("s", None, 2, "sum", "1", "in"), ("p", "s", 1, "mid", "1", ""), ("c", "p", 0, "x", "1", "5"), ("d", "p", 0, "x", "1", "6"),
    ]
    kind = "node string, parent string, level int, algorithm string, version string, input string"
    got = {r["node"]: r for r in E.provenance(spark.createDataFrame(nodes, kind), 3).collect()}
    a, b = sha("x", "1", "5", ""), sha("w", "1", "6", "")
    m, n = sha("mid", "1", "", f"w@1@{b}\nx@1@{a}"), sha("other", "2", "", "")
    assert (got["a"]["hash"], got["b"]["hash"], got["m"]["hash"], got["n"]["hash"]) == (a, b, m, n) and got["r"]["hash"] == sha("sum", "1", "in", f"mid@1@{m}\nother@2@{n}")
    assert (got["p"]["issue"], got["p"]["hash"], got["s"]["issue"], got["s"]["hash"]) == ("duplicate-component", None, "incomplete", None)
    other = [(*x[:5], "7") if x[0] == "b" else x for x in nodes if x[0] != "n"] + [("e", "m", 0, "new", "1", "")]
    moved = E.changed(E.provenance(spark.createDataFrame(nodes, kind), 3), E.provenance(spark.createDataFrame(other, kind), 3))
    assert {r["node"]: r["origin"] for r in moved.collect()} == {"b": True, "e": True, "n": True, "m": False, "r": False}


def test_index(spark, tmp_path):
    """Only the months asked for are opened, the base doesn't move, and the rows are those of a plain filter."""
    month = 31 * 86_400_000
    df = spark.range(2000).select(F.concat(F.lit("d"), "id").alias("id"), F.when(F.col("id") % 50 > 0, F.pmod(F.xxhash64("id"), F.lit(20 * month))).alias("at"), (F.col("id") % 7).alias("v"))
    write_index(df, str(tmp_path / "index"), "at", "id")
    base = write_base(df, "index_base", str(tmp_path / "base"), "id", 4)
    low, high = 3 * month, 4 * month
    found = scan_index(spark, str(tmp_path / "index"), "at", low, high)
    got = reread(found, base, "id")
    want = df.where((F.col("at") >= low) & (F.col("at") < high))
    assert sorted(map(tuple, got.select("id", "at", "v").collect())) == sorted(map(tuple, want.select("id", "at", "v").collect())) and want.count() > 50
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = reread(found, base, "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "PartitionFilters: [isnotnull(month" in plan and "Join" in plan
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange" not in plan.split("FileScan parquet spark_catalog")[0].split("Join")[-1]  # the keys' side alone
    spark.sql("DROP TABLE index_base")


def test_cursors_are_bound_to_filters_and_instant(spark):
    rows = [(f"o{k:02}", ev, 50, 50, 50, "moneyline" if k % 3 else "spread", 10 * k) for k, ev in enumerate([0.3, 0.1, 0.1, 0.2, 0.1, 0.3, 0.0, 0.1, 0.2, 0.1])]
    df = spark.createDataFrame(rows, "id string, ev double, confidence long, freshness long, coverage long, market string, observed_ms long")
    filters, cursor, found = {"market": "moneyline"}, None, []
    while page := R.filtered_page(df, 2, filters, 80, cursor).collect():
        found += [r["id"] for r in page]
        cursor = R.cursor_at(page[-1], filters, 80)
    assert found == [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0])) if r[5] == "moneyline" and r[6] <= 80]
    for other, at in (({"market": "spread"}, 80), ({}, 80), (filters, 90)):
        with pytest.raises(ValueError, match="cursor-"):
            R.filtered_page(df, 2, other, at, R.cursor_at(rows_of(rows[1]), filters, 80))


def rows_of(r):
    return dict(zip(("id", "ev", "confidence", "freshness", "coverage"), r))


def test_labels_in_composition(spark):
    labels = ["Plain FC", "\uff21tl\u00e9tico", "Atle\u0301tico", None, "", "\ufb01n", "Plain FC", "\u2460"]
    df = spark.createDataFrame(list(enumerate(labels)), "id int, label string")
    assert [r["label"] for r in composed(df, "label").orderBy("id").collect()] == ["Plain FC", "Atl\u00e9tico", "Atl\u00e9tico", None, "", "fin", "Plain FC", "1"]
