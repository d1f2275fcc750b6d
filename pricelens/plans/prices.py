"""Price math, settlement math and ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelens.functions import pricing as P
from pricelens.operators.consensus import remove_vig
from pricelens.plans.registry import query


def dec(a: str) -> str:
    """SQL for the decimal form of American odds."""
    return f"(CASE WHEN {a} >= 100 THEN 1 + {a} / 100e0 ELSE 1 + 100e0 / abs({a}) END)"


def implied(a: str) -> str:
    return f"(1 / {dec(a)})"


@query(f"""SELECT snapshot_id, american, round({dec('american')}, 9) AS decimal_odds, round({implied('american')}, 9) AS implied,
  round(CASE WHEN {dec('american')} >= 2 THEN ({dec('american')} - 1) * 100 ELSE -100 / ({dec('american')} - 1) END, 6) AS back,
  round(CASE WHEN american > 0 THEN 100e0 / (100 + american) ELSE abs(american) / (abs(american) + 100e0) END, 9) AS break_even FROM quotes""")
def odds_conversion(t):
    a = F.col("american")
    back = P.decimal_to_american(P.american_to_decimal(a))
    return t.quotes.select(
        "snapshot_id", "american", F.round(P.american_to_decimal(a), 9).alias("decimal_odds"), F.round(P.implied_probability(a), 9).alias("implied"),
        F.round(back, 6).alias("back"), F.round(P.break_even_probability(a), 9).alias("break_even"),
    )


@query("""SELECT id, p, round(1 / p, 9) AS fair_decimal,
  round(CASE WHEN 1 / p >= 2 THEN (1 / p - 1) * 100 ELSE -100 / (1 / p - 1) END, 6) AS fair_american FROM decisions""")
def fair_odds(t):
    fair = P.fair_odds(F.col("p"))
    return t.decisions.select("id", "p", F.round(fair["decimal"], 9).alias("fair_decimal"), F.round(fair["american"], 6).alias("fair_american"))


@query(f"""WITH x AS (SELECT id, p, american, {dec('american')} AS d FROM decisions)
SELECT id, round(p * d - 1, 9) AS ev, round(100 * (p * d - 1) + 0e0, 7) AS profit, round((p * d - 1) / (d - 1), 9) AS kelly,
  round(greatest(0, (p * d - 1) / (d - 1)) * 0.25e0, 9) AS stake_fraction FROM x""")
def value_of_decisions(t):
    p, a = F.col("p"), F.col("american")
    return t.decisions.select(
        "id", F.round(P.expected_value(p, a), 9).alias("ev"), F.round(P.expected_profit(p, a, F.lit(100.0)), 7).alias("profit"),
        F.round(P.kelly_fraction(p, a), 9).alias("kelly"), F.round(P.fractional_kelly(p, a, F.lit(0.25)), 9).alias("stake_fraction"),
    )


@query(f"""WITH x AS (SELECT id, p, american, {dec('american')} AS d, l.stake, p > 0.9 AS bad FROM (SELECT *, CASE WHEN american % 5 = 0 THEN -1 ELSE 10 END AS stake FROM decisions) l),
y AS (SELECT *, CASE WHEN p > 0.9 THEN 1.0e0 ELSE p END AS q FROM x)
SELECT id, CASE WHEN q < 1 AND stake >= 0 THEN round(1 / q, 9) END AS fair_decimal, CASE WHEN q < 1 AND stake >= 0 THEN round(stake * (q * d - 1), 9) END AS profit,
  CASE WHEN q < 1 AND stake >= 0 THEN '' WHEN q >= 1 AND stake < 0 THEN 'invalid-probability,invalid-stake' WHEN q >= 1 THEN 'invalid-probability' ELSE 'invalid-stake' END AS issues FROM y""")
def fair_value_issues(t):
    rows = t.decisions.withColumns({"q": F.when(F.col("p") > 0.9, 1.0).otherwise(F.col("p")), "stake": F.when(F.col("american") % 5 == 0, -1).otherwise(10)})
    fair = rows.withColumn("fair", P.fair_value(F.col("q"), F.col("american"), F.col("stake"), F.lit(0.25)))
    return fair.select(
        "id", F.round("fair.decimal", 9).alias("fair_decimal"), F.round("fair.profit", 9).alias("profit"), F.array_join("fair.issues", ",").alias("issues")
    )


@query(f"""WITH x AS (SELECT game, market, book, selection, coalesce(CAST(abs(point) AS STRING), '-') AS line, {implied('american')} AS implied, snapshot_id FROM quotes),
g AS (SELECT game, market, book, line, selection, max(implied) AS implied FROM x GROUP BY ALL)
SELECT game, market, book, line, selection, round(implied / sum(implied) OVER w, 9) AS fair
FROM g WINDOW w AS (PARTITION BY game, market, book, line) QUALIFY count(*) OVER w >= 2""")
def vig_removed(t):
    line = F.coalesce(F.abs("point").cast("string"), F.lit("-")).alias("line")
    rows = t.quotes.select("game", "market", "book", "selection", line, P.implied_probability(F.col("american")).alias("implied"))
    best = rows.groupBy("game", "market", "book", "line", "selection").agg(F.max("implied").alias("implied"))
    fair = remove_vig(best, ["game", "market", "book", "line"], "implied", "fair")
    return fair.select("game", "market", "book", "line", "selection", F.round("fair", 9).alias("fair"))


@query("""SELECT CASE WHEN american <= -200 THEN 'heavy-favorite' WHEN american <= -110 THEN 'favorite' WHEN american <= 109 THEN 'near-even'
  WHEN american <= 199 THEN 'underdog' ELSE 'longshot' END AS band, count(*) AS n, min(american) AS low, max(american) AS high FROM decisions GROUP BY 1""")
def odds_bands(t):
    return t.decisions.groupBy(P.odds_band(F.col("american")).alias("band")).agg(
        F.count("*").alias("n"), F.min("american").alias("low"), F.max("american").alias("high")
    )


@query(f"""WITH x AS (SELECT *, CASE status WHEN 'won' THEN stake_cents + CAST(floor(stake_cents * ({dec('american')} - 1) + 0.5e0) AS BIGINT)
  WHEN 'push' THEN stake_cents WHEN 'void' THEN stake_cents WHEN 'cashed-out' THEN cashed_cents ELSE 0 END AS returned_cents FROM bets)
SELECT bet, status, returned_cents, CASE WHEN status = 'open' THEN 0 ELSE returned_cents - stake_cents END AS profit_cents,
  CASE WHEN status = 'open' THEN NULL ELSE round((returned_cents - stake_cents) / nullif(stake_cents, 0), 9) END AS roi FROM x""")
def settled_bets(t):
    own = P.settle_bet(F.col("status"), F.col("stake_cents"), F.col("american"), F.col("cashed_cents"))
    return t.bets.withColumn("own", own).select(
        "bet", "status", F.col("own.returned_cents"), F.col("own.profit_cents"), F.round("own.roi", 9).alias("roi")
    )


@query("""SELECT a.status AS before, b.status AS after, b.status <> 'open' AND (a.status = 'open' OR a.status <> b.status) AS allowed
FROM (SELECT DISTINCT status FROM bets) a CROSS JOIN (SELECT DISTINCT status FROM bets) b""")
def bet_transitions(t):
    """Whether a bet may go from each status that bets have to each other one."""
    states = t.bets.select(F.col("status").alias("before")).distinct()
    return states.crossJoin(F.broadcast(states.withColumnRenamed("before", "after"))).withColumn(
        "allowed", P.can_transition(F.col("before"), F.col("after"))
    )


@query("SELECT account, bet, placed_ms, row_number() OVER (PARTITION BY account ORDER BY placed_ms, bet) AS place FROM bets")
def bets_in_order(t):
    from pyspark.sql import Window

    return t.bets.select("account", "bet", "placed_ms", F.row_number().over(Window.partitionBy("account").orderBy("placed_ms", "bet")).cast("long").alias("place"))


@query("""WITH x AS (SELECT id, round(money_percent, 9) AS m, round(bet_percent, 9) AS b FROM splits), y AS (SELECT id, greatest(0, least(100, b)) AS bet, greatest(0, least(100, m)) AS money FROM x)
SELECT id, bet, money, round(money - bet, 9) AS divergence FROM y""")
def split_cells(t):
    from pricelens.functions.text import split_cell

    return t.splits.select("id", split_cell(F.col("bet_percent"), F.col("money_percent")).alias("c")).select("id", "c.*")


@query()
def display_values(t):
    a = F.col("american")
    return t.decisions.select(
        "id", P.display("american", a).alias("odds"), P.display("probability", F.col("p")).alias("chance"), P.display("decimal", P.american_to_decimal(a)).alias("decimal_odds")
    )
