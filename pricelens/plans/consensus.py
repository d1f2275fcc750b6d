"""Consensus, qualification and arbitrage queries over current quotes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pricelens.functions.pricing import expected_value
from pricelens.operators import arbitrage as A
from pricelens.operators import consensus as C
from pricelens.operators import qualify as Q
from pricelens.operators.latest import current_availability, current_quotes
from pricelens.plans.facts import NOW_MS
from pricelens.plans.prices import dec, implied
from pricelens.plans.registry import part, query

#: Ages here run to days, for the quotes of the driver's events are days apart.
POLICY = C.ConsensusPolicy(minimum_books=2, maximum_age_minutes=14400.0)
MARKET = ["game", "market"]

part("current_quotes", """SELECT * FROM quotes QUALIFY row_number() OVER (PARTITION BY game, market, selection, book
  ORDER BY observed_ms DESC, provider_rank DESC, snapshot_id DESC) = 1""")
part("book_rows", """SELECT game, market, book, count(*) AS n, count(DISTINCT selection) AS sels, max(expected) AS expected, min(CASE WHEN state <> 'active' THEN state END) AS off,
  min(observed_ms) AS oldest FROM (SELECT *, count(DISTINCT selection) OVER (PARTITION BY game, market) AS expected FROM current_quotes) GROUP BY ALL""")
part("excluded", f"""SELECT game, market, book, round(({NOW_MS} - oldest) / 60000, 6) AS age_minutes, CASE WHEN book = 'hardrock' THEN 'target-sportsbook' WHEN off IS NOT NULL THEN off
  WHEN {NOW_MS} - oldest < 0 THEN 'invalid-age' WHEN ({NOW_MS} - oldest) / 60000 > 14400 THEN 'stale' WHEN n > sels THEN 'duplicate-selection'
  WHEN sels < expected THEN 'missing-selection' WHEN book = 'pinnacle' THEN 'unconfigured' END AS reason FROM book_rows""")
part("fair_prices", f"""SELECT game, market, book, selection, {implied('american')} / sum({implied('american')}) OVER (PARTITION BY game, market, book) AS fair
  FROM current_quotes SEMI JOIN (SELECT * FROM excluded WHERE reason IS NULL) e USING (game, market, book)
  QUALIFY count(*) OVER (PARTITION BY game, market, book) >= 2""")
part("medians", "SELECT game, market, selection, list_sort(list(fair))[len(list(fair)) // 2 + 1] AS mid FROM fair_prices GROUP BY ALL")
part("strays", """SELECT f.*, abs(fair - mid) AS deviation, max(abs(fair - mid)) OVER (PARTITION BY game, market, book) > 0.08 * (1 + 2 * power(2e0, -52)) AS outlier
  FROM fair_prices f JOIN medians USING (game, market, selection)""")
part("means", "SELECT game, market, selection, avg(fair) AS mean, count(*) AS books FROM strays WHERE NOT outlier GROUP BY ALL")
part("agreed", "SELECT game, market, selection, books, CASE WHEN min(books) OVER w >= 2 THEN mean / sum(mean) OVER w END AS probability FROM means WINDOW w AS (PARTITION BY game, market)")
part("ranges", "SELECT game, market, selection, round(max(fair) - min(fair), 12) AS range FROM strays WHERE NOT outlier GROUP BY ALL")
part("disagreed", """SELECT game, market, min_by(selection, struct_pack(a := -range, b := selection)) AS selection, max(range) AS score,
  CASE WHEN max(range) >= 0.1e0 * (1 - 2 * power(2e0, -52)) THEN 'block' WHEN max(range) >= 0.05e0 * (1 - 2 * power(2e0, -52)) THEN 'warning' ELSE 'none' END AS level FROM ranges GROUP BY ALL""")


def _rows(t):
    """Every current quote with its market's consensus."""
    return C.with_consensus(current_quotes(t.quotes), POLICY, NOW_MS)


@query("SELECT game, market, book, age_minutes, coalesce(reason, 'included') AS reason FROM excluded")
def book_exclusions(t):
    found = C.exclusions(current_quotes(t.quotes), POLICY, NOW_MS)
    return found.withColumn("reason", F.coalesce("reason", F.lit("included")))


@query("SELECT game, market, book, bool_and(fair BETWEEN 0 AND 1) AND abs(sum(fair) - 1) <= 32 * power(2e0, -52) AS valid FROM fair_prices GROUP BY ALL")
def contribution_checks(t):
    return C.valid_contributions(_rows(t).where("fair IS NOT NULL"), [*MARKET, "book"])


@query("SELECT game, market, book, selection, round(fair, 9) AS fair, round(deviation, 9) AS deviation, outlier FROM strays")
def outlier_audit(t):
    return _rows(t).where("fair IS NOT NULL").select(*MARKET, "book", "selection", F.round("fair", 9).alias("fair"), F.round("deviation", 9).alias("deviation"), "outlier")


@query("SELECT game, market, selection, books, round(probability, 9) AS probability FROM agreed")
def weighted_consensus(t):
    return C.consensus(_rows(t)).withColumn("probability", F.round("probability", 9))


@query("SELECT game, market, selection, round(score, 9) AS score, level FROM disagreed")
def market_disagreement(t):
    return C.disagreement(_rows(t))


@query(f"""SELECT q.game, q.market, q.selection, round(a.probability, 9) AS fair, q.american, round(a.probability * {dec('q.american')} - 1, 9) AS ev
FROM current_quotes q JOIN agreed a USING (game, market, selection) WHERE q.book = 'hardrock' AND q.state = 'active' AND a.probability IS NOT NULL""")
def consensus_ev(t):
    """Flagship: expected value of the target book's current prices by the consensus of the others."""
    priced = _rows(t).where((F.col("book") == POLICY.target) & (F.col("state") == "active") & F.col("probability").isNotNull())
    ev = expected_value(F.col("probability"), F.col("american"))
    return priced.select(*MARKET, "selection", F.round("probability", 9).alias("fair"), "american", F.round(ev, 9).alias("ev"))


@query(f"""WITH x AS (SELECT id, p, american, market, game % 5 AS books, game % 31 AS age_minutes, game % 180 AS minutes_to_start, game % 3 = 0 AS lineup, game % 100 AS tickets FROM decisions),
r AS (SELECT id, round(p * {dec('american')} - 1, 9) AS ev, list_filter([CASE WHEN market <> 'moneyline' THEN 'unsupported-market' END, CASE WHEN p * {dec('american')} - 1 < 0.02e0 THEN 'ev-below-threshold' END,
  CASE WHEN books < 3 THEN 'insufficient-books' END, CASE WHEN age_minutes > 15 THEN 'stale-price' END, CASE WHEN minutes_to_start <= 60 AND NOT lineup THEN 'lineup-unconfirmed' END,
  CASE WHEN tickets >= 80 THEN 'public-fade' END], lambda r: r IS NOT NULL) AS reasons FROM x)
SELECT id, ev, CASE WHEN len(reasons) = 0 THEN 'play' ELSE 'no-bet' END AS decision, CASE WHEN len(reasons) = 0 THEN 'positive-ev' ELSE array_to_string(reasons, ',') END AS reasons FROM r""")
def edge_evaluation(t):
    rows = t.decisions.selectExpr(
        "id", "p", "american", "market", "game % 5 AS books", "game % 31 AS age_minutes", "game % 180 AS minutes_to_start", "game % 3 = 0 AS lineup_confirmed", "game % 100 AS ticket_percent"
    )
    own = Q.evaluate_edge(rows, ["moneyline"])
    return own.select("id", F.round("ev", 9).alias("ev"), "decision", F.array_join("reasons", ",").alias("reasons"))


def _targets(t):
    """The target's current quotes with the consensus of the others, disagreement, outliers, and reasons against other books."""
    whole = Window.partitionBy(*MARKET)
    against = F.when(F.col("book") != POLICY.target, F.col("reason"))
    rows = _rows(t).withColumns({"has_outlier": F.bool_or("outlier").over(whole), "comparison_reasons": F.collect_set(against).over(whole)})
    agreed = F.col("probability").isNotNull()
    return rows.where(F.col("book") == POLICY.target).withColumns(
        {
            "fair": F.col("probability"),
            "score": F.when(agreed, F.col("score")),
            "level": F.when(agreed, F.col("level")),
            "age_minutes": (F.lit(NOW_MS) - F.col("observed_ms")) / 60000,
        }
    )


part("target_rows", f"""SELECT q.*, a.probability AS fair, CASE WHEN a.probability IS NOT NULL THEN round(d.score, 9) END AS score, CASE WHEN a.probability IS NOT NULL THEN d.level END AS level, coalesce(o.odd, false) AS odd, ({NOW_MS} - observed_ms) / 60000 AS age
  FROM current_quotes q LEFT JOIN agreed a USING (game, market, selection) LEFT JOIN disagreed d ON d.game = q.game AND d.market = q.market
  LEFT JOIN (SELECT game, market, bool_or(outlier) AS odd FROM strays GROUP BY ALL) o ON o.game = q.game AND o.market = q.market WHERE q.book = 'hardrock'""")


@query(f"""WITH x AS (SELECT *, CAST(20 + snapshot_id % 60 AS DOUBLE) / 100 AS p_low, CAST(snapshot_id % 15 AS DOUBLE) / 100 AS uncertainty, snapshot_id % 6 = 0 AS reduced FROM target_rows),
y AS (SELECT *, p_low - coalesce(fair, 0) AS edge, p_low * {dec('american')} - 1 AS ev FROM x),
r AS (SELECT game, market, selection, edge, ev, list_filter([CASE WHEN age > 14400 THEN 'stale-offered-price' END, CASE WHEN reduced THEN 'analysis-reduced' END, CASE WHEN fair IS NULL THEN 'insufficient-comparison-books' END,
  CASE WHEN odd THEN 'comparison-outlier-excluded' END, CASE WHEN uncertainty > 0.1e0 THEN 'uncertainty-above-threshold' END, CASE WHEN coalesce(score, 0) >= 0.1e0 THEN 'market-disagreement-blocked' END,
  CASE WHEN coalesce(score, 0) >= 0.05e0 AND coalesce(score, 0) < 0.1e0 THEN 'market-disagreement-warning' END, CASE WHEN edge < 0.015e0 THEN 'edge-below-threshold' END, CASE WHEN ev < 0.02e0 THEN 'ev-below-threshold' END], lambda r: r IS NOT NULL) AS reasons FROM y),
z AS (SELECT *, len(list_filter(reasons, lambda r: r NOT IN ('comparison-outlier-excluded', 'market-disagreement-warning'))) = 0 AS plays FROM r)
SELECT game, market, selection, round(edge, 9) AS edge, round(ev, 9) AS ev, CASE WHEN plays THEN 'play' ELSE 'no-bet' END AS decision,
  array_to_string(list_sort(CASE WHEN plays THEN list_append(reasons, 'positive-ev-qualified') ELSE reasons END), ',') AS reasons FROM z""")
def evaluation_qualification(t):
    rows = _targets(t).withColumns(
        {"p_low": F.expr("CAST(20 + snapshot_id % 60 AS DOUBLE) / 100"), "uncertainty": F.expr("CAST(snapshot_id % 15 AS DOUBLE) / 100"), "reduced": F.col("snapshot_id") % 6 == 0}
    )
    own = Q.qualify_evaluation(rows, POLICY)
    return own.select(*MARKET, "selection", F.round("edge", 9).alias("edge"), F.round("ev", 9).alias("ev"), "decision", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH c AS (SELECT game, market, list(DISTINCT reason) AS cr FROM excluded WHERE book <> 'hardrock' AND reason IS NOT NULL GROUP BY ALL),
x AS (SELECT t.*, g.status AS event_status, t.market = 'moneyline' AS approved, t.game % 8 <> 0 AS healthy, coalesce(c.cr, []) AS cr, t.fair * {dec('t.american')} - 1 AS ev
  FROM target_rows t JOIN games g ON g.game = t.game LEFT JOIN c ON c.game = t.game AND c.market = t.market),
r AS (SELECT game, market, selection, ev, list_sort(list_filter([CASE WHEN event_status <> 'scheduled' THEN 'event-not-scheduled' END, CASE WHEN NOT approved THEN 'market-not-approved' END, CASE WHEN NOT healthy THEN 'target-provider-unhealthy' END,
  CASE WHEN state = 'suspended' THEN 'target-suspended' END, CASE WHEN state = 'unavailable' THEN 'target-unavailable' END, CASE WHEN age > 14400 THEN 'target-stale' END,
  CASE WHEN level = 'block' THEN 'market-disagreement-blocked' END, CASE WHEN fair IS NULL THEN 'insufficient-comparison-books' END, CASE WHEN fair IS NULL AND list_contains(cr, 'stale') THEN 'comparison-stale' END,
  CASE WHEN fair IS NULL AND list_contains(cr, 'missing-selection') THEN 'comparison-incomplete' END, CASE WHEN ev < 0.02e0 THEN 'ev-below-threshold' END], lambda r: r IS NOT NULL)) AS reasons,
  list_sort(list_filter([CASE WHEN odd THEN 'comparison-outlier-excluded' END, CASE WHEN level = 'warning' THEN 'market-disagreement-warning' END], lambda r: r IS NOT NULL)) AS warnings FROM x)
SELECT game, market, selection, round(ev, 9) AS ev, CASE WHEN len(reasons) > 0 THEN 'disqualified' ELSE 'qualified' END AS verdict, array_to_string(reasons, ',') AS reasons, array_to_string(warnings, ',') AS warnings FROM r""")
def opportunity_qualification(t):
    games = t.games.select("game", F.col("status").alias("event_status"))
    rows = _targets(t).join(games, "game").withColumns({"approved": F.col("market") == "moneyline", "healthy": F.col("game") % 8 != 0})
    own = Q.qualify_opportunity(rows, POLICY)
    return own.select(*MARKET, "selection", F.round("ev", 9).alias("ev"), "verdict", F.array_join("reasons", ",").alias("reasons"), F.array_join("warnings", ",").alias("warnings"))


@query(f"""WITH b AS (SELECT game, market, book, count(DISTINCT selection) = max(n) AS complete, min(observed_ms) AS oldest, max(observed_ms) AS newest
  FROM (SELECT *, count(DISTINCT selection) OVER (PARTITION BY game, market) AS n FROM current_quotes) GROUP BY ALL),
g AS (SELECT game, market, count(*) FILTER (book <> 'hardrock' AND complete) AS books, count(*) FILTER (book = 'hardrock' AND complete) AS offered, max(newest) AS newest,
  bool_or(book = 'hardrock' AND ({NOW_MS} - oldest) / 60000 > 14400) AS os, count(*) FILTER (book <> 'hardrock' AND complete AND ({NOW_MS} - oldest) / 60000 > 14400) AS cs, count(*) FILTER (book <> 'hardrock' AND NOT complete) AS ci FROM b GROUP BY ALL),
r AS (SELECT game, market, books, list_filter([CASE WHEN newest > {NOW_MS} THEN 'evidence-from-future' END, CASE WHEN offered = 0 THEN 'offered-missing' END, CASE WHEN os THEN 'offered-stale' END, CASE WHEN books < 3 THEN 'comparison-sparse' END,
  CASE WHEN cs > 0 THEN 'comparison-stale' END, CASE WHEN ci > 0 THEN 'comparison-incomplete' END], lambda r: r IS NOT NULL) AS reasons FROM g)
SELECT game, market, books, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS valid FROM r""")
def evaluation_evidence(t):
    return Q.evidence_gate(current_quotes(t.quotes), "hardrock", NOW_MS, 14400, 3).withColumn("reasons", F.array_join("reasons", ","))


@query("""SELECT id, low >= 0 AND low <= p AND p <= high AND high <= 1 AND high - low <= 0.3e0 AND u <= 0.1e0 AND abs(u - (high - low) / 2) <= 1e-9 AS valid
FROM (SELECT id, p, p - 0.05e0 AS low, p + CASE WHEN game % 3 = 0 THEN 0.15e0 ELSE 0.05e0 END AS high, CASE WHEN game % 3 = 0 THEN 0.1e0 ELSE CASE WHEN game % 4 = 0 THEN 0.07e0 ELSE 0.05e0 END END AS u FROM decisions)""")
def model_probability_gate(t):
    third = F.col("game") % 3 == 0
    low, high = F.col("p") - 0.05, F.col("p") + F.when(third, 0.15).otherwise(0.05)
    u = F.when(third, 0.1).otherwise(F.when(F.col("game") % 4 == 0, 0.07).otherwise(0.05))
    return t.decisions.select("id", Q.model_probability_valid(low, F.col("p"), high, u).alias("valid"))


@query("""SELECT game, market, book, count(*) = 2 AND CASE market WHEN 'moneyline' THEN count(point) = 0 ELSE count(point) = count(*) AND abs(sum(point)) < 1e-9 END AS coherent FROM current_quotes GROUP BY game, market, book""")
def point_coherence(t):
    return Q.coherent_points(current_quotes(t.quotes), [*MARKET, "book"])


@query("SELECT game, market, book, bool_and(observed_ms <= retrieved_ms) AND max(observed_ms) - min(observed_ms) <= 15 * 60000 AS coherent FROM current_quotes GROUP BY ALL")
def window_coherence(t):
    return Q.coherent_window(current_quotes(t.quotes), [*MARKET, "book"])


@query("""SELECT game, market, book FROM current_quotes GROUP BY ALL HAVING list_sort(list(selection)) = ['away', 'home'] AND coalesce(abs(sum(point)), 0) <= 1e-9""")
def complete_main_prices(t):
    return Q.complete_prices(current_quotes(t.quotes), [*MARKET, "book"], ["away", "home"])


part("live_quotes", "SELECT * FROM current_quotes WHERE state = 'active'")
part("best_quotes", f"""SELECT game, market, selection, book, american, {dec('american')} AS decimal FROM live_quotes
  QUALIFY row_number() OVER (PARTITION BY game, market, selection ORDER BY {dec('american')} DESC, book) = 1""")
part("findings", """SELECT game, market, sum(1 / decimal) AS total, (sum(1 / decimal) - 1) * 100 AS hold, CASE WHEN sum(1 / decimal) < 1 THEN 'arbitrage' WHEN sum(1 / decimal) < 1.01e0 THEN 'low-hold' ELSE 'none' END AS kind
  FROM best_quotes GROUP BY ALL HAVING count(*) = 2""")


def _live(t):
    return current_quotes(t.quotes).where("state = 'active'")


@query("SELECT game, market, selection, book, american, round(decimal, 9) AS decimal FROM best_quotes")
def best_price(t):
    return A.best_prices(_live(t), [*MARKET, "selection"]).withColumn("decimal", F.round("decimal", 9))


@query("SELECT game, market, round(total, 9) AS total, round(hold, 7) AS hold, kind FROM findings")
def arbitrage_scan(t):
    return A.arbitrage(_live(t)).withColumns({"total": F.round("total", 9), "hold": F.round("hold", 7)})


@query("""SELECT game, market, round(hold, 7) AS hold, kind, (SELECT count(*) FROM findings WHERE kind <> 'none') AS total_count FROM findings WHERE kind <> 'none' ORDER BY round(hold, 9), game, market LIMIT 12""")
def arbitrage_board(t):
    found = A.arbitrage(_live(t)).where("kind <> 'none'").withColumn("hold", F.round("hold", 9))
    return A.board(found).select(*MARKET, F.round("hold", 7).alias("hold"), "kind", "total_count")


@query(f"""WITH x AS (SELECT game, market, selection, book, american, row_number() OVER (PARTITION BY game, market, selection ORDER BY {dec('american')} DESC, book) AS k FROM live_quotes)
SELECT game, market, selection, max(CASE WHEN k = 1 THEN book END) AS best_book, max(CASE WHEN k = 1 THEN american END) AS best_american,
  coalesce(string_agg(book || ':' || american, ',' ORDER BY book) FILTER (k > 1), '') AS competing FROM x GROUP BY ALL""")
def arbitrage_legs(t):
    leg = A.legs(_live(t)).select(*MARKET, F.explode("legs").alias("leg"))
    shown = F.array_join(F.transform("leg.competing", lambda q: F.concat_ws(":", q["book"], q["american"])), ",")
    return leg.select(*MARKET, F.col("leg.selection"), F.col("leg.best.book").alias("best_book"), F.col("leg.best.american").alias("best_american"), shown.alias("competing"))


@query(f"""SELECT game, market, kind, oldest + 14400 * 60000 AS expires_ms FROM findings JOIN (SELECT game, market, min(observed_ms) AS oldest FROM live_quotes GROUP BY ALL) USING (game, market)
WHERE kind <> 'none' AND oldest + 14400 * 60000 > {NOW_MS}""")
def arbitrage_unexpired(t):
    live = _live(t)
    oldest = live.groupBy(*MARKET).agg(F.min("observed_ms").alias("oldest"))
    found = A.arbitrage(live).where("kind <> 'none'").join(oldest, MARKET)
    return found.select(*MARKET, "kind", (F.col("oldest") + 14400 * 60000).alias("expires_ms")).where(F.col("expires_ms") > NOW_MS)


@query("""SELECT game, market, selection, book, state FROM quotes QUALIFY row_number() OVER (PARTITION BY game, market, selection, book ORDER BY observed_ms DESC, state <> 'active' DESC, snapshot_id DESC) = 1""")
def latest_availability(t):
    return current_availability(t.quotes).select(*MARKET, "selection", "book", "state")


@query("SELECT snapshot_id, game, market, selection, book, american, observed_ms FROM current_quotes")
def current_snapshots(t):
    return current_quotes(t.quotes).select("snapshot_id", *MARKET, "selection", "book", "american", "observed_ms")


# current prices: a book listed twice in some games, sides missing in others, up to four in a few
part("listed_prices", """SELECT game, market, book, selection FROM current_quotes WHERE NOT (game % 11 = 4 AND selection = 'home') UNION ALL SELECT game, market, book, selection FROM current_quotes WHERE game % 7 = 2 AND book = 'draftkings'
  UNION ALL SELECT game, market, book, selection || s FROM current_quotes CROSS JOIN (VALUES ('-alt')) x(s) WHERE game % 13 IN (3, 5) AND (game % 13 = 3 OR selection = 'home')""")


@query("""WITH r AS (SELECT game, market, book, selection, count(*) AS n FROM listed_prices GROUP BY ALL), m AS (SELECT game, market, count(DISTINCT selection) NOT BETWEEN 2 AND 3 AS bad, max(n) > 1 AS twice FROM r GROUP BY ALL)
SELECT game, market, array_to_string(list_filter([CASE WHEN bad THEN 'invalid-market' END, CASE WHEN twice THEN 'duplicate-sportsbook' END], lambda r: r IS NOT NULL), ',') AS issues, NOT bad AND NOT twice AS valid FROM m""")
def market_validity(t):
    """Markets of current prices; a book that has a selection twice, and fewer than two or more than three selections, are wrong."""
    return C.market_validity(_listed(current_quotes(t.quotes))).withColumn("issues", F.array_join("issues", ","))


def _listed(now):
    now, game = now.select("game", "market", "book", "selection"), F.col("game")
    odd = now.where((game % 13).isin(3, 5) & ((game % 13 == 3) | (F.col("selection") == "home"))).withColumn("selection", F.concat("selection", F.lit("-alt")))
    return now.where("NOT (game % 11 = 4 AND selection = 'home')").unionByName(now.where("game % 7 = 2 AND book = 'draftkings'")).unionByName(odd)


@query(f"""SELECT q.snapshot_id, a.probability IS NOT NULL AS available, round({dec('q.american')} * a.probability - 1, 9) AS price_clv, round(a.probability - {implied('q.american')}, 9) AS probability_clv
FROM quotes q LEFT JOIN agreed a USING (game, market, selection) WHERE q.book = 'hardrock'""")
def consensus_clv(t):
    """Closing line value of the target's quotes against the consensus of the others' last prices; null without one."""
    from pricelens.operators.closing import price_clv, probability_clv

    agreed = C.consensus(_rows(t)).select(*MARKET, "selection", "probability")
    both = t.quotes.where("book = 'hardrock'").join(agreed, [*MARKET, "selection"], "left")
    p, a = F.col("probability"), F.col("american")
    return both.select("snapshot_id", p.isNotNull().alias("available"), F.round(price_clv(p, a), 9).alias("price_clv"), F.round(probability_clv(p, a), 9).alias("probability_clv"))
