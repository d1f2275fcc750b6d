"""Queries on what boards show."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelens.operators import serving as S
from pricelens.operators.latest import current_quotes, latest_by
from pricelens.plans.facts import DAY_MS, FIRST_MS, NOW_MS
from pricelens.plans.registry import part, query

ROSTER = ["hardrock", "draftkings", "fanduel", "betmgm"]
MIDDLE_MS, GRACE_MS, OLD_MS, SKEW_MS = FIRST_MS + 15 * DAY_MS, 4 * 3_600_000, 5 * DAY_MS, 60_000

# totals where a spread's game is every third; games without quotes beside those with; closes from the last quotes before start
part("market_quotes", "SELECT * REPLACE (CASE WHEN market = 'spread' AND game % 3 = 1 THEN 'total' ELSE market END AS market, CASE WHEN market = 'spread' AND game % 3 = 1 THEN abs(point) ELSE point END AS point) FROM current_quotes")
part("board_games", f"SELECT game, version, CASE WHEN status = 'scheduled' OR start_ms > {MIDDLE_MS} THEN 'scheduled' ELSE status END AS status, start_ms FROM games UNION ALL SELECT game + 1000000, version, 'scheduled', start_ms FROM games WHERE game % 4 = 0")
part("closes", f"""SELECT game, CASE WHEN game % 4 = 1 THEN 1 ELSE 2 END AS version, market, selection, book, american + 1 AS american, point, book <> 'draftkings' AS final, CASE WHEN game % 10 = 7 THEN 'failed' ELSE 'ok' END AS state
  FROM market_quotes WHERE game % 3 > 0 OR book = 'fanduel'""")


def _complete(quotes: str) -> str:
    return f"""SELECT * FROM (SELECT game, market, book, list(struct_pack(selection := selection, american := american, point := point) ORDER BY selection) AS prices FROM {quotes} WHERE book IN {tuple(ROSTER)} GROUP BY ALL
  HAVING count(*) = 2 AND count(DISTINCT selection) = 2 AND CASE WHEN market = 'moneyline' THEN count(point) = 0 WHEN market = 'total' THEN count(point) = 2 AND max(point) - min(point) <= 1e-9 ELSE count(point) = 2 AND abs(sum(point)) <= 1e-9 END)
  QUALIFY row_number() OVER (PARTITION BY game, market ORDER BY list_position({ROSTER}, book)) = 1"""


def _tables(t):
    own = current_quotes(t.quotes)
    total = (F.col("market") == "spread") & (F.col("game") % 3 == 1)
    quotes = own.withColumns({"market": F.when(total, "total").otherwise(F.col("market")), "point": F.when(total, F.abs("point")).otherwise(F.col("point"))})
    status = F.when((F.col("status") == "scheduled") | (F.col("start_ms") > MIDDLE_MS), "scheduled").otherwise(F.col("status"))
    games = t.games.select("game", "version", status.alias("status"), "start_ms")
    games = games.unionByName(t.games.where("game % 4 = 0").select((F.col("game") + 1_000_000).alias("game"), "version", F.lit("scheduled").alias("status"), "start_ms"))
    closes = quotes.where("game % 3 > 0 OR book = 'fanduel'").select(
        "game", F.when(F.col("game") % 4 == 1, 1).otherwise(2).alias("version"), "market", "selection", "book", (F.col("american") + 1).alias("american"), "point", (F.col("book") != "draftkings").alias("final"),
        F.when(F.col("game") % 10 == 7, "failed").otherwise("ok").alias("state"),
    )
    return games, quotes, closes


@query(f"""WITH priced_now AS (SELECT q.* FROM market_quotes q JOIN board_games g USING (game) WHERE q.version >= g.version - 1 AND q.state = 'active' AND q.observed_ms <= q.retrieved_ms),
final_closes AS (SELECT c.* FROM closes c JOIN board_games g USING (game) WHERE c.version = g.version AND final AND state = 'ok'), now AS ({_complete('priced_now')}), close AS ({_complete('final_closes')}),
grid AS (SELECT g.*, m.market, n.book AS nb, n.prices AS np, c.book AS cb, c.prices AS cp, EXISTS (SELECT 1 FROM closes f WHERE f.game = g.game AND f.state = 'failed') AS failed, g.status <> 'scheduled' AND start_ms <= {MIDDLE_MS} AS begun
  FROM board_games g CROSS JOIN (SELECT unnest({list(S.MARKETS)}) AS market) m LEFT JOIN now n ON n.game = g.game AND n.market = m.market LEFT JOIN close c ON c.game = g.game AND c.market = m.market),
judged AS (SELECT *, CASE WHEN begun AND failed THEN 'withheld' WHEN begun AND cb IS NOT NULL THEN 'close' WHEN nb IS NOT NULL THEN 'current' ELSE 'none' END AS source, bool_or(nb IS NOT NULL OR cb IS NOT NULL) OVER (PARTITION BY game) AS priced FROM grid)
SELECT game, market, status, source, CASE source WHEN 'close' THEN cb WHEN 'current' THEN nb END AS book, CASE source WHEN 'close' THEN cp WHEN 'current' THEN np END[1].american AS first_price, CASE source WHEN 'close' THEN cp WHEN 'current' THEN np END[2].point AS second_point
FROM judged WHERE NOT (status = 'scheduled' AND start_ms < {MIDDLE_MS - GRACE_MS} AND NOT priced)""")
def served_markets(t):
    """Games as of the middle of the month with moneyline, spread and total of the book served, current or closing."""
    own = S.served_markets(*_tables(t), ROSTER, MIDDLE_MS, GRACE_MS)
    at = lambda k, c: F.get("prices", F.lit(k))[c]
    return own.select("game", "market", "status", "source", "book", at(0, "american").alias("first_price"), at(1, "point").alias("second_point"))


part("grid_cells", f"""SELECT x.*, q.american, q.point, q.observed_ms FROM (SELECT DISTINCT game, sport, m.market, selection, b.book FROM (SELECT DISTINCT game, market, selection FROM quotes) m JOIN games USING (game) CROSS JOIN (SELECT unnest({ROSTER}) AS book) b) x
  LEFT JOIN (SELECT * REPLACE (CASE WHEN market = 'spread' AND game % 5 = 2 THEN NULL ELSE point END AS point) FROM current_quotes) q ON q.game = x.game AND q.market = x.market AND q.selection = x.selection AND q.book = x.book""")
part("cell_evidence", "SELECT game, market, selection, book, arg_max(state, struct_pack(a := observed_ms, b := snapshot_id)) AS state, max(observed_ms) AS at FROM quotes WHERE snapshot_id % 3 > 0 GROUP BY ALL")
part("group_evidence", "SELECT game, market, book, arg_max(state, struct_pack(a := observed_ms, b := snapshot_id)) AS state, max(observed_ms) AS at FROM quotes WHERE snapshot_id % 4 = 0 AND game % 6 > 0 GROUP BY ALL")
part("judged_cells", f"""SELECT c.*, CASE WHEN c.market = 'moneyline' AND game % 8 = 3 AND sport <> 'soccer' THEN 'market-unsupported' WHEN american IS NULL THEN 'quote-missing' WHEN o.state IS NULL AND g.state IS NULL THEN 'availability-evidence-missing'
  WHEN greatest(c.observed_ms, coalesce(o.at, 0), coalesce(g.at, 0)) > {NOW_MS - DAY_MS + SKEW_MS} THEN 'evidence-ahead' WHEN coalesce(o.state, 'active') <> 'active' OR coalesce(g.state, 'active') <> 'active' THEN 'market-blocked'
  WHEN c.market = 'spread' AND point IS NULL THEN 'point-missing' WHEN {NOW_MS - DAY_MS} - c.observed_ms > {OLD_MS} THEN 'quote-stale' END AS reason, CASE WHEN coalesce(o.state, 'active') <> 'active' THEN o.state ELSE g.state END AS blocker
  FROM grid_cells c LEFT JOIN cell_evidence o USING (game, market, selection, book) LEFT JOIN group_evidence g USING (game, market, book)""")


def _cells(t):
    """The grid a day before the quotes end, where some are ahead of the clock; a moneyline of every eighth game stands for a market of soccer."""
    sports = t.games.select("game", "sport", "status", F.col("fresh_ms").isNotNull().alias("complete"))
    grid = t.quotes.select("game", "market", "selection").distinct().join(sports, "game").withColumn("book", F.explode(F.array(*map(F.lit, ROSTER))))
    point = F.when((F.col("market") == "spread") & (F.col("game") % 5 == 2), F.lit(None)).otherwise(F.col("point"))
    now = current_quotes(t.quotes).select("game", "market", "selection", "book", "american", point.alias("point"), "observed_ms")
    evidence = lambda rows, name, *keys: latest_by(rows, [*keys], ["observed_ms", "snapshot_id"]).select(*keys, F.struct("state", "observed_ms").alias(name))
    own = evidence(t.quotes.where("snapshot_id % 3 > 0"), "own", "game", "market", "selection", "book")
    group = evidence(t.quotes.where("snapshot_id % 4 = 0 AND game % 6 > 0"), "group", "game", "market", "book")
    both = grid.join(now, ["game", "market", "selection", "book"], "left").join(own, ["game", "market", "selection", "book"], "left").join(group, ["game", "market", "book"], "left")
    btts = (F.col("market") == "moneyline") & (F.col("game") % 8 == 3)
    judged = S.cell_states(both.withColumn("was", F.col("market")).withColumn("market", F.when(btts, "btts").otherwise(F.col("market"))), NOW_MS - DAY_MS, OLD_MS, SKEW_MS)
    return judged.withColumn("market", F.col("was")).drop("was")


@query("""SELECT game, market, selection, book, coalesce(reason, '') AS reason, CASE WHEN reason IS NULL THEN 'active' WHEN reason = 'market-blocked' THEN blocker WHEN reason = 'quote-stale' THEN 'stale' ELSE 'unavailable' END AS shown FROM judged_cells""")
def grid_states(t):
    """Every cell of the grid with its state; blockers come before age."""
    return _cells(t).select("game", "market", "selection", "book", F.coalesce("reason", F.lit("")).alias("reason"), "shown")


@query("""SELECT game, status = 'scheduled' AND fresh_ms IS NOT NULL AND bool_and(reason IS NULL) AS qualifies FROM judged_cells JOIN games USING (game) WHERE book = 'hardrock' GROUP BY game, status, fresh_ms""")
def target_qualified(t):
    """Games whose target book has every expected cell active, while the game is scheduled and its metadata complete."""
    return S.target_qualifies(_cells(t), "hardrock")
