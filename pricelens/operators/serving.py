"""What a board shows: the book served for each market of a game, and the state of each cell of its grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions.pricing import first_reason

MARKETS = ("moneyline", "spread", "total")
#: Markets whose cells need a point, and sports that a market is for.
POINTED, ONLY_FOR = ("spread", "total", "team_total"), {"btts": "soccer"}


def complete_books(quotes: DataFrame, roster: Sequence[str], sides: int = 2) -> DataFrame:
    """Of each game and market the first book of the roster with all sides and points that agree: (game, market, book, prices).

    Points agree if they sum to nothing, or, for totals, are one. A side that comes twice makes a book incomplete. prices: an
    array of (selection, american, point) by selection.
    """
    place = F.array_position(F.array(*map(F.lit, roster)), F.col("book"))
    per = quotes.where(place > 0).groupBy("game", "market", "book").agg(
        F.count("*").alias("n"), F.count_distinct("selection").alias("own"), F.count("point").alias("points"), F.abs(F.sum("point")).alias("off"), (F.max("point") - F.min("point")).alias("wide"),
        F.first(place).alias("place"), F.sort_array(F.collect_list(F.struct("selection", "american", "point"))).alias("prices"),
    )
    pointed = F.col("market").isin(*POINTED)
    agree = F.when(~pointed, F.col("points") == 0).otherwise((F.col("points") == sides) & F.when(F.col("market") == "total", F.col("wide") <= 1e-9).otherwise(F.col("off") <= 1e-9))
    good = per.where((F.col("n") == sides) & (F.col("own") == sides) & agree)
    return good.groupBy("game", "market").agg(F.min_by(F.struct("book", "prices"), "place").alias("b")).select("game", "market", "b.*")


def served_markets(games: DataFrame, quotes: DataFrame, closes: DataFrame, roster: Sequence[str], now_ms: int, grace_ms: int) -> DataFrame:
    """A row per game shown and market of MARKETS: source, book and prices.

    Before its start a game shows current prices: those of its version or the one before, active, observed by retrieval.
    From its start on a final close of its very version wins (source close); current prices stay where it has none; if its
    closes can't be read (a row with state failed) prices are withheld. A scheduled game that began more than the grace ago
    and has no prices at all is not shown; one to come is, without prices (none).

    games: (game, version, status, start_ms); quotes: current ones; closes: rows (game, version, market, selection, book,
    american, point, final, state).
    """
    g = games.select("game", "status", "start_ms", F.col("version").alias("gv"))
    usable = quotes.join(g.select("game", "gv"), "game").where((F.col("version") >= F.col("gv") - 1) & (F.col("state") == "active") & (F.col("observed_ms") <= F.col("retrieved_ms")))
    own = closes.join(g.select("game", "gv"), "game")
    final = own.where((F.col("version") == F.col("gv")) & F.col("final") & (F.col("state") == "ok"))
    failed = own.where("state = 'failed'").select("game").distinct().withColumn("failed", F.lit(True))
    now, close = complete_books(usable, roster), complete_books(final, roster)
    grid = g.withColumn("market", F.explode(F.array(*map(F.lit, MARKETS))))  # a row for each market of the list
    both = grid.join(now.select("game", "market", F.struct("book", "prices").alias("now")), ["game", "market"], "left")
    both = both.join(close.select("game", "market", F.struct("book", "prices").alias("close")), ["game", "market"], "left").join(failed, "game", "left")
    begun = (F.col("status") != "scheduled") & (F.col("start_ms") <= now_ms)
    source = F.when(begun & F.col("failed").isNotNull(), "withheld").when(begun & F.col("close").isNotNull(), "close").when(F.col("now").isNotNull(), "current").otherwise("none")
    shown = F.when(source == "close", F.col("close")).when(source == "current", F.col("now"))
    priced = both.groupBy("game").agg(F.bool_or(F.col("now").isNotNull() | F.col("close").isNotNull()).alias("priced"))
    phantom = (F.col("status") == "scheduled") & (F.col("start_ms") < now_ms - grace_ms) & ~F.col("priced")
    judged = both.withColumns({"source": source, "shown": shown}).join(priced, "game").where(~phantom)
    return judged.select("game", "market", "status", "source", "shown.book", "shown.prices")


def cell_states(cells: DataFrame, now_ms: int, most_age_ms: int, skew_ms: int) -> DataFrame:
    """cells with shown and reason; what blocks a cell comes before its age.

    cells: rows with sport, market, american, point, observed_ms (null: no price), own and group: the last availability of the
    cell and of its book's market, structs of state and observed_ms, null if there is none. A cell without any evidence of
    availability is unavailable, whatever its age; a blocker of the cell or of its market holds though the other is active
    and newer; evidence from beyond the clock's skew counts for nothing.
    """
    own, group = F.col("own"), F.col("group")
    blocked = lambda x: F.coalesce(x["state"] != "active", F.lit(False))
    ahead = lambda at: F.coalesce(at > now_ms + skew_ms, F.lit(False))
    other = F.lit(False)
    for market, sport in ONLY_FOR.items():
        other = other | ((F.col("market") == market) & (F.col("sport") != sport))
    kind: Column = F.when(blocked(own), own["state"]).when(blocked(group), group["state"])
    reason = first_reason(
        (other, "market-unsupported"), (F.col("american").isNull(), "quote-missing"), (own.isNull() & group.isNull(), "availability-evidence-missing"), (ahead(F.col("observed_ms")) | ahead(own["observed_ms"]) | ahead(group["observed_ms"]), "evidence-ahead"),
        (kind.isNotNull(), "market-blocked"), (F.col("market").isin(*POINTED) & F.col("point").isNull(), "point-missing"), (now_ms - F.col("observed_ms") > most_age_ms, "quote-stale"),
    )
    judged = cells.withColumn("reason", reason)
    shown = F.when(F.col("reason").isNull(), "active").when(F.col("reason") == "market-blocked", kind).when(F.col("reason") == "quote-stale", "stale").otherwise("unavailable")
    return judged.withColumn("shown", shown)


def target_qualifies(cells: DataFrame, target: str) -> DataFrame:
    """Games with whether the target book qualifies: scheduled, complete, and each of its cells active. cells: of cell_states, with status and complete."""
    own = F.col("book") == target
    good = F.coalesce(F.bool_and(F.when(own, F.col("shown") == "active")), F.lit(False))
    return cells.groupBy("game").agg((good & F.first(F.col("status") == "scheduled") & F.first("complete")).alias("qualifies"))
