"""Boards: games joined to quotes, comparison grids, splits, filters, counts, gaps of evidence and provider states."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.pricing import american_to_decimal, first_reason, implied_probability
from pricelens.functions.text import searchable


def served_games(games: DataFrame, quotes: DataFrame, roster: Sequence[str], sides: int = 2) -> DataFrame:
    """Every game with the prices of the first book of the roster that has a complete coherent market, or none.

    quotes: current ones. Quotes of the game's version or the one before count, if active and observed by retrieval.
    A roster's length is a parameter, so the choice per game is a minimum over as many books at most.
    """
    order = F.array_position(F.array(*map(F.lit, roster)), F.col("q.book"))
    own = games.select("game", "version").alias("g").join(quotes.alias("q"), F.col("g.game") == F.col("q.game"))
    usable = own.where((F.col("q.version") >= F.col("g.version") - 1) & (F.col("q.state") == "active") & (F.col("q.observed_ms") <= F.col("q.retrieved_ms")) & (order > 0))
    per = usable.groupBy("g.game", "q.market", "q.book").agg(F.count("*").alias("n"), F.first(order).alias("place"), F.coalesce(F.abs(F.sum("q.point")), F.lit(0.0)).alias("off"), F.map_from_entries(F.collect_list(F.struct("q.selection", "q.american"))).alias("prices"))
    best = per.where((F.col("n") == sides) & (F.col("off") <= 1e-9)).groupBy("game", "market").agg(F.min_by(F.struct("book", "prices"), "place").alias("b"))
    ml = best.where("market = 'moneyline'").select("game", F.col("b.book").alias("book"), F.col("b.prices").alias("prices"))
    return games.select("game", "status").join(ml, "game", "left")


def comparison_grid(quotes: DataFrame, books: Sequence[str], cells: Sequence[str] = ("game", "market", "selection")) -> DataFrame:
    """Every cell that any book has, for every book of the list, with the book's price or unavailable."""
    grid = quotes.select(*cells).distinct().withColumn("book", F.explode(F.array(*map(F.lit, books))))  # a row for each configured book
    return grid.join(quotes.select(*cells, "book", "american", "point", "state"), [*cells, "book"], "left").withColumn("state", F.coalesce("state", F.lit("unavailable")))


def best_cells(quotes: DataFrame, key: Sequence[str] = ("game", "market", "selection")) -> DataFrame:
    """quotes with best: the better point first (higher; for over the lower; none for moneyline), then the higher odds; all equal cells."""
    point = F.when(F.col("market") == "moneyline", F.lit(0.0)).when((F.col("market") == "total") & (F.col("selection") == "over"), -F.col("point")).otherwise(F.col("point"))
    value = F.struct(F.coalesce(point, F.lit(-1e300)).alias("p"), F.col("american").alias("a"))
    return quotes.withColumn("__v", value).withColumn("best", F.col("__v") == F.max("__v").over(Window.partitionBy(*key))).drop("__v")


def anchored(quotes: DataFrame, sharp: str = "pinnacle") -> DataFrame:
    """Each quote with the sharp book's price of the same cell and point; a missing point equals a missing one."""
    cell = ["game", "market", "selection"]
    anchors = quotes.where((F.col("book") == sharp) & (F.col("state") == "active")).select(*[F.col(c).alias(f"s_{c}") for c in (*cell, "point")], F.col("american").alias("sharp"))
    on = [F.col(c) == F.col(f"s_{c}") for c in cell] + [F.col("point").eqNullSafe(F.col("s_point"))]
    return quotes.join(anchors, on, "left").drop(*[f"s_{c}" for c in (*cell, "point")])


def attach_splits(games: DataFrame, splits: DataFrame) -> DataFrame:
    """Every game with its latest splits by cell, those no newer than the game's version, as a sorted array."""
    s = splits.alias("s").join(games.select("game", F.col("version").alias("gv")).alias("g"), "game").where(F.col("s.version") <= F.col("gv"))
    top = s.groupBy("game", "market", "selection").agg(F.max(F.struct("provider_ms", "retrieved_ms", "id", "bet_percent")).alias("t"))
    per = top.groupBy("game").agg(F.array_sort(F.collect_list(F.struct("market", "selection", F.col("t.bet_percent").alias("bet")))).alias("splits"))
    return games.select("game").join(per, "game", "left").withColumn("splits", F.coalesce("splits", F.array()))


def listed(games: DataFrame, sport: str | None = None, league: str | None = None, statuses: Sequence[str] | None = None, from_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    for column, want in (("sport", sport), ("league", league)):
        games = games if want is None else games.where(F.col(column) == want)
    games = games if statuses is None else games.where(F.col("status").isin(*statuses))
    games = games if from_ms is None else games.where(F.col("start_ms") >= from_ms)
    return games if until_ms is None else games.where(F.col("start_ms") < until_ms)


#: Fixed value: the order of lifecycle states on a list.
LIFECYCLE = ("scheduled", "started", "postponed", "completed", "cancelled", "unknown")


def explore(games: DataFrame, text: str | None, sort: str, descending: bool = False) -> DataFrame:
    """Games either of whose labels holds the text, accents aside, with place: by the key asked for, ties always by id upwards."""
    if text:
        needle = searchable(F.lit(text))
        games = games.where(F.contains(searchable(F.col("home")), needle) | F.contains(searchable(F.col("away")), needle))
    key = {
        "kickoff": F.col("start_ms"), "matchup": F.concat(searchable(F.col("away")), F.lit(" "), searchable(F.col("home"))),
        "competition": F.col("league"), "lifecycle": F.array_position(F.array(*map(F.lit, LIFECYCLE)), F.col("status")), "freshness": F.col("fresh_ms"),
    }[sort]
    return games.withColumn("sort_key", key).orderBy(F.desc_nulls_last("sort_key") if descending else F.asc_nulls_last("sort_key"), "game")


def games_with_edge(target: DataFrame, least: float = 0.05) -> DataFrame:
    """target (game, market, selection, american, sharp): games with any selection whose price beats the fair one by `least` percent.

    Fair prices are the market's sharp ones without margin if every side has one, else its own ones; markets of one side don't count.
    """
    w = Window.partitionBy("game", "market")
    anchored = F.bool_and(F.col("sharp").isNotNull()).over(w)
    rows = target.withColumns({"__p": implied_probability(F.when(anchored, F.col("sharp")).otherwise(F.col("american"))), "__n": F.count("*").over(w)})
    ev = (F.col("__p") / F.sum("__p").over(w) * american_to_decimal(F.col("american")) - 1) * 100
    return rows.withColumn("__ev", ev).where("__n >= 2").groupBy("game").agg(F.max("__ev").alias("best_ev")).where(F.col("best_ev") > least)


def evidence_gaps(expected: DataFrame, quotes: DataFrame, markets: Mapping[str, Sequence[str]], sides: int, now_ms: int, stale_after_ms: int) -> DataFrame:
    """expected (game): the cells of games (expected or seen) by each book's own markets that lack a complete group, with the reason.

    quotes: with unsupported and alternate, booleans. Any active main price makes it an incomplete market; else the first
    of unsupported, closed, suspended, stale that any price is, partial if there are others only, missing if none.
    The grid has as many rows a game as there are configured books and markets.
    """
    cells = F.array(*[F.struct(F.lit(b).alias("book"), F.lit(m).alias("market")) for b, own in markets.items() for m in own])
    grid = expected.select("game").union(quotes.select("game")).distinct().select("game", F.inline(cells))
    stale = F.col("observed_ms") < now_ms - stale_after_ms
    worst = F.when(F.col("unsupported"), 1).when(F.col("state") == "unavailable", 2).when(F.col("state") == "suspended", 3).when(stale, 4)
    good = (F.col("state") == "active") & ~F.col("unsupported") & ~F.col("alternate") & ~stale
    per = quotes.groupBy("game", "book", "market").agg(F.count_if(good).alias("good"), F.count("*").alias("n"), F.min(worst).alias("worst"))
    both = grid.join(per, ["game", "book", "market"], "left").where(F.col("good").isNull() | (F.col("good") < sides))
    # no element_at: of an array of literals it takes the last one for a null place
    named = [(F.col("worst") == k, name) for k, name in enumerate(("unsupported", "closed", "suspended", "stale"), 1)]
    reason = F.coalesce(first_reason((F.col("n").isNull(), "missing"), (F.col("good") > 0, "incomplete-market"), *named), F.lit("partial"))
    return both.select("game", "book", "market", reason.alias("gap"))


def availability_rows(quotes: DataFrame, rejected: DataFrame) -> DataFrame:
    """Availability by cell: suspended and closed as the state says, incomplete for cells of rejected groups."""
    bad = rejected.select("game", "market", "book").distinct().withColumn("__bad", F.lit(True))
    both = quotes.join(bad, ["game", "market", "book"], "left")
    state = F.when(F.col("__bad"), "incomplete").when(F.col("state") == "suspended", "suspended").when(F.col("state") == "unavailable", "closed").otherwise("active")
    return both.withColumn("availability", state).drop("__bad")


def actionable(quotes: DataFrame, selection: DataFrame, group: DataFrame) -> DataFrame:
    """quotes with actionable: both the cell's and the group's latest availability are active and no older than the quote."""
    s = selection.select("game", "market", "selection", "book", F.col("state").alias("s_state"), F.col("observed_ms").alias("s_ms"))
    g = group.select("game", "market", "book", F.col("state").alias("g_state"), F.col("observed_ms").alias("g_ms"))
    both = quotes.join(s, ["game", "market", "selection", "book"], "left").join(g, ["game", "market", "book"], "left")
    fine = lambda k: (F.col(f"{k}_state") == "active") & (F.col(f"{k}_ms") >= F.col("observed_ms"))
    return both.withColumn("actionable", F.coalesce(fine("s") & fine("g"), F.lit(False))).drop("s_state", "s_ms", "g_state", "g_ms")


def reconcile(left: DataFrame, right: DataFrame, key: str, digest: Column, at: str) -> DataFrame:
    """Full outer comparison of two routes by key: missing, extra, same, mismatch (equal times), temporal, indeterminate."""
    a, b = (df.select(F.col(key), digest.alias(f"{s}_digest"), F.col(at).alias(f"{s}_at"), F.lit(True).alias(f"{s}_there")) for df, s in ((left, "l"), (right, "r")))
    both = a.join(b, key, "full_outer")
    kind = (
        F.when(F.col("r_there").isNull(), "missing").when(F.col("l_there").isNull(), "extra").when(F.col("l_digest") == F.col("r_digest"), "same")
        .when(F.col("l_at").isNull() | F.col("r_at").isNull(), "indeterminate").when(F.col("l_at") == F.col("r_at"), "mismatch").otherwise("temporal")
    )
    return both.select(key, kind.alias("kind"))


def rotated(df: DataFrame, key: str, group: Sequence[str], now_ms: int) -> DataFrame:
    """Place of each row in its group's list, turned by the minute: floor(now / 60000) mod n rows to the left."""
    w = Window.partitionBy(*group)
    turn = F.floor(F.lit(now_ms) / 60000)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(key)) - 1
    return df.withColumn("place", F.pmod(i - F.pmod(turn, n), n).cast("long"))


def due(age_ms: Column, to_start_ms: Column, near_ms: int = 3_600_000, near_cadence_ms: int = 60_000, base_cadence_ms: int = 600_000) -> Column:
    """Whether a poll is due: more often within an hour of the start."""
    cadence = F.when((to_start_ms > 0) & (to_start_ms <= near_ms), near_cadence_ms).otherwise(base_cadence_ms)
    return age_ms.isNull() | (age_ms >= cadence)
