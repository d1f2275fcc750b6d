"""Price series: opening and current markers, movement, gaps, downsampling, trailing windows, lifecycle changes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.pricing import american_to_decimal, implied_probability, issues
from pricelens.operators.consensus import ULP

SERIES = ("game", "market", "selection", "book")
ORDER = ("observed_ms", "retrieved_ms", "snapshot_id")


def _key() -> Column:
    return F.struct(*ORDER)


def markers(quotes: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    """quotes with opening and current: whether the row is its series' first or last active point."""
    active = F.when(F.col("state") == "active", _key())
    ends = quotes.groupBy(*series).agg(F.min(active).alias("__first"), F.max(active).alias("__last"))
    joined = quotes.alias("q").join(ends.alias("e"), [F.col(f"q.{c}").eqNullSafe(F.col(f"e.{c}")) for c in series])
    is_end = lambda end: F.coalesce((F.col("q.state") == "active") & (_key_of("q") == F.col(end)), F.lit(False))
    return joined.select("q.*", is_end("__first").alias("opening"), is_end("__last").alias("current"))


def _key_of(alias: str) -> Column:
    return F.struct(*[F.col(f"{alias}.{c}") for c in ORDER])


def movement(quotes: DataFrame, threshold: float, most_gap_minutes: float, series: Sequence[str] = SERIES) -> DataFrame:
    """One row per series: status, issues, opening and latest active price, change of implied probability, direction,
    whether it is significant, and the longest gap between active points.

    A series is ordered by a window, so one key's points meet in one task; keys are cells of one game and book, whose
    number of observations a season bounds.
    """
    w = Window.partitionBy(*series).orderBy(*ORDER)
    active = F.col("state") == "active"
    seen = quotes.where(active).withColumn("gap", (F.col("observed_ms") - F.lag("observed_ms").over(w)) / 60000)
    point = F.struct("snapshot_id", "american", "point")
    own = seen.groupBy(*series).agg(
        F.count("*").alias("n_active"), F.min_by(point, _key()).alias("opening"), F.max_by(point, _key()).alias("latest"), F.max("gap").alias("gap"),
        F.count_distinct(F.coalesce(F.col("point").cast("string"), F.lit("-"))).alias("lines"),
    )
    last = quotes.groupBy(*series).agg(F.max_by("state", _key()).alias("current_state"))
    both = last.alias("l").join(own.alias("o"), [F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}")) for c in series], "left")
    n, gap = F.coalesce("o.n_active", F.lit(0)), F.col("o.gap")
    inactive, few = F.col("l.current_state") != "active", n < 2
    usable = ~inactive & ~few
    exceeded, changed = usable & (gap > most_gap_minutes * (1 + 2 * ULP)), usable & (F.col("o.lines") > 1)
    found = issues((changed, "line-changed"), (inactive, "current-observation-inactive"), (few, "insufficient-active-observations"), (exceeded, "history-gap-exceeded"))
    priced = usable & ~changed
    before, after = F.col("o.opening.american"), F.col("o.latest.american")
    delta = F.when(priced, implied_probability(after) - implied_probability(before))
    direction = F.when(delta > 0, "shortened").when(delta < 0, "lengthened").when(priced, "unchanged")
    return both.select(
        *[F.col(f"l.{c}") for c in series], F.when(priced, "available").otherwise("unavailable").alias("status"), found.alias("issues"), "l.current_state",
        n.alias("n_active"), F.col("o.opening.snapshot_id").alias("opening_id"), F.col("o.latest.snapshot_id").alias("latest_id"),
        F.when(usable, gap).alias("gap_minutes"), F.when(usable, F.col("o.latest.point") - F.col("o.opening.point")).alias("point_delta"),
        F.when(priced, after - before).alias("american_delta"), delta.alias("probability_delta"), direction.alias("direction"),
        (F.abs(delta) >= threshold * (1 - 2 * ULP)).alias("significant"),
    )


def change_of(quotes: DataFrame, series: Sequence[str] = SERIES, **values: Column) -> DataFrame:
    """Last less first active value of each series, for each of the values by name, in one aggregation."""
    own = quotes.where("state = 'active'").withColumn("__v", F.struct(*[x.alias(k) for k, x in values.items()]))
    ends = own.groupBy(*series).agg(F.min_by("__v", _key()).alias("__first"), F.max_by("__v", _key()).alias("__last"))
    return ends.select(*series, *[(F.col(f"__last.{k}") - F.col(f"__first.{k}")).alias(k) for k in values])


def trailing(quotes: DataFrame, hours: float, key: Sequence[str] = ("game", "market", "selection")) -> DataFrame:
    """The rows within `hours` before their selection's latest observation."""
    latest = quotes.groupBy(*key).agg(F.max("observed_ms").alias("__latest"))
    return quotes.join(latest, list(key)).where(F.col("observed_ms") >= F.col("__latest") - int(hours * 3_600_000)).drop("__latest")


def downsample(quotes: DataFrame, limit: int, series: Sequence[str] = SERIES) -> DataFrame:
    """At most `limit` points a series: both ends, every turn from active to inactive, and others at even strides.

    If ends and turns alone are more than the limit, all of them stay. Down-sampling for a chart is the feature here.
    """
    w, whole = Window.partitionBy(*series).orderBy(*ORDER), Window.partitionBy(*series)
    before = F.lag("state").over(w)
    numbered = quotes.withColumns({"__i": F.row_number().over(w), "__n": F.count("*").over(whole), "__turn": (F.col("state") != "active") & (before.isNull() | (before == "active"))})
    needed = (F.col("__i") == 1) | (F.col("__i") == F.col("__n")) | F.col("__turn")
    marked = numbered.withColumn("__needed", needed)
    free = Window.partitionBy(*series, "__needed").orderBy("__i")
    marked = marked.withColumns({"__free": F.row_number().over(free) - 1, "__required": F.count_if("__needed").over(whole)})
    spare, others = F.lit(limit) - F.col("__required"), F.col("__n") - F.col("__required")
    # the free point j is taken if some k < spare has floor(k / spare * others) = j
    k = F.ceil(F.col("__free") * spare / F.greatest(others, F.lit(1)))
    taken = (spare > 0) & (k < spare) & (F.floor(k * others / F.greatest(spare, F.lit(1))) == F.col("__free"))
    return marked.where((F.col("__n") <= limit) | F.col("__needed") | taken).drop("__i", "__n", "__turn", "__needed", "__free", "__required")


#: Fixed value: how far a game has got in each phase.
PHASE_RANKS = {"unknown": 0, "pregame": 1, "delayed": 1, "live": 2, "break": 2, "final": 3}


def phase_changes(states: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each observation of a game's state with the kinds of change since the one before, in fixed order."""
    w = Window.partitionBy(*key).orderBy(*order)
    state = ("phase", "away_score", "home_score", "terminal")
    before = {c: F.lag(c).over(w) for c in (*state, "agreed_ms")}
    rank = lambda c: F.coalesce(F.create_map(*[F.lit(x) for kv in PHASE_RANKS.items() for x in kv])[c], F.lit(0))
    own = states.withColumns({f"__{c}": x for c, x in before.items()} | {"__seen": F.lag(F.lit(True)).over(w)})
    now, was, seen = F.col("phase"), F.col("__phase"), F.col("__seen").isNotNull()
    differs = seen & ~reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in state])
    ended, had_ended = F.col("terminal"), F.col("__terminal")
    kinds = issues(
        (~seen, "first-seen"),
        (differs, "changed"),
        (seen & ~had_ended & ended, "terminal-clock-first-seen"),
        (differs & had_ended & ended, "terminal-clock-revised"),
        (seen & had_ended & ~ended, "terminal-clock-disappeared"),
        (seen & (was != "break") & (now == "break"), "period-break"),
        (seen & was.isin("break", "delayed") & (now == "live"), "resumed"),
        (seen & (was != "delayed") & (now == "delayed"), "delayed"),
        (seen & (was != "final") & (now == "final"), "first-final"),
        (differs & (was == "final") & (now == "final"), "final-revised"),
        (seen & (rank(now) < rank(was)), "phase-regressed"),
        (F.col("agreed_ms") < F.col("__agreed_ms"), "provider-time-regressed"),
    )
    return own.withColumn("kinds", kinds).drop("__seen", *[f"__{c}" for c in before])


def decimal_change(quotes: DataFrame) -> DataFrame:
    return change_of(quotes, delta=american_to_decimal(F.col("american")))
