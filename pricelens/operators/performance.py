"""Performance of decisions: counts, returns, intervals, calibration, closing line value, drawdown, slices, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.pricing import american_to_decimal, break_even_probability, implied_probability
from pricelens.operators.closing import ratio_clv

#: Fixed value: the normal quantile of a two-sided 95 % interval.
Z = 1.959963984540054
OUTCOMES = ("won", "lost", "push", "void", "unresolved")


def profit_of(outcome: Column, american: Column) -> Column:
    return F.when(outcome == "won", american_to_decimal(american) - 1).when(outcome == "lost", -1.0).otherwise(0.0)


def wilson(won: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % interval of a rate, held to 0..1; null for no trials."""
    p, z2 = F.try_divide(won, n), Z * Z
    middle = F.try_divide(p + F.try_divide(F.lit(z2), 2 * n), 1 + F.try_divide(F.lit(z2), n))
    half = F.try_divide(Z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z2), 4 * n * n)), 1 + F.try_divide(F.lit(z2), n))
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)


def counts(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per key: a count for each outcome, decisions (won and lost), exposure (with pushes), units, roi."""
    agg = df.groupBy(*keys).agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES], F.coalesce(F.sum("profit"), F.lit(0.0)).alias("units")
    )
    own = agg.withColumns({"decisions": F.col("won") + F.col("lost"), "exposure": F.col("won") + F.col("lost") + F.col("push")})
    return own.withColumn("roi", F.try_divide("units", "exposure"))


def report(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """df (outcome, profit, p, american, closing_american) by key: the whole report in one aggregation.

    Means of odds, break-even and expected value go over all decisions; Brier over won and lost; each expected value is
    rounded to 12 places before the mean.
    """
    settled = F.col("outcome").isin("won", "lost", "push")
    decided = F.col("outcome").isin("won", "lost")
    d = american_to_decimal(F.col("american"))
    won = F.when(F.col("outcome") == "won", 1.0).otherwise(0.0)
    agg = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("outcome") == "won").alias("won"), F.count_if(decided).alias("decisions"), F.count_if(settled).alias("exposure"),
        F.sum(F.when(settled, F.col("profit"))).alias("units"), F.var_samp(F.when(settled, F.col("profit"))).alias("variance"),
        F.avg(d).alias("mean_odds"), F.avg(break_even_probability(F.col("american"))).alias("break_even"), F.avg(F.round(F.col("p") * d - 1, 12)).alias("mean_ev"),
        F.avg(F.when(decided, F.pow(F.col("p") - won, F.lit(2)))).alias("brier"), F.count("closing_american").alias("n_clv"),
        F.avg(ratio_clv(F.col("american"), F.col("closing_american"))).alias("price_clv"),
        F.avg(implied_probability(F.col("closing_american")) - implied_probability(F.col("american"))).alias("probability_clv"),
    )
    mean = F.try_divide("units", "exposure")
    half = F.when(F.col("exposure") >= 2, Z * F.sqrt(F.try_divide("variance", "exposure")))
    low, high = wilson(F.col("won"), F.col("decisions"))
    caution = F.when(F.col("decisions") < 30, "insufficient").when(F.col("decisions") < 100, "limited").otherwise("established")
    return agg.withColumns(
        {
            "roi": mean, "roi_low": mean - half, "roi_high": mean + half, "win_rate": F.try_divide("won", "decisions"),
            "win_low": low, "win_high": high, "caution": caution,
        }
    ).drop("variance")


def calibration(df: DataFrame) -> DataFrame:
    """Ten rows, empty buckets too: bucket, n, mean forecast, observed rate."""
    own = df.where(F.col("outcome").isin("won", "lost")).groupBy(F.least(F.lit(9), F.floor(F.col("p") * 10)).cast("long").alias("bucket"))
    found = own.agg(F.count("*").alias("n"), F.avg("p").alias("forecast"), F.avg((F.col("outcome") == "won").cast("double")).alias("observed"))
    return df.sparkSession.range(10).withColumnRenamed("id", "bucket").join(F.broadcast(found), "bucket", "left").fillna(0, ["n"])


def calibration_error(buckets: DataFrame) -> DataFrame:
    return buckets.agg(F.try_divide(F.sum(F.col("n") * F.abs(F.col("observed") - F.col("forecast"))), F.sum("n")).alias("error"))


def cumulative(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Running units per key over settled decisions, and the drawdown from the running peak, which starts at 0.

    A running sum needs a key's rows in one order; accounts are many, and one account's decisions fit a task.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = df.where(F.col("outcome").isin("won", "lost", "push")).withColumn("running", F.sum("profit").over(w))
    return running.withColumn("drawdown", F.greatest(F.lit(0.0), F.max("running").over(w)) - F.col("running"))


def cumulative_by_day(df: DataFrame, at_ms: str) -> DataFrame:
    """Running units of the whole table by day: sums per day first, so the one unpartitioned window has a row a day."""
    day = F.floor(F.col(at_ms) / 86_400_000).alias("day")
    days = df.where(F.col("outcome").isin("won", "lost", "push")).groupBy(day).agg(F.sum("profit").alias("units"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    running = days.withColumn("running", F.sum("units").over(w))
    return running.withColumn("drawdown", F.greatest(F.lit(0.0), F.max("running").over(w)) - F.col("running"))


def slices(df: DataFrame) -> DataFrame:
    """Grouping sets (), (sport), (league), (market): counts by outcome; units and roi on the overall row only."""
    sets = df.groupingSets([[], ["sport"], ["league"], ["market"]], "sport", "league", "market").agg(
        F.grouping_id().alias("level"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES], F.sum("profit").alias("units")
    )
    overall = F.col("level") == 7
    exposure = F.col("won") + F.col("lost") + F.col("push")
    kind = F.when(overall, "overall").when(F.col("level") == 3, "sport").when(F.col("level") == 5, "league").otherwise("market")
    return sets.select(
        kind.alias("slice"), F.coalesce("sport", "league", "market", F.lit("all")).alias("value"), *OUTCOMES,
        F.when(overall, F.col("units")).alias("units"), F.when(overall, F.try_divide("units", exposure)).alias("roi"),
    )


def promotion_gates(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """gates (metric, operator, threshold) against metrics (metric, value): passed; a missing metric fails."""
    both = gates.join(metrics, "metric", "left")
    v, t = F.col("value"), F.col("threshold")
    holds = F.when(F.col("operator") == "gte", v >= t).when(F.col("operator") == "gt", v > t).when(F.col("operator") == "lte", v <= t).when(F.col("operator") == "lt", v < t)
    return both.withColumn("passed", F.coalesce(holds, F.lit(False)))


def overlapping_windows(windows: DataFrame) -> DataFrame:
    """windows (name, from_ms, until_ms): those out of order, and those that begin before an earlier one ends."""
    w = Window.partitionBy("experiment").orderBy("from_ms", "name").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max("until_ms").over(w)
    return windows.withColumn(
        "issue", F.when(F.col("from_ms") >= F.col("until_ms"), "window-order").when(F.col("from_ms") < before, "window-overlap")
    )


def verify(claims: DataFrame, computed: DataFrame, keys: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """claims (keys, metric, value) recomputed: verified, mismatch or unknown-metric, by a relative tolerance of at least 1."""
    both = claims.join(computed.withColumnRenamed("value", "recomputed"), [*keys, "metric"], "left")
    near = F.abs(F.col("value") - F.col("recomputed")) <= tolerance * F.greatest(F.lit(1.0), F.abs(F.col("recomputed")))
    return both.withColumn("check", F.when(F.col("recomputed").isNull(), "unknown-metric").when(near, "verified").otherwise("mismatch"))


def median_of(df: DataFrame, key: str, value: str, cells: int = 4096) -> DataFrame:
    """(key, n, median) of the values that are not null, exactly, without gathering a key's values.

    Values are counted by cell between the key's least and largest, which tells the cell of the middle ranks; only the
    distinct values of that cell, with their counts, are then ordered. Few keys are expected: the cells of all are `cells`
    times as many at most, and one or two a key are joined back.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    ends = rows.groupBy(key).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.sum("__n").alias("__all"))
    cell = F.coalesce(F.floor(F.try_divide(F.col("__v") - F.col("__lo"), F.col("__hi") - F.col("__lo")) * cells), F.lit(0))
    placed = rows.join(ends, key).withColumn("__cell", cell)
    counts = placed.groupBy(key, "__cell", "__all").agg(F.sum("__n").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(key).orderBy("__cell"))
    low, high = F.floor((F.col("__all") + 1) / 2), F.floor(F.col("__all") / 2) + 1
    middle = counts.withColumns({"__before": upto - F.col("__c")}).where((F.col("__before") < high) & (F.col("__before") + F.col("__c") >= low))
    inside = placed.join(middle.select(key, "__cell", "__before"), [key, "__cell"])
    rank = F.col("__before") + F.sum("__n").over(Window.partitionBy(key, "__cell").orderBy("__v"))
    ranked = inside.withColumn("__rank", rank)
    hit = lambda at: F.min(F.when(F.col("__rank") >= at, F.col("__v")))
    return ranked.groupBy(key, "__all").agg(hit(low).alias("__a"), hit(high).alias("__b")).select(key, F.col("__all").alias("n"), ((F.col("__a") + F.col("__b")) / 2).alias("median"))
