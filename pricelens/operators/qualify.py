"""Gates that decide on a price: edge evaluation, evaluation and opportunity qualification, evidence and model gates."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.pricing import expected_value, implied_probability, issues, probability_to_american


def evaluate_edge(df: DataFrame, approved: list[str], minimum_ev: float = 0.02, minimum_books: int = 3, maximum_age: float = 15.0) -> DataFrame:
    """df (p, american, market, books, age_minutes, minutes_to_start, lineup_confirmed, ticket_percent) with ev, decision, reasons."""
    ev = expected_value(F.col("p"), F.col("american"))
    reasons = issues(
        (~F.col("market").isin(approved), "unsupported-market"),
        (ev < minimum_ev, "ev-below-threshold"),
        (F.col("books") < minimum_books, "insufficient-books"),
        (F.col("age_minutes") > maximum_age, "stale-price"),
        ((F.col("minutes_to_start") <= 60) & ~F.col("lineup_confirmed"), "lineup-unconfirmed"),
        (F.coalesce("ticket_percent", F.lit(0)) >= 80, "public-fade"),
    )
    own = df.withColumns({"ev": ev, "reasons": reasons})
    play = F.size("reasons") == 0
    return own.withColumn("decision", F.when(play, "play").otherwise("no-bet")).withColumn(
        "reasons", F.when(play, F.array(F.lit("positive-ev"))).otherwise(F.col("reasons"))
    )


#: Reasons that don't block.
WARNINGS = ("comparison-outlier-excluded", "market-disagreement-warning")


def qualify_evaluation(df: DataFrame, policy, minimum_edge: float = 0.015, minimum_ev: float = 0.02, maximum_uncertainty: float = 0.1) -> DataFrame:
    """df (p_low, uncertainty, american, age_minutes, reduced, fair, score, has_outlier) with edge, ev, reasons (sorted), decision.

    fair is the consensus probability, null if there is none; it then counts as 0. The disagreement score is compared
    here without tolerance.
    """
    fair, score = F.coalesce("fair", F.lit(0.0)), F.coalesce("score", F.lit(0.0))
    edge, ev = F.col("p_low") - fair, expected_value(F.col("p_low"), F.col("american"))
    reasons = issues(
        (F.col("age_minutes") > policy.maximum_age_minutes, "stale-offered-price"),
        (F.col("reduced"), "analysis-reduced"),
        (F.col("fair").isNull(), "insufficient-comparison-books"),
        (F.col("has_outlier"), WARNINGS[0]),
        (F.col("uncertainty") > maximum_uncertainty, "uncertainty-above-threshold"),
        (score >= policy.disagreement_block, "market-disagreement-blocked"),
        ((score >= policy.disagreement_warning) & (score < policy.disagreement_block), WARNINGS[1]),
        (edge < minimum_edge, "edge-below-threshold"),
        (ev < minimum_ev, "ev-below-threshold"),
    )
    own = df.withColumns({"edge": edge, "ev": ev, "reasons": reasons})
    plays = F.size(F.array_except("reasons", F.array(*map(F.lit, WARNINGS)))) == 0
    all_reasons = F.when(plays, F.array_append("reasons", F.lit("positive-ev-qualified"))).otherwise(F.col("reasons"))
    return own.withColumn("decision", F.when(plays, "play").otherwise("no-bet")).withColumn("reasons", F.array_sort(all_reasons))


def qualify_opportunity(df: DataFrame, policy, minimum_ev: float = 0.02) -> DataFrame:
    """df: one row per market and selection of the target book, with status, approved, healthy, state, american,
    age_minutes, fair, level, has_outlier and comparison_reasons (array); adds values, status, reasons, warnings."""
    ev = expected_value(F.col("fair"), F.col("american"))
    short = F.col("fair").isNull()
    among = lambda x: short & F.array_contains(F.coalesce("comparison_reasons", F.array().cast("array<string>")), x)
    missing = F.col("state").isNull()
    reasons = issues(
        (F.col("event_status") != "scheduled", "event-not-scheduled"),
        (~F.col("approved"), "market-not-approved"),
        (~F.col("healthy"), "target-provider-unhealthy"),
        (missing, "target-missing"),
        (F.col("state") == "suspended", "target-suspended"),
        (F.col("state") == "unavailable", "target-unavailable"),
        (F.col("age_minutes") < 0, "target-incoherent"),
        (F.col("age_minutes") > policy.maximum_age_minutes, "target-stale"),
        (~missing & implied_probability(F.col("american")).isNull(), "target-incomplete"),
        (F.col("level") == "block", "market-disagreement-blocked"),
        (short, "insufficient-comparison-books"),
        (among("stale"), "comparison-stale"),
        (among("missing-selection"), "comparison-incomplete"),
        (ev < minimum_ev, "ev-below-threshold"),
    )
    warnings = issues((F.col("has_outlier"), WARNINGS[0]), (F.col("level") == "warning", WARNINGS[1]))
    own = df.withColumns(
        {
            "implied": implied_probability(F.col("american")),
            "fair_american": probability_to_american(F.col("fair")),
            "ev": ev,
            "reasons": F.array_sort(reasons),
            "warnings": F.array_sort(warnings),
        }
    )
    return own.withColumn("verdict", F.when(F.size("reasons") > 0, "disqualified").otherwise("qualified"))


def evidence_gate(quotes: DataFrame, target: str, now_ms: int, maximum_age_minutes: float, minimum_books: int) -> DataFrame:
    """Per game and market: books with every selection, and the reasons against an evaluation; any reason makes it invalid.

    quotes: current quotes, a row per game, market, book and selection.
    """
    n = F.size(F.collect_set("selection").over(Window.partitionBy("game", "market")))
    books = quotes.withColumn("n", n).groupBy("game", "market", "book").agg(
        (F.count_distinct("selection") == F.max("n")).alias("complete"),
        F.min("observed_ms").alias("oldest"),
        F.max("observed_ms").alias("newest"),
    )
    age = (F.lit(now_ms) - F.col("oldest")) / 60000
    own = F.col("book") == target
    other = ~own & F.col("complete")
    per = books.groupBy("game", "market").agg(
        F.count_if(other).alias("books"),
        F.count_if(own & F.col("complete")).alias("offered"),
        F.max("newest").alias("newest"),
        F.coalesce(F.max(F.when(own, age)) > maximum_age_minutes, F.lit(False)).alias("offered_stale"),
        F.count_if(other & (age > maximum_age_minutes)).alias("stale"),
        F.count_if(~own & ~F.col("complete")).alias("incomplete"),
    )
    reasons = issues(
        (F.col("newest") > now_ms, "evidence-from-future"),
        (F.col("offered") == 0, "offered-missing"),
        (F.col("offered_stale"), "offered-stale"),
        (F.col("books") < minimum_books, "comparison-sparse"),
        (F.col("stale") > 0, "comparison-stale"),
        (F.col("incomplete") > 0, "comparison-incomplete"),
    )
    return per.select("game", "market", "books", reasons.alias("reasons"), (F.size(reasons) == 0).alias("valid"))


def model_probability_valid(low: Column, estimate: Column, high: Column, uncertainty: Column, most_width: float = 0.3, most_uncertainty: float = 0.1) -> Column:
    """Interval in order within 0..1, neither too wide nor too uncertain, uncertainty half the width."""
    return (
        (low >= 0) & (low <= estimate) & (estimate <= high) & (high <= 1) & (high - low <= most_width)
        & (uncertainty <= most_uncertainty) & (F.abs(uncertainty - (high - low) / 2) <= 1e-9)
    )


def coherent_points(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key whether the points of a market's selections agree.

    Two or three different selections are needed. Three-way, moneyline and both-teams markets: all null. Spreads and
    handicaps: they sum to 0 within 1e-9. Totals: all equal. Others: all null or all equal.
    """
    points = df.groupBy(*keys).agg(
        F.first("market").alias("__market") if "market" not in keys else F.lit(None).alias("__market"),
        F.count("*").alias("n"),
        F.count_distinct("selection").alias("n_selections"),
        F.count("point").alias("n_points"),
        F.sum("point").alias("total"),
        F.min("point").alias("low"),
        F.max("point").alias("high"),
    )
    market = F.lower(F.col("market") if "market" in keys else F.col("__market"))
    named = lambda *words: reduce(or_, [F.contains(market, F.lit(w)) for w in words])
    none, all_there = F.col("n_points") == 0, F.col("n_points") == F.col("n")
    equal = all_there & (F.col("low") == F.col("high"))
    holds = (
        F.when(~F.col("n").between(2, 3) | (F.col("n_selections") < F.col("n")), F.lit(False))
        .when((F.col("n") == 3) | (market == "ml") | named("moneyline", "both-teams"), none)
        .when(named("spread", "handicap"), F.coalesce(all_there & (F.abs("total") < 1e-9), F.lit(False)))
        .when(named("total"), F.coalesce(equal, F.lit(False)))
        .otherwise(none | F.coalesce(equal, F.lit(False)))
    )
    return points.select(*keys, holds.alias("coherent"))


def coherent_window(df: DataFrame, keys: list[str], most_minutes: float = 15) -> DataFrame:
    """Per key whether all were observed before retrieval and within one span of most_minutes."""
    seen = F.bool_and(F.col("observed_ms") <= F.col("retrieved_ms"))
    return df.groupBy(*keys).agg((seen & (F.max("observed_ms") - F.min("observed_ms") <= most_minutes * 60000)).alias("coherent"))


def complete_prices(df: DataFrame, keys: list[str], expected: list[str]) -> DataFrame:
    """The keys whose rows are exactly the expected selections, once each, with spreads that sum to 0."""
    found = df.groupBy(*keys).agg(
        F.array_sort(F.collect_list("selection")).alias("selections"), F.coalesce(F.abs(F.sum("point")), F.lit(0.0)).alias("off")
    )
    return found.where((F.col("selections") == F.array(*map(F.lit, sorted(expected)))) & (F.col("off") <= 1e-9)).select(*keys)
