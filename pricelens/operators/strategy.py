"""Strategies as JSON rows: which markets of a sport may be played, and from what expected value, coverage and age."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.functions.pricing import first_reason

SCHEMA = (
    "id string, sport string, version string, approvedMarkets array<string>, prohibitedMarkets array<string>, minimumEv double, "
    "minimumComparisonBooks int, maximumPriceAgeMinutes double"
)


def strategies(configs: DataFrame, config: str = "config") -> DataFrame:
    """The JSON of each row as columns; rows that aren't a strategy with an id, a sport and sensible limits are left out."""
    parsed = configs.select(F.from_json(config, SCHEMA).alias("s")).select("s.*")
    limits = F.col("minimumEv").between(0, 1) & (F.col("minimumComparisonBooks") >= 1) & (F.col("maximumPriceAgeMinutes") >= 0)
    return parsed.where((F.trim("id") != "") & (F.trim("sport") != "") & F.col("approvedMarkets").isNotNull() & limits)


def against_strategy(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (sport, market, ev, books, age_minutes, ...) with strategy and reason: the first rule broken, null if none is.

    rules: strategies(), one a sport; a handful of rows, whose join is left to adaptive execution. Missing figures break theirs.
    """
    s = rules.select("sport", F.struct("*").alias("__s"))
    c = lambda x: F.col(f"__s.{x}")
    holds = lambda x: F.coalesce(x, F.lit(False))
    reason = first_reason(
        (F.col("__s").isNull(), "no-strategy"),
        (holds(F.array_contains(c("prohibitedMarkets"), F.col("market"))), "market-prohibited"),
        (~holds(F.array_contains(c("approvedMarkets"), F.col("market"))), "market-not-approved"),
        (~holds(F.col("ev") >= c("minimumEv")), "ev-below-minimum"),
        (~holds(F.col("books") >= c("minimumComparisonBooks")), "too-few-books"),
        (~holds(F.col("age_minutes") <= c("maximumPriceAgeMinutes")), "price-too-old"),
    )
    return rows.join(s, "sport", "left").select(*rows.columns, c("id").alias("strategy"), reason.alias("reason"))
