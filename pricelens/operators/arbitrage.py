"""Best prices over books, arbitrage and low holds, and the board of findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.functions.pricing import american_to_decimal

LOW_HOLD = 1.01


def best_prices(quotes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key (which ends in the selection) the largest decimal price, of equal ones the book that sorts first."""
    d = american_to_decimal(F.col("american"))
    top = quotes.withColumn("decimal", d).groupBy(*keys).agg(F.min_by(F.struct("book", "american", "decimal"), F.struct((-F.col("decimal")).alias("d"), "book")).alias("best"))
    return top.select(*keys, "best.*")


def arbitrage(quotes: DataFrame, market: Sequence[str] = ("game", "market"), outcomes: int = 2) -> DataFrame:
    """Per market with all its outcomes priced: the sum of inverse best prices, hold in percent, and its class."""
    best = best_prices(quotes, [*market, "selection"])
    sums = best.groupBy(*market).agg(F.count("*").alias("n"), F.sum(1 / F.col("decimal")).alias("total"))
    kind = F.when(F.col("total") < 1, "arbitrage").when(F.col("total") < LOW_HOLD, "low-hold").otherwise("none")
    return sums.where(F.col("n") == outcomes).select(*market, "total", ((F.col("total") - 1) * 100).alias("hold"), kind.alias("kind"))


def legs(quotes: DataFrame, market: Sequence[str] = ("game", "market")) -> DataFrame:
    """Per market an array of legs by selection: best quote, and competing quotes of other books by book id."""
    d = american_to_decimal(F.col("american"))
    per = quotes.withColumn("decimal", d).groupBy(*market, "selection").agg(F.array_sort(F.collect_list(F.struct((-F.col("decimal")).alias("d"), "book", "american"))).alias("all"))
    quote = lambda x: F.struct(x["book"].alias("book"), x["american"].alias("american"))
    rest = F.array_sort(F.transform(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), quote))
    leg = F.struct("selection", quote(F.get("all", F.lit(0))).alias("best"), rest.alias("competing"))
    return per.groupBy(*market).agg(F.array_sort(F.collect_list(leg)).alias("legs"))


def board(findings: DataFrame, limit: int = 12) -> DataFrame:
    """The findings of lowest hold, by id where equal; total_count counts them before the cut. A top-k: limit is the feature."""
    total = findings.agg(F.count("*").alias("total_count"))
    return findings.orderBy("hold", "game", "market").limit(limit).crossJoin(F.broadcast(total))
