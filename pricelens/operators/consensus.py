"""Consensus of books: no-vig probabilities, exclusions, outliers, weighted means, disagreement. Long format, a row per selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.pricing import first_reason, implied_probability, issues

ULP = 2.0**-52
MARKET = ("game", "market")
INACTIVE = ("closed", "suspended", "unavailable")


@dataclass(frozen=True)
class ConsensusPolicy:
    """The default weights and limits."""

    target: str = "hardrock"
    weights: dict[str, float] = field(default_factory=lambda: {"draftkings": 1.0, "fanduel": 1.0, "betmgm": 1.0, "caesars": 1.0})
    minimum_books: int = 3
    maximum_age_minutes: float = 15.0
    outlier_threshold: float = 0.08
    disagreement_warning: float = 0.05
    disagreement_block: float = 0.1

    def __post_init__(self):
        usable = [b for b, w in self.weights.items() if w > 0 and b != self.target]
        if any(b != b.strip().lower() or not b or not 0 <= w < float("inf") for b, w in self.weights.items()):
            raise ValueError("weights need canonical book ids and finite values from 0")
        if self.maximum_age_minutes < 0 or not 0 <= self.outlier_threshold < 1:
            raise ValueError("age from 0, threshold from 0 to less than 1")
        if len(usable) < self.minimum_books:
            raise ValueError("fewer usable books than the minimum")

    def weight(self, book: Column) -> Column:
        """The book's weight, null for a book that isn't configured."""
        out = F.lit(None).cast("double")
        for b, w in self.weights.items():
            out = F.when(book == b, F.lit(float(w))).otherwise(out)
        return out


def remove_vig(df: DataFrame, market: Sequence[str], implied: str, name: str) -> DataFrame:
    """Implied probabilities of one market over their sum; markets of one outcome go. A window over a market's few rows."""
    w = Window.partitionBy(*market)
    return df.withColumn("__n", F.count("*").over(w)).where("__n >= 2").withColumn(name, F.col(implied) / F.sum(implied).over(w)).drop("__n")


def upper_median(values: Column) -> Column:
    """The middle value of an array, of two middle ones the larger; groups are as small as the number of books."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def judged(quotes: DataFrame, policy: ConsensusPolicy, now_ms: int, market: Sequence[str] = MARKET) -> DataFrame:
    """quotes with age_minutes of the row's book and reason: the first one against that book, null if it may take part.

    quotes: current ones, a row per market, book and selection, with american, state and observed_ms. What is expected of
    a book is every selection that any book of the market has. The market's window comes first, so its shuffle serves the
    book's window too, and all that with_consensus adds.
    """
    whole, book = Window.partitionBy(*market), Window.partitionBy(*market, "book")
    rows = quotes.withColumn("__expected", F.size(F.collect_set("selection").over(whole)))
    rows = rows.withColumns(
        {
            "__rows": F.count("*").over(book),
            "__selections": F.size(F.collect_set("selection").over(book)),
            "__state": F.min(F.when(F.col("state") != "active", F.col("state"))).over(book),
            "__oldest": F.min("observed_ms").over(book),
            "__priced": F.bool_and(implied_probability(F.col("american")).isNotNull()).over(book),
        }
    )
    age, weight = (F.lit(now_ms) - F.col("__oldest")) / 60000, policy.weight(F.col("book"))
    reason = first_reason(
        (F.col("book").isNull() | (F.trim("book") == ""), "invalid-sportsbook"),
        (F.col("book") == policy.target, "target-sportsbook"),
        (~F.col("__state").isin(*INACTIVE), "invalid-status"),
        *[(F.col("__state") == x, x) for x in INACTIVE],
        (age.isNull() | (age < 0), "invalid-age"),
        (age > policy.maximum_age_minutes, "stale"),
        (F.col("__rows") > F.col("__selections"), "duplicate-selection"),
        (F.col("__selections") < F.col("__expected"), "missing-selection"),
        (weight.isNull(), "unconfigured"),
        (weight == 0, "zero-weight"),
        (~F.col("__priced"), "invalid-odds"),
    )
    return rows.withColumns({"age_minutes": F.round(age, 6), "reason": reason}).drop("__expected", "__rows", "__selections", "__state", "__oldest", "__priced")


def exclusions(quotes: DataFrame, policy: ConsensusPolicy, now_ms: int, market: Sequence[str] = MARKET) -> DataFrame:
    """One row per market and book with its age and the first reason against it, null for none."""
    rows = judged(quotes, policy, now_ms, market)
    return rows.groupBy(*market, "book").agg(F.max("age_minutes").alias("age_minutes"), F.max("reason").alias("reason"))


def fair_prices(rows: DataFrame, market: Sequence[str] = MARKET) -> DataFrame:
    """rows of judged() with fair: the no-vig probability, null for books that don't take part or price one outcome only."""
    book = Window.partitionBy(*market, "book")
    p = F.when(F.col("reason").isNull(), implied_probability(F.col("american")))
    rows = rows.withColumn("__p", p)
    return rows.withColumn("fair", F.when(F.count("__p").over(book) >= 2, F.col("__p") / F.sum("__p").over(book))).drop("__p")


def outliers(rows: DataFrame, threshold: float, market: Sequence[str] = MARKET) -> DataFrame:
    """rows with deviation from the upper median of fair, and outlier: whether the book strays by more than the threshold on any selection."""
    cell, book = Window.partitionBy(*market, "selection"), Window.partitionBy(*market, "book")
    strays = F.abs(F.col("fair") - upper_median(F.collect_list("fair").over(cell)))
    far = F.max("deviation").over(book) > threshold * (1 + 2 * ULP)
    return rows.withColumn("deviation", strays).withColumn("outlier", F.coalesce(far, F.lit(False)))


def with_consensus(quotes: DataFrame, policy: ConsensusPolicy, now_ms: int, market: Sequence[str] = MARKET) -> DataFrame:
    """Each current quote with its market's consensus: reason, fair, deviation, outlier, kept, books, probability, score, level.

    probability is the weighted mean of the kept books' fair values, made to sum to 1 over the market; null where too few
    books are kept. score is the widest range of kept values over the selections, level its class. Everything is a window
    within one market, so all of it runs behind a single shuffle by market.
    """
    cell, whole = Window.partitionBy(*market, "selection"), Window.partitionBy(*market)
    rows = outliers(fair_prices(judged(quotes, policy, now_ms, market), market), policy.outlier_threshold, market)
    rows = rows.withColumn("kept", F.col("fair").isNotNull() & ~F.col("outlier"))
    rows = rows.withColumn("__w", F.when(F.col("kept"), policy.weight(F.col("book")) / max(policy.weights.values())))
    value = F.when(F.col("kept"), F.col("fair"))
    rows = rows.withColumns({"__part": F.col("fair") * F.col("__w") / F.sum("__w").over(cell), "books": F.count("__w").over(cell), "range": F.round(F.max(value).over(cell) - F.min(value).over(cell), 12)})
    enough = F.min(F.when(F.col("books") > 0, F.col("books"))).over(whole) >= policy.minimum_books
    rows = rows.withColumns(
        {"probability": F.when((F.col("books") > 0) & enough, F.sum("__part").over(cell) / F.sum("__part").over(whole)), "score": F.max("range").over(whole)}
    )
    reaches = lambda x: F.col("score") >= x * (1 - 2 * ULP)
    level = F.when(reaches(policy.disagreement_block), "block").when(reaches(policy.disagreement_warning), "warning").when(F.col("score").isNotNull(), "none")
    return rows.withColumn("level", level).drop("__w", "__part")


def consensus(rows: DataFrame, market: Sequence[str] = MARKET) -> DataFrame:
    """rows of with_consensus(): a row per selection that any kept book prices, with books and probability."""
    return rows.where("kept").groupBy(*market, "selection").agg(F.max("books").alias("books"), F.max("probability").alias("probability"))


def disagreement(rows: DataFrame, market: Sequence[str] = MARKET) -> DataFrame:
    """rows of with_consensus(): per market the widest range, of equal ones the first selection, and its level."""
    widest = F.min_by("selection", F.struct((-F.col("range")).alias("r"), "selection"))
    found = rows.where("kept").groupBy(*market).agg(F.max("score").alias("score"), widest.alias("selection"), F.max("level").alias("level"))
    return found.select(*market, "selection", F.round("score", 9).alias("score"), "level")


def valid_contributions(vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per book's vector: whether its probabilities lie in 0..1 and sum to 1 within 32 ulps."""
    inside = F.bool_and(F.coalesce((F.col("fair") >= 0) & (F.col("fair") <= 1), F.lit(False)))
    return vectors.groupBy(*keys).agg((inside & (F.abs(F.sum("fair") - 1) <= 32 * ULP)).alias("valid"))


def market_validity(quotes: DataFrame, market: Sequence[str] = MARKET) -> DataFrame:
    """Per market whether it can have a consensus, and the issues: 2 or 3 distinct selections, none blank, no book twice for one."""
    twice = quotes.groupBy(*market, "book", "selection").agg(F.count("*").alias("n"))
    per = twice.groupBy(*market).agg(F.count_distinct("selection").alias("selections"), F.bool_or(F.trim("selection") == "").alias("blank"), F.max("n").alias("most"))
    bad = ~F.col("selections").between(2, 3) | F.col("blank")
    found = issues((bad, "invalid-market"), (F.col("most") > 1, "duplicate-sportsbook"))
    return per.select(*market, found.alias("issues"), (F.size(found) == 0).alias("valid"))
