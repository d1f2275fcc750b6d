"""Opportunities with confidence and expiry, filtered and ranked."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.pricing import expected_value
from pricelens.operators.consensus import ConsensusPolicy


def confidence(age_ms: Column, most_age_ms: float, included: Column, seen: Column, score: Column, block: float) -> dict[str, Column]:
    """Freshness, coverage and agreement in percent, their minimum, the weakest in that order, and its bucket."""
    part = lambda x: F.floor(100 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    freshness = part(1 - F.greatest(F.lit(0), age_ms) / most_age_ms)
    coverage = F.floor(100 * F.coalesce(F.try_divide(included, seen), F.lit(0.0)))
    agreement = part(1 - score / block)
    least = F.least(freshness, coverage, agreement)
    return {
        "freshness": freshness, "coverage": coverage, "agreement": agreement, "confidence": least,
        "weakest": F.when(freshness == least, "freshness").when(coverage == least, "coverage").otherwise("agreement"),
        "bucket": F.when(least >= 80, "high").when(least >= 60, "medium").otherwise("low"),
    }


def expires_ms(oldest_ms: Column, maximum_age_minutes: float, start_ms: Column) -> Column:
    """The first instant at which the oldest evidence is too old, or the start if that is earlier."""
    return F.least(F.floor(oldest_ms + maximum_age_minutes * 60000) + 1, start_ms).cast("long")


def opportunities(rows: DataFrame, policy: ConsensusPolicy, now_ms: int) -> DataFrame:
    """rows of with_consensus(): those of the target book that the others agree on, with ev and confidence. No further shuffle."""
    market = ("game", "market")
    whole = Window.partitionBy(*market)
    other = F.col("book") != policy.target
    seen = rows.withColumns(
        {"seen": F.size(F.collect_set(F.when(other, F.col("book"))).over(whole)), "oldest_ms": F.least("observed_ms", F.min(F.when(other, F.col("observed_ms"))).over(whole))}
    )
    own = seen.where((F.col("book") == policy.target) & F.col("probability").isNotNull())
    found = confidence(now_ms - F.col("oldest_ms"), policy.maximum_age_minutes * 60000, F.col("books"), F.col("seen"), F.col("score"), policy.disagreement_block)
    ev = F.round(expected_value(F.col("probability"), F.col("american")), 9)
    return own.withColumns({"ev": ev, "id": F.concat_ws(":", *market, "selection")} | found)


def filtered(
    df: DataFrame, *, market: str | None = None, book: str | None = None, competition: str | None = None, warning: str | None = None, from_ms: int | None = None,
    until_ms: int | None = None, minimum_ev: float | None = None, minimum_books: int | None = None, maximum_age_ms: int | None = None, now_ms: int = 0,
) -> DataFrame:
    """Any of the predicates given, together; those given need their column: league, warnings (an array), start_ms and so on."""
    wanted = {
        "market": (market, lambda x: F.col("market") == x),
        "book": (book, lambda x: F.col("book") == x),
        "competition": (competition, lambda x: F.col("league") == x),
        "warning": (warning, lambda x: F.array_contains("warnings", x)),
        "from": (from_ms, lambda x: F.col("start_ms") >= x),
        "until": (until_ms, lambda x: F.col("start_ms") < x),
        "ev": (minimum_ev, lambda x: F.col("ev") >= x),
        "books": (minimum_books, lambda x: F.col("books") >= x),
        "age": (maximum_age_ms, lambda x: now_ms - F.col("oldest_ms") <= x),
    }
    for value, holds in wanted.values():
        df = df if value is None else df.where(holds(value))
    return df


#: The order of opportunities: downwards by these, then by id.
RANK = ("ev", "confidence", "freshness", "coverage")


def after(df: DataFrame, cursor: Mapping | None, as_of_ms: int | None = None, seen: str = "observed_ms") -> DataFrame:
    """The rows that come after the cursor, a row's RANK and id, in the order of ranked(), ties included; all without one.

    as_of_ms holds every page to the rows that the first one could see. Rows with a null in RANK are never ranked.
    """
    df = df if as_of_ms is None else df.where(F.col(seen) <= as_of_ms)
    if cursor is None:
        return df
    later = F.col("id") > cursor["id"]
    for c in reversed(RANK):
        later = (F.col(c) < cursor[c]) | ((F.col(c) == cursor[c]) & later)
    return df.where(later)


def next_page(df: DataFrame, limit: int, cursor: Mapping | None = None, as_of_ms: int | None = None, seen: str = "observed_ms") -> DataFrame:
    """The first `limit` rows after the cursor."""
    return ranked(after(df, cursor, as_of_ms, seen), limit)


def _bound_to(filters: Mapping) -> str:
    return hashlib.sha256(json.dumps(dict(sorted(filters.items())), sort_keys=True).encode()).hexdigest()


def cursor_at(row: Mapping, filters: Mapping, as_of_ms: int) -> dict:
    """A cursor of the row that a page ended with, bound to the page's filters and instant."""
    return {**{c: row[c] for c in (*RANK, "id")}, "as_of_ms": as_of_ms, "filters": _bound_to(filters)}


def filtered_page(df: DataFrame, limit: int, filters: Mapping, as_of_ms: int, cursor: Mapping | None = None, seen: str = "observed_ms") -> DataFrame:
    """A page under filters (those of filtered()), of the rows seen by an instant; with a cursor the one after it.

    The cursor must come from a page of the same filters and instant, so that no row is skipped or comes twice.
    """
    if cursor is not None and cursor["filters"] != _bound_to(filters):
        raise ValueError("cursor-filter-mismatch")
    if cursor is not None and cursor["as_of_ms"] != as_of_ms:
        raise ValueError("cursor-as-of-mismatch")
    return next_page(filtered(df, **filters), limit, cursor, as_of_ms, seen)


def ranked(df: DataFrame, limit: int) -> DataFrame:
    """A top-k by ev, confidence, freshness, coverage downwards, then id."""
    return df.orderBy(*map(F.desc, RANK), "id").limit(limit)
