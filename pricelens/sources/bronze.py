"""Raw provider rows: JSON parsed permissively, rows that fail a rule quarantined with the reason, never fatal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions.pricing import first_reason

ODDS_SCHEMA = "event string, market string, selection string, book string, american int, point double, observed_ms long, retrieved_ms long, corrupt string"


def parse_json(raw: DataFrame, body: str, schema: str) -> DataFrame:
    """raw with parsed: a struct of the schema; text that isn't such JSON lands in its field `corrupt`."""
    return raw.withColumn("parsed", F.from_json(body, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}))


def with_reason(rows: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """rows with reason: the first rule that is broken, null for a good row. A rule that can't be evaluated is broken."""
    return rows.withColumn("reason", first_reason(*[(~F.coalesce(holds, F.lit(False)), name) for holds, name in rules]))


def odds_rules(p: str = "parsed") -> list[tuple[Column, str]]:
    """What an odds row must be."""
    c = lambda x: F.col(f"{p}.{x}")
    return [
        (c("corrupt").isNull(), "malformed"),
        (F.trim(c("event")) != "", "event-missing"),
        (F.trim(c("market")) != "", "market-missing"),
        (F.trim(c("selection")) != "", "selection-missing"),
        (F.trim(c("book")) != "", "book-missing"),
        (F.abs(c("american")).between(100, 100_000), "odds-invalid"),
        (c("observed_ms") <= c("retrieved_ms"), "observed-after-retrieval"),
        (c("point").isNull() | ~F.isnan(c("point")), "point-invalid"),
    ]


def odds_rows(raw: DataFrame, body: str) -> tuple[DataFrame, DataFrame]:
    """Good rows with the odds columns, and quarantined raw rows with their reason."""
    judged = with_reason(parse_json(raw, body, ODDS_SCHEMA), odds_rules())
    return judged.where("reason IS NULL").select(*raw.columns, "parsed.*").drop("corrupt"), judged.where("reason IS NOT NULL").drop("parsed")


def replay_census(pages: DataFrame, event: str, order: Sequence[str], outcome: str) -> DataFrame:
    """Captured rows by outcome, the first one of each provider event."""
    first = pages.groupBy(event).agg(F.min_by(outcome, F.struct(*order)).alias(outcome))
    return first.groupBy(outcome).agg(F.count("*").alias("n"))
