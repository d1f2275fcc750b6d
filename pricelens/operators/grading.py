"""Grading and settlement of decisions against results."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.pricing import american_to_decimal, first_reason


def _grade(outcome: Column, reason: Column, american: Column) -> Column:
    """Struct of outcome, reason and profit in units: a win pays the decimal price less 1, a loss costs 1, others 0."""
    profit = F.when(outcome == "won", american_to_decimal(american) - 1).when(outcome == "lost", -1.0).otherwise(0.0)
    return F.struct(outcome.alias("outcome"), reason.alias("reason"), profit.alias("profit"))


def _state(state: Column) -> tuple[Column, Column]:
    return state.isin("cancelled", "no-contest"), state == "postponed"


def grade_moneyline(away: Column, home: Column, selected: Column, outcomes: Column, american: Column, state: Column) -> Column:
    voided, postponed = _state(state)
    missing = away.isNull() | home.isNull()
    winner = F.when(away == home, "draw").when(away > home, "away").otherwise("home")
    tie = (winner == "draw") & (outcomes == 2)
    outcome = F.when(voided, "void").when(postponed | missing | tie, "unresolved").when(winner == selected, "won").otherwise("lost")
    reason = F.when(voided | postponed, state).when(missing, "scores-missing").when(tie, "two-way-tie").otherwise("moneyline-final")
    return _grade(outcome, reason, american)


def grade_spread(away: Column, home: Column, selected: Column, point: Column, american: Column, state: Column) -> Column:
    voided, postponed = _state(state)
    missing = away.isNull() | home.isNull() | point.isNull()
    margin = F.when(selected == "away", away - home).otherwise(home - away) + point
    outcome = F.when(voided, "void").when(postponed | missing, "unresolved").when(margin > 0, "won").when(margin < 0, "lost").otherwise("push")
    reason = F.when(voided | postponed, state).when(missing, "spread-evidence-missing").otherwise("spread-final")
    return _grade(outcome, reason, american)


def guard(df: DataFrame, accepted_scopes: list[str]) -> Column:
    """The first mismatch between a decision and a result, in fixed order; null if the result may grade it.

    df: sport, event, version, selection and participants of the decision; result_sport, result_event, result_version,
    state, scope, scored (participants with scores) of the result.
    """
    final = F.col("state") == "final"
    strangers = F.size(F.array_except("scored", "participants")) > 0
    return first_reason(
        (F.col("result_sport") != F.col("sport"), "sport-mismatch"),
        (F.col("result_event") != F.col("event"), "event-mismatch"),
        (F.col("result_version") != F.col("version"), "event-version-mismatch"),
        (final & ~F.col("scope").isin(accepted_scopes), "result-scope-mismatch"),
        (final & ((F.size("scored") != 2) | strangers), "participant-mismatch"),
        (~F.array_contains("participants", F.col("selection")), "selection-mismatch"),
    )


@dataclass(frozen=True)
class SportModule:
    """What a sport brings to grading: the scopes of results that count, and a grader for each of its markets."""

    scopes: Sequence[str]
    graders: Mapping[str, Callable[[], Column]]


def by_moneyline() -> Column:
    return grade_moneyline(F.col("away_score"), F.col("home_score"), F.col("selection"), F.col("outcomes"), F.col("american"), F.col("state"))


def by_spread() -> Column:
    return grade_spread(F.col("away_score"), F.col("home_score"), F.col("selection"), F.col("point"), F.col("american"), F.col("state"))


#: Sports by name; another one is added by an entry.
SPORTS: dict[str, SportModule] = {
    "baseball": SportModule(("full",), {"moneyline": by_moneyline, "spread": by_spread}),
    "soccer": SportModule(("full", "regulation"), {"moneyline": by_moneyline, "spread": by_spread}),
    "basketball": SportModule(("full",), {"moneyline": by_moneyline, "spread": by_spread}),
    "football": SportModule(("full",), {"moneyline": by_moneyline}),
}


def graded(df: DataFrame, sports: Mapping[str, SportModule] = SPORTS) -> DataFrame:
    """df, the columns of guard() and of the graders with market, by its sport's module: with grade, and refused, why not.

    A sport or a market that no module knows, and a result that the module's guard turns away, give no grade.
    """
    grade, refused = F.lit(None), F.lit("sport-unsupported")
    for name, module in sports.items():
        here = F.col("sport") == name
        known = F.col("market").isin(*module.graders)
        refused = F.when(here, F.when(known, guard(df, list(module.scopes))).otherwise("market-unsupported")).otherwise(refused)
        for market, grader in module.graders.items():
            grade = F.when(here & (F.col("market") == market), grader()).otherwise(grade)
    return df.withColumn("refused", refused).withColumn("grade", F.when(F.col("refused").isNull(), grade))


def supersession(grades: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Each grade with its correction number from 0, whether a later one replaces it, and what it said before."""
    w = Window.partitionBy(*key).orderBy(*order)
    return grades.withColumns(
        {
            "correction": (F.row_number().over(w) - 1).cast("long"),
            "superseded": F.lead(F.lit(True), 1, False).over(w),
            "previous_outcome": F.lag("outcome").over(w),
        }
    )
