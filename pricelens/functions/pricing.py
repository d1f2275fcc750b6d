"""Price math as Column functions. American odds below 100 in size, and non-finite inputs, give null, not an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x as a double, null if it is NaN or infinite."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def american_to_decimal(american: Column) -> Column:
    a = finite(american)
    return F.when(a >= 100, 1 + a / 100).when(a <= -100, 1 + F.try_divide(F.lit(100.0), F.abs(a)))


def decimal_to_american(decimal: Column) -> Column:
    d = finite(decimal)
    return F.when(d >= 2, (d - 1) * 100).when(d > 1, F.try_divide(F.lit(-100.0), d - 1))


def implied_probability(american: Column) -> Column:
    return F.try_divide(F.lit(1.0), american_to_decimal(american))


def probability_to_american(p: Column) -> Column:
    q = finite(p)
    return F.when((q > 0) & (q < 1), decimal_to_american(F.try_divide(F.lit(1.0), q)))


def break_even_probability(american: Column) -> Column:
    a = finite(american)
    return F.when(a >= 100, F.try_divide(F.lit(100.0), 100 + a)).when(a <= -100, F.try_divide(F.abs(a), F.abs(a) + 100))


def expected_value(p: Column, american: Column) -> Column:
    return p * american_to_decimal(american) - 1


def expected_profit(p: Column, american: Column, stake: Column) -> Column:
    """Null for a negative stake; adding 0 turns -0 into 0."""
    return F.when(stake >= 0, stake * expected_value(p, american) + F.lit(0.0))


def kelly_fraction(p: Column, american: Column) -> Column:
    """May be negative."""
    return F.try_divide(expected_value(p, american), american_to_decimal(american) - 1)


def fractional_kelly(p: Column, american: Column, multiplier: Column) -> Column:
    return F.when((multiplier > 0) & (multiplier <= 1), F.greatest(F.lit(0.0), kelly_fraction(p, american)) * multiplier)


def fair_odds(p: Column) -> Column:
    q = finite(p)
    return F.when((q > 0) & (q < 1), F.struct((1 / q).alias("decimal"), probability_to_american(q).alias("american")))


def issues(*rules: tuple[Column, str]) -> Column:
    """The names of the rules that hold, in the order given; null conditions don't hold."""
    return F.array_compact(F.array(*[F.when(holds, F.lit(name)) for holds, name in rules]))


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that holds, else null."""
    out = F.lit(None).cast("string")
    for holds, name in reversed(rules):
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def fair_value(p: Column, american: Column, stake: Column, multiplier: Column) -> Column:
    """Struct of decimal, american, ev, profit, kelly, stake_fraction and issues; figures are null if there is an issue."""
    found = issues(
        (p.isNull() | ~((p > 0) & (p < 1)), "invalid-probability"),
        (american_to_decimal(american).isNull(), "invalid-odds"),
        (stake.isNull() | (stake < 0), "invalid-stake"),
        (multiplier.isNull() | ~((multiplier > 0) & (multiplier <= 1)), "invalid-kelly-multiplier"),
    )
    ok = lambda x: F.when(F.size(found) == 0, x)
    return F.struct(
        ok(fair_odds(p)["decimal"]).alias("decimal"),
        ok(fair_odds(p)["american"]).alias("american"),
        ok(expected_value(p, american)).alias("ev"),
        ok(expected_profit(p, american, stake)).alias("profit"),
        ok(kelly_fraction(p, american)).alias("kelly"),
        ok(fractional_kelly(p, american, multiplier)).alias("stake_fraction"),
        found.alias("issues"),
    )


def odds_band(american: Column) -> Column:
    return (
        F.when(american <= -200, "heavy-favorite")
        .when(american <= -110, "favorite")
        .when(american <= 109, "near-even")
        .when(american <= 199, "underdog")
        .when(american > 199, "longshot")
    )


def round_half_up(x: Column) -> Column:
    """To the next whole number, halves up, also below zero."""
    return F.floor(x + 0.5)


def winning_return_cents(stake_cents: Column, american: Column) -> Column:
    return (stake_cents + round_half_up(stake_cents * (american_to_decimal(american) - 1))).cast("long")


TERMINAL = ("won", "lost", "push", "void", "cashed-out")


def settle_bet(status: Column, stake_cents: Column, american: Column, cashed_cents: Column) -> Column:
    """Struct of returned_cents, profit_cents and roi; an open bet has returned nothing and has no roi."""
    back = (
        F.when(status == "won", winning_return_cents(stake_cents, american))
        .when(status == "lost", F.lit(0))
        .when(status.isin("push", "void"), stake_cents)
        .when(status == "cashed-out", cashed_cents)
        .otherwise(F.lit(0))
        .cast("long")
    )
    settled = status.isin(*TERMINAL)
    profit = F.when(settled, back - stake_cents).otherwise(F.lit(0)).cast("long")
    return F.struct(
        back.alias("returned_cents"), profit.alias("profit_cents"), F.when(settled, F.try_divide(profit, stake_cents)).alias("roi")
    )


def can_transition(before: Column, after: Column) -> Column:
    """An open bet may settle; a settled one may only become another settled state."""
    return (after != "open") & ((before == "open") | (before != after))


#: Decimal places shown for each kind of value.
DISPLAY_SCALES = {"american": 0, "probability": 2, "decimal": 3, "money": 2}


def display(kind: str, x: Column) -> Column:
    """Text of a value, halves away from zero on its shortest decimal form; plus sign for odds, % for probabilities."""
    scale = DISPLAY_SCALES[kind]
    shown = x * 100 if kind == "probability" else x
    text = F.round(shown.cast("string").cast("decimal(38,18)"), scale).cast(f"decimal(38,{scale})").cast("string")
    if kind == "american":
        return F.when(x > 0, F.concat(F.lit("+"), text)).otherwise(text)
    return F.concat(text, F.lit("%")) if kind == "probability" else text
