"""Odds rows mapped to events: by binding first, rows of a secondary catalogue else by labels within their run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.functions.text import fuzzy_parts, fuzzy_parts_match
from pricelens.operators.matching import drift_class, label_pairs


def with_bindings(feed: DataFrame, bindings: DataFrame, canonical: DataFrame, secondary: Sequence[str]) -> DataFrame:
    """feed with secondary, kind of its binding, and the bound event with its labels and start under e_; null if none is known.

    A row is of a secondary catalogue if its provider id begins with the catalogue's name and an underscore, in any case.
    feed: rows (listing, run, provider_event, home, away, start_ms, retrieved_ms), a row per listing; bindings: (provider_event,
    event, kind), an id at most once; canonical: (event, home, away, start_ms), an event once.
    """
    events = canonical.select("event", F.col("home").alias("e_home"), F.col("away").alias("e_away"), F.col("start_ms").alias("e_start_ms"))
    known = bindings.select("provider_event", "event", "kind").join(events, "event")
    prefixed = F.lit(False)
    for name in secondary:
        prefixed = prefixed | F.startswith(F.lower("provider_event"), F.lit(f"{name.lower()}_"))
    return feed.join(known, "provider_event", "left").withColumn("secondary", F.coalesce(prefixed, F.lit(False)))


def secondary_aliases(bound: DataFrame, canonical: DataFrame) -> DataFrame:
    """Rows of a secondary catalogue that no binding knows: listing, event and outcome, alias, no-candidate or ambiguous.

    Candidates are the events that rows of the same run are bound to, whose labels match in either orientation; an alias
    needs exactly one. Run and last words join as keys, so a pair of frequent names is spread over its runs, and within a
    run the join's skew is left to adaptive execution: nothing gathers a key.
    """
    own = bound.where("secondary AND event IS NULL").select("listing", "run", "home", "away")
    seen = bound.where("event IS NOT NULL").select("run", "event").distinct()
    candidates = seen.join(canonical.select("event", "home", "away"), "event")
    ends = label_pairs(own, candidates, None, ["run"]).groupBy("listing").agg(F.min("r_event").alias("event"), F.max("r_event").alias("last"))
    outcome = F.when(F.col("event").isNull(), "no-candidate").when(F.col("event") == F.col("last"), "alias").otherwise("ambiguous")
    return own.select("listing").join(ends, "listing", "left").select("listing", F.when(outcome == "alias", F.col("event")).alias("event"), outcome.alias("outcome"))


def map_odds(feed: DataFrame, bindings: DataFrame, canonical: DataFrame, secondary: Sequence[str]) -> DataFrame:
    """Each feed row with event, drift and outcome, and the event's side that its home label is on.

    outcome: unresolved (no binding, first catalogue), no-candidate or ambiguous (no alias), start-time-conflict (the event's
    start isn't known, or the drift is rejected), after-start (retrieved when the game had begun), participant-mismatch, or
    mapped. drift is kept, trusted or rejected, of rows retrieved before a known start. Both labels must each match one
    side, not the same; of a row within the first tolerance one label is enough if the other matches neither. Labels are
    compared with the row's own event only.
    """
    bound = with_bindings(feed, bindings, canonical, secondary)
    found = secondary_aliases(bound, canonical)
    events = canonical.select(F.col("event").alias("a_event"), F.col("home").alias("a_home"), F.col("away").alias("a_away"), F.col("start_ms").alias("a_start_ms"))
    aliases = found.withColumnRenamed("event", "a_event").join(events, "a_event", "left")
    both = bound.join(aliases, "listing", "left")
    own = both.select(
        *feed.columns, "secondary", "kind", F.col("outcome").alias("alias"), *[F.coalesce(f"e_{c}" if c != "event" else c, f"a_{c}").alias(f"e_{c}") for c in ("event", "home", "away", "start_ms")]
    )
    off = F.abs(F.col("start_ms") - F.col("e_start_ms"))
    kind = drift_class(off, F.col("secondary"), F.coalesce(F.col("kind") == "source", F.lit(False)))
    early = F.col("e_start_ms").isNotNull() & (F.col("retrieved_ms") < F.col("e_start_ms"))
    parts = {c: fuzzy_parts(F.col(c)) for c in ("home", "away", "e_home", "e_away")}
    marks = {a[0] + b[2]: fuzzy_parts_match(F.col(f"__{a}"), F.col(f"__{b}")) for a in ("home", "away") for b in ("e_home", "e_away")}
    marked = own.withColumns({f"__{c}": x for c, x in parts.items()}).withColumns(marks | {"drift": F.when(early, kind), "__near": F.coalesce(off <= 15 * 60_000, F.lit(False))})
    home, away = F.col("hh") != F.col("ha"), F.col("ah") != F.col("aa")
    side = (
        F.when(home & away & (F.col("hh") != F.col("ah")), F.when(F.col("hh"), "home").otherwise("away"))
        .when(F.col("__near") & away & ~F.col("hh") & ~F.col("ha"), F.when(F.col("aa"), "home").otherwise("away"))
        .when(F.col("__near") & home & ~F.col("ah") & ~F.col("aa"), F.when(F.col("hh"), "home").otherwise("away"))
    )
    outcome = (
        F.when(F.col("e_event").isNull(), F.when(F.col("alias") != "alias", F.col("alias")).otherwise("unresolved"))
        .when(F.col("e_start_ms").isNull(), "start-time-conflict")
        .when(~early, "after-start")
        .when(F.col("drift") == "rejected", "start-time-conflict")
        .when(F.col("side").isNull(), "participant-mismatch")
        .otherwise("mapped")
    )
    judged = marked.withColumn("side", side).withColumn("outcome", F.coalesce(outcome, F.lit("unresolved")))
    return judged.select(*feed.columns, F.col("e_event").alias("event"), "secondary", "drift", "outcome", F.when(F.col("outcome") == "mapped", F.col("side")).alias("home_side"))
