"""Closing prices by backward as-of joins with a tolerance, reasons where there is none, and closing line value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.pricing import american_to_decimal, first_reason, implied_probability

TOLERANCE_MS = 15 * 60 * 1000


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, seen: str, tolerance: int, right_columns: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Each left row with the last right row of its keys seen within `tolerance` up to its own instant, or nulls.

    Both sides are one stream per key, ordered by time, and the last right row is carried forward, whatever the number of
    matches, instead of a range join that emits every pair. Time is cut into spans as wide as the tolerance, and only a
    span's last right row is carried into the next, so a hot key is many partitions, sorted apart: one shuffle of all rows
    and one of a row per span. Null keys and instants match nothing; the left's rows stay all the same.
    """
    width = max(int(tolerance), 1)
    spans = [*keys, "__span"]
    order = F.struct(*[F.col(c) for c in tie]) if tie else F.lit(0)
    l = left.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__left"), F.struct(*left.columns).alias("__l"))
    r = right.where(F.col(seen).isNotNull()).select(*keys, F.col(seen).alias("__t"), F.lit(0).alias("__left"), F.struct(*right_columns).alias("__r"), F.col(seen).cast("long").alias("__seen"), order.alias("__tie"))
    l, r = (x.withColumn("__span", F.floor(F.col("__t") / width)) for x in (l, r))
    ends = r.groupBy(*spans).agg(F.max_by(F.struct("__t", "__left", "__r", "__seen", "__tie"), F.struct("__t", "__tie")).alias("__e"))
    carried = ends.select(*keys, (F.col("__span") + 1).alias("__span"), "__e.*")
    both = r.unionByName(carried).unionByName(l, allowMissingColumns=True)
    w = Window.partitionBy(*spans).orderBy("__t", "__left", F.col("__tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumns({"__last": F.last("__r", ignorenulls=True).over(w), "__when": F.last("__seen", ignorenulls=True).over(w)}).where("__left = 1")
    near = F.col("__t") - F.col("__when") <= tolerance
    complete = ~sum((F.col(k).isNull().cast("int") for k in keys), F.lit(0)).cast("boolean")
    return last.select("__l.*", *[F.when(near & complete, F.col("__last")[c]).alias(f"closing_{c}") for c in right_columns])


def closing_prices(entries: DataFrame, quotes: DataFrame) -> DataFrame:
    """entries (id, game, version, market, selection, book, line, start_ms) with the closing snapshot or why there is none.

    line is the point as text, '-' for none, so that a missing point is a value. The closing snapshot is the last active
    one of the same cell within 15 minutes up to the start. The reasons come from counts per cell and per selection,
    aggregated before they are joined, so no entry meets all quotes of its game.
    """
    cell, selection = ["game", "version", "market", "selection", "book", "line"], ["game", "version", "market", "selection"]
    active = quotes.where("state = 'active'")
    found = asof_backward(entries, active, cell, "start_ms", "observed_ms", TOLERANCE_MS, ["snapshot_id", "american"], ["snapshot_id"])
    same = active.groupBy(*cell).agg(F.max("observed_ms").alias("__latest"))
    book = quotes.groupBy(*selection, "book").agg(F.count_distinct("line").alias("__lines"), F.max("line").alias("__line"))
    others = quotes.groupBy(*selection).agg(F.count_distinct("book").alias("__books"), F.max("book").alias("__book"))
    joined = found.join(same, cell, "left").join(book, [*selection, "book"], "left").join(others, selection, "left")
    reason = first_reason(
        (F.col("closing_snapshot_id").isNotNull(), "none"),
        (F.col("start_ms").isNull(), "legacy-scheduled-start-missing"),
        (F.col("__latest") > F.col("start_ms"), "closing-price-post-start"),
        (F.col("__latest").isNotNull(), "closing-price-stale"),
        ((F.col("__lines") > 1) | (F.col("__line") != F.col("line")), "closing-line-changed"),
        ((F.col("__books") > 1) | (F.col("__book") != F.col("book")), "closing-book-mismatch"),
    )
    return joined.withColumn("reason", F.nullif(F.coalesce(reason, F.lit("closing-price-missing")), F.lit("none"))).drop(
        "__latest", "__lines", "__line", "__books", "__book"
    )


def price_clv(p_close: Column, american: Column) -> Column:
    return american_to_decimal(american) * p_close - 1


def probability_clv(p_close: Column, american: Column) -> Column:
    return p_close - implied_probability(american)


def ratio_clv(american: Column, closing: Column) -> Column:
    """Same-book price ratio, opening over closing decimal, less 1."""
    return F.try_divide(american_to_decimal(american), american_to_decimal(closing)) - 1


def market_clv(entries: DataFrame, closing: DataFrame) -> DataFrame:
    """entries (id, game, market, selection, american, at_ms) against closing (game, market, selection, american, sharp, captured_ms).

    The closing market of 2 or 3 selections is de-vigged, by its sharp prices if every selection has one. Entries made
    after the capture, and those whose selection isn't in the market, go.
    """
    w = Window.partitionBy("game", "market")
    anchored = F.bool_and(F.col("sharp").isNotNull()).over(w)
    price = implied_probability(F.when(anchored, F.col("sharp")).otherwise(F.col("american")))
    fair = closing.withColumns({"__n": F.count("*").over(w), "source": F.when(anchored, "sharp-anchor").otherwise("display-book"), "__p": price})
    fair = fair.withColumn("closing_fair", F.col("__p") / F.sum("__p").over(w)).where("__n BETWEEN 2 AND 3").select("game", "market", "selection", "captured_ms", "source", "closing_fair")
    both = entries.join(fair, ["game", "market", "selection"]).where(F.col("at_ms") <= F.col("captured_ms"))
    return both.withColumn("clv_percent", price_clv(F.col("closing_fair"), F.col("american")) * 100)


def capture_window(captured_ms: Column, start_ms: Column) -> Column:
    """Whether a capture lies from 2 hours before to 48 hours after the start."""
    return captured_ms.between(start_ms - 2 * 3_600_000, start_ms + 48 * 3_600_000)


def coherent_closing_group(rows: DataFrame, key: Sequence[str], group: Sequence[str], complete: Sequence[str]) -> DataFrame:
    """Per key the rows of its first group, by version then retrieval then id downwards, that has every selection needed."""
    groups = rows.groupBy(*key, *group).agg(F.collect_set("selection").alias("__s"), F.max("retrieved_ms").alias("__r"), F.max("version").alias("__v"))
    whole = groups.where(F.size(F.array_except(F.array(*map(F.lit, complete)), "__s")) == 0)
    best = whole.groupBy(*key).agg(F.max(F.struct("__v", "__r", *group)).alias("__b")).select(*key, *[F.col(f"__b.{c}") for c in group])
    return rows.join(best, [*key, *group], "left_semi")
