"""The row that counts, of many for one key: by authority, time or preference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], keep: int = 1) -> DataFrame:
    """The last `keep` rows of each key by the order given; end it with a unique column, else ties are arbitrary.

    One row a key is a maximum of structs, which partial aggregation reduces before the shuffle, so a hot key never
    gathers in one task. More rows take a window. Null keys are keys. The order's columns must be orderable.
    """
    if keep > 1:
        last_first = [(F.col(c) if isinstance(c, str) else c).desc_nulls_last() for c in order]
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*last_first))
        return df.withColumn("__place", place).where(F.col("__place") <= keep).drop("__place")
    by = [(F.col(c) if isinstance(c, str) else c).alias(f"__o{k}") for k, c in enumerate(order)]
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max(F.struct(*by, F.struct(*rest).alias("__row"))).alias("__top"))
    return top.select(*keys, *[F.col("__top.__row")[c].alias(c) for c in rest]).select(*df.columns)


QUOTE_KEY = ("game", "market", "selection", "book")


def current_quotes(quotes: DataFrame, keys: Sequence[str] = QUOTE_KEY) -> DataFrame:
    """The current quote of each cell: latest observation, then provider rank, then snapshot id."""
    return latest_by(quotes, keys, ["observed_ms", "provider_rank", "snapshot_id"])


def current_availability(observations: DataFrame, keys: Sequence[str] = QUOTE_KEY) -> DataFrame:
    """The latest state; at one instant anything but active wins, then the larger id."""
    return latest_by(observations, keys, ["observed_ms", F.col("state") != "active", "snapshot_id"])


def current_results(results: DataFrame) -> DataFrame:
    return latest_by(results, ["game"], ["authority", "updated_ms", "sequence", "token", "version"])


def preferred(df: DataFrame, keys: Sequence[str], priority: Column, *then: Column | str) -> DataFrame:
    """The row of lowest priority number, then the last by `then`."""
    return latest_by(df, keys, [-priority, *then])


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by numeric columns in order: what a dedupe that keeps the first one keeps."""
    return latest_by(df, keys, [-F.col(c) for c in order])


def revision_authority(revisions: DataFrame, event: str = "event") -> DataFrame:
    """The revision that an event goes by: each provider's own latest (time, sequence, token), then of those the one of
    highest rank, freshest, last provider id."""
    own = latest_by(revisions, [event, "provider"], ["updated_ms", "sequence", "token"])
    return latest_by(own, [event], ["rank", "updated_ms", "provider"])
