"""Sinks: immutable history, partitioned boards, and the arbitrage board that only moves forward."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.operators.arbitrage import board
from pricelens.sources.storage import VersionedTable


def new_history(stored: DataFrame | None, batch: DataFrame, key: str, content: Sequence[str]) -> dict[str, DataFrame]:
    """batch against stored history: rows to append (new ids, once each), ids that exist alike, and ids in conflict.

    A conflict is an id whose content differs from the stored row's, or between rows of the batch.
    """
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    own = batch.groupBy(key).agg(F.min(F.struct(digest.alias("d"), F.struct(*batch.columns).alias("r"))).alias("t"), F.count_distinct(digest).alias("n"))
    if stored is None:
        both = own.withColumn("stored", F.lit(None).cast("string"))
    else:
        both = own.join(stored.select(key, digest.alias("stored")), key, "left")
    conflict = (F.col("n") > 1) | (F.col("stored") != F.col("t.d"))
    return {
        "append": both.where(F.col("stored").isNull() & (F.col("n") == 1)).select("t.r.*"),
        "existing": both.where(F.col("stored").isNotNull() & ~conflict).select(key),
        "conflicts": both.where(conflict).select(key),
    }


BOARD_PARTITIONS = ("sport", "league", "status", "day")


def write_boards(games: DataFrame, path: str, partitions: Sequence[str] = BOARD_PARTITIONS) -> None:
    """One folder per board; boards that the rows touch are replaced, others stay. Rows of one board meet in one file."""
    rows = games.repartition(*partitions).sortWithinPartitions(*partitions, "start_ms", "game")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def read_board(spark, path: str, **at) -> DataFrame:
    """The board of the partition values given; other folders are pruned, not read."""
    rows = spark.read.parquet(path)
    for column, value in at.items():
        rows = rows.where(F.col(column) == value)
    return rows


def advance_arbitrage_board(table: VersionedTable, findings: DataFrame, scanned_ms: int, limit: int = 12) -> bool:
    """Replace the board by the best of `findings` unless it already shows a scan as late; whether it moved."""
    if table.versions() and table.versions()[-1] >= scanned_ms:
        return False
    table.write(board(findings, limit).withColumn("scanned_ms", F.lit(scanned_ms)), scanned_ms)
    return True
