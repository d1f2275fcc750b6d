"""Ordered indexes: keys alone, in time order by month, beside a base table that is bucketed by id and re-read by it.

A range of time opens the months that it touches, and of their files the row groups whose least and largest instants meet
it. What it finds is keys; the base comes back by a join on id, for which only the keys move, for the base lies in buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _month(at_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(at_ms), "yyyyMM").cast("int")


def write_index(df: DataFrame, path: str, at: str, id: str) -> None:
    """(at, id) of the rows, sorted by both within ranges of them, a folder a month. Rows without an instant are not indexed."""
    keys = df.where(F.col(at).isNotNull()).select(F.col(at), F.col(id), _month(F.col(at)).alias("month"))
    ordered = keys.repartitionByRange("month", at, id).sortWithinPartitions("month", at, id)
    ordered.write.mode("overwrite").option("parquet.block.size", 1 << 20).partitionBy("month").parquet(path)


def scan_index(spark: SparkSession, path: str, at: str, from_ms: int, until_ms: int) -> DataFrame:
    """(at, id) from an instant to before another; other months' files are not opened."""
    first, last = spark.range(1).select(_month(F.lit(from_ms)), _month(F.lit(until_ms - 1))).first()
    rows = spark.read.parquet(path).where(F.col("month").between(first, last))
    return rows.where((F.col(at) >= from_ms) & (F.col(at) < until_ms)).drop("month")


def write_base(df: DataFrame, name: str, path: str, id: str, buckets: int) -> DataFrame:
    """df as a table in buckets by id, one sorted file each; an id's rows lie in one bucket."""
    dealt = df.repartition(buckets, id)
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, id).sortBy(id).saveAsTable(name)
    return df.sparkSession.table(name)


def reread(found: DataFrame, base: DataFrame, id: str) -> DataFrame:
    """The base rows of the ids found. The keys are dealt to the base's buckets, or broadcast if they turn out few."""
    return base.join(found.select(id).distinct(), id, "left_semi")
