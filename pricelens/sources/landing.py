"""Landing of raw provider pages: a stream of many kinds into tables by provider and day, with retention by partition."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.sources.storage import delete, folders

#: Days that landed rows of a kind, and quarantined rows, are kept.
KEPT_DAYS, QUARANTINE_DAYS = 90, 30
PARTITIONS = ("provider", "day", "batch")

Judge = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def land(raw: DataFrame, judges: Mapping[str, Judge], path: str, quarantine: str, checkpoint: str, **trigger):
    """Land a stream of raw rows (kind, provider, received_ms, body, ...); returns the started query.

    judges: by kind, what makes of a batch its good rows and its quarantined ones with their reason; both keep provider and
    received_ms. Good rows go to a table per kind, path/kind=..., for schemas differ; quarantined ones to another. Tables
    are partitioned by provider, UTC day and batch. A batch overwrites its own partitions only, so one that is repeated after
    a failure lands the same rows once. Rows of a kind without judge are quarantined as kind-unknown.
    """

    def put(rows: DataFrame, number: int, to: str) -> None:
        day = F.date_format(F.timestamp_millis("received_ms"), "yyyy-MM-dd")
        own = rows.withColumns({"day": F.coalesce(day, F.lit("none")), "batch": F.lit(number)})
        # rows of a provider and day meet in few files, dealt by adaptive execution, which splits a day that is too large
        own.hint("rebalance", "provider", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(to)

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for kind, judge in judges.items():
            good, bad = judge(batch.where(F.col("kind") == kind))
            put(good.drop("kind"), number, f"{path}/kind={kind}")
            put(bad.drop("kind"), number, f"{quarantine}/kind={kind}")
        other = batch.where(~F.coalesce(F.col("kind").isin(*judges), F.lit(False)))
        put(other.drop("kind").withColumn("reason", F.lit("kind-unknown")), number, f"{quarantine}/kind=unknown")
        batch.unpersist()

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def landed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The landed rows of a kind with provider, day and batch; filters on these open no other files."""
    return spark.read.option("basePath", f"{path}/kind={kind}").parquet(f"{path}/kind={kind}")


def expire(spark: SparkSession, path: str, now_ms: int, days: int) -> list[str]:
    """Drop the days older than `days` before an instant, of all kinds and providers; the folders dropped. No file is opened."""
    oldest = spark.range(1).select(F.date_format(F.timestamp_millis(F.lit(now_ms - days * 86_400_000)), "yyyy-MM-dd")).first()[0]
    gone = []
    for kind in folders(spark, path):
        for provider in folders(spark, kind.toString()):
            for day in folders(spark, provider.toString()):
                value = day.getName().partition("=")[2]
                if day.getName().startswith("day=") and value[:1].isdigit() and value < oldest:
                    delete(spark, day.toString())
                    gone.append(day.toString())
    return sorted(gone)
