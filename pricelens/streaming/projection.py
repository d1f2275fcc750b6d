"""Streams of quotes: the current projection, which late rows can't move back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.operators.latest import QUOTE_KEY, current_quotes
from pricelens.sources.storage import delete, exists, folders
from pricelens.streaming.state import state_on_disk


def read_table_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A Parquet table as a stream of its files, by the schema it has now. path: a folder of files, or one file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


#: Batches that are written before they are put together with what was current before them.
COMPACT_EVERY = 100


def project_current(quotes: DataFrame, path: str, checkpoint: str, keys=QUOTE_KEY, compact_every: int = COMPACT_EVERY):
    """Keep the current quote of each cell; returns the started query, which ends with its input.

    Spark's state store, on disk with a change log, holds each cell's last quote by observation, rank and id, so an older
    row arriving late changes nothing and no watermark drops it. A batch writes the cells that it touched to a folder of its
    number, and no others. Each `compact_every`-th batch then writes the current table, from the one before and the folders
    since; older folders go, so a reader never has more than that many. A batch that is repeated after a failure writes the
    same again. read_current gives the table.
    """
    order = ("observed_ms", "provider_rank", "snapshot_id")
    latest = quotes.groupBy(*keys).agg(F.max(F.struct(*order, F.struct(*quotes.columns).alias("row"))).alias("last")).select("last.row.*")

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/batches/batch={number}")
        if number % compact_every == compact_every - 1:
            read_current(own, path, keys, before=number + 1).write.mode("overwrite").parquet(f"{path}/current/upto={number}")
            for k in _numbers(own, f"{path}/batches", number + 1):
                delete(own, f"{path}/batches/batch={k}")
            for k in _numbers(own, f"{path}/current", number)[:-1]:  # the one before stays, for who reads it now
                delete(own, f"{path}/current/upto={k}")

    with state_on_disk(quotes.sparkSession):
        return latest.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_current(spark: SparkSession, path: str, keys=QUOTE_KEY, before: int | None = None) -> DataFrame:
    """The current quotes: the last table put together (by a batch before `before`), and the last cells of the batches since."""
    upto = _numbers(spark, f"{path}/current", before)[-1:]
    found = [f"{path}/batches/batch={k}" for k in _numbers(spark, f"{path}/batches", before) if not upto or k > upto[0]]
    parts = [f"{path}/current/upto={k}" for k in upto] + found
    return current_quotes(spark.read.parquet(*parts), keys)


def _numbers(spark: SparkSession, folder: str, before: int | None = None) -> list[int]:
    """The numbers of the complete folders name=number there, in order."""
    found = [(p, int(p.getName().partition("=")[2])) for p in folders(spark, folder)]
    return sorted(k for p, k in found if (before is None or k < before) and exists(spark, f"{p}/_SUCCESS"))


def window_counts(events: DataFrame, at: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts per tumbling window of event time; on a stream a window closes when the watermark passes it."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"))
