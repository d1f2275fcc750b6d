"""Line dedup: levelled sorted runs of line hashes, compacted periodically.

A run is a table of (h1, h2, n): a line's 128-bit hash and the documents of one batch that hold it, bucketed and sorted by
the hash, so that runs join and merge without a shuffle. Each new batch merge-anti-joins the hashes that the runs already
prove frequent (they need no further count) and adds the rest as its own run at level 0. When a level holds `fanout` runs,
they are merged into one run of the next level. A line is frequent when its documents over all runs reach the threshold.

Filtering then joins line hashes with the frequent ones; what comes back to a document is the list of its line positions
to drop, so one shuffle moves the texts. A line that a third of all documents share is counted before the shuffle, and
the join on its hash is an inner one, which adaptive execution splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm.common import SPACES, ascii_lower, materialize, table, whole_text, work_path

HASH = ["h1", "h2"]


def line_keys(text: Column) -> Column:
    """The keys of a text's lines in order: stripped, A-Z lower-cased."""
    return F.transform(F.split(ascii_lower(text), "\n"), lambda line: F.btrim(line, F.lit(SPACES)))


def hashes() -> list[Column]:
    """Two independent 64-bit hashes of the column key; together they tell any corpus's lines apart."""
    return [F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")]


class LineRuns:
    """The runs of one corpus: the partitions of one table in the shared folder, bucketed and sorted by the hash.

    Runs of one table, rather than a table for each, are what lets Spark merge them bucket by bucket without a shuffle.
    Merged runs are no longer listed in levels; their files stay until the folder goes.
    """

    def __init__(self, spark: SparkSession, min_documents: int, fanout: int = 4, buckets: int | None = None):
        self.spark, self.min_documents, self.fanout = spark, min_documents, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = work_path(spark, "line-runs")
        self.name = f"line_runs_{self.path[-32:]}"
        self.levels: dict[int, list[int]] = {}
        self.written = 0

    def _write(self, rows: DataFrame, level: int) -> None:
        (
            rows.select(*HASH, "n", F.lit(self.written).alias("run"))
            .repartition(self.buckets, *HASH)
            .write.mode("append")
            .partitionBy("run")
            .bucketBy(self.buckets, *HASH)
            .sortBy(*HASH)
            .option("path", self.path)
            .saveAsTable(self.name)
        )
        self.levels.setdefault(level, []).append(self.written)
        self.written += 1

    def rows(self, runs: list[int]) -> DataFrame:
        return self.spark.table(self.name).where(F.col("run").isin(runs)).select(*HASH, "n")

    def merged(self, runs: list[int]) -> DataFrame:
        return self.rows(runs).groupBy(*HASH).agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame | None:
        """The hashes that the runs prove to be in min_documents documents or more; None before the first run."""
        live = [run for level in self.levels.values() for run in level]
        return self.merged(live).where(F.col("n") >= self.min_documents).select(*HASH) if live else None

    def add(self, batch: DataFrame) -> None:
        """batch: (h1, h2, n) of new documents, a row for each hash."""
        known = self.frequent()
        self._write(batch if known is None else batch.join(known, HASH, "left_anti"), 0)
        self.compact()

    def compact(self) -> None:
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            self._write(self.merged(self.levels.pop(level)), level + 1)
            level += 1


def line_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_documents: int = 10, batches: int = 4, fanout: int = 4
) -> DataFrame:
    """docs with text replaced by the lines that stay, plus n_lines and n_dropped (columns of those names are replaced).

    Null and empty texts are one empty line and come back as ''. Lines with an empty key always stay. Every row counts as
    a document, repeated ones too; a line repeated within a document counts once. A document all of whose lines go stays
    with text ''. Null doc_ids are kept like any others. An empty table gives no rows.
    """
    spark = docs.sparkSession
    body = whole_text(text)
    counted = materialize(
        docs.select(F.pmod(F.xxhash64(doc_id), F.lit(batches)).alias("batch"), F.explode(F.array_distinct(line_keys(body))).alias("key"))
        .where("key <> ''")
        .select("batch", *hashes())
        .groupBy("batch", *HASH)
        .agg(F.count("*").alias("n")),
        "line-batches",
    )
    runs = LineRuns(spark, min_documents, fanout)
    for k in range(batches):
        runs.add(counted.where(F.col("batch") == k).drop("batch"))
    # a table of its own, so that the join below has shuffles on both sides and a hot line can be split
    frequent = materialize(runs.frequent(), "line-frequent")

    row = [F.col(doc_id).alias("__drop_key"), F.xxhash64(body).alias("__drop_version")]
    drops = (
        docs.select(*row, F.posexplode(line_keys(body)).alias("pos", "key"))
        .where("key <> ''")
        .select("__drop_key", "__drop_version", "pos", *hashes())
        .join(frequent, HASH)
        .groupBy("__drop_key", "__drop_version")
        .agg(F.collect_set("pos").alias("__drop"))
    )
    joined = docs.withColumn("__doc_key", F.col(doc_id)).withColumn("__doc_version", F.xxhash64(body)).join(
        drops.hint("shuffle_hash"), F.col("__doc_key").eqNullSafe(F.col("__drop_key")) & (F.col("__doc_version") == F.col("__drop_version")), "left"
    )
    lines = F.split(body, "\n")
    n_lines, drop = F.size(lines), F.coalesce("__drop", F.array().cast("array<int>"))
    kept = F.array_except(F.sequence(F.lit(0), n_lines - 1), drop)
    return joined.withColumns(
        {
            "n_lines": n_lines.cast("long"),
            "n_dropped": F.size(drop).cast("long"),
            text: F.when(F.size(drop) == 0, body).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")),
        }
    ).drop("__doc_key", "__doc_version", "__drop_key", "__drop_version", "__drop")


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.*, f.key IS NOT NULL AS dropped FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
