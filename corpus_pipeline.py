"""A training corpus from raw documents, in five stages. Each stage works on all that its predecessor kept.

All but the last return the columns of documents; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm.common import table, work_path
from pricelens.llm.line_runs import line_dedup
from pricelens.llm.packing import pack_documents
from pricelens.llm.quality_pu import keep_quality
from pricelens.llm.simhash_cover import drop_near_duplicates
from pricelens.llm.source_mix import mix


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; of a table of none, or without labels of good ones, none do."""
    return keep_quality(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents go; a document stays even if none of its lines do, a null text as an empty one.

    Other columns, whatever their names, go along in a struct; n_chars is counted again.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    kept = line_dedup(docs.select("doc_id", "text", *([F.struct(*[f"`{c}`" for c in rest]).alias("rest")] if rest else [])))
    made = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.char_length("text").cast("long").alias("n_chars")}
    return kept.select(*[made[c] if c in made else F.col(f"rest.`{c}`") for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component one row stays, that of the smallest doc_id, a null one last; null texts are empty ones."""
    return drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; equal rows share their copies, null texts are empty, a null source is one."""
    return mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences; a document taken twice is packed twice, a null or empty one is its end alone."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_copies),
    ("mix", mix_sources),
    ("pack", pack),
]

#: No SQL expresses the classifier, SimHash, the mix or packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each but the last written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = work_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
