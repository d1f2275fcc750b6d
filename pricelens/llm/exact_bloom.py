"""Exact dedup: two Bloom passes find hashes that may repeat, only their rows shuffle, all others pass straight through.

Each row's normalised text becomes a SHA-256. A pass marks in a bitmap the slots that two or more rows fell on. The
second pass marks again, by an independent hash, among the survivors of the first only. A row is "maybe repeated" if its
bit is set in both bitmaps; equal hashes always share slots, so no copy is lost, and a false positive just joins a group
of one. What every row contributes to a bitmap is a slot number, counted before the shuffle; SHA values and ids of rows
that fail a pass never move.

A bitmap is broadcast in rows of 4 kB and has 2^28 slots (32 MB) at most. With more rows than that serves, at SLOTS slots a
row, the hashes are cut into ranges, and the passes go through one range after another, each with bitmaps of its own. The
table of hashes is sorted within its files, which are written in small row groups, so a range's jobs read about its share of
them. The share of unrepeated rows that shuffle is therefore the same at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import SPACE_RUN, materialize, table, whole_text, work_path

MIN_FILTER_BITS, MAX_FILTER_BITS, SLOTS = 1 << 20, 1 << 28, 8
#: Bytes of a row group of the table of hashes: some 25,000 rows.
ROW_GROUP = 1 << 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_RUN, " ")


def filter_bits(rows: int, most: int = MAX_FILTER_BITS) -> int:
    """SLOTS slots a row as a power of two, within the bounds."""
    return min(most, max(MIN_FILTER_BITS, 1 << (SLOTS * rows).bit_length()))


def hash_ranges(rows: int, most: int = MAX_FILTER_BITS) -> list[tuple[str, str]]:
    """Ranges of hashes in hex, from the first to before the second, in each of which a filter of `most` bits has SLOTS slots a row."""
    n = 1
    while n * most < SLOTS * rows and n < 1 << 16:
        n *= 2
    cuts = [f"{(1 << 16) * k // n:04x}" for k in range(n)] + ["g"]
    return list(zip(cuts, cuts[1:]))


def slot(seed: int, bits: int, of: str = "text_sha256") -> Column:
    """From 1, for the bitmap functions number their buckets from there."""
    return F.xxhash64(F.lit(seed), of).bitwiseAND(F.lit(bits - 1)) + 1


def repeated_slots(rows: DataFrame, at: Column) -> DataFrame:
    """Bitmaps of the slots with more than one row: (bucket, bitmap), bits / 32768 rows at most."""
    return set_slots(rows.groupBy(at.alias("slot")).agg(F.count("*").alias("n")).where("n > 1"), F.col("slot"))


def set_slots(rows: DataFrame, at: Column) -> DataFrame:
    """Bitmaps of the slots of rows, built up before the shuffle: (bucket, bitmap)."""
    return rows.select(at.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap")
    )


def with_bit(rows: DataFrame, bitmaps: DataFrame, at: Column, name: str) -> DataFrame:
    """rows with a boolean column: whether the bit of its slot is set. The bitmaps' size is bounded, so they are broadcast.

    rows must not have columns bucket and bitmap: a caller's own columns belong in a struct.
    """
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (
        rows.withColumn("bucket", F.bitmap_bucket_number(at))
        .join(F.broadcast(bitmaps), "bucket", "left")
        .withColumn(name, F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False)))
        .drop("bucket", "bitmap")
    )


def _groups(hashed: DataFrame, bits: int) -> DataFrame:
    """hashed (doc_id, text_sha256, row) of one range, by two passes with filters of that size."""
    first = materialize(repeated_slots(hashed, slot(1, bits)), "bloom-1")
    once = with_bit(hashed, first, slot(1, bits), "hit_1")
    second = materialize(repeated_slots(once.where("hit_1"), slot(2, bits)), "bloom-2")
    flagged = with_bit(once, second, slot(2, bits), "hit_2")
    maybe, rest = flagged.where("hit_1 AND hit_2"), flagged.where("NOT (hit_1 AND hit_2)")
    first_of = materialize(  # a table of its own, so that the join below has shuffles on both sides and a hot hash can be split
        maybe.groupBy("text_sha256").agg(
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"), F.count("*").alias("group_size")
        ),
        "text-groups",
    )
    grouped = maybe.join(first_of, "text_sha256").select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
    )
    alone = rest.select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    return grouped.unionByName(alone)


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int | None = None, most_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; empty texts equal each other. The smallest doc_id of a group stays, a null doc_id only if
    the group has no other; of rows that tie in doc_id and text exactly one is kept. An empty table gives no rows. Other
    columns of docs are not read, whatever their names.
    """
    spark, path = docs.sparkSession, work_path(docs.sparkSession, "text-hashes")
    hashed = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.sha2(normalised(whole_text(text)), 256).alias("text_sha256"),
        F.monotonically_increasing_id().alias("row"),
    )
    hashed.sortWithinPartitions("text_sha256").write.option("parquet.block.size", ROW_GROUP).parquet(path)
    hashed = spark.read.schema(hashed.schema).parquet(path)
    rows = hashed.count()
    ranges = hash_ranges(rows, most_bits)
    if len(ranges) == 1:
        return _groups(hashed, bits or filter_bits(rows, most_bits))
    done = work_path(spark, "text-ranges")
    for k, (low, high) in enumerate(ranges):  # a range's bitmaps are gone before the next one's come
        own = hashed.where((F.col("text_sha256") >= low) & (F.col("text_sha256") < high))
        found = _groups(own, bits or most_bits)
        found.write.parquet(f"{done}/range={k}")
    return spark.read.schema(found.schema).parquet(*[f"{done}/range={k}" for k in range(len(ranges))])


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH h AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)
"""
