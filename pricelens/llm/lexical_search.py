"""Ranked lexical search as a blocked sparse matrix product: items by terms, times terms by documents.

The left matrix holds how often an item has a term, the right one what a term of a document is worth: a whole number of 64
bits that combines the term's rarity with its share of the document. An item's scores are a row of the product.

Items come in blocks of at most BLOCK_TERMS term rows, so that a block's matrix and vocabulary can be sent to every task;
a block is a pass over the documents. In the pass a task counts the block's terms in its documents, which gives the right
matrix without values, a row per document. From it follow document frequencies, and then the values. A task takes its
documents BLOCK_DOCS at a time, turns them into rows by term and merges the rows of each item's terms into an accumulator
(Gustavson's order). Of each item it keeps the best documents so far, and returns those at its end. They are reduced by
item and group of tasks first, then by item, so that no group holds more than a share of the tasks' bests.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm.common import bounded_batches, materialize, table

BEST, BLOCK_TERMS, BLOCK_DOCS, TASK_GROUPS = 10, 1 << 20, 4096, 64
SLICE = 1 << 20
#: Bytes of terms, A-Z lower-cased; all other ASCII bytes become blanks. Bytes from 0x80 on make up all other characters.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, in lists of about SLICE bytes."""
    plain, at = text.translate(LETTERS), 0
    while at < len(plain):
        end = len(plain) if len(plain) - at <= SLICE else plain.find(b" ", at + SLICE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def counted(text: bytes) -> Counter:
    found: Counter = Counter()
    for own in terms(text):
        found.update(own)
    return found


def item_rows(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """A row per item with terms: row, item_id, terms and how often it has each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [counted(x.as_py() or b"") for x in batch.column("text").cast(pa.binary())]
            words = pa.array([list(c) for c in own], pa.list_(pa.binary()))
            times = pa.array([list(c.values()) for c in own], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("item_id"), words, times], ["row", "item_id", "terms", "times"])

    own = items.select(F.monotonically_increasing_id().alias("row"), F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(count, f"row long, item_id {items.schema[item_id].dataType.simpleString()}, terms array<binary>, times array<long>").where("size(terms) > 0")


def in_blocks(items: DataFrame, most: int = BLOCK_TERMS) -> DataFrame:
    """items with block: the items of a block have `most` term rows at most, or it is a single item."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, filled = None, 0
        for batch in batches:
            blocks = []
            for row, n in zip(batch.column("row").to_pylist(), (len(x) for x in batch.column("times"))):
                if block is None or filled + n > most:
                    block, filled = row, 0  # a block is named by its first row
                filled += n
                blocks.append(block)
            yield batch.append_column("block", pa.array(blocks, pa.int64()))

    total = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    return items.coalesce(max(1, math.ceil(total / most))).mapInArrow(deal, f"{', '.join(f'`{n}` {t}' for n, t in items.dtypes)}, block long")


class Items:
    """One block's matrix: the term numbers and multiplicities of each item."""

    def __init__(self, rows: list):
        self.numbers: dict[bytes, int] = {}
        self.rows = []
        for r in rows:
            own = [self.numbers.setdefault(bytes(t), len(self.numbers)) for t in r["terms"]]
            self.rows.append((r["row"], np.array(own), np.array(r["times"])))


def term_counts(docs: DataFrame, items, doc_id: str, text: str) -> DataFrame:
    """A row per document with terms: doc_id, n (all terms), and of the block's terms the numbers and counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = items.value.numbers
        known = numbers.keys()
        for batch in batches:
            own = [counted(x.as_py() or b"") for x in batch.column("text").cast(pa.binary())]
            found = [[(numbers[t], c[t]) for t in c.keys() & known] for c in own]
            n = pa.array([c.total() for c in own], pa.int64())
            term = pa.array([[t for t, _ in x] for x in found], pa.list_(pa.int32()))
            times = pa.array([[k for _, k in x] for x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, term, times], ["doc_id", "n", "term", "times"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(count, "doc_id long, n long, term array<int>, times array<long>").where("n > 0")


class _Best:
    """The best documents of one item so far: score, whether the id is null, id."""

    def __init__(self, most: int):
        self.most, self.held = most, [np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]

    def add(self, scores: np.ndarray, no_id: np.ndarray, ids: np.ndarray) -> None:
        held, full = self.held, len(self.held[0]) == self.most
        at = np.flatnonzero(scores >= (max(1, held[0][-1]) if full else 1))
        if len(at) > self.most:  # all that tie with the last one that fits stay for the order by id
            at = at[scores[at] >= np.partition(scores[at], -self.most)[-self.most]]
        if len(at):
            both = [np.concatenate((x, y[at])) for x, y in zip(held, (scores, no_id, ids))]
            order = np.lexsort((both[2], both[1], -both[0]))[: self.most]
            self.held = [x[order] for x in both]


def product(counts: DataFrame, items, weights, n_docs: int, n_terms: int, most: int, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """counts times the block's items: of each task and item the best documents, as (row, doc_id, score)."""

    def values(n: list[int], sizes: np.ndarray, term: np.ndarray, times: np.ndarray) -> np.ndarray:
        length = np.array([25 + 75 * k * n_docs // n_terms for k in n], np.int64)  # Python's numbers: the product may be long
        return weights.value[term] * (1_000_000_000 * times // (1000 * times + 8 * np.repeat(length, sizes)))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(most) for _ in items.value.rows]
        n_own = len(items.value.numbers)
        for batch in batches:
            for k in range(0, batch.num_rows, block_docs):
                part = batch.slice(k, block_docs)
                lists, times = part.column("term"), part.column("times").flatten().to_numpy()
                term = lists.flatten().to_numpy().astype(np.int64)
                sizes = lists.value_lengths().to_numpy()
                value = values(part.column("n").to_pylist(), sizes, term, times)
                order = np.argsort(term, kind="stable")
                column, value = np.repeat(np.arange(part.num_rows), sizes)[order], value[order]
                start = np.searchsorted(term[order], np.arange(n_own + 1)).tolist()
                no_id = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                ids = part.column("doc_id").fill_null(0).to_numpy()
                for (_, own, often), b in zip(items.value.rows, best):
                    scores = np.zeros(part.num_rows, np.int64)
                    for t, m in zip(own.tolist(), often.tolist()):
                        if start[t] < start[t + 1]:
                            scores[column[start[t] : start[t + 1]]] += m * value[start[t] : start[t + 1]]  # a column at most once
                    b.add(scores, no_id, ids)
        for (row, _, _), b in zip(items.value.rows, best):
            score, no_id, ids = b.held
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), row)), pa.array(ids, mask=no_id), pa.array(score)], ["row", "doc_id", "score"])

    return counts.mapInArrow(multiply, "row long, doc_id long, score long").withColumn("task", F.spark_partition_id())


def ranked(found: DataFrame, most: int) -> DataFrame:
    """found (row, doc_id, score, task) reduced in two steps to the best of each row, with rank."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    near = found.withColumn("task", F.col("task") % TASK_GROUPS).withColumn("rank", place("row", "task")).where(F.col("rank") <= most)
    return near.withColumn("rank", place("row")).where(F.col("rank") <= most).drop("task")


def search(
    items: DataFrame, docs: DataFrame, most: int = BEST, item_id: str = "item_id", doc_id: str = "doc_id", text: str = "text", block_terms: int = BLOCK_TERMS, block_docs: int = BLOCK_DOCS
) -> DataFrame:
    """The `most` best documents of each item: item_id, rank, doc_id, score; only scores above 0.

    Each row of items is an item, and each row of docs a document, also where ids repeat. Null and empty texts have no terms:
    such an item has no rows, such a document counts for nothing. Ties are ranked by doc_id, a null one last. Empty tables
    give no rows. Other columns are not read. Texts may have any length.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    blocks = materialize(in_blocks(materialize(item_rows(items, item_id, text), "search-items"), block_terms), "search-blocks")
    out = None
    for (block,) in blocks.select("block").distinct().orderBy("block").collect():
        own = blocks.where(F.col("block") == block)
        matrix = spark.sparkContext.broadcast(Items(own.select("row", "terms", "times").collect()))
        counts = materialize(term_counts(docs, matrix, doc_id, text), "search-counts")
        n_docs, n_terms = counts.agg(F.count("*"), F.sum("n")).first()
        # a row per term of the block at most
        found = counts.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()
        weights = np.zeros(len(matrix.value.numbers), np.int64)
        for term, df in found:
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        best = ranked(product(counts.where("size(term) > 0"), matrix, spark.sparkContext.broadcast(weights), n_docs, n_terms or 1, most, block_docs), most)
        named = best.join(own.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")
        out = named if out is None else out.unionByName(named)
    if out is None:
        return items.select(F.col(item_id).alias("item_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    return out


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS own FROM documents),
full_docs AS (SELECT r, doc_id, len(own) AS n, own FROM docs WHERE len(own) > 0),
sums AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM full_docs),
items AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS own FROM benchmark),
multiples AS (SELECT i, t, count(*) AS often FROM (SELECT i, unnest(own) AS t FROM items) GROUP BY ALL),
counts AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(own) AS t FROM full_docs) WHERE t IN (SELECT t FROM multiples) GROUP BY ALL),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, sums GROUP BY t),
impacts AS (SELECT r, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // nt))) AS v FROM counts JOIN full_docs USING (r) JOIN weights USING (t), sums),
scores AS (SELECT i, r, CAST(sum(often * v) AS BIGINT) AS score FROM multiples JOIN impacts USING (t) GROUP BY ALL HAVING sum(often * v) > 0)
SELECT item_id, CAST(row_number() OVER w AS INT) AS rank, doc_id, score FROM scores JOIN items USING (i) JOIN full_docs USING (r)
WINDOW w AS (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) QUALIFY row_number() OVER w <= 10
"""
