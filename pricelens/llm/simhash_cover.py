"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints are grouped first, so copies count once. Each distinct fingerprint then enters 2^(r+1) - 1 tables, one for
each non-zero vector v of r+1 bits: bit i of the fingerprint is in v's mask if <m(i), v> is odd, where m deals non-zero
vectors to the 64 bits. The m(i) of r differing bits span at most r dimensions, so some v is orthogonal to all of them, and
in its table the two fingerprints share a key: every pair within the radius meets, without exception.

A task streams the sorted keys of its tables and compares within runs of equal keys by numpy, never across; of a run it
returns a spanning forest of the links, fewer edges than members. A run longer than MAX_RUN is not compared there: its
members differ in the free bits only, so those are cut into r + 1 chunks, one of which any close pair shares, and the
members return in r + 1 narrower tables each. Distinct fingerprints fill a table of 11 free bits with 2048 members at most,
so this ends, and it is exact.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm.common import bounded_batches, materialize, table, work_path
from pricelens.llm.components import connected_components
from pricelens.llm.exact_bloom import set_slots, with_bit

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
MAX_RUN = 2048
#: Rows whose bits one broadcast holds: 32 MB, and 4 kB a partition.
MOST_MARKED = 1 << 28
CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles of a UTF-8 text, as a signed 64-bit number; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z only, and exactly the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, CHUNK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(first[k : k + CHUNK], last[k : k + CHUNK])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """The fingerprint of each text, null as empty; only texts go to Python."""

    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(x.as_py() or b"", shingle, seed) for x in texts.cast(pa.binary())], pa.int64())

    return F.arrow_udf(of, "long")(text)


def covering_masks(bits: int = BITS, radius: int = RADIUS, seed: int = SEED) -> list[int]:
    """The 2^(r+1) - 1 masks, each of about half the bits."""
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(bits)]
    random.Random(seed).shuffle(vectors)
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, size)]


def narrower(mask: int, radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """mask with each of r + 1 chunks of its free bits added in turn."""
    free = [i for i in range(bits) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[k :: radius + 1]) for k in range(radius + 1)]


def all_masks(radius: int = RADIUS) -> list[int]:
    """Masks by number; the r + 1 that narrow one follow in its order, down to 11 free bits or fewer."""
    masks = covering_masks(radius=radius)
    level = masks
    while BITS - min(m.bit_count() for m in level) > 11:
        level = [x for m in level for x in narrower(m, radius)]
        masks = masks + level
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class _Runs:
    """Links within runs of equal (mask, key) of one sorted partition."""

    def __init__(self, masks: list[int], roots: int, max_run: int, radius: int = RADIUS):
        self.masks, self.roots, self.max_run, self.radius = masks, roots, max_run, radius

    def _rows(self, kind: int, a: np.ndarray, b: np.ndarray, mask: int) -> pa.RecordBatch:
        n = len(a)
        columns = [np.full(n, kind, np.int32), np.full(n, mask, np.int32), b.astype(np.int64), a.astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "mask", "key", "fp"])

    def _forest(self, fp: np.ndarray, run: np.ndarray) -> pa.RecordBatch:
        """fp in runs numbered by run: (member, smaller member) edges that connect what the links within runs connect."""
        lab, at, step, pairs = np.arange(len(fp)), np.arange(len(fp)), 1, []
        while len(at := at[at + step < len(fp)]) and len(at := at[run[at] == run[at + step]]):
            close = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= self.radius]
            pairs.append((close, close + step))
            step += 1
        if pairs:
            i, j = (np.concatenate(x) for x in zip(*pairs))
            while True:
                low = np.minimum(lab[i], lab[j])
                before = lab.copy()
                np.minimum.at(lab, i, low)
                np.minimum.at(lab, j, low)
                lab = lab[lab]
                if (lab == before).all():
                    break
        own = np.flatnonzero(lab != np.arange(len(fp)))
        return self._rows(0, fp[own], fp[lab[own]], 0)

    def _overflow(self, mask: int, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(self.radius + 1):
            child = self.roots + (self.radius + 1) * mask + k
            yield self._rows(1, fp, fp & np.int64(_signed(self.masks[child])), child)

    def _can_narrow(self, mask: int) -> bool:
        return self.roots + (self.radius + 1) * mask < len(self.masks)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3  # mask, key, fp of the run that the next batch may continue
        over = None  # mask and key of a run that has overflowed already
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("mask", "key", "fp")]
            if over is not None:
                differs = (new[0] != over[0]) | (new[1] != over[1])
                n = int(np.argmax(differs)) if differs.any() else len(differs)
                yield from self._overflow(over[0], new[2][:n])
                if n == len(differs):
                    continue
                over, new = None, [x[n:] for x in new]
            mask, key, fp = (np.concatenate(x) for x in zip(held, new))
            starts = np.flatnonzero(np.append(True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])))
            last = int(starts[-1])
            yield from self._complete(mask[:last], fp[:last], starts[:-1])
            held = [mask[last:], key[last:], fp[last:]]
            if len(held[2]) > self.max_run and self._can_narrow(int(mask[last])):
                over = (int(mask[last]), int(key[last]))
                yield from self._overflow(over[0], held[2])
                held = [x[:0] for x in held]
        if len(held[2]):
            yield from self._complete(held[0], held[2], np.zeros(1, int))

    def _complete(self, mask: np.ndarray, fp: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole runs, which begin at starts: short ones together, long ones one at a time."""
        sizes = np.diff(np.append(starts, len(fp)))
        run = np.repeat(np.arange(len(sizes)), sizes)
        short = (sizes > 1) & (sizes <= 256)
        if short.any():
            yield self._forest(fp[short[run]], run[short[run]])
        for k in np.flatnonzero(sizes > 256):
            own, number = fp[starts[k] : starts[k] + sizes[k]], int(mask[starts[k]])
            if sizes[k] > self.max_run and self._can_narrow(number):
                yield from self._overflow(number, own)
            else:
                yield self._forest(own, np.zeros(len(own), int))


def close_links(distinct: DataFrame, max_run: int = MAX_RUN, radius: int = RADIUS) -> DataFrame:
    """distinct (fp): edges (a, b) whose components are those of all links at `radius` or fewer differing bits."""
    masks, roots = all_masks(radius), len(covering_masks(radius=radius))
    tables = F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(masks[k]))).alias("key")) for k in range(roots)])
    keys = distinct.select("fp", F.inline(tables).alias("mask", "key"))
    edges = None
    while True:
        found = materialize(
            keys.repartition("mask", "key")
            .sortWithinPartitions("mask", "key", "fp")
            .mapInArrow(_Runs(masks, roots, max_run, radius), "kind int, mask int, key long, fp long"),
            "simhash-links",
        )
        own = found.where("kind = 0").select(F.col("fp").alias("a"), F.col("key").alias("b"))
        edges = own if edges is None else edges.unionByName(own)
        keys = found.where("kind = 1").select("mask", "key", "fp")
        if keys.isEmpty():
            return edges


def classes(own: DataFrame, first: Column, max_run: int = MAX_RUN, radius: int = RADIUS) -> DataFrame:
    """own (fp, ...): (fp, first) with the smallest `first` of each fingerprint's component, a row per fingerprint, written."""
    distinct = materialize(own.groupBy("fp").agg(F.min(first).alias("first")), "simhash-distinct")
    nodes = connected_components(close_links(distinct.select("fp"), max_run, radius))
    rooted = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "simhash-roots")
    firsts = materialize(rooted.groupBy("root").agg(F.min("first").alias("first")), "simhash-components")
    return materialize(rooted.select("fp", "root").join(firsts, "root").select("fp", "first"), "simhash-classes")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_run: int = MAX_RUN, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED
) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of its component).

    Null and empty texts, and texts without words, have fingerprint zero and link like any other. Repeated rows give
    repeated results. Null doc_ids take part; a component has a null id only if all of its doc_ids are null. An empty
    table gives no rows. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    own = materialize(docs.select(F.col(doc_id).cast("long").alias("doc_id"), fingerprints(F.col(text), shingle, seed).alias("fp")), "fingerprints")
    found = classes(own, F.col("doc_id"), max_run, radius)
    return own.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def drop_near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_run: int = MAX_RUN, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, most_marked: int = MOST_MARKED
) -> DataFrame:
    """Of each component one row of docs, that of the smallest doc_id, a null one last; of rows that tie exactly one.

    Null and empty texts have fingerprint zero and link like any other; an empty table gives no rows. Extra columns may have
    any names. Rows are numbered in a written table, a struct beside the number, and what is decided is the numbers to drop.
    They come back to the rows as a bitmap with a bit a row, so no text shuffles. A broadcast holds MOST_MARKED rows' bits;
    more rows are gone through in ranges of their numbers, which are whole files, one range after another.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    numbered = materialize(docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("own"), F.monotonically_increasing_id().alias("row"), fingerprints(F.col(text), shingle, seed).alias("fp")), "simhash-numbered", "zstd")
    at = F.struct(F.col(f"own.{doc_id}").isNull().alias("no_id"), F.col(f"own.{doc_id}").cast("long").alias("id"), F.col("row").alias("row"))
    own = numbered.select("fp", at.alias("at"))
    found = classes(own, F.col("at"), max_run, radius)
    dropped = materialize(own.join(found, "fp").where("at.row <> first.row").select(F.col("at.row").alias("row")), "simhash-dropped")
    ranges = row_ranges(numbered, most_marked)
    kept = lambda low, high: _unmarked(numbered, dropped, low, high).select("own.*")
    if len(ranges) == 1:
        return kept(*ranges[0])
    done = work_path(spark, "simhash-kept")
    for k, (low, high) in enumerate(ranges):
        kept(low, high).write.option("compression", "zstd").parquet(f"{done}/range={k}")
    return spark.read.schema(docs.schema).parquet(*[f"{done}/range={k}" for k in range(len(ranges))])


def row_ranges(numbered: DataFrame, most: int) -> list[tuple[int | None, int | None]]:
    """Ranges of row numbers, from the first to before the second (null: no bound), of about `most` rows, cut between partitions."""
    part = F.shiftright("row", 33)
    sizes = numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    cut = sizes.withColumn("range", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / most)).groupBy("range").agg(F.min("part").alias("part"))
    firsts = sorted(r["part"] << 33 for r in cut.collect())
    cuts = [None, *firsts[1:], None]
    return list(zip(cuts, cuts[1:]))


def _unmarked(numbered: DataFrame, marked: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """The numbered rows of a range whose number isn't marked, by a bitmap that is exact."""
    if low is not None:
        numbered, marked = (df.where(F.col("row") >= low) for df in (numbered, marked))
    if high is not None:
        numbered, marked = (df.where(F.col("row") < high) for df in (numbered, marked))
    at = F.col("row") + 1  # the bitmap functions number from 1
    return with_bit(numbered, materialize(set_slots(marked, at), "simhash-bits"), at, "hit").where("NOT hit")


def op9_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
