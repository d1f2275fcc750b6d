"""Mixing sources to target weights by entropy balancing.

Targets: each source's share of the wanted tokens by weight, held to twice its size, the excess dealt out again by weight.
That is min(limit, level * weight) with one level for all sources, found by a few sums over the table of sources.

Rates: of all rates in (0, 2], those nearest to 1 in relative entropy whose tokens meet each source's target. The convex
dual has a multiplier per source, and its optimum tilts documents exponentially: rate = min(2, exp(multiplier * size /
mean size of the source)). Newton's method solves it: in each round Spark sums tokens and their derivative over a table of
(source, size, documents) and steps all sources at once, inside brackets that make it safe. Sources, targets and
multipliers stay in tables; the driver sees sums over all sources only, so a source may be a domain.

Copies: documents are dealt by a hash into groups of about GROUP per source. (Where over GROUP rows are equal in all that
counts, those are a group of their own, and their copies are dealt by place, in as many tasks as hold them.) Within a group, from the largest document
down, the running sum of rate * size is rounded to whole documents, so a group misses its share by less than its smallest
documents and no group grows with a source.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm.common import WORD, materialize, table, whole_text

WEIGHTS, TOTAL_SHARE, MOST_COPIES = (5, 2, 1), 1.5, 2
GROUP = 1000
ROUNDS, NEAR = 60, 1e-6


def n_words(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def _key(doc_id: str, text: str, source: str) -> Column:
    """By which documents are dealt and ordered, whatever the partitions."""
    return F.xxhash64(F.col(doc_id), whole_text(text), F.col(source))


def ranked(sources: DataFrame) -> DataFrame:
    """sources with place, from 0 by code point, null last: sorted by range, then counted by partition, in no single task."""
    sorted_ = sources.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source")
    numbered = materialize(sorted_.withColumn("at", F.monotonically_increasing_id()), "mix-ranks")
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    # a row per partition that has sources: the window and the broadcast are bounded by the number of partitions
    counts = numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return numbered.withColumn("part", part).join(F.broadcast(before), "part").withColumn("place", F.col("before") + inside).drop("part", "at", "before")


def source_targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, most: float = MOST_COPIES) -> DataFrame:
    """sizes (source, source_size, ...), a row per source: with target.

    Sources take the weights in turn by code point, null last. A source of no words gets no target. Each round the level
    rises to what the sources below their limits must take, given those at their limits; it stops when none joins those.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * float(most)
    now = materialize(ranked(sizes).withColumns({"weight": weight, "limit": limit}).drop("place"), "mix-weights")
    wanted, every = now.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted, level, stopped = total_share * (wanted or 0), 0.0, -1
    while every:
        at_limit = F.col("weight") * level >= F.col("limit")
        n, full, free = now.agg(F.count_if(at_limit), F.sum(F.when(at_limit, F.col("limit"))), F.sum(F.when(~at_limit, F.col("weight")))).first()
        if n == stopped or not free:
            break
        stopped, level = n, max(level, (wanted - (full or 0.0)) / free)
    return now.withColumn("target", F.least("limit", F.col("weight") * level)).drop("weight", "limit")


def _exact(x: Column) -> Column:
    """Thousandths as whole numbers, so that sums don't depend on their order and reruns agree."""
    return F.round(x * 1000).cast("decimal(28,0)")


def multipliers(counted: DataFrame, sources: DataFrame, most: float = MOST_COPIES) -> DataFrame:
    """counted (source, size, documents), sources (source, source_size, target, mean): with multiplier, by Newton.

    A target of the whole limit needs no multiplier: its documents are all taken `most` times. No row goes to the driver.
    """
    at, low, high = F.col("multiplier"), F.col("low"), F.col("high")
    open_ = (F.col("target") > 0) & (F.col("target") < most * F.col("source_size"))
    nothing = F.lit(None).cast("double")
    state = materialize(sources.withColumns({"multiplier": F.when(open_, 0.0), "low": nothing, "high": nothing, "going": F.coalesce(open_, F.lit(False))}), "mix-state")
    for _ in range(ROUNDS):
        going = state.where("going").select(F.col("source").alias("of"), "multiplier", "mean")
        if going.isEmpty():
            break
        tilt = F.least(F.exp(at * F.col("size") / F.col("mean")), F.lit(float(most)))
        tokens = F.col("documents") * F.col("size") * tilt
        slope = F.when(tilt < most, tokens * F.col("size") / F.col("mean")).otherwise(0.0)
        own = counted.join(going, counted["source"].eqNullSafe(F.col("of"))).groupBy("of")
        sums = own.agg((F.sum(_exact(tokens)).cast("double") / 1000).alias("tokens"), (F.sum(_exact(slope)).cast("double") / 1000).alias("slope"))
        miss = F.col("tokens") - F.col("target")
        moved = state.join(sums, F.col("going") & state["source"].eqNullSafe(F.col("of")), "left").withColumn("miss", miss)
        moved = moved.withColumns({"going": F.col("going") & (F.abs("miss") > NEAR * F.col("target")), "low": F.when(F.col("miss") > 0, low).otherwise(at), "high": F.when(F.col("miss") > 0, at).otherwise(high)})
        newton = at - F.try_divide(F.col("miss"), F.col("slope"))
        inside = F.coalesce(newton > low, low.isNull()) & F.coalesce(newton < high, high.isNull()) & newton.isNotNull()
        widen = 2 * at + F.when(high.isNull(), 1.0).otherwise(-1.0)
        step = F.when(inside, newton).otherwise(F.coalesce((low + high) / 2, widen))
        state = materialize(moved.withColumn("multiplier", F.when(F.col("going"), step).otherwise(at)).select(state.columns), "mix-state")
    return state.drop("low", "high", "going")


def _copies(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole copies of one group's documents, from the largest down, each nearest to what the running sum asks for."""
    pdf = pdf.sort_values(["size", "order", "row"], ascending=[False, True, True], kind="stable")
    owed, copies = 0.0, []
    for size, rate, most in zip(pdf["size"].tolist(), pdf["rate"].tolist(), pdf["most"].tolist()):
        owed += rate * size
        n = min(most, max(0, int(owed / size + 0.5))) if size else int(rate + 0.5)
        copies.append(n)
        owed -= n * size
    return pdf.assign(copies=copies)[["doc_id", "row", "size", "source_size", "target", "copies"]]


def mix_copies(
    docs: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, doc_id: str = "doc_id", text: str = "text", source: str = "source", row: Column | None = None
) -> DataFrame:
    """One row per row of docs: doc_id, row (its number, or what `row` says), size, source_size, target, copies (0 to 2).

    Null and empty texts have size 0; such documents have rate 1. A null source is a source of its own. Rows equal in id,
    text and source are interchangeable: which of them is taken does not show in the result. Reruns agree. An empty table
    gives no rows.
    """
    sized = materialize(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            n_words(text).alias("size"),
            _key(doc_id, text, source).alias("key"),
            (F.monotonically_increasing_id() if row is None else row).alias("row"),
        ),
        "mix-sizes",
    )
    counted = materialize(sized.groupBy("source", "size").agg(F.count("*").alias("documents")), "mix-counts")
    sizes = counted.groupBy("source").agg(
        F.sum(F.col("size") * F.col("documents")).alias("source_size"),
        F.sum("documents").alias("n"),
        (F.sum(F.col("size").cast("double") * F.col("documents")) / F.sum("documents")).alias("mean"),
    )
    tilted = multipliers(counted, source_targets(sizes, weights, total_share)).withColumnRenamed("source", "of")
    full = F.col("target") >= MOST_COPIES * F.col("source_size")
    rate = (
        F.when(F.col("size") == 0, 1.0)
        .when(full, float(MOST_COPIES))
        .when(F.col("target") > 0, F.least(F.exp(F.col("multiplier") * F.col("size") / F.col("mean")), F.lit(float(MOST_COPIES))))
        .otherwise(0.0)
    )
    rated = sized.join(tilted, sized["source"].eqNullSafe(tilted["of"])).select(
        "doc_id",
        "row",
        "source",
        "size",
        "source_size",
        "target",
        F.round(rate, 9).alias("rate"),
        F.lit(MOST_COPIES).alias("most"),
        "key",
        F.xxhash64(F.lit(3), "key").alias("order"),
        F.pmod(F.xxhash64(F.lit(4), "key"), F.ceil(F.col("n") / GROUP)).alias("group"),
    )
    own = ["doc_id", "row", "size", "source_size", "target", "copies"]
    alike = ["key", "size"]
    hot = materialize(sized.groupBy(*alike).agg(F.count("*").alias("alike")).where(F.col("alike") > GROUP), "mix-alike")
    if hot.isEmpty():
        return rated.groupBy("source", "group").applyInPandas(_copies, COPIES).select(own)
    marked = materialize(rated.join(hot, alike, "left"), "mix-marked")
    dealt = marked.where("alike IS NULL").drop("alike", "key").groupBy("source", "group").applyInPandas(_copies, COPIES)
    return dealt.select(own).unionByName(_copies_of_equals(marked.where("alike IS NOT NULL"), alike).select(own))


COPIES = "doc_id long, row long, size long, source_size long, target double, copies int"


def _copies_of_equals(rows: DataFrame, alike: list[str]) -> DataFrame:
    """rows (row, rate, most, alike, ...), each one of `alike` equal rows: with copies, whose sum is nearest to rate * alike.

    All get the whole part; the rest go to the first rows by number. A row's place is that in its partition, and the rows of
    partitions before: sums by partition, so that no task sees all equal rows.
    """
    part = F.shiftright("row", 33)
    counts = rows.groupBy(*alike, part.alias("part")).agg(F.count("*").alias("here"))
    before = Window.partitionBy(*alike).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = counts.select(*alike, "part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*alike, "part").orderBy("row"))
    placed = rows.withColumn("part", part).withColumn("inside", inside).join(offsets, [*alike, "part"])
    total = F.floor(F.col("rate") * F.col("alike") + 0.5).cast("long")
    whole_ = F.expr("__total div alike")
    return placed.withColumn("__total", total).withColumn("copies", F.least("most", whole_ + F.when(F.col("before") + F.col("inside") <= F.col("__total") % F.col("alike"), 1).otherwise(0)).cast("int"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """docs as the mix takes them: each row as often as it has copies, two times at most.

    Null and empty texts have rate 1, a null source is one of its own, an empty table gives no rows. Extra columns may have
    any names. Rows are numbered in a written table, a struct beside the number, and their copies are joined by that number;
    the texts shuffle once.
    """
    numbered = materialize(docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("own"), F.monotonically_increasing_id().alias("row")), "mix-numbered", "zstd")
    read = numbered.select("row", *[F.col(f"own.{c}").alias(name) for c, name in ((doc_id, "doc_id"), (text, "text"), (source, "source"))])
    copies = mix_copies(read, row=F.col("row"), **options)
    taken = copies.where("copies > 0").select("row", "copies")
    return numbered.join(taken.hint("shuffle_hash"), "row").select("own", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("own.*")


def op3_source_mix(spark, sf_dir: str) -> DataFrame:
    copies = mix_copies(table(spark, sf_dir, "documents"))
    return copies.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
