"""Whether experiments are valid: windows, sets of ids and evidence, each compared by one aggregation over all ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions.pricing import issues

#: What an id may be in, a bit each: the three windows, and the evidence of the two strategies.
ROLES = ("train", "tune", "holdout", "baseline", "challenger")
BIT = {r: 1 << k for k, r in enumerate(ROLES)}


def _has(role: str) -> Column:
    return F.col("in").bitwiseAND(F.lit(BIT[role])) > 0


def id_bits(members: DataFrame) -> DataFrame:
    """members (experiment, role, kind, id): a row per experiment, kind and id with the bits of the roles it has."""
    bit = F.coalesce(*[F.when(F.col("role") == r, b) for r, b in BIT.items()])
    return members.groupBy("experiment", "kind", "id").agg(F.bit_or(bit).alias("in"))


def manifest(role: str) -> Column:
    """An aggregate over id_bits: a digest of the events and members of a role, null if it has none.

    The digest sums a hash of each id, so it is built up before the shuffle and doesn't depend on any order.
    """
    own = _has(role) & F.col("kind").isin("event", "member")
    part = F.conv(F.substring(F.md5(F.concat_ws(":", "kind", "id")), 1, 15), 16, 10).cast("decimal(20,0)")
    n, total = F.count_if(own), F.sum(F.when(own, part)).cast("decimal(38,0)")
    return F.when(n > 0, F.sha2(F.concat_ws(":", n, total), 256))


def failures(experiments: DataFrame, members: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each experiment with the names of what is wrong with it, sorted, and the digests of its tune and holdout windows.

    experiments: (experiment, created_ms, train_end, tune_start, tune_end, holdout_start, frozen_ms, and the digests of both
    strategies beside those that their evidence names: baseline, baseline_evidence, challenger, challenger_evidence); members:
    rows (experiment, role, kind, id) with kind event, member or result; ledger: (digest, used_ms), what was used when.
    A pair of windows that share an id is one flag per id, whatever the number of ids; sets are equal if no id is in one only.
    Flags and digests come from one aggregation over the ids, after the one that puts each id's roles together.
    """
    of = lambda *kinds: F.col("kind").isin(*kinds)
    some = lambda x: F.coalesce(F.bool_or(x), F.lit(False))
    apart = lambda a, b: _has(a) != _has(b)
    shared = (_has("train") & _has("tune")) | (_has("train") & _has("holdout")) | (_has("tune") & _has("holdout"))
    flags = id_bits(members).groupBy("experiment").agg(
        some(of("event", "member") & shared).alias("overlap"),
        some(of("event") & (apart("holdout", "baseline") | apart("holdout", "challenger"))).alias("universe"),
        some(of("member") & (apart("holdout", "baseline") | apart("holdout", "challenger"))).alias("manifest"),
        some(of("result") & apart("baseline", "challenger")).alias("results"),
        some(of("result") & _has("baseline")).alias("has_results"),
        *[manifest(r).alias(f"{r}_digest") for r in ("tune", "holdout")],
    )
    both = experiments.join(flags, "experiment", "left")
    first = ledger.groupBy("digest").agg(F.min("used_ms").alias("used_ms"))
    for r in ("tune", "holdout"):
        own = first.select(F.col("digest").alias(f"{r}_digest"), F.col("used_ms").alias(f"{r}_used_ms"))
        both = both.join(own, f"{r}_digest", "left").withColumn(f"{r}_used", F.coalesce(F.col(f"{r}_used_ms") < F.col("created_ms"), F.lit(False)))
    wrong = issues(
        (F.col("frozen_ms") > F.col("holdout_start"), "challenger-frozen-late"), (F.col("holdout_used"), "holdout-evidence-reused"), (F.col("manifest"), "holdout-member-manifest-mismatch"), (F.col("universe"), "holdout-universe-mismatch"),
        (F.col("results") | ~F.coalesce("has_results", F.lit(False)), "result-evidence-mismatch"), ((F.col("baseline") != F.col("baseline_evidence")) | (F.col("challenger") != F.col("challenger_evidence")), "strategy-evidence-mismatch"),
        (F.col("tune_used"), "tune-evidence-reused"), ((F.col("train_end") > F.col("tune_start")) | (F.col("tune_end") > F.col("holdout_start")), "window-chronology"), (F.col("overlap"), "window-overlap"),
    )
    return both.select("experiment", wrong.alias("failures"), "tune_digest", "holdout_digest")


def content_hash(algorithm: Column, version: Column, own: Column, components: Column) -> Column:
    """SHA-256 of a calculation: what it runs, on what, and the entries of its components in order, null as none."""
    return F.sha2(F.concat_ws("\n", algorithm, version, own, F.coalesce(F.array_join(components, "\n"), F.lit(""))), 256)


def provenance(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes (node, parent, level, algorithm, version, input): each with hash, components and issue.

    Level 0 has no components; a node's components are the nodes whose parent it is, sorted by algorithm, version and hash,
    so a root's hash stands for all below it. A calculation with two components of one algorithm is rejected: no hash and
    issue duplicate-component, and those above it are incomplete. Each level is one aggregation by parent, of the few
    components that a calculation has.
    """
    out = below = None
    for level in range(levels):
        own = nodes.where(F.col("level") == level)
        if below is None:
            none = F.array().cast("array<string>")
            own = own.select("*", none.alias("components"), F.lit(None).cast("string").alias("issue"))
        else:
            own = own.join(below, "node", "left").withColumn("components", F.coalesce("components", F.array().cast("array<string>")))
        done = own.select("*", F.when(F.col("issue").isNull(), content_hash(F.col("algorithm"), F.col("version"), F.col("input"), F.col("components"))).alias("hash"))
        entry = F.concat_ws("@", "algorithm", "version", "hash")
        below = done.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
            F.sort_array(F.collect_list(entry)).alias("components"),
            F.when(F.count_distinct("algorithm") < F.count("*"), "duplicate-component").when(F.count("hash") < F.count("*"), "incomplete").alias("issue"),
        )
        out = done if out is None else out.unionByName(done)
    return out


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Nodes of two provenances whose hashes differ, added and removed ones too; origin: none of its components differs."""
    named = lambda df, side: df.select("node", F.col("level").alias(f"level_{side}"), F.col("parent").alias(f"parent_{side}"), F.col("hash").alias(f"hash_{side}"))
    both = named(before, "a").join(named(after, "b"), "node", "full").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
    found = both.select("node", F.coalesce("level_a", "level_b").alias("level"), F.coalesce("parent_a", "parent_b").alias("parent"))
    moved = found.where("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct().withColumn("moved", F.lit(True))
    return found.join(moved, "node", "left").select("node", "level", F.col("moved").isNull().alias("origin"))
