"""Counts of events that listings fuzzily match, without making the pairs: most of them follow from frequent words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions.text import fuzzy_parts, fuzzy_parts_match, long_words, plain_words, telling_words
from pricelens.operators.matching import near_in_time, sides_found
from pricelens.sources.storage import shared_dir

LABELS = ("home", "away")


def _written(df: DataFrame, name: str) -> DataFrame:
    """df by way of a table in the shared folder; its size is known to the plans that read it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _with_parts(df: DataFrame) -> DataFrame:
    """df with the fuzzy_parts of its labels as columns, one after the other, so that none is computed twice."""
    words = df.withColumns({f"{c}_words": plain_words(F.col(c)) for c in LABELS})
    own = words.withColumns({f"{c}_whole": F.array_join(f"{c}_words", "") for c in LABELS} | {f"{c}_own": telling_words(F.col(f"{c}_words")) for c in LABELS})
    return own.withColumns({f"{c}_long": long_words(F.col(f"{c}_own")) for c in LABELS}).drop(*[f"{c}_words" for c in LABELS])


def _parts(prefix: str) -> dict[str, Column]:
    return {x: F.col(f"{prefix}_{x}") for x in ("whole", "own", "long")}


def frequent_words(events: DataFrame, least: int, share: float, most: int = 63) -> list[str]:
    """The words of 4 letters or more that tell participants apart and yet stand in more than `least` events and more than
    that share of them, `most` of them at most, the most frequent first. events: with parts."""
    words = events.select(F.explode(F.array_union(*[F.col(f"{c}_long") for c in LABELS])).alias("word"))
    often = max(least, int(events.count() * share))
    return [r["word"] for r in words.groupBy("word").count().where(F.col("count") > often).orderBy(F.desc("count"), "word").limit(most).collect()]


def _bits(holds: Callable[[Column], Column], words: Sequence[str]) -> Column:
    """A long with bit k set where holds(word k)."""
    none = F.lit(0).cast("long")
    if not words:
        return none
    each = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(1 << k).cast("long").alias("bit")) for k, w in enumerate(words)])
    return F.aggregate(each, none, lambda bits, x: F.when(holds(x["word"]), bits.bitwiseOR(x["bit"])).otherwise(bits))


def _marked(df: DataFrame, words: Sequence[str]) -> DataFrame:
    """df, with parts, with three masks of each label over the frequent words: has, those in it; reach, those and the ones it
    is a part of; hides, those that its letters hold but not as words of its own. A label that is null has null masks."""
    masks = {}
    for c in LABELS:
        whole, long = F.col(f"{c}_whole"), F.col(f"{c}_long")
        in_it = lambda w: F.array_contains(long, w)  # noqa: B023, E731
        masks[f"{c}_has"] = _bits(in_it, words)
        masks[f"{c}_reach"] = _bits(lambda w: in_it(w) | (F.contains(w, whole) & (F.length(whole) >= 4)), words)  # noqa: B023
        masks[f"{c}_hides"] = _bits(lambda w: F.contains(whole, w) & ~in_it(w), words)  # noqa: B023
    return df.withColumns({name: F.when(F.col(name.split("_")[0]).isNotNull(), mask) for name, mask in masks.items()})


MASKS = tuple(f"{c}_{m}" for c in LABELS for m in ("has", "reach"))


def _overlap(has: str, reach: str, other_has: str, other_reach: str) -> Column:
    """Whether two labels match by frequent words: one is in both, or in one whose letters hold all of the other label."""
    return (F.col(has).bitwiseAND(F.col(other_reach)) != 0) | (F.col(reach).bitwiseAND(F.col(other_has)) != 0)


# Of two labels that match but not by frequent words, both have a key of one kind: w, a rare word of 4 letters or more; o, the
# words that tell, if all are shorter; e, the letters, if fewer than 4; or a run of 4 letters, of which a label within the other
# one gives one, and the other one all: i for listings within events, c for events within listings. Runs are compared
# whatever the start, for they are few; all other keys by sport and bucket.


def _keyed(df: DataFrame, words: Sequence[str], run: str, as_part: Callable[[str], Column]) -> DataFrame:
    """df, with parts, masks and bucket, with the keys of each label but all its runs; as_part: whether label c can be within another."""
    found = {}
    for c in LABELS:
        whole, own, long = _parts(c).values()
        rare = F.array_except(long, F.array(*map(F.lit, words)).cast("array<string>"))
        # one without digits if there is one, as numbers share theirs
        runs = F.transform(F.sequence(F.lit(1), F.length(whole) - 3), lambda i: F.substring(whole, i, F.lit(4)))  # noqa: B023
        one = F.array_min(F.transform(runs, lambda g: F.struct(g.rlike("[0-9]"), F.xxhash64(g), g.alias("run"))))["run"]
        tagged = F.transform(rare, lambda w: F.concat(F.lit("w"), w))
        short = F.when((F.size(long) == 0) & (F.size(own) > 0), F.concat(F.lit("o"), F.array_join(own, " ")))
        letters = F.when(F.length(whole) < 4, F.concat(F.lit("e"), whole))
        within = F.when(as_part(c) & (F.length(whole) >= 4), F.concat(F.lit(run), one))
        keys = F.array_compact(F.concat(tagged, F.array(short, letters, within)))
        found[f"{c}_keys"] = F.transform(keys, lambda x: F.when(F.substring(x, 1, 1) == run, F.xxhash64(x)).otherwise(F.xxhash64(x, "sport", "bucket")))
    return df.withColumns(found)


def _keys(df: DataFrame, *rest: str) -> DataFrame:
    """A row per key k of each label, with has and reach of the label."""
    each = [F.struct(*[F.col(f"{c}_{x}").alias(x) for x in ("has", "reach", "keys")]) for c in LABELS]
    return df.select(*rest, F.inline(F.array(*each))).select(*rest, "has", "reach", F.explode("keys").alias("k"))


def _runs(df: DataFrame, run: str, *rest: str) -> DataFrame:
    """A row per run of 4 letters of each label, as _keys."""
    each = [F.struct(*[F.col(f"{c}_{x}").alias(x) for x in ("has", "reach", "whole")]) for c in LABELS]
    long = df.select(*rest, F.inline(F.array(*each))).where(F.length("whole") >= 4)
    at = long.select(*rest, "has", "reach", "whole", F.explode(F.sequence(F.lit(1), F.length("whole") - 3)).alias("i"))
    return at.select(*rest, "has", "reach", F.xxhash64(F.concat(F.lit(run), F.substring(F.col("whole"), F.col("i"), F.lit(4)))).alias("k"))


def _hit(marks: dict[str, Column], near: Column) -> Column:
    """Whether a pair's four marks tell the sides, false where one isn't known."""
    home, away = marks["hh"] != marks["ha"], marks["ah"] != marks["aa"]
    alone = (home & ~marks["ah"] & ~marks["aa"]) | (away & ~marks["hh"] & ~marks["ha"])
    return F.coalesce((home & away & (marks["hh"] != marks["ah"])) | (near & alone), F.lit(False))


def _frequent_marks() -> dict[str, Column]:
    return {a[0] + b[0]: _overlap(f"{a}_has", f"{a}_reach", f"r_{b}_has", f"r_{b}_reach") for a in LABELS for b in LABELS}


def _counted(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("listing").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"))


def _by_pairs(listings: DataFrame, events: DataFrame, tolerance_ms: int, near_ms: int) -> DataFrame:
    """Matching events of each listing, every near pair compared."""
    parts = {c: fuzzy_parts(F.col(c)) for c in LABELS}
    pairs = near_in_time(listings.withColumns(parts), events.withColumns(parts), ["sport"], "start_ms", "start_ms", tolerance_ms)
    near = F.abs(F.col("start_ms") - F.col("r_start_ms")) <= near_ms
    marked = pairs.select("listing", "r_event", near.alias("near"), *[fuzzy_parts_match(F.col(a), F.col(f"r_{b}")).alias(a[0] + b[0]) for a in LABELS for b in LABELS])
    # a filter on the four marks would move below them and compare the labels again for each mention of a mark
    hit = F.when(sides_found("hh", "ha", "ah", "aa", F.col("near")), F.col("r_event"))
    found = marked.groupBy("listing", hit.alias("x")).agg(F.lit(1).cast("long").alias("n")).where("x IS NOT NULL")
    return found.select("listing", "n", "x")


def fuzzy_events(listings: DataFrame, schedule: DataFrame, tolerance_ms: int, near_ms: int, least: int = 20, share: float = 0.001) -> DataFrame:
    """Each listing with n, the number of events of its sport within the tolerance that fuzzily match, and event if n is 1.

    Both labels must each match one side, not the same; within near_ms one label that does so is enough if the other matches
    none. listings: rows (listing, sport, home, away, start_ms); schedule: (event, sport, home, away, start_ms); both ids long.

    Frequent words make most pairs match, so these aren't made: events of one start and the same frequent words are one group
    with a count, and a listing is compared with groups. Pairs whose labels match in another way share a rarer key, by which
    they are found; they add what they change of the count. The exclusive or of the events counted is the event of those that
    count one. Rows of an event, or of a listing, that comes in several forms are compared pair by pair, as they count once.
    """
    columns = ["sport", "home", "away", "start_ms"]
    width = 6 * tolerance_ms
    bucket = lambda at: F.floor(at / width)
    off = F.abs(F.col("start_ms") - F.col("r_start_ms"))
    renamed = lambda df: df.select(*[F.col(c).alias(f"r_{c}") for c in df.columns])
    again = lambda df, key: _written(df.groupBy(key).count().where("count > 1").select(key), "fuzzy-again")

    whole = " AND ".join(f"{c} IS NOT NULL" for c in ("event", *columns))
    events = _written(_with_parts(schedule.select("event", *columns).where(whole).distinct()), "fuzzy-events")
    words = frequent_words(events, least, share)
    more = again(events, "event")
    some_more = not more.isEmpty()
    single = _marked(events.join(more, "event", "left_anti") if some_more else events, words)
    told = single.agg(*[F.bit_or(f"{c}_hides").alias(c) for c in LABELS], F.max((F.col("home_has") == 0) | (F.col("away_has") == 0)).alias("bare")).first()
    hidden, bare = (told["home"] or 0) | (told["away"] or 0), bool(told["bare"])
    spread = F.explode(F.sequence(bucket(F.col("start_ms") - tolerance_ms), bucket(F.col("start_ms") + tolerance_ms)))
    placed = single.withColumn("bucket", spread)

    # a label that has frequent words can only be within an event's that hides them all
    marked = _marked(_with_parts(listings.select("listing", *columns).withColumn("bucket", bucket(F.col("start_ms")))), words)
    keyed = _keyed(marked, words, "i", lambda c: F.col(f"{c}_has").bitwiseAND(F.lit(~hidden)) == 0)
    every = _written(keyed.select("listing", *columns, "bucket", *MASKS, *[f"{c}_{x}" for c in LABELS for x in ("hides", "keys")]), "fuzzy-listings")
    unknown = every.where("listing IS NULL").select("listing", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("x"))
    known = every.where("listing IS NOT NULL")
    repeated = again(known, "listing")
    some_repeated = not repeated.isEmpty()
    own = known.join(repeated, "listing", "left_anti") if some_repeated else known

    # by frequent words
    groups = _written(renamed(placed.groupBy("sport", "bucket", "start_ms", *MASKS).agg(F.count("*").alias("n"), F.bit_xor("event").alias("x"))), "fuzzy-groups")
    both = own.select("listing", "sport", "bucket", "start_ms", *MASKS).join(groups, [F.col(c) == F.col(f"r_{c}") for c in ("sport", "bucket")], "left")
    hit = (off <= tolerance_ms) & _hit(_frequent_marks(), off <= near_ms)
    found = both.select("listing", F.when(hit, F.col("r_n")).otherwise(F.lit(0)).alias("n"), F.when(hit, F.col("r_x")).otherwise(F.lit(0)).alias("x"))

    # by rarer keys: those that labels of a listing and an event share which don't match by frequent words already
    holding = own if bare else own.where("home_hides <> 0 OR away_hides <> 0")
    held = bare or not holding.isEmpty()
    mine, theirs = (lambda *rest: _keys(own, *rest)), (lambda *rest: _keys(_keyed(placed, words, "c", lambda c: F.lit(held)), *rest))
    my_runs, their_runs = (lambda *rest: _runs(_with_parts(holding), "c", *rest)), (lambda *rest: _runs(placed if rest else single, "i", *rest))
    flagged = lambda keys, runs: keys().withColumn("run", F.lit(False)).unionByName(runs().withColumn("run", F.lit(True)))
    least_of = flagged(theirs, their_runs).groupBy("k").agg(F.bit_and("has").alias("r_has"), F.bit_and("reach").alias("r_reach"), F.max("run").alias("r_run"))
    shared = flagged(mine, my_runs).distinct().join(least_of, "k").where(~_overlap("has", "reach", "r_has", "r_reach"))
    shared = _written(shared.groupBy("k").agg(F.max("run").alias("run"), F.max("r_run").alias("r_run")), "fuzzy-keys")
    any_run = shared.agg(F.max("run").alias("mine"), F.max("r_run").alias("theirs")).first()
    left, right = mine("listing", "bucket", *columns), theirs("event", "bucket", *columns)
    left = left.unionByName(my_runs("listing", "bucket", *columns)) if any_run["mine"] else left
    right = right.unionByName(their_runs("event", "bucket", *columns)) if any_run["theirs"] else right
    left, right = (x.join(shared, "k", "left_semi").drop("has", "reach").distinct() for x in (left, right))
    close = left.join(renamed(right), [F.col(c) == F.col(f"r_{c}") for c in ("k", "sport", "bucket")]).where(off <= tolerance_ms)
    pairs = close.drop("k", "r_k", "bucket", "r_bucket").distinct()
    ours = _marked(_with_parts(pairs), words)
    turned = _marked(_with_parts(ours.select(F.struct(*ours.columns).alias("l"), *[F.col(f"r_{c}").alias(c) for c in LABELS])), words)
    compared = turned.select("l.*", *[F.col(c).alias(f"r_{c}") for c in turned.columns if c.startswith(("home_", "away_"))])
    exact = {a[0] + b[0]: fuzzy_parts_match(_parts(a), _parts(f"r_{b}")) for a in LABELS for b in LABELS}
    judged = compared.select("listing", "r_event", _hit(_frequent_marks(), off <= near_ms).alias("before"), *[x.alias(m) for m, x in exact.items()], (off <= near_ms).alias("near"))
    after = _hit({m: F.col(m) for m in exact}, F.col("near"))
    changed = judged.select("listing", (after.cast("long") - F.col("before").cast("long")).alias("n"), F.col("r_event").alias("x")).where("n <> 0")

    found = found.unionByName(changed)
    if some_more:
        found = found.unionByName(_by_pairs(own.select("listing", *columns), events.join(more, "event", "left_semi").select("event", *columns), tolerance_ms, near_ms))
    counted = _counted(found).unionByName(unknown)
    if some_repeated:
        rest = known.join(repeated, "listing", "left_semi").select("listing", *columns)
        pairwise = _counted(_by_pairs(rest.distinct(), events.select("event", *columns), tolerance_ms, near_ms))
        counted = counted.unionByName(rest.select("listing").join(pairwise, "listing", "left"))
    n = F.coalesce("n", F.lit(0))
    return counted.select("listing", n.alias("n"), F.when(n == 1, F.col("x")).alias("event"))
