"""Matching of listings to scheduled events by start and labels, with bounded fan-out; clusters; merges; identities."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.pricing import first_reason
from pricelens.functions.text import eastern_day, folded, words_match, words_within


def near_in_time(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ms: str, right_ms: str, tolerance_ms: int) -> DataFrame:
    """Pairs of equal keys whose instants differ by the tolerance at most, right's columns under r_.

    The range condition becomes an equality on time buckets as wide as the tolerance: each right row enters its own and
    the two neighbouring buckets, so the join shuffles by (keys, bucket) and never compares all rows of a key.
    """
    bucket = lambda c: F.floor(F.col(c) / tolerance_ms)
    spread = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], F.explode(F.sequence(bucket(right_ms) - 1, bucket(right_ms) + 1)).alias("__bucket"))
    l = left.withColumn("__bucket", bucket(left_ms))
    on = [F.col(f"l.{k}") == F.col(f"r.r_{k}") for k in keys] + [F.col("l.__bucket") == F.col("r.__bucket")]
    pairs = l.alias("l").join(spread.alias("r"), on).where(F.abs(F.col(f"l.{left_ms}") - F.col(f"r.r_{right_ms}")) <= tolerance_ms)
    return pairs.select("l.*", *[f"r.r_{c}" for c in right.columns]).drop("__bucket")


def label_pairs(listings: DataFrame, schedule: DataFrame, tolerance_ms: int | None, keys: Sequence[str] = ("sport",)) -> DataFrame:
    """Listings with the events of equal keys that they match in labels and start, the event's columns under r_, and reversed.

    Labels that match share their last word, so the last words of both sides join as keys beside `keys` and the time bucket;
    a listing enters once as it stands and once with its sides swapped. What is left to compare is a few rows a key.
    Labels are folded once, before the join. Without a tolerance any start fits; then keys must bound what a key holds.
    """
    side = lambda home, away, turned: F.struct(F.col(home).alias("home"), F.col(away).alias("away"), F.lit(turned).alias("reversed"))
    rest = [c for c in listings.columns if c not in ("home", "away")]
    both = listings.select(*rest, F.inline(F.array(side("home", "away", False), side("away", "home", True))))
    plain = {"h_plain": folded(F.col("home")), "a_plain": folded(F.col("away"))}
    words = {"h_word": F.substring_index("h_plain", " ", -1), "a_word": F.substring_index("a_plain", " ", -1)}
    left, right = both.withColumns(plain).withColumns(words), schedule.withColumns(plain).withColumns(words)
    on = [*keys, "h_word", "a_word"]
    if tolerance_ms is None:
        own = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
        pairs = left.join(own, [left[k] == own[f"r_{k}"] for k in on])
    else:
        pairs = near_in_time(left, right, on, "start_ms", "start_ms", tolerance_ms)
    same = words_match(F.col("h_plain"), F.col("r_h_plain")) & words_match(F.col("a_plain"), F.col("r_a_plain"))
    return pairs.where(same).drop(*plain, *words, *[f"r_{c}" for c in (*plain, *words)])


def resolve(listings: DataFrame, schedule: DataFrame, tolerance_ms: int) -> DataFrame:
    """Each listing with the number of events that match in either orientation, its class and, if it is one, the event."""
    pairs = label_pairs(listings, schedule, tolerance_ms)
    found = pairs.groupBy("listing").agg(F.count_distinct("r_event").alias("n"), F.min("r_event").alias("event"), F.bool_and("reversed").alias("reversed"))
    own = listings.select("listing").join(found, "listing", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    kind = F.when(F.col("n") == 0, "no-candidate").when(F.col("n") == 1, "matched").otherwise("ambiguous")
    return own.select("listing", "n", kind.alias("class"), F.when(F.col("n") == 1, F.col("event")).alias("event"), F.when(F.col("n") == 1, F.col("reversed")).alias("reversed"))


#: The day in a provider's event id, and the suffix that its split feed leaves out.
EVENT_DAY, DAY_AT_END, BINDING_SUFFIX = r"(?:^|_)(\d{4}-\d{2}-\d{2})(?:_|$)", r"(?:^|_)\d{4}-\d{2}-\d{2}$", "_b[0-9]$"


def attribute_splits(splits: DataFrame, bindings: DataFrame, events: DataFrame, run: DataFrame) -> DataFrame:
    """splits with via and event: the event bound to the provider's id, else the only event of the same run that fits, else
    the only one bound to the id with a suffix _b0 to _b9; what none of them settles is a gap without event.

    Whatever a binding names must fit too: the sport, both labels or abbreviations of them on their sides and, where dated,
    the Eastern day in the provider's id. Suffixes are cut from the bindings, so all ten are one join.

    splits: rows (split, provider_event, sport, dated, home, away, ...), a row per split; bindings: (provider_event, event);
    events, and run, those seen in the same run: (event, sport, home, away, start_ms).
    """
    day = F.nullif(F.regexp_extract("provider_event", EVENT_DAY, 1), F.lit(""))
    own = splits.select("split", "provider_event", F.col("sport").alias("s_sport"), "dated", folded(F.col("home")).alias("h"), folded(F.col("away")).alias("a"), day.alias("day"))

    def scheduled(df: DataFrame) -> DataFrame:
        return df.select("event", F.col("sport").alias("e_sport"), folded(F.col("home")).alias("e_h"), folded(F.col("away")).alias("e_a"), eastern_day(F.col("start_ms")).cast("string").alias("e_day"))

    fits = (F.col("s_sport") == F.col("e_sport")) & words_within(F.col("e_h"), F.col("h")) & words_within(F.col("e_a"), F.col("a"))
    fits = fits & (~F.col("dated") | F.coalesce(F.col("day") == F.col("e_day"), F.lit(False)))

    def only(pairs: DataFrame, name: str) -> DataFrame:
        ends = pairs.where(fits).groupBy("split").agg(F.min("event").alias(name), F.max("event").alias("__last"))
        return ends.where(F.col(name) == F.col("__last")).select("split", name)

    bound = own.join(bindings, "provider_event").join(scheduled(events), "event")
    last = lambda c: F.substring_index(c, " ", -1)
    # candidates share sport, last words and, where dated, the day; an event enters once under its day and once under none
    dates = scheduled(run).withColumn("k_day", F.explode(F.array("e_day", F.lit(""))))
    keyed = own.withColumn("k_day", F.when(F.col("dated"), F.col("day")).otherwise(""))
    same = [F.col("s_sport") == F.col("e_sport"), last("h") == last("e_h"), last("a") == last("e_a"), keyed["k_day"] == dates["k_day"]]
    suffixed = bindings.where(F.col("provider_event").rlike(BINDING_SUFFIX)).withColumn("provider_event", F.regexp_replace("provider_event", BINDING_SUFFIX, ""))
    aliases = own.where(F.col("dated") & F.col("provider_event").rlike(DAY_AT_END)).join(suffixed, "provider_event").join(scheduled(events), "event")
    found = splits.join(only(bound, "__bound"), "split", "left").join(only(keyed.join(dates, same), "__seen"), "split", "left").join(only(aliases, "__alias"), "split", "left")
    via = F.when(F.col("__bound").isNotNull(), "binding").when(F.col("__seen").isNotNull(), "match").when(F.col("__alias").isNotNull(), "alias").otherwise("gap")
    return found.select(*splits.columns, via.alias("via"), F.coalesce("__bound", "__seen", "__alias").alias("event"))


def split_selections(attributed: DataFrame, markets: str = "markets") -> DataFrame:
    """A row per selection of each market of each split that has an event; markets: an array of (market, selections: an array of structs)."""
    rest = [c for c in attributed.columns if c != markets]
    each = attributed.where("event IS NOT NULL").select(*rest, F.inline(markets))
    return each.select(*rest, "market", F.inline("selections"))


def withdrawn(
    games: DataFrame, schedule: DataFrame, now_ms: int, tolerance_ms: int = 15 * 60_000, grace_ms: int = 15 * 60_000, witness_ms: int = 90 * 60_000
) -> DataFrame:
    """games with reason: why a game leaves its board, null if it stays.

    Only scheduled games that the schedule doesn't list within the tolerance can go. One whose pair of labels another game
    of the board has that is listed goes (vouched-sibling). Without split coverage a future one goes (future-no-witness)
    and one that may be in play stays. With coverage a game goes if its own last split is old (witness-silent), but only
    while some game of the board has a fresh one: a silent feed tells nothing. Nor does a missing schedule: without any event
    of a sport its board stays as it is.

    games: rows (listing, sport, status, home, away, start_ms, splits_expected, witness_ms), the board being the sport.
    """
    label = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    pair = {"__one": F.least(label("home"), label("away")), "__two": F.greatest(label("home"), label("away"))}
    listed = label_pairs(games.select("listing", "sport", "home", "away", "start_ms"), schedule, tolerance_ms).select("listing").distinct()
    own = games.withColumns(pair).join(listed.withColumn("__listed", F.lit(True)), "listing", "left")
    siblings = own.where("__listed").select("sport", *pair).distinct().withColumn("__sibling", F.lit(True))
    fresh = F.coalesce(F.lit(now_ms) - F.col("witness_ms") <= witness_ms, F.lit(False))
    feeds = games.groupBy("sport").agg(F.max(fresh).alias("__heard"))
    expected = F.coalesce("splits_expected", F.lit(False))
    why = first_reason(
        (F.col("__sibling").isNotNull(), "vouched-sibling"),
        (~expected & (F.col("start_ms") > now_ms + grace_ms), "future-no-witness"),
        (expected & F.col("__heard") & ~fresh, "witness-silent"),
    )
    known = schedule.select("sport").distinct().withColumn("__known", F.lit(True))
    judged = own.join(siblings, ["sport", *pair], "left").join(feeds, "sport", "left").join(known, "sport", "left")
    reason = F.when((F.col("status") == "scheduled") & F.col("__listed").isNull() & F.col("__known"), why)
    return judged.select(*games.columns, reason.alias("reason"))


def sides_found(hh: str, ha: str, ah: str, aa: str, one_is_enough: Column) -> Column:
    """Whether two labels tell which side of an event each is: hh says that home matches home, ha that home matches away, and so on."""
    home, away = F.col(hh) != F.col(ha), F.col(ah) != F.col(aa)
    alone = (home & ~F.col(ah) & ~F.col(aa)) | (away & ~F.col(hh) & ~F.col(ha))
    return (home & away & (F.col(hh) != F.col(ah))) | (one_is_enough & alone)


def drift_class(drift_ms: Column, secondary: Column, trusted: Column, primary_ms: int = 15 * 60_000, secondary_ms: int = 2 * 3_600_000) -> Column:
    """kept, trusted or rejected by how far a row's start is off its event's: one tolerance for rows of a secondary catalogue,
    another for all others; beyond it a row is kept if its source is trusted. A drift that isn't known is rejected."""
    within = drift_ms <= F.when(secondary, secondary_ms).otherwise(primary_ms)
    return F.when(within, "kept").when(trusted & drift_ms.isNotNull(), "trusted").otherwise("rejected")


def anchored_clusters(df: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], window: int) -> DataFrame:
    """df with cluster: a row within `window` of its cluster's first row joins it, else it begins a new one.

    The rule is greedy, so a cluster's start depends on the one before; a gap of more than the window always begins one.
    Spark first cuts a key's rows at such gaps, then sorts each gapless stretch into one partition, and a task walks its
    rows in order, a batch at a time, holding one anchor. Gaps are found within spans of time of 256 windows, and between
    spans by their last rows, so a hot key is many partitions. keys must be strings and not null.
    """
    span = [*keys, "__span"]
    spread = df.withColumn("__span", F.floor(F.col(at) / (256 * max(window, 1))))
    ends = spread.groupBy(*span).agg(F.max(at).alias("__last"))
    before = ends.select(*span, F.lag("__last").over(Window.partitionBy(*keys).orderBy("__span")).alias("__before"))
    w = Window.partitionBy(*span).orderBy(at, *order)
    near = spread.join(before, span).withColumn("__lag", F.coalesce(F.lag(at).over(w), "__before"))
    start = F.when(F.coalesce(F.col(at) - F.col("__lag") > window, F.lit(True)), F.col(at))
    cut_ = near.withColumn("__start", F.last(start, ignorenulls=True).over(w))
    firsts = cut_.groupBy(*span).agg(F.max("__start").alias("__s"))
    earlier = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    carried = firsts.select(*span, F.last("__s", ignorenulls=True).over(earlier).alias("__carried"))
    stretched = cut_.join(carried, span).withColumn("__stretch", F.coalesce("__start", "__carried")).select(*df.columns, "__stretch")
    whole = [*keys, "__stretch"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, anchor = None, 0
        for pdf in batches:
            anchors = []
            for *own, x in zip(*[pdf[k].tolist() for k in whole], pdf[at].tolist()):
                if own != now or x - anchor > window:
                    now, anchor = own, x
                anchors.append(anchor)
            yield pdf.drop(columns="__stretch").assign(cluster=anchors)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return stretched.repartition(*whole).sortWithinPartitions(*whole, at, *order).mapInPandas(walk, f"{kinds}, cluster bigint")


def merge_pages(pages: DataFrame, price_id: str, event: str) -> dict[str, DataFrame]:
    """Pages of one event merged: first-seen participants and start win, reversed rows have their sides swapped, other
    labels go to rejections, the newest observation of a price wins (the later row on ties), retrieval is the earliest.
    A price of an event that changes its side between pages is an error: it goes to conflicts, whole.

    pages: rows (event, price_id, home, away, start_ms, side, american, observed_ms, retrieved_ms, row).
    """
    first = pages.groupBy(event).agg(F.min_by(F.struct("home", "away", "start_ms"), "row").alias("__f"), F.min("retrieved_ms").alias("__retrieved"))
    both = pages.join(first, event)
    h, a, fh, fa = (folded(c) for c in (F.col("home"), F.col("away"), F.col("__f.home"), F.col("__f.away")))
    straight, turned = (h == fh) & (a == fa), (h == fa) & (a == fh)
    side = F.when(straight, F.col("side")).when(turned, F.when(F.col("side") == "home", "away").otherwise("home"))
    marked = both.select(event, price_id, F.col("__f.home").alias("home"), F.col("__f.away").alias("away"), F.col("__f.start_ms").alias("start_ms"), side.alias("side"), "american", "observed_ms", F.col("__retrieved").alias("retrieved_ms"), "row")
    rest = [c for c in marked.columns if c not in (event, price_id)]
    newest = marked.where("side IS NOT NULL").groupBy(event, price_id).agg(F.max_by(F.struct(*rest), F.struct("observed_ms", "row")).alias("__r"), F.count_distinct("side").alias("__n"))
    return {
        "prices": newest.where("__n = 1").select(event, price_id, "__r.*"),
        "rejections": marked.where("side IS NULL").select(event, price_id, "row"),
        "conflicts": newest.where("__n > 1").select(event, price_id),
    }


def upsert_decisions(observations: DataFrame, candidates: DataFrame) -> DataFrame:
    """observations (event, provider, revision, content, row) classed against candidates (event, n) and the provider's
    latest stored revision before each: no-candidate, ambiguous, conflict, skipped, refreshed or written.

    A conflict or an older revision stores nothing, so what is stored is the first row of the highest revision so far.
    """
    w = Window.partitionBy("provider", "event").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.struct("revision", (-F.col("row")).alias("first"), "content")).over(w)
    both = observations.withColumn("__b", before).join(candidates, "event", "left")
    kind = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "no-candidate")
        .when(F.col("n") > 1, "ambiguous")
        .when(F.col("__b").isNull(), "written")
        .when((F.col("revision") == F.col("__b.revision")) & (F.col("content") != F.col("__b.content")), "conflict")
        .when(F.col("revision") <= F.col("__b.revision"), "skipped")
        .when(F.col("content") == F.col("__b.content"), "refreshed")
        .otherwise("written")
    )
    return both.withColumn("decision", kind).drop("__b")


def collapse_duplicates(events: DataFrame, keys: Sequence[str], window_ms: int) -> DataFrame:
    """Of each anchored cluster the preferred row: version, evidence time, lifecycle rank, odds, then the smaller id."""
    from pricelens.operators.latest import latest_by

    clustered = anchored_clusters(events, keys, "start_ms", ["event"], window_ms)
    return latest_by(clustered, [*keys, "cluster"], ["version", "seen_ms", "lifecycle_rank", "has_odds", -F.col("event")])
