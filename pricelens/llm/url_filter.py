"""URL filter: fixed rules first, then gradient-boosted trees on lexical features, all in DataFrame expressions.

URLs that a rule fits are the labelled ones. A URL's lexical features (lengths, depth, digit ratio, entropy, parameter
counts, hyphens, and how often its host's suffixes were blocked among labelled URLs) are binned into small whole numbers.
Suffix shares are shrunk to the overall rate, and a labelled URL's are counted without the fold of hosts it is in, so no
label helps to predict itself.
Labelled rows are counted by (bins, label), so training works on distinct combinations. Boosting grows trees level by
level: one aggregation gives gradient and Hessian sums per (leaf, feature, bin), a table bounded by the model's own
size, and the driver picks the splits. Sums are of whole numbers, so reruns grow the same trees. The model is a sum of
CASE expressions, scored where the rows are, without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import LOWER, UPPER, materialize, table

#: (host, path, verdict), fixed by the contract.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
TREES, DEPTH, RATE, RIDGE, LEAST_HESSIAN, SCALE = 10, 3, 0.3, 1.0, 1.0, 1 << 20
#: Suffix statistics are kept by this many buckets of hashes: every suffix counts, and the table's size is bounded.
SUFFIX_BUCKETS = 1 << 16
BINS = 16
#: Folds of hosts for the suffix statistics, how many URLs of the overall rate a share is mixed with, trees between two cuts of the margin.
FOLDS, SHRINK, CUT = 5, 20.0, 5


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a URL without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule over the columns host and path, as host + path, and its verdict; null if none fits."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        found, verdict = F.when(fits, host + path).otherwise(found), F.when(fits, says).otherwise(verdict)
    return found, verdict


def entropy(text: Column) -> Column:
    """Bits per character of a string of any length, over a-z and 0-9; other characters count in the length only."""
    size = F.greatest(F.char_length(text), F.lit(1))
    letters = F.split(F.lit("abcdefghijklmnopqrstuvwxyz0123456789"), "")
    shares = F.transform(letters, lambda c: (F.char_length(text) - F.char_length(F.replace(text, c, F.lit("")))) / size)
    return F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda bits, p: bits - p * F.log2(p))


def lexical(pages: DataFrame, url: str, rules=RULES) -> DataFrame:
    """pages with host, path, rule, verdict, buckets of two suffixes of the host, and binned features f0, f1, ..."""
    address = F.coalesce(F.col(url), F.lit(""))
    host, path = url_parts(address)
    rule, verdict = fitting_rule(rules)
    tail = F.regexp_extract(address, "[?#](.*)$", 1)
    n = lambda text, what: F.regexp_count(text, F.lit(what))
    own = pages.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "said": verdict})
    host, path = F.col("host"), F.col("path")
    size = F.greatest(F.char_length(address), F.lit(1))
    raw = [
        F.char_length(address) / 8,
        F.char_length(host) / 4,
        n(host, "[.]"),
        n(path, "/"),
        F.char_length(path) / 4,
        n(address, "[0-9]") / size * BINS,
        entropy(host) * 3,
        entropy(path) * 3,
        n(tail, "[^&#=]+="),
        F.char_length(tail) / 4,
        n(host, "-"),
        F.when(F.startswith(address, F.lit("https")), 1).otherwise(0),
    ]
    binned = {f"f{k}": F.least(F.floor(x), F.lit(BINS - 1)).cast("int") for k, x in enumerate(raw)}
    suffixes = {f"suffix_{k}": F.pmod(F.xxhash64(F.substring_index(host, ".", -k)), F.lit(SUFFIX_BUCKETS)) for k in (1, 2)}
    return own.withColumns(binned | suffixes | {"fold": F.pmod(F.xxhash64(F.lit(7), host), F.lit(FOLDS)).cast("int")})


N_LEXICAL = 12
FEATURES = [f"f{k}" for k in range(N_LEXICAL + 2)]


def with_suffix_statistics(own: DataFrame) -> DataFrame:
    """own with the last two features: the share of blocked labelled URLs by either suffix's bucket, shrunk, in bins.

    Of a labelled URL the other folds' labels count only; buckets without labels take the overall rate. A statistics table
    has SUFFIX_BUCKETS rows at most, of two numbers a fold, so it is broadcast.
    """
    labelled = own.where("said IS NOT NULL").select("suffix_1", "suffix_2", "fold", (F.col("said") == "block").cast("long").alias("blocked"))
    n, blocked = labelled.agg(F.count("*"), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    rate = round((blocked + 1) / (n + 2), 6)
    for k in (1, 2):
        name, feature = f"suffix_{k}", f"f{N_LEXICAL + k - 1}"
        of = lambda what: F.array(*[F.coalesce(F.sum(F.when(F.col("fold") == f, what)), F.lit(0)) for f in range(FOLDS)])
        stats = materialize(labelled.groupBy(name).agg(of(F.lit(1)).alias("n"), of(F.col("blocked")).alias("b")), "url-suffixes")
        total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y) - F.when(F.col("said").isNotNull(), F.get(c, F.col("fold"))).otherwise(0)
        share = (F.coalesce(total(F.col("b")), F.lit(0)) + SHRINK * rate) / (F.coalesce(total(F.col("n")), F.lit(0)) + SHRINK)
        own = own.join(F.broadcast(stats), name, "left").withColumn(feature, F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")).drop("n", "b")
    return own


@dataclass
class Leaf:
    """A leaf's conditions (feature, bin, whether above it), and its sums of gradient and Hessian."""

    path: tuple = ()
    sums: tuple[int, int] | None = None

    def holds(self) -> Column:
        return reduce(lambda x, y: x & y, [F.col(f) > b if above else F.col(f) <= b for f, b, above in self.path], F.lit(True))

    def value(self) -> float:
        g, h = self.sums
        return round(-RATE * (g / SCALE) / (h / SCALE + RIDGE), 9)


def tree_score(leaves: list[Leaf]) -> Column:
    out = F.lit(0.0)
    for leaf in leaves:
        out = F.when(leaf.holds(), F.lit(leaf.value())).otherwise(out)
    return out


def _split(sums: dict[tuple[str, int], tuple[int, int]], total: tuple[int, int]) -> tuple | None:
    """The best (gain, feature, bin, sums up to the bin) over a leaf's histogram; of equal gains the first feature, then the lowest bin."""
    score = lambda g, h: (g / SCALE) ** 2 / (h / SCALE + RIDGE)
    best = None
    for f in FEATURES:
        g = h = 0
        for b in range(BINS - 1):
            dg, dh = sums.get((f, b), (0, 0))
            g, h = g + dg, h + dh
            if min(h, total[1] - h) < LEAST_HESSIAN * SCALE:
                continue
            gain = score(g, h) + score(total[0] - g, total[1] - h) - score(*total)
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                best = (gain, f, b, (g, h))
    return best


def grow_tree(rows: DataFrame) -> list[Leaf]:
    """rows (FEATURES, g, h): the leaves of one tree. Each level takes one histogram of leaves * features * bins rows at most."""
    cells = F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in FEATURES]))
    done, leaves = [], [Leaf()]
    for _ in range(DEPTH):
        place = F.lit(None).cast("int")
        for k, leaf in enumerate(leaves):
            place = F.when(leaf.holds(), F.lit(k)).otherwise(place)
        cut = rows.select(place.alias("leaf"), "g", "h", cells).where("leaf IS NOT NULL")
        sums: dict[int, dict] = {}
        for r in cut.groupBy("leaf", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            sums.setdefault(r["leaf"], {})[r["feature"], r["bin"]] = (r["g"], r["h"])
        grown = []
        for k, leaf in enumerate(leaves):
            own = sums[k]
            leaf.sums = leaf.sums or tuple(sum(v[i] for (f, _), v in own.items() if f == FEATURES[0]) for i in (0, 1))
            best = _split(own, leaf.sums)
            if best is None:
                done.append(leaf)
            else:
                _, f, b, (g, h) = best
                grown += [Leaf((*leaf.path, (f, b, False)), (g, h)), Leaf((*leaf.path, (f, b, True)), (leaf.sums[0] - g, leaf.sums[1] - h))]
        leaves = grown
        if not leaves:
            break
    return done + leaves


def boosted(labelled: DataFrame) -> Column:
    """labelled (FEATURES, blocked 0 or 1): the model's log-odds of a block, as an expression over FEATURES."""
    rows = materialize(labelled.groupBy(*FEATURES, "blocked").agg(F.count("*").alias("n")), "url-counts")
    n, blocked = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("blocked")), F.lit(0))).first()
    prior = round(math.log((blocked + 1) / (n - blocked + 1)), 9)
    rows, trees, margin = rows.withColumn("margin", F.lit(prior)), [], F.col("margin")
    for k in range(TREES if n else 0):
        p = 1 / (1 + F.exp(-margin))
        g, h = F.round((p - F.col("blocked")) * SCALE).cast("long"), F.round(p * (1 - p) * SCALE).cast("long")
        trees.append(tree_score(grow_tree(rows.withColumns({"g": g * F.col("n"), "h": h * F.col("n")}))))
        margin = margin + trees[-1]
        if k % CUT == CUT - 1:
            rows, margin = materialize(rows.withColumn("margin", margin), "url-rows"), F.col("margin")
    return reduce(add, trees, F.lit(prior))


def featured(pages: DataFrame, page_id: str, url: str, rules=RULES, hidden: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, said, known, fold, FEATURES), written. Labels of the fold `hidden` are in said, but not known."""
    own = lexical(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")), "url", rules).withColumn("truth", F.col("said"))
    own = own.withColumn("said", F.when(F.col("fold") != F.lit(-1 if hidden is None else hidden), F.col("said")))
    own = with_suffix_statistics(own).select("page_id", "host", "path", "rule", F.col("truth").alias("said"), F.col("said").alias("known"), "fold", *FEATURES)
    return materialize(own, "url-features")


def _odds(own: DataFrame) -> Column:
    return F.round(boosted(own.where("known IS NOT NULL").select(*FEATURES, (F.col("known") == "block").cast("int").alias("blocked"))), 6)


def cross_validated(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """Labelled URLs only: page_id, said, odds by a model that knew no label of their fold of hosts, and the majority verdict
    of their last suffix among the other folds (null if unseen there)."""
    found = []
    for fold in range(FOLDS):
        own = featured(pages, page_id, url, rules, hidden=fold)
        tail = F.substring_index("host", ".", -1).alias("tail")
        others = own.where("known IS NOT NULL").groupBy(tail).agg(F.mode("known", True).alias("majority"))
        mine = own.where((F.col("fold") == fold) & F.col("said").isNotNull()).select("page_id", "said", _odds(own).alias("odds"), tail)
        found.append(mine.join(others, "tail", "left").drop("tail"))
    return reduce(DataFrame.unionByName, found)


def judge_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, blocked_odds (the model's log-odds, rules or not).

    Null URLs and those without :// have empty host and path, fit no rule, and are judged by the model like others. Repeated
    rows give repeated results. With no labelled URL the model allows all. An empty table gives no rows. Only id and url
    are read.
    """
    own = featured(pages, page_id, url, rules)
    odds = _odds(own)
    verdict = F.coalesce("said", F.when(odds > 0, "block").otherwise("allow"))
    return own.select("page_id", "host", "path", "rule", verdict.alias("verdict"), odds.alias("blocked_odds"))


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
