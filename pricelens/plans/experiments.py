"""Queries on experiments and on the provenance of calculations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelens.operators import experiments as E
from pricelens.operators.latest import current_quotes
from pricelens.plans.facts import DAY_MS
from pricelens.plans.registry import part, query

#: 1994-01-01, 1996-01-01 and 1998-01-01: where train, tune and holdout begin after the first.
TUNE_MS, HOLDOUT_MS = 757_382_400_000, 820_454_400_000

# two experiments for each half of the accounts: the second sees fewer decisions, or the same, as where evidence is used twice
part("cases", """SELECT account % 500 + 500 * c AS experiment, account % 500 AS k, c, id, game, created_ms, outcome FROM decisions CROSS JOIN (VALUES (0), (1)) copies(c)
  WHERE c = 0 OR account % 500 % 3 = 0 OR game % 5 > 0""")
part("case_roles", f"""SELECT *, 'train' AS role FROM cases WHERE created_ms < {TUNE_MS} UNION ALL SELECT *, 'tune' FROM cases WHERE created_ms >= {TUNE_MS} AND created_ms < {HOLDOUT_MS} UNION ALL SELECT *, 'holdout' FROM cases WHERE created_ms >= {HOLDOUT_MS}
  UNION ALL SELECT *, 'baseline' FROM cases WHERE created_ms >= {HOLDOUT_MS} AND (k % 7 <> 1 OR game % 10 > 0) UNION ALL SELECT *, 'challenger' FROM cases WHERE created_ms >= {HOLDOUT_MS} AND (k % 11 <> 2 OR id NOT LIKE '%-1-%')""")
part("case_members", """SELECT experiment, role, 'event' AS kind, CAST(game AS VARCHAR) AS id FROM case_roles UNION ALL SELECT experiment, role, 'member', id FROM case_roles
  UNION ALL SELECT experiment, role, 'result', id FROM case_roles WHERE role IN ('baseline', 'challenger') AND outcome <> 'unresolved' AND (role = 'baseline' OR k % 13 <> 3) AND k % 17 <> 5""")
part("case_ids", "SELECT experiment, kind, id, " + ", ".join(f"bool_or(role = '{r}') AS {r}" for r in E.ROLES) + " FROM case_members GROUP BY ALL")
part("case_digests", """SELECT experiment, role, sha256(count(*) || ':' || sum(CAST(('0x' || md5(kind || ':' || id)[:15]) AS BIGINT))) AS digest FROM (SELECT DISTINCT experiment, role, kind, id FROM case_members WHERE kind <> 'result') GROUP BY ALL""")


def _cases(t):
    copies = F.explode(F.array(F.lit(0), F.lit(1))).alias("c")
    own = t.decisions.select((F.col("account") % 500).alias("k"), copies, "id", "game", "created_ms", "outcome").where("c = 0 OR k % 3 = 0 OR game % 5 > 0").withColumn("experiment", F.col("k") + 500 * F.col("c"))
    held = F.col("created_ms") >= HOLDOUT_MS
    window = F.when(F.col("created_ms") < TUNE_MS, "train").when(held, "holdout").otherwise("tune")
    roles = F.array_compact(F.array(window, F.when(held & ((F.col("k") % 7 != 1) | (F.col("game") % 10 > 0)), "baseline"), F.when(held & ((F.col("k") % 11 != 2) | ~F.col("id").contains("-1-")), "challenger")))
    rows = own.select("*", F.explode(roles).alias("role"))
    result = F.col("role").isin("baseline", "challenger") & (F.col("outcome") != "unresolved") & ((F.col("role") == "baseline") | (F.col("k") % 13 != 3)) & (F.col("k") % 17 != 5)
    kinds = F.array_compact(F.array(F.struct(F.lit("event").alias("kind"), F.col("game").cast("string").alias("id")), F.struct(F.lit("member").alias("kind"), "id"), F.when(result, F.struct(F.lit("result").alias("kind"), "id"))))
    members = rows.select("experiment", "role", F.inline(kinds))
    k = F.col("k")
    experiments = own.select("experiment", "k").distinct().select(
        "experiment", F.col("experiment").alias("created_ms"), F.lit(TUNE_MS).alias("train_end"), (F.lit(TUNE_MS) - F.when(k % 9 == 4, DAY_MS).otherwise(0)).alias("tune_start"), F.lit(HOLDOUT_MS).alias("tune_end"), F.lit(HOLDOUT_MS).alias("holdout_start"),
        (F.lit(HOLDOUT_MS) + F.when(k % 10 == 5, 1).otherwise(-1)).alias("frozen_ms"), F.lit("a").alias("baseline"), F.when(k % 8 == 6, "b").otherwise("a").alias("baseline_evidence"), F.lit("c").alias("challenger"), F.lit("c").alias("challenger_evidence"),
    )
    return experiments, members


_SOME = lambda a, b, kind: f"bool_or(kind = '{kind}' AND {a} <> {b})"


@query(f"""WITH flags AS (SELECT experiment, bool_or(kind <> 'result' AND (train AND tune OR train AND holdout OR tune AND holdout)) AS overlap, {_SOME('holdout', 'baseline', 'event')} OR {_SOME('holdout', 'challenger', 'event')} AS universe,
  {_SOME('holdout', 'baseline', 'member')} OR {_SOME('holdout', 'challenger', 'member')} AS manifest, {_SOME('baseline', 'challenger', 'result')} OR NOT bool_or(kind = 'result' AND baseline) AS results FROM case_ids GROUP BY experiment),
used AS (SELECT d.experiment, max(d.digest) FILTER (role = 'tune') AS tune_digest, max(d.digest) FILTER (role = 'holdout') AS holdout_digest, bool_or(role = 'tune' AND l.digest IS NOT NULL) AS tune_used, bool_or(role = 'holdout' AND l.digest IS NOT NULL) AS holdout_used
  FROM case_digests d LEFT JOIN (SELECT DISTINCT digest FROM case_digests WHERE experiment < 500 AND experiment % 2 = 0 AND role IN ('tune', 'holdout')) l ON l.digest = d.digest AND d.experiment >= 500 WHERE role IN ('tune', 'holdout') GROUP BY d.experiment)
SELECT experiment, array_to_string(list_filter([CASE WHEN k % 10 = 5 THEN 'challenger-frozen-late' END, CASE WHEN holdout_used THEN 'holdout-evidence-reused' END, CASE WHEN manifest THEN 'holdout-member-manifest-mismatch' END, CASE WHEN universe THEN 'holdout-universe-mismatch' END,
  CASE WHEN results THEN 'result-evidence-mismatch' END, CASE WHEN k % 8 = 6 THEN 'strategy-evidence-mismatch' END, CASE WHEN tune_used THEN 'tune-evidence-reused' END, CASE WHEN k % 9 = 4 THEN 'window-chronology' END, CASE WHEN overlap THEN 'window-overlap' END], lambda x: x IS NOT NULL), ',') AS failures, tune_digest, holdout_digest
FROM (SELECT DISTINCT experiment, k FROM cases) LEFT JOIN flags USING (experiment) LEFT JOIN used USING (experiment)""")
def experiment_failures(t):
    """Experiments with all that is wrong with them; the second half of them against a ledger of what some of the first half used."""
    experiments, members = _cases(t)
    used = E.id_bits(members.where("experiment < 500 AND experiment % 2 = 0 AND role IN ('tune', 'holdout') AND kind <> 'result'")).groupBy("experiment").agg(E.manifest("tune").alias("a"), E.manifest("holdout").alias("b"))
    ledger = used.select(F.explode(F.array("a", "b")).alias("digest"), F.lit(499).alias("used_ms"))
    return E.failures(experiments, members, ledger).withColumn("failures", F.array_join("failures", ","))


def _nodes(quotes, american):
    """Prices, books and markets as calculations: a market's consensus is made of its books, a book's of its prices."""
    now, key = current_quotes(quotes), F.concat_ws(":", "game", "market")
    book = F.concat_ws(":", "game", "market", "book")
    kind = F.when((F.col("game") % 10 == 3) & (F.col("book") == "fanduel"), "implied").otherwise(F.concat(F.lit("implied:"), "selection"))
    price = now.select(F.concat_ws(":", "game", "market", "book", "selection").alias("node"), book.alias("parent"), F.lit(0).alias("level"), kind.alias("algorithm"), F.lit("1").alias("version"), american.cast("string").alias("input"))
    books = now.select(book.alias("node"), key.alias("parent"), F.lit(1).alias("level"), F.concat(F.lit("vig:"), "book").alias("algorithm"), F.lit("1").alias("version"), F.lit("").alias("input")).distinct()
    markets = now.select(key.alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(2).alias("level"), F.lit("consensus").alias("algorithm"), F.lit("2").alias("version"), F.col("market").alias("input")).distinct()
    return price.unionByName(books).unionByName(markets)


def _graph(american: str) -> str:
    entry = "algorithm || '@1@' || hash"
    rolled = f"string_agg({entry}, chr(10) ORDER BY {entry})"
    return f"""prices AS (SELECT game, market, book, game || ':' || market || ':' || book || ':' || selection AS node, game || ':' || market || ':' || book AS parent, CASE WHEN game % 10 = 3 AND book = 'fanduel' THEN 'implied' ELSE 'implied:' || selection END AS algorithm,
  sha256(CASE WHEN game % 10 = 3 AND book = 'fanduel' THEN 'implied' ELSE 'implied:' || selection END || chr(10) || '1' || chr(10) || {american} || chr(10)) AS hash FROM current_quotes),
books AS (SELECT game, market, parent AS node, game || ':' || market AS parent, 'vig:' || book AS algorithm, CASE WHEN count(DISTINCT algorithm) = count(*) THEN sha256('vig:' || book || chr(10) || '1' || chr(10) || chr(10) || {rolled}) END AS hash, CASE WHEN count(DISTINCT algorithm) < count(*) THEN 'duplicate-component' END AS issue, count(*) AS n FROM prices GROUP BY game, market, book, parent),
markets AS (SELECT parent AS node, market, CASE WHEN count(hash) = count(*) THEN sha256('consensus' || chr(10) || '2' || chr(10) || market || chr(10) || {rolled}) END AS hash, CASE WHEN count(hash) < count(*) THEN 'incomplete' END AS issue, count(*) AS n FROM books GROUP BY market, parent),
graph AS (SELECT node, parent, 0 AS level, hash, NULL AS issue, 0 AS n FROM prices UNION ALL SELECT node, parent, 1, hash, issue, n FROM books UNION ALL SELECT node, NULL, 2, hash, issue, n FROM markets)"""


@query(f"WITH {_graph('american')} SELECT node, level, n AS components, issue, hash FROM graph WHERE level > 0")
def provenance_roots(t):
    """Hashes of books and markets over the hashes of what they are made of."""
    own = E.provenance(_nodes(t.quotes, F.col("american")), 3).where("level > 0")
    return own.select("node", "level", F.size("components").cast("long").alias("components"), "issue", "hash")


@query("WITH " + _graph("american") + ", " + _graph("american + CASE WHEN snapshot_id % 50 = 0 THEN 1 ELSE 0 END").replace("prices", "prices_b").replace("books", "books_b").replace("markets", "markets_b").replace("graph", "graph_b") + """,
moved AS (SELECT a.node, a.level, a.parent FROM graph a JOIN graph_b b USING (node) WHERE a.hash IS DISTINCT FROM b.hash)
SELECT node, level, node NOT IN (SELECT parent FROM moved WHERE parent IS NOT NULL) AS origin FROM moved""")
def provenance_changes(t):
    """What differs between two calculations of all markets, and which components that goes back to."""
    other = F.col("american") + F.when(F.col("snapshot_id") % 50 == 0, 1).otherwise(0)
    return E.changed(E.provenance(_nodes(t.quotes, F.col("american")), 3), E.provenance(_nodes(t.quotes, other), 3))
