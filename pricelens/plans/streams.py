"""Queries that run streams to their end, and raw rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelens.plans.facts import DAY_MS, NOW_MS, Tables, fact_sql
from pricelens.plans.registry import part, query
from pricelens.sources.bronze import odds_rows, odds_rules, parse_json, replay_census, with_reason
from pricelens.sources.landing import expire, land
from pricelens.sources.pages import parse_pages
from pricelens.sources.sinks import new_history, write_boards
from pricelens.sources.storage import work_path
from pricelens.streaming.lifecycle import expired, fold, heads, swept
from pricelens.streaming.projection import project_current, read_current, read_table_stream


@query("SELECT snapshot_id, game, market, selection, book, american, observed_ms FROM current_quotes")
def stream_projection(t: Tables):
    """The events arrive in four files, each with old and new ones, a batch a file; the projection's end equals the batch result."""
    path = {k: work_path(t.spark, f"projection-{k}") for k in ("events", "current", "checkpoint")}
    t.events.repartition(4, F.pmod(F.xxhash64("event_id"), F.lit(4))).write.parquet(path["events"])
    stream = t.spark.sql(fact_sql("quotes", "spark"), events=read_table_stream(t.spark, path["events"], 1))
    project_current(stream, path["current"], path["checkpoint"]).awaitTermination()
    return read_current(t.spark, path["current"]).select("snapshot_id", "game", "market", "selection", "book", "american", "observed_ms")


part("raw_odds", """SELECT snapshot_id, CASE WHEN snapshot_id % 10 = 1 THEN '' ELSE CAST(game AS STRING) END AS event, CASE WHEN snapshot_id % 10 = 2 THEN 99 ELSE american END AS american, observed_ms,
  CASE WHEN snapshot_id % 10 = 3 THEN observed_ms - 1 ELSE retrieved_ms END AS retrieved_ms, snapshot_id % 10 = 4 AS torn FROM quotes""")


def _raw(t):
    n = F.col("snapshot_id") % 10
    own = F.struct(
        F.when(n == 1, "").otherwise(F.col("game").cast("string")).alias("event"), "market", "selection", "book", F.when(n == 2, 99).otherwise(F.col("american")).alias("american"),
        "point", "observed_ms", F.when(n == 3, F.col("observed_ms") - 1).otherwise(F.col("retrieved_ms")).alias("retrieved_ms"),
    )
    return t.quotes.select("snapshot_id", F.when(n == 4, F.concat(F.lit('["torn'), F.to_json(own))).otherwise(F.to_json(own)).alias("body"))


@query("""SELECT snapshot_id, CASE WHEN torn THEN 'malformed' WHEN event = '' THEN 'event-missing' WHEN abs(american) < 100 THEN 'odds-invalid' WHEN observed_ms > retrieved_ms THEN 'observed-after-retrieval' ELSE 'good' END AS reason,
  CASE WHEN NOT torn THEN american END AS american FROM raw_odds""")
def raw_odds_rows(t: Tables):
    from pricelens.sources.bronze import ODDS_SCHEMA

    judged = with_reason(parse_json(_raw(t), "body", ODDS_SCHEMA), odds_rules())
    return judged.select("snapshot_id", F.coalesce("reason", F.lit("good")).alias("reason"), F.col("parsed.american").alias("american"))


@query("SELECT state, count(*) AS n FROM (SELECT arg_min(state, struct_pack(a := observed_ms, b := snapshot_id)) AS state FROM quotes GROUP BY game, book) GROUP BY state")
def replay_outcomes(t: Tables):
    rows = t.quotes.withColumn("event", F.concat_ws(":", "game", "book"))
    return replay_census(rows, "event", ["observed_ms", "snapshot_id"], "state")


@query("""WITH s AS (SELECT snapshot_id, american FROM quotes WHERE provider <> 'gamma'), b AS (SELECT snapshot_id, CASE WHEN provider = 'beta' AND american > 150 THEN american + 1 ELSE american END AS american FROM quotes)
SELECT b.snapshot_id, CASE WHEN s.snapshot_id IS NULL THEN 'append' WHEN s.american = b.american THEN 'existing' ELSE 'conflicts' END AS outcome FROM b LEFT JOIN s USING (snapshot_id)""")
def history_append(t: Tables):
    """All quotes arrive, twice, where those of two providers are stored; some of one provider's have another price now."""
    changed = F.when((F.col("provider") == "beta") & (F.col("american") > 150), F.col("american") + 1).otherwise(F.col("american"))
    batch = t.quotes.select("snapshot_id", changed.alias("american"))
    own = new_history(t.quotes.where("provider <> 'gamma'").select("snapshot_id", "american"), batch.union(batch), "snapshot_id", ["american"])
    parts = [df.select("snapshot_id", F.lit(k).alias("outcome")) for k, df in own.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# pages of 40 events each: bad ids, starts and flags, numbers in place of an element, repeated ids, lists with bad entries
part("event_elements", """SELECT event // 40 AS page, event % 40 AS place, event, CASE WHEN event % 40 = 7 THEN 'e' || (event - 1) ELSE 'e' || event END AS id, home, away, start_ms,
  CASE event % 40 WHEN 1 THEN 'id' WHEN 2 THEN 'start' WHEN 3 THEN 'live' WHEN 4 THEN 'number' WHEN 5 THEN 'markets' WHEN 8 THEN 'home' ELSE '' END AS fault, event // 40 % 9 = 5 AS torn FROM schedule""")


def _event_pages(t):
    n = F.col("event")
    at = lambda k: n % 40 == k
    own = F.struct(
        F.when(at(1), "").when(at(7), F.concat(F.lit("e"), n - 1)).otherwise(F.concat(F.lit("e"), n)).alias("id"), "sport", "league",
        F.when(at(2), "soon").otherwise(F.date_format(F.timestamp_millis("start_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("start_time"), F.lit("scheduled").alias("status"),
        F.when(at(8), F.concat(F.lit(" "), "home")).otherwise(F.col("home")).alias("home_team"), F.col("away").alias("away_team"), F.array(F.lit("moneyline"), F.when(at(5), "").otherwise("spread")).alias("markets"), F.array(F.lit("alpha")).alias("books"),
    )
    flag = F.when(at(3), '"no"').otherwise("false")
    element = F.when(at(4), "17").otherwise(F.concat(F.lit('{"is_live":'), flag, F.lit(","), F.substring(F.to_json(own), 2, 1 << 20)))
    rows = t.schedule.select(F.floor(n / 40).alias("page"), F.struct((n % 40).alias("place"), element.alias("e")).alias("r"))
    joined = rows.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["e"]), ",").alias("data"))  # 40 rows a page
    body = F.concat(F.lit('{"data":['), "data", F.lit('],"pagination":{"has_more":true}}'))
    return joined.select("page", F.when(F.col("page") % 9 == 5, F.substring(body, 1, 50)).otherwise(body).alias("body"))


@query("""SELECT page, place AS row_index, event, sport_ AS sport, start_ms, fault = 'home' AS home_missing, CASE fault WHEN 'markets' THEN 'markets-entry-invalid' WHEN 'home' THEN 'home-participant-invalid' ELSE '' END AS warnings
FROM event_elements JOIN (SELECT event, sport AS sport_ FROM schedule) s USING (event) WHERE NOT torn AND fault NOT IN ('id', 'start', 'live', 'number') AND place <> 7""")
def event_pages(t: Tables):
    """Good elements of pages of events."""
    good, _ = parse_pages(_event_pages(t), "page", "body", "events")
    event = F.substring("id", 2, 20).cast("long")
    return good.select(F.col("page_id").alias("page"), F.col("row_index").cast("long").alias("row_index"), event.alias("event"), "sport", "start_ms", F.col("home").isNull().alias("home_missing"), F.array_join("warnings", ",").alias("warnings"))


@query("""SELECT page, place AS row_index, CASE WHEN place = 7 THEN 'duplicate-provider-id' ELSE 'invalid-row' END AS reason FROM event_elements WHERE NOT torn AND (fault IN ('id', 'start', 'live', 'number') OR place = 7)
UNION ALL SELECT DISTINCT page, -1, 'page-malformed' FROM event_elements WHERE torn""")
def event_page_quarantine(t: Tables):
    """Bad elements of the same pages, and pages that are none, with the reason."""
    _, bad = parse_pages(_event_pages(t), "page", "body", "events")
    return bad.select(F.col("page_id").alias("page"), F.col("row_index").cast("long").alias("row_index"), "reason")


@query("""WITH l AS (SELECT sport, league, count(*) AS n, count(*) FILTER (status = 'started') AS live, min(game) % 5 AS fault FROM games GROUP BY ALL)
SELECT sport AS page, league, n AS event_count, live AS live_count, CASE fault WHEN 1 THEN 'invalid-row' WHEN 2 THEN 'unrepresentable-filter-id' ELSE 'good' END AS reason FROM l""")
def league_pages(t: Tables):
    """A page per sport with its leagues and how many events they have; some counts are negative, some ids hold a comma."""
    leagues = t.games.groupBy("sport", "league").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "started").alias("live"), (F.min("game") % 5).alias("fault"))
    own = F.struct(
        F.when(F.col("fault") == 2, F.concat("league", F.lit(",x"))).otherwise(F.col("league")).alias("id"), F.concat(F.lit("League "), "league").alias("display_name"), "sport",
        F.when(F.col("fault") == 1, -F.col("n")).otherwise(F.col("n")).alias("event_count"), F.col("live").alias("live_count"),
    )
    pages = leagues.groupBy("sport").agg(F.concat(F.lit('{"data":'), F.to_json(F.collect_list(own)), F.lit("}")).alias("body"))
    good, bad = parse_pages(pages, "sport", "body", "leagues")
    element = F.from_json("element", "id string, event_count long, live_count long")
    other = bad.select(F.col("page_id").alias("page"), F.substring_index(element["id"], ",", 1).alias("league"), F.abs(element["event_count"]).alias("event_count"), element["live_count"].alias("live_count"), "reason")
    return good.select(F.col("page_id").alias("page"), F.col("id").alias("league"), "event_count", "live_count", F.lit("good").alias("reason")).unionByName(other)


@query("""SELECT id, 'moneyline' AS market, selection, CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(id % 101 AS DOUBLE) END AS bet_percent, CAST(id % 97 AS DOUBLE) AS money_percent, CAST(NULL AS DOUBLE) AS point FROM (SELECT id, unnest(['away', 'home']) AS selection FROM splits) WHERE id % 7 > 1 AND (selection = 'away' OR id % 3 > 0)
UNION ALL SELECT id, 'total', 'over', CAST(50 AS DOUBLE), NULL, CAST(id % 9 AS DOUBLE) FROM splits WHERE id % 7 > 1 AND id % 2 = 0""")
def split_pages_nested(t: Tables):
    """Selections of nested markets of split elements, a page per element; shares beyond 1 and markets without shares are bad."""
    n = F.col("id")
    shares = lambda x, other: F.struct((x / 100).alias("away"), F.when(n % 3 > 0, other / 100).alias("home"))
    moneyline = F.struct(F.when(n % 3 > 0, shares(n % 101, n % 101)).alias("bets_pct"), F.struct(((n % 97) / 100 + F.when(n % 7 == 0, 2).otherwise(0)).alias("away"), F.when(n % 3 > 0, (n % 97) / 100).alias("home")).alias("handle_pct"))
    bare = F.to_json(F.struct(F.col("id").alias("other")))
    total = F.when(n % 2 == 0, F.struct((n % 9).alias("line"), F.struct(F.lit(0.5).alias("over")).alias("bets_pct")))
    own = F.to_json(F.struct(n.cast("string").alias("event_id"), F.lit("s").alias("sport"), F.lit("l").alias("league"), F.lit("b").alias("sportsbook"), F.lit("h").alias("home_team"), F.lit("a").alias("away_team"), F.lit("2024-01-01T00:00:00Z").alias("fetched_at"), moneyline.alias("moneyline"), total.alias("total")))
    bad = F.concat(F.substring(own, 1, 1), F.lit('"spread":'), bare, F.lit(","), F.substring(own, 2, 1 << 20))
    pages = t.splits.select("id", F.concat(F.lit('{"data":['), F.when(n % 7 == 1, bad).otherwise(own), F.lit('],"pagination":{"has_more":false}}')).alias("body"))
    good, _ = parse_pages(pages, "id", "body", "splits")
    return good.select(F.col("page_id").alias("id"), F.inline("selections")).select("id", "market", "selection", "bet_percent", "money_percent", "point")


@query("""SELECT account, CASE WHEN account % 5 = 1 THEN 'features-entry' WHEN account % 5 = 2 THEN 'invalid-row' ELSE 'good' END AS reason, CASE WHEN account % 5 NOT IN (1, 2) THEN n END AS requests_per_minute FROM (SELECT account, count(*) AS n FROM bets GROUP BY account)""")
def account_pages(t: Tables):
    """An account page per account: its limits stand for its number of bets."""
    accounts, n = t.bets.groupBy("account").agg(F.count("*").alias("n")), F.col("account")
    own = F.struct(F.lit("pro").alias("tier"), F.array(F.lit("odds"), F.when(n % 5 == 1, " ").otherwise("splits")).alias("features"), F.struct(F.col("n").alias("requests_per_minute"), F.lit(5).alias("max_books")).alias("rate_limit"), F.when(n % 5 != 2, F.struct((n % 2 == 0).alias("enabled"))).alias("streaming"))
    pages = accounts.select("account", F.to_json(F.struct(own.alias("data"))).alias("body"))
    good, bad = parse_pages(pages, "account", "body", "account")
    return good.select(F.col("page_id").alias("account"), F.lit("good").alias("reason"), "requests_per_minute").unionByName(bad.select(F.col("page_id").alias("account"), "reason", F.lit(None).cast("long").alias("requests_per_minute")))


#: Raw rows are received in sweeps five days apart.
SWEEP_MS = 5 * DAY_MS
JUDGES = {"odds": lambda b: odds_rows(b, "body"), "quick-odds": lambda b: odds_rows(b, "body")}


def _landing(t):
    """Raw rows of three kinds: a kind by book, a provider, and the time of retrieval."""
    kind = F.when(F.col("book") == "circa", "odds").when(F.col("book") == "fanduel", "quick-odds").when(F.col("book") == "caesars", "rumours").otherwise("odds")
    return _raw(t).join(t.quotes.select("snapshot_id", "provider", (F.col("retrieved_ms") - F.col("retrieved_ms") % SWEEP_MS).alias("received_ms"), kind.alias("kind")), "snapshot_id")


@query(f"""SELECT r.snapshot_id, CASE WHEN book = 'caesars' THEN 'kind-unknown' WHEN torn THEN 'malformed' WHEN event = '' THEN 'event-missing' WHEN abs(r.american) < 100 THEN 'odds-invalid' WHEN r.observed_ms > r.retrieved_ms THEN 'observed-after-retrieval' ELSE 'good' END AS reason,
  q.provider, strftime(make_timestamp((q.retrieved_ms - q.retrieved_ms % {SWEEP_MS}) * 1000), '%Y-%m-%d') AS day FROM raw_odds r JOIN quotes q USING (snapshot_id) WHERE strftime(make_timestamp((q.retrieved_ms - q.retrieved_ms % {SWEEP_MS}) * 1000), '%Y-%m-%d') >= '2024-01-11' OR (book <> 'caesars' AND NOT torn AND event <> '' AND abs(r.american) >= 100 AND r.observed_ms <= r.retrieved_ms)""")
def landed_rows(t: Tables):
    """Raw rows of several kinds as files, read as a stream and landed by provider and day; then quarantined days older than 20 days expire."""
    at = {k: work_path(t.spark, f"landing-{k}") for k in ("raw", "good", "bad", "checkpoint")}
    _landing(t).repartition(4).write.parquet(at["raw"])
    land(read_table_stream(t.spark, at["raw"], 2), JUDGES, at["good"], at["bad"], at["checkpoint"]).awaitTermination()
    expire(t.spark, at["bad"], NOW_MS, 20)
    good = t.spark.read.parquet(at["good"]).select("snapshot_id", F.lit("good").alias("reason"), "provider", F.col("day").cast("string").alias("day"))
    return good.unionByName(t.spark.read.parquet(at["bad"]).select("snapshot_id", "reason", "provider", F.col("day").cast("string").alias("day")))


@query("""SELECT game, sport, league, status, strftime(make_timestamp(start_ms * 1000), '%Y%m%d') AS day FROM games""")
def board_sink(t: Tables):
    """Games written as one folder per board, twice, and read back: the second write replaces what the first left."""
    path = work_path(t.spark, "boards")
    day = F.date_format(F.timestamp_millis("start_ms"), "yyyyMMdd")
    games = t.games.select("game", "start_ms", "sport", "league", "status", day.alias("day"))
    write_boards(games.where("status <> 'unknown'"), path)
    write_boards(games, path)
    return t.spark.read.schema(games.schema).parquet(path).select("game", "sport", "league", "status", "day")


def _commands(t):
    n = F.col("event_id")
    states = F.array(*map(F.lit, ("active", "active", "stale", "suspended", "disqualified", "active", "closed")))
    at = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return t.events.select(
        F.concat_ws("-", "user_id", F.floor(n / 2) % 16).alias("key"), n.alias("seq"), F.concat(F.lit("c"), F.floor(n / 2) * F.lit(2)).alias("command"), (at - (n % 5) * 20_000_000).alias("at_ms"),
        F.element_at(states, (F.floor(F.col("value")) % 7 + 1).cast("int")).alias("state"), F.when(n % 4 == 0, "odds").otherwise("none").alias("reason"),
        F.when(n % 3 == 0, at + (n % 8) * DAY_MS).alias("expires_ms"),
    )


# a key's commands walked in order; a head moves only where the outcome is a transition
part("commands", f"""SELECT user_id || '-' || event_id // 2 % 16 AS key, event_id AS seq, 'c' || (event_id - event_id % 2) AS command, epoch_us(ts) // 1000 - event_id % 5 * 20000000 AS at_ms,
  (['active', 'active', 'stale', 'suspended', 'disqualified', 'active', 'closed'])[CAST(floor(value) AS BIGINT) % 7 + 1] AS state, CASE WHEN event_id % 4 = 0 THEN 'odds' ELSE 'none' END AS reason,
  CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) // 1000 + event_id % 8 * {DAY_MS} END AS expires_ms FROM events""")


def _folded(commands: str, name: str) -> str:
    move = "o = 'transition'"
    return f"""{name}_rows AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS k FROM {commands}),
{name} AS (SELECT key, k, command, 'transition' AS outcome, CAST(1 AS BIGINT) AS version, CAST(NULL AS VARCHAR) AS from_state, state AS to_state, at_ms, reason, expires_ms, command AS head_command, at_ms AS head_ms FROM {name}_rows WHERE k = 1
UNION ALL SELECT key, k, command, o, CASE WHEN {move} THEN version + 1 ELSE version END, to_state, CASE WHEN {move} THEN state ELSE to_state END, at_ms, CASE WHEN {move} THEN new_reason ELSE reason END, CASE WHEN {move} THEN new_expires ELSE expires_ms END,
  CASE WHEN {move} THEN command ELSE head_command END, CASE WHEN {move} THEN at_ms ELSE head_ms END
  FROM (SELECT c.key, c.k, c.command, c.state, c.at_ms, c.reason AS new_reason, c.expires_ms AS new_expires, h.version, h.to_state, h.reason, h.expires_ms, h.head_command, h.head_ms,
    CASE WHEN h.head_command = c.command THEN 'duplicate' WHEN h.to_state = 'closed' THEN 'closed' WHEN c.at_ms < h.head_ms THEN 'ignored-older' WHEN h.to_state = c.state AND h.reason = c.reason AND h.expires_ms IS NOT DISTINCT FROM c.expires_ms THEN 'noop' ELSE 'transition' END AS o
    FROM {name} h JOIN {name}_rows c ON c.key = h.key AND c.k = h.k + 1))"""


_HEADS = "SELECT key, version, to_state AS state, reason, at_ms, expires_ms FROM {} WHERE outcome = 'transition' QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC) = 1"
_SWEEP = f"SELECT key, 'sweep:' || key || ':{NOW_MS}' AS command, CAST({NOW_MS} AS BIGINT) AS at_ms, 'stale' AS state, 'candidate-evidence-stale' AS reason, CAST(NULL AS BIGINT) AS expires_ms FROM heads WHERE state = 'active' AND expires_ms <= {NOW_MS}"


@query(f"WITH RECURSIVE {_folded('commands', 'walk')} SELECT key, command, outcome, version, from_state, to_state, at_ms, reason, expires_ms FROM walk")
def lifecycle_fold(t: Tables):
    return fold(_commands(t))


@query(f"WITH RECURSIVE {_folded('commands', 'walk')} {_HEADS.format('walk')}")
def lifecycle_heads(t: Tables):
    return heads(fold(_commands(t)))


@query(f"WITH RECURSIVE {_folded('commands', 'walk')}, heads AS ({_HEADS.format('walk')}) {_SWEEP}")
def expiration_sweep(t: Tables):
    """Heads whose expiry has come, as commands."""
    return expired(heads(fold(_commands(t))), NOW_MS)


@query(f"""WITH RECURSIVE {_folded('commands', 'walk')}, heads AS ({_HEADS.format('walk')}), sweeps AS ({_SWEEP}), every AS (SELECT * FROM commands UNION ALL BY NAME SELECT *, {(1 << 63) - 1} AS seq FROM sweeps),
{_folded('every', 'again')} {_HEADS.format('again')}""")
def swept_heads(t: Tables):
    """Heads once the sweep's commands have gone through the same fold."""
    return swept(_commands(t), NOW_MS)
