"""Boards, listings, matching and ingestion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelens.functions import text as T
from pricelens.operators import board as B
from pricelens.operators import mapping
from pricelens.operators import matching as M
from pricelens.operators.fuzzy import fuzzy_events
from pricelens.operators.latest import current_availability, current_quotes, latest_by
from pricelens.plans.facts import BOOKS, DAY_MS, FIRST_MS, NOW_MS
from pricelens.plans.prices import dec, implied
from pricelens.plans.registry import part, query

TOLERANCE = 15 * 60_000
#: The catalogue whose rows may only alias.
SECONDARY = ["alt"]
#: 2024-01-16, in the middle of the schedule.
MIDDLE_MS = FIRST_MS + 15 * DAY_MS
PLAIN = f"translate({{0}}, '{T.DIACRITICS}', '{T.PLAIN_LETTERS}')"


def fold(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def match(a: str, b: str) -> str:
    """SQL for labels_match."""
    x, y = f"string_split({fold(a)}, ' ')", f"string_split({fold(b)}, ' ')"
    return f"({fold(a)} <> '' AND {fold(b)} <> '' AND {fold(a)} = {fold(b)} OR ({x}[-1] = {y}[-1] AND CASE WHEN len({x}) <= len({y}) THEN list_has_all({y}, {x}) ELSE list_has_all({x}, {y}) END))"


part("usable", "SELECT q.* FROM current_quotes q JOIN games g USING (game) WHERE q.version >= g.version - 1 AND q.state = 'active' AND q.observed_ms <= q.retrieved_ms")


@query("""WITH b AS (SELECT game, market, book, count(*) AS n, coalesce(abs(sum(point)), 0) AS off, max(american) FILTER (selection = 'home') AS home_price, max(american) FILTER (selection = 'away') AS away_price FROM usable WHERE book IN ('hardrock', 'draftkings', 'fanduel') GROUP BY ALL),
c AS (SELECT * FROM b WHERE n = 2 AND off <= 1e-9 AND market = 'moneyline' QUALIFY row_number() OVER (PARTITION BY game ORDER BY CASE book WHEN 'hardrock' THEN 1 WHEN 'draftkings' THEN 2 ELSE 3 END) = 1)
SELECT g.game, g.status, c.book, c.home_price, c.away_price FROM games g LEFT JOIN c USING (game)""")
def served_games(t):
    own = B.served_games(t.games, current_quotes(t.quotes), ["hardrock", "draftkings", "fanduel"])
    return own.select("game", "status", "book", F.try_element_at("prices", F.lit("home")).alias("home_price"), F.try_element_at("prices", F.lit("away")).alias("away_price"))


@query(f"""SELECT c.game, c.market, c.selection, b.book, q.american, coalesce(q.state, 'unavailable') AS state FROM (SELECT DISTINCT game, market, selection FROM current_quotes) c CROSS JOIN (SELECT unnest({list(BOOKS) + ['circa']}) AS book) b LEFT JOIN current_quotes q USING (game, market, selection, book)""")
def comparison_grid(t):
    return B.comparison_grid(current_quotes(t.quotes), [*BOOKS, "circa"]).select("game", "market", "selection", "book", "american", "state")


@query(f"""WITH v AS (SELECT *, CASE WHEN market = 'moneyline' THEN 0 ELSE point END AS p, american AS d FROM current_quotes)
SELECT snapshot_id, rank() OVER (PARTITION BY game, market, selection ORDER BY p DESC, d DESC) = 1 AS best FROM v""")
def best_cells(t):
    return B.best_cells(current_quotes(t.quotes)).select("snapshot_id", "best")


@query("""SELECT q.snapshot_id, s.american AS sharp FROM current_quotes q LEFT JOIN current_quotes s ON s.book = 'pinnacle' AND s.state = 'active' AND s.game = q.game AND s.market = q.market AND s.selection = q.selection AND s.point IS NOT DISTINCT FROM q.point""")
def sharp_anchors(t):
    return B.anchored(current_quotes(t.quotes)).select("snapshot_id", "sharp")


@query("""WITH s AS (SELECT game, market, selection, bet_percent FROM splits JOIN games USING (game) WHERE splits.version <= games.version QUALIFY row_number() OVER (PARTITION BY game, market, selection ORDER BY provider_ms DESC, retrieved_ms DESC, id DESC) = 1)
SELECT g.game, coalesce(string_agg(market || ':' || selection || ':' || CAST(CAST(bet_percent AS BIGINT) AS STRING), ',' ORDER BY market, selection), '') AS splits FROM games g LEFT JOIN s USING (game) GROUP BY g.game""")
def attached_splits(t):
    shown = F.transform("splits", lambda s: F.concat_ws(":", s["market"], s["selection"], s["bet"].cast("long")))
    return B.attach_splits(t.games, t.splits).select("game", F.array_join(shown, ",").alias("splits"))


@query(f"SELECT game, status, start_ms FROM games WHERE sport = 'soccer' AND status IN ('started', 'scheduled') AND start_ms >= {FIRST_MS + 8 * DAY_MS} AND start_ms < {FIRST_MS + 24 * DAY_MS}")
def event_list(t):
    return B.listed(t.games, sport="soccer", statuses=["started", "scheduled"], from_ms=FIRST_MS + 8 * DAY_MS, until_ms=FIRST_MS + 24 * DAY_MS).select("game", "status", "start_ms")


@query("SELECT game, status, start_ms FROM games WHERE status IN ('started', 'scheduled', 'completed', 'postponed', 'cancelled', 'unknown') ORDER BY start_ms, game LIMIT 25")
def merged_status_list(t):
    """A page of 25 by start and id."""
    return B.listed(t.games, statuses=B.LIFECYCLE).orderBy("start_ms", "game").limit(25).select("game", "status", "start_ms")


@query(f"SELECT game, home, away, league AS sort_key FROM games WHERE {PLAIN.format('home')} ILIKE '%atletico%' OR {PLAIN.format('away')} ILIKE '%atletico%'")
def explorer(t):
    """In order of the key downwards, then id; the order itself is tested apart."""
    return B.explore(t.games, "ATLÉTICO", "competition", descending=True).select("game", "home", "away", "sort_key")


@query(f"SELECT game, start_ms, CAST(timezone('America/New_York', timezone('UTC', make_timestamp(start_ms * 1000))) AS DATE) AS day FROM games")
def eastern_days(t):
    return t.games.select("game", "start_ms", T.eastern_day(F.col("start_ms")).alias("day"))


@query(f"""SELECT DISTINCT home, {fold('home')} AS folded, {fold(PLAIN.format('home'))} AS search, 'participant:' || replace(url_encode(home), '+', '%20') AS key FROM games""")
def label_forms(t):
    h = F.col("home")
    return t.games.select("home", T.folded(h).alias("folded"), T.searchable(h).alias("search"), T.selection_key(h).alias("key")).distinct()


_WIDE, _PLAIN = "".join(chr(0xFF41 + k) for k in range(26)), "abcdefghijklmnopqrstuvwxyz"


@query(f"""SELECT game, {fold(PLAIN.format("nfc_normalize(translate(label, '" + _WIDE + "', '" + _PLAIN + "'))"))} AS search FROM (SELECT game, CASE game % 3 WHEN 0 THEN translate(lower(home), '{_PLAIN}', '{_WIDE}') WHEN 1 THEN replace(home, 'é', 'e' || chr(769)) ELSE home END AS label FROM games)""")
def unicode_labels(t):
    """Labels some of which come in full-width letters or with their accents apart, as they are searched."""
    k = F.col("game") % 3
    wide = F.translate(F.lower("home"), _PLAIN, _WIDE)
    rows = t.games.select("game", F.when(k == 0, wide).when(k == 1, F.replace("home", F.lit("é"), F.lit("e\u0301"))).otherwise(F.col("home")).alias("label"))
    return T.composed(rows, "label").select("game", T.searchable(F.col("label")).alias("search"))


@query(f"""WITH x AS (SELECT q.*, p.american AS sharp, bool_and(p.american IS NOT NULL) OVER (PARTITION BY q.game, q.market) AS anchored, count(*) OVER (PARTITION BY q.game, q.market) AS n
  FROM current_quotes q LEFT JOIN current_quotes p ON p.book = 'pinnacle' AND p.game = q.game AND p.market = q.market AND p.selection = q.selection WHERE q.book = 'hardrock'),
y AS (SELECT *, CASE WHEN anchored THEN {implied('sharp')} ELSE {implied('american')} END AS p FROM x), z AS (SELECT game, n, (p / sum(p) OVER (PARTITION BY game, market) * {dec('american')} - 1) * 100 AS ev FROM y)
SELECT game, round(max(ev), 7) AS best_ev FROM z WHERE n >= 2 GROUP BY game HAVING max(ev) > 0.05e0""")
def games_with_edge(t):
    now = current_quotes(t.quotes)
    sharp = now.where("book = 'pinnacle'").select("game", "market", "selection", F.col("american").alias("sharp"))
    shown = now.where("book = 'hardrock'").join(sharp, ["game", "market", "selection"], "left")
    return B.games_with_edge(shown).withColumn("best_ev", F.round("best_ev", 7))


@query(f"""SELECT g.game FROM games g WHERE g.start_ms > {FIRST_MS + 12 * DAY_MS} AND EXISTS (SELECT 1 FROM current_quotes q WHERE q.game = g.game AND q.state = 'active')""")
def open_board_games(t):
    live = current_quotes(t.quotes).where("state = 'active'")
    return t.games.where(F.col("start_ms") > FIRST_MS + 12 * DAY_MS).join(live, "game", "left_semi").select("game")


@query(f"""WITH x AS (SELECT c.game, b.book, b.market FROM (SELECT game FROM games UNION SELECT game FROM quotes) c CROSS JOIN (VALUES ('hardrock', 'moneyline'), ('hardrock', 'total'), ('fanduel', 'moneyline'), ('fanduel', 'spread'), ('circa', 'moneyline')) b(book, market)),
p AS (SELECT game, book, market, count(*) AS n, count(*) FILTER (state = 'active' AND observed_ms >= {NOW_MS - 5 * DAY_MS} AND abs(american) <= 280 AND american <> 200) AS good, min(CASE WHEN abs(american) > 280 THEN 1 WHEN state = 'unavailable' THEN 2 WHEN state = 'suspended' THEN 3 WHEN observed_ms < {NOW_MS - 5 * DAY_MS} THEN 4 END) AS worst FROM current_quotes GROUP BY ALL)
SELECT x.game, x.book, x.market, CASE WHEN n IS NULL THEN 'missing' WHEN good > 0 THEN 'incomplete-market' WHEN worst = 1 THEN 'unsupported' WHEN worst = 2 THEN 'closed' WHEN worst = 3 THEN 'suspended' WHEN worst = 4 THEN 'stale' ELSE 'partial' END AS gap FROM x LEFT JOIN p USING (game, book, market) WHERE good IS NULL OR good < 2""")
def evidence_gaps(t):
    """Each book has markets of its own; prices beyond 280 stand for unsupported ones, 200 for alternate lines."""
    marked = current_quotes(t.quotes).withColumns({"unsupported": F.abs("american") > 280, "alternate": F.col("american") == 200})
    return B.evidence_gaps(t.games, marked, {"hardrock": ["moneyline", "total"], "fanduel": ["moneyline", "spread"], "circa": ["moneyline"]}, 2, NOW_MS, 5 * DAY_MS)


@query("""WITH bad AS (SELECT game, market, book FROM current_quotes GROUP BY ALL HAVING NOT (list_sort(list(selection)) = ['away', 'home'] AND coalesce(abs(sum(point)), 0) <= 1e-9))
SELECT q.snapshot_id, CASE WHEN bad.game IS NOT NULL THEN 'incomplete' WHEN state = 'suspended' THEN 'suspended' WHEN state = 'unavailable' THEN 'closed' ELSE 'active' END AS availability FROM current_quotes q LEFT JOIN bad USING (game, market, book)""")
def availability_rows(t):
    from pricelens.operators.qualify import complete_prices

    now, key = current_quotes(t.quotes), ["game", "market", "book"]
    bad = now.join(complete_prices(now, key, ["away", "home"]), key, "left_anti")
    return B.availability_rows(now, bad).select("snapshot_id", "availability")


@query("""WITH s AS (SELECT * FROM quotes QUALIFY row_number() OVER (PARTITION BY game, market, selection, book ORDER BY observed_ms DESC, state <> 'active' DESC, snapshot_id DESC) = 1),
g AS (SELECT * FROM quotes QUALIFY row_number() OVER (PARTITION BY game, market, book ORDER BY observed_ms DESC, state <> 'active' DESC, snapshot_id DESC) = 1)
SELECT q.snapshot_id, coalesce(s.state = 'active' AND s.observed_ms >= q.observed_ms AND g.state = 'active' AND g.observed_ms >= q.observed_ms, false) AS actionable FROM quotes q LEFT JOIN s USING (game, market, selection, book) LEFT JOIN g ON g.game = q.game AND g.market = q.market AND g.book = q.book""")
def actionable_quotes(t):
    """Every quote against the latest availability of its cell and of its book's market."""
    return B.actionable(t.quotes, current_availability(t.quotes), current_availability(t.quotes, ["game", "market", "book"])).select("snapshot_id", "actionable")


part("alpha", "SELECT game, max(american) AS v, max(CASE WHEN snapshot_id % 7 > 0 THEN floor(observed_ms / 86400000) END) AS at FROM quotes WHERE provider = 'alpha' AND market = 'moneyline' GROUP BY game")
part("beta", "SELECT game, max(american) AS v, max(CASE WHEN snapshot_id % 7 > 0 THEN floor(observed_ms / 86400000) END) AS at FROM quotes WHERE provider = 'beta' AND market = 'moneyline' GROUP BY game")


@query("""SELECT coalesce(a.game, b.game) AS game, CASE WHEN b.game IS NULL THEN 'missing' WHEN a.game IS NULL THEN 'extra' WHEN a.v = b.v THEN 'same' WHEN a.at IS NULL OR b.at IS NULL THEN 'indeterminate' WHEN a.at = b.at THEN 'mismatch' ELSE 'temporal' END AS kind FROM alpha a FULL JOIN beta b ON a.game = b.game""")
def route_reconciliation(t):
    return _reconciled(t.quotes)


def _reconciled(quotes):
    def route(name):
        own = quotes.where((F.col("provider") == name) & (F.col("market") == "moneyline"))
        at = F.max(F.when(F.col("snapshot_id") % 7 > 0, F.floor(F.col("observed_ms") / 86_400_000)))
        return own.groupBy("game").agg(F.max("american").alias("v"), at.alias("at"))

    return B.reconcile(route("alpha"), route("beta"), "game", F.sha2(F.col("v").cast("string"), 256), "at")


@query(f"""WITH x AS (SELECT game, league, row_number() OVER (PARTITION BY league ORDER BY game) - 1 AS i, count(*) OVER (PARTITION BY league) AS n FROM games)
SELECT game, league, (i - {NOW_MS // 60000} % n + n) % n AS place FROM x""")
def rotated_captures(t):
    return B.rotated(t.games, "game", ["league"], NOW_MS).select("game", "league", "place")


@query(f"""SELECT game, fresh_ms IS NULL OR {NOW_MS} - fresh_ms >= CASE WHEN start_ms > {NOW_MS - 8 * DAY_MS} AND start_ms - {NOW_MS - 8 * DAY_MS} <= 3600000 THEN 60000 ELSE 600000 END AS due,
  CASE WHEN fresh_ms IS NULL THEN 'unavailable' WHEN {NOW_MS} - fresh_ms <= 7200000 THEN 'current' ELSE 'stale' END AS freshness, CASE WHEN fresh_ms IS NULL THEN 'unavailable' WHEN status <> 'unknown' THEN 'complete' ELSE 'partial' END AS availability FROM games""")
def poll_due(t):
    return t.games.select("game", B.due(F.lit(NOW_MS) - F.col("fresh_ms"), F.col("start_ms") - (NOW_MS - 8 * DAY_MS)).alias("due"), T.metadata_freshness(F.col("fresh_ms"), F.lit(NOW_MS)).alias("freshness"), T.metadata_availability(F.col("status"), F.col("fresh_ms"), F.lit(NOW_MS)).alias("availability"))


part("provider_states", """SELECT *, CASE WHEN outage THEN 'outage' WHEN age_s IS NULL THEN 'unknown' WHEN age_s > 900 THEN 'stale' WHEN failed > 0 THEN 'partial' ELSE 'healthy' END AS connection,
  CASE WHEN remaining IS NULL OR remaining < 0 THEN 'unknown' WHEN remaining = 0 THEN 'exhausted' WHEN remaining <= reserve THEN 'reserve-protected' WHEN remaining <= 2 * reserve THEN 'low' ELSE 'available' END AS capacity
  FROM health QUALIFY row_number() OVER (PARTITION BY scope ORDER BY at_ms DESC, id DESC) = 1""")
part("provider_impacts", "SELECT *, CASE WHEN scope % 3 = 0 AND connection IN ('outage', 'unknown', 'stale') THEN 'suppressed' WHEN scope % 3 = 0 AND connection = 'partial' OR scope % 3 > 0 AND connection <> 'healthy' OR capacity IN ('reserve-protected', 'exhausted') THEN 'limited' ELSE 'none' END AS impact FROM provider_states")


def _states(t):
    now = latest_by(t.health, ["scope"], ["at_ms", "id"])
    own = now.withColumns({"connection": T.connection_state(F.col("outage"), F.col("age_s"), F.col("failed"), 900), "capacity": T.capacity_state(F.col("remaining"), F.col("reserve"))})
    capability = F.element_at(F.array(F.lit("odds"), F.lit("account"), F.lit("schedule")), (F.col("scope") % 3 + 1).cast("int"))
    return own.withColumn("impact", T.impact(capability, F.col("connection"), F.col("capacity")))


@query("SELECT scope, connection, capacity, impact FROM provider_impacts")
def provider_states(t):
    return _states(t).select("scope", "connection", "capacity", "impact")


@query("SELECT connection, count(*) AS n, count(*) FILTER (impact <> 'none') AS impacted FROM provider_impacts GROUP BY connection")
def provider_summary(t):
    return _states(t).groupBy("connection").agg(F.count("*").alias("n"), F.count_if(F.col("impact") != "none").alias("impacted"))


@query(f"""SELECT sport, count(*) AS n, count(*) FILTER (status = 'scheduled') AS upcoming, count(*) FILTER (p.game IS NOT NULL) AS priced, count(*) FILTER (fresh_ms IS NULL) AS unavailable, count(*) FILTER (fresh_ms < {NOW_MS} - 7200000) AS stale, min(fresh_ms) AS freshness_ms, max({NOW_MS} - p.oldest) AS worst_age_ms
FROM games LEFT JOIN (SELECT game, min(observed_ms) AS oldest FROM current_quotes WHERE state = 'active' GROUP BY game) p USING (game) GROUP BY sport""")
def board_counts(t):
    priced = current_quotes(t.quotes).where("state = 'active'").groupBy("game").agg(F.min("observed_ms").alias("oldest"))
    both = t.games.join(priced, "game", "left")
    return both.groupBy("sport").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "scheduled").alias("upcoming"), F.count("oldest").alias("priced"), F.count_if(F.col("fresh_ms").isNull()).alias("unavailable"),
        F.count_if(F.col("fresh_ms") < NOW_MS - 7_200_000).alias("stale"), F.min("fresh_ms").alias("freshness_ms"), F.max(F.lit(NOW_MS) - F.col("oldest")).alias("worst_age_ms"),
    )


@query(f"""SELECT q.snapshot_id, h.connection IS NULL OR h.connection IN ('stale', 'outage', 'unknown') AS unhealthy FROM current_quotes q LEFT JOIN provider_states h ON h.scope = q.game""")
def candidate_health(t):
    now = _states(t).select(F.col("scope").alias("game"), "connection")
    both = current_quotes(t.quotes).join(now, "game", "left")
    return both.select("snapshot_id", (F.col("connection").isNull() | F.col("connection").isin("stale", "outage", "unknown")).alias("unhealthy"))


part("pairs", f"""SELECT l.*, s.event, {match('l.home', 's.home')} AND {match('l.away', 's.away')} AS straight, {match('l.home', 's.away')} AND {match('l.away', 's.home')} AS turned
  FROM listings l JOIN schedule s ON s.sport = l.sport AND abs(l.start_ms - s.start_ms) <= 3600000""")
part("resolved", """SELECT listing, count(DISTINCT event) AS n, min(event) AS event, bool_and(NOT straight) AS reversed FROM pairs WHERE straight OR turned GROUP BY listing""")


@query("""SELECT l.listing, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'no-candidate' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS class, CASE WHEN n = 1 THEN event END AS event, CASE WHEN n = 1 THEN reversed END AS reversed
FROM listings l LEFT JOIN resolved r USING (listing)""")
def listing_matches(t):
    return M.resolve(t.listings, t.schedule, 3_600_000)


@query("SELECT DISTINCT listing FROM listings l WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.listing = l.listing AND abs(p.start_ms - (SELECT start_ms FROM schedule s WHERE s.event = p.event)) <= 900000 AND (straight OR turned))")
def withdrawn_listings(t):
    """Listings that no scheduled event vouches for within 15 minutes, in either orientation."""
    vouched = M.label_pairs(t.listings, t.schedule, TOLERANCE)
    return t.listings.join(vouched, "listing", "left_anti").select("listing")


part("board_entries", f"""SELECT l.listing, l.sport, CASE WHEN l.listing % 7 = 0 THEN 'started' ELSE 'scheduled' END AS status, l.home, l.away, l.start_ms,
  l.sport NOT IN ('ASIA', 'AFRICA') AS splits_expected, CASE WHEN l.sport = 'EUROPE' THEN w.at - 7200000 ELSE w.at END AS witness_ms
  FROM listings l LEFT JOIN (SELECT game, max(retrieved_ms) AS at FROM splits WHERE retrieved_ms <= {MIDDLE_MS} GROUP BY game) w ON w.game = l.listing % 40""")
part("entries_listed", f"SELECT DISTINCT p.listing FROM pairs p JOIN schedule s USING (event) WHERE (straight OR turned) AND abs(p.start_ms - s.start_ms) <= {TOLERANCE}")
part("entry_pairs", "SELECT listing, least(lower(trim(home)), lower(trim(away))) AS one, greatest(lower(trim(home)), lower(trim(away))) AS two FROM listings")


@query(f"""WITH siblings AS (SELECT DISTINCT sport, one, two FROM board_entries JOIN entry_pairs USING (listing) JOIN entries_listed USING (listing)),
feeds AS (SELECT sport, max(coalesce({MIDDLE_MS} - witness_ms <= 5400000, false)) AS heard FROM board_entries GROUP BY sport)
SELECT b.listing, CASE WHEN status <> 'scheduled' OR v.listing IS NOT NULL THEN NULL WHEN s.one IS NOT NULL THEN 'vouched-sibling'
  WHEN NOT splits_expected AND b.start_ms > {MIDDLE_MS} + 900000 THEN 'future-no-witness' WHEN splits_expected AND heard AND coalesce({MIDDLE_MS} - witness_ms > 5400000, true) THEN 'witness-silent' END AS reason
FROM board_entries b JOIN entry_pairs e USING (listing) LEFT JOIN entries_listed v USING (listing) LEFT JOIN siblings s ON s.sport = b.sport AND s.one = e.one AND s.two = e.two JOIN feeds f ON f.sport = b.sport""")
def withdrawn_games(t):
    """Every listing as of the middle of the month with the reason why it leaves the board, if one does."""
    witness = t.splits.where(F.col("retrieved_ms") <= MIDDLE_MS).groupBy(F.col("game").alias("__game")).agg(F.max("retrieved_ms").alias("at"))
    late = F.when(F.col("sport") == "EUROPE", F.col("at") - 7_200_000).otherwise(F.col("at"))
    games = t.listings.join(witness, F.col("__game") == F.col("listing") % 40, "left").select(
        "listing", "sport", F.when(F.col("listing") % 7 == 0, "started").otherwise("scheduled").alias("status"), "home", "away", "start_ms",
        (~F.col("sport").isin("ASIA", "AFRICA")).alias("splits_expected"), late.alias("witness_ms"),
    )
    return M.withdrawn(games, t.schedule, MIDDLE_MS, TOLERANCE).select("listing", "reason")


def _folded_match(a: str, b: str) -> str:
    x, y = f"string_split({a}, ' ')", f"string_split({b}, ' ')"
    return f"({a} = {b} OR CASE WHEN len({x}) <= len({y}) THEN list_has_all({y}, {x}) ELSE list_has_all({x}, {y}) END)"


_LAST = "string_split({0}, ' ')[-1]"


part("bound_feed", """SELECT f.*, lower(f.provider_event) LIKE 'alt\\_%' ESCAPE '\\' AS secondary, c.event, b.kind FROM feed f LEFT JOIN bindings b USING (provider_event) LEFT JOIN canonical c ON c.event = b.event""")
part("run_events", f"SELECT DISTINCT run, event, {fold('c.home')} AS h, {fold('c.away')} AS a FROM bound_feed JOIN canonical c USING (event)")
part("unbound_rows", f"SELECT listing, run, {fold('home')} AS h, {fold('away')} AS a FROM bound_feed WHERE secondary AND event IS NULL")


def _turned(h: str, a: str) -> str:
    ends = " AND ".join(f"{_LAST.format(x)} = {_LAST.format(y)}" for x, y in ((f"l.{h}", "s.h"), (f"l.{a}", "s.a")))
    return f"SELECT l.listing, s.event FROM unbound_rows l JOIN run_events s ON l.run = s.run AND {ends} WHERE l.h <> '' AND l.a <> '' AND {_folded_match(f'l.{h}', 's.h')} AND {_folded_match(f'l.{a}', 's.a')}"


part("feed_aliases", f"""SELECT u.listing, CASE WHEN count(DISTINCT p.event) = 1 THEN min(p.event) END AS event, CASE count(DISTINCT p.event) WHEN 0 THEN 'no-candidate' WHEN 1 THEN 'alias' ELSE 'ambiguous' END AS outcome
  FROM unbound_rows u LEFT JOIN ({_turned('h', 'a')} UNION {_turned('a', 'h')}) p USING (listing) GROUP BY u.listing""")


@query("SELECT listing, event, outcome FROM feed_aliases")
def secondary_aliases(t):
    """Rows of the secondary catalogue without a binding, bound by labels to an event of their run; never a new event."""
    return mapping.secondary_aliases(mapping.with_bindings(t.feed, t.bindings, t.canonical, SECONDARY), t.canonical)


def _mapped(t):
    return mapping.map_odds(t.feed, t.bindings, t.canonical, SECONDARY)


def _words(x: str) -> str:
    text = f"lower({PLAIN.format(x)})"
    for letter, written in T.WRITTEN_OUT:
        text = f"replace({text}, '{letter}', '{written}')"
    return f"regexp_extract_all({text}, '[a-z0-9]+')"


def _fuzzy(x: str, y: str) -> str:
    """SQL of fuzzy_match over the parts w (joined words), o (the words that tell, sorted)."""
    long = f"list_filter({x}_o, lambda w: length(w) >= 4)"
    return f"({x}_w = {y}_w OR (least(length({x}_w), length({y}_w)) >= 4 AND (contains({x}_w, {y}_w) OR contains({y}_w, {x}_w))) OR (len({x}_o) > 0 AND {x}_o = {y}_o) OR list_has_any({long}, {y}_o))"


def _parts(table: str, key: str) -> str:
    told = lambda c: f"list_sort(list_distinct(list_filter({_words(c)}, lambda w: w NOT IN {T.GENERIC_WORDS})))"
    return f"SELECT {key}, sport, start_ms, " + ", ".join(f"array_to_string({_words(c)}, '') AS {c[0]}_w, {told(c)} AS {c[0]}_o" for c in ("home", "away")) + f" FROM {table}"


def _comparable(c: str) -> str:
    told = f"list_sort(list_distinct(list_filter({_words(c)}, lambda w: w NOT IN {T.GENERIC_WORDS})))"
    return f"array_to_string({_words(c)}, '') AS {c}_w, {told} AS {c}_o"


part("feed_marks", f"""SELECT *, {_fuzzy('home', 'e_home')} AS hh, {_fuzzy('home', 'e_away')} AS ha, {_fuzzy('away', 'e_home')} AS ah, {_fuzzy('away', 'e_away')} AS aa FROM (
  SELECT f.listing, f.secondary, f.kind, f.retrieved_ms, c.event, a.outcome AS alias, c.start_ms AS e_start_ms, abs(f.start_ms - c.start_ms) AS off, {", ".join(map(_comparable, ("home", "away")))}, c.* EXCLUDE (event, start_ms)
  FROM bound_feed f LEFT JOIN feed_aliases a USING (listing) LEFT JOIN (SELECT event, start_ms, {", ".join(_comparable(c).replace(f"{c}_w", f"e_{c}_w").replace(f"{c}_o", f"e_{c}_o") for c in ("home", "away"))} FROM canonical) c ON c.event = coalesce(f.event, a.event))""")
part("mapped_feed", f"""SELECT listing, event, CASE WHEN retrieved_ms < e_start_ms THEN CASE WHEN off <= CASE WHEN secondary THEN 7200000 ELSE {TOLERANCE} END THEN 'kept' WHEN kind = 'source' AND off IS NOT NULL THEN 'trusted' ELSE 'rejected' END END AS drift,
  CASE WHEN hh <> ha AND ah <> aa AND hh <> ah THEN CASE WHEN hh THEN 'home' ELSE 'away' END WHEN off > {TOLERANCE} OR off IS NULL THEN NULL WHEN ah <> aa AND NOT hh AND NOT ha THEN CASE WHEN aa THEN 'home' ELSE 'away' END WHEN hh <> ha AND NOT ah AND NOT aa THEN CASE WHEN hh THEN 'home' ELSE 'away' END END AS side,
  e_start_ms, retrieved_ms, alias FROM feed_marks""")
part("judged_feed", """SELECT listing, event, drift, side, CASE WHEN event IS NULL THEN coalesce(alias, 'unresolved') WHEN e_start_ms IS NULL THEN 'start-time-conflict' WHEN retrieved_ms >= e_start_ms THEN 'after-start' WHEN drift = 'rejected' THEN 'start-time-conflict' WHEN side IS NULL THEN 'participant-mismatch' ELSE 'mapped' END AS outcome FROM mapped_feed""")


@query("SELECT listing, event, drift FROM judged_feed WHERE drift IS NOT NULL")
def start_drift(t):
    """Rows with an event by how far their start is off its start; each row by its catalogue's tolerance."""
    return _mapped(t).where("drift IS NOT NULL").select("listing", "event", "drift")


@query("SELECT listing, event, outcome, CASE WHEN outcome = 'mapped' THEN side END AS home_side FROM judged_feed")
def odds_mapping(t):
    """Every row of the feed with what became of it, and the side of the event that its home label is on."""
    return _mapped(t).select("listing", "event", "outcome", "home_side")


@query(f"""WITH l AS ({_parts('listings', 'listing')}), s AS ({_parts('schedule', 'event')}),
p AS (SELECT listing, event, abs(l.start_ms - s.start_ms) AS d, {_fuzzy('l.h', 's.h')} AS hh, {_fuzzy('l.h', 's.a')} AS ha, {_fuzzy('l.a', 's.h')} AS ah, {_fuzzy('l.a', 's.a')} AS aa FROM l JOIN s ON l.sport = s.sport AND abs(l.start_ms - s.start_ms) <= 3600000),
f AS (SELECT listing, count(DISTINCT event) AS n, min(event) AS event FROM p WHERE (hh <> ha AND ah <> aa AND hh <> ah) OR (d <= {TOLERANCE} AND ((hh <> ha AND NOT ah AND NOT aa) OR (ah <> aa AND NOT hh AND NOT ha))) GROUP BY listing)
SELECT l.listing, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN f.event END AS event FROM listings l LEFT JOIN f USING (listing)""")
def fuzzy_labels(t):
    """Every listing with the number of events of its sport within an hour that it fuzzily matches, and the event if it is one.

    Both labels must each match one side, not the same; within 15 minutes one label that does so is enough if the other
    matches none.
    """
    return fuzzy_events(t.listings, t.schedule, 3_600_000, TOLERANCE)


@query(f"""WITH b AS (SELECT listing, listing % 1500 AS bound FROM listings WHERE listing % 4 = 0)
SELECT l.listing, CASE WHEN b.bound IS NOT NULL THEN 'binding' WHEN r.n = 1 THEN 'match' WHEN a.event IS NOT NULL THEN 'alias' ELSE 'gap' END AS via, coalesce(b.bound, CASE WHEN r.n = 1 THEN r.event END, a.event) AS event
FROM listings l LEFT JOIN b USING (listing) LEFT JOIN resolved r USING (listing) LEFT JOIN (SELECT event FROM schedule) a ON a.event = l.listing - 10000 AND l.listing % 3 = 0""")
def attribution_cascade(t):
    """An exact binding first, then a unique match, then an alias; what none resolves is a gap."""
    bound = t.listings.where("listing % 4 = 0").select("listing", (F.col("listing") % 1500).alias("bound"))
    unique = M.resolve(t.listings, t.schedule, 3_600_000).where("n = 1").select("listing", F.col("event").alias("matched"))
    alias = t.schedule.select((F.col("event") + 10000).alias("listing"), F.col("event").alias("alias")).where("listing % 3 = 0")
    both = t.listings.join(bound, "listing", "left").join(unique, "listing", "left").join(alias, "listing", "left")
    via = F.when(F.col("bound").isNotNull(), "binding").when(F.col("matched").isNotNull(), "match").when(F.col("alias").isNotNull(), "alias").otherwise("gap")
    return both.select("listing", via.alias("via"), F.coalesce("bound", "matched", "alias").alias("event"))


def _day(ms: str) -> str:
    return f"CAST(CAST(timezone('America/New_York', timezone('UTC', make_timestamp(({ms}) * 1000))) AS DATE) AS VARCHAR)"


# provider ids with the event's day, some a day off or without it, some with a suffix; bindings of the id, of suffixed ids, and wrong ones
part("split_pages", f"""SELECT listing AS split, 'e' || o_custkey || CASE WHEN listing % 9 = 0 THEN '' ELSE '_' || {_day("s.start_ms + CASE WHEN listing % 8 = 0 THEN 86400000 ELSE 0 END")} END || CASE WHEN listing % 11 = 0 THEN '_b1' ELSE '' END AS provider_event,
  l.sport, l.sport <> 'ASIA' AS dated, l.home, l.away FROM listings l JOIN orders ON o_orderkey = listing JOIN schedule s ON s.event = o_custkey""")
part("split_bindings", f"""SELECT 'e' || event || '_' || {_day('start_ms')} || CASE event % 3 WHEN 0 THEN '' ELSE '_b' || (event % 4) END AS provider_event, event + CASE WHEN event % 21 < 2 THEN 1 ELSE 0 END AS event FROM schedule WHERE event % 4 > 0""")
part("split_pairs", f"""SELECT p.split, s.event, s.event % 2 = 0 AS seen, p.provider_event, p.dated FROM split_pages p JOIN schedule s ON s.sport = p.sport AND {match('p.home', 's.home')} AND {match('p.away', 's.away')}
  AND len(string_split({fold('p.home')}, ' ')) <= len(string_split({fold('s.home')}, ' ')) AND len(string_split({fold('p.away')}, ' ')) <= len(string_split({fold('s.away')}, ' '))
  AND string_split({fold('p.home')}, ' ')[-1] = string_split({fold('s.home')}, ' ')[-1]
  AND (NOT p.dated OR regexp_extract(p.provider_event, '(?:^|_)([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})(?:_|$)', 1) = {_day('s.start_ms')})""")
part("split_events", """SELECT split, CASE WHEN b.event IS NOT NULL THEN 'binding' WHEN r.event IS NOT NULL THEN 'match' WHEN a.event IS NOT NULL THEN 'alias' ELSE 'gap' END AS via, coalesce(b.event, r.event, a.event) AS event FROM split_pages
  LEFT JOIN (SELECT split, min(x.event) AS event FROM split_pairs x JOIN split_bindings y USING (provider_event, event) GROUP BY split HAVING count(DISTINCT x.event) = 1) b USING (split)
  LEFT JOIN (SELECT split, min(event) AS event FROM split_pairs WHERE seen GROUP BY split HAVING count(DISTINCT event) = 1) r USING (split)
  LEFT JOIN (SELECT split, min(x.event) AS event FROM split_pairs x JOIN split_bindings y ON y.event = x.event AND left(y.provider_event, -3) = x.provider_event AND y.provider_event[-3:-2] = '_b'
    WHERE dated AND regexp_matches(x.provider_event, '(?:^|_)[0-9]{4}-[0-9]{2}-[0-9]{2}$') GROUP BY split HAVING count(DISTINCT x.event) = 1) a USING (split)""")


def _attributed_splits(t):
    day = lambda ms: T.eastern_day(ms).cast("string")
    s = t.schedule.select(F.col("event").alias("o_custkey"), F.col("start_ms").alias("begin_ms"))
    k, off = F.col("listing"), F.when(F.col("listing") % 8 == 0, DAY_MS).otherwise(0)
    dated_id = F.concat(F.lit("e"), "o_custkey", F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("_"), day(F.col("begin_ms") + off))), F.when(k % 11 == 0, "_b1").otherwise(""))
    splits = t.listings.join(t.orders.select(F.col("o_orderkey").alias("listing"), "o_custkey"), "listing").join(s, "o_custkey").select(
        k.alias("split"), dated_id.alias("provider_event"), "sport", (F.col("sport") != "ASIA").alias("dated"), "home", "away"
    )
    e = F.col("event")
    bound_id = F.concat(F.lit("e"), e, F.lit("_"), day(F.col("start_ms")), F.when(e % 3 == 0, "").otherwise(F.concat(F.lit("_b"), e % 4)))
    bindings = t.schedule.where(e % 4 > 0).select(bound_id.alias("provider_event"), (e + F.when(e % 21 < 2, 1).otherwise(0)).alias("event"))
    return M.attribute_splits(splits, bindings, t.schedule, t.schedule.where(e % 2 == 0))


@query("SELECT split, via, event FROM split_events")
def attributed_split_events(t):
    """Splits by what their event is known from: a binding, the same run, a suffixed binding, or nothing."""
    return _attributed_splits(t).select("split", "via", "event")


@query("""SELECT split, event, market, selection, CAST(split * k % 101 AS BIGINT) AS bet_percent FROM split_events
CROSS JOIN (VALUES ('moneyline', 'home', 7), ('moneyline', 'away', 11), ('spread', 'home', 13)) m(market, selection, k) WHERE event IS NOT NULL""")
def attributed_split_rows(t):
    """A row per selection of the nested markets of every split that has an event."""
    cell = lambda selection, k: F.struct(F.lit(selection).alias("selection"), (F.col("split") * k % 101).alias("bet_percent"))
    market = lambda name, *cells: F.struct(F.lit(name).alias("market"), F.array(*cells).alias("selections"))
    nested = F.array(market("moneyline", cell("home", 7), cell("away", 11)), market("spread", cell("home", 13)))
    return M.split_selections(_attributed_splits(t).withColumn("markets", nested)).select("split", "event", "market", "selection", "bet_percent")


part("page_rows", """SELECT floor(listing / 4) AS event, CAST(floor(listing / 2) AS BIGINT) * 7 % 3000 AS price_id, home, away, start_ms, CASE WHEN listing % 3 = 0 THEN 'home' ELSE 'away' END AS side, CAST(100 + listing % 150 AS INT) AS american, seen_ms AS observed_ms, seen_ms + 1000 AS retrieved_ms, listing AS row
  FROM (SELECT listing, seen_ms, CASE WHEN listing % 6 = 0 THEN 'Away' WHEN listing % 11 = 0 THEN 'Else' ELSE 'Home' END AS home, CASE WHEN listing % 6 = 0 THEN 'HOME' ELSE 'away' END AS away, start_ms FROM listings)""")


def _pages(t):
    n = F.col("listing")
    return t.listings.select(
        F.floor(n / 4).alias("event"), (F.floor(n / 2) * 7 % 3000).alias("price_id"), F.when(n % 6 == 0, "Away").when(n % 11 == 0, "Else").otherwise("Home").alias("home"),
        F.when(n % 6 == 0, "HOME").otherwise("away").alias("away"), "start_ms", F.when(n % 3 == 0, "home").otherwise("away").alias("side"), (100 + n % 150).cast("int").alias("american"),
        F.col("seen_ms").alias("observed_ms"), (F.col("seen_ms") + 1000).alias("retrieved_ms"), n.alias("row"),
    )


part("merged_rows", """SELECT p.event, p.price_id, p.row, p.american, p.observed_ms, f.retrieved AS retrieved_ms, CASE WHEN lower(p.home) = lower(f.home) AND lower(p.away) = lower(f.away) THEN p.side WHEN lower(p.home) = lower(f.away) AND lower(p.away) = lower(f.home) THEN CASE p.side WHEN 'home' THEN 'away' ELSE 'home' END END AS side
  FROM page_rows p JOIN (SELECT event, arg_min(home, row) AS home, arg_min(away, row) AS away, min(retrieved_ms) AS retrieved FROM page_rows GROUP BY event) f USING (event)""")


@query("SELECT CAST(event AS BIGINT) AS event, price_id, row, side, american, retrieved_ms FROM merged_rows WHERE side IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event, price_id ORDER BY observed_ms DESC, row DESC) = 1 AND min(side) OVER (PARTITION BY event, price_id) = max(side) OVER (PARTITION BY event, price_id)")
def merged_pages(t):
    return M.merge_pages(_pages(t), "price_id", "event")["prices"].select("event", "price_id", "row", "side", "american", "retrieved_ms")


@query("SELECT CAST(event AS BIGINT) AS event, price_id, row FROM merged_rows WHERE side IS NULL")
def merge_rejections(t):
    return M.merge_pages(_pages(t), "price_id", "event")["rejections"]


@query("SELECT CAST(event AS BIGINT) AS event, price_id FROM merged_rows GROUP BY ALL HAVING count(DISTINCT side) > 1")
def merge_conflicts(t):
    """Prices of an event whose side isn't the same on all pages: an error, so they are set apart."""
    return M.merge_pages(_pages(t), "price_id", "event")["conflicts"]


@query("""WITH o AS (SELECT snapshot_id AS row, game AS event, provider, floor(snapshot_id / 400) + snapshot_id % 3 AS revision, american % 3 AS content FROM quotes),
x AS (SELECT o.*, max(struct_pack(r := revision, f := -row, c := content)) OVER (PARTITION BY provider, event ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, event % 3 AS n FROM o)
SELECT row, CASE WHEN n = 0 THEN 'no-candidate' WHEN n > 1 THEN 'ambiguous' WHEN b IS NULL THEN 'written' WHEN revision = b.r AND content <> b.c THEN 'conflict' WHEN revision <= b.r THEN 'skipped' WHEN content = b.c THEN 'refreshed' ELSE 'written' END AS decision FROM x""")
def event_upserts(t):
    n = F.col("snapshot_id")
    o = t.quotes.select(n.alias("row"), F.col("game").alias("event"), "provider", (F.floor(n / 400) + n % 3).alias("revision"), (F.col("american") % 3).alias("content"))
    c = t.games.select(F.col("game").alias("event"), (F.col("game") % 3).alias("n"))
    return M.upsert_decisions(o, c).select("row", "decision")


@query("SELECT listing, sport, provider FROM listings QUALIFY row_number() OVER (PARTITION BY sport, provider ORDER BY seen_ms DESC, listing DESC) <= 20")
def unresolved_history(t):
    """The last 20 observations of each sport and provider: the cap is the feature."""
    return latest_by(t.listings, ["sport", "provider"], ["seen_ms", "listing"], keep=20).select("listing", "sport", "provider")


@query("SELECT snapshot_id, lower(trim(book)) AS book, CASE WHEN book = 'hardrock' THEN 'target' WHEN book = 'pinnacle' THEN 'sharp' ELSE 'comparison' END AS role FROM quotes WHERE state <> 'suspended' AND market IN ('moneyline', 'spread') AND book <> 'caesars'")
def book_roles(t):
    roles = t.spark.createDataFrame([(b, "target" if b == "hardrock" else "sharp" if b == "pinnacle" else "comparison") for b in BOOKS if b != "caesars"], "book string, role string")
    own = t.quotes.where((F.col("state") != "suspended") & F.col("market").isin("moneyline", "spread")).withColumn("book", T.book_id(F.col("book")))
    return own.join(F.broadcast(roles), "book").select("snapshot_id", "book", "role")


@query("""SELECT g.sport, count(*) AS expected, count(p.game) AS mapped, count(*) - count(p.game) AS unmapped, count(*) FILTER (p.n > 1) AS ambiguous, count(*) FILTER (p.checks > 1) AS duplicated
FROM games g LEFT JOIN (SELECT game, count(DISTINCT phase) AS n, count(*) AS checks FROM phases WHERE origin = 'checkpoint' GROUP BY game) p USING (game) GROUP BY g.sport""")
def coverage_summary(t):
    return _coverage(t.games, t.phases)


def _coverage(games, phases):
    own = phases.where("origin = 'checkpoint'").groupBy("game").agg(F.count_distinct("phase").alias("n"), F.count("*").alias("checks"))
    both = games.select("game", "sport").join(own, "game", "left")
    return both.groupBy("sport").agg(
        F.count("*").alias("expected"), F.count("n").alias("mapped"), F.count_if(F.col("n").isNull()).alias("unmapped"), F.count_if(F.col("n") > 1).alias("ambiguous"), F.count_if(F.col("checks") > 1).alias("duplicated")
    )


@query("SELECT book, max(age) AS worst_age_ms FROM (SELECT book, game, max(" + str(NOW_MS) + " - observed_ms) AS age FROM current_quotes GROUP BY ALL) GROUP BY book")
def worst_book_age(t):
    return current_quotes(t.quotes).groupBy("book").agg(F.max(F.lit(NOW_MS) - F.col("observed_ms")).alias("worst_age_ms"))


@query(f"SELECT league, min(start_ms) AS first_ms, min(start_ms) - {FIRST_MS} > 7 * {DAY_MS} AS beyond FROM games GROUP BY league")
def pricing_horizon(t):
    return t.games.groupBy("league").agg(F.min("start_ms").alias("first_ms")).withColumn("beyond", F.col("first_ms") - FIRST_MS > 7 * DAY_MS)


@query("SELECT d.id, coalesce(g.home, 'unknown') AS home, coalesce(g.away, 'unknown') AS away FROM decisions d LEFT JOIN games g ON d.game = g.game")
def labelled_findings(t):
    labels = t.games.select("game", "home", "away")
    both = t.decisions.select("id", "game").join(labels, "game", "left")
    return both.select("id", F.coalesce("home", F.lit("unknown")).alias("home"), F.coalesce("away", F.lit("unknown")).alias("away"))


@query("SELECT d.id, r.state, b.status FROM decisions d JOIN current_results r ON r.game = d.game LEFT JOIN bets b ON b.bet = d.game")
def evidence_joins(t):
    """Every decision by its exact game: the result that counts, and the bet if there is one."""
    from pricelens.operators.latest import current_results

    now = current_results(t.results).select("game", "state")
    bets = t.bets.select(F.col("bet").alias("game"), "status")
    return t.decisions.select("id", "game").join(now, "game").join(bets, "game", "left").select("id", "state", "status")


@query(f"""WITH RECURSIVE r AS (SELECT sport, least({fold('home')}, {fold('away')}) AS a, greatest({fold('home')}, {fold('away')}) AS b, start_ms, listing AS event, listing % 3 AS version, seen_ms, listing % 4 AS lifecycle_rank, listing % 2 = 0 AS has_odds FROM listings),
n AS (SELECT x.sport, x.a, x.b, x.start_ms, min(y.start_ms) AS following FROM (SELECT DISTINCT sport, a, b, start_ms FROM r) x LEFT JOIN (SELECT DISTINCT sport, a, b, start_ms FROM r) y ON x.sport = y.sport AND x.a = y.a AND x.b = y.b AND y.start_ms > x.start_ms + 120000 GROUP BY ALL),
c AS (SELECT sport, a, b, min(start_ms) AS anchor FROM r GROUP BY ALL UNION ALL SELECT c.sport, c.a, c.b, n.following FROM c JOIN n ON c.sport = n.sport AND c.a = n.a AND c.b = n.b AND c.anchor = n.start_ms WHERE n.following IS NOT NULL)
SELECT r.*, c.anchor AS cluster FROM r JOIN c ON r.sport = c.sport AND r.a = c.a AND r.b = c.b AND r.start_ms BETWEEN c.anchor AND c.anchor + 120000
QUALIFY row_number() OVER (PARTITION BY r.sport, r.a, r.b, c.anchor ORDER BY version DESC, seen_ms DESC, lifecycle_rank DESC, has_odds DESC, event) = 1""")
def near_duplicate_events(t):
    """Listings of one sport and pair of labels, clustered within 2 minutes of the cluster's first, one of each kept."""
    return M.collapse_duplicates(_listed_rows(t.listings), ["sport", "a", "b"], 120_000)


def _listed_rows(listings):
    return listings.select("sport", F.least(T.folded("home"), T.folded("away")).alias("a"), F.greatest(T.folded("home"), T.folded("away")).alias("b"), "start_ms", F.col("listing").alias("event"),
        (F.col("listing") % 3).alias("version"), "seen_ms", (F.col("listing") % 4).alias("lifecycle_rank"), (F.col("listing") % 2 == 0).alias("has_odds"))


@query("""SELECT snapshot_id, sha256('quote/v1' || chr(10) || '{"american":' || american || ',"book":"' || book || '","game":' || game || ',"market":"' || market || '","observed_ms":' || observed_ms || ',"selection":"' || selection || '"}') AS content_id FROM quotes""")
def content_ids(t):
    return t.quotes.withColumn("content_id", T.content_id("quote/v1", "game", "market", "selection", "book", "american", "observed_ms")).select("snapshot_id", "content_id")


@query(f"SELECT game, start_ms FROM games WHERE status = 'scheduled' AND start_ms >= {FIRST_MS + 6 * DAY_MS} AND start_ms < {FIRST_MS + 20 * DAY_MS} ORDER BY start_ms, game LIMIT 100")
def eligible_candidates(t):
    """A page of 100 scheduled games that start in the window, by start and id."""
    own = B.listed(t.games, statuses=["scheduled"], from_ms=FIRST_MS + 6 * DAY_MS, until_ms=FIRST_MS + 20 * DAY_MS)
    return own.orderBy("start_ms", "game").limit(100).select("game", "start_ms")


part("attributed", f"""SELECT l.listing, count(DISTINCT s.event) AS n, min(s.event) AS event FROM listings l JOIN schedule s ON s.sport = l.sport AND {match('l.home', 's.home')} AND {match('l.away', 's.away')} AND abs(l.start_ms - s.start_ms) <= 86400000
  AND CAST(timezone('America/New_York', timezone('UTC', make_timestamp(l.start_ms * 1000))) AS DATE) = CAST(timezone('America/New_York', timezone('UTC', make_timestamp(s.start_ms * 1000))) AS DATE) GROUP BY l.listing""")


@query("SELECT listing, provider, event FROM attributed JOIN (SELECT listing, provider FROM listings) USING (listing) WHERE n = 1")
def split_attribution(t):
    """Listings whose labels match exactly one event of the same Eastern day."""
    pairs = M.label_pairs(t.listings, t.schedule, DAY_MS).where("NOT reversed")
    same_day = pairs.where(T.eastern_day(F.col("start_ms")) == T.eastern_day(F.col("r_start_ms")))
    found = same_day.groupBy("listing", "provider").agg(F.count_distinct("r_event").alias("n"), F.min("r_event").alias("event"))
    return found.where("n = 1").select("listing", "provider", "event")


@query("""WITH r AS (SELECT game AS event, provider, provider_rank % 2 AS rank, observed_ms AS updated_ms, snapshot_id % 5 AS sequence, snapshot_id AS token FROM quotes),
o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY event, provider ORDER BY updated_ms DESC, sequence DESC, token DESC) = 1)
SELECT event, provider, token FROM o QUALIFY row_number() OVER (PARTITION BY event ORDER BY rank DESC, updated_ms DESC, provider DESC) = 1""")
def revision_authority(t):
    from pricelens.operators.latest import revision_authority as winner

    n = F.col("snapshot_id")
    r = t.quotes.select(F.col("game").alias("event"), "provider", (F.col("provider_rank") % 2).alias("rank"), F.col("observed_ms").alias("updated_ms"), (n % 5).alias("sequence"), n.alias("token"))
    return winner(r).select("event", "provider", "token")


@query("""SELECT provider, CAST(floor(snapshot_id / 1000) AS BIGINT) AS page, count(*) AS rows, count(*) FILTER (state = 'active') AS active, count(*) FILTER (observed_ms > retrieved_ms - 30000) AS fresh, min(retrieved_ms) AS first_ms FROM quotes GROUP BY ALL""")
def ingestion_counters(t):
    page = F.floor(F.col("snapshot_id") / 1000).alias("page")
    return t.quotes.groupBy("provider", page).agg(
        F.count("*").alias("rows"), F.count_if(F.col("state") == "active").alias("active"), F.count_if(F.col("observed_ms") > F.col("retrieved_ms") - 30000).alias("fresh"), F.min("retrieved_ms").alias("first_ms")
    )
