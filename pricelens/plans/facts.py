"""Domain tables over the driver's tables, as SQL text that both engines read: whole-number arithmetic only.

{name} stands for a source table, MS(column) for an instant in epoch milliseconds.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
BOOKS = ("hardrock", "draftkings", "fanduel", "betmgm", "caesars", "pinnacle")
DAY_MS = 86_400_000
#: 2024-01-31, when the quotes end.
NOW_MS = 1_706_659_200_000
FIRST_MS = 1_704_067_200_000


def _div(x: str, n: int) -> str:
    return f"CAST(floor(({x}) / {n}) AS BIGINT)"


_BOOK = "CASE " + _div("event_id", 7) + " % 6 " + " ".join(f"WHEN {k} THEN '{b}'" for k, b in enumerate(BOOKS)) + " END"
_GAME = _div("user_id", 3)

FACTS = {
    # one row per price observation
    "quotes": f"""
SELECT event_id AS snapshot_id, {_GAME} AS game, 1 + {_div("event_id", 29)} % 2 AS version,
       CASE WHEN {_div("event_id", 11)} % 4 < 3 THEN 'moneyline' ELSE 'spread' END AS market,
       {_BOOK} AS book, CASE WHEN event_id % 2 = 0 THEN 'away' ELSE 'home' END AS selection,
       CASE WHEN {_div("event_id", 11)} % 4 < 3 THEN NULL
            ELSE CAST(CASE WHEN event_id % 2 = 0 THEN 1.5 ELSE -1.5 END AS DOUBLE)
                 + CAST(CASE WHEN {_div("event_id", 23)} % 5 = 0 AND event_id % 2 = 0 THEN 1 WHEN {_div("event_id", 23)} % 5 = 0 THEN -1 ELSE 0 END AS DOUBLE) END AS point,
       CAST(CASE WHEN (event_id * 37) % 7 < 3 THEN 100 + (event_id * 37) % 200 ELSE -(100 + (event_id * 53) % 200) END AS INT) AS american,
       CASE event_type WHEN 'error' THEN 'suspended' WHEN 'signup' THEN 'unavailable' ELSE 'active' END AS state,
       CASE event_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS provider,
       CAST(event_id % 3 AS INT) AS provider_rank, MS(ts) AS observed_ms, MS(ts) + (event_id * 13 % 90) * 1000 AS retrieved_ms
FROM {{events}}""",
    # one row per game that has quotes
    "games": f"""
SELECT game, CASE game % 4 WHEN 0 THEN 'baseball' WHEN 1 THEN 'soccer' WHEN 2 THEN 'basketball' ELSE 'football' END AS sport,
       'league-' || CAST(game % 7 AS STRING) AS league,
       CASE game % 6 WHEN 0 THEN 'started' WHEN 1 THEN 'completed' WHEN 2 THEN 'postponed' WHEN 5 THEN 'unknown' ELSE 'scheduled' END AS status,
       CASE WHEN game % 5 = 0 THEN 'Atlético ' ELSE 'Harbor ' END || CAST(game AS STRING) AS home,
       CASE WHEN game % 3 = 0 THEN 'Río Plata ' ELSE 'North Bay ' END || CAST(game AS STRING) AS away,
       2 AS version, {FIRST_MS} + (5 + game % 20) * {DAY_MS} + (game * 37 % 24) * 3600000 AS start_ms,
       CASE WHEN game % 9 = 0 THEN NULL ELSE {NOW_MS} - (game * 611 % 14400) * 1000 END AS fresh_ms
FROM (SELECT DISTINCT {_GAME} AS game FROM {{events}}) g""",
    # one row per scheduled event
    "schedule": f"""
SELECT c_custkey AS event, r.r_name AS sport, 'league-' || CAST(c_custkey % 5 AS STRING) AS league,
       'Port ' || lower(c_mktsegment) || ' ' || CAST(c_custkey AS STRING) AS home, 'Lake rovers ' || CAST(c_custkey + 1 AS STRING) AS away,
       {FIRST_MS} + (c_custkey % 60) * 43200000 AS start_ms
FROM {{customer}} c JOIN {{nation}} n ON c_nationkey = n_nationkey JOIN {{region}} r ON n_regionkey = r_regionkey""",
    # one row per event as a provider lists it, with drifting starts and other labels
    "listings": f"""
SELECT o_orderkey AS listing, sport, CASE WHEN o_orderpriority = '1-URGENT' THEN 'alpha' ELSE 'beta' END AS provider,
       CASE o_orderkey % 5 WHEN 1 THEN 'port ' || CAST(event AS STRING) WHEN 2 THEN away WHEN 3 THEN 'Nobody ' || CAST(o_orderkey AS STRING) ELSE upper(home) END AS home,
       CASE o_orderkey % 5 WHEN 2 THEN home ELSE away END AS away,
       start_ms + (o_orderkey * 7919 % 4800 - 2400) * 1000 AS start_ms, MS(o_orderdate) AS seen_ms
FROM {{orders}} o JOIN ({{schedule}}) s ON o_custkey = event""",
    # events that odds rows are mapped to: the schedule, second games of the same day for some, starts that can't be read
    "canonical": f"""
SELECT event, sport, home, away, CASE WHEN event % 97 = 3 THEN NULL ELSE start_ms END AS start_ms FROM ({{schedule}}) s
UNION ALL SELECT event + 1000000 AS event, sport, home, away, start_ms + 10800000 AS start_ms FROM ({{schedule}}) s WHERE event % 7 = 0""",
    # provider ids bound to events, some to the wrong one
    "bindings": """
SELECT 'main_' || CAST(event AS STRING) AS provider_event, CASE WHEN event % 16 = 5 THEN event + 1 ELSE event END AS event, CASE WHEN event % 4 = 1 THEN 'alias' ELSE 'source' END AS kind FROM ({schedule}) s WHERE event % 8 < 6
UNION ALL SELECT 'main_' || CAST(event AS STRING) || '_2' AS provider_event, event + 1000000 AS event, 'source' AS kind FROM ({schedule}) s WHERE event % 7 = 0
UNION ALL SELECT 'ALT_' || CAST(event AS STRING) AS provider_event, event, 'alias' AS kind FROM ({schedule}) s WHERE event % 4 = 0""",
    # odds rows of two catalogues, by run
    "feed": f"""
SELECT o_orderkey AS listing, sport, sport || '/' || CAST({_div("MS(o_orderdate)", 365 * DAY_MS)} AS STRING) AS run,
       CASE WHEN o_orderkey % 3 = 0 THEN 'ALT_' ELSE 'main_' END || CAST(event AS STRING) || CASE WHEN o_orderkey % 3 > 0 AND event % 7 = 0 AND o_orderkey % 2 = 0 THEN '_2' ELSE '' END AS provider_event,
       CASE o_orderkey % 5 WHEN 1 THEN 'port ' || CAST(event AS STRING) WHEN 2 THEN away WHEN 3 THEN 'Nobody ' || CAST(o_orderkey AS STRING) ELSE upper(home) END AS home,
       CASE o_orderkey % 5 WHEN 2 THEN home ELSE away END AS away,
       CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE start_ms + (o_orderkey * 7919 % 4800 - 2400) * 500 + CASE o_orderkey % 7 WHEN 0 THEN 5400000 WHEN 1 THEN 10800000 ELSE 0 END END AS start_ms,
       start_ms - 36000000 + o_orderkey % 11 * 3600000 AS retrieved_ms
FROM {{orders}} o JOIN ({{schedule}}) s ON o_custkey = event""",
    # one row per graded decision
    "decisions": """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(MS(l_shipdate) AS STRING) AS id,
       l_orderkey AS game, o_custkey % 1000 AS account, CASE l_suppkey % 4 WHEN 0 THEN 'baseball' WHEN 1 THEN 'soccer' WHEN 2 THEN 'basketball' ELSE 'football' END AS sport,
       'league-' || CAST(l_suppkey % 7 AS STRING) AS league, CASE WHEN l_partkey % 3 = 0 THEN 'spread' ELSE 'moneyline' END AS market,
       'v' || CAST(l_partkey % 2 AS STRING) AS strategy, MS(l_shipdate) AS created_ms,
       CASE WHEN l_returnflag = 'R' THEN 'lost' WHEN l_returnflag = 'A' THEN 'won' WHEN l_linestatus = 'F' THEN 'push' ELSE 'unresolved' END AS outcome,
       CAST((5 + (l_partkey * 31 + l_suppkey * 17) % 90) AS DOUBLE) / 100 AS p,
       CAST(CASE WHEN l_partkey % 2 = 0 THEN 100 + (l_partkey * 13) % 300 ELSE -(100 + (l_partkey * 29) % 250) END AS INT) AS american,
       CASE l_linenumber % 4 WHEN 0 THEN NULL ELSE CAST(CASE WHEN l_partkey % 2 = 0 THEN 100 + (l_suppkey * 7) % 300 ELSE -(100 + (l_suppkey * 11) % 250) END AS INT) END AS closing_american,
       CASE l_linenumber % 4 WHEN 0 THEN CASE l_suppkey % 3 WHEN 0 THEN 'stale' WHEN 1 THEN 'line-changed' ELSE 'missing' END END AS clv_reason
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    # observations of results, several a game
    "results": """
SELECT l_orderkey AS game, 1 + l_linenumber % 2 AS version, l_linenumber % 3 AS authority, MS(l_shipdate) AS updated_ms, l_partkey AS sequence,
       l_suppkey AS token, CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE l_suppkey % 7 END AS away_score, CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE l_partkey % 7 END AS home_score,
       CASE l_partkey % 10 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'postponed' WHEN 2 THEN 'no-contest' ELSE 'final' END AS state,
       CASE WHEN l_suppkey % 2 = 0 THEN 'away' ELSE 'home' END AS selected, CAST(2 + l_partkey % 2 AS INT) AS outcomes,
       CAST(l_quantity - 25 AS DOUBLE) / 2 AS point, CAST(CASE WHEN l_partkey % 2 = 0 THEN 100 + (l_partkey * 13) % 300 ELSE -(100 + (l_partkey * 29) % 250) END AS INT) AS american
FROM {lineitem}""",
    # wagers in whole cents
    "bets": """
SELECT o_orderkey AS bet, o_custkey AS account, CAST(round(o_totalprice) AS BIGINT) * 10 AS stake_cents,
       CAST(CASE WHEN o_orderkey % 2 = 0 THEN 100 + o_orderkey % 300 ELSE -(100 + o_orderkey % 250) END AS INT) AS american, MS(o_orderdate) AS placed_ms,
       CASE o_orderkey % 7 WHEN 0 THEN 'open' WHEN 1 THEN 'won' WHEN 2 THEN 'lost' WHEN 3 THEN 'push' WHEN 4 THEN 'void' WHEN 5 THEN 'cashed-out' ELSE 'won' END AS status,
       CASE WHEN o_orderkey % 7 = 5 THEN CAST(round(o_totalprice) AS BIGINT) * 7 END AS cashed_cents
FROM {orders}""",
    # observed shares of tickets and money
    "splits": f"""
SELECT event_id AS id, {_GAME} AS game, 1 + {_div("event_id", 3)} % 3 AS version, CASE WHEN {_div("event_id", 11)} % 4 < 3 THEN 'moneyline' ELSE 'spread' END AS market,
       CASE WHEN event_id % 2 = 0 THEN 'away' ELSE 'home' END AS selection,
       CASE {_div("event_id", 5)} % 4 WHEN 0 THEN 'consensus' WHEN 1 THEN 'draftkings' WHEN 2 THEN 'circa' ELSE 'other' END AS scope,
       CAST(event_id * 17 % 130 - 10 AS DOUBLE) AS bet_percent, CAST(event_id * 29 % 120 - 5 AS DOUBLE) AS money_percent, MS(ts) AS provider_ms, MS(ts) + (event_id * 7 % 50) * 1000 AS retrieved_ms
FROM {{events}}""",
    # health and quota of providers over time
    "health": f"""
SELECT event_id AS id, CAST(user_id AS BIGINT) AS scope, event_type = 'error' AND event_id % 5 = 0 AS outage,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id * 97 % 1200 END AS age_s, event_id % 4 - 2 AS failed,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_id * 31 % 500 - 20 END AS remaining, 100 AS reserve, MS(ts) AS at_ms
FROM {{events}}""",
    # game states over time, as a feed reports them
    "phases": f"""
SELECT event_id AS id, CAST(user_id AS BIGINT) AS game, MS(ts) AS at_ms,
       CASE CAST(floor(value) AS BIGINT) % 7 WHEN 0 THEN 'pregame' WHEN 1 THEN 'break' WHEN 2 THEN 'delayed' WHEN 3 THEN 'final' ELSE 'live' END AS phase,
       CAST(event_id * 3 % 5 AS INT) AS away_score, CAST(event_id * 7 % 5 AS INT) AS home_score, CASE WHEN event_id % 4 = 0 THEN 'checkpoint' ELSE 'feed' END AS origin,
       event_id * 5 % 11 < 3 AS terminal, CASE WHEN event_id % 6 = 0 THEN NULL ELSE MS(ts) - (event_id % 3) * 40000000 END AS agreed_ms
FROM {{events}}""",
}
_MS = {"spark": r"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', \1)", "duckdb": r"(epoch_us(\1) // 1000)"}


def fact_sql(name: str, dialect: str) -> str:
    """The text with MS() for the dialect; DuckDB's names its tables, Spark's keeps {table} for DataFrames."""
    text = FACTS[name].replace("({schedule})", f"({FACTS['schedule']})")
    text = re.sub(r"\bMS\((\w+)\)", _MS[dialect], text)
    return text.format(**{t: t for t in SOURCES}) if dialect == "duckdb" else text


class Tables:
    """Source tables and facts of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in SOURCES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in FACTS:
            raise AttributeError(name)
        text = fact_sql(name, "spark")
        return self.spark.sql(text, **{t: getattr(self, t) for t in set(re.findall(r"\{(\w+)\}", text))})
