"""Grading, performance, slices, gates, and ranked opportunities."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pricelens.functions.pricing import american_to_decimal, odds_band
from pricelens.operators import grading as G
from pricelens.operators import performance as P
from pricelens.operators import ranking as R
from pricelens.operators import strategy as S
from pricelens.operators.closing import ratio_clv
from pricelens.operators.latest import current_results
from pricelens.plans.consensus import POLICY, _rows
from pricelens.plans.facts import DAY_MS, NOW_MS
from pricelens.plans.prices import dec, implied
from pricelens.plans.registry import part, query
from pricelens.sources import index as X
from pricelens.sources.storage import work_path

part("current_results", "SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY game ORDER BY authority DESC, updated_ms DESC, sequence DESC, token DESC, version DESC) = 1")
part("graded", f"""SELECT *, CASE WHEN outcome = 'won' THEN {dec('american')} - 1 WHEN outcome = 'lost' THEN -1e0 ELSE 0e0 END AS profit FROM decisions""")
part("report_rows", f"""SELECT sport, count(*) AS n, count(*) FILTER (outcome = 'won') AS won, count(*) FILTER (outcome IN ('won', 'lost')) AS decisions, count(*) FILTER (outcome IN ('won', 'lost', 'push')) AS exposure,
  sum(profit) FILTER (outcome IN ('won', 'lost', 'push')) AS units, var_samp(profit) FILTER (outcome IN ('won', 'lost', 'push')) AS variance, avg({dec('american')}) AS mean_odds, avg({implied('american')}) AS break_even,
  avg(round(p * {dec('american')} - 1, 12)) AS mean_ev, avg(power(p - CASE WHEN outcome = 'won' THEN 1 ELSE 0 END, 2)) FILTER (outcome IN ('won', 'lost')) AS brier, count(closing_american) AS n_clv,
  avg({dec('american')} / {dec('closing_american')} - 1) AS price_clv, avg({implied('closing_american')} - {implied('american')}) AS probability_clv FROM graded GROUP BY sport""")
WON = P.Z * P.Z


def _decided(t):
    return t.decisions.withColumn("profit", P.profit_of(F.col("outcome"), F.col("american")))


@query("SELECT game, version, authority, updated_ms, state, away_score, home_score FROM current_results")
def result_authority(t):
    return current_results(t.results).select("game", "version", "authority", "updated_ms", "state", "away_score", "home_score")


@query(f"""WITH x AS (SELECT *, CASE WHEN away_score = home_score THEN 'draw' WHEN away_score > home_score THEN 'away' ELSE 'home' END AS winner FROM results)
SELECT game, version, authority, updated_ms, sequence, token, american, CASE WHEN state IN ('cancelled', 'no-contest') THEN 'void' WHEN state = 'postponed' OR away_score IS NULL OR (winner = 'draw' AND outcomes = 2) THEN 'unresolved' WHEN winner = selected THEN 'won' ELSE 'lost' END AS outcome,
  CASE WHEN state <> 'final' THEN state WHEN away_score IS NULL THEN 'scores-missing' WHEN winner = 'draw' AND outcomes = 2 THEN 'two-way-tie' ELSE 'moneyline-final' END AS reason,
  round(CASE WHEN state = 'final' AND away_score IS NOT NULL AND NOT (winner = 'draw' AND outcomes = 2) THEN CASE WHEN winner = selected THEN {dec('american')} - 1 ELSE -1 END ELSE 0 END, 9) AS profit FROM x""")
def moneyline_grades(t):
    g = G.grade_moneyline(F.col("away_score"), F.col("home_score"), F.col("selected"), F.col("outcomes"), F.col("american"), F.col("state"))
    own = t.results.withColumn("g", g)
    return own.select("game", "version", "authority", "updated_ms", "sequence", "token", "american", "g.outcome", "g.reason", F.round("g.profit", 9).alias("profit"))


@query(f"""WITH x AS (SELECT *, CASE WHEN selected = 'away' THEN away_score - home_score ELSE home_score - away_score END + point AS margin FROM results)
SELECT game, version, authority, updated_ms, sequence, token, american, CASE WHEN state IN ('cancelled', 'no-contest') THEN 'void' WHEN state = 'postponed' OR margin IS NULL THEN 'unresolved' WHEN margin > 0 THEN 'won' WHEN margin < 0 THEN 'lost' ELSE 'push' END AS outcome,
  CASE WHEN state <> 'final' THEN state WHEN margin IS NULL THEN 'spread-evidence-missing' ELSE 'spread-final' END AS reason,
  round(CASE WHEN state = 'final' AND margin > 0 THEN {dec('american')} - 1 WHEN state = 'final' AND margin < 0 THEN -1 ELSE 0 END, 9) AS profit FROM x""")
def spread_grades(t):
    g = G.grade_spread(F.col("away_score"), F.col("home_score"), F.col("selected"), F.col("point"), F.col("american"), F.col("state"))
    own = t.results.withColumn("g", g)
    return own.select("game", "version", "authority", "updated_ms", "sequence", "token", "american", "g.outcome", "g.reason", F.round("g.profit", 9).alias("profit"))


@query("""SELECT d.id, CASE WHEN r.token % 4 <> CASE d.sport WHEN 'baseball' THEN 0 WHEN 'soccer' THEN 1 WHEN 'basketball' THEN 2 ELSE 3 END THEN 'sport-mismatch' WHEN r.version <> 1 + d.account % 2 THEN 'event-version-mismatch'
  WHEN r.state = 'final' AND r.sequence % 5 = 0 THEN 'result-scope-mismatch' WHEN r.state = 'final' AND r.away_score IS NULL THEN 'participant-mismatch' WHEN d.account % 9 = 0 THEN 'selection-mismatch' ELSE 'none' END AS reason
FROM decisions d JOIN current_results r ON d.game = r.game""")
def grading_guards(t):
    both = _guarded(t)
    return both.select("id", F.coalesce(G.guard(both, ["full", "regulation"]), F.lit("none")).alias("reason"))


def _guarded(t):
    """Decisions beside the result that counts for their game."""
    sport = F.element_at(F.array(*map(F.lit, ("baseball", "soccer", "basketball", "football"))), (F.col("token") % 4 + 1).cast("int"))
    now = current_results(t.results).select(
        F.col("game").alias("result_event"), F.col("version").alias("result_version"), sport.alias("result_sport"), "state",
        F.when(F.col("sequence") % 5 == 0, "first-half").otherwise("full").alias("scope"),
        F.when(F.col("away_score").isNull(), F.array(F.lit("away"))).otherwise(F.array(F.lit("away"), F.lit("home"))).alias("scored"), "away_score", "home_score", "outcomes", "point",
    )
    d = t.decisions.select(
        "id", "sport", "market", "american", F.col("game").alias("event"), (1 + F.col("account") % 2).alias("version"), F.array(F.lit("away"), F.lit("home")).alias("participants"),
        F.when(F.col("account") % 9 == 0, "draw").otherwise("home").alias("selection"),
    )
    return d.join(now, F.col("event") == F.col("result_event"))


@query(f"""WITH x AS (SELECT d.id, CASE WHEN d.sport = 'football' AND d.market = 'spread' THEN 'market-unsupported' WHEN r.token % 4 <> CASE d.sport WHEN 'baseball' THEN 0 WHEN 'soccer' THEN 1 WHEN 'basketball' THEN 2 ELSE 3 END THEN 'sport-mismatch' WHEN r.version <> 1 + d.account % 2 THEN 'event-version-mismatch'
  WHEN r.state = 'final' AND r.sequence % 5 = 0 THEN 'result-scope-mismatch' WHEN r.state = 'final' AND r.away_score IS NULL THEN 'participant-mismatch' WHEN d.account % 9 = 0 THEN 'selection-mismatch' END AS refused, r.state, d.market, d.american,
  CASE WHEN d.market = 'spread' THEN r.home_score - r.away_score + r.point ELSE CASE WHEN r.home_score = r.away_score AND r.outcomes = 3 THEN -1 ELSE r.home_score - r.away_score END END AS margin, r.home_score = r.away_score AND r.outcomes = 2 AND d.market <> 'spread' AS tie
FROM decisions d JOIN current_results r ON d.game = r.game),
y AS (SELECT id, refused, american, CASE WHEN refused IS NULL THEN CASE WHEN state IN ('cancelled', 'no-contest') THEN 'void' WHEN state = 'postponed' OR margin IS NULL OR tie THEN 'unresolved' WHEN margin > 0 THEN 'won' WHEN margin < 0 THEN 'lost' ELSE 'push' END END AS outcome FROM x)
SELECT id, refused, outcome, CASE WHEN refused IS NULL THEN round(CASE outcome WHEN 'won' THEN {dec('american')} - 1 WHEN 'lost' THEN -1 ELSE 0 END, 9) END AS profit FROM y""")
def module_grades(t):
    """Every decision by the module of its sport: its grade, or why the module refuses the result."""
    own = G.graded(_guarded(t))
    return own.select("id", "refused", "grade.outcome", F.round("grade.profit", 9).alias("profit"))


@query("""WITH x AS (SELECT game, updated_ms, sequence, token, authority, version, point, american, state AS outcome FROM results)
SELECT game, updated_ms, sequence, token, authority, version, point, american, row_number() OVER w - 1 AS correction, lead(true, 1, false) OVER w AS superseded, lag(outcome) OVER w AS previous_outcome
FROM x WINDOW w AS (PARTITION BY game ORDER BY updated_ms, sequence, token, authority, version, point, american)""")
def grade_corrections(t):
    keys = ["updated_ms", "sequence", "token", "authority", "version", "point", "american"]
    rows = t.results.select("game", *keys, F.col("state").alias("outcome"))
    return G.supersession(rows, ["game"], keys).drop("outcome")


@query(f"""SELECT b.bet, r.state, CASE WHEN r.state IN ('cancelled', 'no-contest') THEN 'void' WHEN r.state = 'postponed' OR r.away_score IS NULL OR (r.away_score = r.home_score AND r.outcomes = 2) THEN 'unresolved'
  WHEN CASE WHEN r.away_score = r.home_score THEN 'draw' WHEN r.away_score > r.home_score THEN 'away' ELSE 'home' END = r.selected THEN 'won' ELSE 'lost' END AS outcome FROM bets b JOIN current_results r ON b.bet = r.game""")
def bets_graded_by_results(t):
    now = current_results(t.results)
    g = G.grade_moneyline(F.col("away_score"), F.col("home_score"), F.col("selected"), F.col("outcomes"), F.col("american"), F.col("state"))
    return t.bets.select("bet").join(now.withColumn("g", g), F.col("bet") == F.col("game")).select("bet", "state", "g.outcome")


@query("""SELECT sport, count(*) FILTER (outcome = 'won') AS won, count(*) FILTER (outcome = 'lost') AS lost, count(*) FILTER (outcome = 'push') AS push, count(*) FILTER (outcome = 'void') AS void, count(*) FILTER (outcome = 'unresolved') AS unresolved,
  count(*) FILTER (outcome IN ('won', 'lost')) AS decisions, count(*) FILTER (outcome IN ('won', 'lost', 'push')) AS exposure, round(sum(profit), 6) AS units, round(sum(profit) / nullif(count(*) FILTER (outcome IN ('won', 'lost', 'push')), 0), 9) AS roi FROM graded GROUP BY sport""")
def performance_counts(t):
    return P.counts(_decided(t), ["sport"]).withColumns({"units": F.round("units", 6), "roi": F.round("roi", 9)})


@query(f"""SELECT sport, n, won, decisions, exposure, n_clv, round(units, 6) AS units, round(units / exposure, 9) AS roi, round(units / exposure - {P.Z} * sqrt(variance / exposure), 9) AS roi_low, round(units / exposure + {P.Z} * sqrt(variance / exposure), 9) AS roi_high,
  round(won / decisions, 9) AS win_rate, round(greatest(0, ((won / decisions) + {WON} / (2 * decisions)) / (1 + {WON} / decisions) - {P.Z} * sqrt((won / decisions) * (1 - won / decisions) / decisions + {WON} / (4e0 * decisions * decisions)) / (1 + {WON} / decisions)), 9) AS win_low,
  round(least(1, ((won / decisions) + {WON} / (2 * decisions)) / (1 + {WON} / decisions) + {P.Z} * sqrt((won / decisions) * (1 - won / decisions) / decisions + {WON} / (4e0 * decisions * decisions)) / (1 + {WON} / decisions)), 9) AS win_high,
  round(mean_odds, 9) AS mean_odds, round(break_even, 9) AS break_even, round(mean_ev, 9) AS mean_ev, round(brier, 9) AS brier, round(price_clv, 9) AS price_clv, round(probability_clv, 9) AS probability_clv,
  CASE WHEN decisions < 30 THEN 'insufficient' WHEN decisions < 100 THEN 'limited' ELSE 'established' END AS caution FROM report_rows""")
def performance_report(t):
    own = P.report(_decided(t), ["sport"])
    places = {"units": 6} | dict.fromkeys(["roi", "roi_low", "roi_high", "win_rate", "win_low", "win_high", "mean_odds", "break_even", "mean_ev", "brier", "price_clv", "probability_clv"], 9)
    return own.withColumns({c: F.round(c, n) for c, n in places.items()})


part("deciles", """SELECT r.bucket, coalesce(n, 0) AS n, forecast, observed FROM (SELECT range AS bucket FROM range(10)) r LEFT JOIN
  (SELECT least(9, CAST(floor(p * 10) AS BIGINT)) AS bucket, count(*) AS n, avg(p) AS forecast, avg(CASE WHEN outcome = 'won' THEN 1e0 ELSE 0e0 END) AS observed FROM graded WHERE outcome IN ('won', 'lost') GROUP BY 1) d ON r.bucket = d.bucket""")


@query("SELECT bucket, n, round(forecast, 9) AS forecast, round(observed, 9) AS observed FROM deciles")
def calibration_deciles(t):
    return P.calibration(t.decisions).withColumns({"forecast": F.round("forecast", 9), "observed": F.round("observed", 9)})


@query("SELECT round(sum(n * abs(observed - forecast)) / sum(n), 9) AS error FROM deciles")
def expected_calibration_error(t):
    return P.calibration_error(P.calibration(t.decisions)).select(F.round("error", 9).alias("error"))


@query(f"""SELECT coalesce(clv_reason, 'available') AS reason, count(*) AS n, round(avg({dec('american')} / {dec('closing_american')} - 1), 9) AS mean_clv FROM decisions GROUP BY 1""")
def clv_reasons(t):
    clv = ratio_clv(F.col("american"), F.col("closing_american"))
    return t.decisions.groupBy(F.coalesce("clv_reason", F.lit("available")).alias("reason")).agg(F.count("*").alias("n"), F.round(F.avg(clv), 9).alias("mean_clv"))


@query("""WITH x AS (SELECT id, account, sum(profit) OVER w AS running, created_ms FROM graded WHERE outcome IN ('won', 'lost', 'push') WINDOW w AS (PARTITION BY account ORDER BY created_ms, id ROWS UNBOUNDED PRECEDING))
SELECT id, account, round(running, 6) AS running, round(greatest(0, max(running) OVER (PARTITION BY account ORDER BY created_ms, id ROWS UNBOUNDED PRECEDING)) - running, 6) AS drawdown FROM x""")
def cumulative_units(t):
    own = P.cumulative(_decided(t), ["account"], ["created_ms", "id"])
    return own.select("id", "account", F.round("running", 6).alias("running"), F.round("drawdown", 6).alias("drawdown"))


@query("""WITH d AS (SELECT CAST(floor(created_ms / 86400000) AS BIGINT) AS day, sum(profit) AS units FROM graded WHERE outcome IN ('won', 'lost', 'push') GROUP BY 1),
x AS (SELECT day, sum(units) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS running FROM d), y AS (SELECT day, running, greatest(0, max(running) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING)) - running AS drawdown FROM x)
SELECT count(*) AS days, round(max(drawdown), 6) AS max_drawdown, round(arg_max(running, day), 6) AS final_units FROM y""")
def maximum_drawdown(t):
    own = P.cumulative_by_day(_decided(t), "created_ms")
    return own.agg(F.count("*").alias("days"), F.round(F.max("drawdown"), 6).alias("max_drawdown"), F.round(F.max_by("running", "day"), 6).alias("final_units"))


@query("""WITH s AS (SELECT grouping_id(sport, league, market) AS level, coalesce(sport, league, market, 'all') AS value, count(*) FILTER (outcome = 'won') AS won, count(*) FILTER (outcome = 'lost') AS lost, count(*) FILTER (outcome = 'push') AS push,
  count(*) FILTER (outcome = 'void') AS void, count(*) FILTER (outcome = 'unresolved') AS unresolved, sum(profit) AS units FROM graded GROUP BY GROUPING SETS ((), (sport), (league), (market)))
SELECT CASE level WHEN 7 THEN 'overall' WHEN 3 THEN 'sport' WHEN 5 THEN 'league' ELSE 'market' END AS slice, value, won, lost, push, void, unresolved, CASE WHEN level = 7 THEN round(units, 6) END AS units, CASE WHEN level = 7 THEN round(units / (won + lost + push), 9) END AS roi FROM s""")
def retrospective_slices(t):
    return P.slices(_decided(t)).withColumns({"units": F.round("units", 6), "roi": F.round("roi", 9)})


_GATES = [("won", "gte", 10.0), ("roi", "gt", 0.0), ("brier", "lte", 0.4), ("drawdown", "lt", 5.0), ("mean_ev", "gt", -0.5), ("decisions", "gte", 100.0), ("price_clv", "gt", 0.0)]


@query("""WITH m AS (UNPIVOT (SELECT CAST(sum(won) AS DOUBLE) AS won, CAST(sum(decisions) AS DOUBLE) AS decisions, sum(units) / sum(exposure) AS roi, max(brier) AS brier, min(mean_ev) AS mean_ev, min(price_clv) AS price_clv FROM report_rows) ON won, decisions, roi, brier, mean_ev, price_clv INTO NAME metric VALUE v)
SELECT g.metric, g.op AS operator, coalesce(CASE g.op WHEN 'gte' THEN v >= threshold WHEN 'gt' THEN v > threshold WHEN 'lte' THEN v <= threshold ELSE v < threshold END, false) AS passed
FROM (VALUES """ + ", ".join(f"('{m}', '{o}', {v}e0)" for m, o, v in _GATES) + """) g(metric, op, threshold) LEFT JOIN m ON g.metric = m.metric""")
def promotion_gates(t):
    own = P.report(_decided(t), ["sport"]).agg(
        F.sum("won").cast("double").alias("won"), F.sum("decisions").cast("double").alias("decisions"), (F.sum("units") / F.sum("exposure")).alias("roi"),
        F.max("brier").alias("brier"), F.min("mean_ev").alias("mean_ev"), F.min("price_clv").alias("price_clv"),
    )
    metrics = own.unpivot([], own.columns, "metric", "value")
    gates = t.spark.createDataFrame(_GATES, "metric string, operator string, threshold double")
    return P.promotion_gates(metrics, gates).select("metric", "operator", "passed")


@query("""WITH w AS (SELECT account AS experiment, id AS name, created_ms AS from_ms, created_ms + (game % 9 - 1) * 86400000 AS until_ms FROM decisions)
SELECT experiment, name, coalesce(CASE WHEN from_ms >= until_ms THEN 'window-order' WHEN from_ms < max(until_ms) OVER (PARTITION BY experiment ORDER BY from_ms, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'window-overlap' END, 'none') AS issue FROM w""")
def experiment_windows(t):
    return _windows(t.decisions)


def _windows(decisions):
    w = decisions.select(F.col("account").alias("experiment"), F.col("id").alias("name"), F.col("created_ms").alias("from_ms"), (F.col("created_ms") + (F.col("game") % 9 - 1) * 86_400_000).alias("until_ms"))
    return P.overlapping_windows(w).select("experiment", "name", F.coalesce("issue", F.lit("none")).alias("issue"))


@query("""WITH h AS (SELECT DISTINCT game FROM decisions WHERE strategy = 'v0'), e AS (SELECT DISTINCT game FROM decisions WHERE strategy = 'v1')
SELECT (SELECT count(*) FROM (SELECT * FROM h EXCEPT SELECT * FROM e)) AS only_left, (SELECT count(*) FROM (SELECT * FROM e EXCEPT SELECT * FROM h)) AS only_right, (SELECT count(*) FROM (SELECT * FROM h INTERSECT SELECT * FROM e)) AS both""")
def universe_equality(t):
    of = lambda s: t.decisions.where(F.col("strategy") == s).select("game").distinct().withColumn(s, F.lit(1))
    return of("v0").join(of("v1"), "game", "full").agg(
        F.count_if(F.col("v1").isNull()).alias("only_left"), F.count_if(F.col("v0").isNull()).alias("only_right"), F.count_if(F.col("v0").isNotNull() & F.col("v1").isNotNull()).alias("both")
    )


@query("""SELECT id FROM decisions WHERE created_ms >= 788918400000 AND created_ms < 852076800000 AND sport IN ('baseball', 'soccer') AND market = 'moneyline' AND strategy = 'v1'
  AND CASE WHEN american <= -200 THEN 'heavy-favorite' WHEN american <= -110 THEN 'favorite' WHEN american <= 109 THEN 'near-even' WHEN american <= 199 THEN 'underdog' ELSE 'longshot' END IN ('favorite', 'underdog')""")
def cohort_members(t):
    own = t.decisions.where((F.col("created_ms") >= 788_918_400_000) & (F.col("created_ms") < 852_076_800_000))
    return own.where(F.col("sport").isin("baseball", "soccer") & (F.col("market") == "moneyline") & (F.col("strategy") == "v1") & odds_band(F.col("american")).isin("favorite", "underdog")).select("id")


@query("""SELECT id, account, created_ms FROM decisions WHERE created_ms >= 788918400000 AND created_ms < 796694400000 AND sport IN ('baseball', 'soccer') AND market = 'moneyline'""")
def indexed_members(t):
    """The same kind of cohort over three months, by way of an index on the day and a re-read of the rows it names."""
    at, name = work_path(t.spark, "decisions"), f"decisions_{uuid.uuid4().hex}"
    X.write_index(t.decisions, f"{at}/index", "created_ms", "id")
    base = X.write_base(t.decisions, name, f"{at}/base", "id", 8)
    found = X.scan_index(t.spark, f"{at}/index", "created_ms", 788_918_400_000, 796_694_400_000)
    return X.reread(found, base, "id").where(F.col("sport").isin("baseball", "soccer") & (F.col("market") == "moneyline")).select("id", "account", "created_ms")


@query("""SELECT sport, reason, count(*) AS n FROM (SELECT sport, unnest(list_filter([CASE WHEN american < 0 THEN 'favorite' END, CASE WHEN p < 0.5 THEN 'unlikely' END, clv_reason], lambda r: r IS NOT NULL)) AS reason FROM decisions) GROUP BY ALL""")
def reason_histogram(t):
    from pricelens.functions.pricing import issues

    found = F.array_compact(F.array_append(issues((F.col("american") < 0, "favorite"), (F.col("p") < 0.5, "unlikely")), F.col("clv_reason")))
    return t.decisions.select("sport", F.explode(found).alias("reason")).groupBy("sport", "reason").agg(F.count("*").alias("n"))


part("ranked_rows", f"""SELECT r.game, r.market, r.selection, r.ev, CAST(floor(100 * greatest(0, least(1, 1 - ({NOW_MS} - r.oldest) / (14400 * 60000)))) AS BIGINT) AS freshness, CAST(floor(100 * coalesce(r.books / nullif(r.seen, 0), 0)) AS BIGINT) AS coverage,
  CAST(floor(100 * greatest(0, least(1, 1 - d.score / 0.1e0))) AS BIGINT) AS agreement FROM
  (SELECT q.game, q.market, q.selection, round(a.probability * {dec('q.american')} - 1, 9) AS ev, a.books, least(q.observed_ms, f.oldest) AS oldest, f.seen FROM current_quotes q JOIN agreed a USING (game, market, selection)
   JOIN (SELECT game, market, count(DISTINCT book) FILTER (book <> 'hardrock') AS seen, min(observed_ms) FILTER (book <> 'hardrock') AS oldest FROM current_quotes GROUP BY ALL) f ON f.game = q.game AND f.market = q.market WHERE q.book = 'hardrock' AND a.probability IS NOT NULL) r
  JOIN disagreed d ON d.game = r.game AND d.market = r.market""")
part("ranked", """SELECT *, least(freshness, coverage, agreement) AS confidence, CASE least(freshness, coverage, agreement) WHEN freshness THEN 'freshness' WHEN coverage THEN 'coverage' ELSE 'agreement' END AS weakest,
  CASE WHEN least(freshness, coverage, agreement) >= 80 THEN 'high' WHEN least(freshness, coverage, agreement) >= 60 THEN 'medium' ELSE 'low' END AS bucket, game || ':' || market || ':' || selection AS id FROM ranked_rows""")


def _ranked(t):
    return R.opportunities(_rows(t), POLICY, NOW_MS)


@query("SELECT id, ev, freshness, coverage, agreement, confidence, weakest, bucket FROM ranked")
def opportunity_confidence(t):
    return _ranked(t).select("id", "ev", "freshness", "coverage", "agreement", "confidence", "weakest", "bucket")


@query("SELECT id, ev, confidence, bucket FROM ranked ORDER BY ev DESC, confidence DESC, freshness DESC, coverage DESC, id LIMIT 20")
def ranked_opportunities(t):
    return R.ranked(_ranked(t), 20).select("id", "ev", "confidence", "bucket")


_PAGED = f"ev >= -0.5 AND market = 'moneyline' AND oldest <= {NOW_MS - 2 * DAY_MS}"


@query(f"""WITH own AS (SELECT * FROM ranked JOIN (SELECT game, market, selection, least(observed_ms, o) AS oldest FROM current_quotes JOIN (SELECT game, market, min(observed_ms) AS o FROM current_quotes WHERE book <> 'hardrock' GROUP BY ALL) USING (game, market) WHERE book = 'hardrock') USING (game, market, selection) WHERE {_PAGED}),
placed AS (SELECT *, row_number() OVER (ORDER BY ev DESC, confidence DESC, freshness DESC, coverage DESC, id) AS place FROM own)
SELECT id, ev FROM placed WHERE place > 5 ORDER BY place LIMIT 10""")
def ranked_next_page(t):
    """Keyset page under a filter and as of an instant: the ten opportunities after the cursor, the last row of a first page of five."""
    rows, filters, as_of = _ranked(t), {"market": "moneyline", "minimum_ev": -0.5}, NOW_MS - 2 * DAY_MS
    first = R.filtered_page(rows, 5, filters, as_of, seen="oldest_ms").select(*R.RANK, "id").collect()  # a page, so five rows
    return R.filtered_page(rows, 10, filters, as_of, R.cursor_at(first[-1], filters, as_of) if first else None, "oldest_ms").select("id", "ev")


@query(f"""SELECT id, least(oldest + 14400 * 60000 + 1, start_ms) AS expires_ms FROM ranked JOIN (SELECT game, market, selection, least(observed_ms, o) AS oldest FROM current_quotes JOIN (SELECT game, market, min(observed_ms) AS o FROM current_quotes WHERE book <> 'hardrock' GROUP BY ALL) USING (game, market) WHERE book = 'hardrock') USING (game, market, selection) JOIN games USING (game)""")
def opportunity_expiry(t):
    rows = _ranked(t).join(t.games.select("game", "start_ms"), "game")
    return rows.select("id", R.expires_ms(F.col("oldest_ms"), 14400, F.col("start_ms")).alias("expires_ms"))


@query(f"""WITH x AS (SELECT r.*, g.version AS gv, g.status, q.version AS qv FROM ranked r LEFT JOIN games g USING (game) LEFT JOIN (SELECT game, market, selection, max(version) AS version FROM current_quotes WHERE book = 'hardrock' GROUP BY ALL) q ON q.game = r.game AND q.market = r.market AND q.selection = r.selection)
SELECT count(*) AS seen, count(*) FILTER (gv IS NULL OR qv IS NULL) AS join_failures, count(*) FILTER (qv < gv) AS stale, count(*) FILTER (qv = gv AND status = 'scheduled') AS served FROM x""")
def ranked_join_counts(t):
    rows = _ranked(t).withColumnRenamed("version", "qv").drop("status")
    both = rows.join(t.games.select("game", F.col("version").alias("gv"), "status"), "game", "left")
    return both.agg(
        F.count("*").alias("seen"), F.count_if(F.col("gv").isNull() | F.col("qv").isNull()).alias("join_failures"), F.count_if(F.col("qv") < F.col("gv")).alias("stale"),
        F.count_if((F.col("qv") == F.col("gv")) & (F.col("status") == "scheduled")).alias("served"),
    )


@query("""WITH c AS (SELECT sport, metric, value FROM (SELECT sport, 'won' AS metric, CAST(won AS DOUBLE) AS value FROM report_rows UNION ALL SELECT sport, 'decisions', CAST(decisions + CASE sport WHEN 'soccer' THEN 1 ELSE 0 END AS DOUBLE) FROM report_rows UNION ALL SELECT sport, 'sharpe', 1e0 FROM report_rows))
SELECT sport, metric, CASE WHEN metric = 'sharpe' THEN 'unknown-metric' WHEN metric = 'decisions' AND sport = 'soccer' THEN 'mismatch' ELSE 'verified' END AS "check" FROM c""")
def report_verification(t):
    """Claimed figures against recomputed ones; one claim is off, one metric doesn't exist."""
    own = P.report(_decided(t), ["sport"])
    computed = own.select("sport", F.expr("stack(2, 'won', CAST(won AS DOUBLE), 'decisions', CAST(decisions AS DOUBLE)) AS (metric, value)"))
    off = F.when((F.col("sport") == "soccer") & (F.col("metric") == "decisions"), 1.0).otherwise(0.0)
    claims = computed.withColumn("value", F.col("value") + off).unionByName(own.select("sport", F.lit("sharpe").alias("metric"), F.lit(1.0).alias("value")))
    return P.verify(claims, computed, ["sport"]).select("sport", "metric", "check")


#: Strategies of this query, the last two of which are none.
STRATEGIES = (
    '{"id": "diamond", "sport": "baseball", "version": "1", "approvedMarkets": ["moneyline"], "prohibitedMarkets": ["spread"], "minimumEv": 0.02, "minimumComparisonBooks": 2, "maximumPriceAgeMinutes": 15}',
    '{"id": "pitch", "sport": "soccer", "version": "1", "approvedMarkets": ["moneyline", "spread"], "prohibitedMarkets": [], "minimumEv": 0.025, "minimumComparisonBooks": 3, "maximumPriceAgeMinutes": 15}',
    '{"id": "court", "sport": "basketball", "version": "1", "approvedMarkets": ["total"], "minimumEv": 0, "minimumComparisonBooks": 1, "maximumPriceAgeMinutes": 1}',
    '{"id": "grid", "sport": "football", "version": "1", "approvedMarkets": ["moneyline"], "minimumEv": 2, "minimumComparisonBooks": 1, "maximumPriceAgeMinutes": 1}',
    '{"id": "grid", "sport": "foot',
)


@query(f"""WITH s(sport, strategy, approved, prohibited, ev, books, age) AS (VALUES ('baseball', 'diamond', ['moneyline'], ['spread'], 0.02e0, 2, 15), ('soccer', 'pitch', ['moneyline', 'spread'], ['-'], 0.025e0, 3, 15), ('basketball', 'court', ['total'], ['-'], 0e0, 1, 1))
SELECT d.id, s.strategy, CASE WHEN s.sport IS NULL THEN 'no-strategy' WHEN list_contains(prohibited, market) THEN 'market-prohibited' WHEN NOT list_contains(approved, market) THEN 'market-not-approved'
  WHEN p * {dec('american')} - 1 < ev THEN 'ev-below-minimum' WHEN d.game % 5 < books THEN 'too-few-books' WHEN d.game % 20 > age THEN 'price-too-old' END AS reason FROM decisions d LEFT JOIN s USING (sport)""")
def strategy_checks(t):
    """Every decision against its sport's strategy, read from JSON."""
    rules = S.strategies(t.spark.createDataFrame([(x,) for x in STRATEGIES], "config string"))
    rows = t.decisions.select("id", "sport", "market", (F.col("p") * american_to_decimal(F.col("american")) - 1).alias("ev"), (F.col("game") % 5).alias("books"), (F.col("game") % 20).alias("age_minutes"))
    return S.against_strategy(rows, rules).select("id", "strategy", "reason")
