"""Streams equal their batch results, sinks are idempotent, the lifecycle fold equals a plain loop."""

import random

from pyspark.sql import functions as F

from pricelens.operators.latest import current_quotes
from pricelens.sources import bronze, pages, sinks
from pricelens.sources.landing import expire, land, landed
from pricelens.sources.storage import VersionedTable, folders
from pricelens.streaming import lifecycle, projection

SCHEMA = "game long, market string, selection string, book string, observed_ms long, provider_rank int, snapshot_id long, american int"


def test_projection_with_late_rows(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randint(0, 4), "m", "h", rng.choice("ab"), rng.randint(0, 100), 0, k, 100 + k) for k in range(400)]
    current = str(tmp_path / "current")
    for k in range(4):  # four files arrive one after the other, with old and new observations mixed
        spark.createDataFrame(rows[100 * k : 100 * k + 100], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = projection.read_table_stream(spark, str(tmp_path / "in"), files_per_batch=1)
        projection.project_current(stream, current, str(tmp_path / "check")).awaitTermination()
    want = sorted(map(tuple, current_quotes(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert sorted(map(tuple, projection.read_current(spark, current).collect())) == want
    cells = len({r[:4] for r in rows})
    assert all(spark.read.parquet(f"{current}/batches/batch={k}").count() <= cells for k in range(4))
    projection.project_current(projection.read_table_stream(spark, str(tmp_path / "in")), current, str(tmp_path / "check")).awaitTermination()
    assert len(folders(spark, f"{current}/batches")) == 4  # nothing new, nothing written
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")  # the session's own again
    compact = str(tmp_path / "compact")
    for k in range(2):  # the second run goes on where the first ended, and writes nothing
        projection.project_current(projection.read_table_stream(spark, str(tmp_path / "in"), 1), compact, str(tmp_path / "other"), compact_every=3).awaitTermination()
        assert sorted(p.getName() for p in folders(spark, f"{compact}/batches")) == ["batch=3"]
        assert sorted(map(tuple, projection.read_current(spark, compact).collect())) == want
    assert [p.getName() for p in folders(spark, f"{compact}/current")] == ["upto=2"]


def commands(rng, n=300):
    return [(rng.choice("xyz"), k, f"c{k // 2}", 1000 * k - rng.choice([0, 0, 5000]), rng.choice(["active", "stale", "suspended"]) if k < 280 else "closed", rng.choice(["r", "s"]), rng.choice([None, 9])) for k in range(n)]


COMMANDS = "key string, seq long, command string, at_ms long, state string, reason string, expires_ms long"


def walked(rows):
    """What each command did, and the heads at the end, by a plain loop."""
    want, heads = [], {}
    for k, _, command, at, state, reason, expires in rows:
        before = heads.get(k)
        heads[k], outcome = lifecycle.advance(before, command, at, state, reason, expires)
        want.append((k, command, outcome, heads[k][0], before[1] if before else None, heads[k][1], at, heads[k][2], heads[k][5]))
    return want, heads


def in_order(df):
    return sorted((tuple(r[c] for c in lifecycle.COLUMNS) for r in df.collect()), key=repr)


def test_fold(spark):
    rows = commands(random.Random(2))
    want, heads = walked(rows)
    df = spark.createDataFrame(rows, COMMANDS)
    assert in_order(lifecycle.fold(df)) == sorted(want, key=repr)
    assert {o for _, _, o, *_ in want} == {"transition", "duplicate", "closed", "ignored-older", "noop"}
    assert {r["key"]: (r["version"], r["state"], r["reason"], r["at_ms"], r["expires_ms"]) for r in lifecycle.heads(lifecycle.fold(df)).collect()} == {k: (*h[:3], *h[4:]) for k, h in heads.items()}


def test_sweep_of_real_heads(spark):
    """A key's last command need not be its head: an older one, a repeated one and one after the end move nothing."""
    rows = [
        ("a", 1, "c1", 10, "active", "", 50), ("a", 2, "c2", 5, "stale", "", None), ("b", 3, "c3", 10, "active", "", 500), ("c", 4, "c4", 10, "closed", "", None), ("c", 5, "c5", 20, "active", "", 50),
        ("d", 6, "c6", 10, "active", "", 60), ("d", 7, "c6", 20, "suspended", "", None), ("e", 8, "c8", 10, "active", "", None),
    ]
    df = spark.createDataFrame(rows, COMMANDS)
    sweep = lifecycle.expired(lifecycle.heads(lifecycle.fold(df)), 100)
    assert sorted((r["key"], r["command"], r["at_ms"]) for r in sweep.collect()) == [("a", "sweep:a:100", 100), ("d", "sweep:d:100", 100)]
    _, heads = walked(rows + [(k, 9, f"sweep:{k}:100", 100, *lifecycle.EXPIRED) for k in "ad"])
    assert {r["key"]: (r["version"], r["state"], r["expires_ms"]) for r in lifecycle.swept(df, 100).collect()} == {k: (h[0], h[1], h[5]) for k, h in heads.items()}


def test_fold_on_a_stream_with_timers(spark, tmp_path):
    """Three files, a query started anew for each; an expiry that has passed makes a head stale in the batch after."""
    later = 4_102_444_800_000
    rows = [(*r[:6], None if r[6] is None else later + r[6]) for r in commands(random.Random(2))]
    due = [("due", 400, "d0", 500, "active", "", 1000), ("due", 402, "d2", 2000, "active", "", 1500), ("moved", 401, "m1", 500, "active", "", later)]
    again = [("moved", 500, "m2", 600, "suspended", "", None)]  # its timer goes
    files = [rows[:100] + due[:1] + due[2:], rows[100:200] + again, rows[200:] + due[1:2], [("last", 900, "l", 1, "active", "", None)]]
    for own in files:
        spark.createDataFrame(own, COMMANDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = projection.read_table_stream(spark, str(tmp_path / "in"))
        lifecycle.start_fold(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    sweeps = [("due", 401, "sweep:due:1000", 1000, *lifecycle.EXPIRED), ("due", 403, "sweep:due:1500", 2000, *lifecycle.EXPIRED)]
    both = sorted(rows + due + again + sweeps + files[3], key=lambda r: r[1])
    got = spark.read.parquet(str(tmp_path / "out"))
    assert in_order(got) == in_order(lifecycle.fold(spark.createDataFrame(both, COMMANDS))) == sorted(walked(both)[0], key=repr)
    assert {(r["key"], r["state"]) for r in lifecycle.heads(got).collect() if r["key"] in ("due", "moved")} == {("due", "stale"), ("moved", "suspended")}


RAW = "id int, kind string, provider string, received_ms long, body string"


def test_landing(spark, tmp_path):
    """Two kinds and an unknown one in one stream; a batch that comes again changes nothing; days expire by their names."""
    day, good = 86_400_000, '{"event":"e","market":"m","selection":"s","book":"b","american":110,"observed_ms":1,"retrieved_ms":2}'
    event = '{"data":[{"id":"a","sport":"s","league":"l","start_time":"2024-01-01T00:00:00Z","status":"x","is_live":true,"markets":[],"books":[]},5],"pagination":{"has_more":false}}'
    rows = [(k, "odds", "pq"[k % 2], k // 2 * day, good if k % 3 else "{torn") for k in range(12)] + [(20, "events", "p", day, event), (21, "gossip", "p", day, ""), (22, None, "p", day, ""), (23, "odds", "p", None, good)]

    def events(batch):
        known = batch.select(F.col("id").alias("page_id"), "provider", "received_ms")
        return tuple(df.join(known, "page_id") for df in pages.parse_pages(batch, "id", "body", "events"))

    for k in (0, 1):
        spark.createDataFrame(rows[8 * k : 8 * k + 8], RAW).coalesce(1).write.mode("append").parquet(str(tmp_path / "raw"))
    stream = projection.read_table_stream(spark, str(tmp_path / "raw"), 1)
    run = lambda name: land(stream, {"odds": lambda b: bronze.odds_rows(b, "body"), "events": events}, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / name)).awaitTermination()
    counts = lambda: (landed(spark, str(tmp_path / "good"), "odds").count(), landed(spark, str(tmp_path / "good"), "events").count(), spark.read.parquet(str(tmp_path / "bad")).count())
    run("check")
    assert counts() == (9, 1, 7)
    run("another")  # the same batches once more, as after a lost checkpoint
    assert counts() == (9, 1, 7)
    assert {str(r["day"]) for r in landed(spark, str(tmp_path / "good"), "odds").where("provider = 'p'").select("day").distinct().collect()} == {"1970-01-02", "1970-01-03", "1970-01-05", "1970-01-06", "none"}
    for f in (tmp_path / "good" / "kind=odds").rglob("*.parquet"):
        f.write_text("no parquet")  # whatever the files hold, only names decide
    gone = expire(spark, str(tmp_path / "good"), 93 * day, 90)
    assert [g.partition("kind=")[2] for g in gone] == ["events/provider=p/day=1970-01-02", *[f"odds/provider={p}/day=1970-01-0{d}" for p, d in ("p2", "p3", "q1", "q3")]]
    assert expire(spark, str(tmp_path / "good"), 93 * day, 90) == [] and expire(spark, str(tmp_path / "nothing"), 0, 1) == []


def test_pages(spark):
    """One bad element leaves its siblings; each field is of its own kind of value."""
    element = '{"id":"%s","sport":"s","league":"l","start_time":"%s","status":"x","is_live":%s,"home_team":%s,"markets":%s,"books":null}'
    ok = "2024-01-01T00:00:00.5+01:00"
    own = [
        element % ("a", ok, "true", "5", '["m",""]'), element % ("a", ok, "true", "null", "[]"), element % ("b", "2024-01-01", "true", "null", "[]"), element % ("c", ok, '"true"', "null", "[]"), "17", "null", "[1]",
        element % (" d", ok, "true", "null", "[]"), element % ("e", ok, "false", '"H"', '{"m":1}'), element % ("b", ok, "true", "null", "[]"),
    ]
    page = lambda *e, more="false": '{"data":[' + ",".join(e) + '],"pagination":{"has_more":' + more + "}}"
    rows = [(1, page(*own)), (2, "{torn"), (3, None), (4, '{"data":7,"pagination":{"has_more":true}}'), (5, page(own[0], more="1")), (6, page(*["1"] * 201)), (7, '{"data":null,"pagination":{"has_more":false,"count":0}}'), (8, page())]
    good, bad = pages.parse_pages(spark.createDataFrame(rows, "p int, body string"), "p", "body", "events")
    assert [(r["row_index"], r["id"], r["start_ms"], r["is_live"], r["home"], r["markets"], r["warnings"]) for r in good.orderBy("row_index").collect()] == [
        (0, "a", 1704063600500, True, None, ["m"], ["home-participant-invalid", "markets-entry-invalid", "books-invalid"]), (8, "e", 1704063600500, False, "H", [], ["markets-invalid", "books-invalid"]),
        (9, "b", 1704063600500, True, None, [], ["books-invalid"]),
    ]
    assert sorted((r["page_id"], r["row_index"], r["reason"]) for r in bad.collect()) == [
        (1, 1, "duplicate-provider-id"), *[(1, k, "invalid-row") for k in (2, 3, 4, 5, 6, 7)], (2, -1, "page-malformed"), (3, -1, "page-malformed"), (4, -1, "page-data"), (5, -1, "page-pagination"), (6, -1, "page-size"),
    ]


def test_history_is_immutable(spark):
    stored = spark.createDataFrame([(1, 10), (2, 20)], "id int, v int")
    batch = spark.createDataFrame([(1, 10), (2, 21), (3, 30), (3, 30), (4, 1), (4, 2)], "id int, v int")
    got = {k: sorted(r["id"] for r in df.collect()) for k, df in sinks.new_history(stored, batch, "id", ["v"]).items()}
    assert got == {"append": [3], "existing": [1], "conflicts": [2, 4]}


def test_boards_replace_what_they_touch(spark, tmp_path):
    row = "game long, start_ms long, sport string, league string, status string, day string"
    write = lambda rows: sinks.write_boards(spark.createDataFrame(rows, row), str(tmp_path / "boards"))
    write([(1, 5, "s", "l", "live", "d"), (2, 6, "s", "l", "final", "d")])
    write([(3, 7, "s", "l", "live", "d")])
    assert [r["game"] for r in sinks.read_board(spark, str(tmp_path / "boards"), status="live").collect()] == [3]
    assert sinks.read_board(spark, str(tmp_path / "boards")).count() == 2


def test_arbitrage_board_only_moves_forward(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "arbitrage"))
    found = lambda *holds: spark.createDataFrame([(k, "m", h) for k, h in enumerate(holds)], "game int, market string, hold double")
    assert sinks.advance_arbitrage_board(table, found(-2.0, -1.0, -3.0), 100, limit=2)
    assert not sinks.advance_arbitrage_board(table, found(-9.0), 90)
    assert [(r["hold"], r["total_count"]) for r in table.read().orderBy("hold").collect()] == [(-3.0, 3), (-2.0, 3)]


def test_bad_rows_are_quarantined(spark):
    good = '{"event":"e","market":"m","selection":"s","book":"b","american":110,"observed_ms":1,"retrieved_ms":2}'
    bodies = [good, "{torn", good.replace("110", "50"), good.replace('"e"', '" "'), "", None]
    raw = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    fine, bad = bronze.odds_rows(raw, "body")
    assert [r["id"] for r in fine.collect()] == [0]
    assert {r["id"]: r["reason"] for r in bad.collect()}.keys() == {1, 2, 3, 4, 5}


def test_windows(spark):
    df = spark.sql("SELECT CAST(x AS TIMESTAMP) AS at, 'k' AS k FROM VALUES ('2024-01-01 00:00:10'), ('2024-01-01 00:04:59'), ('2024-01-01 00:05:00') t(x)")
    got = projection.window_counts(df, "at", "5 minutes", "10 minutes", "k").select(F.unix_timestamp("window.start").alias("s"), "n").orderBy("s").collect()
    assert [r["n"] for r in got] == [2, 1]
