"""Counts of fuzzy matches that don't come from pairs, against all pairs."""

import random
from types import SimpleNamespace

import pytest

from pricelens.operators.fuzzy import fuzzy_events
from pricelens.plans import boards

HOUR = 3_600_000
LISTING, EVENT = (f"{k} long, sport string, home string, away string, start_ms long" for k in ("listing", "event"))
GENERIC = {"afc", "cf", "city", "club", "fc", "fk", "gnk", "pfc", "sc", "sk", "united"}


def words(label):
    plain = label.lower().replace("é", "e").replace("ø", "o")
    return "".join(x if x in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for x in plain).split()


def fuzzy(x, y):
    a, b = words(x), words(y)
    wa, wb, oa, ob = "".join(a), "".join(b), set(a) - GENERIC, set(b) - GENERIC
    return wa == wb or min(len(wa), len(wb)) >= 4 and (wa in wb or wb in wa) or bool(oa) and oa == ob or any(len(w) >= 4 for w in oa & ob)


def matches(l, e):
    if None in l[1:] or None in e or l[1] != e[1] or abs(l[4] - e[4]) > HOUR:
        return False
    (hh, ha), (ah, aa) = ([fuzzy(l[x], e[y]) for y in (2, 3)] for x in (2, 3))
    return hh != ha and ah != aa and hh != ah or abs(l[4] - e[4]) <= 900_000 and (hh != ha and not ah and not aa or ah != aa and not hh and not ha)


def expected(listings, events):
    own = {}
    for l in listings:
        own.setdefault(l[0], set()).update(e[0] for e in events if matches(l, e))
    own.pop(None, None)
    return sorted((repr(l[0]), len(x), *x) if len(x := own.get(l[0], set())) == 1 else (repr(l[0]), len(x), None) for l in listings)


def labels(rng, frequent):
    """Labels of frequent and rare words, with words run together, cut, hidden in others, generic, short, or without letters."""
    word = lambda: rng.choice(frequent) if rng.random() < 0.5 else rng.choice(["kestrel", "otter", "Élan", "ab", "abc", "fc", "united", "øre", "1234", "56789", "x"]) + rng.choice(["", "", "s", str(rng.randrange(30))])
    form = rng.random()
    if form < 0.02:
        return rng.choice([None, "", "—", "fc", "ab", "a-b", "FC United"])
    text = rng.choice([" ", "-", " "]).join(word() for _ in range(rng.randrange(1, 4)))
    if form < 0.12:
        return text.replace(" ", "")
    if form < 0.2:
        return text[rng.randrange(3) :][: rng.randrange(4, 9)]
    return rng.choice(["new", "x"]) + text if form < 0.26 else text.upper() if form < 0.4 else text


@pytest.mark.parametrize(("seed", "bare", "repeat"), [(1, True, False), (2, False, False), (3, True, True)])
def test_every_kind_of_match(spark, seed, bare, repeat):
    """bare: events without frequent words too; repeat: ids that come again, alike and in other forms, and null ids."""
    rng = random.Random(seed)
    frequent = ["port", "rovers", "harbour", "bour"]

    def rows(n, sure):
        made = []
        for k in range(n):
            home, away = labels(rng, frequent), labels(rng, frequent)
            if sure:
                home, away = (None if x is None else f"{x} {rng.choice(frequent)}" for x in (home, away))
            made.append((k, rng.choice(["a", "a", "b"]), home, away, rng.choice([0, 0, 600_000, 900_000, 900_001, HOUR, HOUR + 1, 20 * HOUR, -HOUR]) + rng.choice([0, 5 * HOUR])))
        return made

    events, listings = rows(150, not bare), rows(250, False)
    if repeat:
        events += events[:5] + [(k, *x[1:]) for k, x in zip(range(10, 20), rows(10, False))]
        listings += listings[:5] + [(k, *x[1:]) for k, x in zip(range(10, 20), rows(10, False))] + [(None, *listings[0][1:])] * 2
    got = fuzzy_events(spark.createDataFrame(listings, LISTING), spark.createDataFrame(events, EVENT), HOUR, 900_000, 10, 0.1).collect()
    want = expected(listings, events)
    assert sorted((repr(r["listing"]), r["n"], r["event"]) for r in got) == want
    assert {1, 2} <= {n for _, n, _ in want} and max(n for _, n, _ in want) > 10


def shuffled(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    quantiles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = store.stageList(None, False, False, quantiles, None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_pairs_of_frequent_words_are_not_made(spark):
    """1,500 listings of 1,500 events each: 2,250,000 pairs match, and none of them is shuffled."""
    n = 1500
    side = lambda key: spark.range(n).selectExpr(f"id AS {key}", "'ASIA' AS sport", "'Port ' || (id + 100) AS home", "'Lake rovers ' || (id + 5000) AS away", "0L AS start_ms").repartition(4).localCheckpoint()
    tables, before = SimpleNamespace(listings=side("listing"), schedule=side("event")), shuffled(spark)
    got = boards.fuzzy_labels(tables).collect()
    assert {(r["n"], r["event"]) for r in got} == {(n, None)} and len(got) == n
    assert shuffled(spark) - before < 100 * n
