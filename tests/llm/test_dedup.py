"""Exact dedup, line dedup and SimHash against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import xxhash
from pyspark.sql import functions as F

from pricelens.llm.components import connected_components
from pricelens.llm.common import shared_dir
from pricelens.llm.exact_bloom import exact_dedup, hash_ranges
from pricelens.llm.line_runs import LineRuns, line_dedup
from pricelens.llm.simhash_cover import RADIUS, all_masks, close_links, covering_masks, drop_near_duplicates, fingerprint, narrower, near_duplicates, row_ranges

SPACE = " \t\n\x0b\x0c\r"


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def test_exact_dedup(docs, rows):
    hashed = [(i, hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", t or "").encode()).hexdigest()) for i, t in rows]
    groups = defaultdict(list)
    for i, h in hashed:
        groups[h].append(i)
    first = {h: min((i for i in g if i is not None), default=None) for h, g in groups.items()}
    for bits in (None, 1 << 20, 64):  # even a filter that is full gives the same rows
        got = exact_dedup(docs, bits=bits).collect()
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == Counter((i, first[h], len(groups[h]), h) for i, h in hashed)
        kept = Counter(r["text_sha256"] for r in got if r["kept"])
        assert kept == Counter(dict.fromkeys(groups, 1))
        assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_ranges_of_hashes(spark, docs, rows, tmp_path):
    """With a filter far too small for all rows the hashes go in ranges; results are the same, and few unrepeated rows shuffle."""
    want = Counter(tuple(r) for r in exact_dedup(docs).drop("kept").collect())
    assert Counter(tuple(r) for r in exact_dedup(docs, most_bits=64).drop("kept").collect()) == want
    assert sum(r["kept"] for r in exact_dedup(docs, most_bits=64).collect()) == len({h for *_, h in want})
    for n, most in ((0, 64), (8, 64), (9, 64), (1 << 20, 1 << 10), (1 << 40, 64)):
        ranges = hash_ranges(n, most)
        assert ranges[0][0] == "0000" and ranges[-1][1] == "g" and all(a < b for a, b in ranges) and all(x[1] == y[0] for x, y in zip(ranges, ranges[1:]))
        assert len(ranges) * most >= min(8 * n, most << 16)
    many = spark.range(20_000).select("id", F.concat(F.lit("text "), F.least("id", F.lit(19_990))).alias("text"))
    before = set(Path(shared_dir(spark).removeprefix("file:")).glob("text-groups-*"))
    got = exact_dedup(many, "id", most_bits=1 << 14).collect()
    assert Counter(r["group_size"] for r in got) == {1: 19_990, 10: 10} and sum(r["kept"] for r in got) == 19_991
    shuffled = spark.read.parquet(*[str(p) for p in set(Path(shared_dir(spark).removeprefix("file:")).glob("text-groups-*")) - before])
    assert shuffled.count() <= 600  # 3 of 100 rows pass both filters of 8 slots a row, whatever the number of rows


def test_rows_marked_in_ranges(spark, docs):
    """Near-duplicates that go are marked range by range of row numbers; the rows that stay are the same."""
    want = Counter(map(tuple, drop_near_duplicates(docs).collect()))
    assert Counter(map(tuple, drop_near_duplicates(docs, most_marked=7).collect())) == want
    numbered = docs.repartition(5).select(F.monotonically_increasing_id().alias("row"))
    for most in (1, 7, 20, 1000):
        ranges = row_ranges(numbered, most)
        assert ranges[0][0] is None and ranges[-1][1] is None and all(x[1] == y[0] for x, y in zip(ranges, ranges[1:]))
    assert row_ranges(numbered.where("false"), 5) == [(None, None)]


def brute_lines(rows, least):
    key = lambda line: lower(line.strip(SPACE))
    found = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if found[key(x)] < least or not key(x)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_line_dedup(docs, rows):
    got = line_dedup(docs.drop("row"), min_documents=10)
    assert set(got.columns) == {*docs.drop("row").columns, "n_lines", "n_dropped"}
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == brute_lines(rows, 10)
    got = line_dedup(docs, min_documents=2, batches=5, fanout=2)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == brute_lines(rows, 2)


def test_runs_compact_and_skip_known(spark):
    runs = LineRuns(spark, min_documents=4, fanout=2, buckets=2)
    batch = lambda *x: spark.createDataFrame([(h, h + 1, n) for h, n in x], "h1 long, h2 long, n long")
    runs.add(batch((1, 3), (2, 1)))
    runs.add(batch((1, 1), (3, 5)))
    assert runs.levels[1] and not runs.levels.get(0)
    runs.add(batch((1, 9), (2, 3), (4, 1)))  # 1 is known to be frequent by now and adds nothing
    newest = runs.rows(runs.levels[0]).collect()
    assert {(r["h1"], r["n"]) for r in newest} == {(2, 3), (4, 1)}
    assert {r["h1"] for r in runs.frequent().collect()} == {1, 2, 3}


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", lower(text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(points):
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    points = list(points)
    for k, a in enumerate(points):
        for b in points[:k]:
            if (a ^ b).bit_count() <= RADIUS:
                root[find(a)] = find(b)
    return {p: find(p) for p in points}


def test_near_duplicates(docs, rows):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    assert all(fingerprint((t or "").encode()) & (1 << 64) - 1 == f for (_, t), (_, f) in zip(rows, fps))
    root = brute_components({f for _, f in fps})
    ids = defaultdict(list)
    for i, f in fps:
        ids[root[f]].append(i)
    first = {r: min((i for i in g if i is not None), default=None) for r, g in ids.items()}
    got = near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == Counter((i, f"{f:016x}", first[root[f]]) for i, f in fps)


def test_masks_cover_every_pair():
    masks, rng = covering_masks(), random.Random(1)
    assert len(masks) == 15
    for _ in range(3000):
        bits = rng.sample(range(64), rng.randint(1, RADIUS))
        difference = sum(1 << b for b in bits)
        assert any(not m & difference for m in masks)
        m = next(m for m in masks if not m & difference)
        assert any(not x & difference for x in narrower(m))
    assert max(64 - m.bit_count() for m in all_masks()[-4:]) <= 12


def test_links_when_runs_overflow(spark):
    """A dense ball of fingerprints, far more than max_run share every key, has the components of brute force."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    points = {centre ^ sum(1 << b for b in rng.sample(range(40), rng.randint(0, 7))) for _ in range(500)}
    points |= {rng.getrandbits(64) for _ in range(50)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in points], "fp long")
    want = brute_components(points)
    groups = defaultdict(set)
    for p, r in want.items():
        groups[r].add(signed(p))
    for max_run in (4, 64, 2048):
        got = defaultdict(set)
        for r in connected_components(close_links(df, max_run)).collect():
            got[r["root"]].add(r["node"])
        assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 100), (200, 201), (201, 200)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 200: 200, 201: 200}


def test_empty(nothing):
    assert exact_dedup(nothing).count() == line_dedup(nothing).count() == near_duplicates(nothing).count() == 0
