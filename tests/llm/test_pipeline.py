"""The pipeline's stages against brute force on the smallest documents, and the SQL of the operators that have one."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
from test_dedup import brute_components, brute_fingerprint, brute_lines
from test_models import brute_targets
from test_texts import check_packing
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricelens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents, then what each stage makes of all that its predecessor kept."""
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet")
    made = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, made[-1], SF).write.parquet(str(folder / name))
        made.append(spark.read.parquet(str(folder / name)))
    return made


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "mix", "pack"]
    assert all(df.columns == stages[0].columns for df in stages[1:5])


def test_quality_rejects_junk_only(spark):
    """On 1000 documents; 200 have too few trusted positives for a model that rejects anything."""
    folder = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.keep_good(spark, docs, folder).select("doc_id").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    good, bad = [i for i, y in labels.items() if y], [i for i, y in labels.items() if not y]
    assert len(kept.intersection(good)) >= 0.97 * len(good) and len(kept.intersection(bad)) <= 0.1 * len(bad)


def test_lines(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    want = Counter((i, t) for (i, _, _, t), n in brute_lines(rows, 10).items() for _ in range(n))
    assert Counter((r["doc_id"], r["text"]) for r in stages[2].collect()) == want


def test_near_duplicates(stages):
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in stages[2].collect()]
    root = brute_components({f for _, f in rows})
    first = defaultdict(list)
    for i, f in rows:
        first[root[f]].append(i)
    assert Counter(r["doc_id"] for r in stages[3].collect()) == Counter(min(x) for x in first.values())


def test_one_row_of_each_component_stays(spark):
    """Repeated rows, rows of one id with other texts, null ids: exactly one row of each component stays, by id, null last."""
    text = " ".join(f"word{k}" for k in range(300))
    other = " ".join(f"thing{k % 91}" for k in range(200))
    rows = [(1, text, "a"), (1, text, "a"), (2, text, "b"), (1, other, "c"), (3, other, "d"), (None, other, "e"), (None, "alone", "f"), (None, "alone", "f"), (7, None, "g"), (5, "", "h"), (5, " ", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = Counter(map(tuple, corpus_pipeline.drop_copies(spark, docs, SF).collect()))
    kept = {(i, t) for i, t, _ in got.elements()}
    assert sum(got.values()) == 4 and {(1, text), (1, other), (None, "alone")} <= kept and any(i == 5 for i, _ in kept)


def test_mix(stages):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in stages[3].collect()]
    times = Counter(r["doc_id"] for r in stages[4].collect())
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    by_source, taken = defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        by_source[s] += size(t)
        taken[s] += times[i] * size(t)
    targets = brute_targets(dict(by_source))
    assert max(times.values()) <= 2
    assert all(abs(taken[s] - targets[s]) <= max(size(t) for _, t, z in rows if z == s) for s in targets)


def test_packing(stages):
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), defaultdict(list)
    for r in stages[4].collect():
        want[r["doc_id"]].append([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2])
    got = stages[5].collect()
    assert check_packing(got, want, 4096) == 0


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == stages[5].columns and got.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert Counter(map(tuple, df.select(columns).collect())) == Counter(cursor.fetchall())


def test_stages_bear_odd_rows(spark, docs, nothing):
    """Nulls, empty and long texts, repeated rows, clashing columns and an empty table pass through every stage."""
    for start in (docs, nothing):
        now = start
        for _, stage in corpus_pipeline.STAGES:
            made = stage(spark, now, SF)
            if "sequence_id" not in made.columns:
                assert made.columns == start.columns
            rows = made.collect()
            now = spark.createDataFrame(rows, made.schema)
        assert bool(rows) == (start is docs)


CLASHES = ("own", "row", "fp", "at", "first", "hit", "hit_1", "bucket", "bitmap", "slot", "copies", "taken", "key", "group", "rate", "most", "order", "alike", "part", "of", "n", "x", "rest", "_", "__x", "__row", "__copy", "__drop", "drop", "n_lines", "n_dropped", "batch", "range", "score", "target", "source_size", "text_sha256", "h 1")


def test_stages_bear_any_extra_column(spark, docs):
    """Columns by every internal name come out as they came in."""
    own = docs.drop(*CLASHES).withColumns({c: F.concat(F.lit(c), F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES[:4]:
        made = stage(spark, own, SF)
        assert made.columns == own.columns
        rows = made.collect()
        assert rows and all(r[c] == f"{c}-{'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in CLASHES), name
    assert corpus_pipeline.STAGES[4][1](spark, own, SF).count()
