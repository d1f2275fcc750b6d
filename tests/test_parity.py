"""Every query with SQL gives the same rows, names and types on Spark and on DuckDB."""

import duckdb
import pytest

from pricelens.plans import boards, consensus, experiments, prices, reports, series, serving, streams  # noqa: F401  they register their queries
from pricelens.plans.facts import SOURCES
from pricelens.plans.registry import QUERIES, oracles

ORACLES = oracles()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in SOURCES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def ordered(rows, columns):
    place = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(row[k] for k in place) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    cursor = duck.execute(ORACLES[name])
    columns = {c[0]: str(c[1]) for c in cursor.description}
    want = cursor.fetchall()
    assert {c: TYPES[t] for c, t in df.dtypes} == columns
    assert ordered(map(tuple, got), df.columns) == ordered(want, list(columns))


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
