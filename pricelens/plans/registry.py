"""Named queries, each a function over Tables with SQL of the same result where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pricelens.plans.facts import FACTS, Tables, fact_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: SQL of queries as written; oracles() completes it.
SQL: dict[str, str] = {}
#: Named parts that the SQL of several queries shares.
PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    PARTS[name] = sql


def with_parts(sql: str) -> str:
    """sql preceded by the facts and parts that it names, as common table expressions, each after those it needs."""
    text = lambda k: PARTS[k] if k in PARTS else fact_sql(k, "duckdb")
    done: dict[str, str] = {}

    def need(x: str) -> None:
        words = set(re.findall(r"\w+", x))
        for k in [*FACTS, *PARTS]:
            if k in words and k not in done and text(k) is not x:
                if k in PARTS:
                    need(PARTS[k])
                done[k] = f"{k} AS ({text(k)})"

    own = sql.strip()
    need(own)
    if not done:
        return own
    joined = ",\n".join(done.values())
    for head in ("WITH RECURSIVE ", "WITH "):
        if own.startswith(head):
            return f"{head}{joined},\n{own[len(head) :]}"
    return f"WITH {joined}\n{own}"


def oracles() -> dict[str, str]:
    """Whole SQL by query, once all modules have registered theirs."""
    return {k: with_parts(x) for k, x in SQL.items()}


def query(sql: str | None = None, name: str | None = None):
    """Register a function over Tables; sql: the same result on DuckDB, over facts and parts by name."""

    def register(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[key] = sql
        return f

    return register
