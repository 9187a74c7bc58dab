"""The driver's contract, and every engine query against DuckDB at the smallest scale."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quarry import queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def plain(v):
    return bytes(v) if isinstance(v, (bytes, bytearray)) else v


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query_against_duckdb(spark, name):
    got = entry.queries()[name](spark, SMALL)
    if name not in entry.oracle_sql():
        assert name == "suffix_blocks"  # ranks by brute force are in test_engine
        blocks = {r.block: r.n for r in got.collect()}
        n = queries.QUERIES["suffix_facts"](spark, SMALL).first().n_suffixes
        assert blocks == {b: min(2048, n - 2048 * b) for b in range(-(-n // 2048))}
        return
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(r) for r in want.fetchall()), key=repr)


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert (len(rows), sum(r.n_matches for r in rows)) == (3, 4)


def test_pushdown(spark):
    plan = queries.QUERIES["search_docs"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(text,License)" in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
