"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
# fitting hundreds of trees is exercised by the model tests on small frames
SLOW = {"i1_canonical_forest", "i2_graph_policy", "i8_fold_predictions"}
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else (value + 0.0 if isinstance(value, float) else value)


def table(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = table(df.select(*columns).collect())
    if name not in ORACLES:
        assert found
        return
    expected = duck.sql(ORACLES[name])
    assert sorted(expected.columns) == columns
    types = dict(zip(expected.columns, map(str, expected.types)))
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == types
    order = [expected.columns.index(c) for c in columns]
    assert found == table([tuple(r[i] for i in order) for r in expected.fetchall()])
