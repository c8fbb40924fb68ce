"""Every registered query of the library against its SQL in DuckDB."""

import math

import duckdb
import pytest
import query_text_cases
from pyspark import cloudpickle

from graphloom.plans import registry

cloudpickle.register_pickle_by_value(query_text_cases)  # workers don't have the tests' folder
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(name, spark, sf_dir, duck):
    compare(registry.queries()[name](spark, sf_dir), registry.oracle_sql().get(name), duck)


@pytest.mark.parametrize("name", sorted(query_text_cases.QUERIES))
def test_cases(name, spark, sf_dir, duck):
    compare(query_text_cases.QUERIES[name](spark, sf_dir), query_text_cases.SQL[name], duck)


def compare(df, sql, duck):
    columns = sorted(df.columns)
    mine = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    if sql is None:
        assert mine, "a query without SQL has rows at least"
        return
    rel = duck.sql(sql)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert [repr(x) for x in mine] == [repr(x) for x in theirs]
