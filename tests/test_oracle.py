"""Every registered job against its DuckDB oracle on sf0.001 (the driver
runs the same comparison at sf0.01)."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as entry
from aspectspark import catalog, oracle
from tests.conftest import SF001

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

QUERIES = catalog.QUERIES
SQL = oracle.oracle_sql()
TRAINED = {"train_head", "cross_validate_metrics", "cross_validate_multilabel_metrics"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(hashlib.md5(repr([_norm(r[i]) for i in order]).encode()).hexdigest()
                  for r in rows)


def test_every_query_has_sql_or_is_training():
    assert set(QUERIES) - set(SQL) == TRAINED
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    drows = rel.fetchall()
    assert len(rows) == len(drows)
    assert _digest(df.columns, rows) == _digest(rel.columns, drows)


@pytest.mark.parametrize("name", sorted(TRAINED))
def test_training_rows(spark, name):
    df = QUERIES[name](spark, SF001)
    n = df.count()
    assert n == (5 if name.startswith("cross_validate") else
                 spark.read.parquet(f"{SF001}/embeddings.parquet").count())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and df.columns == ["id", "n_annotations", "annotation_text"]
