"""The registered queries against their oracles on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def test_entry(spark, sf_dir):
    df = contract.entry(spark)
    assert df.columns == ["mass_bin", "n_events", "mean_cos_theta_star"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(cell(r[columns.index(c)]) for c in sorted(columns)) for r in result.fetchall())
    got = sorted(tuple(cell(r[c]) for c in sorted(columns)) for r in df.collect())
    assert got == want
