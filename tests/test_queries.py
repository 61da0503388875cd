"""Registered queries against their DuckDB oracles, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from heronry.plans.oracles import ORACLES
from heronry.plans.queries import QUERIES

SF = os.environ.get("HERONRY_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def rows(df):
    out = []
    for row in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple("" if v is None or v != v else repr(round(float(v), 5)) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v) for v in row))
    return sorted(out)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLES:
        assert rows(got) == rows(duck.sql(ORACLES[name]).df())


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_type", "k", "mean_recall", "mean_mrr", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
