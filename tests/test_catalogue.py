"""Every catalogue query against its SQL."""

import math

import duckdb
import pytest

from sonorel import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(df):
    columns = sorted(df.columns)
    df = df.astype(object).where(df.notna(), None)[columns]
    return columns, sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_sql(spark, data, sql, name):
    ours = rows(catalogue.queries()[name](spark, data).toPandas())
    if name in catalogue.oracle_sql():
        assert ours == rows(sql.execute(catalogue.oracle_sql()[name]).fetchdf())
