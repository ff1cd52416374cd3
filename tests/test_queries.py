"""Every query with SQL gives the rows that DuckDB gives; the others give rows."""

import duckdb
import pandas as pd
import pytest

from skytile.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list:
    def value(v):
        if pd.isna(v):
            return ""
        if isinstance(v, (str, pd.Timestamp)):
            return str(v)
        return round(float(v), 6)

    return sorted((tuple(value(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        assert rows(got) == rows(con.execute(SQL[name]).df())
    else:
        assert len(got)
