import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract
from gradeflow.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda x: "null" if pd.isna(x) else f"{x:.6f}" if isinstance(x, float) and df[c].dtype.kind == "f" else str(x))
    return sorted(map(tuple, df.itertuples(index=False)))


def test_contract(spark):
    assert contract.entry(spark).columns == ["item_id", "doc_id", "score", "rk"]
    assert set(contract.oracle_sql()) <= set(contract.queries()) and set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, oracle, name):
    got, want = contract.queries()[name](spark, SF).toPandas(), oracle.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
