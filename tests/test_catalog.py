"""Every registered signal query against its DuckDB oracle, and the driver's contract."""

import math

import duckdb
import pytest

import __spark_entry__
from panelforge import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v) if isinstance(v, float) else str(v)
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_against_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    want = duck.sql(catalog.oracles()[name])
    rows, columns = want.fetchall(), list(want.columns)
    assert sorted(df.columns) == sorted(columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(rows, columns)


def test_contract(spark):
    names = __spark_entry__.queries()
    assert set(catalog.queries()) <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)
    assert set(catalog.queries()) - set(catalog.oracles()) == set()
    assert __spark_entry__.entry(spark).count() > 0


def test_rows_only_queries_have_rows(spark):
    assert catalog.queries()["lasso_k3"](spark, SF).where("value is not null").count() > 0
    assert catalog.queries()["lasso_alpha_sweep"](spark, SF).count() == 3
    assert catalog.queries()["weight_variants"](spark, SF).count() == 3
