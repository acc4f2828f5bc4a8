"""The operators' queries against their DuckDB oracles, where SQL can express them."""

import duckdb
import pytest

from panelforge.llm import queries
from tests.test_catalog import canonical

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_against_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    want = con.sql(queries.oracles()[name])
    rows, columns = want.fetchall(), list(want.columns)
    assert sorted(df.columns) == sorted(columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(rows, columns)


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_leaks_with_slots_against_oracle(spark, tmp_path):
    """The tables' benchmark has no slots; these rows have."""
    question = "Maria has 12 apples and gives 5 kg of them to Peter, then Maria buys 12 more apples; how many apples does Maria have"
    swapped = question.replace("Maria", "Jonas").replace("12", "31").replace("Peter", "Anna")
    texts = [question, f"Before it, {swapped} and after.", question.replace("buys 12", "buys 13"), "two words", "12 13 14 15 16", None, f"{question} {question}", "He said: 5 % of 7 items cost 3 dollars each day in May"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(0, question), (1, "two words"), (2, "1 2 3 4 5"), (3, "He said: 9 % of 2 items cost 8 dollars each day in June")], "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("benchmark", items.toPandas())
    want = con.sql(queries.oracles()["op9_decontamination"])
    df = queries.decontam.leaks(docs, items)
    rows, columns = want.fetchall(), list(want.columns)
    assert len(rows) >= 5
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(rows, columns)
