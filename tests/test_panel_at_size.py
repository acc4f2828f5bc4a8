"""Bars out of lines at size: more tasks and not larger ones, aggregates without sorting, lines read once."""

from datetime import datetime

import pytest

from panelforge.sources import panel


@pytest.fixture
def star(spark, tmp_path):
    day = lambda d: datetime(2024, 1, d)
    make = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    make("region", [(0, "R")], "r_regionkey int, r_name string")
    make("nation", [(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int")
    make("customer", [(1, 0)], "c_custkey long, c_nationkey int")
    make("orders", [(k, 1) for k in (-5, 3, 2**40)], "o_orderkey long, o_custkey long")
    # a week's first line is of its first moment, then of the least order, then of the least line; no line counts before any
    lines = [(3, 2, day(8), 20.0), (3, 1, day(9), 30.0), (2**40, 1, day(8), 40.0), (-5, 9, day(8), 50.0), (-5, 2, day(8), 60.0), (3, -4, day(16), 70.0), (3, None, day(16), 80.0), (3, 1, None, 90.0)]
    make("lineitem", [(*x, 1.0) for x in lines], "l_orderkey long, l_linenumber int, l_shipdate timestamp_ntz, l_extendedprice double, l_quantity double")
    return str(tmp_path)


def test_first_lines(spark, star):
    got = {r.date and r.date.day: (r.open, r.high, r.low, r.close, r.volume) for r in panel.trade_bars(spark, star).collect()}
    assert got == {8: (60.0, 60.0, 20.0, 40.0, 5), 15: (80.0, 80.0, 70.0, 75.0, 2), None: (90.0, 90.0, 90.0, 90.0, 1)}
    assert dict(panel.trade_bars(spark, star).dtypes)["turnover_value"] == "decimal(28,2)"


def test_tasks_and_plans(spark, star, capsys, monkeypatch):
    assert panel.tasks_for(spark.range(1_000), 10) == 100 and panel.tasks_for(spark.range(0)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(panel.tasks_for, "__defaults__", (1,))
    panel.trade_bars(spark, star).explain()
    plan = capsys.readouterr().out
    assert "SortAggregate" not in plan and "hashpartitioning(l_orderkey" in plan and ", 8)" in plan
    panel.price_panel(spark, star).explain()
    assert "InMemoryTableScan" in capsys.readouterr().out
