"""Exponential weights over long series, grids in one pass, bootstraps of any statistic, and settings that stay as submitted."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge import session
from panelforge.operators import combine, ic
from panelforge.operators.backtest import Backtest, sweep


@pytest.mark.parametrize(("halflife", "gap"), [(2, 0), (2, 2500), (0.5, 700), (126, 10)])
def test_ewm_against_pandas(spark, halflife, gap):
    """More than 1024 half-lives, with runs of nulls longer than that."""
    r = random.Random(4)
    values = [r.gauss(0, 1) if r.random() > 0.1 else None for _ in range(2600)]
    values[1000 : 1000 + gap] = [None] * len(values[1000 : 1000 + gap])
    rows = [("a", k, v) for k, v in enumerate(values)] + [("b", k, None) for k in range(3)]
    found = combine.ewm_mean(spark.createDataFrame(rows, "factor string, rn int, ic double"), "ic", halflife).orderBy("factor", "rn").collect()
    got = pd.Series([x.ewm for x in found if x.factor == "a"], dtype=float)
    want = pd.Series(values, dtype=float).ewm(halflife=halflife).mean()
    assert np.allclose(got, want, rtol=1e-9, atol=1e-12, equal_nan=True) and got[1:].notna().all()
    assert [x.ewm for x in found if x.factor == "b"] == [None] * 3


@pytest.fixture(scope="module")
def series(spark):
    r = random.Random(9)
    rows = [("f", 1, k, f"2020-01-{1 + k % 28}", r.gauss(0.1, 1)) for k in range(90)]
    return spark.createDataFrame(rows, "factor string, horizon int, rn int, date string, ic double").withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("rn")))


def replay(values, block, replicates, seed, how):
    """The generator and the laying out of blocks, step by step."""
    n, out = len(values), []
    for rep in range(replicates):
        laid, blk = [], 0
        while len(laid) < n:
            state = (seed + rep * 7919 + blk * 104729) % ic.LCG_M
            for _ in range(3):
                state = (state * ic.LCG_A + ic.LCG_C) % ic.LCG_M
            start = state * n // ic.LCG_M
            laid += values[start : min(start + block, n)][: n - len(laid)]
            blk += 1
        out.append(how(np.array(laid)))
    return np.array(out)


@pytest.mark.parametrize(
    ("statistic", "how"),
    [
        ("mean", np.mean),
        ("median", np.median),
        ("std", lambda v: v.std(ddof=1)),
        ("sharpe", lambda v: v.mean() / v.std(ddof=1) * 252**0.5),
        (F.array_max, np.max),
    ],
)
def test_bootstrap_of_any_statistic(series, statistic, how):
    values = [r.ic for r in series.orderBy("rn").collect()]
    found = ic.block_bootstrap(series, 7, replicates=60, statistic=statistic).first()
    want = replay(values, 7, 60, 42, how)
    assert found.ci_lower == pytest.approx(np.quantile(want, 0.025)) and found.ci_upper == pytest.approx(np.quantile(want, 0.975))
    assert found.se_bootstrap == pytest.approx(want.std(ddof=1))


def test_grid_is_its_runs(spark):
    r = random.Random(8)
    cells = [(k, f"t{t}", r.uniform(50, 150) if r.random() > 0.03 else None, r.gauss(0, 1) if r.random() > 0.05 else None) for k in range(150) for t in range(5)]
    table = spark.createDataFrame(cells, "rn int, ticker string, close double, value double").withColumn("date", F.date_add(F.lit("2021-01-01").cast("date"), F.col("rn"))).persist()
    panel, signal = table.select("date", "rn", "ticker", "close"), table.select(F.lit("s").alias("factor"), "date", "rn", "ticker", "value")
    grid = {(x.rebalance, x.smooth, x.date): (x.ret, x.turnover) for x in sweep(panel, signal, [1, 4], [0.0, 0.3, 0.9]).collect()}
    for f in (1, 4):
        for s in (0.0, 0.3, 0.9):
            own = {x.date: (x.ret, x.turnover) for x in Backtest(10.0, f, s).run(panel, signal).collect()}
            assert own.keys() == {d for a, b, d in grid if (a, b) == (f, s)}
            assert all(v == pytest.approx(grid[f, s, d], abs=1e-12) for d, v in own.items())


def test_what_was_submitted_stands():
    defaults = {"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "true"}
    assert session.unset(defaults, {}) == defaults
    assert session.unset(defaults, {"spark.master": "yarn"}) == {"spark.sql.adaptive.enabled": "true"}
    assert session.unset(defaults, {"spark.sql.adaptive.enabled": "false"}) == {}
