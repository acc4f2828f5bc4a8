import math
import random
from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import factors as fx
from panelforge.sources.panel import densify, forward_returns, with_returns

START = date(2023, 1, 2)


def walk(n=70, tickers=5, seed=42, gaps=False):
    rng, rows = random.Random(seed), []
    for k in range(tickers):
        p = 100.0
        for i in range(n):
            p *= math.exp(rng.gauss(0.0005, 0.02))
            if not (gaps and k == 1 and i in (30, 31)) and not (gaps and k == 2 and i < 10):
                rows.append((START + timedelta(i), f"T{k}", "AB"[k % 2] if k < 4 else "C", round(p, 6)))
    return rows


def panel_of(spark, rows):
    p = with_returns(densify(spark.createDataFrame(rows, "date date, ticker string, sector string, close double"), ["sector"]))
    market = p.groupBy("date").agg(F.avg("ret").alias("market_ret"))
    return p.join(market, "date")


SMALL = [
    fx.Momentum(20, 3), fx.CrossSectionalMomentum(20, 3), fx.RSI(5), fx.BollingerZScore(8), fx.ShortTermReversal(4), fx.LowVol(6), fx.ResidualMomentum(10, 20, 3),
    fx.SectorNeutralMomentum(20, 3), fx.QualityProxy(12), fx.RollingSharpe(12), fx.RollingCVaR(12, 0.1), fx.RollingMaxDrawdown(12), fx.RollingSkewness(12),
]


@pytest.fixture(scope="module")
def panel(spark):
    return panel_of(spark, walk(gaps=True)).persist()


def values(df):
    return {(r.factor, r.date, r.ticker): r.value for r in df.collect()}


def test_names_and_cells(panel):
    found = values(fx.compute(panel, SMALL))
    assert len(found) == len(SMALL) * panel.count()
    assert {f.name for f in SMALL} == {k[0] for k in found}


def test_first_values_come_after_the_lookback(panel):
    first = {r.factor: r.rn for r in fx.compute(panel, SMALL).where("value is not null and ticker = 'T0'").groupBy("factor").agg(F.min("rn").alias("rn")).collect()}
    assert {f.name: f.lookback for f in SMALL if not isinstance(f, fx.ResidualMomentum)} == {k: v for k, v in first.items() if not k.startswith("residual")}
    assert first["residual_momentum_10_20_3"] <= SMALL[6].lookback


def test_no_look_ahead(spark, panel):
    """A value doesn't change when later prices are taken away."""
    cut = START + timedelta(55)
    whole = values(fx.compute(panel, SMALL))
    part = values(fx.compute(panel.where(F.col("date") <= F.lit(cut)), SMALL))
    for key, v in part.items():
        assert v == whole[key] or abs(v - whole[key]) < 1e-12, key


def test_late_dates_need_only_their_lookback(panel):
    start = str(START + timedelta(60))
    late = values(fx.compute_from(panel, SMALL, start))
    whole = values(fx.compute(panel, SMALL))
    for key, v in late.items():
        assert (v is None) == (whole[key] is None) and (v is None or abs(v - whole[key]) < 1e-9), key


def test_against_pandas(panel):
    wide = panel.toPandas().pivot(index="date", columns="ticker", values="close").sort_index()
    r = wide.pct_change(fill_method=None)
    expected = {
        "momentum_20_3": wide.shift(3) / wide.shift(20) - 1,
        "bollinger_8": -(wide - wide.rolling(8).mean()) / wide.rolling(8).std(),
        "low_volatility_6": -r.rolling(6).std(),
        "rolling_skewness_12": -r.rolling(12).skew(),
        "rolling_sharpe_12": r.rolling(12).mean() / r.rolling(12).std(),
        "cross_sectional_momentum_20_3": (wide.shift(3) / wide.shift(20) - 1).rank(axis=1, pct=True),
        "quality_proxy_12": -(r.rolling(12).std() / r.abs().rolling(12).mean()),
        "rolling_cvar_12_10": r.rolling(12).apply(lambda x: x[x <= x.quantile(0.1)].mean(), raw=False),
    }
    found = values(fx.compute(panel, SMALL))
    for name, frame in expected.items():
        for day, row in frame.iterrows():
            for ticker, want in row.items():
                got = found[name, day, ticker]
                assert (got is None) == pd.isna(want), (name, day, ticker)
                assert got is None or got == pytest.approx(want, abs=1e-9), (name, day, ticker)


def test_orientation(spark):
    up = [(START + timedelta(i), t, "A", 100.0 + i * s) for i in range(40) for t, s in (("UP", 1), ("DN", -1), ("Z", 0.1))]
    found = values(fx.compute(panel_of(spark, up), [fx.Momentum(20, 3), fx.RSI(5), fx.ShortTermReversal(4)]))
    last = START + timedelta(39)
    assert found["momentum_20_3", last, "UP"] > 0 > found["momentum_20_3", last, "DN"]
    assert found["rsi_5", last, "UP"] == -50 and found["rsi_5", last, "DN"] == 50
    assert found["short_term_reversal_4", last, "UP"] < 0


def test_constant_prices(spark):
    flat = [(START + timedelta(i), t, "A", 50.0) for i in range(30) for t in "XY"]
    found = fx.compute(panel_of(spark, flat), [fx.RSI(5), fx.BollingerZScore(5), fx.QualityProxy(5), fx.RollingSharpe(5), fx.RollingSkewness(5), fx.RollingMaxDrawdown(5)])
    kinds = {r.factor: r.v for r in found.where("rn = 29 and ticker = 'X'").groupBy("factor").agg(F.max("value").alias("v")).collect()}
    assert kinds == {"rsi_5": None, "bollinger_5": None, "quality_proxy_5": None, "rolling_sharpe_5": None, "rolling_skewness_5": 0, "rolling_max_drawdown_5": 0}


def test_sector_neutral(panel):
    rows = fx.compute(panel, [SMALL[7]]).join(panel.select("date", "ticker", "sector"), ["date", "ticker"])
    sums = rows.groupBy("date", "sector").agg(F.sum("value").alias("s"), F.count("value").alias("n")).collect()
    assert all(abs(r.s) < 1e-12 for r in sums if r.n)
    # the sector of one ticker has no value
    assert all(r.n == 0 for r in sums if r.sector == "C")


def test_missing_columns_and_equal_names(panel):
    with pytest.raises(ValueError, match="market_ret"):
        fx.compute(panel.drop("market_ret"), [fx.ResidualMomentum()])
    with pytest.raises(ValueError, match="same name"):
        fx.compute(panel, [fx.LowVol(), fx.LowVol()])


def test_grid_is_dense_and_nan_is_null(spark):
    rows = [(START, "A", 1.0), (START + timedelta(1), "B", float("nan")), (START + timedelta(5), "A", 3.0)]
    dense = densify(spark.createDataFrame(rows, "date date, ticker string, close double"))
    assert dense.count() == 6 and dense.where("close is not null").count() == 2
    assert {(r.date, r.rn) for r in dense.collect()} == {(START, 0), (START + timedelta(1), 1), (START + timedelta(5), 2)}
    fwd = forward_returns(dense, [2]).where("fwd is not null").collect()
    assert [(r.ticker, r.fwd) for r in fwd] == [("A", 2.0)]
