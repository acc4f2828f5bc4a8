import math
import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import combine, diagnostics, ic
from panelforge.operators.backtest import Backtest
from panelforge.plans.report import ReportConfig, SignalReport
from panelforge.sources.panel import forward_returns
from tests.test_factors import START, panel_of, walk


@pytest.fixture(scope="module")
def panel(spark):
    return panel_of(spark, walk(120, 6)).persist()


def signal_of(spark, panel, make, name="s"):
    rows = [(name, r.date, r.rn, r.ticker, make(r)) for r in panel.collect()]
    return spark.createDataFrame(rows, "factor string, date date, rn int, ticker string, value double").persist()


@pytest.fixture(scope="module")
def noise(spark, panel):
    rng = random.Random(1)
    return signal_of(spark, panel, lambda r: rng.gauss(0, 1))


def as_signal(forward, sign=1.0):
    return forward.select(F.lit("s").alias("factor"), "date", "rn", "ticker", (F.col("fwd") * sign).alias("value"))


@pytest.mark.parametrize("sign", [1.0, -1.0])
def test_perfect_signal(panel, sign):
    fwd = forward_returns(panel, [1])
    rows = ic.compute_ic(as_signal(fwd, sign), fwd).collect()
    assert len(rows) == 120
    assert all(r.ic == pytest.approx(sign) for r in rows if r.n_valid) and rows[0].factor == "s"
    assert [r.rn for r in rows if r.ic is None] == [119]


def test_ranks_are_over_valid_pairs(spark):
    day = START
    sig = spark.createDataFrame([("s", day, 0, t, v) for t, v in zip("ABCD", (1.0, 2.0, 3.0, 4.0), strict=True)], "factor string, date date, rn int, ticker string, value double")
    fwd = spark.createDataFrame([(1, day, 0, t, v) for t, v in zip("ABCD", (0.1, 0.2, None, 0.3), strict=True)], "horizon int, date date, rn int, ticker string, fwd double")
    assert ic.compute_ic(sig, fwd, 3).first().ic == pytest.approx(1.0)
    assert ic.compute_ic(sig, fwd, 4).first().ic is None
    assert ic.compute_ic(sig.withColumn("value", F.lit(1.0)), fwd, 3).first().ic is None


def newey_west_by_hand(x, m):
    n, d = len(x), np.array(x) - np.mean(x)
    g = [sum(d[k:] * d[: n - k]) / n for k in range(m + 1)]
    v = g[0] + 2 * sum((1 - k / (m + 1)) * g[k] for k in range(1, m + 1))
    return math.sqrt(max(v, 0) / n)


def test_newey_west(noise, panel):
    table = ic.compute_ic(noise, forward_returns(panel, [1, 5])).persist()
    for bandwidth in (0, 4, None):
        for r in ic.newey_west(table, bandwidth).collect():
            x = [q.ic for q in table.where(f"horizon = {r.horizon} and ic is not null").orderBy("date").collect()]
            m = math.ceil(len(x) ** (1 / 3)) if bandwidth is None else bandwidth
            assert (r.n, r.bandwidth) == (len(x), m)
            assert r.se_nw == pytest.approx(newey_west_by_hand(x, m))
            assert r.t_naive == pytest.approx(np.mean(x) / (np.std(x, ddof=1) / len(x) ** 0.5))


def test_summary_and_decay(noise, panel):
    table = ic.compute_ic(noise, forward_returns(panel, [1])).persist()
    x = np.array([r.ic for r in table.where("ic is not null").collect()])
    s = ic.summary(table).first()
    assert (s.mean, s.std, s.n_dates) == (pytest.approx(x.mean()), pytest.approx(x.std(ddof=1)), len(x))
    assert s.hit_rate == pytest.approx((x > 0).mean()) and s.avg_coverage == pytest.approx(119 * 6 / 120)
    assert ic.decay(noise, panel, 3).where("horizon = 1").first().mean_ic == pytest.approx(x.mean())
    assert ic.non_overlapping_ic(noise, forward_returns(panel, [5]), 5).count() == 24
    assert ic.correlation_matrix(table).first()["corr"] == pytest.approx(1.0)


def test_bootstrap(noise, panel):
    table = ic.compute_ic(noise, forward_returns(panel, [1])).persist()
    a, b = (ic.block_bootstrap(table, replicates=300).first() for _ in range(2))
    assert a == b and a.ci_lower < a.ci_upper
    mean = table.agg(F.avg("ic")).first()[0]
    assert a.ci_lower < mean < a.ci_upper
    assert ic.block_bootstrap(table, replicates=300, confidence=0.5).first().ci_lower > a.ci_lower
    assert a != ic.block_bootstrap(table, replicates=300, seed=7).first()
    median = ic.block_bootstrap(table, replicates=100, statistic="median").first()
    assert median.ci_lower < median.ci_upper


def test_zscores_and_equal_weight(noise, panel):
    z = combine.zscored(noise).groupBy("date").agg(F.avg("z").alias("m"), F.stddev_samp("z").alias("s")).collect()
    assert all(abs(r.m) < 1e-12 and r.s == pytest.approx(1) for r in z)
    one = combine.EqualWeight().combine(noise).join(combine.zscored(noise).select("date", "ticker", "z"), ["date", "ticker"])
    assert one.where("abs(value - z) > 1e-12").count() == 0


def test_ic_weights(spark, panel):
    fwd = forward_returns(panel, [1])
    good, bad = as_signal(fwd).withColumn("factor", F.lit("good")), as_signal(fwd, -1.0).withColumn("factor", F.lit("bad"))
    signals = good.unionByName(bad)
    w = {(r.factor, r.rn): r.weight for r in combine.ICWeighted(lookback=20, shrinkage=0.0).weights(signals, panel).collect()}
    assert w["good", 19] is None and w["good", 20] == pytest.approx(0.5) and w["bad", 60] == pytest.approx(-0.5)
    even = combine.ICWeighted(lookback=20, shrinkage=1.0).combine(signals, panel).where("rn between 20 and 118")
    assert even.where("abs(value) > 1e-12").count() == 0
    ewm = {r.rn: r.weight for r in combine.ICWeighted(use_ewm=True, halflife=10, shrinkage=0.0).weights(signals, panel).where("factor = 'good'").collect()}
    assert ewm[0] is None and ewm[1] == pytest.approx(0.5)


def test_ewm_is_pandas_ewm(noise, panel):
    got = [r.weight for r in combine.ICWeighted(use_ewm=True, halflife=10, shrinkage=0.0).weights(noise, panel).orderBy("rn").collect()]
    x = pd.Series([r.ic for r in ic.compute_ic(noise, forward_returns(panel, [1])).orderBy("rn").collect()], dtype=float)
    want = x.ewm(halflife=10).mean().shift(1)
    # one factor: its weight is the sign of the mean
    assert [np.sign(v) for v in want[1:]] == got[1:] and got[0] is None


def test_lasso(panel, noise, spark):
    assert combine.RollingLasso(20, alpha=10.0).combine(noise, panel).where("rn >= 20 and value <> 0").count() == 0
    assert combine.RollingLasso(20).combine(noise, panel).where("rn < 20 and value is not null").count() == 0
    rng = random.Random(3)
    more = noise.unionByName(signal_of(spark, panel, lambda r: rng.gauss(0, 1), "t"))
    coefs = combine.RollingLasso(30, alpha=0.02).coefficients(more, panel, ["s", "t"]).where("rn = 60").first().coef
    wide = combine.RollingLasso._wide(more, ["s", "t"]).join(forward_returns(panel, [1]).select("date", "ticker", "fwd"), ["date", "ticker"]).where("rn between 30 and 59").toPandas()
    x, y = wide[["z0", "z1"]].to_numpy(), wide["fwd"].to_numpy()
    y = (y - y.mean()) / y.std()
    b = np.zeros(2)
    for _ in range(500):
        for i in range(2):
            rest = y - x @ b + x[:, i] * b[i]
            c = x[:, i] @ rest
            b[i] = np.sign(c) * max(abs(c) - len(y) * 0.02, 0) / (x[:, i] @ x[:, i])
    assert coefs == pytest.approx(list(b), abs=1e-9)


def by_hand(panel, signal, cost, freq, smooth):
    p = panel.toPandas().pivot(index="date", columns="ticker", values="close").sort_index()
    s = signal.toPandas().pivot(index="date", columns="ticker", values="value").sort_index()
    raw = s.sub(s.mean(axis=1), axis=0)
    pos = raw.div(raw.abs().sum(axis=1), axis=0).fillna(0)
    pos = pos.iloc[(np.arange(len(pos)) // freq) * freq].set_axis(pos.index)
    if smooth:
        for i in range(1, len(pos)):
            pos.iloc[i] = (1 - smooth) * pos.iloc[i] + smooth * pos.iloc[i - 1]
        pos = pos.div(pos.abs().sum(axis=1), axis=0).fillna(0)
    trade = pos.diff()
    trade.iloc[0] = pos.iloc[0]
    gross = (pos * (p.shift(-1) / p - 1)).sum(axis=1, min_count=1)
    return (gross - trade.abs().sum(axis=1) * cost / 1e4).dropna()


@pytest.mark.parametrize(("cost", "freq", "smooth"), [(0, 1, 0.0), (10, 1, 0.0), (10, 7, 0.0), (5, 3, 0.5)])
def test_backtest(panel, noise, cost, freq, smooth):
    want = by_hand(panel, noise, cost, freq, smooth)
    got = Backtest(cost, freq, smooth).run(panel, noise).orderBy("date").collect()
    assert [r.date for r in got] == list(want.index)
    assert [r.ret for r in got] == pytest.approx(list(want), abs=1e-12)


def test_positions_are_neutral_with_unit_gross(panel, noise):
    for how in (Backtest(), Backtest(rebalance=5), Backtest(smooth=0.7)):
        sums = how.positions(panel, noise).groupBy("date").agg(F.sum("position").alias("net"), F.sum(F.abs("position")).alias("gross")).collect()
        assert all(abs(r.net) < 1e-12 and r.gross == pytest.approx(1) for r in sums)


def test_flat_signal_and_partial_overlap(spark, panel, noise):
    flat = Backtest().run(panel, noise.withColumn("value", F.lit(3.0))).agg(F.max(F.abs("ret")), F.max("turnover")).first()
    assert tuple(flat) == (0, 0)
    late = noise.where("rn >= 50")
    assert Backtest(rebalance=9).run(panel, late).agg(F.min("date")).first()[0] == START + timedelta(50)


def test_diagnostics(spark, panel, noise):
    const = signal_of(spark, panel, lambda r: 1.0)
    assert diagnostics.autocorrelation(const, 2).where("autocorr is not null").count() == 0
    flip = signal_of(spark, panel, lambda r: (-1.0) ** r.rn)
    moved = {r.rn: r.turnover for r in diagnostics.turnover(flip).collect()}
    assert moved[0] == 0 and moved[5] == pytest.approx(2.0)
    assert all(v == pytest.approx(-1.0) for v in [r.autocorr for r in diagnostics.autocorrelation(flip, 1).collect()])
    a, b = (diagnostics.dispersion(s).where("rn = 3").first().dispersion for s in (noise, noise.withColumn("value", F.col("value") * 3)))
    assert b == pytest.approx(3 * a)
    back = {r.offset: r.mean_ic for r in diagnostics.lead_lag(panel.select(F.lit("s").alias("factor"), "date", "rn", "ticker", F.col("ret").alias("value")), panel, 2, 2).collect()}
    assert back[0] == pytest.approx(1.0) and abs(back[2]) < 0.5


def test_natural_frequency(spark):
    rows = [("a", 1, 0.1, 0.05), ("a", 5, 0.3, 0.05), ("a", 10, 0.9, 0.0), ("b", 1, -0.5, None), ("b", 5, 0.5, None), ("c", 1, None, None)]
    found = {r.factor: r.natural_freq for r in diagnostics.natural_frequency(spark.createDataFrame(rows, "factor string, lag int, point double, se double")).collect()}
    assert found == {"a": 5, "b": 1, "c": 1}


def test_spread(spark):
    day, names = date(2024, 1, 1), "ABCDEF"
    sig = spark.createDataFrame([("s", day, 0, t, float(i)) for i, t in enumerate(names)], "factor string, date date, rn int, ticker string, value double")
    fwd = spark.createDataFrame([(1, day, 0, t, i / 100) for i, t in enumerate(names)], "horizon int, date date, rn int, ticker string, fwd double")
    assert diagnostics.quantile_spread(sig, fwd, 2).first().spread == pytest.approx(0.04)
    assert diagnostics.quantile_spread(sig, fwd, 4).count() == 0


def test_report(panel, noise):
    report = SignalReport(noise, panel, ReportConfig(horizons=[1, 5], decay_lags=5, replicates=50))
    with pytest.raises(RuntimeError):
        report.results  # noqa: B018
    assert report.run() is report
    assert len(report.results) == 12 and 1 <= report.results["natural_freq"] <= 5
    assert "horizon 5" in report.text() and set(report.panels()) == {"autocorrelation", "decay", "lead_lag", "equity"}
    assert report.results["ic_by_horizon"].count() == 2 and report.results["ic_decay"].count() == 5
