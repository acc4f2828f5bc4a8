"""The lasso path, the rolling drawdown by blocks and the bootstrap of any function, against plain versions."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from panelforge.operators import combine, ic
from panelforge.operators import factors as fx


def descent(gram, corr, alpha, rounds=4000):
    b = np.zeros(len(corr))
    for _ in range(rounds):
        change = 0.0
        for i in range(len(b)):
            if gram[i, i] > 1e-12:
                r = corr[i] - gram[i] @ b + gram[i, i] * b[i]
                new = np.sign(r) * max(abs(r) - alpha, 0) / gram[i, i]
                change, b[i] = max(change, abs(new - b[i])), new
        if change < 1e-14:
            break
    return b


@pytest.mark.parametrize("seed", range(60))
def test_path_minimises_for_every_penalty(seed):
    """Few rows and many, columns that are alike, opposite, zero, or correlated."""
    rng, alphas = np.random.default_rng(seed), [1.0, 0.001, 0.05, 0.2, 0.01, 0.0001]
    k, n = rng.integers(1, 8), rng.integers(2, 40)
    x = rng.normal(size=(n, k)) + (rng.normal(size=(n, 1)) * 2 if seed % 3 == 0 else 0)
    if seed % 5 == 0 and k > 1:
        x[:, 1] = x[:, 0] * (1 if seed % 2 else -2)
    if seed % 7 == 0:
        x[:, 0] = 0
    y = rng.normal(size=n)
    gram, corr = x.T @ x / n, x.T @ y / n
    cost = lambda b, a: b @ gram @ b / 2 - corr @ b + a * np.abs(b).sum()
    for a, b in zip(alphas, combine.lasso_path(gram, corr, alphas), strict=True):
        assert cost(b, a) <= cost(descent(gram, corr, a), a) + 1e-9


def test_path_of_one_and_of_nothing():
    assert combine.lasso_path(np.array([[2.0]]), np.array([1.0]), [0.5, 2.0])[0].tolist() == [0.25]
    assert combine.lasso_path(np.array([[2.0]]), np.array([-1.0]), [1.0])[0].tolist() == [0.0]
    assert combine.lasso_path(np.zeros((0, 0)), np.zeros(0), [0.1])[0].tolist() == []


def panel_of(spark, returns):
    """ticker -> returns, as a panel."""
    rows = [(date(2020, 1, 1) + timedelta(days=k), k, t, r) for t, rs in returns.items() for k, r in enumerate(rs)]
    return spark.createDataFrame(rows, "date date, rn int, ticker string, ret double")


def worst_fall(window):
    if any(r is None for r in window):
        return None
    level, peak, worst = 1.0, 0.0, 0.0
    for r in window:
        level *= 1 + r
        peak = max(peak, level)
        worst = min(worst, level / peak - 1) if peak else worst
    return worst


@pytest.mark.parametrize("window", [1, 2, 5, 7, 40])
def test_rolling_drawdown(spark, window):
    rng = np.random.default_rng(window)
    returns = {t: [float(r) for r in rng.normal(0, 0.1, 60)] for t in "AB"}
    returns["gaps"] = [None if k % 17 == 0 else r for k, r in enumerate(returns["A"])]
    returns["ruin"] = [-1.0 if k in (9, 31) else r for k, r in enumerate(returns["B"])]
    returns["flat"], returns["short"] = [0.0] * 60, [0.1, -0.2]
    got = {(r.ticker, r.rn): r.value for r in fx.compute(panel_of(spark, returns), [fx.RollingMaxDrawdown(window)]).collect()}
    for t, rs in returns.items():
        for k in range(len(rs)):
            want = worst_fall(rs[k - window + 1 : k + 1]) if k >= window - 1 else None
            assert got[t, k] == (None if want is None else pytest.approx(want, abs=1e-12)), (t, k)


def replayed(values, block, replicates, seed, function):
    """The draws of the linear congruential generator, one by one."""
    n, out = len(values), []
    for rep in range(replicates):
        laid, k = [], 0
        while len(laid) < n:
            state = (seed + rep * 7919 + k * 104729) % ic.LCG_M
            for _ in range(3):
                state = (state * ic.LCG_A + ic.LCG_C) % ic.LCG_M
            start = state * n // ic.LCG_M
            laid += values[start : start + block]
            k += 1
        out.append(function(np.array(laid[:n])))
    return out


def sharpe(x):
    return x.mean() / x.std(ddof=1) * np.sqrt(252)


@pytest.mark.parametrize("function", [sharpe, np.median, lambda x: np.percentile(x, 10)])
def test_bootstrap_of_any_function(spark, function):
    rng = np.random.default_rng(5)
    series = {"x": rng.normal(0.02, 0.1, 40).tolist(), "y": rng.normal(size=23).tolist()}
    rows = [(f, 5, date(2024, 1, 1) + timedelta(days=k), k, v) for f, vs in series.items() for k, v in enumerate(vs)] + [("x", 5, date(2023, 1, 1), -1, None), ("one", 5, date(2023, 1, 1), 0, 0.5)]
    table = spark.createDataFrame(rows, "factor string, horizon int, date date, rn int, ic double")
    got = {r.factor: r for r in ic.bootstrap_of(table, function, 4, replicates=150, seed=9).collect()}
    for f, vs in series.items():
        draws = pd.Series(replayed(vs, 4, 150, 9, function))
        assert got[f].point_estimate == pytest.approx(function(np.array(vs)))
        assert (got[f].ci_lower, got[f].ci_upper, got[f].se_bootstrap) == pytest.approx((draws.quantile(0.025), draws.quantile(0.975), draws.std()))
    assert tuple(got["one"])[2:] == (None,) * 4  # too short
    assert all(tuple(r)[2:] == (None,) * 4 for r in ic.bootstrap_of(table, function, 4, replicates=0).collect())


def test_bootstrap_of_the_mean_is_the_same_draws(spark):
    rows = [("x", 1, date(2024, 1, 1) + timedelta(days=k), k, float((k * 37) % 11)) for k in range(31)]
    table = spark.createDataFrame(rows, "factor string, horizon int, date date, rn int, ic double")
    a, b = ic.block_bootstrap(table, replicates=100).first(), ic.bootstrap_of(table, np.mean, replicates=100).first()
    assert tuple(a)[2:] == pytest.approx(tuple(b)[3:]) and b.point_estimate == pytest.approx(np.mean([r[4] for r in rows]))


def test_penalties_at_once_are_those_one_by_one(spark):
    rng = np.random.default_rng(1)
    dates = [date(2024, 1, 1) + timedelta(days=k) for k in range(30)]
    cells = [(d, k, t) for k, d in enumerate(dates) for t in "ABCDEFG"]
    panel = spark.createDataFrame([(d, k, t, float(100 * np.exp(rng.normal(0, 0.05)))) for d, k, t in cells], "date date, rn int, ticker string, close double")
    signals = spark.createDataFrame([(f, d, k, t, float(rng.normal())) for f in ("a", "b") for d, k, t in cells], "factor string, date date, rn int, ticker string, value double")
    value = lambda df: {(r.factor, r.rn, r.ticker): r.value for r in df.collect()}
    swept = value(combine.RollingLasso(10).sweep(signals, panel, [0.001, 0.05]))
    assert len(swept) == 2 * len(cells)
    for a in (0.001, 0.05):
        for key, v in value(combine.RollingLasso(10, a, name=f"lasso_{a:g}").combine(signals, panel)).items():
            assert swept[key] == (None if v is None else pytest.approx(v))
