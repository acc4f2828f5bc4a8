"""Ranks of whole tables, rolling tails, leaving one out and nearest dates, against plain versions."""

import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from panelforge.functions.stats import nearest_dates, whole_rank
from panelforge.operators import factors as fx
from panelforge.plans.research import leave_one_out, without_each


@pytest.mark.parametrize("blocks", [1, 5, 64, 4096])
def test_ranks_with_a_value_that_most_rows_share(spark, blocks):
    rnd = random.Random(blocks)
    rows = [("g", 0.5)] * 400 + [("g", rnd.choice([0.5, -1.0, 2.0])) for _ in range(50)] + [("g", rnd.gauss(0, 1)) for _ in range(300)] + [("h", float(k % 7)) for k in range(60)] + [("h", None), ("one", 3.0)]
    df = spark.createDataFrame([(k, g, x) for k, (g, x) in enumerate(rows)], "id int, g string, x double")
    got = {r.id: r.rank for r in whole_rank(df, "x", "g", blocks=blocks).collect()}
    want = pd.DataFrame(rows, columns=["g", "x"]).groupby("g")["x"].rank()
    assert got == {k: r for k, r in want.items() if r == r}


def test_ranks_without_keys(spark):
    df = spark.createDataFrame([(float(k % 10),) for k in range(100)], "x double")
    assert sorted({r.rank for r in whole_rank(df, "x", blocks=16).collect()}) == [10 * k + 5.5 for k in range(10)]
    assert whole_rank(df.limit(0), "x").count() == 0


def test_rank_tree():
    rnd, order = random.Random(1), np.array([-2.0, -1.0, 0.0, 3.0, 4.0, 9.0, 11.0])
    tree, held = fx.RankTree(order), []
    for _ in range(600):
        if held and rnd.random() < 0.45:
            place = held.pop(rnd.randrange(len(held)))
            tree.add(place, -1)
        else:
            place = rnd.randrange(len(order))
            held.append(place)
            tree.add(place, 1)
        values = sorted(order[p] for p in held)
        assert [tree.select(k) for k in range(len(values))] == values
        for place in range(len(order) + 1):
            below = [order[p] for p in held if p < place]
            assert tree.below(place) == (len(below), pytest.approx(sum(below)))


@pytest.mark.parametrize(("window", "confidence"), [(1, 0.05), (5, 0.05), (7, 0.3), (20, 0.5), (12, 1.0)])
def test_rolling_cvar(spark, window, confidence):
    rng = np.random.default_rng(window)
    series = {"a": rng.normal(size=60), "ties": rng.integers(0, 3, 60).astype(float), "gaps": np.where(np.arange(60) % 19 == 0, np.nan, rng.normal(size=60)), "short": rng.normal(size=2), "none": np.full(5, np.nan)}
    rows = [(date(2020, 1, 1) + timedelta(days=k), k, t, None if np.isnan(r) else float(r)) for t, rs in series.items() for k, r in enumerate(rs)]
    rng.shuffle(rows)
    panel = spark.createDataFrame([tuple(r) for r in rows], "date date, rn int, ticker string, ret double")
    got = {(r.ticker, r.rn): r.value for r in fx.compute(panel, [fx.RollingCVaR(window, confidence), fx.LowVol(3)]).where(f"factor like 'rolling_cvar%'").collect()}
    for t, rs in series.items():
        want = pd.Series(rs).rolling(window, min_periods=window).apply(lambda w: w[w <= np.quantile(w, confidence)].mean(), raw=True)
        for k, v in want.items():
            assert got[t, k] == (None if np.isnan(v) else pytest.approx(v)), (t, k)


@pytest.mark.parametrize("seed", range(8))
def test_without_each(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 300))
    x, y = (rng.integers(0, 6, n).astype(float) if seed % 2 else rng.normal(size=n) for _ in range(2))
    whole, each = without_each(x, y)
    spearman = lambda a, b: pd.Series(a).rank().corr(pd.Series(b).rank()) if len(set(a)) > 1 and len(set(b)) > 1 else np.nan
    assert whole == pytest.approx(spearman(x, y), nan_ok=True)
    for j in range(0, n, 17):
        keep = np.arange(n) != j
        assert each[j] == pytest.approx(spearman(x[keep], y[keep]), nan_ok=True)


def test_leave_one_out_with_gaps(spark):
    rng = np.random.default_rng(3)
    dates, names = [date(2024, 1, 1) + timedelta(days=k) for k in range(12)], "ABCDEFG"
    closes = {(k, t): None if (k, t) in ((3, "B"), (5, "C")) else float(np.exp(rng.normal())) for k in range(12) for t in names}
    values = {(k, t): None if t == "A" and k % 3 == 0 or k == 7 and t in "ABC" else float(rng.normal()) for k in range(12) for t in names}
    panel = spark.createDataFrame([(dates[k], k, t, c) for (k, t), c in closes.items()], "date date, rn int, ticker string, close double")
    signal = spark.createDataFrame([("f", dates[k], k, t, v) for (k, t), v in values.items() if t != "G"], "factor string, date date, rn int, ticker string, value double")
    got = {r.left_out: r.mean_ic for r in leave_one_out(signal, panel).collect()}
    for out in names:
        coefficients = []
        for k in range(11):
            pairs = [(values[k, t], closes[k + 1, t] / closes[k, t]) for t in names if t not in ("G", out) and values[k, t] is not None and closes[k, t] and closes[k + 1, t]]
            if len(pairs) >= 5:
                coefficients.append(pd.Series([p[0] for p in pairs]).rank().corr(pd.Series([p[1] for p in pairs]).rank()))
        assert got[out] == pytest.approx(np.mean(coefficients))


@pytest.mark.parametrize("days", [1, 10, 366])
def test_nearest_dates(spark, days):
    rnd, origin = random.Random(days), date(1999, 1, 1)
    have = sorted({origin + timedelta(days=rnd.randrange(1500)) for _ in range(60)})
    asked = sorted({origin + timedelta(days=rnd.randrange(-400, 2000)) for _ in range(200)} | set(have[:3]))
    dates, probes = spark.createDataFrame([(d,) for d in have * 2], "date date"), spark.createDataFrame([(p,) for p in asked] + [(None,)], "probe date")
    got = {r.probe: r.date for r in nearest_dates(dates, probes, days).collect()}
    assert got == {p: min(have, key=lambda d: (abs((d - p).days), d)) for p in asked}
    assert nearest_dates(dates.limit(0), probes, days).count() == 0 and nearest_dates(dates, probes.limit(0), days).count() == 0
