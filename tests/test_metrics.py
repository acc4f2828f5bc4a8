import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from panelforge.functions.stats import average_rank, rounded, safe_corr
from panelforge.operators import metrics
from panelforge.plans import tearsheet

DAY = date(2024, 1, 2)


def frame(spark, returns, bench=None, key="k"):
    rows = [(key, DAY + timedelta(i), r, bench[i] if bench else None) for i, r in enumerate(returns)]
    return spark.createDataFrame(rows, "key string, date date, ret double, bench double")


def of(spark, returns, bench=None):
    return metrics.full_summary(frame(spark, returns, bench), ["key"]).first()


def test_by_hand(spark):
    r, b = [0.01, -0.02, 0.03, 0.0, -0.01, 0.02], [0.01, -0.01, 0.02, 0.01, -0.02, 0.01]
    m = of(spark, r, b)
    n, mean = len(r), sum(r) / len(r)
    sd = math.sqrt(sum((x - mean) ** 2 for x in r) / (n - 1))
    assert m.sharpe_ratio == pytest.approx(mean / sd * 252**0.5)
    assert m.sortino_ratio == pytest.approx(mean / math.sqrt((0.0004 + 0.0001) / 2) * 252**0.5)
    assert m.win_rate == pytest.approx(3 / 6) and m.profit_factor == pytest.approx(0.06 / 0.03)
    assert m.best_day == 0.03 and m.worst_day == -0.02
    bm = sum(b) / n
    cov = sum((x - mean) * (y - bm) for x, y in zip(r, b, strict=True)) / (n - 1)
    var = sum((y - bm) ** 2 for y in b) / (n - 1)
    assert m.beta == pytest.approx(cov / var) and m.alpha == pytest.approx((mean - cov / var * bm) * 252)
    assert m.up_capture == pytest.approx((0.01 + 0.03 + 0.0 + 0.02) / 4 / (0.05 / 4)) and m.down_capture == pytest.approx(-0.015 / -0.015)
    growth = 1.0
    for x in r:
        growth *= 1 + x
    assert m.annualized_return == pytest.approx(growth ** (252 / 6) - 1)
    assert m.value_at_risk_95 == pytest.approx(-0.0175) and m.cvar_95 == pytest.approx(-0.02)


def test_drawdown_starts_at_one(spark):
    assert of(spark, [-0.1, 0.05]).max_drawdown == pytest.approx(-0.1)
    assert of(spark, [0.1, 0.05]).max_drawdown == 0 and of(spark, [0.1, 0.05]).calmar_ratio == 0
    curve = tearsheet.equity(frame(spark, [-0.1, 0.05, -0.02]), ["key"]).orderBy("date").collect()
    assert [x.drawdown for x in curve] == pytest.approx([0, 0, -0.02])


@pytest.mark.parametrize(("returns", "sharpe", "sortino", "factor"), [([0.01] * 50, math.inf, math.inf, math.inf), ([-0.01] * 50, -math.inf, -0.01 / 0.01 * 252**0.5, 0), ([0.0] * 5, 0, 0, 0), ([0.1], 0, 0, math.inf), ([0.1] * 50, math.inf, math.inf, math.inf)])
def test_edges(spark, returns, sharpe, sortino, factor):
    m = of(spark, returns)
    assert m.sharpe_ratio == sharpe and m.profit_factor == factor
    assert m.sortino_ratio == pytest.approx(sortino)


def test_missing_and_short(spark):
    m = of(spark, [None, 0.02, None, -0.01], [0.01, 0.01, 0.01, None])
    assert m.win_rate == 0.25 and m.beta == 0 and m.skewness == 0 and m.excess_kurtosis == 0
    nothing = of(spark, [None, None])
    assert all(nothing[c] == 0 for c in [*metrics.PERFORMANCE, *metrics.BENCHMARK, *metrics.DISTRIBUTION])
    assert metrics.full_summary(frame(spark, []), ["key"]).count() == 0
    ruin = of(spark, [0.1, -1.5])
    assert ruin.annualized_return is None and ruin.calmar_ratio is None


def test_keys_and_columns(spark):
    both = frame(spark, [0.01, 0.02, -0.01]).unionByName(frame(spark, [0.03, -0.02], key=None))
    rows = {r.key: r for r in metrics.full_summary(both, ["key"]).collect()}
    assert set(rows) == {"k", None} and rows[None].best_day == 0.03
    assert metrics.summary(both, ["key"]).columns == ["key", *metrics.PERFORMANCE]
    assert "beta" not in metrics.full_summary(both.drop("bench"), ["key"]).columns
    assert metrics.total_return(both, ["key"]).where("key = 'k'").first().total_return == pytest.approx(1.01 * 1.02 * 0.99 - 1)


def test_sample_moments_are_those_of_pandas(spark):
    import pandas as pd

    r = [0.01, -0.02, 0.05, 0.0, -0.01, 0.02, 0.003]
    m = of(spark, r)
    assert m.skewness == pytest.approx(pd.Series(r).skew()) and m.excess_kurtosis == pytest.approx(pd.Series(r).kurt())
    assert of(spark, [0.01] * 6).skewness == 0


def test_months(spark):
    x = spark.createDataFrame([("k", date(2024, 1, 5), 0.1), ("k", date(2024, 1, 9), 0.1), ("k", date(2024, 4, 1), -0.5)], "key string, date date, ret double")
    m = {r.month: r.ret for r in tearsheet.monthly(x, ["key"]).collect()}
    assert m[date(2024, 1, 1)] == pytest.approx(0.21) and m[date(2024, 2, 1)] == 0 and len(m) == 4
    assert tearsheet.monthly_table(x, ["key"]).columns == ["key", "year", *map(str, range(1, 13))]


def test_benchmark_curve_is_carried_over(spark):
    x = frame(spark, [0.0] * 4, [None, 0.1, None, 0.1])
    assert [r.bench_equity for r in tearsheet.benchmark_equity(x, ["key"]).orderBy("date").collect()] == pytest.approx([1.1, 1.1, 1.1, 1.21])


def test_helpers(spark):
    x = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("a", 2.0, 4.0), ("a", None, 1.0)], "k string, x double, y double")
    assert [r.r for r in x.select("x", average_rank(F.col("x"), "k").alias("r")).orderBy(F.col("x").asc_nulls_first()).collect()] == [None, 1.5, 1.5, 3.0]
    assert x.agg(safe_corr(F.col("x"), F.lit(1.0)).alias("c")).first().c is None
    assert math.copysign(1, rounded(spark.createDataFrame([(-1e-9,)], "v double")).first().v) == 1


def test_whole_rank_is_the_rank(spark):
    import random

    from panelforge.functions.stats import whole_rank

    random.seed(8)
    rows = [(random.choice("ab"), float(random.choice([random.randint(0, 40), 7, random.random()]))) for _ in range(600)] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    want = df.select("k", "x", average_rank(F.col("x"), "k").alias("rank")).where("x is not null")
    for blocks in (4, 256):
        got = whole_rank(df, "x", "k", blocks=blocks)
        assert sorted(map(tuple, got.select("k", "x", "rank").collect())) == sorted(map(tuple, want.collect()))
    one = whole_rank(df, "x", blocks=8).collect()
    assert sorted(r["rank"] for r in one)[-1] <= 600 and len(one) == 600
