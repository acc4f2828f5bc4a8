"""Twenty-two performance, benchmark-relative and distribution metrics as one aggregation by key.

Input: the key columns, date, ret and, for the benchmark metrics, bench. Null
returns are missing; they still count toward the length where a metric is per
period. Every edge (no rows, one row, no losses, a flat series) has the value
that its line below says; a fall of more than everything has no annual rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.stats import NOISE, ratio, sample_kurtosis, sample_skewness

PERIODS = 252
INF = float("inf")
PERFORMANCE = ["sharpe_ratio", "sortino_ratio", "max_drawdown", "calmar_ratio", "annualized_return", "annualized_volatility", "win_rate", "profit_factor"]
BENCHMARK = ["beta", "alpha", "tracking_error", "information_ratio", "up_capture", "down_capture"]
DISTRIBUTION = ["skewness", "excess_kurtosis", "value_at_risk_95", "cvar_95", "tail_ratio", "expected_tail_ratio", "best_day", "worst_day"]


def _or_zero(enough: Column, value: Column) -> Column:
    return F.when(enough, F.coalesce(value, F.lit(0.0))).otherwise(0.0)


def _flat(sd: Column, mean: Column) -> Column:
    return F.coalesce(sd, F.lit(0.0)) <= NOISE * F.greatest(F.lit(1.0), F.abs(mean))


def drawdowns(returns: DataFrame, keys: list[str], from_one: bool = True) -> DataFrame:
    """The rows that have a return, with equity and drawdown; the first peak is 1 or, for a curve to draw, the first equity."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    x = returns.where(F.col("ret").isNotNull()).withColumn("equity", F.product(1 + F.col("ret")).over(w))
    peak = F.max("equity").over(w)
    return x.withColumn("drawdown", ratio(F.col("equity"), F.greatest(F.lit(1.0), peak) if from_one else peak) - 1)


def full_summary(returns: DataFrame, keys: list[str], periods: int = PERIODS, rf: float = 0.0, tail: float = 0.05) -> DataFrame:
    """All metrics by key; those against the benchmark are null without a ``bench`` column."""
    with_bench = "bench" in returns.columns
    x = returns if with_bench else returns.withColumn("bench", F.lit(None).cast("double"))
    r, b = F.col("ret"), F.col("bench")
    daily_rf = (1 + rf) ** (1 / periods) - 1
    excess = r - daily_rf
    both = r.isNotNull() & b.isNotNull()
    p, q = F.when(both, r), F.when(both, b)
    n, size = F.count(r), F.count(F.lit(1))
    pairs = F.count(p)
    # quantiles and falls are columns of the series itself, so that it is read once, however it was made
    series_of = Window.partitionBy(*keys)
    so_far = series_of.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    j = x.withColumns({"_var": F.percentile(r, 1 - 0.95).over(series_of), "_low": F.percentile(r, tail).over(series_of), "_high": F.percentile(r, 1 - tail).over(series_of), "_equity": F.product(1 + r).over(so_far)})
    j = j.withColumn("_fall", ratio(F.col("_equity"), F.greatest(F.lit(1.0), F.max("_equity").over(so_far))) - 1)
    mean, sd = F.avg(excess), F.stddev_samp(excess)
    downside = F.sqrt(F.avg(F.when(excess < 0, excess * excess)))
    years = size.cast("double") / periods
    growth = F.product(1 + r)
    gains, losses = F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)), F.coalesce(-F.sum(F.when(r < 0, r)), F.lit(0.0))
    beta = F.coalesce(ratio(F.covar_samp(p, q), F.nullif(F.var_samp(q), F.lit(0.0))), F.lit(0.0))
    te = F.stddev_samp(p - q) * periods**0.5
    up, down = F.avg(F.when(q > 0, p)), F.avg(F.when(q < 0, p))
    up_b, down_b = F.avg(F.when(q > 0, q)), F.avg(F.when(q < 0, q))
    low, high = F.max("_low"), F.max("_high")
    right, left = F.avg(F.when(r >= F.col("_high"), r)), F.avg(F.when(r <= F.col("_low"), r))
    cagr = F.when(n > 0, F.when(growth > 0, F.pow(growth, 1 / years) - 1).when(growth == 0, -1.0)).otherwise(0.0)
    at_least = lambda k: n >= k
    cols = {
        "sharpe_ratio": F.when(~at_least(2), 0.0).when(_flat(sd, mean), F.when(mean > 0, INF).when(mean < 0, -INF).otherwise(0.0)).otherwise(ratio(mean, F.nullif(sd, F.lit(0.0))) * periods**0.5),
        "sortino_ratio": F.when(~at_least(2), 0.0).when(F.coalesce(downside, F.lit(0.0)) == 0, F.when(mean > 0, INF).otherwise(0.0)).otherwise(ratio(mean, F.nullif(downside, F.lit(0.0))) * periods**0.5),
        "annualized_return": cagr,
        "annualized_volatility": _or_zero(at_least(2), F.stddev_samp(r) * periods**0.5),
        "win_rate": F.coalesce(F.sum((r > 0).cast("double")), F.lit(0.0)) / size,
        "profit_factor": F.when(losses == 0, F.when(gains > 0, INF).otherwise(0.0)).otherwise(ratio(gains, F.nullif(losses, F.lit(0.0)))),
        "skewness": _or_zero(at_least(3), sample_skewness(r)),
        "excess_kurtosis": _or_zero(at_least(4), sample_kurtosis(r)),
        "value_at_risk_95": _or_zero(at_least(2), F.max("_var")),
        "cvar_95": _or_zero(at_least(2), F.avg(F.when(r <= F.col("_var"), r))),
        "tail_ratio": _or_zero(at_least(2), F.abs(ratio(high, F.nullif(low, F.lit(0.0))))),
        "expected_tail_ratio": _or_zero(at_least(2), F.abs(ratio(right, F.nullif(left, F.lit(0.0))))),
        "best_day": F.coalesce(F.max(r), F.lit(0.0)),
        "worst_day": F.coalesce(F.min(r), F.lit(0.0)),
    }
    if with_bench:
        cols |= {
            "beta": _or_zero(pairs >= 2, beta),
            "alpha": _or_zero(pairs >= 2, (F.avg(p) - daily_rf - beta * (F.avg(q) - daily_rf)) * periods),
            "tracking_error": _or_zero(pairs >= 2, te),
            "information_ratio": _or_zero(pairs >= 2, ratio(F.avg(p - q) * periods, F.nullif(te, F.lit(0.0)))),
            "up_capture": _or_zero(pairs >= 2, ratio(up, F.nullif(up_b, F.lit(0.0)))),
            "down_capture": _or_zero(pairs >= 2, ratio(down, F.nullif(down_b, F.lit(0.0)))),
        }
    out = j.groupBy(*keys).agg(*[c.cast("double").alias(k) for k, c in cols.items()], F.least(F.min("_fall"), F.lit(0.0)).alias("max_drawdown"))
    out = out.withColumn("max_drawdown", F.coalesce("max_drawdown", F.lit(0.0))).withColumn("calmar_ratio", F.when(F.col("max_drawdown") == 0, 0.0).otherwise(ratio(F.col("annualized_return"), F.abs("max_drawdown"))))
    return out.select(*keys, *PERFORMANCE, *(BENCHMARK if with_bench else []), *DISTRIBUTION)


def summary(returns: DataFrame, keys: list[str], periods: int = PERIODS, rf: float = 0.0) -> DataFrame:
    """The eight performance metrics."""
    return full_summary(returns.drop("bench"), keys, periods, rf).select(*keys, *PERFORMANCE)


def total_return(returns: DataFrame, keys: list[str]) -> DataFrame:
    return returns.groupBy(*keys).agg((F.product(1 + F.col("ret")) - 1).alias("total_return"))
