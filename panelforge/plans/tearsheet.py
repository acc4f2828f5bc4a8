"""The data of a tear sheet: banner, equity curves, drawdown, months."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators import metrics


def equity(returns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, date, equity, drawdown; the drawdown is from the curve's own peak."""
    return metrics.drawdowns(returns, keys, from_one=False).select(*keys, "date", "equity", "drawdown")


def benchmark_equity(returns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, date, bench_equity on the strategy's dates, carried over gaps, back to the first date too."""
    w = Window.partitionBy(*keys).orderBy("date")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = returns.withColumn("_e", F.when(F.col("bench").isNotNull(), F.product(1 + F.col("bench")).over(run)))
    back = w.rowsBetween(0, Window.unboundedFollowing)
    x = x.withColumn("bench_equity", F.coalesce(F.last("_e", ignorenulls=True).over(run), F.first("_e", ignorenulls=True).over(back)))
    return x.select(*keys, "date", "bench_equity")


def monthly(returns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, month (its first day), ret: compounded; months without a row inside the range have 0."""
    m = returns.groupBy(*keys, F.trunc("date", "month").alias("month")).agg((F.coalesce(F.product(1 + F.col("ret")), F.lit(1.0)) - 1).alias("_r"))
    span = m.groupBy(*keys).agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month"))).alias("month"))
    return span.join(m, [*keys, "month"], "left").select(*keys, "month", F.coalesce("_r", F.lit(0.0)).alias("ret"))


def monthly_table(returns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, year and one column a month, all twelve there."""
    m = monthly(returns, keys).select(*keys, F.year("month").alias("year"), F.month("month").alias("m"), "ret")
    return m.groupBy(*keys, "year").pivot("m", list(range(1, 13))).agg(F.avg("ret"))


def banner(returns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, first and last date, and every metric."""
    span = returns.groupBy(*keys).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return span.join(metrics.full_summary(returns, keys), keys)
