"""What a signal looks like before any return is known: persistence, turnover, dispersion, lead and lag."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.stats import average_rank, ratio, safe_corr, series, whole_rank


def autocorrelation(signal: DataFrame, max_lag: int = 20) -> DataFrame:
    """factor, lag, autocorr: each ticker's correlation with itself, averaged over tickers that have one."""
    w = series("factor", "ticker")
    each = F.array(*[F.struct(F.lit(k).alias("lag"), F.lag("value", k).over(w).alias("before")) for k in range(1, max_lag + 1)])
    lagged = signal.select("factor", "ticker", "value", each.alias("x")).select("factor", "ticker", "value", F.inline("x"))
    own = lagged.groupBy("factor", "lag", "ticker").agg(safe_corr(F.col("value"), F.col("before")).alias("c"))
    return own.groupBy("factor", "lag").agg(F.avg("c").alias("autocorr"))


def turnover(signal: DataFrame, normalize: bool = True) -> DataFrame:
    """factor, date, rn, turnover: summed absolute changes, over summed absolute values if asked; the first date has 0."""
    x = signal.withColumn("d", F.abs(F.col("value") - F.lag("value").over(series("factor", "ticker"))))
    moved, gross = F.coalesce(F.sum("d"), F.lit(0.0)), F.coalesce(F.sum(F.abs("value")), F.lit(0.0))
    return x.groupBy("factor", "date", "rn").agg((ratio(moved, F.nullif(gross, F.lit(0.0))) if normalize else moved).alias("turnover"))


def dispersion(signal: DataFrame) -> DataFrame:
    return signal.groupBy("factor", "date", "rn").agg(F.stddev_samp("value").alias("dispersion"))


def lead_lag(signal: DataFrame, panel: DataFrame, max_lead: int = 10, max_lag: int = 10) -> DataFrame:
    """factor, offset, mean_ic of the signal with the one-row return ``offset`` rows on (negative: back). Any two pairs are enough."""
    offsets = list(range(-max_lag, max_lead + 1))
    w = series("ticker")
    each = F.array(*[F.struct(F.lit(k).alias("offset"), (F.lead("ret", k) if k >= 0 else F.lag("ret", -k)).over(w).alias("y")) for k in offsets])
    moved = panel.select("date", "ticker", each.alias("x")).select("date", "ticker", F.inline("x"))
    pairs = signal.select("factor", "date", "ticker", F.col("value").alias("x")).join(moved, ["date", "ticker"]).where("x is not null and y is not null")
    keys = ("factor", "offset", "date")
    ranked = pairs.withColumn("rx", average_rank(F.col("x"), *keys)).withColumn("ry", average_rank(F.col("y"), *keys))
    daily = ranked.groupBy(*keys).agg(safe_corr(F.col("rx"), F.col("ry")).alias("ic"))
    return daily.groupBy("factor", "offset").agg(F.avg("ic").alias("mean_ic"))


def natural_frequency(table: DataFrame, point: str = "point", se: str | None = "se", lag: str = "lag") -> DataFrame:
    """factor, natural_freq: the lag of the largest |point| / se; without a standard error, of the largest |point|; else 1. Ties take the least lag."""
    size = F.abs(point)
    by_se = F.when(F.col(se) > 0, size / F.col(se)) if se else F.lit(None).cast("double")
    x = table.select("factor", F.col(lag).alias("_lag"), by_se.alias("_s"), size.alias("_p"))
    top = lambda c: F.max_by("_lag", F.when(F.col(c).isNotNull(), F.struct(F.col(c), -F.col("_lag"))))
    return x.groupBy("factor").agg(F.coalesce(F.when(F.count("_s") > 0, top("_s")), F.when(F.count("_p") > 0, top("_p")), F.lit(1)).cast("int").alias("natural_freq"))


def pooled_spearman(signals: DataFrame) -> DataFrame:
    """factor_a, factor_b, corr over all cells in which every factor has a value.

    Ranks are over a factor's whole table and made in blocks of values.
    """
    k = signals.select("factor").distinct().count()
    whole = signals.where("value is not null").withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("date", "ticker"))).where(F.col("_k") == k)
    ranked = whole_rank(whole.select("factor", "date", "ticker", "value"), "value", "factor").select("factor", "date", "ticker", F.col("rank").alias("r"))
    a = ranked.select("date", "ticker", F.col("factor").alias("factor_a"), F.col("r").alias("a"))
    b = ranked.select("date", "ticker", F.col("factor").alias("factor_b"), F.col("r").alias("b"))
    return a.join(b, ["date", "ticker"]).groupBy("factor_a", "factor_b").agg(safe_corr(F.col("a"), F.col("b")).alias("corr"))


def quantile_spread(signal: DataFrame, forward: DataFrame, top: int = 3) -> DataFrame:
    """factor, horizon, date, spread: mean forward return of the ``top`` highest less that of the lowest.

    Dates with fewer than twice as many valid tickers are left out; ties go to
    the ticker that sorts first.
    """
    pairs = signal.join(forward.select("horizon", "date", "ticker", "fwd"), ["date", "ticker"]).where("value is not null and fwd is not null")
    day = Window.partitionBy("factor", "horizon", "date")
    x = pairs.withColumn("n", F.count(F.lit(1)).over(day)).withColumn("hi", F.row_number().over(day.orderBy(F.desc("value"), "ticker"))).withColumn("lo", F.row_number().over(day.orderBy("value", "ticker")))
    x = x.where(F.col("n") >= 2 * top)
    return x.groupBy("factor", "horizon", "date").agg((F.avg(F.when(F.col("hi") <= top, F.col("fwd"))) - F.avg(F.when(F.col("lo") <= top, F.col("fwd")))).alias("spread"))
