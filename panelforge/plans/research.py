"""Analyses that put the operators together, one function each."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.stats import nearest_dates, ratio, rolling, safe_corr, sample_kurtosis, sample_skewness, series
from panelforge.operators import factors as fx
from panelforge.operators import ic, metrics
from panelforge.operators.backtest import Backtest
from panelforge.operators.combine import ICWeighted, zscored
from panelforge.session import for_workers
from panelforge.sources.panel import forward_returns


def coverage(panel: DataFrame, late_days: int = 5) -> DataFrame:
    """ticker, first_date, n_valid, coverage_pct, late (listed over ``late_days`` after the panel starts)."""
    there = F.when(F.col("close").isNotNull(), F.col("date"))
    start = panel.agg(F.min("date").alias("_start"))
    own = panel.groupBy("ticker").agg(F.min(there).alias("first_date"), F.count("close").alias("n_valid"), (100 * F.count("close") / F.count(F.lit(1))).alias("coverage_pct"))
    return own.crossJoin(F.broadcast(start)).withColumn("late", F.datediff("first_date", "_start") > late_days).drop("_start")


def usable_dates(panel: DataFrame) -> DataFrame:
    """How many dates have all tickers, and how many have any."""
    daily = panel.groupBy("date").agg(F.count("close").alias("n"), F.count(F.lit(1)).alias("k"))
    return daily.agg(F.count(F.lit(1)).alias("n_dates"), F.sum((F.col("n") == F.col("k")).cast("long")).alias("n_complete"), F.sum((F.col("n") > 0).cast("long")).alias("n_any"))


def base_100(panel: DataFrame) -> DataFrame:
    first = F.first("close", ignorenulls=True).over(series("ticker").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return panel.select("date", "ticker", (100 * ratio(F.col("close"), first)).alias("base100"))


def rolling_volatility(panel: DataFrame, windows: tuple[int, ...] = (5, 21, 63), periods: int = 252) -> DataFrame:
    return panel.select("date", "ticker", *[(rolling(F.stddev_samp, F.col("ret"), w, series("ticker")) * periods**0.5).alias(f"vol_{w}") for w in windows])


def return_correlations(panel: DataFrame) -> DataFrame:
    a = panel.select("date", F.col("ticker").alias("ticker_a"), F.col("ret").alias("a"))
    b = panel.select("date", F.col("ticker").alias("ticker_b"), F.col("ret").alias("b"))
    return a.join(b, "date").groupBy("ticker_a", "ticker_b").agg(safe_corr(F.col("a"), F.col("b")).alias("corr"))


def forward_moments(panel: DataFrame, horizons: list[int]) -> DataFrame:
    """horizon and pooled moments of forward returns, means and deviations in basis points."""
    x = F.col("fwd")
    return forward_returns(panel, horizons).groupBy("horizon").agg(F.count(x).alias("n"), (1e4 * F.avg(x)).alias("mean_bps"), (1e4 * F.stddev_samp(x)).alias("std_bps"), sample_skewness(x).alias("skew"), sample_kurtosis(x).alias("kurt"))


def histogram(values: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """bin (from 0), low, n, density of equal bins between the least and the greatest value."""
    ends = values.agg(F.min(column).alias("_a"), F.max(column).alias("_b"))
    x = values.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends))
    width = (F.col("_b") - F.col("_a")) / bins
    k = F.coalesce(F.least(F.floor(ratio(F.col(column) - F.col("_a"), width)), F.lit(bins - 1)), F.lit(0)).cast("int")
    counts = x.groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.first("_a").alias("_a"), F.first(width).alias("_w"))
    return counts.select("bin", (F.col("_a") + F.col("bin") * F.col("_w")).alias("low"), "n", ratio(F.col("n"), F.sum("n").over(Window.partitionBy()) * F.col("_w")).alias("density"))


def rolling_ic(table: DataFrame, window: int = 63, least: int = 30) -> DataFrame:
    return table.withColumn("rolling_ic", rolling(F.avg, F.col("ic"), window, series("factor", "horizon"), least))


def spread_stats(spreads: DataFrame) -> DataFrame:
    s = F.col("spread")
    return spreads.groupBy("factor", "horizon").agg(F.count(s).alias("n"), F.avg(s).alias("mean"), ratio(F.avg(s), F.nullif(F.stddev_samp(s), F.lit(0.0))).alias("ratio"), F.avg((s > 0).cast("double")).alias("hit_rate"))


def sub_periods(table: DataFrame, split: str) -> DataFrame:
    """Mean and t of the coefficients before and after ``split``; both parts have the date itself."""
    d = F.lit(split).cast("date")
    parts = table.where(F.col("date") <= d).withColumn("period", F.lit("pre")).unionByName(table.where(F.col("date") >= d).withColumn("period", F.lit("post")))
    return parts.groupBy("factor", "horizon", "period").agg(F.avg("ic").alias("mean"), (ratio(F.avg("ic"), F.nullif(F.stddev_samp("ic"), F.lit(0.0))) * F.sqrt(F.count("ic"))).alias("t_stat"), F.count("ic").alias("n"))


def without_each(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """The rank correlation of ``x`` and ``y``, and that without each pair in turn; NaN where a side is constant.

    Without a pair every greater value's rank falls by one and every equal one's
    by a half, so nothing is ranked again. Ranks are multiples of a half: the sums
    are exact. Pairs are left out in slices, so memory is linear in their number.
    """

    def ranks(v: np.ndarray) -> np.ndarray:
        _, at, times = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(times) - (times - 1) / 2)[at]

    def corr(n, xx, yy, xy):
        mean = (n + 1) / 2
        spread = np.sqrt((xx - n * mean**2) * (yy - n * mean**2))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(spread > 0, (xy - n * mean**2) / spread, np.nan)

    n, rx, ry = len(x), ranks(x), ranks(y)
    out = np.empty(n)
    for at in range(0, n, 256):
        cut = slice(at, min(at + 256, n))
        lower = lambda v: (v[:, None] > v[None, cut]) + 0.5 * (v[:, None] == v[None, cut])
        a, b = rx[:, None] - lower(x), ry[:, None] - lower(y)
        a[np.arange(cut.start, cut.stop), np.arange(cut.stop - cut.start)] = 0
        b[np.arange(cut.start, cut.stop), np.arange(cut.stop - cut.start)] = 0
        out[cut] = corr(n - 1, (a * a).sum(0), (b * b).sum(0), (a * b).sum(0))
    return float(corr(n, rx @ rx, ry @ ry, rx @ ry)), out


def leave_one_out(signal: DataFrame, panel: DataFrame, horizon: int = 1, min_periods: int = 5) -> DataFrame:
    """factor, left_out, mean_ic: the coefficient without each ticker in turn.

    A date's cross-section is ranked once and gives a row for each of its tickers.
    A ticker's mean is the factor's sums over all dates, with its own dates' whole
    coefficients changed for those without it.
    """
    forward = forward_returns(panel, [horizon]).select("date", "ticker", "fwd")
    pairs = signal.join(forward, ["date", "ticker"]).where("value is not null and fwd is not null").select("factor", "date", "ticker", "value", "fwd")

    def run(table: pa.Table) -> pa.Table:
        n = table.num_rows
        whole, each = without_each(table["value"].to_numpy(), table["fwd"].to_numpy())
        whole = whole if n >= min_periods else np.nan
        each = each if n - 1 >= min_periods else np.full(n, np.nan)
        null = lambda v: pa.array(v, pa.float64(), mask=np.isnan(v))
        names = pa.array([*table["ticker"].to_pylist(), None], pa.string())
        return pa.table({"factor": pa.array(table["factor"].to_pylist()[:1] * (n + 1), pa.string()), "left_out": names, "whole": null(np.full(n + 1, whole)), "without": null(np.append(each, np.nan))})

    cut = for_workers(pairs).groupBy("factor", "date").applyInArrow(run, "factor string, left_out string, whole double, without double")
    sums = cut.groupBy("factor", "left_out").agg(*[f(c).alias(f"{n}_{c}") for c in ("whole", "without") for n, f in (("s", F.sum), ("c", F.count))])
    total = sums.where("left_out is null").select("factor", F.coalesce("s_whole", F.lit(0.0)).alias("s"), F.col("c_whole").alias("c"))
    every = signal.select("factor").distinct().crossJoin(panel.select(F.col("ticker").alias("left_out")).distinct())  # factors times names
    of = every.join(sums.where("left_out is not null"), ["factor", "left_out"], "left").join(total, "factor", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    mean = ratio(zero("s") - zero("s_whole") + zero("s_without"), (zero("c") - zero("c_whole") + zero("c_without")).cast("double"))
    return of.select("factor", "left_out", F.when(zero("c") - zero("c_whole") + zero("c_without") > 0, mean).alias("mean_ic"))


def most_volatile(panel: DataFrame) -> DataFrame:
    return panel.groupBy("ticker").agg(F.stddev_samp("ret").alias("vol")).orderBy(F.desc("vol"), "ticker").limit(1)


def sector_split(signal: DataFrame, panel: DataFrame, horizon: int = 1, least: int = 5) -> DataFrame:
    """factor, sector, mean_ic within each sector of at least ``least`` tickers."""
    sectors = panel.select("ticker", "sector").distinct().withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("sector"))).where(F.col("_k") >= least).drop("_k")
    s = signal.join(sectors, "ticker").withColumn("factor", F.concat_ws("|", "factor", "sector")).drop("sector")
    both = F.split("factor", r"\|")
    return ic.compute_ic(s, forward_returns(panel, [horizon])).groupBy(both[0].alias("factor"), both[1].alias("sector")).agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("n"))


def parameter_grid(panel: DataFrame, windows: list[int], skips: list[int], horizon: int = 5) -> DataFrame:
    """factor (its parameters in the name), mean_ic of momentum over a grid."""
    grid = [fx.Momentum(w, s) for w in windows for s in skips if s < w]
    return ic.compute_ic(fx.compute(panel, grid), forward_returns(panel, [horizon])).groupBy("factor").agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("n"))


def triage(table: DataFrame, least: float = 2.0) -> DataFrame:
    """factor, best_t (largest |t| by Newey-West over the horizons), survives."""
    nw = ic.newey_west(table, F.col("horizon") - 1)
    return nw.groupBy("factor").agg(F.max(F.abs("t_nw")).alias("best_t")).withColumn("survives", F.col("best_t") >= least)


def inflation(table: DataFrame) -> DataFrame:
    """factor, horizon, t_naive, t_nw and how often the naive t is the other one."""
    return ic.newey_west(table, F.col("horizon") - 1).select("factor", "horizon", "t_naive", "t_nw", ratio(F.col("t_naive"), F.nullif("t_nw", F.lit(0.0))).alias("inflation"))


def common_start(signals: DataFrame, floor: str) -> DataFrame:
    """The date from which every factor has values, ``floor`` at the earliest."""
    first = signals.where("value is not null").groupBy("factor").agg(F.min("date").alias("d"))
    return first.agg(F.greatest(F.max("d"), F.lit(floor).cast("date")).alias("common_start"))


def regimes(returns: DataFrame, spans: dict[str, tuple[str, str]]) -> DataFrame:
    """regime, factor and the eight performance metrics of each span, both ends in; spans may overlap."""
    rows = [F.struct(F.lit(k).alias("regime"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for k, (a, b) in spans.items()]
    x = returns.select("factor", "date", "ret", F.inline(F.array(*rows))).where("date between a and b").drop("a", "b")
    return metrics.summary(x, ["regime", "factor"])


def orientation_lag(table: DataFrame, probes: list[str], trailing: int = 52, ahead: int = 4) -> DataFrame:
    """probe, date (the nearest there is, the earlier of two), trailing and realised mean coefficient around it, and whether their signs agree."""
    w = series("factor", "horizon")
    x = table.withColumn("trailing", rolling(F.avg, F.col("ic"), trailing, w, least=1)).withColumn("realised", F.avg("ic").over(w.rowsBetween(1, ahead)))
    asked = table.sparkSession.createDataFrame([(p,) for p in probes], "probe string").select(F.col("probe").cast("date").alias("probe"))
    near = nearest_dates(table.select("date").distinct(), asked)
    return x.join(near, "date").select("factor", "horizon", "probe", "date", "trailing", "realised", (F.signum("trailing") == F.signum("realised")).alias("agrees"))


def decision_table(table: DataFrame, returns: DataFrame) -> DataFrame:
    """factor, mean, t_nw, sharpe_ratio and a verdict: keep, weak or drop."""
    t = ic.summary(table).select("factor", "horizon", "mean", "t_nw")
    s = metrics.summary(returns, ["factor"]).select("factor", "sharpe_ratio")
    verdict = F.when((F.abs("t_nw") >= 2) & (F.col("sharpe_ratio") > 0), "keep").when((F.abs("t_nw") >= 1) | (F.col("sharpe_ratio") > 0), "weak").otherwise("drop")
    return t.join(s, "factor", "left").withColumn("verdict", verdict)


def with_benchmark(returns: DataFrame, panel: DataFrame) -> DataFrame:
    """Back-test returns with bench, the market's next change: what a position of that date earns."""
    market = panel.select("date", "rn", "market").distinct()
    w = Window.orderBy("rn")  # one row a date
    bench = market.select("date", (ratio(F.lead("market").over(w), F.col("market")) - 1).alias("bench"))
    return returns.join(bench, "date", "left")


def flagship(panel: DataFrame, momentum_window: int = 52, skip: int = 4, vol_window: int = 21, halflife: int = 26, rebalance: int = 31, cost_bps: float = 10.0) -> DataFrame:
    """Daily returns of the frozen signal: sector-neutral momentum and low volatility, weighted by their exponentially weighted coefficients."""
    signals = fx.compute(panel, [fx.SectorNeutralMomentum(momentum_window, skip), fx.LowVol(vol_window)])
    combined = ICWeighted(shrinkage=0.0, use_ewm=True, halflife=halflife, name="flagship", factors=2).combine(signals, panel)
    return Backtest(cost_bps, rebalance).run(panel, combined)


def attribution(signals: DataFrame, panel: DataFrame, groups: dict[str, list[str]], rebalance: int = 5, cost_bps: float = 10.0) -> DataFrame:
    """Daily returns by group of factors (as ``factor``), each group the mean of its z-scores; a leading minus turns a factor round.

    One group of all factors is the kitchen sink, one of two opposite styles a
    barbell, one of a reversed factor the static-reversal test.
    """
    rows = [F.struct(F.lit(g).alias("g"), F.lit(m.removeprefix("-")).alias("m"), F.lit(-1.0 if m.startswith("-") else 1.0).alias("s")) for g, ms in groups.items() for m in ms]
    z = zscored(signals).select("factor", "date", "rn", "ticker", "z", F.inline(F.array(*rows))).where("factor = m")
    mixed = z.groupBy("g", "date", "rn", "ticker").agg(F.avg(F.col("s") * F.col("z")).alias("value")).withColumnRenamed("g", "factor")
    return Backtest(cost_bps, rebalance).run(panel, mixed)


def squared_returns(panel: DataFrame) -> DataFrame:
    """date, ticker, ret2: what volatility clusters show in."""
    return panel.select("date", "ticker", (F.col("ret") * F.col("ret")).alias("ret2"))


def describe(panel: DataFrame, column: str = "ret") -> DataFrame:
    """ticker, n, mean, std, min, quartiles and max of a column."""
    c = F.col(column)
    quarter = [F.percentile(c, q).alias(f"p{int(100 * q)}") for q in (0.25, 0.5, 0.75)]
    return panel.groupBy("ticker").agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), *quarter, F.max(c).alias("max"))


def weight_variants(signals: DataFrame, panel: DataFrame, variants: dict[str, ICWeighted], rebalance: int = 5) -> DataFrame:
    """factor (the variant) and total return of coefficient-weighted combinations, all in one back-test."""
    combined = [how.combine(signals, panel).withColumn("factor", F.lit(name)) for name, how in variants.items()]
    return metrics.total_return(Backtest(10.0, rebalance).run(panel, reduce(DataFrame.unionByName, combined)), ["factor"])
