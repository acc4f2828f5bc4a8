"""Information coefficients: rank correlation of signals with forward returns, and what its series says.

Signals are (factor, date, rn, ticker, value), forward returns (horizon, date,
ticker, fwd), coefficients (factor, horizon, date, rn, ic, n_valid). Factors and
horizons are columns, so all of them are one job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.stats import average_rank, ratio, safe_corr
from panelforge.session import for_workers
from panelforge.sources.panel import forward_returns

KEYS = ("factor", "horizon")
#: A coefficient of ranks is a multiple of far more than this; up to it, it is zero but for rounding.
NOISE_IC = 1e-12
#: A 31-bit linear congruential generator: fixed values.
LCG_A, LCG_C, LCG_M = 1103515245, 12345, 2147483648
#: Tasks that a series' replicates are dealt to.
_SHARES = 64


def compute_ic(signal: DataFrame, forward: DataFrame, min_periods: int = 5) -> DataFrame:
    """The Spearman coefficient of each date the two share, over the tickers of ``signal`` that have both values.

    Null where fewer than ``min_periods`` are left or a side is constant.
    """
    dates = forward.select("horizon", "date").distinct()
    joined = signal.join(dates, "date").join(forward.select("horizon", "date", "ticker", "fwd"), ["horizon", "date", "ticker"], "left")
    both = F.col("value").isNotNull() & F.col("fwd").isNotNull()
    pairs = joined.select(*KEYS, "date", "rn", "ticker", F.when(both, F.col("value")).alias("x"), F.when(both, F.col("fwd")).alias("y"))
    ranked = pairs.withColumn("rx", average_rank(F.col("x"), *KEYS, "date")).withColumn("ry", average_rank(F.col("y"), *KEYS, "date"))
    n = F.count("rx")
    return ranked.groupBy(*KEYS, "date", "rn").agg(F.when(n >= min_periods, safe_corr(F.col("rx"), F.col("ry"))).alias("ic"), n.alias("n_valid"))


def non_overlapping_ic(signal: DataFrame, forward: DataFrame, horizon: int, min_periods: int = 5) -> DataFrame:
    """The coefficient of every ``horizon``-th date the two share, from the first on."""
    shared = signal.select("date").distinct().join(forward.select("date").distinct(), "date")
    place = shared.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("_at"))
    kept = place.where(F.col("_at") % horizon == 0).select("date")
    return compute_ic(signal.join(kept, "date"), forward.where(F.col("horizon") == horizon), min_periods)


def numbered(ic: DataFrame) -> DataFrame:
    """The coefficients that aren't null with their place (pos from 1) and their series' length and mean."""
    there = ic.where(F.col("ic").isNotNull())
    whole = Window.partitionBy(*KEYS)
    return there.select(*KEYS, "date", "ic", F.row_number().over(whole.orderBy("date")).alias("pos"), F.count("ic").over(whole).alias("n"), F.avg("ic").over(whole).alias("mean"))


def newey_west(ic: DataFrame, bandwidth: int | Column | None = None) -> DataFrame:
    """n, bandwidth, se_nw, t_nw, se_naive, t_naive by factor and horizon.

    ``bandwidth`` may be a column of horizon; by default the cube root of n,
    rounded up. It is cut to n - 1. Series of fewer than two values have nulls.
    """
    x = numbered(ic).withColumn("d", F.col("ic") - F.col("mean"))
    asked = F.ceil(F.cbrt(F.col("n").cast("double")) - 1e-9) if bandwidth is None else bandwidth if isinstance(bandwidth, Column) else F.lit(bandwidth)
    x = x.withColumn("m", F.when(F.col("n") < 2, 0).otherwise(F.least(asked, F.col("n") - 1)).cast("int"))
    # a date meets the m dates before it by place
    reach = x.select(*KEYS, "pos", "m", "d", "n", F.explode(F.sequence(F.lit(0), F.col("m"))).alias("k")).withColumn("at", F.col("pos") - F.col("k"))
    pairs = reach.join(x.select(*KEYS, F.col("pos").alias("at"), F.col("d").alias("d0")), [*KEYS, "at"])
    gamma = pairs.groupBy(*KEYS, "k").agg((F.sum(F.col("d") * F.col("d0")) / F.max("n")).alias("g"), F.max("m").alias("m"))
    weight = F.when(F.col("k") == 0, 1.0).otherwise(2 * (1 - F.col("k") / (F.col("m") + 1)))
    v = gamma.groupBy(*KEYS).agg(F.sum(weight * F.col("g")).alias("v"))
    naive = x.groupBy(*KEYS).agg(F.max("n").alias("n"), F.max("m").alias("bandwidth"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("sd"))
    se, plain = F.sqrt(F.greatest(F.col("v"), F.lit(0.0)) / F.col("n")), F.col("sd") / F.sqrt("n")
    enough = F.col("n") >= 2
    return naive.join(v, list(KEYS)).select(
        *KEYS,
        "n",
        "bandwidth",
        F.when(enough, se).alias("se_nw"),
        F.when(enough, ratio(F.col("mean"), F.nullif(se, F.lit(0.0)))).alias("t_nw"),
        F.when(enough, plain).alias("se_naive"),
        F.when(enough, ratio(F.col("mean"), F.nullif(plain, F.lit(0.0)))).alias("t_naive"),
    )


def summary(ic: DataFrame, with_newey_west: bool = True) -> DataFrame:
    """mean, std, icir, hit_rate, t_stat, n_dates, avg_coverage and, with a bandwidth of horizon - 1, the Newey-West columns."""
    sd = F.nullif(F.stddev_samp("ic"), F.lit(0.0))
    mean, n = F.avg("ic"), F.count("ic")
    out = ic.groupBy(*KEYS).agg(
        mean.alias("mean"),
        F.stddev_samp("ic").alias("std"),
        ratio(mean, sd).alias("icir"),
        F.avg(F.when(F.col("ic").isNotNull(), (F.col("ic") > NOISE_IC).cast("double"))).alias("hit_rate"),
        (ratio(mean, sd) * F.sqrt(n)).alias("t_stat"),
        n.alias("n_dates"),
        F.avg("n_valid").alias("avg_coverage"),
    )
    if with_newey_west:
        nw = newey_west(ic, F.col("horizon") - 1).select(*KEYS, "bandwidth", "se_nw", "t_nw")
        out = out.join(nw, list(KEYS), "left")
    return out


def _over_values(statistic: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A statistic as a function of an array column."""
    if callable(statistic):
        return statistic
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    std = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean(v)) * (x - mean(v))) / F.nullif(F.size(v) - 1, F.lit(0)))
    middle = lambda v: (F.get(F.sort_array(v), F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(F.sort_array(v), F.floor(F.size(v) / 2).cast("int"))) / 2
    return {"mean": mean, "median": middle, "std": std, "sharpe": lambda v: mean(v) / F.nullif(std(v), F.lit(0.0)) * 252**0.5}[statistic]


def block_bootstrap(ic: DataFrame, block: int | Column | None = None, replicates: int = 10_000, confidence: float = 0.95, seed: int = 42, statistic: str | Callable[[Column], Column] = "mean") -> DataFrame:
    """ci_lower, ci_upper, se_bootstrap by factor and horizon from a moving-block bootstrap.

    Blocks start anywhere, end with the series and are laid end to end until
    they fill it. The starts come from a linear congruential generator, so any
    engine can replay them. ``statistic``: mean, median, std, sharpe (by 252
    rows a year), or any function from an array column to a column.

    A series has one value a date, so it is one array: the coefficients are read
    once, and a replicate is one pass over its blocks, without a join. For the
    mean, prefix sums make a block one subtraction.
    """
    series = _as_arrays(ic, block, running_sums=statistic == "mean")
    laid = _laid(series, replicates, seed, sums=statistic == "mean")
    value = laid.select(*KEYS, (F.col("laid") / F.col("n") if statistic == "mean" else _over_values(statistic)(F.col("laid"))).alias("s"))
    return value.groupBy(*KEYS).agg(*_interval(confidence))


def bootstrap_of(ic: DataFrame, function: Callable[[np.ndarray], float], block: int | Column | None = None, replicates: int = 10_000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """point_estimate, ci_lower, ci_upper, se_bootstrap by factor and horizon of any function from a numpy array to a number.

    The draws are those of ``block_bootstrap``; the function runs in Arrow
    batches, once a replicate and once for the series itself. A series of fewer
    than two values, or no replicates, gives nulls; so does a NaN.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [float(function(x.values.to_numpy(zero_copy_only=False))) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([None if x != x else x for x in found], pa.float64())], ["factor", "horizon", "s"])

    def of(arrays: DataFrame) -> DataFrame:
        return for_workers(arrays).mapInArrow(run, arrays.select(*KEYS).withColumn("s", F.lit(None).cast("double")).schema)

    series = _as_arrays(ic, block)
    point = of(series.select(*KEYS, "v")).withColumnRenamed("s", "point_estimate")
    spread = of(_laid(series, replicates, seed).select(*KEYS, "laid")).groupBy(*KEYS).agg(*_interval(confidence))
    all_ = ic.select(*KEYS).distinct().join(point, list(KEYS), "left").join(spread, list(KEYS), "left")
    there = F.lit(replicates >= 1)
    return all_.select(*KEYS, *[F.when(there, F.col(c)).alias(c) for c in ("point_estimate", "ci_lower", "ci_upper", "se_bootstrap")])


def _interval(confidence: float) -> list[Column]:
    tail = (1 - confidence) / 2
    return [F.percentile("s", tail).alias("ci_lower"), F.percentile("s", 1 - tail).alias("ci_upper"), F.stddev_samp("s").alias("se_bootstrap")]


def _as_arrays(ic: DataFrame, block: int | Column | None, running_sums: bool = False) -> DataFrame:
    """factor, horizon, v, n, b: each series of at least two values as one array (or its running sums, from 0), and the length of its blocks."""
    table = numbered(ic)
    if running_sums:
        so_far = Window.partitionBy(*KEYS).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        table = table.withColumn("ic", F.sum("ic").over(so_far))
    values = F.transform(F.array_sort(F.collect_list(F.struct("pos", "ic"))), lambda s: s["ic"])
    series = table.groupBy(*KEYS).agg(values.alias("v")).where("size(v) >= 2").withColumn("n", F.size("v").cast("long"))
    asked = F.ceil(F.cbrt(F.col("n").cast("double")) - 1e-9) if block is None else block if isinstance(block, Column) else F.lit(block)
    series = series.withColumn("b", F.least(F.greatest(asked.cast("long"), F.lit(1).cast("long")), F.col("n")))
    return series.withColumn("v", F.concat(F.array(F.lit(0.0)), "v")) if running_sums else series


def _laid(series: DataFrame, replicates: int, seed: int, sums: bool = False) -> DataFrame:
    """factor, horizon, n, laid: each replicate of each series, as its values or, of running sums, as its sum."""
    spark, shares = series.sparkSession, max(1, min(_SHARES, replicates))
    # each series goes to as many tasks as it has shares of the replicates, which are drawn there
    share = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long")))
    dealt = series.withColumn("_share", share).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *KEYS, "_share")
    drawn = F.explode(F.sequence(F.col("_share"), F.lit(max(replicates, 1) - 1).cast("long"), F.lit(shares).cast("long")))
    draws = dealt.where(F.lit(replicates >= 1)).withColumn("rep", drawn)

    def start(blk: Column) -> Column:
        state = (F.lit(seed) + F.col("rep") * 7919 + blk * 104729) % LCG_M
        for _ in range(3):
            state = (state * LCG_A + LCG_C) % LCG_M
        return F.call_function("div", state * F.col("n"), F.lit(LCG_M))

    blocks = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / F.col("b")) * 4 + 49)
    if sums:
        nothing, of = F.lit(0.0), lambda acc, s, size: acc + F.get("v", (s + size).cast("int")) - F.get("v", s.cast("int"))
    else:
        nothing, of = F.array().cast("array<array<double>>"), lambda acc, s, size: F.concat(acc, F.array(F.slice("v", (s + 1).cast("int"), size.cast("int"))))

    def lay(a: Column, blk: Column) -> Column:
        """One more block, unless the series is full; the start is worked out once and only then."""
        size = lambda s: F.least(F.col("b"), F.col("n") - s, F.col("n") - a["filled"])
        more = F.transform(F.array(start(blk)), lambda s: F.struct((a["filled"] + size(s)).alias("filled"), of(a["acc"], s, size(s)).alias("acc")))
        return F.when(a["filled"] < F.col("n"), F.get(more, F.lit(0))).otherwise(a)

    laid = F.aggregate(blocks, F.struct(F.lit(0).cast("long").alias("filled"), nothing.alias("acc")), lay)["acc"]
    return draws.select(*KEYS, "n", (laid if sums else F.flatten(laid)).alias("laid"))


def decay(signal: DataFrame, panel: DataFrame, max_lag: int = 20, min_periods: int = 5) -> DataFrame:
    """factor, horizon (1 to ``max_lag``) and the mean coefficient."""
    return compute_ic(signal, forward_returns(panel, list(range(1, max_lag + 1))), min_periods).groupBy(*KEYS).agg(F.avg("ic").alias("mean_ic"))


def correlation_matrix(ic: DataFrame) -> DataFrame:
    """factor_a, factor_b, corr: Pearson, pairwise complete, of the factors' coefficients at each horizon."""
    a = ic.select("horizon", "date", F.col("factor").alias("factor_a"), F.col("ic").alias("a"))
    b = ic.select("horizon", "date", F.col("factor").alias("factor_b"), F.col("ic").alias("b"))
    return a.join(b, ["horizon", "date"]).groupBy("horizon", "factor_a", "factor_b").agg(safe_corr(F.col("a"), F.col("b")).alias("corr"))


def autocorrelation(ic: DataFrame, lags: list[int]) -> DataFrame:
    """factor, horizon, lag, corr of a series with itself ``lag`` dates before."""
    w = Window.partitionBy(*KEYS).orderBy("rn")
    each = F.array(*[F.struct(F.lit(k).alias("lag"), F.lag("ic", k).over(w).alias("before")) for k in lags])
    pairs = ic.select(*KEYS, "ic", each.alias("x")).select(*KEYS, "ic", F.inline("x"))
    return pairs.groupBy(*KEYS, "lag").agg(safe_corr(F.col("ic"), F.col("before")).alias("corr"))
