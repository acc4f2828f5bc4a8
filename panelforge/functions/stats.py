"""Column helpers with the null rules that every operator here keeps.

A missing value is null, never NaN. A rolling value exists only if its whole
window does. Division by zero is null unless a metric defines it otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: A standard deviation up to this share of the mean is rounding noise of a constant.
NOISE = 1e-15


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once, also where a lambda uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def series(*keys: str, order: str = "rn") -> WindowSpec:
    """One series after another, each in the order of its dates."""
    return Window.partitionBy(*keys).orderBy(order)


def rolling(agg: Callable[[Column], Column], x: Column, rows: int, over: WindowSpec, least: int | None = None, end: int = 0) -> Column:
    """``agg`` of the ``rows`` rows that end ``end`` rows back; null unless ``least`` (all of them) are there."""
    frame = over.rowsBetween(-(rows - 1) - end, -end)
    return F.when(F.count(x).over(frame) >= (rows if least is None else least), agg(x).over(frame))


def safe_corr(x: Column, y: Column, over: WindowSpec | None = None) -> Column:
    """Pearson correlation of the pairs that are whole; null where a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    on = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    return ratio(on(F.covar_samp(a, b)), F.nullif(on(F.stddev_samp(a)) * on(F.stddev_samp(b)), F.lit(0.0)))


def average_rank(x: Column, *keys: str) -> Column:
    """Rank within ``keys`` from 1, ties sharing their mean; null for null."""
    there = x.isNotNull()
    group = Window.partitionBy(*keys, there)
    ties = Window.partitionBy(*keys, there, x)
    return F.when(there, F.rank().over(group.orderBy(x)) + (F.count(F.lit(1)).over(ties) - 1) / 2)


def whole_rank(df: DataFrame, x: str, *keys: str, blocks: int = 4096) -> DataFrame:
    """``df`` with ``rank``, the average rank of ``x`` within ``keys``, for groups too large for one task.

    Only distinct values and their counts are ordered, so a value that many rows
    share is one row there. Approximate quantiles cut a group's values into at least
    ``blocks`` blocks (four or more); a value's rank comes from the counts in the blocks
    before its own and those before it in its own. It is exact: quantiles only
    decide which task does what. Rows get their value's rank by a join that Spark
    may split where one value is frequent. Rows with a null have none.
    """
    there = df.where(F.col(x).isNotNull())
    values = there.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_c"))
    side = max(2, math.isqrt(max(blocks, 1) - 1) + 1)
    n = side * side
    cuts = values.groupBy(*keys).agg(F.percentile_approx(x, [k / n for k in range(1, n)], 10_000).alias("_cuts"))
    # a cut is found among every side-th, then among those up to the next of these
    cuts = cuts.withColumn("_coarse", F.transform(F.sequence(F.lit(1), F.lit(side - 1)), lambda i: F.element_at("_cuts", i * side)))
    cut = values.join(cuts, list(keys)) if keys else values.crossJoin(cuts)  # one row a group
    below = lambda c: F.size(F.filter(c, lambda v: v < F.col(x)))
    cut = cut.withColumn("_a", below(F.col("_coarse"))).withColumn("_block", F.col("_a") * side + below(F.slice("_cuts", F.col("_a") * side + 1, side)))
    cut = cut.drop("_cuts", "_coarse", "_a")
    sizes = cut.groupBy(*keys, "_block").agg(F.sum("_c").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*keys, "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    so_far = F.sum("_c").over(Window.partitionBy(*keys, "_block").orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    ranks = cut.join(starts, [*keys, "_block"]).select(*keys, x, (F.col("_before") + so_far - (F.col("_c") - 1) / 2).alias("rank"))
    return there.join(ranks, [*keys, x]).select(*df.columns, "rank")


def nearest_dates(dates: DataFrame, probes: DataFrame, days: int = 366) -> DataFrame:
    """probe, date: the nearest of ``dates`` (date) to each of ``probes`` (probe), the earlier of two; no row where there are no dates.

    Both are merged in order of date within spans of ``days``; what comes from
    beyond a span is carried over from its neighbours, of which there is a row a
    span. Any number of dates and probes: nothing is compared pair by pair.
    """
    rows = dates.select("date", F.lit(None).cast("date").alias("probe")).distinct().unionByName(probes.select(F.lit(None).cast("date").alias("date"), "probe").where("probe is not null").distinct())
    rows = rows.withColumn("_at", F.coalesce("date", "probe")).withColumn("_span", F.floor(F.unix_date("_at") / days))
    run = lambda order: Window.partitionBy("_span").orderBy(order, F.col("probe").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumns({"_below": F.last("date", ignorenulls=True).over(run(F.col("_at"))), "_above": F.last("date", ignorenulls=True).over(run(F.desc("_at")))})
    spans = rows.groupBy("_span").agg(F.min("date").alias("_first"), F.max("date").alias("_last"))
    order = Window.orderBy("_span")  # one row a span
    carried = spans.select("_span", F.max("_last").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.min("_first").over(Window.orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
    near = found.where("probe is not null").join(carried, "_span").select("probe", F.coalesce("_below", "_before").alias("a"), F.coalesce("_above", "_after").alias("b"))
    date = F.when(F.col("b").isNull() | (F.datediff("probe", "a") <= F.datediff("b", "probe")), F.col("a")).otherwise(F.col("b"))
    return near.select("probe", date.alias("date")).where("date is not null")


def sample_skewness(x: Column, on: Callable[[Column], Column] = lambda c: c) -> Column:
    """Bias-corrected skewness; 0 for a constant, null for fewer than three values."""
    n = on(F.count(x)).cast("double")
    # the population moment is undefined for a constant
    g = on(F.skewness(x)) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n < 3, None).when(on(F.max(x)) == on(F.min(x)), 0.0).otherwise(g)


def sample_kurtosis(x: Column, on: Callable[[Column], Column] = lambda c: c) -> Column:
    """Bias-corrected excess kurtosis; 0 for a constant, null for fewer than four values."""
    n = on(F.count(x)).cast("double")
    g = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * on(F.kurtosis(x)) + 6)
    return F.when(n < 4, None).when(on(F.max(x)) == on(F.min(x)), 0.0).otherwise(g)


def zscore(x: Column, *keys: str) -> Column:
    """(x - mean) / sample deviation within ``keys``; null for a constant or a single value."""
    w = Window.partitionBy(*keys)
    return ratio(x - F.avg(x).over(w), F.nullif(F.stddev_samp(x).over(w), F.lit(0.0)))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """``df`` with its doubles rounded and no negative zero, for comparison across engines."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
