"""The price panel: one row a date and ticker, on a dense grid.

Every date has a row for every ticker, with a null price where it has none, so
that a lag counts dates and not a ticker's own rows. ``rn`` is the date's place.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions.stats import ratio, series


def number_dates(dates: DataFrame) -> DataFrame:
    """date, rn from 0. There are a few thousand dates however large the panel is."""
    return dates.select("date").distinct().select("date", (F.row_number().over(Window.orderBy("date")) - 1).cast("int").alias("rn"))


def densify(cells: DataFrame, attributes: list[str] | None = None) -> DataFrame:
    """``cells`` (date, ticker, attributes of the ticker, measures) on the grid of its dates and tickers, with rn.

    The grid has as many rows as the dense panel; its sides are small, so it is
    a nested loop over a broadcast list of tickers. NaN measures become null.
    """
    attributes = attributes or []
    measures = [c for c in cells.columns if c not in ("date", "ticker", *attributes)]
    doubles = {c for c, t in cells.dtypes if t in ("double", "float")}
    clean = cells.select("date", "ticker", *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in doubles else F.col(c) for c in measures])
    tickers = cells.select("ticker", *attributes).distinct()
    return number_dates(cells).crossJoin(tickers).join(clean, ["date", "ticker"], "left").select("date", "rn", "ticker", *attributes, *measures)


def with_returns(panel: DataFrame, price: str = "close") -> DataFrame:
    """ret: the change from the row before; a gap is not filled, so it breaks two returns."""
    return panel.withColumn("ret", ratio(F.col(price), F.lag(price).over(series("ticker"))) - 1)


def pad_forward(panel: DataFrame, price: str = "close") -> DataFrame:
    """Prices carried over gaps, for callers that want padded returns."""
    w = series("ticker").rowsBetween(Window.unboundedPreceding, 0)
    return panel.withColumn(price, F.last(price, ignorenulls=True).over(w))


def forward_returns(panel: DataFrame, horizons: list[int], price: str = "close") -> DataFrame:
    """horizon, date, rn, ticker, fwd: the change over the next ``horizon`` rows."""
    w = series("ticker")
    each = [F.struct(F.lit(h).alias("horizon"), (ratio(F.lead(price, h).over(w), F.col(price)) - 1).alias("fwd")) for h in horizons]
    return panel.select("date", "rn", "ticker", F.array(*each).alias("x")).select("date", "rn", "ticker", F.inline("x"))


def window_rows(panel: DataFrame, start: str, lookback: int) -> DataFrame:
    """Rows that serve dates from ``start`` on with ``lookback`` rows of history: the scan a late date needs, and no more."""
    first = panel.where(F.col("date") >= F.lit(start).cast("date")).agg(F.min("rn").alias("r0"))
    return panel.join(F.broadcast(first), F.col("rn") >= F.col("r0") - lookback).drop("r0")


# --- a panel from the star schema ---------------------------------------------------------------------------


#: Lines that a task of the panel's join takes, about.
LINES_A_TASK = 1_000_000


def tasks_for(rows: DataFrame, each: int = LINES_A_TASK) -> int:
    """How many tasks have about ``each`` rows; no fewer than a shuffle has anyway."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / each))


def trade_bars(spark: SparkSession, sf_dir: str, bucket: str = "week") -> DataFrame:
    """OHLCV by customer nation (ticker) and time bucket of shipping, sector = region.

    The unit price of a bucket is revenue over quantity; sums are decimal, so
    they don't depend on the order in which tasks end. Lines become bars of
    moments first, and these bars of buckets: so a bucket's first line is found by
    values of fixed width, and lines are hashed into their groups without sorting.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nation = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("ticker"), F.col("r_name").alias("sector"))
    owner = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    # more lines are more tasks to join and not larger ones
    tasks = tasks_for(read("lineitem"))
    # l_quantity is cast at once so that both sums aggregate on the map side
    lines = read("lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("at"), F.col("l_extendedprice").cast("decimal(18,2)").alias("value"), F.col("l_quantity").cast("decimal(18,2)").alias("qty"))
    rows = lines.repartition(tasks, "l_orderkey").join(owner.repartition(tasks, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    unit = F.round(ratio(F.col("value").cast("double"), F.col("qty").cast("double")), 6)
    # the order of (l_orderkey, l_linenumber), nulls first, as one number
    place = F.col("l_orderkey").cast("decimal(20,0)") * F.lit(2**32) + F.coalesce(F.col("l_linenumber"), F.lit(-(2**31)))
    moments = rows.groupBy("at", "ticker", "sector").agg(F.min_by(unit, place).alias("open"), F.max(unit).alias("high"), F.min(unit).alias("low"), F.sum("value").alias("value"), F.sum("qty").alias("qty"))
    at = F.coalesce("at", F.lit("1970-01-01").cast(dict(lines.dtypes)["at"]))
    total = lambda c: F.sum(c).cast("decimal(28,2)")
    return moments.groupBy(F.to_date(F.date_trunc(bucket, "at")).alias("date"), "ticker", "sector").agg(
        F.min_by("open", at).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.round(ratio(total("value").cast("double"), total("qty").cast("double")), 6).alias("close"),
        total("qty").cast("long").alias("volume"),
        total("value").alias("turnover_value"),
        total("qty").alias("turnover_qty"),
    )


def price_panel(spark: SparkSession, sf_dir: str, bucket: str = "week") -> DataFrame:
    """date, rn, ticker, sector, open, high, low, close, volume, market (the close of all tickers together), ret, market_ret."""
    # the grid reads them three times; a row a bucket and ticker
    bars = trade_bars(spark, sf_dir, bucket).persist()
    dense = densify(bars, ["sector"])
    day = Window.partitionBy("date")
    market = F.round(ratio(F.sum("turnover_value").over(day).cast("double"), F.sum("turnover_qty").over(day).cast("double")), 6)
    out = with_returns(dense.withColumn("market", market).drop("turnover_value", "turnover_qty"))
    return out.withColumn("market_ret", ratio(F.col("market"), F.lag("market").over(series("ticker"))) - 1)
