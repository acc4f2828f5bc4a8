"""A vectorised back-test of dollar-neutral portfolios with unit gross exposure."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.stats import ratio


@dataclass(frozen=True)
class Backtest:
    """Costs in basis points of turnover, rebalancing every so many rows, and the weight that yesterday's position keeps."""

    cost_bps: float = 10.0
    rebalance: int = 1
    smooth: float = 0.0

    def aligned(self, panel: DataFrame, signal: DataFrame) -> DataFrame:
        """factor, date, at (place among the dates both have), ticker, close, value: the panel's tickers on shared dates."""
        dates = panel.select("date").distinct().join(signal.select("factor", "date").distinct(), "date")
        place = dates.select("factor", "date", (F.row_number().over(Window.partitionBy("factor").orderBy("date")) - 1).alias("at"))
        cells = panel.select("date", "ticker", "close").join(place, "date")
        return cells.join(signal.select("factor", "date", "ticker", "value"), ["factor", "date", "ticker"], "left")

    def positions(self, panel: DataFrame, signal: DataFrame) -> DataFrame:
        """factor, date, at, ticker, fwd, position."""
        x = _positions(self.aligned(panel, signal), [self.rebalance], [self.smooth])
        return x.select("factor", "date", "at", "ticker", "fwd", "position")

    def run(self, panel: DataFrame, signal: DataFrame) -> DataFrame:
        """factor, date, ret, turnover of every date whose return is known. The first position is charged in full.

        A ticker without a next price earns nothing; others aren't scaled up.
        """
        x = _positions(self.aligned(panel, signal), [self.rebalance], [self.smooth])
        return _returns(x, self.cost_bps).select("factor", "date", "ret", "turnover")


#: What makes a run of a grid.
SETTING = ("rebalance", "smooth")


def _positions(aligned: DataFrame, rebalances: list[int], smooths: list[float]) -> DataFrame:
    """rebalance, smooth, factor, date, at, ticker, fwd, position of every setting of a grid.

    The targets are made once; the settings are exploded rows, so a grid of any
    size reads the panel as often as a single run does.
    """
    name = Window.partitionBy("factor", "ticker").orderBy("at")
    day = Window.partitionBy("factor", "date")
    x = aligned.withColumn("raw", F.col("value") - F.avg("value").over(day))
    gross = F.nullif(F.coalesce(F.sum(F.abs("raw")).over(day), F.lit(0.0)), F.lit(0.0))
    x = x.withColumn("target", F.coalesce(ratio(F.col("raw"), gross), F.lit(0.0)))
    x = x.withColumns({"fwd": ratio(F.lead("close").over(name), F.col("close")) - 1, "_before": F.lag("at").over(name)})
    # the target of the first row of a holding period is kept to its end
    period = lambda c, f: F.floor(F.col(c) / f)
    first = lambda f: F.when(F.col("_before").isNull() | (period("_before", f) != period("at", f)), F.col("target"))
    held = {f: F.last(first(f), ignorenulls=True).over(name.rowsBetween(Window.unboundedPreceding, 0)) if f > 1 else F.col("target") for f in dict.fromkeys(rebalances)}
    settings = F.array(*[F.struct(F.lit(f).alias("rebalance"), F.lit(float(s)).alias("smooth"), F.lit(_reach(s)).alias("_reach"), held[f].alias("position")) for f in rebalances for s in smooths])
    x = x.withColumn("_settings", settings).select("factor", "date", "at", "ticker", "fwd", F.inline("_settings"))
    return _smoothed(x) if any(smooths) else x


def _reach(smooth: float) -> int:
    """Rows after which a target weighs less than rounding does."""
    return max(1, math.ceil(math.log(1e-18) / math.log(smooth))) if smooth > 0 else 1


def _smoothed(x: DataFrame) -> DataFrame:
    """Each position with the share ``smooth`` of the one before, scaled to unit gross exposure.

    The recursion is a sum of past targets with weights smooth ** age. Summed in
    blocks of ``_reach`` rows, each from its own origin, it is a running sum of
    the block and the whole sum of the block before; older ones are past rounding.
    """
    by = [*SETTING, "factor", "ticker"]
    x = x.withColumn("_block", F.floor(F.col("at") / F.col("_reach"))).withColumn("_age", F.col("at") - F.col("_block") * F.col("_reach"))
    some = F.col("smooth") > 0
    own = F.col("position") * F.when(F.col("at") == 0, 1.0).otherwise(1 - F.col("smooth"))
    x = x.withColumn("_term", F.when(some, own / F.pow("smooth", F.col("_age"))))
    so_far = F.sum("_term").over(Window.partitionBy(*by, "_block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum("_term").over(Window.partitionBy(*by).orderBy("_block").rangeBetween(-1, -1)), F.lit(0.0))
    path = F.pow("smooth", F.col("_age")) * so_far + F.pow("smooth", F.col("_age") + F.col("_reach")) * before
    x = x.withColumn("_path", path)
    gross = F.nullif(F.sum(F.abs("_path")).over(Window.partitionBy(*SETTING, "factor", "date")), F.lit(0.0))
    return x.withColumn("position", F.when(some, F.coalesce(ratio(F.col("_path"), gross), F.lit(0.0))).otherwise(F.col("position")))


def _returns(x: DataFrame, cost_bps: float) -> DataFrame:
    """rebalance, smooth, factor, date, ret, turnover."""
    name = Window.partitionBy(*SETTING, "factor", "ticker").orderBy("at")
    x = x.withColumn("_trade", F.abs(F.col("position") - F.coalesce(F.lag("position").over(name), F.lit(0.0))))
    daily = x.groupBy(*SETTING, "factor", "date").agg(F.sum(F.col("position") * F.col("fwd")).alias("_gross"), F.sum("_trade").alias("turnover"))
    return daily.where(F.col("_gross").isNotNull()).select(*SETTING, "factor", "date", (F.col("_gross") - F.col("turnover") * cost_bps / 1e4).alias("ret"), "turnover")


def sweep(panel: DataFrame, signal: DataFrame, rebalances: list[int], smooths: list[float] = (0.0,), cost_bps: float = 10.0) -> DataFrame:
    """The back-tests of a grid in one pass: rebalance, smooth, factor, date, ret, turnover."""
    return _returns(_positions(Backtest().aligned(panel, signal), list(rebalances), list(smooths)), cost_bps)
