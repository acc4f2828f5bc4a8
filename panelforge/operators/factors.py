"""Thirteen cross-sectional factors. Higher is always the long side.

A factor is a column expression over the dense panel, so any number of them
share one sort by ticker and, where they compare tickers, one by date.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from panelforge.functions.stats import average_rank, ratio, rolling, sample_skewness, series
from panelforge.session import for_workers


def _ticker() -> WindowSpec:
    """Made when it is asked for: a window needs a session."""
    return series("ticker")


#: Denominators up to this are taken for zero.
TINY = 1e-10


class RankTree:
    """A multiset of some of the values of ``order`` (sorted, distinct), by their places: counts and sums in Fenwick trees."""

    def __init__(self, order: np.ndarray):
        self.values = order.tolist()
        self.count, self.total = [0] * (len(order) + 1), [0.0] * (len(order) + 1)
        self.top = 1 << len(order).bit_length() >> 1

    def add(self, place: int, times: int) -> None:
        value, node = self.values[place] * times, int(place) + 1
        while node < len(self.count):
            self.count[node] += times
            self.total[node] += value
            node += node & -node

    def select(self, k: int) -> float:
        """The value with ``k`` before it."""
        node, step = 0, self.top
        while step:
            if node + step < len(self.count) and self.count[node + step] <= k:
                node += step
                k -= self.count[node]
            step >>= 1
        return self.values[node]

    def below(self, place: int) -> tuple[int, float]:
        """Count and sum of those at the first ``place`` places."""
        count, total = 0, 0.0
        while place:
            count, total = count + self.count[place], total + self.total[place]
            place &= place - 1
        return count, total


class Factor:
    """A signal of its name, with the rows of history it needs. Subclass and give ``over_time``; add ``across`` to compare tickers."""

    name: str
    lookback: int
    #: Columns that the panel must have besides date, rn, ticker, close and ret.
    needs: tuple[str, ...] = ()

    def over_time(self) -> Column | list[Column]:
        """The expression over a ticker's own rows; a list is evaluated step by step, each as _step0, _step1..."""
        raise NotImplementedError(f"{type(self).__name__} needs over_time or over_series")

    #: In the place of ``over_time``, for what windows can't express: a function of a ticker's returns in order (NaN for null) that gives as many values.
    over_series: Callable[[np.ndarray], np.ndarray] | None = None

    def across(self, own: Column, panel: DataFrame) -> Column:
        """The expression over the rows of a date, from ``over_time``'s result."""
        return own


def _momentum(window: int, skip: int) -> Column:
    return ratio(F.lag("close", skip).over(_ticker()), F.lag("close", window).over(_ticker())) - 1


@dataclass
class Momentum(Factor):
    window: int = 252
    skip: int = 21

    def __post_init__(self):
        self.name, self.lookback = f"momentum_{self.window}_{self.skip}", self.window

    def over_time(self) -> Column:
        return _momentum(self.window, self.skip)


@dataclass
class CrossSectionalMomentum(Momentum):
    def __post_init__(self):
        self.name, self.lookback = f"cross_sectional_momentum_{self.window}_{self.skip}", self.window

    def across(self, own: Column, panel: DataFrame) -> Column:
        return average_rank(own, "date") / F.count(own).over(Window.partitionBy("date", own.isNotNull()))


@dataclass
class SectorNeutralMomentum(Momentum):
    """Momentum less its sector's mean. Tickers without a sector, and sectors with one ticker in the panel, have none."""

    needs = ("sector",)

    def __post_init__(self):
        self.name, self.lookback = f"sector_neutral_momentum_{self.window}_{self.skip}", self.window

    def across(self, own: Column, panel: DataFrame) -> Column:
        group = Window.partitionBy("date", "sector")
        # the grid is dense: a date's rows of a sector are all its tickers
        return F.when(F.col("sector").isNotNull() & (F.count(F.lit(1)).over(group) > 1), own - F.avg(own).over(group))


@dataclass
class RSI(Factor):
    """50 less the relative strength index by simple means."""

    window: int = 14

    def __post_init__(self):
        self.name, self.lookback = f"rsi_{self.window}", self.window

    def over_time(self) -> list[Column]:
        gain = rolling(F.avg, F.when(F.col("_step0").isNotNull(), F.greatest(F.col("_step0"), F.lit(0.0))), self.window, _ticker())
        loss = rolling(F.avg, F.when(F.col("_step0").isNotNull(), F.greatest(-F.col("_step0"), F.lit(0.0))), self.window, _ticker())
        strength = F.when((loss == 0) & (gain > 0), -50.0).otherwise(100 / (1 + ratio(gain, loss)) - 50)
        return [F.col("close") - F.lag("close").over(_ticker()), strength]


@dataclass
class BollingerZScore(Factor):
    window: int = 20

    def __post_init__(self):
        self.name, self.lookback = f"bollinger_{self.window}", self.window - 1

    def over_time(self) -> Column:
        p = F.col("close")
        return -ratio(p - rolling(F.avg, p, self.window, _ticker()), rolling(F.stddev_samp, p, self.window, _ticker()))


@dataclass
class ShortTermReversal(Factor):
    window: int = 5

    def __post_init__(self):
        self.name, self.lookback = f"short_term_reversal_{self.window}", self.window

    def over_time(self) -> Column:
        return 1 - ratio(F.col("close"), F.lag("close", self.window).over(_ticker()))


@dataclass
class LowVol(Factor):
    window: int = 21

    def __post_init__(self):
        self.name, self.lookback = f"low_volatility_{self.window}", self.window

    def over_time(self) -> Column:
        return -rolling(F.stddev_samp, F.col("ret"), self.window, _ticker())


@dataclass
class ResidualMomentum(Factor):
    """The sum of returns less beta times the market's, from ``momentum_window`` - 1 rows back to ``skip`` rows back."""

    beta_window: int = 63
    momentum_window: int = 252
    skip: int = 21
    needs = ("market_ret",)

    def __post_init__(self):
        self.name = f"residual_momentum_{self.beta_window}_{self.momentum_window}_{self.skip}"
        self.lookback = self.beta_window + self.momentum_window - 1

    def over_time(self) -> list[Column]:
        r, m = F.col("ret"), F.col("market_ret")
        frame = _ticker().rowsBetween(-(self.beta_window - 1), 0)
        whole = F.count(F.when(r.isNotNull() & m.isNotNull(), 1)).over(frame) == self.beta_window
        beta = F.when(whole, ratio(F.covar_samp(r, m).over(frame), F.var_samp(m).over(frame)))
        span = self.momentum_window - self.skip
        return [r - beta * m, rolling(F.sum, F.col("_step0"), span, _ticker(), end=self.skip)]


@dataclass
class QualityProxy(Factor):
    window: int = 252

    def __post_init__(self):
        self.name, self.lookback = f"quality_proxy_{self.window}", self.window

    def over_time(self) -> Column:
        size = rolling(F.avg, F.abs(F.col("ret")), self.window, _ticker())
        return -F.when(size > TINY, rolling(F.stddev_samp, F.col("ret"), self.window, _ticker()) / size)


@dataclass
class RollingSharpe(Factor):
    window: int = 252

    def __post_init__(self):
        self.name, self.lookback = f"rolling_sharpe_{self.window}", self.window

    def over_time(self) -> Column:
        sd = rolling(F.stddev_samp, F.col("ret"), self.window, _ticker())
        return F.when(sd > TINY, rolling(F.avg, F.col("ret"), self.window, _ticker()) / sd)


@dataclass
class RollingCVaR(Factor):
    """The mean of the returns in the window up to their linear quantile."""

    window: int = 252
    confidence: float = 0.05

    def __post_init__(self):
        self.name, self.lookback = f"rolling_cvar_{self.window}_{int(self.confidence * 100)}", self.window

    def over_series(self, ret: np.ndarray) -> np.ndarray:
        """A rank tree holds the window: two selections and a sum of a tail a row, each in logarithmic time."""
        there, out = ~np.isnan(ret), np.full(len(ret), np.nan)
        order = np.unique(ret[there])
        rank = np.searchsorted(order, ret)
        tree, held = RankTree(order), 0
        at = (self.window - 1) * self.confidence
        low, high = int(at), min(int(at) + 1, self.window - 1)
        for t in range(len(ret)):
            if there[t]:
                tree.add(rank[t], 1)
                held += 1
            if t >= self.window and there[t - self.window]:
                tree.add(rank[t - self.window], -1)
                held -= 1
            if held == self.window:
                a, b = tree.select(low), tree.select(high)
                count, total = tree.below(int(np.searchsorted(order, a + (b - a) * (at - low), "right")))
                out[t] = total / count
        return out


@dataclass
class RollingMaxDrawdown(Factor):
    """The deepest fall from a peak inside the window; the first peak is the first value of the window."""

    window: int = 252

    def __post_init__(self):
        self.name, self.lookback = f"rolling_max_drawdown_{self.window}", self.window

    def over_time(self) -> list[Column]:
        """The series is cut into blocks as long as the window, so a window is the end of one block and the beginning of the next.

        The deepest fall of both together is that of either, or from the first's
        highest level to the second's lowest. Beginnings and ends of blocks have
        running summaries, so a row costs the same whatever the window.
        """
        w, ret = self.window, F.col("ret")
        block = Window.partitionBy("ticker", "_step0")
        begun, ends = (block.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in ("rn", F.desc("rn")))
        so_far = _ticker().rowsBetween(Window.unboundedPreceding, 0)
        steps = [
            F.floor((F.row_number().over(_ticker()) - 1) / w),
            F.when(ret > -1, 1 + ret).otherwise(1.0),
            F.product("_step1").over(begun),
            F.struct(F.max("_step2").over(begun).alias("max"), F.min("_step2").over(begun).alias("min")),
            F.min(F.col("_step2") / F.col("_step3.max")).over(begun),
            F.struct(F.max("_step2").over(ends).alias("max"), F.min("_step2").over(ends).alias("min"), F.first("_step2").over(ends).alias("end")),
            F.min(F.col("_step5.min") / F.col("_step2")).over(ends),
            F.struct(F.count(ret).over(so_far).alias("n"), F.count(F.when(ret <= -1, 1)).over(so_far).alias("lost")),
            F.lag(F.struct(F.col("_step0").alias("block"), "_step5.max", "_step5.end", F.col("_step6").alias("worst"), "_step7.lost", "ret"), w - 1).over(_ticker()),
        ]
        first = F.col("_step8")
        whole = F.col("_step7.n") - F.coalesce(F.lag("_step7.n", w).over(_ticker()), F.lit(0)) == w
        across = F.least(first["worst"], F.col("_step4"), first["end"] * F.col("_step3.min") / first["max"])
        kept = F.when(first["block"] == F.col("_step0"), F.col("_step4")).otherwise(across)
        # a level of nothing has no peak to fall from; after one that lost everything there is none either
        fall = F.when(first["ret"] <= -1, 0.0).when(F.col("_step7.lost") > first["lost"], -1.0).otherwise(kept - 1)
        return [*steps, F.when(first.isNotNull() & whole, fall)]


@dataclass
class RollingSkewness(Factor):
    window: int = 252

    def __post_init__(self):
        self.name, self.lookback = f"rolling_skewness_{self.window}", self.window

    def over_time(self) -> Column:
        frame = _ticker().rowsBetween(-(self.window - 1), 0)
        skew = sample_skewness(F.col("ret"), lambda c: c.over(frame))
        return -F.when(F.count("ret").over(frame) == self.window, skew)


ALL = [Momentum, CrossSectionalMomentum, RSI, BollingerZScore, ShortTermReversal, LowVol, ResidualMomentum, SectorNeutralMomentum, QualityProxy, RollingSharpe, RollingCVaR, RollingMaxDrawdown, RollingSkewness]


def _by_series(panel: DataFrame, functions: dict[str, Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """``panel`` with a column for each function of a ticker's returns. A ticker's rows, one a date, are in one task, as windows have them too."""
    schema = reduce(lambda s, c: s.add(c, "double"), functions, T.StructType(list(panel.schema.fields)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rn")
        ret = table["ret"].to_numpy().astype(float)
        for name, function in functions.items():
            found = function(ret)
            table = table.append_column(name, pa.array(found, mask=np.isnan(found)))
        return table

    return for_workers(panel).groupBy("ticker").applyInArrow(run, schema)


def compute(panel: DataFrame, factors: list[Factor]) -> DataFrame:
    """factor, date, rn, ticker, value for every cell of the panel and every factor."""
    names = [f.name for f in factors]
    if len(set(names)) < len(names):
        raise ValueError("two factors have the same name")
    for f in factors:
        if missing := [c for c in f.needs if c not in panel.columns]:
            raise ValueError(f"{f.name} needs {', '.join(missing)}")
    out = panel if "ret" in panel.columns else panel.withColumn("ret", ratio(F.col("close"), F.lag("close").over(_ticker())) - 1)
    for k, f in enumerate(factors):
        if f.over_series:
            continue
        steps = f.over_time()
        steps = steps if isinstance(steps, list) else [steps]
        for i, step in enumerate(steps[:-1]):
            out = out.withColumn(f"_step{i}", step)
        out = out.withColumn(f"_own{k}", steps[-1]).drop(*[f"_step{i}" for i in range(len(steps) - 1)])
    # after the windows, which use the panel's own partitioning; what it gives out is dealt anew by date, if at all
    if in_order := {f"_own{k}": f.over_series for k, f in enumerate(factors) if f.over_series}:
        out = _by_series(out, in_order)
    for k, f in enumerate(factors):
        out = out.withColumn(f"_own{k}", f.across(F.col(f"_own{k}"), panel))
    each = [F.struct(F.lit(f.name).alias("factor"), F.col(f"_own{k}").cast("double").alias("value")) for k, f in enumerate(factors)]
    return out.select("date", "rn", "ticker", F.array(*each).alias("x")).select(F.inline("x"), "date", "rn", "ticker").select("factor", "date", "rn", "ticker", "value")


def compute_from(panel: DataFrame, factors: list[Factor], start: str) -> DataFrame:
    """``compute`` for the dates from ``start`` on, over only as much history as the factors look back on."""
    from panelforge.sources.panel import window_rows

    slim = window_rows(panel, start, max(f.lookback for f in factors))
    return compute(slim, factors).where(F.col("date") >= F.lit(start).cast("date"))
