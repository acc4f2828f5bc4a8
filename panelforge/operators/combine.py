"""Signal combiners: several factors into one."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.stats import ratio, zscore
from panelforge.operators.ic import compute_ic
from panelforge.session import for_workers
from panelforge.sources.panel import forward_returns

OUT = ("factor", "date", "rn", "ticker", "value")


def zscored(signals: DataFrame) -> DataFrame:
    """The signals with z, their cross-sectional z-score."""
    return signals.withColumn("z", zscore(F.col("value"), "factor", "date"))


@dataclass
class EqualWeight:
    """The mean of the z-scores there are."""

    name: str = "equal_weight"

    def combine(self, signals: DataFrame, panel: DataFrame | None = None) -> DataFrame:
        return zscored(signals).groupBy("date", "rn", "ticker").agg(F.avg("z").alias("value")).select(F.lit(self.name).alias("factor"), *OUT[1:])


#: Half-lives of a block: its weights stay below 2 ** 64.
BLOCK = 64


def ewm_mean(series: DataFrame, value: str, halflife: float) -> DataFrame:
    """``series`` (factor, rn) with ewm, the mean so far with weights 0.5 ** (age / halflife); a null counts as age only.

    Weights are taken from the origin of a block of rows, and blocks before come
    in by their sums, scaled by their age: no weight overflows, however long the
    series is. Where ``value`` is null the last mean stands.
    """
    half = F.lit(float(halflife))
    length = F.lit(max(1, int(BLOCK * halflife)))
    x = series.withColumn("_block", F.floor(F.col("rn") / length))
    up = F.when(F.col(value).isNotNull(), F.pow(F.lit(2.0), (F.col("rn") - F.col("_block") * length) / half))
    x = x.withColumns({"_n": F.col(value) * up, "_d": up})
    run = Window.partitionBy("factor", "_block").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("factor").orderBy("rn")
    x = x.withColumns({"_n": F.coalesce(F.sum("_n").over(run), F.lit(0.0)), "_d": F.coalesce(F.sum("_d").over(run), F.lit(0.0))})
    # the last row of a block has its sums; a null isn't collected
    x = x.withColumn("_end", F.when(F.lead("_block").over(whole) > F.col("_block"), F.struct("_block", "_n", "_d")))
    x = x.withColumn("_past", F.collect_list("_end").over(whole.rowsBetween(Window.unboundedPreceding, -1)))
    carried = lambda c: F.aggregate("_past", F.col(c), lambda acc, b: acc + b[c] * F.pow(F.lit(2.0), (b["_block"] - F.col("_block")) * length / half))
    x = x.withColumn("_at", F.when(F.col(value).isNotNull(), carried("_n") / carried("_d")))
    return x.withColumn("ewm", F.last("_at", ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, 0))).select(*series.columns, "ewm")


@dataclass
class ICWeighted:
    """z-scores weighted by each factor's past one-row coefficient: a rolling or an exponentially weighted mean, one row late, shrunk toward equal weights."""

    lookback: int = 252
    shrinkage: float = 0.5
    use_ewm: bool = False
    halflife: int = 126
    name: str = "ic_weighted"
    #: How many factors there are; counted if it isn't given.
    factors: int | None = None

    def weights(self, signals: DataFrame, panel: DataFrame) -> DataFrame:
        """factor, date, rn, weight; absolute weights of a date sum to 1 over the factors that have one."""
        ic = compute_ic(signals, forward_returns(panel, [1])).select("factor", "date", "rn", "ic")
        w = Window.partitionBy("factor").orderBy("rn")
        if self.use_ewm:
            means = ewm_mean(ic, "ic", self.halflife).withColumnRenamed("ewm", "mean")
        else:
            run = w.rowsBetween(-(self.lookback - 1), 0)
            means = ic.withColumn("mean", F.when(F.count("ic").over(run) == self.lookback, F.avg("ic").over(run)))
        past = means.withColumn("past", F.lag("mean").over(w))
        k = F.lit(float(self.factors or signals.select("factor").distinct().count()))
        raw = past.withColumn("raw", (1 - self.shrinkage) * F.col("past") + self.shrinkage / k)
        gross = F.sum(F.abs("raw")).over(Window.partitionBy("date"))
        return raw.select("factor", "date", "rn", ratio(F.col("raw"), F.nullif(gross, F.lit(0.0))).alias("weight"))

    def combine(self, signals: DataFrame, panel: DataFrame) -> DataFrame:
        # one weight a factor and date: small, and the join is left to Spark
        weights = self.weights(signals, panel).select("factor", "date", "weight")
        joined = zscored(signals).join(weights, ["factor", "date"], "left")
        return joined.groupBy("date", "rn", "ticker").agg(F.sum(F.col("z") * F.col("weight")).alias("value")).select(F.lit(self.name).alias("factor"), *OUT[1:])


@dataclass
class RollingLasso:
    """z-scores times the coefficients of a lasso on the ``lookback`` rows before.

    The lasso needs only sums over its rows, and those of a window are sums of
    the dates' sums: K * K numbers a date are shuffled, not its training rows.
    Its coefficients are piecewise linear in the penalty, so one path a date
    (``lasso_path``) gives those of every penalty.
    """

    lookback: int = 252
    alpha: float = 0.001
    name: str = "lasso"

    def coefficients(self, signals: DataFrame, panel: DataFrame, names: list[str], alphas: list[float] | None = None) -> DataFrame:
        """date, rn, alpha, coef (array in the order of ``names``; null where no training row is whole) of the dates after the first ``lookback``."""
        k, alphas = len(names), [self.alpha] if alphas is None else list(alphas)
        forward = forward_returns(panel, [1]).select("date", "ticker", F.col("fwd").alias("y"))
        wide = self._wide(signals, names).join(forward, ["date", "ticker"], "left")
        whole = reduce(lambda a, b: a & b, [F.col(f"z{i}").isNotNull() for i in range(k)] + [F.col("y").isNotNull()])
        cell = lambda c: F.coalesce(F.sum(F.when(whole, c)), F.lit(0.0))
        sums = [cell(F.lit(1.0)).alias("n"), cell(F.col("y")).alias("sy"), cell(F.col("y") * F.col("y")).alias("syy")]
        sums += [cell(F.col(f"z{i}")).alias(f"s{i}") for i in range(k)] + [cell(F.col(f"z{i}") * F.col("y")).alias(f"c{i}") for i in range(k)]
        sums += [cell(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
        daily = wide.groupBy("date", "rn").agg(*sums)
        past = Window.orderBy("rn").rowsBetween(-self.lookback, -1)  # one row a date
        cols = [c for c in daily.columns if c not in ("date", "rn")]
        rolled = daily.select("date", "rn", *[F.sum(c).over(past).alias(c) for c in cols]).where(F.col("rn") >= self.lookback)

        # the window above is one task, the paths needn't be
        rolled = rolled.repartition(int(rolled.sparkSession.conf.get("spark.sql.shuffle.partitions")), "date")

        def solve(frames):
            for frame in frames:
                paths = [_of_sums(r, k, alphas) for r in frame.to_dict("records")]
                yield pd.DataFrame({"date": frame["date"].repeat(len(alphas)), "rn": frame["rn"].repeat(len(alphas)), "alpha": alphas * len(frame), "coef": [c for path in paths for c in path]})

        return for_workers(rolled).mapInPandas(solve, "date date, rn int, alpha double, coef array<double>")

    @staticmethod
    def _wide(signals: DataFrame, names: list[str]) -> DataFrame:
        z = zscored(signals)
        return z.groupBy("date", "rn", "ticker").agg(*[F.max(F.when(F.col("factor") == n, F.col("z"))).alias(f"z{i}") for i, n in enumerate(names)])

    def sweep(self, signals: DataFrame, panel: DataFrame, alphas: list[float], names: list[str] | None = None) -> DataFrame:
        """``combine`` for many penalties at once; the factor is the name and the penalty, as in ``lasso_0.001``."""
        names = names or sorted(r["factor"] for r in signals.select("factor").distinct().collect())
        coef = self.coefficients(signals, panel, names, alphas)
        by_date = coef.groupBy("date").agg(F.collect_list(F.struct("alpha", "coef")).alias("c"))
        joined = self._wide(signals, names).join(by_date, "date", "left")
        none = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(None).cast("array<double>").alias("coef")) for a in alphas])
        each = joined.withColumn("c", F.explode(F.coalesce("c", none)))
        label = F.create_map(*[x for a in alphas for x in (F.lit(float(a)), F.lit(f"{self.name}_{a:g}"))])
        return each.select(label[F.col("c.alpha")].alias("factor"), "date", "rn", "ticker", self._value("c.coef", names).alias("value"))

    @staticmethod
    def _value(coef: str, names: list[str]) -> Column:
        """Null if any factor is, even with a coefficient of zero."""
        return reduce(lambda a, b: a + b, [F.col(f"z{i}") * F.get(F.col(coef), F.lit(i)) for i in range(len(names))])

    def combine(self, signals: DataFrame, panel: DataFrame, names: list[str] | None = None) -> DataFrame:
        names = names or sorted(r["factor"] for r in signals.select("factor").distinct().collect())
        joined = self._wide(signals, names).join(self.coefficients(signals, panel, names).select("date", "coef"), "date", "left")
        return joined.select(F.lit(self.name).alias("factor"), "date", "rn", "ticker", self._value("coef", names).alias("value"))


def _of_sums(sums: dict, k: int, alphas: list[float]) -> list[list[float] | None]:
    """The coefficients at each penalty out of one window's sums; the target is standardised where it varies."""
    n = sums["n"]
    if not n or n != n:
        return [None] * len(alphas)
    mean = sums["sy"] / n
    sd = max(sums["syy"] / n - mean * mean, 0.0) ** 0.5
    c = np.array([(sums[f"c{i}"] - mean * sums[f"s{i}"]) / sd if sd > 0 else sums[f"c{i}"] for i in range(k)])
    g = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    return [b.tolist() for b in lasso_path(g / n, c / n, alphas)]


def lasso_path(gram: np.ndarray, corr: np.ndarray, alphas: list[float]) -> list[np.ndarray]:
    """Minimisers of b'Gb / 2 - c'b + alpha |b|, for each alpha, by following the path from the largest penalty down.

    While the active set stays, coefficients are linear in the penalty. It changes
    where an inactive column's correlation with what is left reaches the penalty,
    which lets it in, or where an active coefficient reaches zero, which drops it.
    A column that the active ones already span (or that is all zero) never enters.
    """
    k, tiny = len(corr), 1e-12
    found: list[np.ndarray | None] = [None] * len(alphas)
    todo = sorted(range(len(alphas)), key=lambda i: -alphas[i])
    active: list[int] = []
    sign = np.zeros(k)
    shut: set[int] = {i for i in range(k) if gram[i, i] <= tiny}  # spanned by the active set as it is
    penalty, dropped = np.inf, None

    def at(alpha: float) -> np.ndarray:
        b = np.zeros(k)
        if active:
            b[active] = np.linalg.solve(gram[np.ix_(active, active)], corr[active] - alpha * sign[active])
        return b

    for _ in range(8 * k * k + 16):  # each turn is a knot of the path
        # b = p - alpha q on the active set, and what is left of the correlations is u + alpha v
        p, q = np.zeros(k), np.zeros(k)
        if active:
            p[active], q[active] = np.linalg.solve(gram[np.ix_(active, active)], np.stack([corr[active], sign[active]], 1)).T
        u, v = corr - gram @ p, gram @ q
        knots: list[tuple[float, int, float]] = []
        for i in range(k):
            if i in active:
                if q[i] and 0 <= p[i] / q[i] < penalty - tiny * max(1.0, penalty if penalty < np.inf else 1.0):
                    knots.append((p[i] / q[i], i, 0.0))
            elif i not in shut:
                for s in (1.0, -1.0):
                    if abs(s - v[i]) > tiny:
                        knot = u[i] / (s - v[i])
                        late = i == dropped and knot > penalty - 1e-9 * max(1.0, penalty)
                        if 0 < knot <= penalty and not late:
                            knots.append((knot, i, s))
        alpha, i, s = max(knots, default=(0.0, -1, 0.0))
        while todo and alphas[todo[0]] >= alpha:
            found[todo[0]] = at(alphas[todo[0]])
            todo.pop(0)
        if not todo or i < 0:
            break
        penalty, dropped = alpha, None
        if s == 0.0:
            active.remove(i)
            sign[i], dropped = 0.0, i
            shut = {j for j in range(k) if gram[j, j] <= tiny}
        else:
            block = gram[np.ix_([*active, i], [*active, i])]
            scale = np.sqrt(np.diag(block))
            if np.linalg.eigvalsh(block / np.outer(scale, scale))[0] <= 1e-10:
                shut.add(i)
            else:
                active.append(i)
                sign[i] = s
    return [settled(gram, corr, alphas[i], at(alphas[i]) if b is None else b) for i, b in enumerate(found)]


def settled(gram: np.ndarray, corr: np.ndarray, alpha: float, b: np.ndarray, rounds: int = 5000, tolerance: float = 1e-12) -> np.ndarray:
    """``b``, if it is the minimiser; else, where columns that are alike reach a knot together, coordinate descent from there."""
    left = corr - gram @ b
    wrong = np.where(b != 0, np.abs(left - alpha * np.sign(b)), np.maximum(np.abs(left) - alpha, 0))
    if wrong.max(initial=0.0) <= 1e-9 * max(1.0, np.abs(corr).max(initial=0.0)):
        return b
    b = b.copy()
    for _ in range(rounds):
        change = 0.0
        for i in np.flatnonzero(np.diag(gram) > 0):
            r = corr[i] - gram[i] @ b + gram[i, i] * b[i]
            new = np.sign(r) * max(abs(r) - alpha, 0.0) / gram[i, i]
            change, b[i] = max(change, abs(new - b[i])), new
        if change <= tolerance:
            break
    return b
