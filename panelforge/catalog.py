"""Every registered query of the signal engine, with its independent SQL oracle."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge import catalog_sources
from panelforge import catalog_sql as q
from panelforge.functions.stats import rounded
from panelforge.operators import combine, diagnostics, ic, metrics
from panelforge.operators import factors as fx
from panelforge.operators.backtest import Backtest, sweep
from panelforge.plans import research, tearsheet
from panelforge.plans.report import ReportConfig, SignalReport
from panelforge.sources import fundamentals, store, universe
from panelforge.sources.panel import forward_returns, price_panel, trade_bars

Query = Callable[[SparkSession, str], DataFrame]
_PANELS: dict[tuple, DataFrame] = {}
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def panel_of(spark: SparkSession, sf_dir: str, bucket: str = "week") -> DataFrame:
    """The panel, kept in memory or on disk for the queries of one session."""
    key = (spark.sparkContext.applicationId, sf_dir, bucket)
    if key not in _PANELS:
        _PANELS[key] = price_panel(spark, sf_dir, bucket).repartition("ticker").persist()
    return _PANELS[key]


def on_panel(oracle: str | None = None, digits: int = 6):
    """Register a function of the panel; its doubles are rounded."""

    def register(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(panel_of(spark, sf_dir)), digits)
        if oracle is not None:
            _ORACLES[f.__name__] = oracle
        return f

    return register


def on_tables(oracle: str | None = None):
    """Register a function of the session and the folder of tables."""

    def register(f):
        _QUERIES[f.__name__] = f
        if oracle is not None:
            _ORACLES[f.__name__] = oracle
        return f

    return register


MOM, REV, VOL = fx.Momentum(26, 4), fx.ShortTermReversal(5), fx.LowVol(21)


def sig(panel: DataFrame, n: int) -> DataFrame:
    return fx.compute(panel, [MOM, REV, VOL][:n])


def ics(panel: DataFrame, n: int, *horizons: int) -> DataFrame:
    return ic.compute_ic(sig(panel, n), forward_returns(panel, list(horizons)))


r, chain = q.r, q.chain

# --- panel --------------------------------------------------------------------------------------------------


@on_tables(chain(select="SELECT date, ticker, sector, open, high, low, close, volume FROM bars"))
def panel_ohlcv(spark, sf_dir):
    return trade_bars(spark, sf_dir).drop("turnover_value", "turnover_qty")


@on_panel(chain(select=f"SELECT date, rn, ticker, sector, close, volume, market, {r('ret', 'ret')}, {r('market_ret', 'market_ret')} FROM panel"))
def panel_dense(p):
    return p.select("date", "rn", "ticker", "sector", "close", "volume", "market", "ret", "market_ret")


@on_panel(chain(select=f"SELECT ticker, min(date) FILTER (close IS NOT NULL) AS first_date, count(close) AS n_valid, {r('100.0::DOUBLE * count(close) / count(*)', 'coverage_pct')}, min(date) FILTER (close IS NOT NULL) - (SELECT min(date) FROM days) > 5 AS late FROM panel GROUP BY ticker"))
def coverage(p):
    return research.coverage(p)


@on_panel(chain(select="SELECT count(*) AS n_dates, CAST(count(*) FILTER (n = k) AS BIGINT) AS n_complete, count(*) FILTER (n > 0) AS n_any FROM (SELECT count(close) AS n, count(*) AS k FROM panel GROUP BY date)"))
def usable_dates(p):
    return research.usable_dates(p)


@on_panel(chain(q.forward(1, 5, 21), select=f"SELECT horizon, date, rn, ticker, {r('fwd', 'fwd')} FROM fwd"))
def forward_returns_1_5_21(p):
    return forward_returns(p, [1, 5, 21]).select("horizon", "date", "rn", "ticker", "fwd")


@on_panel(chain("f AS (SELECT ticker, arg_min(close, rn) FILTER (close IS NOT NULL) AS c FROM panel GROUP BY ticker)", select=f"SELECT date, ticker, {r('100 * close / c', 'base100')} FROM panel JOIN f USING (ticker)"))
def base100(p):
    return research.base_100(p)


@on_panel(chain(select="SELECT date, ticker, " + ", ".join(r(f"({q.full('stddev_samp({x})', 'ret', w)}) * sqrt(252)", f"vol_{w}") for w in (5, 21, 63)) + " FROM panel"))
def rolling_vol(p):
    return research.rolling_volatility(p)


@on_panel(chain(select=f"SELECT a.ticker AS ticker_a, b.ticker AS ticker_b, {r('corr(a.ret, b.ret)', 'corr')} FROM panel a JOIN panel b USING (date) GROUP BY 1, 2"))
def return_corr_matrix(p):
    return research.return_correlations(p)


@on_panel(chain(q.forward(1, 5, 21), select=f"SELECT horizon, count(fwd) AS n, {r('1e4 * avg(fwd)', 'mean_bps', 4)}, {r('1e4 * stddev_samp(fwd)', 'std_bps', 4)}, {r('skewness(fwd)', 'skew', 4)}, {r('kurtosis(fwd)', 'kurt', 4)} FROM fwd GROUP BY horizon"), digits=4)
def fwd_moments(p):
    return research.forward_moments(p, [1, 5, 21])


@on_panel(chain("e AS (SELECT min(ret) AS a, (max(ret) - min(ret)) / 50 AS w FROM panel)", "b AS (SELECT CAST(least(floor((ret - a) / w), 49) AS INTEGER) AS bin, count(*) AS n, any_value(a) AS a, any_value(w) AS w FROM panel, e WHERE ret IS NOT NULL GROUP BY 1)", select=f"SELECT bin, {r('a + bin * w', 'low')}, n, {r('n / (sum(n) OVER () * w)', 'density')} FROM b"))
def return_histogram(p):
    return research.histogram(p, "ret")


@on_panel(chain(select=f"SELECT ticker, {r('stddev_samp(ret)', 'vol')} FROM panel GROUP BY ticker ORDER BY stddev_samp(ret) DESC, ticker LIMIT 1"))
def most_volatile(p):
    return research.most_volatile(p)


# --- factors ------------------------------------------------------------------------------------------------


def _register_factor(factor: fx.Factor) -> None:
    _QUERIES[f"factor_{factor.name}"] = lambda spark, sf_dir: rounded(fx.compute(panel_of(spark, sf_dir), [factor]))
    _ORACLES[f"factor_{factor.name}"] = q.factor_sql(factor.name)


for _factor in fx.ALL:
    _register_factor(_factor())


@on_panel(chain(q.SIG3, select=f"SELECT factor, date, rn, ticker, {r('value', 'value')} FROM sig WHERE date >= DATE '2000-01-03'"))
def factors_pruned_by_lookback(p):
    """Late dates from only as much history as they need."""
    return fx.compute_from(p, [MOM, REV, VOL], "2000-01-03")


# --- combination --------------------------------------------------------------------------------------------


@on_panel(chain(q.SIG3, q.Z, select=f"SELECT factor, date, rn, ticker, {r('z', 'z')} FROM zs"))
def zscore(p):
    return combine.zscored(sig(p, 3)).select("factor", "date", "rn", "ticker", "z")


@on_panel(chain(q.SIG3, q.Z, select=f"SELECT 'equal_weight' AS factor, date, rn, ticker, {r('avg(z)', 'value')} FROM zs GROUP BY date, rn, ticker"))
def equal_weight(p):
    return combine.EqualWeight().combine(sig(p, 3))


def _weighted(mean: str, k: int, shrinkage: float, out: str = "cb") -> list[str]:
    """A combination ``out``; the tables on the way to it are named after it."""
    parts = [
        f"me AS (SELECT factor, date, rn, {mean} AS mean FROM ic)",
        "pa AS (SELECT *, lag(mean) OVER (PARTITION BY factor ORDER BY rn) AS past FROM me)",
        f"wr AS (SELECT factor, date, rn, {1 - shrinkage}::DOUBLE * past + {shrinkage}::DOUBLE / {k} AS raw FROM pa)",
        "we AS (SELECT factor, date, rn, raw / nullif(sum(abs(raw)) OVER (PARTITION BY date), 0) AS weight FROM wr)",
        "cb AS (SELECT z.date, z.rn, z.ticker, sum(z.z * w.weight) AS value FROM zs z LEFT JOIN we w ON z.factor = w.factor AND z.date = w.date GROUP BY z.date, z.rn, z.ticker)",
    ]
    if out == "cb":
        return parts
    return [re.sub(r"\b(me|pa|wr|we|cb)\b", rf"\1_{out}", part) for part in parts]


FLAT = "CASE WHEN count(ic) OVER f = 52 THEN avg(ic) OVER f END".replace("OVER f", "OVER (PARTITION BY factor ORDER BY rn ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)")
EWM = "sum(ic * pow(2.0::DOUBLE, rn / 26.0::DOUBLE)) OVER (PARTITION BY factor ORDER BY rn) / nullif(sum(CASE WHEN ic IS NOT NULL THEN pow(2.0::DOUBLE, rn / 26.0::DOUBLE) END) OVER (PARTITION BY factor ORDER BY rn), 0)"


@on_panel(chain(q.SIG3, q.forward(1), q.IC, q.Z, *_weighted(FLAT, 3, 0.5), select=f"SELECT 'ic_weighted' AS factor, date, rn, ticker, {r('value', 'value')} FROM cb"))
def ic_weighted_flat(p):
    return combine.ICWeighted(lookback=52).combine(sig(p, 3), p)


@on_panel(chain(q.SIG3, q.forward(1), q.IC, q.Z, *_weighted(EWM, 3, 0.25), select=f"SELECT 'ic_weighted' AS factor, date, rn, ticker, {r('value', 'value')} FROM cb"))
def ic_weighted_ewm(p):
    return combine.ICWeighted(shrinkage=0.25, use_ewm=True, halflife=26).combine(sig(p, 3), p)


LASSO1 = [
    "ly AS (SELECT z.date, z.rn, z.ticker, z.z, f.fwd AS y FROM zs z LEFT JOIN fwd f ON z.date = f.date AND z.ticker = f.ticker)",
    "ld AS (SELECT date, rn, coalesce(sum(1.0::DOUBLE) FILTER (z IS NOT NULL AND y IS NOT NULL), 0) AS n, coalesce(sum(y) FILTER (z IS NOT NULL), 0) AS sy, coalesce(sum(y * y) FILTER (z IS NOT NULL), 0) AS syy, coalesce(sum(z) FILTER (y IS NOT NULL), 0) AS s, coalesce(sum(z * y), 0) AS c, coalesce(sum(z * z) FILTER (y IS NOT NULL), 0) AS g FROM ly GROUP BY date, rn)",
    "lr AS (SELECT date, rn, sum(n) OVER w AS n, sum(sy) OVER w AS sy, sum(syy) OVER w AS syy, sum(s) OVER w AS s, sum(c) OVER w AS c, sum(g) OVER w AS g FROM ld WINDOW w AS (ORDER BY rn ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING))",
    "lc AS (SELECT date, rn, n, g, (c - sy / n * s) / sqrt(syy / n - (sy / n) * (sy / n)) AS c FROM lr WHERE rn >= 52 AND n > 0)",
    "lb AS (SELECT date, CASE WHEN abs(c) > n * 0.001 THEN sign(c) * (abs(c) - n * 0.001) / g ELSE 0 END AS b FROM lc)",
]


@on_panel(chain(q.SIG1, q.forward(1), q.Z, *LASSO1, select=f"SELECT 'lasso' AS factor, z.date, z.rn, z.ticker, {r('z.z * b', 'value')} FROM zs z LEFT JOIN lb ON z.date = lb.date"))
def lasso_k1(p):
    return combine.RollingLasso(lookback=52).combine(sig(p, 1), p)


_F3 = ["low_volatility_21", "momentum_26_4", "short_term_reversal_5"]


def _lasso3(alphas: list[float]) -> list[str]:
    """Coordinate descent on the windows' sums, 120 rounds of a recursive query; the columns are in the order of the factors' names."""
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    g = lambda i, j: f"g{min(i, j)}{max(i, j)}"
    sums = ["sum(1.0::DOUBLE) {f} AS n", "sum(y) {f} AS sy", "sum(y * y) {f} AS syy", *[f"sum(z{i}) {{f}} AS s{i}" for i in range(3)], *[f"sum(z{i} * y) {{f}} AS c{i}" for i in range(3)], *[f"sum(z{i} * z{j}) {{f}} AS {g(i, j)}" for i, j in pairs]]
    cols = [x.split(" AS ")[1] for x in sums]
    soft = lambda i, b: f"(sign(c{i} - {b}) * greatest(abs(c{i} - ({b})) - n * alpha, 0) / {g(i, i)})".replace(f"sign(c{i} - {b})", f"sign(c{i} - ({b}))")
    return [
        "lw AS (SELECT date, rn, ticker, " + ", ".join(f"max(z) FILTER (factor = '{n}') AS z{i}" for i, n in enumerate(_F3)) + " FROM zs GROUP BY date, rn, ticker)",
        "ly AS (SELECT w.*, f.fwd AS y, z0 + z1 + z2 + f.fwd IS NOT NULL AS whole FROM lw w LEFT JOIN fwd f ON w.date = f.date AND w.ticker = f.ticker)",
        "ld AS (SELECT date, rn, " + ", ".join(f"coalesce({x.format(f='FILTER (whole)').replace(' AS ', ', 0) AS ')}" for x in sums) + " FROM ly GROUP BY date, rn)",
        "lr AS (SELECT date, rn, " + ", ".join(f"sum({c}) OVER w AS {c}" for c in cols) + " FROM ld WINDOW w AS (ORDER BY rn ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING))",
        "lc AS (SELECT date, alpha, n, " + ", ".join(f"(c{i} - sy / n * s{i}) / sqrt(syy / n - (sy / n) * (sy / n)) AS c{i}" for i in range(3)) + ", " + ", ".join(g(i, j) for i, j in pairs) + f" FROM lr, (SELECT unnest({alphas!r})::DOUBLE AS alpha) WHERE rn >= 52 AND n > 0)",
        "li AS (SELECT date, alpha, 0 AS k, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM lc UNION ALL "
        f"SELECT date, alpha, k + 1, x0, x1, {soft(2, 'g02 * x0 + g12 * x1')} FROM (SELECT *, {soft(1, 'g01 * x0 + g12 * b2')} AS x1 FROM (SELECT li.k, li.b1, li.b2, lc.*, {soft(0, 'g01 * b1 + g02 * b2')} AS x0 FROM li JOIN lc USING (date, alpha) WHERE k < 120)))",
        "lb AS (SELECT * FROM li WHERE k = 120)",
    ]


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@on_panel(_recursive(chain(q.SIG3, q.forward(1), q.Z, *_lasso3([0.001]), select=f"SELECT 'lasso' AS factor, w.date, w.rn, w.ticker, {r('z0 * b0 + z1 * b1 + z2 * b2', 'value')} FROM lw w LEFT JOIN lb ON w.date = lb.date")))
def lasso_k3(p):
    return combine.RollingLasso(lookback=52).combine(sig(p, 3), p)


_ALPHAS = [0.0001, 0.001, 0.01]


@on_panel(_recursive(chain(q.SIG3, q.forward(1), q.Z, *_lasso3(_ALPHAS), "fs AS (SELECT 'lasso_' || alpha AS factor, w.date, w.rn, w.ticker, z0 * b0 + z1 * b1 + z2 * b2 AS value FROM lw w JOIN lb ON w.date = lb.date QUALIFY count(z0 + z1 + z2) OVER (PARTITION BY alpha, w.date) > 0)", *q.backtest("fs", rebalance=5), select=f"SELECT factor, {r('product(1 + ret) - 1', 'total_return')} FROM bt GROUP BY factor")))
def lasso_alpha_sweep(p):
    """Total return by penalty, all penalties from one path a date; those that leave no live dates have none."""
    swept = combine.RollingLasso(lookback=52).sweep(sig(p, 3), p, _ALPHAS)
    return metrics.total_return(Backtest(10, 5).run(p, swept.where("value is not null")), ["factor"])


# --- coefficients -------------------------------------------------------------------------------------------

IC3 = [q.SIG3, q.forward(1, 5), q.IC]


@on_panel(chain(*IC3, select=f"SELECT factor, horizon, date, rn, {r('ic', 'ic')}, n_valid FROM ic"))
def ic_daily(p):
    return ics(p, 3, 1, 5).select("factor", "horizon", "date", "rn", "ic", "n_valid")


_SUMMARY = f"SELECT factor, horizon, {r('avg(ic)', 'mean')}, {r('stddev_samp(ic)', 'std')}, {r('avg(ic) / nullif(stddev_samp(ic), 0)', 'icir')}, {r('avg(CASE WHEN ic > 1e-12 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END)', 'hit_rate')}, {r('avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic))', 't_stat')}, count(ic) AS n_dates, {r('avg(n_valid)', 'avg_coverage')}, max(bandwidth) AS bandwidth, {r('max(se_nw)', 'se_nw')}, {r('max(t_nw)', 't_nw')} FROM ic LEFT JOIN nw USING (factor, horizon) GROUP BY factor, horizon"


@on_panel(chain(*IC3, q.NW, select=_SUMMARY))
def ic_summary(p):
    return ic.summary(ics(p, 3, 1, 5))


@on_panel(chain(*IC3, q.NW, select=f"SELECT factor, horizon, n, bandwidth, {r('se_nw', 'se_nw')}, {r('t_nw', 't_nw')}, {r('se_naive', 'se_naive')}, {r('t_naive', 't_naive')} FROM nw"))
def newey_west(p):
    return ic.newey_west(ics(p, 3, 1, 5), F.col("horizon") - 1)


@on_panel(chain(*IC3, q.NW, select=f"SELECT factor, horizon, {r('t_naive', 't_naive')}, {r('t_nw', 't_nw')}, {r('t_naive / nullif(t_nw, 0)', 'inflation', 6)} FROM nw"))
def t_inflation(p):
    return research.inflation(ics(p, 3, 1, 5))


@on_panel(chain(q.SIG3, q.forward(5), q.IC, select=f"SELECT factor, horizon, date, rn, {r('ic', 'ic')}, n_valid FROM ic WHERE rn % 5 = 0"))
def non_overlap_ic(p):
    return ic.non_overlapping_ic(sig(p, 3), forward_returns(p, [5]), 5).select("factor", "horizon", "date", "rn", "ic", "n_valid")


@on_panel(chain(q.SIG2, q.forward(*range(1, 11)), q.IC, select=f"SELECT factor, horizon, {r('avg(ic)', 'mean_ic')} FROM ic GROUP BY factor, horizon"))
def ic_decay(p):
    return ic.decay(sig(p, 2), p, 10)


@on_panel(chain(q.SIG3, q.forward(1), q.IC, select=f"SELECT a.horizon, a.factor AS factor_a, b.factor AS factor_b, {r('corr(a.ic, b.ic)', 'corr')} FROM ic a JOIN ic b ON a.date = b.date AND a.horizon = b.horizon GROUP BY 1, 2, 3"))
def ic_corr_matrix(p):
    return ic.correlation_matrix(ics(p, 3, 1))


@on_panel(chain(q.SIG2, q.forward(1), q.IC, "lg AS (SELECT factor, horizon, k AS lag, ic, lag(ic, k) OVER (PARTITION BY factor, horizon, k ORDER BY rn) AS b FROM ic, (VALUES (1), (5), (21)) v(k))", select=f"SELECT factor, horizon, lag, {r('corr(ic, b)', 'corr')} FROM lg GROUP BY factor, horizon, lag"))
def ic_autocorr(p):
    return ic.autocorrelation(ics(p, 2, 1), [1, 5, 21])


_BOOT = [
    "xs AS (SELECT ic, row_number() OVER (ORDER BY date) AS pos, count(*) OVER () AS n FROM ic WHERE ic IS NOT NULL)",
    "sz AS (SELECT max(n) AS n, CAST(5 AS BIGINT) AS b FROM xs)",
    "dr AS (SELECT n, b, rep, blk, (42 + rep * 7919 + blk * 104729) % 2147483648 AS s0 FROM sz, range(200) r(rep), range((SELECT CAST(ceil(n / 5.0) * 4 + 50 AS BIGINT) FROM sz)) k(blk))",
    "d1 AS (SELECT *, (s0 * 1103515245 + 12345) % 2147483648 AS s1 FROM dr)",
    "d2 AS (SELECT *, (s1 * 1103515245 + 12345) % 2147483648 AS s2 FROM d1)",
    "d3 AS (SELECT n, b, rep, blk, ((s2 * 1103515245 + 12345) % 2147483648) * n // 2147483648 AS st FROM d2)",
    "ln AS (SELECT *, least(b, n - st) AS len FROM d3)",
    "fl AS (SELECT *, sum(len) OVER (PARTITION BY rep ORDER BY blk) - len AS filled FROM ln)",
    "tk AS (SELECT rep, st, least(len, n - filled) AS len FROM fl WHERE filled < n)",
    "ms AS (SELECT rep, avg(ic) AS m FROM tk JOIN xs ON pos BETWEEN st + 1 AND st + len GROUP BY rep)",
]


@on_panel(chain(q.SIG1, q.forward(5), q.IC, *_BOOT, select=f"SELECT 'momentum_26_4' AS factor, 5 AS horizon, {r('quantile_cont(m, 0.025)', 'ci_lower')}, {r('quantile_cont(m, 0.975)', 'ci_upper')}, {r('stddev_samp(m)', 'se_bootstrap')} FROM ms"))
def bootstrap_lcg(p):
    return ic.block_bootstrap(ics(p, 1, 5), 5, replicates=200)


@on_panel(chain(q.SIG1, q.forward(5), q.IC, *_BOOT[:-1], _BOOT[-1].replace("avg(ic)", "median(ic)"), select=f"SELECT 'momentum_26_4' AS factor, 5 AS horizon, {r('(SELECT median(ic) FROM ic)', 'point_estimate')}, {r('quantile_cont(m, 0.025)', 'ci_lower')}, {r('quantile_cont(m, 0.975)', 'ci_upper')}, {r('stddev_samp(m)', 'se_bootstrap')} FROM ms"))
def bootstrap_callable(p):
    """The same draws, and a statistic that is any numpy function."""
    return ic.bootstrap_of(ics(p, 1, 5), np.median, 5, replicates=200)


@on_panel(chain(q.SIG2, q.forward(1), q.IC, select=f"SELECT factor, horizon, date, rn, {r('ic', 'ic')}, n_valid, {r('CASE WHEN count(ic) OVER w >= 30 THEN avg(ic) OVER w END', 'rolling_ic')} FROM ic WINDOW w AS (PARTITION BY factor, horizon ORDER BY rn ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"))
def rolling_ic_63(p):
    return research.rolling_ic(ics(p, 2, 1)).select("factor", "horizon", "date", "rn", "ic", "n_valid", "rolling_ic")


# --- diagnostics --------------------------------------------------------------------------------------------


@on_panel(chain(q.SIG2, "lg AS (SELECT factor, ticker, k AS lag, value, lag(value, k) OVER (PARTITION BY factor, ticker, k ORDER BY rn) AS b FROM sig, (SELECT CAST(unnest(range(1, 11)) AS INTEGER) AS k))", "oc AS (SELECT factor, ticker, lag, corr(value, b) AS c FROM lg GROUP BY factor, ticker, lag)", select=f"SELECT factor, lag, {r('avg(c)', 'autocorr')} FROM oc GROUP BY factor, lag"))
def signal_autocorr(p):
    return diagnostics.autocorrelation(sig(p, 2), 10)


@on_panel(chain(q.SIG2, "lg AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY factor, ticker ORDER BY rn)) AS d FROM sig)", select=f"SELECT factor, date, rn, {r('coalesce(sum(d), 0) / nullif(coalesce(sum(abs(value)), 0), 0)', 'turnover')} FROM lg GROUP BY factor, date, rn"))
def signal_turnover(p):
    return diagnostics.turnover(sig(p, 2))


@on_panel(chain(q.SIG2, select=f"SELECT factor, date, rn, {r('stddev_samp(value)', 'dispersion')} FROM sig GROUP BY factor, date, rn"))
def dispersion(p):
    return diagnostics.dispersion(sig(p, 2))


_LEADLAG = [
    "mv AS (SELECT date, ticker, CAST(k AS INTEGER) AS offset_, CASE WHEN k >= 0 THEN lead(ret, k) OVER w ELSE lag(ret, -k) OVER w END AS y FROM panel, (SELECT unnest(range(-5, 6)) AS k) WINDOW w AS (PARTITION BY ticker, k ORDER BY rn))",
    "pl AS (SELECT factor, offset_, s.date, value AS x, y FROM sig s JOIN mv ON s.date = mv.date AND s.ticker = mv.ticker WHERE value IS NOT NULL AND y IS NOT NULL)",
    f"rl AS (SELECT *, {q.arank('x', 'factor, offset_, date')} AS rx, {q.arank('y', 'factor, offset_, date')} AS ry FROM pl)",
    "cl AS (SELECT factor, offset_, date, covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) AS c FROM rl GROUP BY factor, offset_, date)",
]


@on_panel(chain(q.SIG2, *_LEADLAG, select=f'SELECT factor, offset_ AS "offset", {r("avg(c)", "mean_ic")} FROM cl GROUP BY factor, offset_'))
def lead_lag(p):
    return diagnostics.lead_lag(sig(p, 2), p, 5, 5)


@on_panel(chain(q.SIG2, q.forward(*range(1, 11)), q.IC, "dc AS (SELECT factor, horizon, avg(ic) AS m FROM ic GROUP BY factor, horizon)", select="SELECT factor, CAST(arg_max(horizon, abs(m)) AS INTEGER) AS natural_freq FROM dc GROUP BY factor"))
def natural_freq(p):
    return diagnostics.natural_frequency(ic.decay(sig(p, 2), p, 10), "mean_ic", None, "horizon")


_POOL = [
    "pw AS (SELECT s.*, count(*) OVER (PARTITION BY date, ticker) AS k FROM sig s WHERE value IS NOT NULL)",
    f"pk AS (SELECT factor, date, ticker, {q.arank('value', 'factor')} AS r FROM (SELECT * FROM pw WHERE k = 3))",
]


@on_panel(chain(q.SIG3, *_POOL, select=f"SELECT a.factor AS factor_a, b.factor AS factor_b, {r('corr(a.r, b.r)', 'corr')} FROM pk a JOIN pk b ON a.date = b.date AND a.ticker = b.ticker GROUP BY 1, 2"))
def pooled_spearman(p):
    return diagnostics.pooled_spearman(sig(p, 3))


_SPREAD = [
    "sp AS (SELECT factor, horizon, s.date, s.ticker, value, fwd, count(*) OVER (PARTITION BY factor, horizon, s.date) AS n, row_number() OVER (PARTITION BY factor, horizon, s.date ORDER BY value DESC, s.ticker) AS hi, row_number() OVER (PARTITION BY factor, horizon, s.date ORDER BY value, s.ticker) AS lo FROM sig s JOIN fwd f ON s.date = f.date AND s.ticker = f.ticker WHERE value IS NOT NULL AND fwd IS NOT NULL)",
    "sd AS (SELECT factor, horizon, date, avg(fwd) FILTER (hi <= 3) - avg(fwd) FILTER (lo <= 3) AS spread FROM sp WHERE n >= 6 GROUP BY factor, horizon, date)",
]


@on_panel(chain(q.SIG2, q.forward(1, 5), *_SPREAD, select=f"SELECT factor, horizon, date, {r('spread', 'spread')} FROM sd"))
def quantile_spread(p):
    return diagnostics.quantile_spread(sig(p, 2), forward_returns(p, [1, 5]))


@on_panel(chain(q.SIG2, q.forward(1, 5), *_SPREAD, select=f"SELECT factor, horizon, count(spread) AS n, {r('avg(spread)', 'mean')}, {r('avg(spread) / nullif(stddev_samp(spread), 0)', 'ratio')}, {r('avg(CASE WHEN spread > 0 THEN 1.0 ELSE 0.0 END)', 'hit_rate')} FROM sd GROUP BY factor, horizon"))
def spread_stats(p):
    return research.spread_stats(diagnostics.quantile_spread(sig(p, 2), forward_returns(p, [1, 5])))


#: The derived prices move by tens of percent a week: curves and metrics are of a twentieth of the exposure.
EXPOSURE = 0.05
_SCALED = "sc AS (SELECT factor, date, ret * 0.05::DOUBLE AS ret, turnover FROM bt)"


def scaled(returns: DataFrame) -> DataFrame:
    return returns.withColumn("ret", F.col("ret") * EXPOSURE)


# --- back-test ----------------------------------------------------------------------------------------------

_BT = f"SELECT factor, date, {r('ret', 'ret')}, {r('turnover', 'turnover')} FROM bt"


@on_panel(chain(q.SIG2, *q.backtest(), select=_BT))
def backtest_daily(p):
    return Backtest().run(p, sig(p, 2))


@on_panel(chain(q.SIG2, *q.backtest(rebalance=5), select=_BT))
def backtest_rebal5(p):
    return Backtest(rebalance=5).run(p, sig(p, 2))


@on_panel(chain(q.SIG2, *q.backtest(rebalance=2, smooth=0.6), select=_BT))
def backtest_smooth(p):
    return Backtest(rebalance=2, smooth=0.6).run(p, sig(p, 2))


@on_panel(chain(q.SIG1, *q.backtest(rebalance=1, prefix="a"), *q.backtest(rebalance=5, prefix="b"), *q.backtest(rebalance=21, prefix="c"), "gr AS (SELECT 1 AS rebalance, * FROM abt UNION ALL SELECT 5, * FROM bbt UNION ALL SELECT 21, * FROM cbt)", select=f"SELECT rebalance, 0.0::DOUBLE AS smooth, factor, {r('product(1 + ret) - 1', 'total_return')} FROM gr GROUP BY rebalance, factor"))
def backtest_grid(p):
    return metrics.total_return(sweep(p, sig(p, 1), [1, 5, 21]), ["rebalance", "smooth", "factor"])


_SMOOTH_GRID = [part for k, (f, sm) in enumerate([(1, 0.0), (1, 0.6), (5, 0.0), (5, 0.6)]) for part in q.backtest(rebalance=f, smooth=sm, prefix="abcd"[k])]
_SMOOTH_ROWS = "gr AS (" + " UNION ALL ".join(f"SELECT {f} AS rebalance, {sm}::DOUBLE AS smooth, * FROM {'abcd'[k]}bt" for k, (f, sm) in enumerate([(1, 0.0), (1, 0.6), (5, 0.0), (5, 0.6)])) + ")"


@on_panel(chain(q.SIG1, *_SMOOTH_GRID, _SMOOTH_ROWS, select=f"SELECT rebalance, smooth, factor, {r('product(1 + ret * 0.05::DOUBLE) - 1', 'total_return')} FROM gr GROUP BY rebalance, smooth, factor"))
def backtest_grid_smooth(p):
    """A grid with smoothing: two holding periods by two shares of yesterday's position, in one pass."""
    return metrics.total_return(scaled(sweep(p, sig(p, 1), [1, 5], [0.0, 0.6])), ["rebalance", "smooth", "factor"])


# --- metrics ------------------------------------------------------------------------------------------------

_BENCH = "wb AS (SELECT sc.*, b.bench FROM sc LEFT JOIN (SELECT date, lead(market) OVER (ORDER BY rn) / market - 1 AS bench FROM days) b USING (date))"
_ALL = [*metrics.PERFORMANCE, *metrics.BENCHMARK, *metrics.DISTRIBUTION]


@on_panel(chain(q.SIG2, *q.backtest(), _SCALED, *q.metrics("sc", "factor", False), select="SELECT factor, " + ", ".join(r(c, c) for c in metrics.PERFORMANCE) + " FROM my"))
def metrics_summary(p):
    return metrics.summary(scaled(Backtest().run(p, sig(p, 2))), ["factor"])


@on_panel(chain(q.SIG2, *q.backtest(), _SCALED, _BENCH, *q.metrics("wb", "factor", True), select="SELECT factor, " + ", ".join(r(c, c) for c in _ALL) + " FROM my"))
def metrics_full(p):
    return metrics.full_summary(research.with_benchmark(scaled(Backtest().run(p, sig(p, 2))), p), ["factor"])


@on_panel(chain("tk AS (SELECT ticker, date, ret, market_ret AS bench FROM panel)", *q.metrics("tk", "ticker", True), select="SELECT ticker, " + ", ".join(r(c, c) for c in _ALL) + " FROM my"))
def metrics_per_ticker(p):
    return metrics.full_summary(p.select("ticker", "date", "ret", F.col("market_ret").alias("bench")), ["ticker"])


@on_panel(chain(q.SIG2, *q.backtest(), _SCALED, "eq AS (SELECT factor, date, product(1 + ret) OVER (PARTITION BY factor ORDER BY date) AS e FROM sc)", select=f"SELECT factor, date, {r('e', 'equity')}, {r('e / max(e) OVER (PARTITION BY factor ORDER BY date) - 1', 'drawdown')} FROM eq"))
def equity_curve(p):
    return tearsheet.equity(scaled(Backtest().run(p, sig(p, 2))), ["factor"])


_MONTHS = ["mr AS (SELECT factor, CAST(date_trunc('month', date) AS DATE) AS month, product(1 + ret) - 1 AS r FROM sc GROUP BY 1, 2)", "sp AS (SELECT factor, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM mr GROUP BY factor)"]


@on_panel(chain(q.SIG2, *q.backtest(), _SCALED, *_MONTHS, select=f"SELECT factor, month, {r('coalesce(r, 0)', 'ret')} FROM sp LEFT JOIN mr USING (factor, month)"))
def monthly_returns(p):
    return tearsheet.monthly(scaled(Backtest().run(p, sig(p, 2))), ["factor"])


@on_panel(chain(q.SIG1, *q.backtest(), _SCALED, _BENCH, "be AS (SELECT factor, date, CASE WHEN bench IS NOT NULL THEN product(1 + bench) OVER (PARTITION BY factor ORDER BY date) END AS e FROM wb)", select=f"SELECT factor, date, {r('e', 'bench_equity')} FROM be"))
def benchmark_equity(p):
    return tearsheet.benchmark_equity(research.with_benchmark(scaled(Backtest().run(p, sig(p, 1))), p), ["factor"])


@on_panel(chain(q.SIG2, *q.backtest(), _SCALED, *_MONTHS, "mt AS (SELECT factor, month, coalesce(r, 0) AS r FROM sp LEFT JOIN mr USING (factor, month))", select="SELECT factor, CAST(year(month) AS INTEGER) AS year, " + ", ".join(r(f"max(r) FILTER (month(month) = {m})", f'"{m}"') for m in range(1, 13)) + " FROM mt GROUP BY 1, 2"))
def monthly_table(p):
    """A row a year, a column a month."""
    return tearsheet.monthly_table(scaled(Backtest().run(p, sig(p, 2))), ["factor"])


@on_panel(chain(q.SIG2, *q.backtest(), _SCALED, _BENCH, *q.metrics("wb", "factor", True), "sd AS (SELECT factor, min(date) AS first_date, max(date) AS last_date FROM sc GROUP BY factor)", select="SELECT factor, first_date, last_date, " + ", ".join(r(c, c) for c in _ALL) + " FROM my JOIN sd USING (factor)"))
def tear_banner(p):
    """The dates and metrics above a tear sheet."""
    return tearsheet.banner(research.with_benchmark(scaled(Backtest().run(p, sig(p, 2))), p), ["factor"])


_REPORT = ReportConfig(horizons=[5], decay_lags=5, replicates=200)


@on_panel(chain(q.SIG1, q.forward(5), q.IC, q.NW, *[re.sub(r"\b(xs|sz|dr)\b", r"\1_b", part) for part in _BOOT], "sm AS (" + _SUMMARY + ")", select=f"SELECT sm.*, {r('(SELECT quantile_cont(m, 0.025) FROM ms)', 'ci_lower')}, {r('(SELECT quantile_cont(m, 0.975) FROM ms)', 'ci_upper')}, {r('(SELECT stddev_samp(m) FROM ms)', 'se_bootstrap')} FROM sm"))
def report_horizons(p):
    """The coefficients of a whole report, with their intervals."""
    return SignalReport(sig(p, 1), p, _REPORT).run().results["ic_by_horizon"]


@on_panel(chain(q.SIG1, *q.backtest(), "eq AS (SELECT factor, date, ret, turnover, product(1 + ret) OVER (PARTITION BY factor ORDER BY date) AS e FROM bt)", select=f"SELECT 'daily' AS run, factor, date, {r('ret', 'ret')}, {r('turnover', 'turnover')}, {r('e', 'equity')}, {r('e / max(e) OVER (PARTITION BY factor ORDER BY date) - 1', 'drawdown')} FROM eq"))
def report_equity(p):
    """The curve behind a report's last plot, rebalanced daily."""
    return SignalReport(sig(p, 1), p, _REPORT).run().panels()["equity"].where("run = 'daily'")


# --- research -----------------------------------------------------------------------------------------------


@on_panel(chain(q.SIG2, q.forward(1), q.IC, "sp AS (SELECT *, 'pre' AS period FROM ic WHERE date <= DATE '1998-06-29' UNION ALL SELECT *, 'post' FROM ic WHERE date >= DATE '1998-06-29')", select=f"SELECT factor, horizon, period, {r('avg(ic)', 'mean')}, {r('avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic))', 't_stat')}, count(ic) AS n FROM sp GROUP BY 1, 2, 3"))
def subperiod(p):
    return research.sub_periods(ics(p, 2, 1), "1998-06-29")


_LOO = "so AS (SELECT s.factor || '|' || n.ticker AS factor, s.date, s.rn, s.ticker, s.value FROM sig s JOIN names n ON s.ticker <> n.ticker)"


@on_panel(chain(q.SIG1, _LOO, q.forward(1), q.IC.replace("FROM sig s", "FROM so s"), select=f"SELECT split_part(factor, '|', 1) AS factor, split_part(factor, '|', 2) AS left_out, {r('avg(ic)', 'mean_ic')} FROM ic GROUP BY 1, 2"))
def leave_one_out(p):
    return research.leave_one_out(sig(p, 1), p)


_SEC = "so AS (SELECT s.factor || '|' || n.sector AS factor, s.date, s.rn, s.ticker, s.value FROM sig s JOIN names n ON s.ticker = n.ticker WHERE n.sector IN (SELECT sector FROM names GROUP BY sector HAVING count(*) >= 5))"


@on_panel(chain(q.SIG2, _SEC, q.forward(1), q.IC.replace("FROM sig s", "FROM so s"), select=f"SELECT split_part(factor, '|', 1) AS factor, split_part(factor, '|', 2) AS sector, {r('avg(ic)', 'mean_ic')}, count(ic) AS n FROM ic GROUP BY 1, 2"))
def sector_split(p):
    return research.sector_split(sig(p, 2), p)


_GRID = q.signals(**{f"momentum_{w}_{s}": q.momentum(w, s) for w in (13, 26, 52) for s in (1, 4)})


@on_panel(chain(_GRID, q.forward(5), q.IC, select=f"SELECT factor, {r('avg(ic)', 'mean_ic')}, count(ic) AS n FROM ic GROUP BY factor"))
def param_sensitivity(p):
    return research.parameter_grid(p, [13, 26, 52], [1, 4])


@on_panel(chain(*IC3, q.NW, select=f"SELECT factor, {r('max(abs(t_nw))', 'best_t')}, max(abs(t_nw)) >= 2 AS survives FROM nw GROUP BY factor"))
def triage(p):
    return research.triage(ics(p, 3, 1, 5))


@on_panel(chain(q.SIG3, "fv AS (SELECT factor, min(date) AS d FROM sig WHERE value IS NOT NULL GROUP BY factor)", select="SELECT greatest(max(d), DATE '1995-03-06') AS common_start FROM fv"))
def common_start(p):
    return research.common_start(sig(p, 3), "1995-03-06")


SPANS = {"early": ("1995-06-01", "1997-06-30"), "middle": ("1997-01-01", "1999-06-30"), "late": ("1999-01-01", "2002-12-31")}
_REG = "rg AS (" + " UNION ALL ".join(f"SELECT '{k}' AS regime, factor, date, ret FROM sc WHERE date BETWEEN DATE '{a}' AND DATE '{b}'" for k, (a, b) in SPANS.items()) + ")"


@on_panel(chain(q.SIG2, *q.backtest(), _SCALED, _REG, *q.metrics("rg", "regime, factor", False), select="SELECT regime, factor, " + ", ".join(r(c, c) for c in metrics.PERFORMANCE) + " FROM my"))
def regime_table(p):
    return research.regimes(scaled(Backtest().run(p, sig(p, 2))), SPANS)


PROBES = ["1997-03-01", "1999-07-15", "2030-01-01"]
_ORI = [
    "pb AS (SELECT CAST(unnest(['1997-03-01', '1999-07-15', '2030-01-01']) AS DATE) AS probe)",
    "nr AS (SELECT probe, date FROM (SELECT probe, date, row_number() OVER (PARTITION BY probe ORDER BY abs(date - probe), date) AS k FROM pb, days) WHERE k = 1)",
    "tr AS (SELECT *, avg(ic) OVER (PARTITION BY factor, horizon ORDER BY rn ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) AS t, avg(ic) OVER (PARTITION BY factor, horizon ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS a FROM ic)",
]


@on_panel(chain(q.SIG2, q.forward(1), q.IC, *_ORI, select=f"SELECT factor, horizon, probe, date, {r('t', 'trailing')}, {r('a', 'realised')}, sign(t) = sign(a) AS agrees FROM tr JOIN nr USING (date)"))
def orientation_lag(p):
    return research.orientation_lag(ics(p, 2, 1), PROBES)


_DEC = "dt AS (SELECT nw.factor, nw.horizon, nb.mean, t_nw, sharpe_ratio FROM nw JOIN nb USING (factor, horizon) LEFT JOIN my ON nw.factor = my.factor)"


@on_panel(chain(q.SIG3, q.forward(1, 5), q.IC, q.NW, *q.backtest(), _SCALED, *q.metrics("sc", "factor", False), _DEC, select=f"SELECT factor, horizon, {r('mean', 'mean')}, {r('t_nw', 't_nw')}, {r('sharpe_ratio', 'sharpe_ratio')}, CASE WHEN abs(t_nw) >= 2 AND sharpe_ratio > 0 THEN 'keep' WHEN abs(t_nw) >= 1 OR sharpe_ratio > 0 THEN 'weak' ELSE 'drop' END AS verdict FROM dt"))
def decision_table(p):
    return research.decision_table(ics(p, 3, 1, 5), scaled(Backtest().run(p, sig(p, 3))))


_FLAG = [
    f"mo AS (SELECT *, {q.momentum(52, 4)} AS x FROM panel)",
    f"sig AS (SELECT 'sector_neutral_momentum_52_4' AS factor, date, rn, ticker, x - avg(x) OVER (PARTITION BY date, sector) AS value FROM mo UNION ALL SELECT 'low_volatility_21', date, rn, ticker, {q.VOL_S} FROM panel)",
    q.forward(1),
    q.IC,
    q.Z,
    *_weighted(EWM, 2, 0.0),
    "fs AS (SELECT 'flagship' AS factor, date, rn, ticker, value FROM cb)",
    *q.backtest("fs", rebalance=31),
]


@on_panel(chain(*_FLAG, select=_BT))
def flagship_alpha(p):
    return research.flagship(p)


@on_panel(chain(*_FLAG, _SCALED, _BENCH, *q.metrics("wb", "factor", True), select="SELECT factor, " + ", ".join(r(c, c) for c in _ALL) + " FROM my"))
def flagship_metrics(p):
    return metrics.full_summary(research.with_benchmark(scaled(research.flagship(p)), p), ["factor"])


GROUPS = {"kitchen_sink": ["momentum_26_4", "short_term_reversal_5", "low_volatility_21"], "barbell": ["momentum_26_4", "low_volatility_21"], "static_reversal": ["-momentum_26_4"]}
_GROUPS = "gs AS (" + " UNION ALL ".join(f"SELECT '{g}' AS factor, date, rn, ticker, avg(CASE factor " + " ".join(f"WHEN '{m.removeprefix('-')}' THEN {'-z' if m[0] == '-' else 'z'}" for m in ms) + " END) AS value FROM zs WHERE factor IN (" + ", ".join(f"'{m.removeprefix('-')}'" for m in ms) + ") GROUP BY date, rn, ticker" for g, ms in GROUPS.items()) + ")"


@on_panel(chain(q.SIG3, q.Z, _GROUPS, *q.backtest("gs", rebalance=5), select=_BT))
def attribution(p):
    return research.attribution(sig(p, 3), p, GROUPS)


@on_panel(chain(select=f"SELECT date, ticker, {r('ret * ret', 'ret2')} FROM panel"))
def squared_returns(p):
    return research.squared_returns(p)


@on_panel(chain(select=f"SELECT ticker, count(ret) AS n, {r('avg(ret)', 'mean')}, {r('stddev_samp(ret)', 'std')}, {r('min(ret)', 'min')}, {r('quantile_cont(ret, 0.25)', 'p25')}, {r('quantile_cont(ret, 0.5)', 'p50')}, {r('quantile_cont(ret, 0.75)', 'p75')}, {r('max(ret)', 'max')} FROM panel GROUP BY ticker"))
def describe_returns(p):
    return research.describe(p)


@on_panel(chain(q.SIG3, q.forward(1), q.IC, q.Z, *_weighted(EWM, 3, 0.25), "fs AS (SELECT 'ewm' AS factor, date, rn, ticker, value FROM cb)", *q.backtest("fs", rebalance=5), select=f"SELECT factor, {r('product(1 + ret * 0.05::DOUBLE) - 1', 'total_return')} FROM bt GROUP BY factor"))
def ewm_variant_return(p):
    combined = combine.ICWeighted(shrinkage=0.25, use_ewm=True, halflife=26, name="ewm").combine(sig(p, 3), p)
    return metrics.total_return(scaled(Backtest(10, 5).run(p, combined)), ["factor"])


_VARIANTS = {"flat": (FLAT, 0.25), "ewm_26": (EWM, 0.25), "ewm_52": (EWM.replace("/ 26.0", "/ 52.0"), 0.25)}
_VS = "fs AS (" + " UNION ALL ".join(f"SELECT '{v}' AS factor, date, rn, ticker, value FROM cb_{v}" for v in _VARIANTS) + ")"


@on_panel(chain(q.SIG3, q.forward(1), q.IC, q.Z, *[part for v, (mean, s) in _VARIANTS.items() for part in _weighted(mean, 3, s, v)], _VS, *q.backtest("fs", rebalance=5), select=f"SELECT factor, {r('product(1 + ret) - 1', 'total_return')} FROM bt GROUP BY factor"))
def weight_variants(p):
    variants = {"flat": combine.ICWeighted(52, 0.25), "ewm_26": combine.ICWeighted(shrinkage=0.25, use_ewm=True, halflife=26), "ewm_52": combine.ICWeighted(shrinkage=0.25, use_ewm=True, halflife=52)}
    return research.weight_variants(sig(p, 3), p, variants)


# --- data layer ---------------------------------------------------------------------------------------------


def _event_bars(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_type").alias("ticker"), F.date_trunc("hour", "ts").alias("timestamp"), "value", "event_id")


# two deliveries that overlap and together hold every row


@on_tables("""
WITH b AS (SELECT event_type AS ticker, date_trunc('hour', ts) AS "timestamp", value, event_id FROM events),
o AS (SELECT ticker, "timestamp", max(event_id) AS event_id FROM b WHERE event_id % 3 IS DISTINCT FROM 0 GROUP BY 1, 2), n AS (SELECT ticker, "timestamp", max(event_id) AS event_id FROM b WHERE event_id % 3 IS DISTINCT FROM 1 GROUP BY 1, 2),
u AS (SELECT *, 0 AS p FROM o UNION ALL SELECT *, 1 FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY ticker, "timestamp" ORDER BY p DESC) AS i FROM u)
SELECT ticker, "timestamp", event_id, p AS part FROM k WHERE i = 1""")
def bars_upsert_all(spark, sf_dir):
    """Two overlapping deliveries of bars that together hold every event; the later one wins."""
    b = _event_bars(spark, sf_dir)
    one = lambda but, k: b.where(~(F.col("event_id") % 3).eqNullSafe(F.lit(but))).groupBy("ticker", "timestamp").agg(F.max("event_id").alias("event_id")).withColumn("part", F.lit(k))
    return store.merge_bars([one(0, 0), one(1, 1)])


@on_tables("""
WITH w AS (SELECT translate(upper(trim(replace(c_name, '#', '-'))), '-/', '..') AS ticker, c_name AS company, c_acctbal AS weight FROM customer WHERE c_custkey % 3 IS DISTINCT FROM 0),
s AS (SELECT translate(upper(trim(replace(c_name, '#', '/'))), '-/', '..') AS ticker, c_mktsegment AS sector FROM customer WHERE c_custkey % 3 IS DISTINCT FROM 1)
SELECT coalesce(w.ticker, s.ticker) AS ticker, company, weight, sector, CASE WHEN w.ticker IS NOT NULL AND s.ticker IS NOT NULL THEN 'both' WHEN w.ticker IS NOT NULL THEN 'weights' ELSE 'sectors' END AS found
FROM w FULL JOIN s ON w.ticker = s.ticker""")
def constituent_merge_all(spark, sf_dir):
    """Weights and sectors that overlap and together hold every customer."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    but = lambda k: c.where(~(F.col("c_custkey") % 3).eqNullSafe(F.lit(k)))
    weights = but(0).select(F.replace("c_name", F.lit("#"), F.lit("-")).alias("ticker"), F.col("c_name").alias("company"), F.col("c_acctbal").alias("weight"))
    sectors = but(1).select(F.replace("c_name", F.lit("#"), F.lit("/")).alias("ticker"), F.col("c_mktsegment").alias("sector"))
    return universe.merge_constituents(weights, sectors).select("ticker", "company", "weight", "sector", "found")


@on_tables("SELECT c_nationkey::VARCHAR AS ticker, arg_max(c_mktsegment, c_custkey) AS sector FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 1")
def sector_map_all(spark, sf_dir):
    """The sector of every ticker."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").cast("string").alias("ticker"), F.lit("x").alias("company"), F.col("c_mktsegment").alias("sector"), "c_custkey")
    return universe.sector_map(c, order="c_custkey")


@on_tables("SELECT s_name AS name, translate(upper(trim(s_name)), '-/', '..') AS ticker FROM supplier")
def ticker_normalise(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_name").alias("name"), universe.normal_ticker(F.col("s_name")).alias("ticker"))


@on_tables("""
WITH u AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS ord, n_name AS ticker FROM nation), e AS (SELECT * FROM (VALUES (0, 'INCOME_STATEMENT'), (1, 'BALANCE_SHEET'), (2, 'EARNINGS')) v(e, endpoint)),
l AS (SELECT n_name AS ticker, ['INCOME_STATEMENT', 'BALANCE_SHEET', 'EARNINGS'][1 + n_nationkey % 3] AS endpoint, DATE '2024-01-31' - CAST(n_nationkey * 3 AS INTEGER) AS last_fetch FROM nation WHERE n_nationkey % 4 > 0),
d AS (SELECT ticker, endpoint, last_fetch, CAST(row_number() OVER (ORDER BY last_fetch ASC NULLS FIRST, ord, e) AS INTEGER) AS place FROM u CROSS JOIN e LEFT JOIN l USING (ticker, endpoint) WHERE last_fetch IS NULL OR DATE '2024-02-15' - last_fetch >= 30)
SELECT ticker, endpoint, last_fetch, place FROM d WHERE place <= 70""")
def fetch_queue(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    names = n.select((F.col("n_nationkey") + 1).alias("ord"), F.col("n_name").alias("ticker"))
    endpoint = F.get(F.array(*[F.lit(e) for e in fundamentals.ENDPOINTS]), (F.col("n_nationkey") % 3).cast("int"))
    ledger = n.where("n_nationkey % 4 > 0").select(F.col("n_name").alias("ticker"), endpoint.alias("endpoint"), F.date_sub(F.lit(date(2024, 1, 31)), F.col("n_nationkey") * 3).alias("last_fetch"))
    return fundamentals.fetch_queue(names, ledger, date(2024, 2, 15), budget=70)


# ------------------------------------------------------------------------------------------------------------


def smoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship on the monthly panel, with short windows."""
    panel = price_panel(spark, sf_dir, "month")
    return rounded(research.flagship(panel, momentum_window=12, skip=1, vol_window=6, halflife=12, rebalance=3))


def queries() -> dict[str, Query]:
    return _QUERIES | catalog_sources.queries()


def oracles() -> dict[str, str]:
    return _ORACLES | catalog_sources.oracles()
