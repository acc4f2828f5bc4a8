"""DuckDB SQL for the registered queries, written apart from the DataFrame plans.

Each text is a chain of common table expressions; ``chain`` puts together those
that a query needs.
"""

from __future__ import annotations

BASE = """
raw AS (
  SELECT n_name AS ticker, r_name AS sector, CAST(date_trunc('{bucket}', l_shipdate) AS DATE) AS date, l_shipdate, l_orderkey, l_linenumber,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS v, CAST(l_quantity AS DECIMAL(18,2)) AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
bars AS (
  SELECT date, ticker, sector, arg_min(round(CAST(v AS DOUBLE) / CAST(q AS DOUBLE), 6), (l_shipdate, l_orderkey, l_linenumber)) AS open,
         max(round(CAST(v AS DOUBLE) / CAST(q AS DOUBLE), 6)) AS high, min(round(CAST(v AS DOUBLE) / CAST(q AS DOUBLE), 6)) AS low,
         round(CAST(sum(v) AS DOUBLE) / CAST(sum(q) AS DOUBLE), 6) AS close, CAST(sum(q) AS BIGINT) AS volume
  FROM raw GROUP BY date, ticker, sector),
mkt AS (SELECT date, round(CAST(sum(v) AS DOUBLE) / CAST(sum(q) AS DOUBLE), 6) AS market FROM raw GROUP BY date),
days AS (SELECT date, market, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS rn FROM mkt),
names AS (SELECT DISTINCT ticker, sector FROM bars),
grid AS (SELECT d.date, d.rn, n.ticker, n.sector, b.open, b.high, b.low, b.close, b.volume, d.market
         FROM days d CROSS JOIN names n LEFT JOIN bars b ON b.date = d.date AND b.ticker = n.ticker),
panel AS (SELECT *, close / lag(close) OVER t - 1 AS ret, market / lag(market) OVER t - 1 AS market_ret FROM grid WINDOW t AS (PARTITION BY ticker ORDER BY rn))
"""


def chain(*parts: str, select: str, bucket: str = "week") -> str:
    return "WITH " + ",".join([BASE.format(bucket=bucket), *parts]) + "\n" + select


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0::DOUBLE AS {name}"


def full(agg: str, x: str, rows: int, end: int = 0) -> str:
    frame = f"(PARTITION BY ticker ORDER BY rn ROWS BETWEEN {rows - 1 + end} PRECEDING AND {end} PRECEDING)" if end else f"(PARTITION BY ticker ORDER BY rn ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {frame} = {rows} THEN {agg.format(x=x)} OVER {frame} END"


T = "(PARTITION BY ticker ORDER BY rn)"
MOM = f"lag(close, {{skip}}) OVER {T} / lag(close, {{window}}) OVER {T} - 1"


def momentum(window: int, skip: int) -> str:
    return MOM.format(window=window, skip=skip)


def arank(x: str, keys: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {keys}, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0::DOUBLE END"


#: Factor -> (parts, expression over the last part) in the default parameters.
def factor_parts(name: str) -> tuple[list[str], str, str]:
    """CTEs, the table to select from, and the value's expression."""
    if name == "momentum_252_21":
        return [], "panel", momentum(252, 21)
    if name == "cross_sectional_momentum_252_21":
        return [f"m AS (SELECT *, {momentum(252, 21)} AS x FROM panel)"], "m", f"({arank('x', 'date')}) / count(x) OVER (PARTITION BY date)"
    if name == "sector_neutral_momentum_252_21":
        return [f"m AS (SELECT *, {momentum(252, 21)} AS x FROM panel)", "s AS (SELECT sector, count(*) AS k FROM names GROUP BY sector)"], "(SELECT m.*, k FROM m JOIN s USING (sector)) AS m", "CASE WHEN k > 1 THEN x - avg(x) OVER (PARTITION BY date, sector) END"
    if name == "rsi_14":
        parts = [f"d AS (SELECT *, close - lag(close) OVER {T} AS d FROM panel)", "g AS (SELECT *, CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0 END AS up, CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0 END AS dn FROM d)", f"a AS (SELECT *, {full('avg({x})', 'up', 14)} AS g, {full('avg({x})', 'dn', 14)} AS l FROM g)"]
        return parts, "a", "CASE WHEN l = 0 AND g > 0 THEN -50.0 WHEN l = 0 THEN NULL ELSE 50 - (100 - 100 / (1 + g / l)) END"
    if name == "bollinger_20":
        return [], "panel", f"-(close - ({full('avg({x})', 'close', 20)})) / nullif({full('stddev_samp({x})', 'close', 20)}, 0)"
    if name == "short_term_reversal_5":
        return [], "panel", f"-(close / lag(close, 5) OVER {T} - 1)"
    if name == "low_volatility_21":
        return [], "panel", f"-({full('stddev_samp({x})', 'ret', 21)})"
    if name == "residual_momentum_63_252_21":
        f = "(PARTITION BY ticker ORDER BY rn ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"
        return [f"e AS (SELECT *, ret - market_ret * CASE WHEN count(ret + market_ret) OVER {f} = 63 THEN covar_samp(ret, market_ret) OVER {f} / nullif(var_samp(market_ret) OVER {f}, 0) END AS e FROM panel)"], "e", full("sum({x})", "e", 231, 21)
    if name == "quality_proxy_252":
        return ["a AS (SELECT *, abs(ret) AS a FROM panel)", f"q AS (SELECT *, {full('stddev_samp({x})', 'ret', 252)} AS s, {full('avg({x})', 'a', 252)} AS m FROM a)"], "q", "CASE WHEN m > 1e-10 THEN -s / m END"
    if name == "rolling_sharpe_252":
        return [f"q AS (SELECT *, {full('stddev_samp({x})', 'ret', 252)} AS s, {full('avg({x})', 'ret', 252)} AS m FROM panel)"], "q", "CASE WHEN s > 1e-10 THEN m / s END"
    if name == "rolling_cvar_252_5":
        return [f"q AS (SELECT date, rn, ticker, {full('quantile_cont({x}, 0.05)', 'ret', 252)} AS q FROM panel)"], "q", "CASE WHEN q IS NOT NULL THEN (SELECT avg(p.ret) FROM panel p WHERE p.ticker = q.ticker AND p.rn BETWEEN q.rn - 251 AND q.rn AND p.ret <= q.q) END"
    if name == "rolling_max_drawdown_252":
        parts = [
            "w AS (SELECT a.date, a.rn, a.ticker, b.rn AS ix, product(1 + b.ret) OVER (PARTITION BY a.ticker, a.rn ORDER BY b.rn) AS c, count(b.ret) OVER (PARTITION BY a.ticker, a.rn) AS n FROM panel a JOIN panel b ON a.ticker = b.ticker AND b.rn BETWEEN a.rn - 251 AND a.rn)",
            "u AS (SELECT *, c / max(c) OVER (PARTITION BY ticker, rn ORDER BY ix) - 1 AS dd FROM w)",
            "z AS (SELECT date, rn, ticker, CASE WHEN max(n) = 252 THEN min(dd) END AS v FROM u GROUP BY date, rn, ticker)",
        ]
        return parts, "z", "v"
    if name == "rolling_skewness_252":
        return [], "panel", f"-({full('skewness({x})', 'ret', 252)})"
    raise KeyError(name)


def factor_sql(name: str) -> str:
    parts, table, value = factor_parts(name)
    return chain(*parts, select=f"SELECT '{name}' AS factor, date, rn, ticker, {r(value, 'value')} FROM {table}")


def signals(**named: str) -> str:
    """A CTE ``sig`` of several expressions over the panel."""
    return "sig AS (" + " UNION ALL ".join(f"SELECT '{k}' AS factor, date, rn, ticker, {v} AS value FROM panel" for k, v in named.items()) + ")"


#: The two or three short factors that composed queries are run on.
MOM_S, REV_S, VOL_S = momentum(26, 4), f"-(close / lag(close, 5) OVER {T} - 1)", f"-({full('stddev_samp({x})', 'ret', 21)})"
SIG1 = signals(momentum_26_4=MOM_S)
SIG2 = signals(momentum_26_4=MOM_S, short_term_reversal_5=REV_S)
SIG3 = signals(momentum_26_4=MOM_S, short_term_reversal_5=REV_S, low_volatility_21=VOL_S)


def forward(*horizons: int) -> str:
    return "fwd AS (" + " UNION ALL ".join(f"SELECT {h} AS horizon, date, rn, ticker, lead(close, {h}) OVER {T} / close - 1 AS fwd FROM panel" for h in horizons) + ")"


IC = f"""
pr AS (SELECT factor, horizon, s.date, s.rn, s.ticker, CASE WHEN value IS NOT NULL AND fwd IS NOT NULL THEN value END AS x, CASE WHEN value IS NOT NULL AND fwd IS NOT NULL THEN fwd END AS y
       FROM sig s JOIN fwd f ON s.date = f.date AND s.ticker = f.ticker),
rk AS (SELECT *, {arank("x", "factor, horizon, date")} AS rx, {arank("y", "factor, horizon, date")} AS ry FROM pr),
ic AS (SELECT factor, horizon, date, rn, count(rx) AS n_valid,
              CASE WHEN count(rx) >= 5 THEN covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) END AS ic
       FROM rk GROUP BY factor, horizon, date, rn)
"""
NW = """
xs AS (SELECT factor, horizon, date, ic, row_number() OVER (PARTITION BY factor, horizon ORDER BY date) AS pos, count(*) OVER (PARTITION BY factor, horizon) AS n,
              ic - avg(ic) OVER (PARTITION BY factor, horizon) AS d FROM ic WHERE ic IS NOT NULL),
nb AS (SELECT factor, horizon, max(n) AS n, least(max(horizon) - 1, max(n) - 1) AS m, avg(ic) AS mean, stddev_samp(ic) AS sd FROM xs GROUP BY factor, horizon),
gm AS (SELECT a.factor, a.horizon, a.pos - b.pos AS k, sum(a.d * b.d) / max(a.n) AS g FROM xs a JOIN xs b ON a.factor = b.factor AND a.horizon = b.horizon JOIN nb ON nb.factor = a.factor AND nb.horizon = a.horizon
       WHERE a.pos - b.pos BETWEEN 0 AND nb.m GROUP BY 1, 2, 3),
nv AS (SELECT factor, horizon, sum(g * CASE WHEN k = 0 THEN 1 ELSE 2 * (1 - k / (m + 1.0::DOUBLE)) END) AS v FROM gm JOIN nb USING (factor, horizon) GROUP BY factor, horizon),
nw AS (SELECT factor, horizon, n, CAST(m AS INTEGER) AS bandwidth, sqrt(greatest(v, 0) / n) AS se_nw, mean / nullif(sqrt(greatest(v, 0) / n), 0) AS t_nw,
              sd / sqrt(n) AS se_naive, mean / nullif(sd / sqrt(n), 0) AS t_naive FROM nb JOIN nv USING (factor, horizon))
"""
Z = "zs AS (SELECT *, (value - avg(value) OVER (PARTITION BY factor, date)) / nullif(stddev_samp(value) OVER (PARTITION BY factor, date), 0) AS z FROM sig)"


def backtest(sig: str = "sig", rebalance: int = 1, smooth: float = 0.0, cost: float = 10.0, prefix: str = "") -> list[str]:
    """CTEs ending in {prefix}bt (factor, date, ret, turnover)."""
    p = prefix
    held = f"first_value(pos) OVER (PARTITION BY factor, ticker, ix // {rebalance} ORDER BY ix)" if rebalance > 1 else "pos"
    parts = [
        f"{p}al AS (SELECT s.factor, p.date, p.ticker, p.close, s.value, dense_rank() OVER (PARTITION BY s.factor ORDER BY p.date) - 1 AS ix FROM panel p JOIN {sig} s ON s.date = p.date AND s.ticker = p.ticker)",
        f"{p}ra AS (SELECT *, lead(close) OVER (PARTITION BY factor, ticker ORDER BY ix) / close - 1 AS f, value - avg(value) OVER (PARTITION BY factor, date) AS raw FROM {p}al)",
        f"{p}ps AS (SELECT *, coalesce(raw / nullif(sum(abs(raw)) OVER (PARTITION BY factor, date), 0), 0) AS pos FROM {p}ra)",
        f"{p}hd AS (SELECT factor, date, ticker, ix, f, {held} AS pos FROM {p}ps)",
    ]
    last = f"{p}hd"
    if smooth:
        parts += [
            f"{p}sm AS (SELECT a.factor, a.date, a.ticker, a.ix, any_value(a.f) AS f, sum(pow({smooth}::DOUBLE, a.ix - b.ix) * CASE WHEN b.ix = 0 THEN 1 ELSE {1 - smooth}::DOUBLE END * b.pos) AS pos FROM {last} a JOIN {last} b ON a.factor = b.factor AND a.ticker = b.ticker AND b.ix <= a.ix GROUP BY 1, 2, 3, 4)",
            f"{p}sn AS (SELECT factor, date, ticker, ix, f, coalesce(pos / nullif(sum(abs(pos)) OVER (PARTITION BY factor, date), 0), 0) AS pos FROM {p}sm)",
        ]
        last = f"{p}sn"
    parts += [
        f"{p}tr AS (SELECT *, abs(pos - coalesce(lag(pos) OVER (PARTITION BY factor, ticker ORDER BY ix), 0)) AS trade FROM {last})",
        f"{p}bt AS (SELECT factor, date, sum(pos * f) - sum(trade) * {cost} / 1e4 AS ret, sum(trade) AS turnover FROM {p}tr GROUP BY factor, date HAVING sum(pos * f) IS NOT NULL)",
    ]
    return parts


def metrics(source: str, keys: str, bench: bool) -> list[str]:
    """CTEs ending in mx: all metrics of ``source`` (keys, date, ret, bench)."""
    b = "bench" if bench else "NULL::DOUBLE"
    on = " AND ".join(f"x.{k.strip()} IS NOT DISTINCT FROM c.{k.strip()}" for k in keys.split(","))
    on_d = " AND ".join(f"m.{k.strip()} IS NOT DISTINCT FROM d.{k.strip()}" for k in keys.split(","))
    ks = ", ".join(f"x.{k.strip()}" for k in keys.split(","))
    both = "CASE WHEN ret IS NOT NULL AND b IS NOT NULL THEN {} END"
    return [
        f"rs AS (SELECT {keys}, date, ret, {b} AS b FROM {source})",
        f"cu AS (SELECT {keys}, quantile_cont(ret, 0.05) AS lo, quantile_cont(ret, 0.95) AS hi FROM rs GROUP BY {keys})",
        f"eq AS (SELECT {keys}, date, product(1 + ret) OVER (PARTITION BY {keys} ORDER BY date) AS e FROM rs WHERE ret IS NOT NULL)",
        f"dd AS (SELECT {keys}, least(0, min(d)) AS mdd FROM (SELECT {keys}, e / greatest(1.0::DOUBLE, max(e) OVER (PARTITION BY {keys} ORDER BY date)) - 1 AS d FROM eq) GROUP BY {keys})",
        f"mj AS (SELECT x.*, lo, hi, {both.format('ret')} AS p, {both.format('b')} AS q FROM rs x JOIN cu c ON {on})",
        f"""mm AS (SELECT {keys}, count(ret) AS n, count(*) AS size, count(p) AS np, avg(ret) AS mean, stddev_samp(ret) AS sd, sqrt(avg(ret * ret) FILTER (ret < 0)) AS dn, product(1 + ret) AS g,
             coalesce(sum(ret) FILTER (ret > 0), 0) AS gains, coalesce(-sum(ret) FILTER (ret < 0), 0) AS losses, count(*) FILTER (ret > 0) AS wins, skewness(ret) AS sk, kurtosis(ret) AS ku, max(lo) AS lo, max(hi) AS hi,
             avg(ret) FILTER (ret <= lo) AS lt, avg(ret) FILTER (ret >= hi) AS rt, max(ret) AS best, min(ret) AS worst, coalesce(covar_samp(p, q) / nullif(var_samp(q), 0), 0) AS beta, avg(p) AS mp, avg(q) AS mq,
             stddev_samp(p - q) * sqrt(252) AS te, avg(p) FILTER (q > 0) / nullif(avg(q) FILTER (q > 0), 0) AS up, avg(p) FILTER (q < 0) / nullif(avg(q) FILTER (q < 0), 0) AS dw FROM mj GROUP BY {keys})""",
        f"""mx AS (SELECT {ks.replace("x.", "m.")}, CASE WHEN n < 2 THEN 0 WHEN sd <= 1e-15 * greatest(1, abs(mean)) THEN CASE WHEN mean > 0 THEN 'inf'::DOUBLE WHEN mean < 0 THEN '-inf'::DOUBLE ELSE 0 END ELSE mean / sd * sqrt(252) END AS sharpe_ratio,
             CASE WHEN n < 2 THEN 0 WHEN coalesce(dn, 0) = 0 THEN CASE WHEN mean > 0 THEN 'inf'::DOUBLE ELSE 0 END ELSE mean / dn * sqrt(252) END AS sortino_ratio, coalesce(mdd, 0) AS max_drawdown,
             CASE WHEN n = 0 THEN 0 WHEN g > 0 THEN pow(g, 252.0::DOUBLE / size) - 1 WHEN g = 0 THEN -1 END AS annualized_return, CASE WHEN n < 2 THEN 0 ELSE sd * sqrt(252) END AS annualized_volatility, wins / size::DOUBLE AS win_rate,
             CASE WHEN losses = 0 THEN CASE WHEN gains > 0 THEN 'inf'::DOUBLE ELSE 0 END ELSE gains / losses END AS profit_factor,
             CASE WHEN np < 2 THEN 0 ELSE beta END AS beta, CASE WHEN np < 2 THEN 0 ELSE (mp - beta * mq) * 252 END AS alpha, CASE WHEN np < 2 THEN 0 ELSE te END AS tracking_error,
             CASE WHEN np < 2 THEN 0 ELSE coalesce((mp - mq) * 252 / nullif(te, 0), 0) END AS information_ratio, CASE WHEN np < 2 THEN 0 ELSE coalesce(up, 0) END AS up_capture, CASE WHEN np < 2 THEN 0 ELSE coalesce(dw, 0) END AS down_capture,
             CASE WHEN n < 3 THEN 0 ELSE sk END AS skewness, CASE WHEN n < 4 THEN 0 ELSE ku END AS excess_kurtosis, CASE WHEN n < 2 THEN 0 ELSE lo END AS value_at_risk_95, CASE WHEN n < 2 THEN 0 ELSE lt END AS cvar_95,
             CASE WHEN n < 2 THEN 0 ELSE coalesce(abs(hi / nullif(lo, 0)), 0) END AS tail_ratio, CASE WHEN n < 2 THEN 0 ELSE coalesce(abs(rt / nullif(lt, 0)), 0) END AS expected_tail_ratio, coalesce(best, 0) AS best_day, coalesce(worst, 0) AS worst_day
             FROM mm m LEFT JOIN dd d ON {on_d})""",
        "my AS (SELECT *, CASE WHEN max_drawdown = 0 THEN 0 ELSE annualized_return / abs(max_drawdown) END AS calmar_ratio FROM mx)",
    ]
