"""A full validation of one signal: diagnostics, coefficients by horizon, decay, and two back-tests."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import diagnostics, ic, metrics
from panelforge.operators.backtest import Backtest
from panelforge.sources.panel import forward_returns


@dataclass
class ReportConfig:
    horizons: list[int] = field(default_factory=lambda: [1, 5, 10, 21])
    decay_lags: int = 30
    replicates: int = 10_000
    cost_bps: float = 10.0
    seed: int = 42


class SignalReport:
    """``run()`` builds the frames; each is computed when it is read.

    One table of coefficients serves the horizons, the decay and its intervals.
    """

    def __init__(self, signal: DataFrame, panel: DataFrame, config: ReportConfig | None = None):
        self.signal, self.panel, self.config = signal, panel, config or ReportConfig()
        self._results: dict | None = None

    @property
    def results(self) -> dict:
        if self._results is None:
            raise RuntimeError("run() first")
        return self._results

    def run(self) -> SignalReport:
        c, signal, panel = self.config, self.signal, self.panel
        lags = sorted({*c.horizons, *range(1, c.decay_lags + 1)})
        table = ic.compute_ic(signal, forward_returns(panel, lags)).persist()
        by_horizon, up_to = table.where(F.col("horizon").isin(c.horizons)), table.where(F.col("horizon") <= c.decay_lags)
        interval = lambda t: ic.block_bootstrap(t, F.col("horizon"), c.replicates, seed=c.seed)
        decay = up_to.groupBy("factor", "horizon").agg(F.avg("ic").alias("mean_ic"))
        decay_ci = decay.join(interval(up_to), ["factor", "horizon"], "left").persist()
        frequency = diagnostics.natural_frequency(decay_ci, "mean_ic", "se_bootstrap", "horizon").first()
        natural = frequency["natural_freq"] if frequency else 1
        daily, slow = Backtest(c.cost_bps).run(panel, signal), Backtest(c.cost_bps, natural).run(panel, signal)
        sharpe = lambda r: metrics.summary(r, ["factor"]).select("factor", "sharpe_ratio")
        self._results = {
            "autocorrelation": diagnostics.autocorrelation(signal),
            "turnover": diagnostics.turnover(signal),
            "dispersion": diagnostics.dispersion(signal),
            "lead_lag": diagnostics.lead_lag(signal, panel),
            "ic_by_horizon": ic.summary(by_horizon).join(interval(by_horizon), ["factor", "horizon"], "left"),
            "ic_decay": decay,
            "ic_decay_ci": decay_ci,
            "natural_freq": natural,
            "returns_daily": daily,
            "returns_natural": slow,
            "sharpe_daily": sharpe(daily),
            "sharpe_natural": sharpe(slow),
        }
        return self

    def flags(self) -> dict[str, str]:
        """What stands out: a nearly static signal, next to no turnover, no dispersion."""
        r = self.results
        found = {}
        lag1 = r["autocorrelation"].where("lag = 1").first()
        if lag1 and lag1["autocorr"] is not None and lag1["autocorr"] > 0.95:
            found["autocorrelation"] = "quasi-static"
        moved = r["turnover"].where(F.col("rn") > self.signal.agg(F.min("rn")).first()[0]).agg(F.avg("turnover")).first()[0]
        if moved is not None and moved < 0.05:
            found["turnover"] = "very low"
        spread = r["dispersion"].agg(F.avg("dispersion")).first()[0]
        if spread is not None and spread < 0.01:
            found["dispersion"] = "near zero"
        return found

    def text(self) -> str:
        """The report to print: the flags, the coefficients by horizon and the best offset."""
        r = self.results
        lines = [f"{k}: {v}" for k, v in self.flags().items()]
        for row in r["ic_by_horizon"].orderBy("horizon").collect():
            show = lambda x: "-" if x is None else f"{x:+.4f}"
            lines.append(f"horizon {row.horizon}: mean {show(row.mean)}, t {show(row.t_stat)}, t Newey-West {show(row.t_nw)}, interval {show(row.ci_lower)} to {show(row.ci_upper)}")
        best = r["lead_lag"].where("mean_ic is not null").orderBy(F.desc(F.abs("mean_ic")), "offset").first()
        if best:
            lines.append(f"largest coefficient at offset {best.offset}: {best.mean_ic:+.4f}")
        lines.append(f"natural frequency: {r['natural_freq']}")
        return "\n".join(lines)

    def panels(self) -> dict[str, DataFrame]:
        """The data of four plots."""
        r = self.results
        both = r["returns_daily"].withColumn("run", F.lit("daily")).unionByName(r["returns_natural"].withColumn("run", F.lit("natural")))
        return {"autocorrelation": r["autocorrelation"], "decay": r["ic_decay_ci"], "lead_lag": r["lead_lag"], "equity": metrics.drawdowns(both, ["run", "factor"], from_one=False)}
