"""Run one cycle of the fundamentals collector: python -m panelforge.collect --fetcher module:function ..."""

from __future__ import annotations

import argparse
import os
from datetime import date
from importlib import import_module

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.session import get_session
from panelforge.sources import fundamentals
from panelforge.sources.schemas import LEDGER
from panelforge.sources.universe import load_constituents


def main(args: list[str] | None = None) -> fundamentals.Cycle:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--constituents", required=True, help="CSV of ticker, company, sector")
    parser.add_argument("--ledger", required=True, help="tab-separated ticker, endpoint, last_fetch; rewritten after every success")
    parser.add_argument("--fetcher", help="module:function of (ticker, endpoint), returns the number of quarters")
    parser.add_argument("--budget", type=int, default=20)
    parser.add_argument("--refresh-days", type=int, default=30)
    parser.add_argument("--dry-run", action="store_true")
    a = parser.parse_args(args)
    if not a.fetcher and not a.dry_run:
        parser.error("--fetcher is needed unless --dry-run")
    spark = get_session("collect")
    names = load_constituents(spark, a.constituents).where("ticker is not null").select("ticker").distinct()
    universe = names.select((F.row_number().over(Window.orderBy("ticker")) - 1).alias("ord"), "ticker")
    try:
        with open(a.ledger) as f:
            rows = [tuple(line.rstrip("\n").split("\t")) for line in f if line.strip()]
    except FileNotFoundError:
        rows = []
    ledger = spark.createDataFrame([(t, e, date.fromisoformat(d) if d else None) for t, e, d in rows], LEDGER)

    def save(df) -> None:
        lines = ["\t".join((r["ticker"], r["endpoint"], r["last_fetch"].isoformat() if r["last_fetch"] else "")) for r in df.orderBy("ticker", "endpoint").collect()]
        draft = f"{a.ledger}.draft"
        with open(draft, "w") as f:
            f.write("".join(x + "\n" for x in lines))
        os.replace(draft, a.ledger)  # whoever is stopped meanwhile leaves the ledger of the last success

    fetch = getattr(import_module(a.fetcher.partition(":")[0]), a.fetcher.partition(":")[2]) if a.fetcher else None
    cycle, _ = fundamentals.run_cycle(spark, universe, ledger, fetch, date.today(), a.budget, a.refresh_days, save, a.dry_run)
    print(f"fetched {cycle.fetched}, errors {cycle.errors}, remaining {cycle.remaining}")
    return cycle


if __name__ == "__main__":
    main()
