from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from panelforge.sources import fundamentals, universe
from panelforge.sources.schemas import BARS, LEDGER
from panelforge.sources.store import BarStore, FileSource, merge_bars, missing_ranges
from panelforge.streaming.upsert import stream_bars


def bars(spark, rows):
    return spark.createDataFrame([(t, datetime(2024, 1, d), c, c, c, c, 10) for t, d, c in rows], BARS)


def closes(df):
    return {(r.ticker, r.timestamp.day): r.close for r in df.collect()}


def test_last_part_wins(spark):
    merged = merge_bars([bars(spark, [("A", 1, 1.0), ("A", 2, 2.0)]), bars(spark, [("A", 2, 9.0), ("A", 3, 3.0)])])
    assert closes(merged) == {("A", 1): 1.0, ("A", 2): 9.0, ("A", 3): 3.0}
    assert closes(merge_bars([merged, merged])) == closes(merged)


def test_ranges():
    d = lambda n: datetime(2024, 1, n)
    assert missing_ranges(None, None, d(1), d(5)) == [(d(1), d(5))]
    assert missing_ranges(d(3), d(6), d(1), d(9)) == [(d(1), d(3)), (d(6), d(9))]
    assert missing_ranges(d(1), d(9), d(2), d(5)) == []


def test_store(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "s"))
    assert store.load() is None and store.list_tickers() == [] and store.metadata("A") is None and store.panel().count() == 0
    store.upsert(bars(spark, [("A", 1, 1.0), ("A", 2, 2.0), ("B", 2, 5.0)]))
    store.upsert(bars(spark, [("A", 2, 7.0), ("C", 4, 1.0)]))
    assert closes(store.load()) == {("A", 1): 1.0, ("A", 2): 7.0, ("B", 2): 5.0, ("C", 4): 1.0}
    assert store.list_tickers() == ["A", "B", "C"]
    note = store.metadata("A")
    assert (note["start"], note["end"], note["schema_version"]) == (datetime(2024, 1, 1), datetime(2024, 1, 2), 1)
    panel = store.panel(["A", "B", "none"])
    assert panel.count() == 4 and panel.where("close is not null").count() == 3
    assert BarStore(spark, str(tmp_path / "s"), "unadjusted").load().count() == 0
    with pytest.raises(ValueError):
        BarStore(spark, "x", "other")
    with pytest.raises(ValueError):
        BarStore(spark, "x", timeframe="2Day")


def test_fetch_only_what_is_missing(spark, tmp_path):
    bars(spark, [("A", d, float(d)) for d in range(1, 11)]).write.parquet(str(tmp_path / "vendor"))
    asked = []

    class Counting(FileSource):
        def bars(self, spark, ticker, timeframe, start, end, adjustment):
            asked.append((start.day, end.day))
            return super().bars(spark, ticker, timeframe, start, end, adjustment)

    store, source = BarStore(spark, str(tmp_path / "s")), Counting(str(tmp_path / "vendor"))
    d = lambda n: datetime(2024, 1, n)
    assert store.fetch("A", d(4), d(7), source).count() == 3
    assert store.fetch("A", d(2), d(9), source).count() == 7
    assert asked == [(4, 7), (2, 4), (6, 9)]
    assert store.fetch("A", d(3), d(5), source).count() == 7 and len(asked) == 3


def test_stream(spark, tmp_path):
    store, path = BarStore(spark, str(tmp_path / "s")), str(tmp_path / "in")
    bars(spark, [("A", 1, 1.0), ("A", 2, 2.0)]).write.parquet(path)
    stream_bars(store, path, str(tmp_path / "c")).awaitTermination()
    bars(spark, [("A", 2, 8.0), ("B", 1, 3.0)]).write.mode("append").parquet(path)
    for _ in range(2):
        stream_bars(store, path, str(tmp_path / "c")).awaitTermination()
    assert closes(store.load()) == {("A", 1): 1.0, ("A", 2): 8.0, ("B", 1): 3.0}


def test_constituents(spark, tmp_path):
    w = spark.createDataFrame([(" brk-b ", "Berkshire", 1, 2.5), ("AAA", "A", 2, None), ("ZZZ", "Z", 3, 9.0)], "ticker string, company string, rank int, weight double")
    s = spark.createDataFrame([("BRK/B", "Financials", "Insurance"), ("NEW", "Tech", "Chips")], "ticker string, sector string, sub_industry string")
    rows = {r.ticker: r for r in universe.merge_constituents(w, s).collect()}
    assert {t: r.found for t, r in rows.items()} == {"BRK.B": "both", "AAA": "weights", "ZZZ": "weights", "NEW": "sectors"}
    assert [r.ticker for r in universe.by_weight(universe.merge_constituents(w, s)).collect()][:2] == ["ZZZ", "BRK.B"]
    path = tmp_path / "c.csv"
    path.write_text('ticker,company,sector\nA,"One, Inc.",Tech\nB,Two,\nA,"One, Inc.",Utilities\n')
    c = universe.load_constituents(spark, str(path))
    assert c.where("ticker = 'A'").first().company == "One, Inc."
    assert [(r.ticker, r.sector) for r in universe.sector_map(c).collect()] == [("A", "Utilities")]
    assert universe.sector_map(c, ["B"]).count() == 0


def test_html_tables(spark):
    html = "<table><tr><th>Other</th></tr></table><table><tr><th>#</th><th>Company</th><th>Symbol</th><th>Weight</th></tr><tr><td>1</td><td>X &amp; Y</td><td><a>x-y</a></td><td>6.5%</td></tr><tr><td>?</td><td>Z</td><td>z</td><td>n/a</td></tr></table>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>none</p>")], "page_id long, html string")
    got = universe.parse_weights(universe.html_tables(pages)).orderBy(F.asc_nulls_last("rank")).collect()
    assert [tuple(r) for r in got] == [(1, "X & Y", "X.Y", 6.5), (None, "Z", "Z", None)]


def test_fundamentals(spark):
    raw = spark.createDataFrame([("A", "None", "12.5", "1e9")], "Symbol string, EPS string, PERatio string, MarketCapitalization string")
    row = fundamentals.overview(raw).first()
    assert (row.ticker, row.eps, row.pe_ratio, row.market_cap, row.roe, len(row)) == ("A", None, 12.5, 1e9, None, 13)
    st = spark.createDataFrame([("EARNINGS", '{"quarterlyEarnings": [1, 2]}'), ("INCOME_STATEMENT", '{"annualReports": [1]}'), ("OTHER", "{}")], "endpoint string, payload string")
    assert sorted(r.n_quarters for r in fundamentals.quarter_counts(st).collect()) == [0, 0, 2]
    cached = spark.createDataFrame([("A", date(2024, 1, 1)), ("B", date(2024, 1, 9))], "ticker string, fetched_at date")
    assert [r.ticker for r in fundamentals.fresh(cached, date(2024, 1, 10)).collect()] == ["B"]


def test_queue_and_cycle(spark):
    today = date(2024, 3, 1)
    names = spark.createDataFrame([(0, "A"), (1, "B")], "ord int, ticker string")
    ledger = spark.createDataFrame([("A", "EARNINGS", date(2024, 1, 1)), ("B", "EARNINGS", date(2023, 12, 1)), ("B", "BALANCE_SHEET", date(2024, 2, 28))], LEDGER)
    queue = [(r.ticker, r.endpoint) for r in fundamentals.fetch_queue(names, ledger, today).orderBy("place").collect()]
    assert queue == [("A", "INCOME_STATEMENT"), ("A", "BALANCE_SHEET"), ("B", "INCOME_STATEMENT"), ("B", "EARNINGS"), ("A", "EARNINGS")]
    asked, saved = [], []

    def fetch(ticker, endpoint):
        asked.append((ticker, endpoint))
        if len(asked) == 2:
            return 0
        if len(asked) == 4:
            raise fundamentals.RateLimited("enough")
        return 4

    cycle, after = fundamentals.run_cycle(spark, names, ledger, fetch, today, budget=10, save=lambda d: saved.append(d.count()))
    assert (cycle.fetched, cycle.errors, cycle.remaining, len(asked)) == (2, 1, 3, 4)
    assert saved == [4, 5] and after.where(F.col("last_fetch") == F.lit(today)).count() == 2
    dry, same = fundamentals.run_cycle(spark, names, ledger, fetch, today, dry_run=True)
    assert dry.remaining == 5 and same is ledger
    tight, _ = fundamentals.run_cycle(spark, names, ledger, lambda t, e: 1, today, budget=2)
    assert (tight.fetched, tight.remaining) == (2, 3)


def stub_fetcher(ticker, endpoint):
    return 3


def test_collector_from_the_command_line(spark, tmp_path):
    from panelforge import collect

    (tmp_path / "c.csv").write_text("ticker,company,sector\nA,One,Tech\nB,Two,Tech\n")
    args = ["--constituents", str(tmp_path / "c.csv"), "--ledger", str(tmp_path / "ledger")]
    assert collect.main([*args, "--dry-run"]).remaining == 6
    assert collect.main([*args, "--fetcher", "tests.test_sources:stub_fetcher", "--budget", "4"]).fetched == 4
    assert collect.main([*args, "--dry-run"]).remaining == 2
