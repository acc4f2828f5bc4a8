"""Responses as data sources: pushed filters, pages, refusals as rows, the cache."""

import json
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from panelforge.sources import fundamentals, vendor
from panelforge.sources.store import BarStore

DAY = datetime(2024, 1, 1, tzinfo=timezone.utc)


def logged(request):
    """The recorded transport, which also notes each request beside its folder."""
    with Path(request["path"] + ".log").open("a") as f:
        f.write(json.dumps(request) + "\n")
    return vendor.recorded(request)


def failing(request):
    if request["ticker"] == "DOWN":
        raise ConnectionError("no route")
    return vendor.recorded(request)


@pytest.fixture
def folder(spark, tmp_path):
    """Ten days of A in pages of four bars, three of B in one."""
    bar = lambda d: {"t": (DAY + timedelta(days=d)).isoformat().replace("+00:00", "Z"), "o": d, "h": d + 1, "l": d - 1, "c": d + 0.5, "v": 10 * d}
    pages = [("bars", "A", p, json.dumps({"bars": [bar(d) for d in range(4 * p, min(10, 4 * p + 4))], "next_page_token": p + 1 if p < 2 else None})) for p in range(3)]
    pages += [("bars", "B", 0, json.dumps({"bars": [bar(d) for d in range(3)]})), ("bars", "EMPTY", 0, json.dumps({"bars": None}))]
    path = str(tmp_path / "responses")
    vendor.record(spark.createDataFrame(pages, "kind string, ticker string, page int, body string"), path)
    return path


def requests(path):
    log = Path(path + ".log")
    asked = [json.loads(x) for x in log.read_text().splitlines()] if log.exists() else []
    log.unlink(missing_ok=True)
    return asked


def load(spark, path, **options):
    return vendor.register(spark).read.format("vendor_bars").options(path=path, transport="tests.test_vendor:logged", **options).load()


def test_filters_are_pushed(spark, folder):
    df = load(spark, folder).where((F.col("ticker").isin("A", "B")) & (F.col("timestamp") >= F.lit(DAY + timedelta(days=1))) & (F.col("timestamp") < F.lit(DAY + timedelta(days=6))))
    assert df.rdd.getNumPartitions() == 2
    requests(folder)
    assert sorted((r.ticker, r.open, r.volume) for r in df.collect()) == [*(("A", float(d), 10 * d) for d in range(1, 6)), ("B", 1.0, 10), ("B", 2.0, 20)]
    asked = requests(folder)
    assert {r["ticker"] for r in asked} == {"A", "B"} and [r["page"] for r in asked if r["ticker"] == "A"] == [0, 1, 2]
    assert {(r["start"], r["end"]) for r in asked} == {("2024-01-02T00:00:00+00:00", "2024-01-07T00:00:00+00:00")}


def test_bounds_of_every_kind_and_filters_that_stay(spark, folder):
    day = lambda d: F.lit(DAY + timedelta(days=d))
    t, a = F.col("timestamp"), F.col("ticker") == "A"
    opens = lambda where: sorted(int(r.open) for r in load(spark, folder).where(where).collect())
    assert opens(a & (t > day(3)) & (t <= day(6))) == [4, 5, 6]
    assert opens(a & (t >= day(3)) & (t > day(4)) & (t < day(9)) & (t <= day(7))) == [5, 6, 7]
    assert opens(a & (t == day(3))) == [3]
    assert opens(a & ((t < day(1)) | (t > day(8)))) == [0, 9]
    assert opens(a & (F.col("close") > 7) & (F.col("volume") % 20 == 0)) == [8]


def test_options(spark, folder, monkeypatch):
    assert load(spark, folder, tickers='["B", "EMPTY", "NONE"]').count() == 3
    assert load(spark, folder, tickers='["A", "B"]', start="2024-01-03", end="2024-01-05").count() == 3
    assert load(spark, folder, tickers='["A", "B"]').where("ticker = 'B'").count() == 3
    for options, said in (({}, "name the tickers"), ({"tickers": "[]", "timeframe": "2Day"}, "timeframe"), ({"tickers": "[]", "adjustment": "none"}, "adjustment"), ({"tickers": "[]", "credentials": "NO_SUCH_KEY"}, "NO_SUCH_KEY must be set")):
        with pytest.raises(Exception, match=said):
            load(spark, folder, **options).count()


def test_the_store_asks_for_what_it_lacks(spark, folder, tmp_path):
    source = vendor.VendorSource({"path": folder, "transport": "tests.test_vendor:logged"})
    store, day = BarStore(spark, str(tmp_path / "s")), lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    assert store.fetch("A", day(4), day(7), source).count() == 3
    requests(folder)
    assert store.fetch("A", day(2), day(9), source).count() == 7
    assert {(r["start"][:10], r["end"][:10]) for r in requests(folder)} == {("2024-01-03", "2024-01-05"), ("2024-01-07", "2024-01-10")}
    assert store.metadata("A")["source"] == "VendorSource"


BODIES = {
    "GOOD": json.dumps({"Symbol": "GOOD", "Name": "Good, Inc.", "Sector": "TECH", "EPS": "1.5", "PERatio": "None", "Beta": "-", "DividendYield": " 0.02 ", "MarketCapitalization": 123, "ReturnOnEquityTTM": "NaN"}),
    "BAD": json.dumps({"Error Message": "unknown symbol"}),
    "NOTE": json.dumps({"Note": "5 a minute", "Symbol": "NOTE"}),
    "INFO": json.dumps({"Information": "25 a day"}),
    "NULLNOTE": json.dumps({"Note": None}),
    "CUT": '{"Symbol": "CU',
    "LIST": "[1, 2]",
    "EMPTY": "{}",
}


def responses(spark):
    rows = [(t, "OVERVIEW", b, None) for t, b in BODIES.items()] + [("DOWN", "OVERVIEW", None, "ConnectionError: no route")]
    return spark.createDataFrame(rows, "ticker string, endpoint string, body string, failure string")


def test_refusals_are_rows(spark):
    found = fundamentals.interpret(responses(spark))
    assert {r.ticker: r.status for r in found.collect()} == {"GOOD": "ok", "BAD": "error", "NOTE": "rate_limited", "INFO": "rate_limited", "NULLNOTE": "rate_limited", "CUT": "malformed", "LIST": "malformed", "EMPTY": "ok", "DOWN": "unreachable"}
    said = {r.ticker: r.message for r in fundamentals.dead_letters(found).collect()}
    assert said == {"BAD": "unknown symbol", "NOTE": "5 a minute", "INFO": "25 a day", "NULLNOTE": None, "CUT": '{"Symbol": "CU', "LIST": "[1, 2]", "DOWN": "ConnectionError: no route"}
    good = {r.ticker: r for r in fundamentals.overviews(found).collect()}
    assert set(good) == {"GOOD", None}
    row = good["GOOD"]
    assert (row.company, row.eps, row.pe_ratio, row.beta, row.dividend_yield, row.market_cap, row.roe) == ("Good, Inc.", 1.5, None, None, 0.02, 123.0, None)
    assert fundamentals.overviews(found).columns == fundamentals.OVERVIEW_COLUMNS and len(fundamentals.OVERVIEW_COLUMNS) == 13


def test_collect_with_a_cache(spark, tmp_path):
    path, now = str(tmp_path / "responses"), datetime(2024, 3, 8, 12)
    vendor.record(spark.createDataFrame([("OVERVIEW", t, 0, b) for t, b in BODIES.items()], "kind string, ticker string, page int, body string"), path)
    universe = spark.createDataFrame(list(enumerate([*BODIES, "DOWN", "FRESH", "OLD", "EDGE"])), "ord int, ticker string")
    body = lambda t, eps: json.dumps({"Symbol": t, "EPS": eps})
    ago = lambda **d: now - timedelta(**d)
    cache = spark.createDataFrame([("FRESH", body("FRESH", 1), ago(days=9)), ("FRESH", body("FRESH", 2), ago(days=6, hours=23)), ("OLD", body("OLD", 3), ago(days=8)), ("EDGE", body("EDGE", 4), ago(days=7))], "ticker string, body string, fetched_at timestamp")
    asked = []

    def fetch(units):
        asked.extend(units)
        return vendor.fetch(spark, units, path=path, transport="tests.test_vendor:failing", lanes="3")

    got = fundamentals.collect(universe, cache, fetch, now)
    assert [t for t, _ in asked] == [*BODIES, "DOWN", "OLD", "EDGE"]  # in the universe's order, without what is fresh
    assert {(r.asked, r.origin): r.eps for r in got.overviews.collect()} == {("FRESH", "cache"): 2.0, ("GOOD", "fetched"): 1.5, ("EMPTY", "fetched"): None}
    rejected = {r.ticker: r.status for r in got.rejected.collect()}
    assert rejected["DOWN"] == "unreachable" and rejected["OLD"] == "unreachable" and rejected["NOTE"] == "rate_limited"
    kept = {(r.ticker, r.fetched_at) for r in got.cache.collect()}
    assert ("GOOD", now) in kept and ("OLD", ago(days=8)) in kept and not any(t == "BAD" for t, _ in kept)
    with pytest.raises(FileNotFoundError):
        fundamentals.load_overviews(spark, str(tmp_path / "o"))
    fundamentals.save_overviews(got.overviews, str(tmp_path / "o"))
    back = {r.ticker: r for r in fundamentals.load_overviews(spark, str(tmp_path / "o")).collect()}
    assert back["GOOD"].company == "Good, Inc." and back["FRESH"].eps == 2.0 and len(back) == 3
    assert fundamentals.collect(universe.limit(0), cache, fetch, now).overviews.count() == 0
