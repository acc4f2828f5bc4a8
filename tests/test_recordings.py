"""Recorded responses at size: what a request reads, units that stay rows, overviews in more files than one."""

import json
from datetime import datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from panelforge.sources import fundamentals, vendor

N = 6_000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Overviews of N tickers, a second kind, and a ticker with many pages."""
    path = str(tmp_path_factory.mktemp("recordings") / "r")
    names = spark.range(N).select(F.format_string("T%05d", "id").alias("ticker"))
    body = F.concat(F.lit('{"Symbol": "'), F.col("ticker"), F.lit('", "EPS": "1", "Name": "'), *[F.sha2(F.concat("ticker", F.lit(k)), 512) for k in range(8)], F.lit('"}'))
    both = names.select(F.explode(F.array(F.lit("OVERVIEW"), F.lit("EARNINGS"))).alias("kind"), "ticker", F.lit(0).alias("page"), body.alias("body"))
    pages = spark.range(4_000).select(F.lit("bars").alias("kind"), F.lit("P").alias("ticker"), F.col("id").cast("int").alias("page"), F.repeat(F.sha2(F.col("id").cast("string"), 512), F.lit(4)).alias("body"))
    vendor.record(both.unionByName(pages), path)
    return path


def test_a_request_reads_one_small_group(folder, monkeypatch):
    read = []
    plain = pq.ParquetFile.read_row_group
    monkeypatch.setattr(pq.ParquetFile, "read_row_group", lambda self, k, **o: read.append(k) or plain(self, k, **o))
    held = vendor._Recordings(folder)
    assert sum(f.num_row_groups for f in held.footers.values()) > 8
    for k in range(N):
        assert json.loads(held.find("OVERVIEW", f"T{k:05}", 0))["Symbol"] == f"T{k:05}"
    groups = len(held.of_kind("OVERVIEW")[0])
    assert len(read) <= groups + 1  # in order: each group once, and not once a request
    assert held.find("OVERVIEW", "T00007x", 0) is None and held.find("OVERVIEW", "A", 0) is None and held.find("NONE", "T00001", 0) is None
    read.clear()
    assert all(held.find("bars", "P", k) for k in (0, 1_999, 3_999)) and held.find("bars", "P", 4_000) is None
    vendor._recordings.cache_clear()
    assert vendor.recorded({"path": folder, "kind": "EARNINGS", "ticker": "T05999"}) == held.find("EARNINGS", "T05999", 0)


def logged(request):
    if request["ticker"] == "T00003":
        raise ConnectionError("no route")
    return vendor.recorded(request)


def test_units_stay_rows(spark, folder, tmp_path):
    universe = spark.range(N).select(F.col("id").cast("int").alias("ord"), F.format_string("T%05d", "id").alias("ticker"))
    now = datetime(2024, 3, 8, 12)
    cache = spark.createDataFrame([("T00001", '{"Symbol": "T00001", "EPS": 2}', datetime(2024, 3, 8))], "ticker string, body string, fetched_at timestamp")
    got = fundamentals.collect_rows(universe, cache, lambda u: vendor.answers(u, path=folder, transport="tests.test_recordings:logged", lanes="3"), now)
    old = fundamentals.collect(universe, cache, lambda u: vendor.fetch(spark, u, path=folder, transport="tests.test_recordings:logged", lanes="3"), now)
    assert got.overviews.exceptAll(old.overviews).count() == 0 and old.overviews.exceptAll(got.overviews).count() == 0
    assert got.overviews.count() == N - 1 and got.overviews.where("origin = 'cache'").first().eps == 2.0
    assert [(r.ticker, r.status, r.message) for r in got.rejected.collect()] == [("T00003", "unreachable", "ConnectionError: no route")]
    assert got.cache.count() == N - 1
    path = str(tmp_path / "o")
    fundamentals.save_overviews(got.overviews, path)
    assert len(list((tmp_path / "o").glob("*.csv"))) > 1  # not all through one task
    assert fundamentals.load_overviews(spark, path).count() == N - 1
    empty = fundamentals.collect_rows(universe.limit(0), cache, lambda u: vendor.answers(u, path=folder, lanes="3"), now)
    assert empty.overviews.count() == 0
