"""Tables of pages at size: parsed and handed on some rows at a time; constituents written by all tasks."""

import tracemalloc

import pytest
from pyspark.sql import functions as F

from panelforge.sources import schemas, universe

HEAD = "<p>x<table><tr><th>Other<tr><td>1</table><table><tr><th>Symbol<th>Symbol<th>W"


def long_page(n):
    return HEAD + "".join(f"<tr><td>T{k}<td>n&amp;{k}" + (f"<td rowspan=3>{k}" if k % 3 == 0 else "") for k in range(n)) + "</table><table><tr><th>Symbol<tr><td>no</table>"


@pytest.mark.parametrize("chunk", [5, 97, 1 << 18])
def test_records_as_from_whole_grids(monkeypatch, chunk):
    monkeypatch.setattr(universe, "CHUNK", chunk)
    nested = "<table><tr><td><table><tr><th>Symbol<tr><td>in</table>out<tr><td>x</table>"
    unclosed = "<table><tr><td rowspan=0>Symbol<td>b<tr><td>c<tr><td>d"
    for html in (long_page(50), nested, nested.replace("out", "Symbol</td><td>Symbol"), unclosed, "<table></table>" + unclosed, "", "no table", "<table><td>Symbol", "a < b <table><tr><td>Symbol<tr><td>1 < 2 &amp"):
        for must in ("Symbol", None):
            found = [g for g in universe.grids(html) if must is None or must in g[0]]
            assert list(universe.records(html, must)) == (universe.headed(found[0]) if found else [])


def test_memory_does_not_follow_the_table():
    html = long_page(60_000)
    tracemalloc.start()
    rows = sum(1 for _ in universe.records(html, "Symbol"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 60_000 and peak < 8 << 20


def test_columns_of_pages_stay(spark):
    pages = spark.createDataFrame([(2**60 + 1, None, long_page(5_000)), (None, "b", long_page(3)), (3, "c", None)], "id long, note string, html string")
    got = universe.html_tables(pages)
    assert {(r.id, r.note): r.n for r in got.groupBy("id", "note").agg(F.count("*").alias("n")).collect()} == {(2**60 + 1, None): 5_000, (None, "b"): 3}
    assert got.where("id is not null and record['Symbol'] = 'T4999'").first().record == {"Symbol": "T4999", "Symbol.1": "n&4999", "W": "4998"}


def test_a_large_index_is_several_files_in_order(spark, tmp_path):
    n = 20_000
    rows = spark.range(n).select(F.col("id").cast("int").alias("rank"), F.format_string("T%05d", F.col("id")).alias("ticker"), F.lit("x").alias("company"), F.when(F.col("id") % 10 > 0, (F.hash("id") % 1_000).cast("double")).alias("weight"), F.lit("s").alias("sector"), F.lit(None).cast("string").alias("sub_industry")).select(*schemas.RANKED_CONSTITUENTS.names)
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        universe.save_constituents(rows, str(tmp_path / "c"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    files = sorted((tmp_path / "c").glob("*.csv"))
    assert len(files) > 1
    found = [r for f in files for r in universe.load_constituents(spark, str(f), ranked=True).select("weight", "ticker").collect()]
    assert [(r.weight, r.ticker) for r in found] == sorted(((r.weight, r.ticker) for r in found), key=lambda x: (x[0] is None, -(x[0] or 0), x[1])) and len(found) == n
