"""Tables out of HTML, universe steps, trading records, streams of ticks."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panelforge.operators import positions
from panelforge.sources import schemas, universe
from panelforge.sources.store import BarStore
from panelforge.streaming import upsert


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<table><tr><th rowspan=2>A<th colspan=2>B<tr><td>x<td>y</table>", [["A", "B", "B"], ["A", "x", "y"]]),
        ("<table><tr><td>1<td rowspan=3>2<tr><td>3<tr><td>4<tr><td>5<td>6</table>", [["1", "2"], ["3", "2"], ["4", "2"], ["5", "6"]]),
        ("<table><tr><td rowspan=0>all<td>1<tr><td>2<tr><td>3</table>", [["all", "1"], ["all", "2"], ["all", "3"]]),
        ("<table><tr><td colspan=2 rowspan=2>big<td>c<tr><td>d<tr><td>e<td>f<td>g", [["big", "big", "c"], ["big", "big", "d"], ["e", "f", "g"]]),
        ("<table><td>no row</table>", [["no row"]]),
        ("<table><tr><td>a<script>var x = '<td>'</script><br>b&amp;c</td></tr></table>", [["a b&c"]]),
        ("<table><tr><td colspan=x rowspan=-1>odd<td>n</table>", [["odd", "n"]]),
        ("<table><tr><td>1<td rowspan=2>2<td>3<tr><td>4</table>", [["1", "2", "3"], ["4", "2"]]),
    ],
)
def test_grids(html, want):
    assert universe.grids(f"<p>before</p>{html}") == [want]


def test_nested_tables_and_none():
    assert universe.grids("<table><tr><td><table><tr><td>in</table>out") == [[["out"]], [["in"]]]
    assert universe.grids("no table") == [] and universe.grids("<table></table>") == []


def test_headings(spark):
    assert universe.headed([["a", "a", "b"], ["1", "2", "3"], ["4"]]) == [{"a": "1", "a.1": "2", "b": "3"}, {"a": "4"}]
    page = "<table><tr><th>Menu<tr><td>x</table><table><tr><th>Symbol<th>GICS Sector<tr><td> brk-b <td>Financials<tr><td rowspan=2>bf/b<td>Staples<tr><td>Food</table>"
    pages = spark.createDataFrame([(1, page), (2, None), (3, "<p>none")], "id int, html string")
    got = universe.parse_sectors(universe.html_tables(pages)).collect()
    assert [tuple(r) for r in got] == [("BRK.B", "Financials", None), ("BF.B", "Staples", None), ("BF.B", "Food", None)]
    first = universe.html_tables(pages, must_have=None).collect()
    assert [r.record for r in first] == [{"Menu": "x"}]
    components = universe.parse_components(universe.html_tables(spark.createDataFrame([("<table><tr><th>Symbol<th>Name<tr><td>a<td>Alpha, Inc.",)], "html string")))
    assert components.first() == ("A", "Alpha, Inc.", None)


def test_universe_steps(spark, tmp_path):
    c = spark.createDataFrame([("GOOG",), ("GOOGL",), ("SPY",), ("B",), ("B",), (None,), ("Z",)], "ticker string")
    held = spark.createDataFrame([("GOOG",), ("GOOGL",), ("SPY",), ("B",), (None,)], "ticker string")
    names = lambda d: sorted(r.ticker for r in d.collect())
    assert names(universe.prepare(c, held)) == ["B", "GOOG", "GOOGL"]
    assert names(universe.prepare(c, held, twins={"GOOG": "GOOGL"})) == ["B", "GOOGL"]
    assert names(universe.prepare(c, held.where("ticker <> 'GOOGL'"), twins={"GOOG": "GOOGL"})) == ["B", "GOOG"]
    assert names(universe.not_held(c, held)) == ["Z"] and names(universe.not_held(c, held.limit(0))) == ["B", "B", "GOOG", "GOOGL", "SPY", "Z"]
    rows = [(2, "A", 'Quote "x", Inc.', 1.5, "S", "I"), (1, "C", None, 9.0, None, None), (3, "B", "B", None, "S", "I")]
    ranked = spark.createDataFrame(rows, schemas.RANKED_CONSTITUENTS)
    universe.save_constituents(ranked, str(tmp_path / "c"))
    assert [tuple(r) for r in universe.load_constituents(spark, str(tmp_path / "c"), ranked=True).collect()] == [rows[1], rows[0], rows[2]]


def fills(spark, rows):
    return spark.createDataFrame([("A", datetime(2024, 1, d), side, q, float(p), 1.0) for d, side, q, p in rows], schemas.FILL)


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(1, "BUY", 10, 5), (2, "BUY", 10, 7)], (20, 6.0, 0.0)),
        ([(1, "BUY", 10, 5), (2, "SELL", 4, 8)], (6, 5.0, 12.0)),
        ([(1, "BUY", 10, 5), (2, "SELL", 10, 8)], (0, 0.0, 30.0)),
        ([(1, "BUY", 10, 5), (2, "SELL", 15, 8)], (-5, 8.0, 30.0)),
        ([(1, "SELL", 10, 5), (2, "SELL", 10, 3), (3, "BUY", 5, 2)], (-15, 4.0, 10.0)),
        ([(1, "SELL", 10, 5), (2, "BUY", 10, 6), (3, "BUY", 2, 9)], (2, 9.0, -10.0)),
    ],
)
def test_positions(spark, rows, want):
    prices = spark.createDataFrame([("A", datetime(2024, 2, 1), 10.0), ("A", datetime(2024, 2, 2), None)], "ticker string, timestamp timestamp, price double")
    r = positions.marked(positions.positions(fills(spark, rows), prices)).first()
    quantity, average, realized = want
    assert (r.quantity, r.avg_entry_price, r.realized_pnl, r.commission) == (quantity, average, realized, float(len(rows)))
    assert (r.market_value, r.unrealized_pnl) == (quantity * 10.0, quantity * (10.0 - average))
    assert r.side == (None if quantity == 0 else "BUY" if quantity > 0 else "SELL")


def test_positions_without_prices_and_fills(spark):
    none = spark.createDataFrame([], "ticker string, timestamp timestamp, price double")
    assert positions.marked(positions.positions(fills(spark, [(1, "BUY", 3, 4)]), none)).first().unrealized_pnl == -12.0
    assert positions.positions(fills(spark, []), none).count() == 0


def test_orders(spark):
    at = lambda d: datetime(2024, 1, d)
    signals = spark.createDataFrame([("A", at(1), 0.9), ("A", at(2), 0.25), ("B", at(2), -0.1), ("C", at(2), 0.1), ("NEW", at(2), 0.5)], schemas.SIGNAL)
    held = spark.createDataFrame([("A", 10, 1.0, 1.0), ("C", 10, 1.0, 1.0), ("GONE", 7, 1.0, 1.0)], schemas.POSITION)
    prices = spark.createDataFrame([("A", at(3), 10.0), ("B", at(3), 3.0), ("C", at(3), 10.0), ("GONE", at(3), 1.0)], "ticker string, timestamp timestamp, price double")
    got = positions.orders(signals, held, prices, 1000)
    assert {(r.ticker, r.side, r.quantity, r.timestamp) for r in got.collect()} == {("A", "BUY", 15, at(2)), ("B", "SELL", 33, at(2)), ("GONE", "SELL", 7, at(3))}
    assert got.columns == schemas.ORDER.names and positions.invalid(got, "order").count() == 0


def test_invalid_records(spark):
    rows = [(None, datetime(2024, 1, 1), "BUY", 1, "MARKET", None), ("A", None, "HOLD", 0, "STOP", None), ("A", datetime(2024, 1, 1), "SELL", 1, "LIMIT", None), ("A", datetime(2024, 1, 1), "SELL", 1, "LIMIT", 2.0)]
    bad = positions.invalid(spark.createDataFrame(rows, schemas.ORDER), "order").collect()
    assert [r.why for r in bad] == [["no ticker"], ["no timestamp", "no such side", "no quantity", "no such order type"], ["no limit"]]
    with pytest.raises(ValueError, match="quantity"):
        positions.invalid(spark.createDataFrame([("A",)], "ticker string"), "position")


def feed(spark, path, *files):
    """Each file's ticks are (id, day, hour, price)."""
    for rows in files:
        spark.createDataFrame([(i, "A", datetime(2024, 1, 1) + timedelta(days=d, hours=h), float(p), 1) for i, d, h, p in rows], upsert.TICKS).coalesce(1).write.mode("append").parquet(path)


def closed(store):
    return {r.timestamp.day: (r.open, r.high, r.low, r.close, r.volume) for r in store.load().collect()}


def test_late_repeated_and_out_of_order_ticks(spark, tmp_path):
    path, store = str(tmp_path / "ticks"), BarStore(spark, str(tmp_path / "s"))
    feed(spark, path, [(1, 0, 9, 5), (2, 0, 12, 9)], [(4, 1, 10, 3), (1, 0, 9, 5)], [(3, 0, 6, 4), (2, 0, 12, 9), (4, 1, 10, 3)], [(5, 4, 1, 7)], [(5, 4, 1, 7), (7, 4, 0, 2)], [(6, 0, 23, 100)])
    upsert.end_of_ticks(spark, path, datetime(2024, 3, 1))
    upsert.stream_ticks(store, path, str(tmp_path / "c"), wait="2 days", files=1).awaitTermination()
    # 6 comes when day 1 is final; 3 is late but within the wait; the repetitions of 1, 2, 4 and 5 don't count
    assert closed(store) == {1: (4.0, 9.0, 4.0, 9.0, 3), 2: (3.0, 3.0, 3.0, 3.0, 1), 5: (2.0, 7.0, 2.0, 7.0, 2)}
    versions = store.versions()
    upsert.stream_ticks(store, path, str(tmp_path / "c"), wait="2 days", files=1).awaitTermination()
    assert store.versions() == versions  # nothing new, nothing done


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    path, store = str(tmp_path / "ticks"), BarStore(spark, str(tmp_path / "s"))
    feed(spark, path, [(1, 0, 9, 5)], [(2, 3, 9, 6)])
    upsert.stream_ticks(store, path, str(tmp_path / "c"), wait="1 day").awaitTermination()
    assert closed(store) == {1: (5.0, 5.0, 5.0, 5.0, 1)}
    feed(spark, path, [(2, 3, 9, 6), (3, 3, 10, 8)])  # a repetition of what the first run saw
    upsert.end_of_ticks(spark, path, datetime(2024, 3, 1))
    upsert.stream_ticks(store, path, str(tmp_path / "c"), wait="1 day").awaitTermination()
    assert closed(store) == {1: (5.0, 5.0, 5.0, 5.0, 1), 4: (6.0, 8.0, 6.0, 8.0, 2)}


def test_late_bars(spark, tmp_path):
    """Intraday bars of a stream against the same bars in a batch."""
    rows = [("A", datetime(2024, 1, 1) + timedelta(hours=h), float(h), float(h + 2), float(h - 2), float(h + 1), 1) for h in range(30)]
    bars = spark.createDataFrame(rows, schemas.BARS)
    bars.write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(None, datetime(2024, 3, 1), *[None] * 5)], schemas.BARS).write.mode("append").parquet(str(tmp_path / "in"))
    stream = upsert.late_bars(spark.readStream.schema(schemas.BARS).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert sorted(tuple(r)[2:] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0.0, 25.0, -2.0, 24.0, 24), (24.0, 31.0, 22.0, 30.0, 6)]
