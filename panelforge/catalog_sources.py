"""Registered queries of sources, stores, streams and trading records, with their SQL oracles.

Each derives its input from the given tables, writes it to a scratch folder where
the source needs files, and reads it back the way a user would.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.operators import positions
from panelforge.sources import fundamentals, universe, vendor
from panelforge.sources.files import scratch_folder
from panelforge.sources.store import BarStore
from panelforge.streaming.upsert import end_of_ticks, stream_ticks

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def on_tables(oracle: str):
    def register(f):
        _QUERIES[f.__name__], _ORACLES[f.__name__] = f, oracle
        return f

    return register


# --- bars of events: an event type is a ticker, an hour a bar -------------------------------------------------

_HOURS = """
h AS (SELECT event_type AS ticker, date_trunc('hour', ts) AS "timestamp", arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, count(*) AS volume FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"""
_BAR = 'ticker, "timestamp", open, high, low, close, volume'


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("value is not null")
    first, last = F.min_by("value", "event_id"), F.max_by("value", "event_id")
    return e.groupBy(F.col("event_type").alias("ticker"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("timestamp")).agg(first.alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), last.alias("close"), F.count("*").alias("volume"))


def naive(df: DataFrame, *columns: str) -> DataFrame:
    """Moments without a zone, as the tables have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def recorded_bars(spark: SparkSession, sf_dir: str) -> str:
    """A folder of recorded responses: each ticker's bars, a day a page."""
    path = scratch_folder(spark, "responses")
    bar = F.struct(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"))
    days = hours(spark, sf_dir).groupBy("ticker", F.to_date("timestamp").alias("day")).agg(F.sort_array(F.collect_list(bar)).alias("bars"))
    by_day = Window.partitionBy("ticker").orderBy("day")
    page = F.row_number().over(by_day) - 1
    more = F.when(F.lead("day").over(by_day).isNotNull(), page + 1)
    pages = days.select(F.lit("bars").alias("kind"), "ticker", page.alias("page"), F.to_json(F.struct("bars", more.alias("next_page_token"))).alias("body"))
    vendor.record(pages, path)
    return path


@on_tables(f"WITH {_HOURS} SELECT {_BAR} FROM h WHERE ticker IN ('click', 'purchase') AND \"timestamp\" >= TIMESTAMP '2024-01-05 06:00:00' AND \"timestamp\" < TIMESTAMP '2024-01-20 00:00:00'")
def vendor_bars_window(spark, sf_dir):
    """Two tickers and a span of days from the vendor format: both filters are pushed to its requests."""
    path = recorded_bars(spark, sf_dir)
    df = vendor.register(spark).read.format("vendor_bars").options(path=path, timeframe="1Hour").load()
    at = lambda text: F.lit(text).cast("timestamp")
    return naive(df.where(F.col("ticker").isin("click", "purchase") & (F.col("timestamp") >= at("2024-01-05 06:00:00")) & (F.col("timestamp") < at("2024-01-20 00:00:00"))), "timestamp")


@on_tables(f"WITH {_HOURS} SELECT {_BAR} FROM h WHERE \"timestamp\" >= TIMESTAMP '2024-01-03 00:00:00' AND \"timestamp\" < TIMESTAMP '2024-01-25 00:00:00'")
def store_fetch(spark, sf_dir):
    """Every ticker fetched for some days, then for more on both sides: only what is missing is asked for."""
    source = vendor.VendorSource({"path": recorded_bars(spark, sf_dir)})
    store, day = BarStore(spark, scratch_folder(spark, "store"), timeframe="1Hour"), lambda d: datetime(2024, 1, d)
    for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct().toLocalIterator():
        for a, b in ((day(10), day(15)), (day(3), day(25))):
            store.fetch(r["event_type"], a, b, source)
    return naive(store.load(), "timestamp")


def two_deliveries(spark: SparkSession, sf_dir: str) -> BarStore:
    """A store after two deliveries that overlap and together hold every hour; the second doubles what it brings."""
    bars = hours(spark, sf_dir)
    store, day = BarStore(spark, scratch_folder(spark, "store"), timeframe="1Hour"), F.day("timestamp")
    store.upsert(bars.where(day <= 20), "first")
    store.upsert(bars.where(day >= 12).withColumns({c: 2 * F.col(c) for c in ("open", "high", "low", "close")}), "second")
    return store


_TWICE = _HOURS + ', d AS (SELECT ticker, "timestamp", ' + ", ".join(f"CASE WHEN day(\"timestamp\") >= 12 THEN 2 ELSE 1 END * {c} AS {c}" for c in ("open", "high", "low", "close")) + ", volume FROM h)"


@on_tables(f"WITH {_TWICE} SELECT {_BAR} FROM d")
def store_upsert(spark, sf_dir):
    """What a store holds after two overlapping deliveries; the last write of a bar wins."""
    return naive(two_deliveries(spark, sf_dir).load(), "timestamp")


@on_tables(f"WITH {_HOURS} SELECT {_BAR} FROM h WHERE day(\"timestamp\") <= 20")
def store_earlier_snapshot(spark, sf_dir):
    """The same store as it was after the first delivery."""
    return naive(two_deliveries(spark, sf_dir).load(version=1), "timestamp")


@on_tables(f"""WITH {_TWICE} SELECT ticker, '1Hour' AS timeframe, 'adjusted' AS adjustment, 'second' AS source, min("timestamp") AS start, max("timestamp") AS "end", CAST(1 AS INTEGER) AS schema_version FROM d GROUP BY ticker""")
def store_manifest(spark, sf_dir):
    """The notes of every ticker, without the moment of the fetch."""
    return naive(two_deliveries(spark, sf_dir).manifest().drop("fetch_timestamp"), "start", "end")


@on_tables(f"""WITH {_HOURS}, b AS (SELECT ticker, CAST("timestamp" AS DATE) AS date, arg_min(open, "timestamp") AS open, max(high) AS high, min(low) AS low, arg_max(close, "timestamp") AS close, CAST(sum(volume) AS BIGINT) AS volume FROM h WHERE ticker <> 'error' GROUP BY 1, 2),
k AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS rn FROM (SELECT DISTINCT date FROM b)), t AS (SELECT DISTINCT ticker FROM b)
SELECT k.date, k.rn, t.ticker, b.open, b.high, b.low, b.close, b.volume FROM k CROSS JOIN t LEFT JOIN b ON b.date = k.date AND b.ticker = t.ticker""")
def store_panel(spark, sf_dir):
    """The dense daily panel of some of a store's tickers."""
    store = BarStore(spark, scratch_folder(spark, "store"))
    day = hours(spark, sf_dir).groupBy("ticker", F.date_trunc("day", "timestamp").alias("day"))
    store.write(day.agg(F.min_by("open", "timestamp").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "timestamp").alias("close"), F.sum("volume").alias("volume")).withColumnRenamed("day", "timestamp"))
    return store.panel([t for t in store.list_tickers() if t != "error"]).select("date", "rn", "ticker", "open", "high", "low", "close", "volume")


@on_tables("""SELECT event_type AS ticker, date_trunc('day', ts) AS "timestamp", arg_min(value, (ts, value)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, value)) AS close, count(*) AS volume FROM events GROUP BY 1, 2""")
def stream_daily_bars(spark, sf_dir):
    """Events as a stream of ticks, up to a day out of order and half of them twice, against their daily bars. A delivery is ten days, in as many files as there are cores, and a micro-batch."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("tick_id"), F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("value").alias("price"), F.lit(1).cast("long").alias("size"))
    ticks, path = e.withColumn("_late", F.pmod(F.xxhash64("tick_id"), F.lit(86_400))), scratch_folder(spark, "ticks")
    arrives = F.floor((F.unix_timestamp("timestamp") + F.col("_late")) / (10 * 86_400))
    arrived, files = ticks.select("*", arrives.alias("_file")).persist(), spark.sparkContext.defaultParallelism
    try:
        for (k,) in sorted(arrived.select("_file").distinct().collect()):
            # of those that come again, the repetition comes with the next file
            again = arrived.where((F.col("_file") == k - 1) & (F.col("_late") % 2 == 0))
            arrived.where(F.col("_file") == k).unionByName(again).drop("_file", "_late").repartition(files).write.mode("append").parquet(path)
        last = arrived.agg(F.max("timestamp")).first()[0]
    finally:
        arrived.unpersist()
    end_of_ticks(spark, path, last + timedelta(days=60))
    store = BarStore(spark, scratch_folder(spark, "store"))
    stream_ticks(store, path, scratch_folder(spark, "offsets"), wait="15 days", files=files).awaitTermination()
    return naive(store.load(), "timestamp")


# --- fundamentals of suppliers ------------------------------------------------------------------------------

_NUMBERS = list(fundamentals.NUMBER_FIELDS.items())


def overview_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, ord, body: what a vendor might say of each supplier; by the last digit of its number an error, a refusal, half an object, or an overview."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    number = lambda k: F.when(F.col("s_suppkey") % (k + 3) == 0, "None").otherwise((F.col("s_acctbal") + k).cast("string"))
    fields = [F.col("s_name").alias("Symbol"), F.concat(F.lit('Company "'), F.col("s_suppkey"), F.lit('", Inc.')).alias("Name"), F.when(F.col("s_nationkey") > 4, F.concat(F.lit("Sector "), F.col("s_nationkey"))).alias("Sector")]
    full = F.to_json(F.struct(*fields, *[number(k).alias(name) for k, (name, _) in enumerate(_NUMBERS)]))
    digit = F.col("s_suppkey") % 10
    body = F.when(digit == 1, '{"Error Message": "unknown symbol"}').when(digit == 2, '{"Note": "too many a minute"}').when(digit == 3, '{"Information": "too many a day"}').when(digit == 4, '{"Symbol": "cut').when(digit == 5, '["no object"]').otherwise(full)
    return s.select(F.col("s_name").alias("ticker"), F.col("s_suppkey").cast("int").alias("ord"), body.alias("body"), full.alias("full"))


_OVERVIEW = "SELECT s_name AS ticker, 'Company \"' || s_suppkey || '\", Inc.' AS company, CASE WHEN s_nationkey > 4 THEN 'Sector ' || s_nationkey END AS sector, " + ", ".join(f"CASE WHEN s_suppkey % {k + 3} <> 0 THEN s_acctbal + {k} END AS {c}" for k, (_, c) in enumerate(_NUMBERS))
_NOW = datetime(2024, 6, 1)


def collected(spark: SparkSession, sf_dir: str) -> fundamentals.Collected:
    """An overview collection in which suppliers of nation 7 have a fresh cached body and those of nation 8 a stale one."""
    bodies, path = overview_bodies(spark, sf_dir), scratch_folder(spark, "responses")
    vendor.record(bodies.select(F.lit("OVERVIEW").alias("kind"), "ticker", F.lit(0).alias("page"), "body"), path)
    nations = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_name").alias("ticker"), "s_nationkey")
    age = F.when(F.col("s_nationkey") == 7, 6).when(F.col("s_nationkey") == 8, 7)
    cache = bodies.join(nations, "ticker").where(age.isNotNull()).select("ticker", F.col("full").alias("body"), (F.lit(_NOW) - F.make_dt_interval(age)).alias("fetched_at"))
    return fundamentals.collect_rows(bodies.select("ord", "ticker"), cache, lambda units: vendor.answers(units, path=path, lanes="4"), _NOW)


@on_tables(f"{_OVERVIEW}, CASE WHEN s_nationkey = 7 THEN 'cache' ELSE 'fetched' END AS origin FROM supplier WHERE s_nationkey = 7 OR s_suppkey % 10 NOT IN (1, 2, 3, 4, 5)")
def overview_collect(spark, sf_dir):
    """The thirteen typed columns of every supplier that the cache or the vendor has."""
    return collected(spark, sf_dir).overviews.drop("asked")


@on_tables("""SELECT s_name AS ticker, 'OVERVIEW' AS endpoint, CASE s_suppkey % 10 WHEN 1 THEN 'error' WHEN 2 THEN 'rate_limited' WHEN 3 THEN 'rate_limited' ELSE 'malformed' END AS status,
CASE s_suppkey % 10 WHEN 1 THEN 'unknown symbol' WHEN 2 THEN 'too many a minute' WHEN 3 THEN 'too many a day' WHEN 4 THEN '{"Symbol": "cut' ELSE '["no object"]' END AS message
FROM supplier WHERE s_nationkey <> 7 AND s_suppkey % 10 IN (1, 2, 3, 4, 5)""")
def overview_rejected(spark, sf_dir):
    """What gave no data, and why."""
    return collected(spark, sf_dir).rejected.select("ticker", "endpoint", "status", "message")


@on_tables(f"{_OVERVIEW} FROM supplier WHERE s_nationkey = 7 OR s_suppkey % 10 NOT IN (1, 2, 3, 4, 5)")
def overview_file(spark, sf_dir):
    """The combined overviews, written as CSV and loaded again."""
    path = scratch_folder(spark, "overviews")
    fundamentals.save_overviews(collected(spark, sf_dir).overviews, path)
    return fundamentals.load_overviews(spark, path)


# --- constituents of customers ------------------------------------------------------------------------------


def constituent_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two web pages a nation out of the customers: a table of weights, and one of sectors whose sector cell spans the rows of a segment."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("symbol", F.translate(F.lower("c_name"), "#", "-"))
    cell = lambda x, tag="td": F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag.split(' ')[0]}>"))
    head = lambda *names: F.lit("<p>x</p><table><tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>")
    rows = F.sort_array(F.collect_list(F.struct("c_custkey", F.concat(F.lit("<tr>"), cell(F.col("c_custkey").cast("string")), cell(F.concat(F.lit("<b>Company</b>\n "), F.col("c_custkey"))), cell(F.col("symbol")), cell(F.concat(F.col("c_acctbal"), F.lit("%"))), F.lit("</tr>")).alias("row"))))
    weights = c.where("c_mktsegment <> 'MACHINERY'").groupBy("c_nationkey").agg(rows.alias("r")).select("c_nationkey", F.concat(head("#", "Company", "Symbol", "Weight"), F.array_join(F.transform("r", lambda x: x["row"]), ""), F.lit("</table>")).alias("html"))
    # the first row of a segment has the sector's cell, the others hang from it
    segment = c.where("c_mktsegment <> 'BUILDING'").groupBy("c_nationkey", "c_mktsegment").agg(F.sort_array(F.collect_list("symbol")).alias("s"))
    sector = F.concat(F.lit("<td rowspan="), F.size("s"), F.lit(">"), F.col("c_mktsegment"))
    line = lambda x, k: F.concat(F.lit("<tr><td>"), x, F.lit("<td colspan=2>Name"), F.when(k == 0, F.col("sector")).otherwise(F.lit("")))
    block = segment.withColumn("sector", sector).select("c_nationkey", "c_mktsegment", F.array_join(F.transform("s", line), "").alias("rows"))
    sectors = block.groupBy("c_nationkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_mktsegment", "rows"))), lambda x: x["rows"]), "").alias("r"))
    return weights, sectors.select("c_nationkey", F.concat(head("Symbol", "Security", "Security", "GICS Sector"), F.col("r"), F.lit("</table>")).alias("html"))


def merged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, sectors = constituent_pages(spark, sf_dir)
    return universe.merge_constituents(universe.parse_weights(universe.html_tables(weights)), universe.parse_sectors(universe.html_tables(sectors)))


_MERGED = """SELECT CASE WHEN c_mktsegment <> 'MACHINERY' THEN CAST(c_custkey AS INTEGER) END AS rank, translate(upper(c_name), '#', '.') AS ticker, CASE WHEN c_mktsegment <> 'MACHINERY' THEN 'Company ' || c_custkey END AS company,
CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_acctbal END AS weight, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS sector, CAST(NULL AS VARCHAR) AS sub_industry"""


@on_tables(f"{_MERGED}, CASE c_mktsegment WHEN 'MACHINERY' THEN 'sectors' WHEN 'BUILDING' THEN 'weights' ELSE 'both' END AS found FROM customer")
def constituent_pages_merged(spark, sf_dir):
    """Weights and sectors out of HTML tables with spans, merged."""
    return merged_pages(spark, sf_dir)


@on_tables("SELECT translate(upper(c_name), '#', '.') AS ticker, CASE c_mktsegment WHEN 'MACHINERY' THEN 'sectors' ELSE 'weights' END AS found FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING')")
def constituents_in_one_source(spark, sf_dir):
    return universe.only_in_one(merged_pages(spark, sf_dir))


@on_tables(f"{_MERGED} FROM customer")
def constituent_file(spark, sf_dir):
    """Merged constituents, written as CSV by weight and loaded again."""
    path = scratch_folder(spark, "constituents")
    universe.save_constituents(merged_pages(spark, sf_dir), path)
    return universe.load_constituents(spark, path, ranked=True)


_HELD = "c AS (SELECT DISTINCT c_name AS ticker, c_mktsegment AS segment, c_custkey AS k FROM customer), held AS (SELECT DISTINCT c_name AS ticker FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')"


def with_urgent_orders(spark: SparkSession, sf_dir: str, customers: DataFrame) -> DataFrame:
    """The customers that stand for tickers whose bars are held."""
    urgent = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
    return customers.join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@on_tables(f"WITH {_HELD} SELECT ticker FROM c WHERE ticker IN (SELECT ticker FROM held) AND ticker NOT IN ('Customer#000000004', 'Customer#000000001') UNION ALL SELECT ticker FROM c WHERE ticker = 'Customer#000000001' AND ticker IN (SELECT ticker FROM held) AND 'Customer#000000002' NOT IN (SELECT ticker FROM held)")
def universe_prep(spark, sf_dir):
    """Constituents that are held, without the market (4) and the other class (1) of a dual listing (2)."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    held = with_urgent_orders(spark, sf_dir, c)
    named = lambda d: d.select(F.col("c_name").alias("ticker"))
    return universe.prepare(named(c), named(held), market="Customer#000000004", twins={"Customer#000000001": "Customer#000000002"})


@on_tables(f"WITH {_HELD} SELECT ticker FROM c WHERE ticker NOT IN (SELECT ticker FROM held)")
def still_to_fetch(spark, sf_dir):
    """The set-difference of what is wanted and what is held."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    held = with_urgent_orders(spark, sf_dir, c)
    named = lambda d: d.select(F.col("c_name").alias("ticker"))
    return universe.not_held(named(c), named(held))


# --- trading records of line items ----------------------------------------------------------------------------


def line_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as fills: a supplier is a ticker; returned ones are sold."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(F.col("l_suppkey").cast("string").alias("ticker"), F.col("l_shipdate").cast("timestamp").alias("timestamp"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.col("l_quantity").cast("long").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_tax").alias("commission"))


@on_tables("""
WITH RECURSIVE f AS (SELECT CAST(l_suppkey AS VARCHAR) AS ticker, l_shipdate AS t, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, CAST(l_quantity AS BIGINT) AS q, l_extendedprice / l_quantity AS p, l_tax AS c FROM lineitem),
o AS (SELECT *, CASE side WHEN 'BUY' THEN q ELSE -q END AS s, row_number() OVER (PARTITION BY ticker ORDER BY t, side, q, p) AS k FROM f),
w AS (
  SELECT ticker, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS held, 0.0::DOUBLE AS average, 0.0::DOUBLE AS realized FROM (SELECT DISTINCT ticker FROM o)
  UNION ALL
  SELECT w.ticker, o.k, w.held + o.s,
    CASE WHEN w.held + o.s = 0 THEN 0.0 WHEN w.held = 0 OR sign(w.held) = sign(o.s) THEN (w.held * w.average + o.s * o.p) / (w.held + o.s) WHEN abs(o.s) > abs(w.held) THEN o.p ELSE w.average END,
    w.realized + CASE WHEN w.held = 0 OR sign(w.held) = sign(o.s) THEN 0.0 ELSE least(abs(w.held), abs(o.s)) * (o.p - w.average) * sign(w.held) END
  FROM w JOIN o ON o.ticker = w.ticker AND o.k = w.k + 1
),
n AS (SELECT ticker, max(k) AS k, arg_max(p, (t, p)) AS market, sum(c) AS c FROM o GROUP BY ticker)
SELECT ticker, held AS quantity, round(average, 6) AS avg_entry_price, market AS market_price, round(realized, 3) AS realized_pnl, round(c, 6) AS commission, round(held * market, 3) AS market_value, round(held * (market - average), 3) AS unrealized_pnl, CASE WHEN held > 0 THEN 'BUY' WHEN held < 0 THEN 'SELL' END AS side
FROM w JOIN n USING (ticker, k)""")
def positions_marked(spark, sf_dir):
    """Positions after all fills at average cost, at each ticker's last price."""
    fills = line_fills(spark, sf_dir)
    found = positions.marked(positions.positions(fills, fills))
    return found.withColumns({c: F.round(c, d) for c, d in {"avg_entry_price": 6, "realized_pnl": 3, "commission": 6, "market_value": 3, "unrealized_pnl": 3}.items()})


@on_tables("""
WITH s AS (SELECT CAST(l_suppkey AS VARCHAR) AS ticker, l_shipdate AS t, (l_discount - 0.05::DOUBLE) / 10 AS w, l_extendedprice / l_quantity AS p, CAST(l_quantity AS BIGINT) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS q FROM lineitem),
a AS (SELECT ticker, arg_max(w, (t, w)) AS w, max(t) AS t, arg_max(p, (t, p)) AS p, CAST(sum(q) AS BIGINT) AS held FROM s GROUP BY ticker),
c AS (SELECT ticker, t, CAST(trunc(w * 1e8::DOUBLE / p) AS BIGINT) - held AS d FROM a WHERE p > 0)
SELECT ticker, t AS "timestamp", CASE WHEN d > 0 THEN 'BUY' ELSE 'SELL' END AS side, abs(d) AS quantity, 'MARKET' AS order_type, CAST(NULL AS DOUBLE) AS limit_price FROM c WHERE d <> 0""")
def target_orders(spark, sf_dir):
    """Orders from the positions of all fills to each ticker's latest target weight."""
    fills = line_fills(spark, sf_dir)
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    signals = li.select(F.col("l_suppkey").cast("string").alias("ticker"), F.col("l_shipdate").cast("timestamp").alias("timestamp"), ((F.col("l_discount") - 0.05) / 10).alias("weight"))
    return naive(positions.orders(signals, positions.positions(fills, fills), fills, 1e8), "timestamp")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)
