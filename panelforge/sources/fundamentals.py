"""Fundamentals: what responses say, typed overviews, a cache, and a collector that spends a daily budget of requests on the stalest units."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.sources.files import Files
from panelforge.sources.schemas import LEDGER

OVERVIEW = "OVERVIEW"
ENDPOINTS = ["INCOME_STATEMENT", "BALANCE_SHEET", "EARNINGS"]
#: A key of a response that isn't data -> what it means: fixed values, in the order in which they are looked for.
REFUSALS = {"Error Message": "error", "Note": "rate_limited", "Information": "rate_limited"}
#: Endpoint -> the array whose entries are quarters: fixed values.
QUARTERS = {"INCOME_STATEMENT": "quarterlyReports", "BALANCE_SHEET": "quarterlyReports", "EARNINGS": "quarterlyEarnings"}
#: A vendor's field -> column, as text and as number: fixed values.
TEXT_FIELDS = {"Symbol": "ticker", "Name": "company", "Sector": "sector"}
NUMBER_FIELDS = {
    "ReturnOnEquityTTM": "roe", "ProfitMargin": "profit_margin", "OperatingMarginTTM": "operating_margin", "EPS": "eps", "PERatio": "pe_ratio", "DividendYield": "dividend_yield",
    "Beta": "beta", "QuarterlyEarningsGrowthYOY": "earnings_growth", "GrossProfitTTM": "gross_profit", "MarketCapitalization": "market_cap",
}


class RateLimited(ValueError):
    """The source has no more requests for now."""


def interpret(responses: DataFrame) -> DataFrame:
    """Responses (ticker, endpoint, body, failure) with payload (variant), status and message; none is an exception.

    status: ``ok``, ``error`` or ``rate_limited`` as the vendor says, ``unreachable``
    where there is no body, ``malformed`` where it isn't a JSON object. The payload
    is that of ``ok`` rows only.
    """
    v = F.try_parse_json("body")
    said = {key: F.try_variant_get(v, f"$['{key}']", "string") for key in REFUSALS}
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    there = lambda key: F.coalesce(F.array_contains(F.json_object_keys("body"), key), F.lit(False))
    status = F.when(F.col("body").isNull(), "unreachable").when(~is_object, "malformed")
    message = F.when(F.col("body").isNull(), F.col("failure")).when(~is_object, F.left("body", F.lit(200)))
    for key, meaning in REFUSALS.items():
        status, message = status.when(there(key), meaning), message.when(there(key), said[key])
    found = responses.withColumns({"status": status.otherwise("ok"), "message": message})
    return found.withColumn("payload", F.when(F.col("status") == "ok", F.try_parse_json("body")))


def dead_letters(interpreted: DataFrame) -> DataFrame:
    """ticker, endpoint, status, message, body of what gave no data."""
    return interpreted.where(F.col("status") != "ok").select("ticker", "endpoint", "status", "message", "body")


def _typed(field) -> list[Column]:
    """The thirteen columns, of ``field``: a vendor's name -> its text. What isn't there or no number is null."""

    def number(name: str) -> Column:
        x = field(name).try_cast("double")
        return F.when(~F.isnan(x), x)

    return [*[field(k).alias(v) for k, v in TEXT_FIELDS.items()], *[number(k).alias(v) for k, v in NUMBER_FIELDS.items()]]


def overviews(interpreted: DataFrame) -> DataFrame:
    """The thirteen typed columns of the overviews among interpreted responses."""
    good = interpreted.where((F.col("status") == "ok") & (F.col("endpoint") == OVERVIEW))
    return good.select(*_typed(lambda k: F.try_variant_get("payload", f"$['{k}']", "string")))


def overview(raw: DataFrame) -> DataFrame:
    """Thirteen typed columns of raw overviews (one string column a field); what isn't there or doesn't parse is null."""
    have = set(raw.columns)
    return raw.select(*_typed(lambda k: F.col(k) if k in have else F.lit(None).cast("string")))


def split_by_cache(universe: DataFrame, cache: DataFrame, now: datetime, days: float = 7) -> tuple[DataFrame, DataFrame]:
    """(cached, due): the bodies fetched less than ``days`` days before ``now``, and the tickers to ask for.

    ``universe`` is (ord, ticker), ``cache`` (ticker, body, fetched_at); of a
    ticker's cached bodies the last counts. A year of overviews is small, and the
    two share one join.
    """
    latest = cache.groupBy("ticker").agg(F.max_by(F.struct("body", "fetched_at"), "fetched_at").alias("held"))
    both = universe.join(latest, "ticker", "left")
    young = F.coalesce(F.col("held.fetched_at") > F.lit(now - timedelta(days=days)), F.lit(False))
    cached = both.where(young).select("ord", "ticker", F.lit(OVERVIEW).alias("endpoint"), "held.body", F.lit(None).cast("string").alias("failure"), "held.fetched_at")
    return cached, both.where(~young).select("ord", "ticker")


@dataclass
class Collected:
    """What a collection gave: typed overviews with where each came from, what gave no data, the cache to keep."""

    overviews: DataFrame
    rejected: DataFrame
    cache: DataFrame


def collect(universe: DataFrame, cache: DataFrame, fetch: Callable[[list[tuple[str, str]]], DataFrame], now: datetime, days: float = 7) -> Collected:
    """An overview of every ticker of the universe: from the cache while it is fresh, else from ``fetch``.

    ``fetch`` takes units (ticker, endpoint), in the universe's order, and gives
    their responses. Each unit is a request, so there are as many as requests.
    What it refuses is left out and kept in ``rejected``.
    """
    cached, due = split_by_cache(universe, cache, now, days)
    units = [(r["ticker"], OVERVIEW) for r in due.orderBy("ord").toLocalIterator()]
    return _collected(cached, cache, fetch(units), now)


def collect_rows(universe: DataFrame, cache: DataFrame, fetch: Callable[[DataFrame], DataFrame], now: datetime, days: float = 7) -> Collected:
    """As ``collect``, for any number of tickers: ``fetch`` takes the units as rows (ord, ticker, endpoint), so none of them pass through the driver."""
    cached, due = split_by_cache(universe, cache, now, days)
    return _collected(cached, cache, fetch(due.withColumn("endpoint", F.lit(OVERVIEW))), now)


def _collected(cached: DataFrame, cache: DataFrame, responses: DataFrame, now: datetime) -> Collected:
    got = responses.withColumn("fetched_at", F.lit(now))
    found = interpret(cached.drop("ord").withColumn("origin", F.lit("cache")).unionByName(got.withColumn("origin", F.lit("fetched"))))
    good = found.where(F.col("status") == "ok")
    typed = good.select("origin", F.col("ticker").alias("asked"), *_typed(lambda k: F.try_variant_get("payload", f"$['{k}']", "string")))
    kept = cache.join(good.where("origin = 'fetched'").select("ticker"), "ticker", "left_anti").select("ticker", "body", "fetched_at")
    return Collected(typed, dead_letters(found), kept.unionByName(good.where("origin = 'fetched'").select("ticker", "body", "fetched_at")))


OVERVIEW_COLUMNS = [*TEXT_FIELDS.values(), *NUMBER_FIELDS.values()]


def save_overviews(typed: DataFrame, path: str) -> None:
    """The combined overviews as a folder of CSV with headers; a file a task, so that collecting and writing aren't one task's work."""
    typed.select(*OVERVIEW_COLUMNS).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def load_overviews(spark: SparkSession, path: str) -> DataFrame:
    """The combined overviews; ``FileNotFoundError`` before the first collection."""
    if not Files(spark).exists(path):
        raise FileNotFoundError(f"{path} not found: collect overviews first")
    schema = ", ".join([f"{c} string" for c in TEXT_FIELDS.values()] + [f"{c} double" for c in NUMBER_FIELDS.values()])
    return spark.read.csv(path, header=True, schema=schema, quote='"', escape='"')


def fresh(cached: DataFrame, now: date, days: int = 7, column: str = "fetched_at") -> DataFrame:
    """Rows that were fetched less than ``days`` days ago."""
    return cached.where(F.datediff(F.lit(now), F.col(column)) < days)


def quarter_counts(statements: DataFrame, payload: str = "payload") -> DataFrame:
    """The rows of (endpoint, payload JSON, ...) with n_quarters; 0 for what has none."""
    n = F.lit(0)
    for endpoint, key in QUARTERS.items():
        n = F.when(F.col("endpoint") == endpoint, F.coalesce(F.json_array_length(F.get_json_object(F.col(payload), f"$.{key}")), F.lit(0))).otherwise(n)
    return statements.withColumn("n_quarters", n.cast("int"))


def fetch_queue(universe: DataFrame, ledger: DataFrame, today: date, refresh_days: int = 30, budget: int | None = None, endpoints: list[str] | None = None) -> DataFrame:
    """ticker, endpoint, last_fetch, place of the units to fetch: never fetched first, in the universe's order, then the stale ones, oldest first.

    ``universe`` is (ord, ticker). The queue is as long as the universe times the endpoints: small.
    """
    endpoints = ENDPOINTS if endpoints is None else endpoints
    units = universe.select("ord", "ticker", F.posexplode(F.array(*[F.lit(e) for e in endpoints])).alias("e", "endpoint"))
    known = units.join(ledger.select("ticker", "endpoint", "last_fetch"), ["ticker", "endpoint"], "left")
    due = known.where(F.col("last_fetch").isNull() | (F.datediff(F.lit(today), F.col("last_fetch")) >= refresh_days))
    place = F.row_number().over(Window.orderBy(F.col("last_fetch").asc_nulls_first(), "ord", "e"))
    queue = due.select("ticker", "endpoint", "last_fetch", place.cast("int").alias("place"))
    return queue if budget is None else queue.where(F.col("place") <= budget)


@dataclass
class Cycle:
    fetched: int
    errors: int
    remaining: int


def run_cycle(spark: SparkSession, universe: DataFrame, ledger: DataFrame, fetch: Callable[[str, str], int], today: date, budget: int = 20, refresh_days: int = 30, save: Callable[[DataFrame], None] | None = None, dry_run: bool = False) -> tuple[Cycle, DataFrame]:
    """Fetch at most ``budget`` units; ``fetch`` returns how many quarters it got. The ledger is saved after every success.

    No quarters are an error, as is a ``ValueError``; ``RateLimited`` ends the
    cycle. Errors count toward the budget.
    """
    queue = fetch_queue(universe, ledger, today, refresh_days)
    total, todo = queue.count(), [(r["ticker"], r["endpoint"]) for r in queue.where(F.col("place") <= budget).orderBy("place").collect()]
    if dry_run:
        return Cycle(0, 0, total), ledger
    done, errors = [], 0
    for ticker, endpoint in todo:
        try:
            if fetch(ticker, endpoint) <= 0:
                raise ValueError("no quarters")
        except RateLimited:
            break
        except ValueError:
            errors += 1
            continue
        done.append((ticker, endpoint, today))
        if save is not None:
            save(updated_ledger(spark, ledger, done))
    return Cycle(len(done), errors, total - len(done)), updated_ledger(spark, ledger, done)


def updated_ledger(spark: SparkSession, ledger: DataFrame, done: list[tuple]) -> DataFrame:
    """The ledger with the latest date of each unit."""
    both = ledger.select(*LEDGER.names).unionByName(spark.createDataFrame(done, LEDGER))
    return both.groupBy("ticker", "endpoint").agg(F.max("last_fetch").alias("last_fetch"))
