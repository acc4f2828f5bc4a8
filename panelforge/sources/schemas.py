"""Schemas of what is stored, and of the trading records that a caller may keep."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "timestamp": T.TimestampType(), "date": T.DateType(), "double": T.DoubleType(), "long": T.LongType(), "int": T.IntegerType()}


def _schema(text: str) -> T.StructType:
    """A schema from "name type, ...", without a session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (part.split() for part in text.split(","))])


BARS = _schema("ticker string, timestamp timestamp, open double, high double, low double, close double, volume long")
MANIFEST = _schema("ticker string, timeframe string, adjustment string, source string, start timestamp, end timestamp, fetch_timestamp timestamp, schema_version int")
CONSTITUENTS = _schema("ticker string, company string, sector string")
RANKED_CONSTITUENTS = _schema("rank int, ticker string, company string, weight double, sector string, sub_industry string")
LEDGER = _schema("ticker string, endpoint string, last_fetch date")

# Trading records: their fields and states are fixed values.
SIDES = ("BUY", "SELL")
ORDER_TYPES = ("MARKET", "LIMIT")
ORDER_STATUSES = ("PENDING", "SUBMITTED", "FILLED", "PARTIALLY_FILLED", "CANCELLED", "REJECTED")
BAR = BARS
SIGNAL = _schema("ticker string, timestamp timestamp, weight double")
ORDER = _schema("ticker string, timestamp timestamp, side string, quantity long, order_type string, limit_price double")
FILL = _schema("ticker string, timestamp timestamp, side string, quantity long, price double, commission double")
POSITION = _schema("ticker string, quantity long, avg_entry_price double, market_price double")

TIMEFRAMES = ("1Min", "5Min", "15Min", "1Hour", "1Day")
#: Name of an adjustment -> what a vendor calls it.
ADJUSTMENTS = {"adjusted": "all", "unadjusted": "raw"}
