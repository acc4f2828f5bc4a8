"""A vendor's responses as Spark data sources: ``vendor_bars`` and ``vendor_responses``.

How a request is answered is a transport: a function from a request (a dict) to the
response's text, named as ``module:function``, so that it can run in any worker.
``recorded`` answers from a folder of recorded responses; a network client is another
function of the same form. It gets its secrets from environment variables, and the
option ``credentials`` names those that must be set.

    spark = vendor.register(spark)
    spark.read.format("vendor_bars").option("path", folder).load().where("ticker in ('A', 'B') and timestamp >= '2024-01-01'")

Tickers and dates in such a filter are pushed down: a ticker is a partition of its
own, those that aren't asked for have none, and dates are part of each request.
"""

from __future__ import annotations

import json
import os
import time
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from importlib import import_module
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from panelforge.session import with_package
from panelforge.sources.schemas import ADJUSTMENTS, BARS, TIMEFRAMES

RECORDED = "panelforge.sources.vendor:recorded"


# --- transports ---------------------------------------------------------------------------------------------


def transport(name: str):
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)


#: Bytes of a row group of recorded responses; how many of them a worker keeps.
GROUP_BYTES, GROUPS_KEPT = 1 << 20, 16


class _Recordings:
    """A folder of recordings by the keys of its row groups: a request reads the groups that may have its ticker, and the last ones stay in memory.

    In a folder that ``record`` wrote, that is one group, found by bisection. Those who
    ask in the order of tickers read each group once, however many requests there are.
    """

    def __init__(self, path: str):
        import pyarrow.dataset as ds
        import pyarrow.parquet as pq
        from pyarrow import fs

        self.system, where = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        self.footers = {f: pq.read_metadata(f, filesystem=self.system) for f in ds.dataset(where, filesystem=self.system, format="parquet").files}
        self.group = lru_cache(maxsize=GROUPS_KEPT)(self._group)
        self.of_kind = lru_cache(maxsize=None)(self._of_kind)

    def _range(self, file: str, k: int, column: str) -> tuple[str, str] | None:
        """A group's least and greatest value of a column; None where its notes don't say."""
        notes = self.footers[file].row_group(k)
        chunk = next(c for c in map(notes.column, range(notes.num_columns)) if c.path_in_schema == column)
        return (chunk.statistics.min, chunk.statistics.max) if chunk.is_stats_set and chunk.statistics.has_min_max else None

    def _of_kind(self, kind: str) -> tuple[list, list, list, list]:
        """The groups that may have a kind, by their first tickers: first tickers, the greatest ticker so far, the groups; and those of unknown tickers."""
        known, unknown = [], []
        for file, footer in self.footers.items():
            for k in range(footer.num_row_groups):
                kinds, tickers = self._range(file, k, "kind"), self._range(file, k, "ticker")
                if kinds is None or kinds[0] <= kind <= kinds[1]:
                    known.append((*tickers, (file, k))) if tickers else unknown.append((file, k))
        known.sort()
        last = list(accumulate((b for _, b, _ in known), max))
        return [a for a, _, _ in known], last, [g for _, _, g in known], unknown

    def _group(self, file: str, k: int) -> tuple[dict, pa.ChunkedArray]:
        """(kind, ticker, page) -> row, and the rows' bodies."""
        import pyarrow.parquet as pq

        with self.system.open_input_file(file) as source:
            rows = pq.ParquetFile(source, metadata=self.footers[file]).read_row_group(k, columns=["kind", "ticker", "page", "body"])
        places: dict = {}
        for at, key in enumerate(zip(*(rows[c].to_pylist() for c in ("kind", "ticker", "page")), strict=True)):
            places.setdefault(key, at)
        return places, rows["body"]

    def find(self, kind: str, ticker: str, page: int) -> str | None:
        first, last, groups, unknown = self.of_kind(kind)
        at = bisect_right(first, ticker) - 1
        while at >= 0 and last[at] >= ticker:
            if (found := self._look(groups[at], (kind, ticker, page))) is not None:
                return found.as_py()
            at -= 1
        found = next((x for g in unknown if (x := self._look(g, (kind, ticker, page))) is not None), None)
        return None if found is None else found.as_py()

    def _look(self, group: tuple[str, int], key: tuple) -> pa.Scalar | None:
        places, bodies = self.group(*group)
        return bodies[places[key]] if key in places else None


_recordings = lru_cache(maxsize=4)(_Recordings)


def recorded(request: dict) -> str | None:
    """The recorded response to ``request``; None where there is none."""
    return _recordings(request["path"]).find(request["kind"], request["ticker"], request.get("page", 0))


def record(responses: DataFrame, path: str) -> None:
    """Write responses (kind, ticker, page, body) as a folder that ``recorded`` reads; sorted and in small row groups, so that a request touches little."""
    tidy = responses.select("kind", "ticker", F.col("page").cast("int").alias("page"), "body")
    tidy.repartitionByRange("kind", "ticker").sortWithinPartitions("kind", "ticker", "page").write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).parquet(path)


# --- what both sources share --------------------------------------------------------------------------------


def _asked(options: dict) -> dict:
    """What every request holds; checks the options."""
    for name in filter(None, options.get("credentials", "").split(",")):
        if not os.environ.get(name.strip()):
            raise ValueError(f"{options['credentials']} must be set")
    if options.get("adjustment", "adjusted") not in ADJUSTMENTS:
        raise ValueError(f"adjustment must be one of {', '.join(ADJUSTMENTS)}")
    if options.get("timeframe", "1Day") not in TIMEFRAMES:
        raise ValueError(f"timeframe must be one of {', '.join(TIMEFRAMES)}")
    return {"path": options.get("path"), "adjustment": ADJUSTMENTS[options.get("adjustment", "adjusted")], "timeframe": options.get("timeframe", "1Day")}


@dataclass
class OfTicker(InputPartition):
    ticker: str


@dataclass
class Lane(InputPartition):
    units: list


def _utc(x) -> datetime:
    x = datetime.fromisoformat(x.replace("Z", "+00:00")) if isinstance(x, str) else x
    return x.replace(tzinfo=timezone.utc) if x.tzinfo is None else x.astimezone(timezone.utc)


# --- bars ---------------------------------------------------------------------------------------------------


class BarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.asked, self.answer = _asked(options), options.get("transport", RECORDED)
        self.tickers = json.loads(options["tickers"]) if "tickers" in options else None
        self.start = _utc(options["start"]) if "start" in options else None
        self.end = _utc(options["end"]) if "end" in options else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes tickers and dates; the other filters go back to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("ticker",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tickers = sorted(asked if self.tickers is None else asked & set(self.tickers))
                continue
            if getattr(f, "attribute", None) == ("timestamp",) and isinstance(getattr(f, "value", None), datetime):
                at, tick = _utc(f.value), timedelta(microseconds=1)
                bound = {GreaterThanOrEqual: ("start", at), GreaterThan: ("start", at + tick), LessThan: ("end", at), LessThanOrEqual: ("end", at + tick)}.get(type(f))
                if bound:
                    side, at = bound
                    held = getattr(self, side)
                    setattr(self, side, at if held is None else (max if side == "start" else min)(at, held))
                    continue
            yield f

    def partitions(self) -> list[OfTicker]:
        if self.tickers is None:
            raise ValueError("name the tickers, by a filter or by the option tickers (a JSON list)")
        return [OfTicker(t) for t in sorted(set(self.tickers))]

    def read(self, partition: OfTicker) -> Iterator[pa.RecordBatch]:
        ask, page = transport(self.answer), 0
        moment = lambda t: None if t is None else t.isoformat()
        while page is not None:
            text = ask(self.asked | {"kind": "bars", "ticker": partition.ticker, "start": moment(self.start), "end": moment(self.end), "page": page})
            if text is None:
                return
            answer = json.loads(text)
            rows = [(partition.ticker, _utc(b["t"]), *(float(b[k]) for k in "ohlc"), int(b["v"])) for b in answer["bars"] or []]
            rows = [r for r in rows if (self.start is None or r[1] >= self.start) and (self.end is None or r[1] < self.end)]
            kinds = [pa.string(), pa.timestamp("us", "UTC"), *[pa.float64()] * 4, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], BARS.names)
            page = answer.get("next_page_token")


class VendorBars(DataSource):
    """Bars of tickers, a partition a ticker. Options: path or transport, tickers, start, end, timeframe, adjustment, credentials."""

    @classmethod
    def name(cls) -> str:
        return "vendor_bars"

    def schema(self):
        return BARS

    def reader(self, schema) -> BarReader:
        return BarReader(dict(self.options))


# --- responses as they are ----------------------------------------------------------------------------------


RESPONSES = "ticker string, endpoint string, body string, failure string"


def answered(units: Iterable[tuple[str, str]], asked: dict, answer: str, pause: float) -> Iterator[tuple]:
    """A lane's requests, one after the other, with ``pause`` seconds between them."""
    ask = transport(answer)
    for k, (ticker, endpoint) in enumerate(units):
        if k and pause:
            time.sleep(pause)
        try:
            yield ticker, endpoint, ask(asked | {"kind": endpoint, "ticker": ticker}), None
        except Exception as e:  # noqa: BLE001: a request that fails is a row, not the end of the job
            yield ticker, endpoint, None, f"{type(e).__name__}: {e}"


class ResponseReader(DataSourceReader):
    def __init__(self, options: dict):
        self.asked, self.answer = _asked(options), options.get("transport", RECORDED)
        self.units = [tuple(u) for u in json.loads(options["units"])]
        self.lanes, self.pause = int(options.get("lanes", 1)), float(options.get("pause", 0))

    def partitions(self) -> list[Lane]:
        return [Lane(self.units[k :: self.lanes]) for k in range(self.lanes)]

    def read(self, partition: Lane) -> Iterator[tuple]:
        return answered(partition.units, self.asked, self.answer, self.pause)


class VendorResponses(DataSource):
    """ticker, endpoint, body, failure of each unit asked for. Options: units (a JSON list of [ticker, endpoint]), lanes (requests at once), pause (seconds between a lane's requests), and those of the bars."""

    @classmethod
    def name(cls) -> str:
        return "vendor_responses"

    def schema(self) -> str:
        return RESPONSES

    def reader(self, schema) -> ResponseReader:
        return ResponseReader(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    """``spark`` with both formats, and with filters pushed to them."""
    with_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (VendorBars, VendorResponses):
        spark.dataSource.register(source)
    return spark


@dataclass
class VendorSource:
    """A ``BarSource`` out of the format: what a store asks for becomes pushed filters."""

    options: dict

    def bars(self, spark: SparkSession, ticker: str, timeframe: str, start: datetime, end: datetime, adjustment: str) -> DataFrame:
        df = register(spark).read.format("vendor_bars").options(**self.options, timeframe=timeframe, adjustment=adjustment).load()
        return df.where((F.col("ticker") == ticker) & (F.col("timestamp") >= F.lit(start)) & (F.col("timestamp") < F.lit(end)))


def fetch(spark: SparkSession, units: list[tuple[str, str]], **options: str) -> DataFrame:
    """The responses of ``units`` (ticker, endpoint)."""
    return register(spark).read.format("vendor_responses").options(units=json.dumps(units), **options).load()


def answers(units: DataFrame, **options: str) -> DataFrame:
    """The responses of ``units`` (ord, ticker, endpoint), which stay rows: each lane asks for a span of them, in their order. Options as for ``vendor_responses``."""
    asked, answer = _asked(options), options.get("transport", RECORDED)
    lanes, pause = int(options.get("lanes", 1)), float(options.get("pause", 0))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = answered((u for b in batches for u in zip(b["ticker"].to_pylist(), b["endpoint"].to_pylist(), strict=True)), asked, answer, pause)
        # bodies may be long: some at a time
        while some := list(islice(rows, 100)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some, strict=True)], ["ticker", "endpoint", "body", "failure"])

    with_package(units.sparkSession)
    return units.repartitionByRange(lanes, "ord").sortWithinPartitions("ord").select("ticker", "endpoint").mapInArrow(ask, RESPONSES)
