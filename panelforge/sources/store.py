"""Bars on disk: Parquet by adjustment, timeframe and ticker, snapshots with a manifest, and incremental merging."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from typing import Protocol
from urllib.parse import unquote
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.sources.files import Files
from panelforge.sources.panel import densify
from panelforge.sources.schemas import ADJUSTMENTS, BARS, MANIFEST, TIMEFRAMES

PARTS = ["adjustment", "timeframe", "ticker"]


class BarSource(Protocol):
    """Where new bars come from: a vendor's client, or files."""

    def bars(self, spark: SparkSession, ticker: str, timeframe: str, start: datetime, end: datetime, adjustment: str) -> DataFrame:
        """Bars with start <= timestamp < end in the schema of ``BARS``."""
        ...


class FileSource:
    """Bars from any Parquet dataset in the schema of ``BARS``."""

    def __init__(self, path: str):
        self.path = path

    def bars(self, spark, ticker, timeframe, start, end, adjustment) -> DataFrame:
        return spark.read.schema(BARS).parquet(self.path).where((F.col("ticker") == ticker) & (F.col("timestamp") >= F.lit(start)) & (F.col("timestamp") < F.lit(end)))


def merge_bars(parts: list[DataFrame], key: tuple[str, ...] = ("ticker", "timestamp")) -> DataFrame:
    """The union of ``parts``; of rows with one key the last part's wins. A part with the same key twice keeps its greatest row."""
    tagged = [p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    rest = sorted(c for c in parts[0].columns if c not in key)
    order = Window.partitionBy(*key).orderBy(F.desc("_part"), *[F.desc(c) for c in rest])
    return out.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_part")


def missing_ranges(first: datetime | None, last: datetime | None, start: datetime, end: datetime) -> list[tuple[datetime, datetime]]:
    """What to fetch so that [start, end) is covered: all of it, or the part before the first bar and the part from the last bar on."""
    if first is None:
        return [(start, end)]
    found = []
    if start < first:
        found.append((start, min(end, first)))
    if end > last:
        found.append((max(start, last), end))
    return found


class Conflict(RuntimeError):
    """Other writers kept publishing snapshots of the same tickers first."""


#: Moments in a snapshot, in UTC.
_TIME = "%Y-%m-%dT%H:%M:%S.%f"


class BarStore:
    """A folder of bars with a log of snapshots.

    A write puts new files in a folder of its own, then publishes a snapshot: a
    small file under the next number that lists each ticker's files and notes.
    Publishing succeeds for one writer a number. Who loses it reads the winner's
    snapshot and tries again, merging anew if it changed a ticker of theirs. Readers
    take the last snapshot there is and so never see half a write; one that
    crashed before publishing leaves only files that ``vacuum`` removes.
    """

    #: Numbers that a writer tries.
    ATTEMPTS = 20

    def __init__(self, spark: SparkSession, path: str, adjustment: str = "adjusted", timeframe: str = "1Day"):
        if adjustment not in ADJUSTMENTS:
            raise ValueError(f"adjustment must be one of {', '.join(ADJUSTMENTS)}")
        if timeframe not in TIMEFRAMES:
            raise ValueError(f"timeframe must be one of {', '.join(TIMEFRAMES)}")
        self.spark, self.path, self.adjustment, self.timeframe = spark, path.rstrip("/"), adjustment, timeframe
        self.files = Files(spark)

    # --- snapshots: ticker's key -> notes and files, a row a ticker --------------------------------------

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names(f"{self.path}/log") if n.endswith(".json")]

    def snapshot(self, version: int | None = None) -> tuple[int, dict[tuple, dict]]:
        """(version, entries by (adjustment, timeframe, ticker)); version 0, without entries, before the first write."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        elif version not in known:
            raise ValueError(f"there is no snapshot {version}")
        if version == 0:
            return 0, {}
        entries = json.loads(self.files.read(f"{self.path}/log/{version:012d}.json"))
        return version, {(e["adjustment"], e["timeframe"], e["ticker"]): e for e in entries}

    def _publish(self, version: int, entries: dict[tuple, dict]) -> bool:
        return self.files.publish(f"{self.path}/log/{version:012d}.json", json.dumps([entries[k] for k in sorted(entries)]))

    def _own(self, entries: dict[tuple, dict], tickers: list[str] | None = None) -> list[dict]:
        wanted = None if tickers is None else set(tickers)
        return [e for (adjustment, timeframe, t), e in entries.items() if (adjustment, timeframe) == (self.adjustment, self.timeframe) and (wanted is None or t in wanted)]

    def _read(self, entries: list[dict]) -> DataFrame:
        paths = [f"{self.path}/{f}" for e in entries for f in e["files"]]
        if not paths:
            return self.spark.createDataFrame([], BARS)
        # files of other tickers aren't listed, let alone read
        df = self.spark.read.schema(_BARS_ON_DISK).option("basePath", f"{self.path}/bars").parquet(*paths)
        return df.select(*BARS.names)

    # --- reading ------------------------------------------------------------------------------------------

    def load(self, tickers: list[str] | None = None, version: int | None = None) -> DataFrame | None:
        """Bars of this adjustment and timeframe, of the last or an earlier snapshot; None where nothing was stored."""
        version, entries = self.snapshot(version)
        return self._read(self._own(entries, tickers)) if version else None

    def list_tickers(self) -> list[str]:
        return sorted(e["ticker"] for e in self._own(self.snapshot()[1]))

    def manifest(self) -> DataFrame:
        """The notes of all tickers, of every adjustment and timeframe."""
        rows = [[_moment(e[c]) if c in ("start", "end", "fetch_timestamp") else e[c] for c in MANIFEST.names] for e in self.snapshot()[1].values()]
        return self.spark.createDataFrame(rows, MANIFEST)

    # --- writing ------------------------------------------------------------------------------------------

    def _stage(self, bars: DataFrame, source: str) -> dict[tuple, dict]:
        """Write bars to a folder of their own; the entries that would make them visible."""
        folder = f"bars/write={uuid4().hex}"
        keyed = bars.select(*BARS.names).withColumns({"adjustment": F.lit(self.adjustment), "timeframe": F.lit(self.timeframe)})
        # a ticker's bars are one file: a day's bar for decades is small, a year of minutes is some megabytes
        keyed.repartition(*PARTS).sortWithinPartitions(*PARTS, "timestamp").write.partitionBy(*PARTS).parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(_BARS_ON_DISK).parquet(f"{self.path}/{folder}")
        file = F.concat(F.lit("bars/"), F.substring_index("_metadata.file_path", "/bars/", -1))
        notes = written.groupBy("ticker").agg(F.date_format(F.min("timestamp"), _PATTERN).alias("start"), F.date_format(F.max("timestamp"), _PATTERN).alias("end"), F.sort_array(F.collect_set(file)).alias("files"))
        now = {"adjustment": self.adjustment, "timeframe": self.timeframe, "source": source, "fetch_timestamp": datetime.now(timezone.utc).strftime(_TIME), "schema_version": 1}
        # file paths are URIs
        return {(self.adjustment, self.timeframe, r["ticker"]): r.asDict() | now | {"files": [unquote(f) for f in r["files"]]} for r in notes.toLocalIterator()}

    def _commit(self, prepare, source: str) -> int:
        """Publish what ``prepare(entries so far)`` gives, bars to put in the place of their tickers'; the new version."""
        version, base = self.snapshot()
        staged = self._stage(prepare(base), source)
        for _ in range(self.ATTEMPTS):
            if not staged:
                return version
            if self._publish(version + 1, base | staged):
                return version + 1
            version, latest = self.snapshot()
            if any(base.get(k) != latest.get(k) for k in staged):
                staged = self._stage(prepare(latest), source)
            base = latest
        raise Conflict(f"no snapshot of {self.path} could be published in {self.ATTEMPTS} attempts")

    def write(self, bars: DataFrame, source: str = "file") -> int:
        """Replace the tickers that ``bars`` has, in one step; the new version."""
        return self._commit(lambda _: bars, source)

    def upsert(self, incoming: DataFrame, source: str = "file") -> int:
        """Merge bars into the store; a bar that is there already is replaced. Without bars nothing is done."""
        # at once: an iterator would run a job a partition
        tickers = [r["ticker"] for r in incoming.select("ticker").distinct().collect()]
        if not tickers:
            return self.snapshot()[0]
        return self._commit(lambda entries: merge_bars([self._read(self._own(entries, tickers)), incoming]), source)

    def vacuum(self, keep: int = 1) -> None:
        """Forget all but the last ``keep`` snapshots and delete the files that none of those lists.

        Run it while nobody writes: files that are still to be published would go too.
        """
        known = self.versions()
        kept = known[-keep:]
        used = {f.split("/")[1] for v in kept for e in self.snapshot(v)[1].values() for f in e["files"]}
        for v in known[:-keep]:
            self.files.delete(f"{self.path}/log/{v:012d}.json")
        for folder in self.files.names(f"{self.path}/bars"):
            if folder not in used:
                self.files.delete(f"{self.path}/bars/{folder}")

    def fetch(self, ticker: str, start: datetime, end: datetime, source: BarSource) -> DataFrame:
        """Bring [start, end) up to date from ``source``: only what is missing is asked for."""
        get = lambda a, b: source.bars(self.spark, ticker, self.timeframe, a, b, self.adjustment).select(*BARS.names)

        def missing(entries: dict[tuple, dict]) -> DataFrame:
            held = self._own(entries, [ticker])
            first, last = (_moment(held[0]["start"]), _moment(held[0]["end"])) if held else (None, None)
            ranges = missing_ranges(first, last, start, end)
            early = [get(a, b) for a, b in ranges if first is None or a < first]
            late = [get(a, b) for a, b in ranges if not (first is None or a < first)]
            return merge_bars([*early, *([self._read(held)] if held else []), *late]) if ranges else self.spark.createDataFrame([], BARS)

        self._commit(missing, type(source).__name__)
        return self.load([ticker]) if self.versions() else self.spark.createDataFrame([], BARS)

    def metadata(self, ticker: str) -> dict | None:
        """The notes of one ticker's bars; None where there are none."""
        found = self._own(self.snapshot()[1], [ticker])
        return {c: _moment(found[0][c]) if c in ("start", "end", "fetch_timestamp") else found[0][c] for c in MANIFEST.names} if found else None

    def panel(self, tickers: list[str] | None = None) -> DataFrame:
        """The dense panel of the stored bars; tickers that aren't stored are left out."""
        bars = self.load(tickers)
        if bars is None:
            bars = self.spark.createDataFrame([], BARS)
        return densify(bars.withColumn("date", F.to_date("timestamp")).drop("timestamp"))


def _moment(text: str | None) -> datetime | None:
    return datetime.strptime(text, _TIME) if text else None


_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
_BARS_ON_DISK = "timestamp timestamp, open double, high double, low double, close double, volume long, adjustment string, timeframe string, ticker string"
