"""Bars from streams of files into a store: bars as they come, or ticks that become daily bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelforge.sources.schemas import BARS
from panelforge.sources.store import BarStore

TICKS = "tick_id long, ticker string, timestamp timestamp, price double, size long"


def _started(stream: DataFrame, store: BarStore, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(lambda batch, _: store.upsert(batch, "stream")).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def stream_bars(store: BarStore, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start a query that upserts every new Parquet file of bars below ``path``. A batch that is run again changes nothing."""
    return _started(store.spark.readStream.schema(BARS).parquet(path), store, checkpoint, available_now)


def once(ticks: DataFrame, wait: str, keys: tuple[str, ...] = ("ticker", "tick_id")) -> DataFrame:
    """A stream without the repetitions that come within ``wait`` of one another.

    The state holds the keys of the last ``wait`` only, so it doesn't grow with the stream.
    """
    return ticks.withWatermark("timestamp", wait).dropDuplicatesWithinWatermark(list(keys))


def late_bars(bars: DataFrame, wait: str = "1 day") -> DataFrame:
    """Daily bars from intraday ones on a stream, final once ``wait`` has passed."""
    return daily(bars.withWatermark("timestamp", wait), "open", "high", "low", "close", "volume")


def daily(stream: DataFrame, open_: str, high: str, low: str, close: str, volume: str) -> DataFrame:
    """Daily bars of a stream that has a watermark; a day is given once, when nothing of it can come any more."""
    day = stream.groupBy("ticker", F.window("timestamp", "1 day"))
    first, last = (F.min_by(open_, F.struct("timestamp", open_)), F.max_by(close, F.struct("timestamp", close)))
    measures = [first.alias("open"), F.max(high).alias("high"), F.min(low).alias("low"), last.alias("close"), F.sum(volume).alias("volume")]
    return day.agg(*measures).select("ticker", F.col("window.start").alias("timestamp"), "open", "high", "low", "close", "volume")


def stream_ticks(store: BarStore, path: str, checkpoint: str, wait: str = "1 day", available_now: bool = True, files: int | None = None) -> StreamingQuery:
    """Start a query that makes daily bars of the ticks (``TICKS``) in new Parquet files below ``path`` and upserts them.

    Ticks may come out of order and more than once: repetitions go, and a day's bar
    is written in the micro-batch after the one whose newest tick is ``wait`` past
    the day. Ticks that come after that are left out. Both steps keep their state in the session's state
    store; for states beyond memory set ``spark.sql.streaming.stateStore.providerClass``
    to the RocksDB one. ``files``: how many files a micro-batch takes.
    """
    source = store.spark.readStream.schema(TICKS)
    ticks = (source.option("maxFilesPerTrigger", files) if files else source).parquet(path)
    bars = daily(once(ticks, wait), "price", "price", "price", "price", "size")
    return _started(bars, store, checkpoint, available_now)


def end_of_ticks(spark: SparkSession, path: str, at: object) -> None:
    """Add a file with one tick without a ticker at ``at``: what is more than the wait before it becomes final."""
    spark.createDataFrame([(None, None, at, None, None)], TICKS).coalesce(1).write.mode("append").parquet(path)
