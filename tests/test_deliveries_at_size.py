"""Deliveries of a stream: written and merged by all tasks, without a job a partition."""

from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from panelforge import catalog
from panelforge.sources.schemas import BARS
from panelforge.sources.store import BarStore


def test_an_upsert_runs_few_jobs(spark, tmp_path):
    rows = [(f"T{k}", datetime(2024, 1, 1) + timedelta(days=k), *[1.0] * 4, 1) for k in range(40)]
    store = BarStore(spark, str(tmp_path / "s"))
    held = spark.conf.get("spark.sql.shuffle.partitions")
    # a micro-batch has no adaptive execution
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        spark.sparkContext.setJobGroup("upsert", "upsert")
        store.upsert(spark.createDataFrame(rows, BARS), "first")
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("upsert"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert jobs < 60  # the notes of the files take one a partition at most; the tickers one
    assert store.load().count() == 40
    assert store.upsert(spark.createDataFrame([], BARS), "none") == 1 and store.versions() == [1]


def test_a_delivery_is_written_by_all_cores(spark, monkeypatch, tmp_path):
    from panelforge import catalog_sources

    monkeypatch.setattr(catalog_sources, "scratch_folder", lambda _, name: str(tmp_path / name))
    found = catalog.queries()["stream_daily_bars"](spark, "/root/testdata/sf0.01")
    ticks = spark.read.parquet(str(tmp_path / "ticks")).where("ticker is not null").groupBy(F.input_file_name().alias("f")).count()
    assert ticks.count() == 4 * spark.sparkContext.defaultParallelism == len(list(Path(tmp_path / "ticks").glob("*.parquet"))) - 1
    assert found.count() > 0
