"""Session factory with the settings every plan in this package assumes."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def with_package(spark: SparkSession) -> SparkSession:
    """``spark``, with Python workers that find this package wherever the driver was started."""
    environment = spark.sparkContext.environment
    if ROOT not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, environment.get("PYTHONPATH")]))
    return spark


def for_workers(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Python workers find this package."""
    with_package(df.sparkSession)
    return df


def get_session(app: str = "panelforge", cores: int | str | None = None, **conf: str) -> SparkSession:
    """A session pinned to UTC with adaptive execution on.

    ``conf`` is always set. The other settings, ``cores`` among them, are
    defaults: what was submitted with the application stands.
    """
    n = cores or os.environ.get("BENCH_CPUS", "8")
    defaults = {
        "spark.master": f"local[{n}]",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    builder = SparkSession.builder.appName(app)
    for key, value in (unset(defaults, submitted()) | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def submitted() -> dict[str, str]:
    """The settings that spark-submit gave the driver; none where Python was started by itself."""
    return dict(SparkConf().getAll()) if "PYSPARK_GATEWAY_PORT" in os.environ else {}


#: Only for drivers that start their own Spark: a cluster's own values of these are never replaced.
LOCAL_ONLY = ("spark.master", "spark.sql.shuffle.partitions", "spark.driver.memory", "spark.ui.enabled", "spark.ui.showConsoleProgress")


def unset(defaults: dict[str, str], given: dict[str, str]) -> dict[str, str]:
    """``defaults`` without what was given, and without local settings where anything was."""
    return {k: v for k, v in defaults.items() if k not in given and not (given and k in LOCAL_ONLY)}
