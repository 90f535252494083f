"""Session defaults."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "tributary", cores: str | None = None, **conf) -> SparkSession:
    """A local session for tests and benches; on a cluster the submitted configuration holds."""
    n = cores or os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    if not os.environ.get("SPARK_MASTER") and not SparkSession.getActiveSession():
        builder = builder.master(f"local[{n}]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
    defaults = {
        "spark.sql.shuffle.partitions": n,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.cteRecursionLevelLimit": "10000",
        "spark.sql.cteRecursionRowLimit": "-1",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**defaults, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
