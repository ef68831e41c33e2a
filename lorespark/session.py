"""The SparkSession that tests, the benchmark and local runs share."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: str | int = "8", partitions: int = 8) -> SparkSession:
    """A local session in UTC with adaptive execution; a cluster brings its own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lorespark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LORE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", os.environ.get("LORE_WAREHOUSE", "/tmp/lorespark-warehouse"))
        .getOrCreate()
    )
