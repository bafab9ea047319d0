"""Session helper for tests, bench and interactive use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(cpus: int | str = 8, app: str = "citegrid") -> SparkSession:
    """A local session with the settings the library expects (UTC, AQE with skew joins)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
