"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "strandlake", cores: int = 8, partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("STRANDLAKE_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One input table; the path may be any URI that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
