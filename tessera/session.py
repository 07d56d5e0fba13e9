"""Session builder for tests, benches and scripts; a cluster brings its own session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(app: str = "tessera", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with adaptive execution, UTC time and few shuffle partitions."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
