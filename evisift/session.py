"""Session settings for local runs; on a cluster the given session is used as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: str | int = "8", app: str = "evisift", memory: str = "12g") -> SparkSession:
    """A local session with the settings the engine is tested with."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", os.environ.get("EVISIFT_SHUFFLE", "8"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One table of a scale directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
