"""Session set-up for local runs; on a cluster the caller's session is used as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A ``local[cores]`` session with the settings the tests and the bench share."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("folioscope")
        .config("spark.driver.memory", os.environ.get("FOLIOSCOPE_DRIVER_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
