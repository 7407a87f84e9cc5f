"""Session settings the operators are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Adaptive execution picks join strategies from measured sizes, merges small partitions and
# splits skewed ones.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(app: str, cpus: int | None = None, memory: str = "12g") -> SparkSession:
    """A single-machine session for tests, checks and benchmarks."""
    cpus = cpus or os.cpu_count() or 8
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.driver.memory", memory)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(cpus)))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
