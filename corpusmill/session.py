"""A session with the settings that results depend on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cores: str = "*", partitions: int | None = None, memory: str = "4g") -> SparkSession:
    n = partitions or (os.cpu_count() or 8 if cores == "*" else int(cores))
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", n).config("spark.driver.memory", memory)
    for k, v in {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    }.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
