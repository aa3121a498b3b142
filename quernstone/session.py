"""Session settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None, memory: str | None = None, app: str = "quernstone") -> SparkSession:
    """UTC time, adaptive plans, last-wins map merging; sizes only where given, so a cluster's own settings stay."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if memory:
        b = b.config("spark.driver.memory", memory)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.parquet.filterPushdown": "true",
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
