"""A session with the settings that the plans here are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "pairlens", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """AQE with skew-join splitting and coalescing on, UTC, Arrow for the few pandas paths.

    Small shuffle partitions are kept: a pair's few bytes grow by the questions of the
    bank after its shuffle, so that one coalesced partition would leave the other cores
    idle. Where partitions are large, the least size plays no part.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4k",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
