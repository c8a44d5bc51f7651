"""A session with the settings the operators are tuned for; an existing session is used as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("pageloom").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
