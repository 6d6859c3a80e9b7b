"""A session with the settings the plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "gridspark", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    known = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    }
    for k, v in (known | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
