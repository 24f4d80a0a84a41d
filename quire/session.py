"""Session settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "quire", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC time and the state store that keyed streams need."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    builder = SparkSession.builder.appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
