"""A session with the settings the file operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.orc.impl": "native",
    "spark.sql.orc.enableVectorizedReader": "true",
    "spark.sql.orc.enableNestedColumnVectorizedReader": "true",
    "spark.sql.orc.filterPushdown": "true",
    "spark.sql.orc.aggregatePushdown": "true",
}


def get_spark(master: str | None = None, **conf: str) -> SparkSession:
    """The session of this process; file settings are applied to one that runs already, too."""
    builder = SparkSession.builder.config(map={**CONF, **conf})
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()
