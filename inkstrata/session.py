"""Sessions."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int = 8, name: str = "inkstrata", **conf: str) -> SparkSession:
    """A session for one machine; on a cluster the session comes from outside."""
    settings = {"spark.sql.shuffle.partitions": str(cores), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "8g"} | conf
    return SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=settings).getOrCreate()

