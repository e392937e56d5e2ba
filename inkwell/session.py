"""Session factory with the settings every plan of this package assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "inkwell", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session in UTC with AQE. ``master`` is for local runs; a cluster passes its own through spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
