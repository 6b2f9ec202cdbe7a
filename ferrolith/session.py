"""Session builder with the settings the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "ferrolith", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew handling on, in UTC.

    On a cluster leave ``master`` unset and let spark-submit decide; ``shuffle_partitions`` is an
    upper bound that adaptive execution coalesces from.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
