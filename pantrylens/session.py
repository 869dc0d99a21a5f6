"""Spark session defaults used by tests and the bench; clusters bring their own."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "pantrylens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> None:
    """Every date bucket is a UTC bucket, whatever session the caller hands in."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def use_order(spark: SparkSession) -> None:
    """Rows that come sorted by their group are summed up in that order, with no hash table that spills."""
    spark.conf.set("spark.sql.execution.replaceHashWithSortAgg", "true")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir, also set as checkpoint folder.

    There is no machine-local fallback: executors on other nodes could not read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named:
        if context.getCheckpointDir() is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return context.getCheckpointDir()
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named
