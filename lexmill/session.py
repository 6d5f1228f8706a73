"""One place that says how a session is set up for these jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "lexmill", **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow; further settings as spark_sql_x=... or by their own names in a dict."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
