"""Session settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling. Partition counts are left to the cluster and to adaptive execution."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
