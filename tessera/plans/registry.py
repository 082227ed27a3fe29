"""Registered queries: a function of the tables and the SQL that gives the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fixtures import Tables, sql_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, needs: str = ""):
    """Registers a function of Tables under its name. ``needs`` names the derived tables of the SQL. Timestamps are returned as text."""

    def register(f: Callable[[Tables], DataFrame]):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(Tables(spark, sf_dir))
            return df.select(*[F.col(c).cast("string").alias(c) if t.startswith("timestamp") or t == "date" else F.col(c) for c, t in df.dtypes])

        QUERIES[f.__name__] = run
        if sql is not None:
            head = sql_of(*needs.split()) if needs else ""
            body = sql.strip()
            SQL[f.__name__] = f"{head}, {body[4:].lstrip()}" if head and body[:4].upper() == "WITH" else f"{head} {body}"
        return run

    return register
