"""Tables behind JDBC, and what a catalog holds."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def query(spark: SparkSession, url: str, sql: str, **options) -> DataFrame:
    """The result of a query, every column as text."""
    df = spark.read.format("jdbc").option("url", url).option("query", sql).options(**options).load()
    return df.select(*(F.col(c).cast("string") for c in df.columns))


def with_retry(run, first: float = 1.0, most: float = 60.0):
    """run(), again after a pause that doubles from `first` seconds, until the pauses would exceed `most` in all."""
    pause, spent = first, 0.0
    while True:
        try:
            return run()
        except Exception:
            if spent + pause > most:
                raise
            time.sleep(pause)
            spent, pause = spent + pause, pause * 2


def columns(df: DataFrame) -> DataFrame:
    """name, type of a table's columns."""
    return df.sparkSession.createDataFrame(df.dtypes, "name string, type string")


def catalog(spark: SparkSession) -> DataFrame:
    """database, table of the session's catalog."""
    rows = [(d.name, t.name) for d in spark.catalog.listDatabases() for t in spark.catalog.listTables(d.name)]
    return spark.createDataFrame(rows, "database string, table string")
