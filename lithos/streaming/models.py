"""Streams of models (params, t, misfit): tail of a log, best so far, means by window. Those with states of their own are in
stateful.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lithos.sources.text import parse_models


def tail(spark: SparkSession, folder: str) -> DataFrame:
    """Models of log files as they arrive in a folder; lines that are no models are dropped."""
    return parse_models(spark.readStream.format("text").load(folder))


def running_best(models: DataFrame) -> DataFrame:
    """n and the best model so far (the earliest of equal ones), updated with every batch."""
    return models.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("misfit", "t", "params")).alias("best")).select("n", "best.misfit", "best.t", "best.params")


def by_window(models: DataFrame, ts: str, width: str, late: str) -> DataFrame:
    """Mean and least misfit of each window of event time."""
    return models.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.count(F.lit(1)).alias("n"), F.avg("misfit").alias("mean"), F.min("misfit").alias("least"))


def on_batch(models: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hand every batch to all listeners."""
    def each(df, n):
        df.persist()
        for sink in sinks:
            sink(df, n)
        df.unpersist()

    writer = models.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
