"""Stateful streams of models (source, t, params, misfit) and of sentinels (source, t, ts): densities, best models, pairs.

Each is a processor of Spark's transformWithState: its state is a few values a source, kept in the state store, so that a
query that is started again with its checkpoint goes on where it stopped. Rows of a source in a batch are taken by t.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lithos.session import ship

STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values("t", kind="stable")


class RunningDensity(StatefulProcessor):
    """Histograms of parameters that begin anew when a model is more than `better` below the best so far, told at the end of
    a batch or, with `flush_ms`, when so many milliseconds have passed since the first change that wasn't told."""

    def __init__(self, bounds: list, bins: int, better: float, flush_ms: int):
        self.low, self.high = (np.array([b[k] for b in bounds], dtype=float) for k in (0, 1))
        self.bins, self.better, self.flush_ms = bins, better, flush_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("density", "best double, counts array<long>, due long")

    def handleInputRows(self, key, rows, timerValues):
        shape = len(self.low), self.bins
        best, counts, due = self.state.get() if self.state.exists() else (float("inf"), None, 0)
        counts = np.zeros(shape, np.int64) if counts is None else np.array(counts, np.int64).reshape(shape)
        for params, misfit in in_order(rows)[["params", "misfit"]].itertuples(index=False):
            if misfit < best - self.better:
                counts[:] = 0
            best = min(best, misfit)
            x = np.asarray(params, dtype=float)
            ok = (x >= self.low) & (x <= self.high)
            at = np.minimum(((x - self.low) / (self.high - self.low) * self.bins).astype(int), self.bins - 1)
            counts[np.flatnonzero(ok), at[ok]] += 1
        if self.flush_ms and not due:
            due = timerValues.getCurrentProcessingTimeInMs() + self.flush_ms
            self.handle.registerTimer(due)
        self.state.update((float(best), counts.ravel().tolist(), due))
        yield self.told(key, counts) if not self.flush_ms else self.told(key, counts).iloc[:0]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        best, counts, _ = self.state.get()
        self.state.update((best, counts, 0))
        yield self.told(key, np.array(counts, np.int64).reshape(-1, self.bins))

    def told(self, key, counts: np.ndarray) -> pd.DataFrame:
        dim, bin_ = np.indices(counts.shape)
        return pd.DataFrame({"source": key[0], "dim": dim.ravel().astype("int32"), "bin": bin_.ravel().astype("int32"), "cnt": counts.ravel()})

    def close(self) -> None:
        pass


class TopModels(StatefulProcessor):
    """The k best models so far, the earlier of equal ones; the state holds k of them."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("best", "misfits array<double>, times array<long>")

    def handleInputRows(self, key, rows, timerValues):
        best = list(zip(*self.state.get())) if self.state.exists() else []
        for frame in rows:
            few = frame.nsmallest(self.k, ["misfit", "t"])
            best = sorted([*best, *zip(few["misfit"].astype(float), few["t"].astype(int))])[: self.k]
        self.state.update(([float(m) for m, _ in best], [int(t) for _, t in best]))
        yield pd.DataFrame({"source": key[0], "rank": np.arange(1, len(best) + 1, dtype="int32"), "misfit": [m for m, _ in best], "t": [t for _, t in best]})

    def close(self) -> None:
        pass


class GapPairs(StatefulProcessor):
    """Pairs of sentinels by the rule of joins.gap_pairs(); the state is the one that waits for its partner. It is forgotten when
    the watermark says that none can come any more, because the next sentinel then begins anew all the same."""

    def __init__(self, least: int, most: int):
        self.least, self.most = least, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("waiting", "t long")

    def handleInputRows(self, key, rows, timerValues):
        at, out = self.state.get()[0] if self.state.exists() else None, []
        for t in in_order(rows)["t"].unique().tolist():
            if at is None or t >= at + self.most:
                at = t
            elif t >= at + self.least:
                out.append((key[0], at, t))
                at = t
        self.state.update((int(at),))
        self.handle.registerTimer(1000 * (int(at) + self.most))
        yield pd.DataFrame(out, columns=["source", "t0", "t1"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.state.exists() and 1000 * (self.state.get()[0] + self.most) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        yield pd.DataFrame([], columns=["source", "t0", "t1"])

    def close(self) -> None:
        pass


def _kind(df: DataFrame) -> str:
    return dict(df.dtypes)["source"]


def running_density(models: DataFrame, bounds: list[tuple[float, float]], bins: int, better: float = 5.0, flush_ms: int = 0) -> DataFrame:
    """source, dim, bin, cnt of the models (source, t, params, misfit) since the last one that was much better."""
    out = f"source {_kind(models)}, dim int, bin int, cnt long"
    # with timers of processing time a query never ends by itself, because one may always fire later
    mode = "ProcessingTime" if flush_ms else "None"
    return models.select("source", "t", "params", "misfit").groupBy("source").transformWithStateInPandas(RunningDensity(bounds, bins, better, flush_ms), out, "Update", mode)


def top_models(models: DataFrame, k: int) -> DataFrame:
    """source, rank, misfit, t of each source's k best models so far."""
    return models.select("source", "t", "misfit").groupBy("source").transformWithStateInPandas(TopModels(k), f"source {_kind(models)}, rank int, misfit double, t long", "Update", "None")


def gap_pairs(sentinels: DataFrame, least: int = 30, most: int = 120, late: str = "0 seconds") -> DataFrame:
    """source, t0, t1 of sentinels (source, t in seconds) that come in order of time, up to `late`."""
    rows = sentinels.select("source", F.col("t").cast("long").alias("t"), F.timestamp_seconds("t").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("source").transformWithStateInPandas(GapPairs(least, most), f"source {_kind(sentinels)}, t0 long, t1 long", "Append", "EventTime")


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """While a query is started: the state store that these processors need, and this package on the executors."""
    ship(spark)
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        yield
    finally:
        spark.conf.set(STORE[0], before)


def run_available(spark: SparkSession, source: str, schema, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """Read what has come to the folder `source` since the checkpoint, and end. Every batch is a folder of `sink`, so that one
    that is written again replaces itself."""
    with state_store(spark):
        stream = transform(spark.readStream.schema(schema).parquet(source))
        mode = "append" if "t0" in stream.columns else "update"
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{sink}/batch={n}"))
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(told: DataFrame) -> DataFrame:
    """What a sink's last batch with a source says about it."""
    last = told.groupBy("source").agg(F.max("batch").alias("batch"))
    return told.join(last, ["source", "batch"]).drop("batch")
