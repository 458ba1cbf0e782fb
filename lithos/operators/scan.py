"""Linear recurrences over a total order of a whole table: s = a * s_before + b, along keys of any length.

A step is an affine map, and maps in a row compose to one. Rows are dealt by ranges of the order; each range composes its maps
on its own, so that a row's state is one map of the state that the range begins with. What the ranges hand on is one map a
range; a key may go through many of them, and no task sees a whole key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithos.operators.stats import keys_of
from lithos.scratch import Scratch
from lithos.session import ship


def composed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maps s -> a * s + b of each place after all before it, by doubling: log2(n) passes."""
    a, b, step = a.copy(), b.copy(), 1
    while step < len(a):
        b[step:] += a[step:] * b[:-step]
        a[step:] *= a[:-step]
        step *= 2
    return a, b


def affine_scan(df: DataFrame, by, order: list[str], a: Column, b: Column, start: Column, out: str = "state") -> DataFrame:
    """`df` with `out` (double): at the first row of each key, in `order`, the value `start`; at each later one a * s + b, where
    s is the state of the row before. `order` should be total within a key. Maps must hold no nulls; keys may be null."""
    spark, keys = df.sparkSession, keys_of(by)
    ship(spark)
    scratch = Scratch(spark, "scan")
    whole = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    names = ("__key", "__a", "__b", "__start")
    rows = df.withColumns({"__key": F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit(""), "__a": a.cast("double"), "__b": b.cast("double"), "__start": start.cast("double")})
    carried = [c for c in rows.columns if c not in names]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fields = [*(rows.schema[c] for c in carried), T.StructField("__range", T.IntegerType()), T.StructField("__a", T.DoubleType()), T.StructField("__b", T.DoubleType()), T.StructField("__edge", T.StringType())]
    schema = T.StructType(fields)

    def run(batches):
        from pyspark import TaskContext

        number, before, last_a, last_b, first, start = TaskContext.get().partitionId(), None, 1.0, 0.0, True, 0.0
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.array(batch.column("__key").to_pylist(), dtype=object)
            m, c, s = (batch.column(x).to_numpy(zero_copy_only=False).copy() for x in ("__a", "__b", "__start"))
            begins = np.concatenate([[before is not None and key[0] != before], key[1:] != key[:-1]])
            m[begins], c[begins] = 0.0, s[begins]
            edge = np.full(len(key), None, dtype=object)
            if first:  # whether a key begins here, the range before knows
                first, start, edge[0] = False, float(s[0]), key[0]
                m[0], c[0] = 1.0, 0.0
                own = float(batch.column("__a")[0].as_py()), float(batch.column("__b")[0].as_py())
                edge[0] = "\x00".join((key[0], repr(start), repr(own[0]), repr(own[1])))
            m, c = composed(m, c)
            m, c = m * last_a, m * last_b + c
            before, last_a, last_b = key[-1], float(m[-1]), float(c[-1])
            if held is not None:
                yield held
            columns = [*(batch.column(x) for x in carried), pa.array([number] * len(key), pa.int32()), pa.array(m), pa.array(c)]
            held = pa.RecordBatch.from_arrays([*columns, pa.array(edge, pa.string())], names=schema.names)
        if held is not None:  # the last row says how the range ends
            edge = held.column("__edge").to_pylist()
            edge[-1] = (edge[-1] or "") + "\x01" + before
            yield pa.RecordBatch.from_arrays([*held.columns[:-1], pa.array(edge, pa.string())], names=schema.names)

    dealt = scratch.save(rows.repartitionByRange(ranges, *whole).sortWithinPartitions(*whole).mapInArrow(run, schema))
    # one first and one last row a range come to the driver: as many as there are ranges
    edges: dict = {}
    for r in dealt.where("__edge IS NOT NULL").select("__range", "__a", "__b", "__edge").collect():
        head, _, tail = r["__edge"].partition("\x01")
        x = edges.setdefault(r["__range"], {})
        if head:
            x["key"], *numbers = head.split("\x00")
            x["start"], x["a"], x["b"] = map(float, numbers)
        if "\x01" in r["__edge"]:
            x["last"], x["end"] = tail, (r["__a"], r["__b"])
    carry, state, key = [], 0.0, None
    for k in sorted(edges):
        x = edges[k]
        state = x["a"] * state + x["b"] if x["key"] == key else x["start"]
        carry.append((k, state))
        state, key = x["end"][0] * state + x["end"][1], x["last"]
    given = scratch.save(spark.createDataFrame(carry, "__range int, __carry double"))
    return dealt.join(given, "__range").select(*(F.col(c) for c in carried if c != out), (F.col("__a") * F.col("__carry") + F.col("__b")).alias(out))


def smoothed_series(df: DataFrame, by, order: list[str], value: str, alpha: float, out: str = "smooth") -> DataFrame:
    """Rows of `df` with a value, and exponential smoothing along each key: the first value, then alpha * x + (1 - alpha) * s.
    Rows without a value have no state and are left out."""
    rows = df.where(F.col(value).isNotNull())
    return affine_scan(rows, by, order, F.lit(1 - alpha), alpha * F.col(value), F.col(value), out)
