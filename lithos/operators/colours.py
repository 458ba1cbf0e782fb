"""Classification of points of a bounded space, such as colours, by random partition trees that don't depend on data.

A tree halves its space at each node on a drawn axis at a drawn place; a point's way down is a text of bits.
Counts are kept for every prefix of every way, so that new points only add to them; a point is told by the deepest node of its
way that has seen any, and the trees' shares are added up.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lithos.scratch import Scratch
from lithos.session import ship


#: Nodes of a tree that a task remembers before it begins anew.
REMEMBERED = 1_000_000


class Tree:
    """The nodes of one tree that points have come to so far, as arrays: each is made once a task, not once a point."""

    def __init__(self, bounds: list[tuple[float, float]], tree: int, seed: int):
        self.bounds, self.tree, self.seed = bounds, tree, seed
        self.begin()

    def begin(self) -> None:
        self.bits, self.low, self.high, self.axis, self.cut = [], [], [], [], []
        self.after = np.empty((0, 3), dtype=np.int64)
        self.add("", [float(b[0]) for b in self.bounds], [float(b[1]) for b in self.bounds])

    def uniform(self, kind: str, bits: str) -> float:
        return (int(hashlib.md5(f"{self.seed}:{kind}:{self.tree}:{bits}".encode()).hexdigest()[:12], 16) + 0.5) / float(1 << 48)

    def add(self, bits: str, low: list[float], high: list[float]) -> int:
        axis = math.floor(self.uniform("axis", bits) * len(self.bounds))
        for kept, x in ((self.bits, bits), (self.low, low), (self.high, high), (self.axis, axis), (self.cut, low[axis] + self.uniform("place", bits) * (high[axis] - low[axis]))):
            kept.append(x)
        if len(self.bits) > len(self.after):
            self.after = np.concatenate([self.after, np.full((len(self.after) + 64, 3), -1)])
        return len(self.bits) - 1

    def below(self, node: int, side: int) -> int:
        """The node on a side: 0 below the place, 1 from it on, 2 below for want of a value, where the box stays as it is."""
        low, high, axis = list(self.low[node]), list(self.high[node]), self.axis[node]
        if side < 2:
            (low if side else high)[axis] = self.cut[node]
        return self.add(self.bits[node] + "01"[side % 2], low, high)

    def ways(self, x: np.ndarray, missing: np.ndarray, depth: int) -> pa.Array:
        if len(self.bits) > REMEMBERED:
            self.begin()
        at, every = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(depth):
            axis = np.array(self.axis)[at]
            v = x[every, axis]
            side = np.where(missing[every, axis], 2, (v >= np.array(self.cut)[at]) | np.isnan(v))
            for node, to in np.unique(np.stack([at, side])[:, self.after[at, side] < 0], axis=1).T.tolist():
                new = self.below(node, to)
                self.after[node, to] = new
            at = self.after[at, side]
        used, index = np.unique(at, return_inverse=True)
        return pa.array([self.bits[k] for k in used], pa.string()).take(pa.array(index))


def with_ways(rows: DataFrame, bounds: list[tuple[float, float]], trees: int, depth: int, seed: int) -> DataFrame:
    """`rows` (x, an array) with __ways: for each tree the bits that lead the point down it, 1 from a node's place on, 0 below."""
    ship(rows.sparkSession)
    names = [f"__x{i}" for i in range(len(bounds))]
    wide = rows.select(*rows.columns, *(F.get("x", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)))
    kept = rows.columns

    def down(batches):
        grown = [Tree(bounds, k, seed) for k in range(trees)]
        for batch in batches:
            columns = [batch.column(n) for n in names]
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1)
            missing = np.stack([c.is_null().to_numpy(zero_copy_only=False) for c in columns], axis=1)
            ways = pa.concat_arrays([t.ways(x, missing, depth) for t in grown])
            ordered = ways.take(pa.array(np.arange(len(ways)).reshape(trees, -1).T.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(ways) + 1, trees), pa.int32()), ordered)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists], names=[*kept, "__ways"])

    return wide.mapInArrow(down, StructType([*rows.schema.fields, StructField("__ways", ArrayType(StringType()))]))


def ways(rows: DataFrame, bounds: list[tuple[float, float]], trees: int, depth: int, seed: int) -> DataFrame:
    """`rows` once a tree, with `tree` and `way`."""
    return with_ways(rows, bounds, trees, depth, seed).select(*rows.columns, F.posexplode("__ways").alias("tree", "way"))


def counted(labelled: DataFrame, bounds: list[tuple[float, float]], trees: int = 5, depth: int = 8, seed: int = 0) -> DataFrame:
    """tree, node, cls, n: how many of the points `labelled` (x, cls) of each class go through each node. Counts of two tables
    add up to those of both. Points of one leaf are counted before their prefixes are."""
    leaves = ways(labelled, bounds, trees, depth, seed).groupBy("tree", "way", "cls").agg(F.count(F.lit(1)).alias("n"))
    nodes = F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda k: F.substring("way", F.lit(1), k))
    return leaves.select("tree", "cls", "n", F.explode(nodes).alias("node")).groupBy("tree", "node", "cls").agg(F.sum("n").alias("n"))


def classified(rows: DataFrame, counts: DataFrame, bounds: list[tuple[float, float]], trees: int = 5, depth: int = 8, seed: int = 0) -> DataFrame:
    """id, cls, share of each of `rows` (id, x): the class with the largest mean share over the trees (the first of equal ones),
    each tree telling the shares of the deepest node that the point reaches and any counted point has. Ids are distinct. No rows
    without counts."""
    # what the trees' leaves say together is looked up once, however many points have the same ones
    placed = Scratch(rows.sparkSession, "ways").save(with_ways(rows.select("id", "x"), bounds, trees, depth, seed).select("id", "__ways"))
    leaves = placed.select("__ways").distinct().select("__ways", F.posexplode("__ways").alias("tree", "way"))
    known = counts.select("tree", "node").distinct()
    reached = leaves.select("tree", "way").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("node", F.substring("way", F.lit(1), F.col("k")))
    deepest = reached.join(known, ["tree", "node"]).groupBy("tree", "way").agg(F.max(F.struct("k", "node"))["node"].alias("node"))
    totals = counts.groupBy("tree", "node").agg(F.sum("n").alias("of"))
    shares = deepest.join(counts, ["tree", "node"]).join(totals, ["tree", "node"]).select("tree", "way", "cls", (F.col("n") / F.col("of")).alias("share"))
    votes = leaves.join(shares, ["tree", "way"]).groupBy("__ways", "cls").agg((F.sum("share") / trees).alias("share"))
    best = votes.groupBy("__ways").agg(F.max("share").alias("share"))
    tied = votes.withColumnRenamed("share", "s").join(best, "__ways").where(F.abs(F.col("s") - F.col("share")) < 1e-9)
    told = tied.groupBy("__ways").agg(F.min("cls").alias("cls"), F.max("share").alias("share"))
    return placed.join(told, "__ways").select("id", "cls", "share")
