"""Regression trees and forests that grow level by level, all nodes and all trees at once.

Every node that is too large tries some splits: a feature, and a place between the values of two of its rows, all drawn by
hashes, so that the same rows give the same tree. One aggregate finds the drawn rows, one the error of every (tree, node,
try); the best try whose smaller side isn't too small splits the node, and rows move to its children. Rows that a tree's
bootstrap leaves out move along and count for nothing, so that their leaf's mean is their out-of-bag prediction.
"""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.scratch import Scratch

#: A split is refused whose smaller side has less than this share of a node's rows.
LEAST_SHARE = 1 / 16
#: Rows of a bootstrap are drawn as often as a Poisson variable with mean 1 says, at most this often (a chance of 1e-10).
MOST_TIMES = 12


def drawn(*parts) -> Column:
    """Hexadecimal digits that look random and depend on the parts only."""
    return F.substring(F.md5(F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(p) for p in parts)).cast("binary")), 1, 12)


def uniform(*parts) -> Column:
    """A number between 0 and 1, of the same kind."""
    return (F.conv(drawn(*parts), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 48))


def poisson_steps() -> list[float]:
    total, out = 0.0, []
    for k in range(MOST_TIMES):
        total += exp(-1) / factorial(k)
        out.append(total)
    return out


def in_bags(rows: DataFrame, trees: int, seed: int) -> DataFrame:
    """`rows` (id, ...) once a tree, with `w`: how often the tree's bootstrap has it. One tree alone has every row once."""
    every = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    if trees == 1:
        return every.withColumn("w", F.lit(1))
    u = uniform(seed, "bag", F.col("tree"), F.col("id"))
    return every.withColumn("w", sum((F.when(u >= x, 1).otherwise(0) for x in poisson_steps()), F.lit(0)))


def candidates(state: DataFrame, features: int, tries: int, capacity: int, seed: int) -> DataFrame:
    """tree, node, try, feature, split of every node of `state` (tree, node, id, w, x, y) with more than `capacity` rows."""
    rows = state.where("w > 0")
    feature = lambda k: F.floor(uniform(seed, "feature", F.col("tree"), F.col("node"), k) * features).cast("int")
    at = lambda k, side: F.min_by(F.get("x", feature(k)), drawn(seed, "row", F.col("tree"), F.col("node"), k, side, F.col("id")))
    found = rows.groupBy("tree", "node").agg(F.sum("w").alias("n"), *(at(k, side).alias(f"v{k}_{side}") for k in range(tries) for side in (0, 1)))
    split = lambda k: F.col(f"v{k}_0") + uniform(seed, "split", F.col("tree"), F.col("node"), k) * (F.col(f"v{k}_1") - F.col(f"v{k}_0"))
    each = F.array(*(F.struct(F.lit(k).alias("try"), feature(k).alias("feature"), split(k).alias("split")) for k in range(tries)))
    return found.where(F.col("n") > capacity).select("tree", "node", F.explode(each).alias("c")).select("tree", "node", "c.*")


def errors(state: DataFrame, tried: DataFrame, norm: float = 2.0) -> DataFrame:
    """tree, node, try, feature, split, n, smaller, error: rows on both sides and the sum of |residual| ** norm about their
    means. Rows of a node move once, whatever the number of its tries."""
    of = tried.groupBy("tree", "node").agg(F.collect_list(F.struct("try", "feature", "split")).alias("tried"))
    each = state.where("w > 0").select("tree", "node", "w", "x", "y").join(of, ["tree", "node"]).withColumn("c", F.explode("tried"))
    sides = each.select("tree", "node", "w", "y", "c.try", (F.get("x", F.col("c.feature")) >= F.col("c.split")).alias("right"))
    sums = sides.groupBy("tree", "node", "try", "right").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("s"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("q"))
    if norm == 2.0:
        error = sums.withColumn("e", F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0)))
    else:
        means = sums.select("tree", "node", "try", "right", "n", (F.col("s") / F.col("n")).alias("mean"))
        error = sides.join(means, ["tree", "node", "try", "right"]).groupBy("tree", "node", "try", "right").agg(F.first("n").alias("n"), F.sum(F.col("w") * F.pow(F.abs(F.col("y") - F.col("mean")), F.lit(norm))).alias("e"))
    both = error.groupBy("tree", "node", "try").agg(F.sum("n").alias("n"), F.when(F.count(F.lit(1)) == 2, F.min("n")).otherwise(0).alias("smaller"), F.sum("e").alias("error"))
    return both.join(tried, ["tree", "node", "try"])


def grown(rows: DataFrame, features: int, trees: int = 1, tries: int = 4, capacity: int = 20, levels: int = 8, norm: float = 2.0, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The nodes (tree, node, n, mean, feature, split; the latter two null in leaves) of trees over `rows` (id, x, y; x an array
    of `features` numbers), and the rows as they end up (tree, id, w, y, node). Node 1 is a tree's root, 2k and 2k + 1 the sides
    of node k below its split and from it on. Ids must not repeat within a table; rows with nulls in x or y are left out."""
    scratch = Scratch(rows.sparkSession, "trees")
    whole = rows.where(F.col("y").isNotNull() & (F.size("x") == features) & ~F.exists("x", lambda v: v.isNull()))
    state = scratch.save(in_bags(whole.select("id", F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y")), trees, seed).withColumn("node", F.lit(1).cast("long")))
    splits = []
    for _ in range(levels):
        tried = scratch.save(candidates(state, features, tries, capacity, seed))
        if tried.isEmpty():
            break
        fair = errors(state, tried, norm).where((F.col("smaller") > 0) & (F.col("smaller") >= F.col("n") * F.lit(LEAST_SHARE)))
        best = scratch.save(fair.groupBy("tree", "node").agg(F.min(F.struct("error", "try", "feature", "split")).alias("b")).select("tree", "node", "b.feature", "b.split"))
        splits.append(best)
        side = F.when(F.get("x", F.col("feature")) >= F.col("split"), 1).otherwise(0)
        child = F.when(F.col("feature").isNull(), F.col("node")).otherwise(2 * F.col("node") + side)
        moved = state.join(best, ["tree", "node"], "left").withColumn("node", child).select("tree", "id", "w", "x", "y", "node")
        below = scratch.save(moved)
        scratch.drop(state)
        state = below
    found = None
    for best in splits:
        found = best if found is None else found.unionByName(best)
    leaves = state.where("w > 0").groupBy("tree", "node").agg(F.sum("w").alias("n"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("mean"))
    nodes = leaves.select("*", F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("split"))
    if found is not None:
        nodes = nodes.unionByName(found.select("tree", "node", F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("mean"), "feature", "split"))
    return scratch.save(nodes), state.select("tree", "id", "w", "y", "node")


def predict(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """id, tree, prediction of `rows` (id, x) by every tree: rows go down a level with each join."""
    scratch = Scratch(rows.sparkSession, "predict")
    last = nodes.agg(F.max("tree")).first()[0]
    trees = F.sequence(F.lit(0), F.lit(last)) if last is not None else F.array().cast("array<int>")
    state = rows.select("id", F.col("x").cast("array<double>").alias("x"), F.explode(trees).alias("tree"), F.lit(1).cast("long").alias("node"))
    out = None
    while True:
        here = scratch.save(state.join(nodes, ["tree", "node"]))
        done = here.where("feature IS NULL").select("id", "tree", F.col("mean").alias("prediction"))
        out = done if out is None else out.unionByName(done)
        state = here.where("feature IS NOT NULL").select("tree", "id", "x", (2 * F.col("node") + F.when(F.get("x", F.col("feature")) >= F.col("split"), 1).otherwise(0)).alias("node"))
        if state.isEmpty():
            return out


def out_of_bag(nodes: DataFrame, placed: DataFrame) -> DataFrame:
    """id, tree, y, prediction of every row by each tree whose bootstrap left it out."""
    return placed.where("w = 0").join(nodes.select("tree", "node", "mean"), ["tree", "node"]).select("id", "tree", "y", F.col("mean").alias("prediction"))
