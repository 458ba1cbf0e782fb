"""Random forests by MLlib, with what the out-of-bag rows of seeded bootstraps say about errors."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.operators.order import bootstrap, prefix


def vectors(df: DataFrame, features: list[str] | str, out: str = "__features") -> DataFrame:
    """`df` with a vector of columns, or of an array column."""
    if isinstance(features, str):
        return df.withColumn(out, array_to_vector(F.col(features).cast("array<double>")))
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="skip").transform(df)


def train(df: DataFrame, features, label: str, trees: int = 20, depth: int = 8, seed: int = 1):
    """A forest whose trees see bootstrap samples."""
    model = RandomForestRegressor(featuresCol="__features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    return model.fit(vectors(df, features))


def predict(model, df: DataFrame, features, out: str = "prediction") -> DataFrame:
    return model.transform(vectors(df, features)).withColumnRenamed("prediction", out).drop("__features", "rawPrediction", "probability")


def out_of_bag(df: DataFrame, features, label: str, ident: str, trees: int = 20, depth: int = 6, seed: int = 1) -> DataFrame:
    """ident, tree, prediction of every row by each tree whose bootstrap left it out."""
    rows, out = vectors(df, features), None
    for t in range(trees):
        bag = bootstrap(rows, seed + 101 * t, F.col(ident))
        tree = DecisionTreeRegressor(featuresCol="__features", labelCol=label, weightCol="times", maxDepth=depth, seed=seed + t).fit(bag.where("times > 0").withColumn("times", F.col("times").cast("double")))
        one = tree.transform(bag.where("times = 0")).select(ident, F.lit(t).alias("tree"), "prediction")
        out = one if out is None else out.unionByName(one)
    return out


def out_of_bag_bounds(oob: DataFrame, ident: str) -> DataFrame:
    """ident, mean, median and the bounds of the middle 75, 90 and 95 % of the trees' predictions; null where fewer than 8,
    20 and 40 trees left the row out. A row's predictions are as many as there are trees."""
    need = ((75, 8), (90, 20), (95, 40))
    cut = lambda p, q: F.expr(f"percentile(prediction, {q})")
    bounds = [F.when(F.count(F.lit(1)) >= n, cut(p, q)).alias(f"{side}_{p}") for p, n in need for side, q in (("lo", (1 - p / 100) / 2), ("hi", (1 + p / 100) / 2))]
    return oob.groupBy(ident).agg(F.avg("prediction").alias("mean"), F.median("prediction").alias("median"), F.count(F.lit(1)).alias("trees"), *bounds)


def filtered(df: DataFrame, oob: DataFrame, ident: str, label: str, p: float = 0.95) -> DataFrame:
    """Rows whose label lies within the middle share p of its out-of-bag predictions; rows that all trees saw stay."""
    cuts = oob.groupBy(ident).agg(F.expr(f"percentile(prediction, {(1 - p) / 2})").alias("__lo"), F.expr(f"percentile(prediction, {(1 + p) / 2})").alias("__hi"))
    joined = df.join(cuts, ident, "left")
    return joined.where(F.col("__lo").isNull() | F.col(label).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def leaf_classes(df: DataFrame, leaf: str, cls: str, boost: bool = False) -> DataFrame:
    """leaf, class, p: class shares in each leaf, all classes in each; counts of 0 count as 1 if boosted."""
    classes = df.select(cls).distinct()
    counts = df.groupBy(leaf, cls).agg(F.count(F.lit(1)).alias("n"))
    every = df.select(leaf).distinct().crossJoin(F.broadcast(classes)).join(counts, [leaf, cls], "left")
    n = F.greatest(F.coalesce("n", F.lit(0)), F.lit(1 if boost else 0))
    total = every.groupBy(leaf).agg(F.sum(n).alias("__t"))
    return every.join(total, leaf).select(leaf, cls, F.try_divide(n, F.col("__t")).alias("p"))


def leaf_error(df: DataFrame, leaf: str, cls: str) -> DataFrame:
    """Rows that don't belong to the commonest class of their leaf."""
    counts = df.groupBy(leaf, cls).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(leaf).agg((F.sum("n") - F.max("n")).alias("e")).agg(F.coalesce(F.sum("e"), F.lit(0)).alias("errors"))


def split_error(df: DataFrame, feature: str, label: str, at: float, norm: float = 2.0) -> DataFrame:
    """Sum of |residual|^norm about the means of both sides of a split."""
    side = F.col(feature) < at
    means = df.groupBy(side.alias("side")).agg(F.avg(label).alias("m"))
    joined = df.withColumn("side", side).join(F.broadcast(means), "side")
    return joined.agg(F.sum(F.pow(F.abs(F.col(label) - F.col("m")), F.lit(norm))).alias("error"))


def best_splits(df: DataFrame, feature: str, label: str) -> DataFrame:
    """The value of a feature, and the squared error, of the best split below it: running sums over distinct values."""
    y = F.col(label)
    sums = df.groupBy(F.col(feature).alias("v")).agg(F.count(y).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
    run = sums
    for c in ("n", "s", "q"):
        run = prefix(run, [F.col("v")], c, out=f"u{c}")
    total = sums.agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    both = run.crossJoin(F.broadcast(total)).select("v", *((F.col(f"u{c}") - F.col(c)).alias(f"l{c}") for c in "nsq"), "tn", "ts", "tq").where("ln > 0")
    right = F.col("tn") - F.col("ln")
    error = F.col("tq") - F.col("ls") * F.col("ls") / F.col("ln") - (F.col("ts") - F.col("ls")) * (F.col("ts") - F.col("ls")) / right
    return both.select(F.col("v").alias("split"), error.alias("error")).orderBy("error", "split").limit(1)
