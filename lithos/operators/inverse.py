"""Search of parameter spaces by user functions: candidates are rows, evaluated by vectorised functions in tasks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.scratch import Scratch


@dataclass(frozen=True)
class Problem:
    """A misfit of models within bounds: `error` takes a matrix (a model each row) and gives a misfit each; `prior` a log
    density each. Functions travel to the executors by value."""

    bounds: tuple[tuple[float, float], ...]
    error: Callable[[np.ndarray], np.ndarray]
    prior: Callable[[np.ndarray], np.ndarray] | None = None
    names: tuple[str, ...] = field(default=())

    @property
    def dims(self) -> int:
        return len(self.bounds)

    def low(self) -> np.ndarray:
        return np.array([a for a, _ in self.bounds], dtype=float)

    def high(self) -> np.ndarray:
        return np.array([b for _, b in self.bounds], dtype=float)


def evaluated(models: DataFrame, problem: Problem, params: str = "params") -> DataFrame:
    """`models` with misfit."""
    error = problem.error

    @F.pandas_udf("double")
    def misfit(p):
        import pandas as pd

        return pd.Series(np.asarray(error(np.stack(p.to_numpy()).astype(float)), dtype=float)) if len(p) else pd.Series([], dtype=float)

    return models.withColumn("misfit", misfit(F.col(params)))


def uniform_models(spark: SparkSession, problem: Problem, n: int, seed: int, first: int = 0) -> DataFrame:
    """id, params: n models uniform within the bounds, by hashes of the seed and id, so that reruns agree."""
    unit = lambda d: (F.pmod(F.xxhash64(F.lit(seed), F.lit(d), "id"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    p = F.array(*(F.lit(float(a)) + unit(d) * float(b - a) for d, (a, b) in enumerate(problem.bounds)))
    return spark.range(first, first + n).select("id", p.alias("params"))


def best(models: DataFrame, k: int = 1) -> DataFrame:
    return models.orderBy("misfit", "id").limit(k)


def monte_carlo(spark: SparkSession, problem: Problem, n: int, seed: int = 0) -> DataFrame:
    """All n models with their misfits."""
    return evaluated(uniform_models(spark, problem, n, seed), problem)


def by_chain(spark: SparkSession, chains: int, run: Callable[[int], list[tuple]], schema: str) -> DataFrame:
    """Rows of run(chain) for each chain: one task's sequential work each, so chains are what scales."""
    def each(frames):
        import pandas as pd

        names = [x.split()[0] for x in schema.split(", ")]
        for pdf in frames:
            for chain in pdf["id"]:
                yield pd.DataFrame(run(int(chain)), columns=names)

    return spark.range(0, chains, 1, chains).mapInPandas(each, schema)


def inside(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> bool:
    return bool(np.all(p >= low) and np.all(p <= high))


def annealing(spark: SparkSession, problem: Problem, chains: int, steps: int, hot: float = 1.0, cold: float = 1e-3, seed: int = 0, greedy: bool = False) -> DataFrame:
    """chain, params, misfit: the best model of each chain. Each step moves one axis uniformly within its bounds and accepts
    by Metropolis at a temperature that falls geometrically; only what is better, if greedy."""
    low, high, error = problem.low(), problem.high(), problem.error

    def run(chain):
        rng = np.random.default_rng([seed, chain])
        p = low + rng.random(len(low)) * (high - low)
        e = float(error(p[None])[0])
        top = (e, p)
        for k in range(steps):
            t = hot * (cold / hot) ** (k / max(1, steps - 1))
            q, d = p.copy(), rng.integers(len(low))
            q[d] = low[d] + rng.random() * (high[d] - low[d])
            f = float(error(q[None])[0])
            if f < e or not greedy and rng.random() < np.exp(-(f - e) / t):
                p, e = q, f
                top = min(top, (e, p), key=lambda x: x[0])
        return [(chain, top[1].tolist(), top[0])]

    return by_chain(spark, chains, run, "chain int, params array<double>, misfit double")


def descent(problem: Problem, rounds: int) -> Callable[[int, np.random.Generator, np.ndarray], list[tuple]]:
    """Powell's direction set from a model, by golden-section searches clamped to the bounds; the net move of a round replaces
    the direction that gained most where that pays."""
    low, high, error = problem.low(), problem.high(), problem.error

    def along(p, d, e):
        with np.errstate(divide="ignore", invalid="ignore"):
            to = np.concatenate([(low - p) / d, (high - p) / d])[np.concatenate([d, d]) != 0]
        if not len(to):
            return p, e
        a, b = to[to <= 0].max(initial=-np.inf), to[to >= 0].min(initial=np.inf)
        if not np.isfinite(a + b) or b <= a:
            return p, e
        grid = np.linspace(a, b, 17)
        values = error(p + grid[:, None] * d)
        i = int(np.argmin(values))
        a, b = grid[max(i - 1, 0)], grid[min(i + 1, 16)]
        g = (5**0.5 - 1) / 2
        for _ in range(40):
            x, y = b - g * (b - a), a + g * (b - a)
            fx, fy = error(np.stack([p + x * d, p + y * d]))
            a, b = (a, y) if fx < fy else (x, b)
        q = np.clip(p + (a + b) / 2 * d, low, high)
        f = float(error(q[None])[0])
        return (q, f) if f < e else (p, e)

    def descend(chain, rng, p):
        e, axes = float(error(p[None])[0]), list(np.eye(len(low))[rng.permutation(len(low))])
        for _ in range(rounds):
            p0, e0, gains = p, e, []
            for d in axes:
                before = e
                p, e = along(p, d, e)
                gains.append(before - e)
            if e0 - e < 1e-12 * (abs(e0) + 1e-12):
                break
            net, far = p - p0, 2 * p - p0
            if inside(far, low, high) and float(error(far[None])[0]) < e0:
                p, e = along(p, net, e)
                axes[int(np.argmax(gains))] = net
        return [(chain, p.tolist(), e)]

    return descend


def powell(spark: SparkSession, problem: Problem, starts: int, rounds: int = 20, seed: int = 0) -> DataFrame:
    """chain, params, misfit: where a descent ends from each of the seeded starts."""
    low, high, descend = problem.low(), problem.high(), descent(problem, rounds)

    def run(chain):
        rng = np.random.default_rng([seed, chain])
        return descend(chain, rng, low + rng.random(len(low)) * (high - low))

    return by_chain(spark, starts, run, "chain int, params array<double>, misfit double")


def hypercubes(spark: SparkSession, problem: Problem, restarts: int, samples: int, precision: float, most: int = 60, rounds: int = 20, seed: int = 0) -> DataFrame:
    """chain, params, misfit: a search of ever smaller boxes for each restart, ended by a descent from its best model.

    In a round every restart draws `samples` models in its box. If the worst and the best differ by less than the precision,
    its box is a plateau and it is done; else it goes to a seeded one of the models that are better than, or within the precision
    of, where it was (it stays where there is none), and the box shrinks to a quarter of its width to both sides of that model on
    one axis. Restarts and models are rows of one table, evaluated together; a round is written to the shared folder. `most`
    bounds the rounds of a misfit without plateau.
    """
    scratch = Scratch(spark, "hypercubes")
    draw = lambda *x: (F.pmod(F.xxhash64(F.lit(seed), "chain", *x), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    low, high = (F.array(*(F.lit(float(x[i])) for x in problem.bounds)) for i in (0, 1))
    within = lambda *x: F.transform("low", lambda a, d: a + draw(d, *x) * (F.get("high", d) - a))
    start = spark.range(restarts).select(F.col("id").cast("int").alias("chain"), low.alias("low"), high.alias("high"), F.lit(False).alias("done"))
    now = scratch.save(evaluated(start.withColumn("params", within(F.lit("start"))), problem).withColumn("best", F.struct("misfit", "params")))
    for k in range(most):
        open_ = now.where("NOT done")
        if open_.isEmpty():
            break
        box = open_.select("chain", "low", "high", F.col("misfit").alias("was"), F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("i"))
        models = evaluated(box.withColumn("params", within(F.lit(k), "i")), problem)
        good = F.when(F.col("misfit") - precision < F.col("was"), F.struct(draw(F.lit("good"), F.lit(k), "i").alias("u"), "misfit", "params"))
        told = models.groupBy("chain").agg(F.min(F.struct("misfit", "params")).alias("top"), F.max("misfit").alias("worst"), F.min(good).alias("to"))
        both = now.join(told, "chain", "left")
        at = F.coalesce("to.params", "params")
        axis = F.floor(draw(F.lit("axis"), F.lit(k)) * problem.dims).cast("int")
        plateau = F.col("done") | F.coalesce(F.col("worst") - F.col("top.misfit") < precision, F.lit(True))
        step = lambda d: (F.get("high", d) - F.get("low", d)) / 4
        cut = lambda c, f: F.when(plateau, F.col(c)).otherwise(F.transform(c, lambda x, d: F.when(d == axis, f(x, d)).otherwise(x))).alias(c)
        lower, upper = cut("low", lambda x, d: F.greatest(x, F.get(at, d) - step(d))), cut("high", lambda x, d: F.least(x, F.get(at, d) + step(d)))
        best_ = F.least("best", F.coalesce("top", "best")).alias("best")
        now = scratch.save(both.select("chain", lower, upper, plateau.alias("done"), at.alias("params"), F.coalesce("to.misfit", "misfit").alias("misfit"), best_))
    descend = descent(problem, rounds)

    def each(frames):
        import pandas as pd

        for pdf in frames:
            ends = [descend(int(c), np.random.default_rng([seed, int(c)]), np.asarray(p, dtype=float)) for c, p in zip(pdf["chain"], pdf["params"], strict=True)]
            yield pd.DataFrame([x for rows in ends for x in rows], columns=["chain", "params", "misfit"])

    tops = now.select("chain", "best.params").repartition(max(1, min(restarts, 200)), "chain")
    return tops.mapInPandas(each, "chain int, params array<double>, misfit double")


def mcmc(spark: SparkSession, problem: Problem, chains: int, steps: int, sd: float = 0.1, temperature: float = 1.0, burn: int = 0, thin: int = 1, seed: int = 0) -> DataFrame:
    """chain, step, params, misfit: Metropolis samples of exp(prior - misfit / temperature). Proposals are normal with `sd`
    times each axis' width; one out of bounds repeats the current model."""
    low, high, error, prior = problem.low(), problem.high(), problem.error, problem.prior

    def run(chain):
        rng = np.random.default_rng([seed, chain])
        log = lambda q, f: (float(prior(q[None])[0]) if prior else 0.0) - f / temperature
        p = low + rng.random(len(low)) * (high - low)
        e = float(error(p[None])[0])
        out, at = [], log(p, e)
        for k in range(steps):
            q = p + rng.normal(size=len(low)) * sd * (high - low)
            if inside(q, low, high):
                f = float(error(q[None])[0])
                new = log(q, f)
                if np.log(rng.random()) < new - at:
                    p, e, at = q, f, new
            if k >= burn and (k - burn) % thin == 0:
                out.append((chain, k, p.tolist(), e))
        return out

    return by_chain(spark, chains, run, "chain int, step int, params array<double>, misfit double")


def genetic(spark: SparkSession, problem: Problem, population: int, generations: int, mutation: float = 0.1, seed: int = 0) -> DataFrame:
    """id, params, misfit, generation of the last population. In each generation every member meets a seeded partner; their
    uniform crossover, mutated with the member's own rate, takes the member's place if it is fitter. A generation is a
    join and an evaluation, written to the shared folder."""
    scratch = Scratch(spark, "genetic")
    width = [float(b - a) for a, b in problem.bounds]
    now = scratch.save(evaluated(uniform_models(spark, problem, population, seed), problem).withColumn("rate", F.lit(mutation)))
    for g in range(1, generations + 1):
        draw = lambda *x, g=g: (F.pmod(F.xxhash64(F.lit(seed), F.lit(g), *x), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        partner = F.pmod(F.xxhash64(F.lit(seed + 7), F.lit(g), "id"), F.lit(population)).alias("mate")
        mates = now.select(F.col("id").alias("mate"), F.col("params").alias("other"))
        rate = F.least(F.greatest(F.col("rate") * F.exp(draw(F.lit("r"), "id") - 0.5), F.lit(1e-4)), F.lit(1.0))

        def gene(d):
            mixed = F.when(draw(F.lit(d), "id") < 0.5, F.get("params", F.lit(d))).otherwise(F.get("other", F.lit(d)))  # noqa: B023
            noise = (draw(F.lit(d + 1000), "id") + draw(F.lit(d + 2000), "id") - 1) * F.col("new_rate") * width[d]  # noqa: B023
            low, high = problem.bounds[d]
            return F.least(F.greatest(mixed + noise, F.lit(float(low))), F.lit(float(high)))

        paired = now.withColumn("mate", partner).join(mates, "mate").withColumn("new_rate", rate)
        child = paired.select("id", F.col("params").alias("old"), F.col("misfit").alias("was"), "rate", "new_rate", F.array(*(gene(d) for d in range(problem.dims))).alias("params"))
        tried = evaluated(child, problem)
        fitter = F.col("misfit") < F.col("was")
        now = scratch.save(tried.select("id", F.when(fitter, F.col("params")).otherwise(F.col("old")).alias("params"), F.least("misfit", "was").alias("misfit"), F.when(fitter, F.col("new_rate")).otherwise(F.col("rate")).alias("rate")))
    return now.select("id", "params", "misfit", F.lit(generations).alias("generation"))


def neighbourhood(spark: SparkSession, problem: Problem, first: int, samples: int, cells: int, rounds: int, seed: int = 0) -> DataFrame:
    """id, params, misfit of all models: uniform ones, then in each round `samples` more, dealt to the Voronoi cells of the
    `cells` best by walks that stay in the cell. The models that bound the walks are broadcast up to 20,000, which is
    refused beyond: the method is for costly functions of few models."""
    scratch = Scratch(spark, "neighbourhood")
    every = scratch.save(evaluated(uniform_models(spark, problem, first, seed), problem))
    low, high = problem.low(), problem.high()
    if first + samples * rounds > 20_000:
        raise ValueError("more than 20000 models")
    for r in range(rounds):
        known = np.array([x.params for x in every.select("params", "id").orderBy("id").collect()])
        tops = np.array([x.params for x in best(every, cells).collect()])
        shared = spark.sparkContext.broadcast((known, tops))
        start = first + r * samples

        def walk(frames, r=r, shared=shared, start=start):
            import pandas as pd

            known, tops = shared.value
            scale = 1 / (high - low) ** 2
            for pdf in frames:
                out = []
                for i in pdf["id"]:
                    rng = np.random.default_rng([seed, r, int(i)])
                    centre = tops[(int(i) - start) % len(tops)]
                    p = centre.copy()
                    for _ in range(3):
                        for d in rng.permutation(len(p)):
                            # along axis d the cell ends where another model gets as near
                            rest = (((known - p) ** 2) * scale).sum(axis=1) - ((known[:, d] - p[d]) ** 2) * scale[d]
                            own = (((centre - p) ** 2) * scale).sum() - ((centre[d] - p[d]) ** 2) * scale[d]
                            gap = known[:, d] - centre[d]
                            with np.errstate(divide="ignore", invalid="ignore"):
                                mid = 0.5 * (known[:, d] + centre[d] + (rest - own) / (scale[d] * gap))
                            a = np.max(mid[(gap < 0)], initial=low[d])
                            b = np.min(mid[(gap > 0)], initial=high[d])
                            p[d] = a + rng.random() * (max(b, a) - a)
                    out.append((int(i), np.clip(p, low, high).tolist()))
                yield pd.DataFrame(out, columns=["id", "params"])

        fresh = spark.range(start, start + samples).mapInPandas(walk, "id long, params array<double>")
        every = scratch.save(every.unionByName(evaluated(fresh, problem)))
    return every


def smooth_prior(delta: list[float]) -> Callable[[np.ndarray], np.ndarray]:
    """Log prior that is flat where neighbouring parameters differ by at most delta, and minus infinity elsewhere."""
    d = np.asarray(delta, dtype=float)
    return lambda p: np.where((np.abs(np.diff(p, axis=1)) <= d).all(axis=1), 0.0, -np.inf)


def bounded_walks(spark: SparkSession, problem: Problem, delta: list[float], n: int, levels: int = 50, seed: int = 0) -> DataFrame:
    """id, params: n models drawn evenly from all whose axes take one of `levels` equally spaced values and whose neighbouring
    parameters differ by at most delta. How many ways lead on from each level is counted from the last axis back; models then
    walk forward by these counts, in tasks. The counts are dims x levels numbers, whatever n. Raises where no model is left."""
    at = [np.linspace(a, b, levels) for a, b in problem.bounds]
    near = [(np.abs(x[:, None] - y[None]) <= d).astype(float) for x, y, d in zip(at[:-1], at[1:], delta, strict=True)]
    ahead = [np.ones(levels)]
    for step in reversed(near):
        ways = step @ ahead[0]
        ahead.insert(0, ways / max(1.0, ways.max()))
    if not ahead[0].any():
        raise ValueError("no model keeps within delta")
    # a row of running shares for each level that a walk comes from
    first = np.cumsum(ahead[0] / ahead[0].sum())
    moves = [np.cumsum(step * ways, axis=1) for step, ways in zip(near, ahead[1:], strict=True)]

    def walk(frames):
        import pandas as pd

        for pdf in frames:
            draws = np.array([np.random.default_rng([seed, int(i)]).random(len(at)) for i in pdf["id"]]).reshape(-1, len(at))
            level = np.minimum(np.searchsorted(first, draws[:, 0], side="right"), levels - 1)
            params = [at[0][level]]
            for d, rows in enumerate(moves, 1):
                upto = rows[level]
                level = (upto <= draws[:, d, None] * upto[:, -1:]).sum(axis=1)
                params.append(at[d][level])
            yield pd.DataFrame({"id": pdf["id"], "params": np.stack(params, axis=1).tolist()})

    return spark.range(n).mapInPandas(walk, "id long, params array<double>")


def gradient(models: DataFrame, problem: Problem, h: float = 1e-4) -> DataFrame:
    """`models` (id, params) with gradient: central differences, 2 evaluations an axis, all at once."""
    steps = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(s).alias("s")) for d in range(problem.dims) for s in (-1.0, 1.0)))
    moved = models.withColumn("__m", F.explode(steps)).withColumn("moved", F.transform("params", lambda x, i: x + F.when(i == F.col("__m.d"), F.col("__m.s") * h).otherwise(0.0)))
    f = evaluated(moved, problem, "moved").select("id", F.col("__m.d").alias("d"), (F.col("misfit") * F.col("__m.s") / (2 * h)).alias("g"))
    by = f.groupBy("id", "d").agg(F.sum("g").alias("g")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("d", "g"))).alias("__g"))
    return models.join(by, "id").withColumn("gradient", F.transform("__g", lambda x: x["g"])).drop("__g")


def slices(spark: SparkSession, problem: Problem, model: list[float], dims: list[int], n: int) -> DataFrame:
    """Misfits on a regular grid of n values along one or two axes through a model."""
    rows, p = spark.range(n ** len(dims)), [F.lit(float(x)) for x in model]
    for k, d in enumerate(dims):
        low, high = problem.bounds[d]
        p[d] = float(low) + F.pmod(F.floor(F.col("id") / n**k), F.lit(n)) * ((high - low) / max(1, n - 1))
    return evaluated(rows.select("id", F.array(*p).alias("params")), problem)


def posterior(models: DataFrame, expression: Column, weight: Column) -> DataFrame:
    """Weighted mean of an expression over models."""
    return models.agg(F.try_divide(F.sum(expression * weight), F.sum(weight)).alias("mean"))
