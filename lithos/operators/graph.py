"""Weighted graphs as tables of edges (src, dst, w): path trees, costs, grid graphs, growth and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.operators.grid import FOUR, PLACE
from lithos.operators.trees import drawn
from lithos.scratch import Scratch


def graph(edges: DataFrame) -> DataFrame:
    """The edges; raises KeyError if one ends at a node that begins none."""
    lost = edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_anti").first()
    if lost is not None:
        raise KeyError(lost.dst)
    return edges


def reachable(edges: DataFrame, origin) -> DataFrame:
    """Nodes that can be reached, the origin too."""
    return shortest_paths(edges.withColumn("w", F.lit(1.0)), edges.sparkSession.createDataFrame([(origin,)], ["origin"])).select("node")


def shortest_paths(edges: DataFrame, origins: DataFrame, most: int | None = None) -> DataFrame:
    """origin, node, prev, dist, hops of the shortest paths from each origin (one column) with weights of 0 or more.

    All nodes whose distance has fallen relax their edges at once; rounds go on until none falls. Of equal paths the one
    with fewer hops, then with the smaller predecessor stays. `most` bounds the hops. Each round is written to the shared
    folder, which cuts the lineage; edges are never collected.
    """
    scratch = Scratch(edges.sparkSession, "paths")
    e = scratch.save(edges.select("src", "dst", F.col("w").cast("double").alias("w")).where("w >= 0"))
    node = dict(e.dtypes)["src"]
    start = origins.select(F.col(origins.columns[0]).alias("origin")).distinct()
    known = scratch.save(start.select("origin", F.col("origin").cast(node).alias("node"), F.lit(0.0).alias("dist"), F.lit(0).alias("hops"), F.lit(None).cast(node).alias("prev")))
    fresh, rounds = known, 0
    key = ["origin", "node"]
    best = F.min(F.struct("dist", "hops", "prev")).alias("b")
    while most is None or rounds < most:
        rounds += 1
        step = fresh.join(e, fresh["node"] == e["src"]).select("origin", F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), (F.col("hops") + 1).alias("hops"), F.col("src").alias("prev"))
        offers = step.groupBy(*key).agg(best).select(*key, "b.*")
        old = known.select(*key, F.struct("dist", "hops", "prev").alias("old"))
        better = offers.join(old, key, "left").where(F.col("old").isNull() | (F.struct("dist", "hops", "prev") < F.col("old"))).drop("old")
        fresh = scratch.save(better.select("origin", "node", "dist", "hops", "prev"))
        if fresh.isEmpty():
            break
        known = scratch.save(known.join(fresh.select(*key), key, "left_anti").unionByName(fresh))
    return known.select("origin", "node", "prev", "dist", "hops")


def path_nodes(paths: DataFrame, origin, target) -> DataFrame:
    """step, node, dist of the path from the origin to the target, from one origin's path tree."""
    tree = paths.where(F.col("origin") == origin)
    scratch = Scratch(paths.sparkSession, "path")
    at = scratch.save(tree.where(F.col("node") == target).select("hops", "node", "dist", "prev"))
    out = at
    while not at.where("prev IS NOT NULL").isEmpty():
        at = scratch.save(tree.alias("t").join(at.select(F.col("prev").alias("node")), "node").select("hops", "node", "dist", "prev"))
        out = out.union(at)
    return out.select(F.col("hops").alias("step"), "node", "dist")


def cost_matrix(paths: DataFrame, per_cost: float = 1.0) -> DataFrame:
    """origin, dest, cost, and the way back's in back."""
    there = paths.select("origin", F.col("node").alias("dest"), (F.col("dist") * per_cost).alias("cost"))
    back = there.select(F.col("origin").alias("dest"), F.col("dest").alias("origin"), F.col("cost").alias("back"))
    return there.join(back, ["origin", "dest"], "left")


def edge_loads(paths: DataFrame, trips: DataFrame, edges: DataFrame) -> DataFrame:
    """Trips and trip-weights on each tree edge: each trip (origin, dest, trips) is sent down its path; nodes hand what they
    carry to their predecessors, the farthest first."""
    scratch = Scratch(paths.sparkSession, "loads")
    tree = scratch.save(paths)
    carried = scratch.save(trips.select("origin", F.col("dest").alias("node"), F.col("trips").cast("double").alias("v")).groupBy("origin", "node").agg(F.sum("v").alias("v")).join(tree, ["origin", "node"]).select("origin", "node", "prev", "hops", "v"))
    parts = None
    while True:
        now = carried.where("prev IS NOT NULL")
        if now.isEmpty():
            break
        load = now.groupBy(F.col("prev").alias("src"), F.col("node").alias("dst")).agg(F.sum("v").alias("trips"))
        parts = load if parts is None else parts.union(load)
        up = now.groupBy("origin", F.col("prev").alias("node")).agg(F.sum("v").alias("v"))
        carried = scratch.save(up.join(tree, ["origin", "node"]).select("origin", "node", "prev", "hops", "v"))
    if parts is None:
        parts = edges.limit(0).select("src", "dst", F.lit(0.0).alias("trips"))
    total = parts.groupBy("src", "dst").agg(F.sum("trips").alias("trips"))
    return total.join(edges.groupBy("src", "dst").agg(F.min("w").alias("w")), ["src", "dst"]).withColumn("work", F.col("trips") * F.col("w"))


def grid_graph(cells: DataFrame, width: int, cost: Column | None = None, eight: bool = False) -> DataFrame:
    """Edges between neighbouring cells; an edge costs the mean of its cells' values, times the root of 2 on a diagonal.
    Nodes are lati * width + loni. Cells without data have no edges."""
    ways = [(i, j, 1.0) for i, j, _ in FOUR] + ([(i, j, 2**0.5) for i in (-1, 1) for j in (-1, 1)] if eight else [])
    moves = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(d).alias("d")) for i, j, d in ways))
    rows = cells.where("value IS NOT NULL").select(*PLACE, (F.col("value") if cost is None else cost).cast("double").alias("v"))
    near = rows.withColumn("m", F.explode(moves)).withColumn("i", F.col("lati") + F.col("m.i")).withColumn("j", F.col("loni") + F.col("m.j"))
    other = rows.select(F.col("lati").alias("i"), F.col("loni").alias("j"), F.col("v").alias("o"))
    node = lambda y, x: (F.col(y).cast("long") * width + F.col(x)).alias
    return near.join(other, ["i", "j"]).select(node("lati", "loni")("src"), node("i", "j")("dst"), ((F.col("v") + F.col("o")) / 2 * F.col("m.d")).alias("w"))


def most_likely_path(steps: DataFrame, emissions: DataFrame) -> DataFrame:
    """t, state, logp of the most likely way through states: `emissions` (t, state, logp) and moves `steps` (src, dst, logp).
    A layer a time step, folded forward with the best predecessor of each state, then traced back."""
    scratch = Scratch(steps.sparkSession, "viterbi")
    times = [r.t for r in emissions.select("t").distinct().orderBy("t").toLocalIterator()]
    if not times:
        return emissions.select("t", "state", "logp")
    layers = [scratch.save(emissions.where(F.col("t") == times[0]).select("t", "state", "logp", F.lit(None).cast(dict(emissions.dtypes)["state"]).alias("prev")))]
    for t in times[1:]:
        before = layers[-1].select(F.col("state").alias("src"), F.col("logp").alias("sofar"))
        offers = before.join(steps, "src").groupBy(F.col("dst").alias("state")).agg(F.max(F.struct((F.col("sofar") + F.col("logp")).alias("p"), -F.xxhash64("src"), F.col("src"))).alias("b"))
        now = emissions.where(F.col("t") == t).join(offers, "state")
        layers.append(scratch.save(now.select("t", "state", (F.col("logp") + F.col("b.p")).alias("logp"), F.col("b.src").alias("prev"))))
    out = [layers[-1].orderBy(F.desc("logp"), "state").limit(1)]
    for layer in reversed(layers[:-1]):
        out.append(scratch.save(layer.join(out[-1].select(F.col("prev").alias("state")), "state").select("t", "state", "logp", "prev")))
    rows = out[0]
    for more in out[1:]:
        rows = rows.union(more)
    return rows.select("t", "state", "logp")


def amalgamated(zones: DataFrame, edges: DataFrame, least: float, most_area: float) -> DataFrame:
    """zone, cluster: zones (zone, cnt, area, value) below `least` merge, in rounds, into the neighbour of closest mean value
    (weighted by counts) that is below it, too, and with which the area stays within `most_area`. In a round every cluster
    makes one offer and mutual offers merge, so that disjoint parts of the map merge side by side. What is left below `least`
    joins its smallest neighbour, whatever the area, again in rounds; a cluster without neighbours stays as it is. Links are
    taken both ways."""
    scratch = Scratch(zones.sparkSession, "merge")
    member = scratch.save(zones.select("zone", F.col("zone").alias("cluster"), "cnt", "area", "value"))
    ways = edges.select("src", "dst").where("src <> dst")
    links = scratch.save(ways.union(ways.select("dst", "src")).distinct())

    def neighbours():
        """Pairs of clusters that touch, with what each of them holds."""
        mean = F.try_divide(F.sum(F.col("cnt") * F.col("value")), F.sum("cnt")).alias("value")
        sums = scratch.save(member.groupBy("cluster").agg(F.sum("cnt").alias("cnt"), F.sum("area").alias("area"), mean))
        of = member.select(F.col("zone").alias("src"), F.col("cluster").alias("a")), member.select(F.col("zone").alias("dst"), F.col("cluster").alias("b"))
        pairs = links.join(of[0], "src").join(of[1], "dst").where("a <> b").select("a", "b").distinct()
        one, two = (sums.select(F.col("cluster").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("cnt", "area", "value"))) for k in ("a", "b"))
        return pairs.join(one, "a").join(two, "b").where(F.col("cnt_a") < least)

    def moved(into):
        return scratch.save(member.join(into, "cluster", "left").select("zone", F.coalesce("into", "cluster").alias("cluster"), "cnt", "area", "value"))

    def chosen(pairs, rank):
        """The best neighbour (b) of each cluster (a) and whether that one chooses it, too (mutual) or chooses at all (open)."""
        offers = scratch.save(pairs.groupBy("a").agg(F.min(rank).alias("o")).select("a", F.col("o.b").alias("b")))
        back = offers.select(F.col("a").alias("b"), F.col("b").alias("back"))
        return offers.join(back, "b", "left").select(F.col("a").alias("cluster"), F.col("b").alias("into"), (F.col("back") == F.col("a")).alias("mutual"), F.col("back").isNotNull().alias("open"))

    while True:
        small = neighbours().where((F.col("cnt_b") < least) & (F.col("area_a") + F.col("area_b") <= most_area))
        # a symmetric order of pairs, so that the closest pair of a neighbourhood is mutual
        rank = F.struct(F.abs(F.col("value_a") - F.col("value_b")), F.least("a", "b"), F.greatest("a", "b"), "b")
        into = scratch.save(chosen(small, rank).where("mutual AND cluster > into").select("cluster", "into"))
        if into.isEmpty():
            break
        member = moved(into)
    while True:
        # choices run down to smaller clusters, so that all but mutual ones end at a cluster that stays
        orphans = chosen(neighbours(), F.struct("cnt_b", "b"))
        into = scratch.save(orphans.where("NOT open OR (mutual AND cluster > into)").select("cluster", "into"))
        if into.isEmpty():
            return member.select("zone", "cluster")
        member = moved(into)


def grown(candidates: DataFrame, start, steps: int, tries: int, score, forbidden: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """A network that grows from `start` by the best of `tries` drawn candidate links (src, dst, ...) a step; links begin at a
    connected node. `score` takes the networks of all tries of a step as one table, with `try`, and gives a number each (try,
    score) to make large, so that a step is one aggregate; of equal ones the first drawn is taken. The network and a step's
    tries are few rows; the candidates stay distributed. Links of `forbidden` (src, dst) are never taken."""
    scratch = Scratch(candidates.sparkSession, "growth")
    pool = candidates if forbidden is None else candidates.join(forbidden.select("src", "dst"), ["src", "dst"], "left_anti")
    pool = scratch.save(pool)
    net = scratch.save(pool.limit(0))
    nodes = candidates.sparkSession.createDataFrame([(start,)], f"src {dict(candidates.dtypes)['src']}")
    for step in range(steps):
        connected = nodes.union(net.select("dst")).distinct()
        near = pool.join(connected, "src", "left_semi").join(net.select("src", "dst"), ["src", "dst"], "left_anti")
        order = [drawn(seed, step, F.col("src"), F.col("dst")), F.col("src"), F.col("dst")]
        few = near.orderBy(*order).limit(tries)
        tried = scratch.save(few.withColumn("try", F.row_number().over(Window.orderBy(*order)) - 1))
        n = tried.count()
        if not n:
            break
        networks = net.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).unionByName(tried)
        best = score(networks).orderBy(F.desc("score"), "try").limit(1).select("try")
        net = scratch.save(net.unionByName(tried.join(best, "try").drop("try")))
    return net


def refined(tree: DataFrame, edges: DataFrame, longest: float, least_leg: float, share: float = 1.0, exempt: DataFrame | None = None) -> DataFrame:
    """Links of a path tree (src, dst, w), those longer than `longest` replaced by the cheapest two links of the full graph
    that join their ends, each at least `least_leg` or `share` of the old link long, until no link can be. The node between is
    one that the tree doesn't visit yet; where links of a round would take the same, the one with the smallest ends does and
    the others choose again, so rounds end. Links of `exempt` (src, dst) stay."""
    scratch = Scratch(tree.sparkSession, "refined")
    now = scratch.save(tree.select("src", "dst", "w").distinct())
    full = scratch.save(edges.select("src", "dst", "w").where("src <> dst"))
    while True:
        long = now.where(F.col("w") > longest)
        if exempt is not None:
            long = long.join(exempt.select("src", "dst"), ["src", "dst"], "left_anti")
        leg = F.least(F.lit(float(least_leg)), F.col("w") * share)
        first = full.select("src", F.col("dst").alias("mid"), F.col("w").alias("aw"))
        second = full.select(F.col("src").alias("mid"), "dst", F.col("w").alias("bw"))
        visited = now.select(F.col("src").alias("mid")).union(now.select("dst")).distinct()
        two = long.join(first, "src").where(F.col("aw") >= leg).join(visited, "mid", "left_anti").join(second, ["mid", "dst"]).where(F.col("bw") >= leg)
        best = two.groupBy("src", "dst").agg(F.min(F.struct((F.col("aw") + F.col("bw")).alias("w"), "mid", "aw", "bw")).alias("m"))
        taken = scratch.save(best.groupBy("m.mid").agg(F.min(F.struct("src", "dst", "m")).alias("t")).select("t.src", "t.dst", "t.m"))
        if taken.isEmpty():
            return now
        new = taken.select("src", F.col("m.mid").alias("dst"), F.col("m.aw").alias("w")).union(taken.select("m.mid", "dst", "m.bw"))
        now = scratch.save(now.join(taken.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "w").union(new).distinct())


def layered(walk: DataFrame, routes: DataFrame, wait: float) -> DataFrame:
    """Edges between (layer, node) names of a public-transport graph: walking before a ride, rides by route, walking after.
    Boarding a route (route, src, dst, w) costs the wait; who has left the last ride walks on to the destination."""
    name = lambda layer, c: F.concat_ws(":", layer if isinstance(layer, Column) else F.lit(layer), c)
    on_foot = [walk.select(name(x, "src").alias("src"), name(x, "dst").alias("dst"), "w") for x in ("before", "after")]
    rides = routes.select(name(F.col("route"), "src").alias("src"), name(F.col("route"), "dst").alias("dst"), "w")
    stops = routes.select("route", F.col("src").alias("n")).union(routes.select("route", "dst")).distinct()
    changes = [stops.select(name(x, "n").alias("src"), name(F.col("route"), "n").alias("dst"), F.lit(float(wait)).alias("w")) for x in ("before", "after")]
    leave = stops.select(name(F.col("route"), "n").alias("src"), name("after", "n").alias("dst"), F.lit(0.0).alias("w"))
    out = rides
    for part in (*on_foot, *changes, leave):
        out = out.union(part)
    return out.distinct()
