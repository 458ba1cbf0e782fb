"""Mixing sources to target weights by a min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern (the set of sources); the patterns'
capacity is routed to the sources' quotas by a min-cost flow, in which the words of a pattern cost more each time that
they are repeated (convex costs), so that repetition is spread and only what has to be is repeated. The flow's totals
say how many words of each pattern the mix takes; whole documents are then selected in a seeded order, by histograms
over the order that narrow the place of the cut, so that no pattern's documents meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithos.llm.common import Scratch, word_count

#: The flow runs on the driver over one row a membership pattern; more of them are refused, because these rows, a few words
#: each, are all that the driver holds. Patterns and sources that overlap with no others cost a step each.
MOST_PATTERNS = 100_000
SEED = "mix-1"
#: Digits of the seeded order (hexadecimal) that one histogram resolves, and of the whole order.
STEP, DIGITS = 3, 15


def weighted_targets(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Share `total` by weight, no source above `most` times its size; what is above is reshared by weight."""
    out, open_ = {}, sorted(sizes, key=lambda s: (s is None, s))
    left = min(total, most * sum(sizes.values()))
    while open_:
        whole = sum(weights[s] for s in open_)
        full = [s for s in open_ if left * weights[s] / whole >= most * sizes[s]]
        if not full:
            return out | {s: left * weights[s] / whole for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
        left -= sum(most * sizes[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def route(capacity: dict[tuple, int], quota: dict, copies: int) -> dict[tuple, int]:
    """Words that each pattern gives: a min-cost flow from patterns to the sources that they belong to, each group of
    overlapping sources on its own."""
    up = {s: s for s in quota}

    def top(s):
        while up[s] != s:
            up[s] = up[up[s]]
            s = up[s]
        return s

    for p in capacity:
        for s in p[1:]:
            up[top(s)] = top(p[0])
    groups: dict = {}
    for p in capacity:
        groups.setdefault(top(p[0]), []).append(p)
    out = {}
    for some in groups.values():
        out |= flow({p: capacity[p] for p in some}, {s: quota[s] for p in some for s in p}, copies)
    return out


def flow(capacity: dict[tuple, int], quota: dict, copies: int) -> dict[tuple, int]:
    """The flow of one group.

    The k-th time that a pattern's words are taken costs 2k + 1 a word, on an arc start -> pattern; the arcs pattern ->
    source and source -> end cost nothing. So all paths of one cost begin with the arcs of one k, and the successive
    shortest paths are found k by k, each time as many as there are: by blocking flows over the arcs that lead a step nearer.
    What can't be routed at one k can't be later either, because no later path leads through it.
    """
    patterns, sources = sorted(capacity, key=repr), sorted(quota, key=lambda s: (s is None, str(s)))
    node = {("p", p): i + 2 for i, p in enumerate(patterns)} | {("s", s): i + 2 + len(patterns) for i, s in enumerate(sources)}
    to, room, out_of = [], [], [[] for _ in range(len(node) + 2)]

    def arc(a: int, b: int, n: int) -> int:
        for x, y, free in ((a, b, n), (b, a, 0)):
            out_of[x].append(len(to))
            to.append(y)
            room.append(free)
        return len(to) - 2

    begins = {p: arc(0, node["p", p], 0) for p in patterns}
    for p in patterns:
        for s in p:
            arc(node["p", p], node["s", s], copies * capacity[p])
    for s in sources:
        arc(node["s", s], 1, quota[s])
    for _ in range(copies):
        for p, i in begins.items():
            room[i] += capacity[p]
        while (far := distances(to, room, out_of))[1] >= 0:
            block(to, room, out_of, far)
    return {p: room[i ^ 1] for p, i in begins.items()}


def distances(to: list[int], room: list[int], out_of: list[list[int]]) -> list[int]:
    """Steps from node 0 to every node over arcs with room; -1 where there is no way."""
    far = [-1] * len(out_of)
    far[0], row = 0, [0]
    while row and far[1] < 0:
        after = []
        for a in row:
            for i in out_of[a]:
                if room[i] and far[to[i]] < 0:
                    far[to[i]] = far[a] + 1
                    after.append(to[i])
        row = after
    return far


def block(to: list[int], room: list[int], out_of: list[list[int]], far: list[int]) -> None:
    """Fill shortest ways from node 0 to node 1 until each has a full arc. An arc that leads nowhere is not tried again."""
    tried, path, a = [0] * len(out_of), [], 0
    while True:
        if a == 1:
            more = min(room[i] for i in path)
            for i in path:
                room[i] -= more
                room[i ^ 1] += more
            k = next(k for k, i in enumerate(path) if not room[i])
            a = to[path[k] ^ 1]
            del path[k:]
        arcs = out_of[a]
        while tried[a] < len(arcs) and not (room[arcs[tried[a]]] and far[to[arcs[tried[a]]]] == far[a] + 1):
            tried[a] += 1
        if tried[a] < len(arcs):
            path.append(arcs[tried[a]])
            a = to[path[-1]]
        elif path:
            a = to[path.pop() ^ 1]
            tried[a] += 1
        else:
            return


def cuts(rows: DataFrame, quotas: DataFrame) -> DataFrame:
    """For each pattern the place in the seeded order where its quota is reached: the place of the last document taken
    (`cut`), or null if none is. Each round resolves STEP more digits, over the documents of the boundary bin only: the
    window of a pattern has 16 ** STEP bins at most, whatever the number of its documents."""
    scratch = Scratch(rows.sparkSession, "cuts")
    known = quotas.select("pattern", F.col("rest").alias("left"), F.lit("").alias("prefix"))
    for depth in range(0, DIGITS, STEP):
        found = known.select("pattern", "left", "prefix")
        inside = rows.join(found, "pattern").where(F.col("place").startswith(F.col("prefix")))
        bins = inside.groupBy("pattern", F.substring("place", 1, depth + STEP).alias("bin")).agg(F.sum("size").alias("words"))
        order = Window.partitionBy("pattern").orderBy("bin")
        running = bins.withColumn("upto", F.sum("words").over(order)).join(found, "pattern")
        before = F.col("upto") - F.col("words")
        # the boundary bin: the first whose end lies above what is left
        at = running.where(F.col("upto") > F.col("left")).groupBy("pattern").agg(F.min(F.struct("bin", (F.col("left") - before).alias("left"), "words")).alias("at"))
        known = scratch.save(at.select("pattern", F.col("at.left").alias("left"), F.col("at.bin").alias("prefix"), F.col("at.words").alias("words")))
    return known


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: int = 2, seed: str = SEED, most_patterns: int = MOST_PATTERNS) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of `docs` (doc_id, text, source).

    A size is a number of words; a null text has none. Sources rank by code point, null last, and take `weights` in
    turn. `share` times all words are shared out; no target is above `most` times its source's size. `taken` is a
    multiple of the size, at most `most` times it: every row of a source is taken as often as the flow's total allows in
    full, and one time more up to a cut in a seeded order of (doc_id, size), to the nearest row. Rows with the same id
    and size share a place in that order, so they are taken alike. An empty table gives an empty result; a mix of empty
    texts takes 0 words. Further columns are not read.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    member = F.array("source")
    return mix_patterns(sized.withColumn("pattern", member), weights, share, most, seed, most_patterns)


def mix_patterns(sized: DataFrame, weights: tuple, share: float, most: int, seed: str, most_patterns: int = MOST_PATTERNS) -> DataFrame:
    """mix() for rows (doc_id, size, pattern): pattern is the sorted array of the sources that a document belongs to.
    source_size and target are sums over the sources of the pattern."""
    spark = sized.sparkSession
    scratch = Scratch(spark, "mix")
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string"))
    rows = scratch.save(sized.select("doc_id", "size", "pattern", F.substring(F.md5(key), 1, DIGITS).alias("place")))
    groups = rows.groupBy("pattern").agg(F.sum("size").alias("size")).limit(most_patterns + 1).collect()
    if len(groups) > most_patterns:
        raise ValueError(f"more than {most_patterns} membership patterns")
    capacity = {tuple(g.pattern): g.size for g in groups}
    sizes: dict = {}
    for p, n in capacity.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    ranked = sorted(sizes, key=lambda s: (s is None, s))
    of = {s: weights[i % len(weights)] for i, s in enumerate(ranked)}
    target = weighted_targets(sizes, of, share * sum(capacity.values()), most)
    given = route(capacity, {s: int(target[s] + 0.5) for s in ranked}, most)
    facts = [
        (list(p), sum(sizes[s] for s in p), float(sum(target[s] for s in p)), given[p] // n if n else 0, given[p] % n if n else 0)
        for p, n in capacity.items()
    ]
    schema = "pattern array<string>, source_size long, target double, full long, rest long"
    plan = scratch.save(spark.createDataFrame(facts, schema).coalesce(1))
    cut = cuts(rows, plan.where("rest > 0"))
    # of the documents at the cut itself the nearer total decides: taken if half of them or more is left
    decided = plan.join(cut.select("pattern", "left", "words", F.col("prefix").alias("cut")), "pattern", "left")
    extra = (F.col("rest") > 0) & ((F.col("place") < F.col("cut")) | ((F.col("place") == F.col("cut")) & (2 * F.col("left") >= F.col("words"))))
    times = F.col("full") + F.when(extra, 1).otherwise(0)
    out = rows.join(decided, "pattern")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), "pattern")


def mix_query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
