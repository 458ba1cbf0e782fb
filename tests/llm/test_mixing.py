import itertools
import random

import pytest

import lithos.llm.mixing as M
from lithos.llm.mixing import mix, mix_patterns, route, weighted_targets

SCHEMA = "doc_id long, text string, source string"


def test_targets_are_reshared():
    assert weighted_targets({"a": 10, "b": 1000, "c": 1000}, {"a": 5, "b": 2, "c": 1}, 1500, 2) == {"a": 20.0, "b": pytest.approx(1480 * 2 / 3), "c": pytest.approx(1480 / 3)}
    assert weighted_targets({}, {}, 0, 2) == {}
    assert weighted_targets({"a": 5}, {"a": 1}, 100, 2) == {"a": 10.0}


def test_flow_spreads_repeats():
    # both sources want 15 words; what only one of them has is repeated, what both have fills the rest
    given = route({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 15, "b": 15}, 2)
    assert given == {("a",): 10, ("a", "b"): 10, ("b",): 10}
    assert sum(route({("a",): 10, ("a", "b"): 4}, {"a": 20, "b": 6}, 2).values()) == 26
    assert route({("a",): 0}, {"a": 0}, 2) == {("a",): 0}


def corpus():
    return [(i, " ".join(["w"] * (i % 13)), f"s{i % 4}" if i % 9 else None) for i in range(400)] + [(500, None, "s1"), (501, "", "s2"), (None, "x y z", "s3"), (1, "w", "s1"), (1, "w", "s1")]


def test_mix(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    rows = mix(df).collect()
    assert len(rows) == len(corpus())
    sources = {}
    for r in rows:
        assert r.taken in ({0, r.size, 2 * r.size} if r.size else {0})
        sources.setdefault(r.pattern[0], []).append(r)
    total = sum(r.size for r in rows)
    sizes = {s: sum(r.size for r in v) for s, v in sources.items()}
    order = sorted(sizes, key=lambda s: (s is None, s))
    targets = weighted_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * total, 2)
    for s, v in sources.items():
        assert v[0].source_size == sizes[s] and v[0].target == pytest.approx(targets[s])
        assert abs(sum(r.taken for r in v) - targets[s]) <= 13
    assert sorted(map(repr, rows)) == sorted(map(repr, mix(df.repartition(7)).collect()))


def test_overlapping_sources(spark):
    rows = spark.createDataFrame([(i, 10, ["a"] if i % 3 else ["a", "b"]) for i in range(90)], "doc_id long, size long, pattern array<string>")
    out = mix_patterns(rows, (1, 1), 1.0, 2, "seed").collect()
    assert abs(sum(r.taken for r in out) - 900) <= 20


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, None, 5, "x")], SCHEMA + ", size int, pattern string")
    assert mix(df).first().taken == 0 and mix(df.limit(0)).collect() == []


def best_flow(capacity, quota, copies):
    """The least cost of a largest flow, over all flows."""
    arcs = [(p, s) for p in capacity for s in p]
    best = None
    for amounts in itertools.product(*(range(copies * capacity[p] + 1) for p, _ in arcs)):
        given, got = dict.fromkeys(capacity, 0), dict.fromkeys(quota, 0)
        for (p, s), n in zip(arcs, amounts):
            given[p] += n
            got[s] += n
        if all(given[p] <= copies * capacity[p] for p in capacity) and all(got[s] <= quota[s] for s in quota):
            found = -sum(amounts), cost_of(given, capacity, copies)
            best = found if best is None or found < best else best
    return best


def cost_of(given, capacity, copies):
    return sum((2 * k + 1) * max(0, min(capacity[p], given[p] - k * capacity[p])) for p in capacity for k in range(copies))


def test_route_against_all_flows():
    r = random.Random(8)
    for _ in range(60):
        sources = "abc"[: r.randint(1, 3)]
        patterns = {tuple(sorted(r.sample(sources, r.randint(1, min(2, len(sources)))))) for _ in range(r.randint(1, 3))}
        capacity = {p: r.randint(0, 2) for p in patterns}
        quota = {s: r.randint(0, 5) for p in patterns for s in p}
        given = M.route(capacity, quota, 2)
        assert (-sum(given.values()), cost_of(given, capacity, 2)) == best_flow(capacity, quota, 2)


def test_many_sources_that_do_not_overlap():
    capacity = {(f"s{i}",): i for i in range(50_000)}
    given = M.route(capacity, {s: 3 for (s,) in capacity}, 2)
    assert all(n == min(2 * i, 3) for i, n in enumerate(given.values()))


def test_many_overlapping_sources():
    import time

    r = random.Random(9)
    sources = [f"s{i}" for i in range(5000)]
    patterns = {(s,) for s in sources} | {tuple(sorted(r.sample(sources, r.choice([2, 2, 3])))) for _ in range(10_000)}
    capacity = {p: r.randint(1, 1000) for p in patterns}
    quota = {s: r.randint(1, 3000) for s in sources}
    start = time.time()
    given = M.route(capacity, quota, 2)
    assert time.time() - start < 30
    assert all(0 <= n <= 2 * capacity[p] for p, n in given.items()) and sum(given.values()) <= sum(quota.values())
    # no source that still wants words belongs to a pattern with words left
    assert sum(given.values()) >= sum(min(q, 2 * capacity[(s,)]) for s, q in quota.items())


def test_the_query_goes_through_the_flow(spark, monkeypatch):
    routed, flow = [], M.flow
    monkeypatch.setattr(M, "flow", lambda capacity, quota, copies: routed.append(set(capacity)) or flow(capacity, quota, copies))
    M.mix_query(spark.createDataFrame(corpus(), SCHEMA))
    assert set().union(*routed) == {("s0",), ("s1",), ("s2",), ("s3",), (None,)}
