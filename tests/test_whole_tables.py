"""Queries without SQL over whole tables, held against brute force."""

import itertools
import math
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lithos.operators.graph import amalgamated, refined
from lithos.operators.inverse import Problem, bounded_walks, hypercubes
from lithos.operators.tracking import sampled_cells
from lithos.plans import registry
from lithos.plans.views import FLOWS

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def flows():
    c = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "supplier"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c.execute(f"WITH {FLOWS} SELECT r1, r2, n FROM flows").fetchall()


def best_paths(flows):
    """(dist, hops) of every pair that is joined, by relaxing all edges until nothing falls."""
    edges = [(a, b, 1.0 + 1000 // n) for a, b, n in flows if a != b]
    best = {(o, o): (0.0, 0) for o, *_ in edges}
    fell = True
    while fell:
        fell = False
        for o in {o for o, _ in best}:
            for a, b, w in edges:
                if (o, a) in best:
                    offer = (best[o, a][0] + w, best[o, a][1] + 1)
                    if offer < best.get((o, b), (float("inf"), 0)):
                        best[o, b], fell = offer, True
    return best


def test_path_lengths(spark, flows):
    expected = {}
    for (o, _), (dist, hops) in best_paths(flows).items():
        n, far = expected.get((o, hops), (0, 0.0))
        expected[o, hops] = (n + 1, max(far, dist))
    assert {(r.origin, r.hops): (r.nodes, r.farthest) for r in QUERIES["path_lengths"](spark, SF).collect()} == expected


def test_edge_loads(spark, flows):
    best = best_paths(flows)
    ways = [(n, *best[a, b]) for a, b, n in flows if (a, b) in best]
    rows = QUERIES["edge_loads"](spark, SF).collect()
    assert sum(r.trips for r in rows) == sum(n * hops for n, _, hops in ways)
    assert sum(r.work for r in rows) == sum(n * dist for n, dist, _ in ways)


def test_amalgamated_zones(spark, flows):
    zones = {z: (n, 1.0, v) for z, n, v in duckdb.sql(f"SELECT c_nationkey, count(*), avg(c_acctbal) FROM '{SF}/customer.parquet' GROUP BY 1").fetchall()}
    links = [(a, b) for a, b, _ in flows if a in zones and b in zones]
    assert {r.zone: r.cluster for r in QUERIES["amalgamated_zones"](spark, SF).collect()} == merged(zones, links, 150, 5)


def merged(zones, links, least, most_area):
    """The cluster of each zone {zone: (count, area, value)}: mutual offers while there are some, then orphans."""
    cluster = {z: z for z in zones}
    for orphans in (False, True):
        while True:
            of = {c: [zones[z] for z in zones if cluster[z] == c] for c in cluster.values()}
            cnt, area = ({c: sum(x[i] for x in xs) for c, xs in of.items()} for i in (0, 1))
            value = {c: sum(x[0] * x[2] for x in xs) / cnt[c] for c, xs in of.items()}
            pairs = {(cluster[x], cluster[y]) for a, b in links for x, y in ((a, b), (b, a))}
            small = [(a, b) for a, b in pairs if a != b and cnt[a] < least]
            if orphans:
                rank = lambda a, b: (cnt[b], b)  # noqa: E731, B023
            else:
                small = [(a, b) for a, b in small if cnt[b] < least and area[a] + area[b] <= most_area]
                rank = lambda a, b: (abs(value[a] - value[b]), min(a, b), max(a, b), b)  # noqa: E731, B023
            choice = {a: min((rank(x, b) for x, b in small if x == a))[-1] for a, _ in small}
            into = {a: b for a, b in choice.items() if a > b and choice.get(b) == a or orphans and b not in choice}
            if not into:
                break
            cluster = {z: into.get(c, c) for z, c in cluster.items()}
    return cluster


def test_orphans_join_their_smallest_neighbour(spark):
    """2 and 3 are closest but together too large; 5 has no neighbours; 1 is above the least."""
    zones = {1: (200, 1.0, 0.0), 2: (60, 3.0, 5.0), 3: (50, 3.0, 5.1), 4: (10, 1.0, 9.0), 5: (1, 1.0, 1.0), 6: (90, 9.0, 7.0)}
    links = [(1, 2), (2, 3), (3, 4), (4, 6), (2, 6)]
    rows = spark.createDataFrame([(z, *x) for z, x in zones.items()], "zone int, cnt int, area double, value double")
    found = {r.zone: r.cluster for r in amalgamated(rows, spark.createDataFrame(links, "src int, dst int"), 100, 5.0).collect()}
    assert found == merged(zones, links, 100, 5.0)
    assert found[5] == 5 and all(sum(zones[z][0] for z in zones if found[z] == c) >= 100 for c in found.values() if c != 5)


def test_refined_takes_each_node_once(spark):
    links = lambda rows: spark.createDataFrame(rows, "src string, dst string, w double")
    full = links([("a", "b", 9.0), ("a", "m", 4.0), ("m", "b", 4.5), ("a", "n", 4.6), ("n", "b", 5.0), ("c", "b", 9.0), ("c", "m", 3.0), ("m", "b", 4.5), ("a", "s", 0.5), ("s", "b", 1.0), ("c", "n", 4.0), ("x", "y", 9.0), ("x", "z", 4.0), ("z", "y", 4.0)])
    tree = links([("a", "b", 9.0), ("c", "b", 9.0), ("x", "y", 9.0)])
    rows = {(r.src, r.dst) for r in refined(tree, full, 5.5, 2.0, exempt=links([("x", "y", 0.0)])).collect()}
    assert rows == {("a", "m"), ("m", "b"), ("c", "n"), ("n", "b"), ("x", "y")}


def test_bounded_walks_are_even(spark):
    problem = Problem(((0.0, 1.0), (0.0, 1.0), (0.0, 2.0)), lambda p: p[:, 0])
    drawn = [tuple(r.params) for r in bounded_walks(spark, problem, [0.5, 1.0], 6000, 3, 1).collect()]
    allowed = {p for p in itertools.product((0.0, 0.5, 1.0), (0.0, 0.5, 1.0), (0.0, 1.0, 2.0)) if abs(p[0] - p[1]) <= 0.5 and abs(p[1] - p[2]) <= 1.0}
    seen = Counter(drawn)
    assert set(seen) == allowed
    assert all(abs(n - 6000 / len(allowed)) < 5 * (6000 / len(allowed)) ** 0.5 for n in seen.values())
    assert drawn == [tuple(r.params) for r in bounded_walks(spark, problem, [0.5, 1.0], 6000, 3, 1).collect()]
    with pytest.raises(ValueError, match="no model"):
        bounded_walks(spark, Problem(((0.0, 1.0), (5.0, 6.0)), lambda p: p[:, 0]), [0.5], 5)


def test_hypercubes_end_at_the_least(spark):
    """Two valleys, of which one is deeper; every restart ends in a valley, the best one in the deeper."""
    valleys = Problem(((-2.0, 2.0), (-2.0, 2.0)), lambda p: ((p[:, 0] ** 2 - 1) ** 2 + 0.2 * p[:, 0] + (p[:, 1] - 0.5) ** 2))
    rows = hypercubes(spark, valleys, 3, 60, 1e-3, seed=5).collect()
    assert sorted(r.chain for r in rows) == [0, 1, 2]
    assert all(abs(r.params[1] - 0.5) < 1e-3 and abs(abs(r.params[0]) - 1) < 0.1 for r in rows)
    assert min(r.misfit for r in rows) == pytest.approx(-0.2 - 0.0025, abs=1e-3)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, hypercubes(spark, valleys, 3, 60, 1e-3, seed=5).collect()))


def test_cells_are_sampled_by_mass(spark):
    pmf = spark.createDataFrame([(1, 0, 0, 0, 0.5), (1, 0, 0, 1, 0.3), (1, 0, 2, 2, 0.2), (1, 0, 3, 3, 0.0), (2, 0, 9, 9, 0.1), (3, 0, 1, 1, 0.0)], "sid int, t int, lati int, loni int, p double")
    rows = sampled_cells(pmf, 4000, 3).collect()
    seen = Counter((r.sid, r.lati, r.loni) for r in rows)
    assert set(seen) == {(1, 0, 0), (1, 0, 1), (1, 2, 2), (2, 9, 9)} and seen[2, 9, 9] == 4000
    assert all(abs(seen[1, i, j] / 4000 - p) < 0.03 for i, j, p in ((0, 0, 0.5), (0, 1, 0.3), (2, 2, 0.2)))


def test_thinned_tracks(spark):
    """Vertices kept by the rule, told anew for each track of the table."""
    tracks = defaultdict(list)
    for user, s, v in duckdb.sql(f"SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT), value FROM '{SF}/events.parquet' ORDER BY user_id, ts").fetchall():
        tracks[user].append((float(s), v))
    expected = {}
    for user, p in tracks.items():
        kept = [p[0]]
        for here, after in itertools.pairwise(p[1:]):
            dx, dy, vx, vy = after[0] - kept[-1][0], after[1] - kept[-1][1], here[0] - kept[-1][0], here[1] - kept[-1][1]
            way = math.hypot(dx, dy)
            if (abs(dx * vy - dy * vx) / way if way else math.hypot(vx, vy)) > 25.0:
                kept.append(here)
        expected[user] = len(kept) + (len(p) > 1)
    assert {r.user_id: r.kept for r in QUERIES["thinned_tracks"](spark, SF).collect()} == expected


def test_confidence_bounds(spark, tmp_path):
    vectors = [[k / 10, -0.3, 0.1, 0.2, 0.4, 2.0 if k == 9 else 0.01 * k] for k in range(-9, 10)]
    pq.write_table(pa.table({"vec_id": list(range(19)), "embedding": pa.array(vectors, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    rows = {r.dim: r for r in QUERIES["confidence_bounds"](spark, str(tmp_path)).collect()}
    assert sorted(rows) == list(range(6))
    for d, r in rows.items():
        xs = sorted(v[d] for v in vectors)
        assert xs[0] - 0.2 <= r.lo <= r.hi and abs(r.lo - xs[0]) <= 0.2 and abs(r.hi - xs[18]) <= 0.4
    assert rows[5].hi > 1.8
