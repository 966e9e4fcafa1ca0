"""Routing, components, closures and rasters held against brute force on small random inputs."""

import heapq
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from viamark.functions import calendar as cal
from viamark.operators import closures, driven, evaluation, network, polygons, raster, regions, routing, spatial, stats
from viamark.plans import q_terrain


def graph(n, m, seed):
    rng = np.random.default_rng(seed)
    found = {}
    for k, (a, b) in enumerate(rng.integers(0, n, (m, 2)).tolist()):
        if a != b:
            found[a, b] = (k + 1, float(rng.integers(1, 50)))
    return [(e, a, b, w) for (a, b), (e, w) in found.items()]


def reach(arcs, start):
    out, todo = {start}, [start]
    while todo:
        v = todo.pop()
        for _, a, b, _ in arcs:
            if a == v and b not in out:
                out.add(b)
                todo.append(b)
    return out


@pytest.mark.parametrize("n, m, seed", [(12, 20, 1), (25, 45, 2), (20, 70, 3), (6, 0, 4)])
def test_strong_components(spark, n, m, seed):
    arcs = graph(n, m, seed)
    ahead = {v: reach(arcs, v) for v in range(n)}
    expect = {frozenset(u for u in ahead[v] if v in ahead[u]) for v in range(n)}
    got = network.strong_components(spark.createDataFrame(arcs, "edge long, tail long, head long, minutes double")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.root, set()).add(r.node)
    assert {frozenset(g) for g in groups.values()} == {g for g in expect if len(g) > 1} and len(got) == sum(map(len, groups.values()))


def dijkstra(arcs, start, allowed, price=lambda a, b, w: w):
    dist, heap = {}, [(0.0, start)]
    while heap:
        d, v = heapq.heappop(heap)
        if v in dist:
            continue
        dist[v] = d
        for _, a, b, w in arcs:
            if a == v and b in allowed:
                heapq.heappush(heap, (d + price(a, b, w), b))
    return dist


def test_fields_paths_and_penalties(spark):
    arcs = graph(30, 110, 7)
    df = spark.createDataFrame(arcs, "edge long, tail long, head long, minutes double")
    starts = spark.createDataFrame([(1, 0), (2, 5)], "trip long, node long")
    allowed = {1: set(range(30)), 2: set(range(22))}
    within = spark.createDataFrame([(t, v) for t, vs in allowed.items() for v in vs], "trip long, node long")
    tree = routing.fields(df, starts, within, "minutes", ("minutes",))
    rows = tree.collect()
    for trip, start in ((1, 0), (2, 5)):
        got = {r.node: r.cost for r in rows if r.trip == trip}
        assert got == dijkstra(arcs, start, allowed[trip])
    assert all(abs(r.cost - r.minutes) < 1e-9 for r in rows)
    far = max((r for r in rows if r.trip == 1), key=lambda r: r.cost)
    steps = sorted(routing.path(tree, spark.createDataFrame([(1, far.node)], "trip long, node long")).collect(), key=lambda r: -r.back)
    weight = {(a, b): w for _, a, b, w in arcs}
    assert steps[0].tail == 0 and steps[-1].head == far.node and abs(sum(weight[r.tail, r.head] for r in steps) - far.cost) < 1e-9
    pen = spark.createDataFrame([(1, steps[0].tail, steps[0].head, 100.0)], "trip long, tail long, head long, factor double")
    got = {r.node: r.cost for r in routing.fields(df, starts.where("trip = 1"), within, "minutes", (), pen).collect()}
    assert got == dijkstra(arcs, 0, allowed[1], lambda a, b, w: w * (100.0 if (a, b) == (steps[0].tail, steps[0].head) else 1.0))


def test_split_junctions_allow_all_but_the_banned(spark):
    arcs = graph(8, 30, 11)
    df = spark.createDataFrame([(e, a, b) for e, a, b, _ in arcs], "edge long, tail long, head long")
    moves = [(b, e, f) for e, _, b, _ in arcs for f, a, _, _ in arcs if a == b]
    bans = set(moves[::3])
    got = routing.split_junctions(df, spark.createDataFrame(sorted(bans), "via long, from_edge long, to_edge long")).collect()
    out = {}
    for r in got:
        out.setdefault((r.tail, r.tail_copy), []).append(r.edge)
    allowed = {(r.head, r.edge, f) for r in got for f in out.get((r.head, r.head_copy), [])}
    assert allowed == set(moves) - bans


def test_barriers_by_where_they_stand(spark):
    # 1 -- 2 -- 3 along x, 4 a dead end at 3's far side; 9 stands inside the edge 1-2, 8 nowhere.
    edges = spark.createDataFrame([(10, 1, 2, 100.0), (11, 2, 3, 100.0), (12, 3, 4, 50.0), (13, 3, 5, 50.0)], "edge long, u long, v long, length_m double")
    segs = spark.createDataFrame([(10, 0.0, 0.0, 100.0, 0.0, 0.0), (11, 100.0, 0.0, 200.0, 0.0, 0.0), (12, 200.0, 0.0, 250.0, 0.0, 0.0), (13, 200.0, 0.0, 200.0, 50.0, 0.0)], "edge long, ax double, ay double, bx double, by double, start double")
    barriers = spark.createDataFrame([(9, 30.0, 0.5), (8, 30.0, 40.0), (2, 100.0, 0.0), (3, 200.0, 0.0), (4, 250.0, 0.0)], "node long, x double, y double")
    owners = spark.createDataFrame([(b, n) for b in (9, 8, 2, 3, 4) for n in (1, 9, 2, 3)], "node long, way_node long")
    got = sorted((r.node, r.place, r.edge, r.at_m) for r in closures.place_barriers(barriers, owners, edges, segs).collect())
    assert got == [(2, "through", 10, 100.0), (2, "through", 11, 0.0), (3, "junction", None, None), (4, "dead end", None, None), (8, "not in the graph", None, None), (9, "edge", 10, 30.0)]


def test_longest_closed_goes_round_the_year(spark):
    days = [(1, d, "a") for d in (*range(350, 366), *range(0, 20))] + [(1, d, "b") for d in range(100, 110)] + [(2, d, "a") for d in range(366)] + [(3, 5, "x")]
    got = {r.edge: (r.first_day, r.closed, r.reopens, r.source) for r in closures.longest_closed(spark.createDataFrame(days, "edge long, day int, source string")).collect()}
    assert got == {1: (350, 36, 20, "a"), 2: (0, 366, None, "a"), 3: (5, 1, 6, "x")}


def test_default_gives_way_on_dated_edges_and_at_whole_gates(spark):
    dated, default, summer = (11, 15, 4, 30), (11, 1, 5, 15), (6, 1, 8, 31)
    rows = [(1, "edge", -1, *default, "osm_default"), (1, "edge", -1, *dated, "table"), (2, "edge", -1, *default, "osm_default"), (2, "edge", -1, *summer, "osm_dated"), (1, "through", 7, *default, "osm_default"), (3, "through", 7, *default, "osm_default"), (3, "through", 8, *default, "osm_default"), (4, "edge", -1, *default, "unknown")]
    df = spark.createDataFrame(rows, "edge long, rule string, node_id long, m1 int, d1 int, m2 int, d2 int, source string")
    gone = sorted((r.edge, r.rule, r.node_id, r.m1) for r in closures.default_gives_way(df).where("gives_way").collect())
    assert gone == [(1, "edge", -1, 11), (1, "through", 7, 11), (3, "through", 7, 11)]


def test_agency_dates_and_park_windows(spark):
    rows = [("05/01-11/15", ""), ("01/01-10/11  10/22-12/31", ""), ("02/30-05/01", "seasonal"), ("by permit 05/01-06/01", ""), (None, "Seasonal ")]
    df = spark.createDataFrame(rows, "d string, s string").select(cal.agency_windows(F.col("d"), F.col("s")).alias("a"))
    got = [([tuple(w) for w in r.a.windows], r.a.how) for r in df.collect()]
    assert got == [([(11, 16, 4, 30)], "dates"), ([(10, 12, 10, 21)], "dates"), ([cal.UNKNOWN_SEASON], "seasonal, no readable dates"), ([], "no dates"), ([cal.UNKNOWN_SEASON], "seasonal, no readable dates")]


def test_road_class_labels(spark):
    # 1: half closed; 2: a run of 120 m private; 3: two samples private between public roads; 4: the same on a major road.
    rules = {1: [1, 1, 0, None], 2: [0, 2, 2, 2, 0, 0, 0, 0], 3: [0, 2, 2, 0, 0, 0], 4: [0, 2, 2, 0, 0, 0], 5: [0, 0, 0, 0], 6: [0, 0, 0, 0]}
    samples = [(e, 20.0 + 40.0 * k, r) for e, rs in rules.items() for k, r in enumerate(rs)]
    ends = {1: (1, 2), 2: (2, 3), 3: (4, 5), 4: (4, 5), 5: (4, 6), 6: (5, 6)}
    edges = [(e, *ends[e], 40.0 * len(rs), e == 4) for e, rs in rules.items()]
    df = spark.createDataFrame(samples, "edge long, along double, rule int")
    got = {r.edge: (r.rule, r.coverage, r.run_m, r.from_m, r.to_m) for r in closures.road_class_labels(df, spark.createDataFrame(edges, "edge long, u long, v long, length_m double, major boolean"), F.col("major")).collect()}
    assert got == {1: ("closed", 0.5, 80.0, 0.0, 80.0), 2: ("private", 0.375, 120.0, None, None), 3: ("private", 2 / 6, 80.0, None, None)}
    runs = {(r.edge, r.run): (r.rule, r.n, r.before, r.after) for r in closures.rule_runs(df).where("edge = 1").collect()}
    assert runs == {(1, 1): (1, 2, -2, 0), (1, 2): (0, 1, 1, -1), (1, 3): (-1, 1, 0, -2)}


def test_focal_filters_see_over_holes(spark):
    rng = np.random.default_rng(3)
    cells = {(r, c): float(rng.integers(0, 900)) for r, c in itertools.product(range(14), range(11)) if rng.random() < 0.4}
    df = spark.createDataFrame([(0, r, c, z) for (r, c), z in cells.items()], "tile int, row long, col long, z double")
    for px in (3, 7):
        k = px // 2
        near = lambda r, c: [z for (a, b), z in cells.items() if abs(a - r) <= k and abs(b - c) <= k]  # noqa: B023, E731
        got = {(r.row, r.col): (r.low, r.high) for r in raster.focal(df, "z", px).collect()}
        assert got == {rc: (min(near(*rc)), max(near(*rc))) for rc in cells}


def test_corridor_is_as_wide_as_its_ellipse(spark):
    nodes = [(i, float(x), float(y)) for i, (x, y) in enumerate(itertools.product(range(-3000, 3001, 250), repeat=2))]
    trip = (1, -1000.0, 0.0, 1000.0, 0.0)
    got = {r.node for r in network.corridor(spark.createDataFrame(nodes, "node_id long, x double, y double"), spark.createDataFrame([trip], "trip long, ox double, oy double, dx double, dy double"), 1500.0).collect()}
    assert got == {i for i, x, y in nodes if np.hypot(x + 1000, y) + np.hypot(x - 1000, y) <= 3500}


def test_least_distances_of_layers(spark):
    rng = np.random.default_rng(9)
    points = [(i, *map(float, rng.integers(0, 4000, 2))) for i in range(60)]
    sites = [(i, *map(float, rng.integers(0, 4000, 2))) for i in range(40)]
    df = spark.createDataFrame(points, "pid long, x double, y double")
    segs = spark.createDataFrame([(i, x, y, x, y) for i, x, y in sites], "id long, ax double, ay double, bx double, by double")
    got = {r.pid: (r.d_near, r.d_far) for r in spatial.distances(df, {"near": (segs, 150.0), "far": (segs, 900.0)}, {}, "id", 500.0).collect()}
    least = {i: min(np.hypot(x - a, y - b) for _, a, b in sites) for i, x, y in points}
    for i, d in least.items():
        near, far = got.get(i, (None, None))
        assert (near is None) == (d > 150) and (far is None) == (d > 900) and (far is None or abs(far - d) < 1e-9)


def test_owners_prefer_the_region_around_them(spark):
    cores = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 10.0, 0.0, 20.0, 10.0), (3, 100.0, 0.0, 110.0, 10.0)], "region int, x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 10.0, 5.0), (3, 22.0, 5.0), (4, 60.0, 5.0)], "pid long, x double, y double")
    assert {r.pid: r.region for r in regions.owners(points, cores, 5.0).collect()} == {1: 1, 2: 1, 3: 2, 4: None}


def test_features_of_one_place_are_worked_out_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, k % 7, k % 5) for k in range(40)], "c_custkey long, c_nationkey int, p_size int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(40).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    grid = spark.createDataFrame([(0, r, c, float(r * 7 + c * 3), c % 3) for r in range(4) for c in range(8)], "tile int, row long, col long, z double, cls long")
    monkeypatch.setattr(q_terrain, "_grid", lambda spark, sf_dir: grid)
    asked = []
    least = spatial.least_distance
    monkeypatch.setattr(spatial, "least_distance", lambda points, *a: asked.append(points.count()) or least(points, *a))
    points = spark.createDataFrame([(k, 1000.0 * (k % 3) + 20, 700.0) for k in range(60)], "pid long, x double, y double")
    got = q_terrain._features(spark, str(tmp_path), points).collect()
    assert asked == [3, 3] and sorted(r.pid for r in got) == list(range(60))
    assert len({tuple(r)[1:] for r in got if r.pid % 3 == 0}) == 1


@pytest.mark.parametrize("rows", [100_000, 7])
def test_draws_fall_on_edges_by_length(spark, rows):
    edges = [(e * 3, (e * 37) % 900) for e in range(300)]
    draws = [(k, k / 2000) for k in range(2000)]
    got = evaluation.interval_draws(spark.createDataFrame(edges, "edge long, mm long"), spark.createDataFrame(draws, "draw long, u double"), rows).collect()
    ends = np.cumsum([mm for _, mm in edges])
    want = {}
    for k, u in draws:
        place = int(np.floor(u * ends[-1]))
        at = int(np.searchsorted(ends, place, "right"))
        want[k] = (edges[at][0], place - int(ends[at] - edges[at][1]))
    assert {r.draw: (r.edge, r.offset) for r in got} == want


def test_draws_are_not_held_against_all_ranges(spark):
    edges = spark.range(40).selectExpr("id AS edge", "if(id % 4 = 0, 0, id) AS mm")
    out = evaluation.interval_draws(edges, spark.createDataFrame([(1, 0.0), (2, 0.5), (3, 1.0)], "draw long, u double"), 2)
    plan = out._jdf.queryExecution().toString()
    assert "lambda" not in plan and "collect_list" not in plan
    assert {(r.draw, r.edge, r.offset) for r in out.collect()} == {(1, 1, 0), (2, 29, 6), (3, 39, 39)}


def ring(rng, n, x, y, size):
    """A ring that winds in and out, with vertices on round numbers."""
    a = np.sort(rng.random(n)) * 2 * np.pi
    r = size * (0.3 + 0.7 * rng.random(n))
    return [(float(round(x + q * np.cos(t))), float(round(y + q * np.sin(t)))) for t, q in zip(a, r)]


def inside(px, py, ring):
    n = 0
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > py) != (by > py) and px < (bx - ax) * (py - ay) / (by - ay) + ax:
            n += 1
    return n % 2 == 1


@pytest.mark.parametrize("size", [7.0, 40.0, 500.0])
def test_cut_polygons_answer_as_whole_ones(spark, size):
    rng = np.random.default_rng(int(size))
    rings = [(k, ring(rng, 60, *rng.integers(0, 200, 2), 80)) for k in range(6)] + [(9, [(0.0, 0.0), (30.0, 0.0), (30.0, 30.0), (0.0, 30.0)])]
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.integers(-60, 260, (600, 2)))]
    df = spark.createDataFrame(rings, "id int, geom array<struct<x:double,y:double>>")
    at = spark.createDataFrame(points, "pid long, x double, y double")
    want = {(k, i) for k, x, y in points for i, g in rings if inside(x, y, g)}
    assert {tuple(r) for r in polygons.containing_cut(at, *polygons.cut(df, "id", size), "id", size).collect()} == want
    both = spatial.containing(at, df, "id", size, vertices=20).collect()
    assert len(both) == len(want) and {tuple(r) for r in both} == want


def test_overlaps_come_once(spark):
    rng = np.random.default_rng(4)
    spans = lambda n: [(int(k % 3), k, float(a), float(a + b)) for k, (a, b) in enumerate(rng.integers(0, 90, (n, 2)))]
    a, b = spans(60), spans(50)
    left = spark.createDataFrame(a, "drive int, i int, a double, b double")
    right = spark.createDataFrame(b, "drive int, j int, c double, d double")
    got = sorted((r.i, r.j) for r in spatial.overlap_join(left, right, ["drive"], ("a", "b"), ("c", "d"), 5.0, 20.0).collect())
    assert got == sorted((i, j) for v, i, x, y in a for w, j, s, t in b if v == w and x - 5 <= t and s <= y + 5)


def test_gated_shares_cross_tiles(spark):
    rng = np.random.default_rng(6)
    grid = rng.integers(0, 2, (8, 12, 2))
    cells = [(r + 4, c - 4, int(grid[r, c, 0]), int(grid[r, c].all())) for r in range(8) for c in range(12) if not 4 <= c < 8 or r < 4]
    there = {(r, c): (a, g) for r, c, a, g in cells}
    points = [(k, int(r), int(c)) for k, (r, c) in enumerate(rng.integers(-8, 20, (80, 2)))] + [(100, 4, -4), (101, 7, 3), (102, 8, 4)]
    got = raster.gated_box_shares(spark.createDataFrame(points, "pid long, row long, col long"), spark.createDataFrame(cells, "row long, col long, a int, g int"), ["a", "g"], 2, 4).collect()
    assert len(got) == len(points)
    for r in got:
        _, row, col = next(p for p in points if p[0] == r.pid)
        box = [there.get((row + i, col + j), (0, 0)) for i in range(-2, 3) for j in range(-2, 3)]
        assert (round(r.a * 25), round(r.g * 25)) == (sum(x for x, _ in box), sum(g for _, g in box))


def test_switch_points_and_frontier(spark):
    rng = np.random.default_rng(8)
    rows = [(t, p + 1, float(k)) for t in range(3) for p, k in enumerate(np.cumsum(rng.integers(0, 5, 40)) / 10)]
    got = {}
    for r in routing.switch_points(spark.createDataFrame(rows, "trip int, pos int, km double"), points=6, step_km=0.5).collect():
        got.setdefault(r.trip, []).append(r.pos)
    for t in range(3):
        line = [(p, k) for u, p, k in rows if u == t]
        step, keep = max(0.5, line[-1][1] / 6), [line[0]]
        for p, k in line[1:]:
            if k >= keep[-1][1] + step - 1e-9:
                keep.append((p, k))
        assert sorted(got[t]) == sorted({p for p, _ in keep} | {line[-1][0]}) and len(got[t]) <= 8
    options = [(1, i, j, float(e), float(g)) for (i, j), (e, g) in zip([(i, j) for i in range(9) for j in range(i)], rng.integers(1, 15, (36, 2)))]
    best = routing.frontier_of(spark.createDataFrame(options, "trip int, i int, j int, extra double, gain double")).collect()
    want = {(e, g) for _, _, _, e, g in options if not any(e2 <= e and g2 >= g and (e2, g2) != (e, g) for _, _, _, e2, g2 in options)}
    assert {(r.extra, r.gain) for r in best} == want and len(best) == len(want)


def test_nearest_of_a_group_at_any_distance(spark):
    rng = np.random.default_rng(5)
    at = lambda n, far: [(k, f"g{k % 4}", float(x), float(y)) for k, (x, y) in enumerate(rng.integers(0, far, (n, 2)))]
    points, others = at(80, 900), [o for o in at(30, 3000) if o[1] != "g3"]
    got = spatial.nearest_of(spark.createDataFrame(points, "pid long, g string, x double, y double"), spark.createDataFrame(others, "key long, g string, x double, y double"), "g", "key", 20.0).collect()
    want = {(p, g, min((np.hypot(x - u, y - v), k) for k, h, u, v in others if h == g)[1]) for p, g, x, y in points if g != "g3"}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_banded_pairs_are_seeded_and_within_quota(spark):
    from viamark.operators import studies

    rng = np.random.default_rng(2)
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.integers(0, 1000, (400, 2)))]
    df = spark.createDataFrame(points, "id long, x double, y double")
    bands = [50.0, 200.0, 500.0, 900.0]
    take = lambda d: sorted(tuple(r) for r in studies.banded_pairs(d, bands, 30, 4).collect())
    got, at = take(df.repartition(3)), {k: (x, y) for k, x, y in points}
    assert got == take(df.repartition(7)) and len({(a, b) for _, a, b, _ in got}) == len(got)
    for band, a, b, d in got:
        assert a != b and abs(d - np.hypot(at[a][0] - at[b][0], at[a][1] - at[b][1])) < 1e-9 and bands[band] <= d < bands[band + 1]
    assert [sum(1 for g in got if g[0] == k) for k in range(3)] == [30, 30, 30]


def test_balanced_logistic_against_newton(spark):
    """Held-out accuracy equals that of the same model fitted by Newton steps in NumPy."""
    from viamark.operators import studies

    rng = np.random.default_rng(9)
    rows = []
    for region in ("a", "b", "c"):
        for _ in range(150):
            y = float(rng.random() < 0.2)
            rows.append((region, float(rng.normal(1.5 * y, 1)), float(rng.normal(-y, 2)), y))
    got = {r.region: (r.n, r.accuracy) for r in studies.balanced_logistic(spark.createDataFrame(rows, "region string, u double, v double, label double"), ["u", "v"], "label", "region").collect()}
    x, y, part = np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows]), np.array([r[0] for r in rows])
    w = np.where(y == 1, 1 / (y == 1).sum(), 1 / (y == 0).sum())
    for r in "abc":
        own = part == r
        m, s = x[~own].mean(0), x[~own].std(0, ddof=1)
        a, b, t, q = np.c_[np.ones((~own).sum()), (x[~own] - m) / s], np.zeros(3), y[~own], w[~own] / w[~own].sum()
        for _ in range(40):
            p = 1 / (1 + np.exp(-a @ b))
            grad = a.T @ (q * (p - t)) + 0.01 * np.r_[0, b[1:]]
            b -= np.linalg.solve((a * (q * p * (1 - p))[:, None]).T @ a + 0.01 * np.diag([0, 1, 1]), grad)
        z = np.c_[np.ones(own.sum()), (x[own] - m) / s] @ b
        assert got[r][0] == own.sum() and abs(got[r][1] - ((z > 0) == (y[own] == 1)).mean()) < 0.02


def test_digest_knows_rows_and_not_their_order(spark):
    from viamark.operators import checks

    df = spark.createDataFrame([(k, float(k % 7), f"t{k % 5}") for k in range(200)], "a long, b double, c string")
    one = lambda d: tuple(checks.digest(d).first())
    base = one(df.repartition(2))
    assert base == one(df.orderBy(F.desc("a")).repartition(5)) and base[0] == 200
    assert len({base, one(df.union(df.limit(1))), one(df.where("a <> 3")), one(df.withColumn("b", F.when(F.col("a") == 3, 9.0).otherwise(F.col("b"))))}) == 4
    assert one(df.limit(0))[0] == 0


def test_group_percentiles(spark):
    rng = np.random.default_rng(14)
    rows = [(g, float(v)) for g, n in (("a", 40), ("b", 1), ("c", 7), (None, 9)) for v in rng.integers(0, 12, n)] + [("c", None)]
    got = {r.g: list(r.p) for r in stats.group_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", (0.0, 0.1, 0.5, 0.77, 1.0)).collect()}
    for g in ("a", "b", "c", None):
        assert np.allclose(got[g], np.percentile([v for k, v in rows if k == g and v is not None], [0, 10, 50, 77, 100]))
    both = stats.with_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", (0.5,), F.count("v").alias("n")).collect()
    assert {r.g: r.n for r in both} == {"a": 40, "b": 1, "c": 7, None: 9} and all(r.p is not None for r in both)


def test_caps_and_recalibration(spark):
    rng = np.random.default_rng(12)
    rows = [(k, g, float(rng.integers(0, top)), float(rng.integers(1, 5))) for g, n, top in (("home", 300, 60), ("far", 200, 400), ("tiny", 5, 90)) for k in range(n)]
    df = spark.createDataFrame(rows, "id long, g string, v double, w double")

    def ranked(g):
        v, w = np.array([r[2] for r in rows if r[1] == g]), np.array([r[3] for r in rows if r[1] == g])
        u = np.unique(v)
        m = np.array([w[v == x].sum() for x in u])
        return u, (np.cumsum(m) - m / 2) / m.sum()

    share = 1 - sum(r[3] for r in rows if r[1] == "home" and r[2] >= 45) / sum(r[3] for r in rows if r[1] == "home")
    caps = {r.g: r.cap for r in stats.equal_share_caps(df, "g", "v", "w", "home", 45.0).collect()}
    assert caps["home"] == 45.0 and all(abs(caps[g] - np.interp(share, *ranked(g)[::-1])) < 1e-9 for g in ("far", "tiny"))
    grid = np.linspace(0, 1, 201)
    ref = np.interp(grid, *ranked("home")[::-1])
    for r in stats.recalibrated(df, "g", "v", "w", "home", 100.0).collect():
        if r.g == "tiny":
            assert r.mapped == r.v
            continue
        own, keep = np.unique(np.interp(grid, *ranked(r.g)[::-1]), return_index=True)
        assert abs(r.mapped - np.interp(r.v, own, ref[keep])) < 1e-6


def test_turned_back_clips_to_the_strip(spark):
    segs = [("a", 100.0, 0.0, 100.0, 0.0, -900.0, 0.0, 0.0, 0.0), ("b", 100.0, 90.0, 50.0, 90.0, -900.0, 0.0, 0.0, 0.0), ("c", 0.0, 0.0, -300.0, 0.0, -100.0, 0.0, 0.0, 0.0), ("d", 10.0, 60.0, -200.0, -60.0, -320.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(segs, "route string, start double, ax double, ay double, bx double, by double, px double, py double, heading double")
    got = {r.route: round(r.at_m, 3) for r in driven.turned_back(df).collect()}
    assert got == {"a": 200.0, "d": round(10 + np.hypot(120, 120) / 3, 3)}


def test_quantiles_are_exact_over_bins(spark):
    from viamark.operators import stats

    rng = np.random.default_rng(6)
    for values in (rng.integers(0, 40, 3000), rng.normal(0, 1, 777), np.array([3.0]), np.repeat([1.0, 2.0], [900, 3])):
        df = spark.createDataFrame([(float(v), int(k % 3 + 1)) for k, v in enumerate(values)], "v double, n int")
        shares = (0.0, 0.1, 0.5, 0.9, 0.99, 1.0)
        assert np.allclose(stats.quantiles(df, "v", shares, bins=16).first().q, np.quantile(values, shares), atol=1e-9)
        repeated = np.repeat(values, [k % 3 + 1 for k in range(len(values))])
        assert np.allclose(stats.quantiles(df, "v", shares, F.col("n"), bins=16).first().q, np.quantile(repeated, shares), atol=1e-9)


def test_edges_that_lie_alike_are_matched_once_and_all_named(spark):
    rng = np.random.default_rng(5)
    at = {n: (float(n * 100), float(n % 3 * 10)) for n in range(6)}
    paths = {w: sorted(rng.choice(6, int(rng.integers(2, 6)), replace=False).tolist()) for w in range(20)}
    steps = [(w, a, b) for w, p in paths.items() for a, b in zip(p[:-1], p[1:])]
    edges = [(k, a, b, (at[a][0] + at[b][0]) / 2, (at[a][1] + at[b][1]) / 2) for k, (_, a, b) in enumerate(steps)]
    nodes = spark.createDataFrame([(w, n) for w, p in paths.items() for n in p], "way_id long, node long")
    segs = spark.createDataFrame([(w, *at[a], *at[b]) for w, a, b in steps], "way_id long, ax double, ay double, bx double, by double")
    e = spark.createDataFrame(edges, "edge long, u long, v long, mx double, my double")
    found = closures.way_shapes(nodes, segs, e)

    def on(w, x, y):
        for a, b in zip(paths[w][:-1], paths[w][1:]):
            (ax, ay), (bx, by) = at[a], at[b]
            t = min(1.0, max(0.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            if np.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)) <= 1:
                return True
        return False

    expect = {(w, k) for w, p in paths.items() for k, u, v, x, y in edges if u in p and v in p and on(w, x, y)}
    assert {(r.way_id, r.edge) for r in closures.way_edges(nodes, segs, e).collect()} == expect
    assert found.count() == len({(w, *edges[k][1:]) for w, k in expect}) < len(expect)


def test_closed_counts_against_brute_force(spark):
    rng = np.random.default_rng(6)
    windows = [(11, 1, 5, 15), (6, 1, 8, 31), (11, 15, 4, 30)]
    rows = [(int(rng.integers(8)), ["edge", "through"][k % 2], int(rng.integers(4)) if k % 2 else -1, *windows[int(rng.integers(3))]) for k in range(40)]
    days = [("a", 1, 20), ("b", 7, 1), ("c", 5, 10), ("d", 9, 15)]
    t = spark.createDataFrame(rows, "edge long, rule string, node_id long, m1 int, d1 int, m2 int, d2 int")
    got = closures.closed_counts(t, spark.createDataFrame(days, "day_id string, month int, day int"))
    held = lambda w, m, d: w[0] * 100 + w[1] <= m * 100 + d <= w[2] * 100 + w[3] if w[:2] <= w[2:] else not w[2] * 100 + w[3] < m * 100 + d < w[0] * 100 + w[1]
    expect = set()
    for i, m, d in days:
        if on := [r for r in rows if held(r[3:], m, d)]:
            expect.add((i, len({r[0] for r in on}), len({r[2] for r in on if r[1] == "through"}), len({r[3:] for r in on})))
    assert {tuple(r) for r in got.collect()} == expect


def test_triples_of_classes_are_those_of_all_their_ways(spark):
    rng = np.random.default_rng(7)
    refs = [(w, n + 1, int(v)) for w in range(60) for n, v in enumerate(rng.choice(7, 4, replace=False))]
    r = spark.createDataFrame(refs, "way_id long, n long, node_id long")
    rule = lambda a, b: (a * 3 + b) % 5 == 0
    pairs = [("only" if (a + b) % 2 else "no", a, v, b) for a, _, v in refs for b, _, u in refs if u == v and a != b and rule(a, b)]
    expect = evaluation.turn_triples(r, spark.createDataFrame(pairs, "kind string, from_way long, via long, to_way long")).collect()
    a, b = F.col("from_class"), F.col("to_class")
    got = evaluation.class_triples(r, F.col("way_id") % 10, rule(a, b), F.when((a + b) % 2 == 1, "only").otherwise("no")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expect)) and len(got) > 100
    # A way that is alone in its class does not restrict itself.
    alone = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3)], "way_id long, n long, node_id long")
    assert evaluation.class_triples(alone, F.col("way_id") % 10, rule(a, b), F.lit("no")).count() == 0


def test_boxes_meet_once_and_copies_of_a_place_are_covered_alike(spark):
    rng = np.random.default_rng(8)
    box = lambda k: (k, *map(float, c := rng.integers(0, 40, 2)), *map(float, c + rng.integers(0, 15, 2)))
    a, b = [box(k) for k in range(60)], [box(k) for k in range(30)]
    a += [(60 + k, *row[1:]) for k, row in enumerate(a)]
    names = "id long, x0 double, y0 double, x1 double, y1 double"
    one, two = spark.createDataFrame(a, names), spark.createDataFrame(b, names)
    expect = [(p[0], q[0]) for p in a for q in b if p[1] <= q[3] + 2 and p[3] >= q[1] - 2 and p[2] <= q[4] + 2 and p[4] >= q[2] - 2]
    pairs = regions.box_pairs(one, two, 2.0, 5.0)
    assert sorted(map(tuple, pairs.collect())) == sorted(expect)
    classes = regions.box_classes(one)
    few = regions.box_pairs(classes, two, 2.0, 5.0)
    assert few.count() <= len(expect) / 2
    sized = few.join(classes.withColumnRenamed("id", "a_id"), "a_id").groupBy("b_id").agg(F.sum("n").alias("n")).collect()
    assert {r.b_id: r.n for r in sized} == {i: sum(q == i for _, q in expect) for i in {q for _, q in expect}}
    rings = [(k, [(x, y), (x + 9.0, y), (x + 9.0, y + 9.0), (x, y + 9.0)], k % 2, k % 4) for k, (x, y) in enumerate(rng.uniform(0, 30, (12, 2)).tolist())]
    r = spark.createDataFrame(rings, "id long, geom array<struct<x: double, y: double>>, carrier int, env int")
    at = [(k, *p) for k, p in enumerate(rng.uniform(0, 35, (20, 2)).tolist() * 5)]
    got = {(c.pid, c.carrier): c.env for c in regions.best_cover(spark.createDataFrame(at, "pid long, x double, y double"), r, 10.0).collect()}
    held = {}
    for pid, x, y in at:
        for _, g, carrier, env in rings:
            if g[0][0] <= x < g[2][0] and g[0][1] <= y < g[2][1]:
                held[pid, carrier] = max(env, held.get((pid, carrier), 0))
    assert got == held and len(held) > 20


def test_spliced_options_count_every_pair_of_nodes(spark, monkeypatch):
    from viamark.plans import q_routing

    n, rng = 12, np.random.default_rng(9)
    minutes, beauty = (np.cumsum(rng.uniform(0.1, 1, n)).tolist() for _ in range(2))
    names = "trip int, node long, cost double, beauty double"
    m1, m2 = ([(1, k, float(a), float(b)) for k, (a, b) in enumerate(rng.uniform(0, 3, (n, 2)))] for _ in range(2))
    on = spark.createDataFrame([(1, k + 1, k, minutes[k], beauty[k], minutes[k]) for k in range(n)], "trip int, pos int, node long, minutes double, beauty double, km double")
    fast = spark.createDataFrame([(1, 1.0, 0.5)], "trip int, minutes double, beauty double")
    monkeypatch.setattr(q_routing, "_spliced", lambda *_: (on, spark.createDataFrame(m1, names), spark.createDataFrame(m2, names), fast))
    options = []
    for i, j in itertools.combinations(range(n), 2):
        extra = m1[i][2] - minutes[i] + minutes[j] + m2[j][2] - 1.0
        gain = m1[i][3] - beauty[i] + beauty[j] + m2[j][3] - 0.5
        if round(extra, 6) > 0 and round(gain, 6) > 1e-9:
            options.append((extra, gain))
    row = q_routing.g23_spliced_options(spark, "").first()
    assert row.options == len(options) > 30
    assert row.best_gain == pytest.approx(max(g for _, g in options), abs=1e-6) and row.least_extra == pytest.approx(min(e for e, _ in options), abs=1e-6)


def test_pairs_of_points_and_cut_polygons_are_not_shuffled(spark):
    rng = np.random.default_rng(21)
    star = lambda cx, cy: [(cx + r * np.cos(a), cy + r * np.sin(a)) for a, r in zip(np.linspace(0, 2 * np.pi, 30, False), rng.uniform(2, 12, 30))]
    rings = [(k, [(float(x), float(y)) for x, y in star(*rng.uniform(0, 40, 2))]) for k in range(12)]
    r = spark.createDataFrame(rings, "id long, geom array<struct<x: double, y: double>>")
    at = spark.createDataFrame([(k, *p) for k, p in enumerate(rng.uniform(-5, 45, (300, 2)).tolist())], "pid long, x double, y double")
    whole = {tuple(p) for p in spatial.containing(at, r, "id", 10.0).collect()}
    cut = spatial.containing(at, r, "id", 10.0, 8)
    assert {tuple(p) for p in cut.collect()} == whole and len(whole) > 100
    assert "hashpartitioning(pid" not in cut._jdf.queryExecution().executedPlan().toString()
    found = [p.pid for p in spatial.inside_any(at, r, "id", 10.0, 8).collect()]
    assert sorted(found) == sorted({p for p, _ in whole})
    near = [p.pid for p in regions.near_polygons(at, r, 1.0, 10.0, 8).collect()]
    assert len(near) == len(set(near)) and set(found) < set(near)


def test_closed_days_are_worked_out_once_for_each_set_of_windows(spark):
    rng = np.random.default_rng(11)
    windows = [("osm_default", 11, 1, 5, 15), ("table", 10, 20, 5, 20), ("osm_dated", 6, 1, 8, 31), ("agency_dated", 11, 16, 4, 30)]
    shapes = [(a, a + 1, a + 0.5, 0.0) for a in range(12)]
    on = {s: [w for w in windows if rng.random() < 0.4] for s in shapes[:9]}
    edges = [(k, 100 + k, *shapes[int(rng.integers(0, 12))]) for k in range(300)]
    gates = sorted({(int(k), int(n), *windows[0]) for k, n in zip(rng.integers(0, 300, 40), rng.integers(0, 3, 40))})
    w = "source string, m1 int, d1 int, m2 int, d2 int"
    ways = spark.createDataFrame([(*s, *x) for s, xs in on.items() for x in xs], f"u int, v int, mx double, my double, {w}")
    e = spark.createDataFrame(edges, "edge int, way_id int, u int, v int, mx double, my double")
    by_set, sets = closures.edges_by_windows(ways, spark.createDataFrame(gates, f"edge int, node_id int, {w}").drop("node_id"), e)
    expect = {k: {*on.get(tuple(s), []), *[g[2:] for g in gates if g[0] == k]} for k, _, *s in edges}
    named = {}
    for r in sets.collect():
        named.setdefault(r["set"], set()).add(tuple(r)[1:])
    got = by_set.collect()
    assert {r.edge: named[r["set"]] for r in got} == {k: x for k, x in expect.items() if x} and all(r.way_id == 100 + r.edge for r in got)
    assert len(got) == len({r.edge for r in got}) and len(named) == len({frozenset(x) for x in named.values()}) < 20
    no = F.lit(3)
    plain = spark.createDataFrame([(k, *x) for k, xs in expect.items() for x in xs], f"edge int, {w}")
    each = sorted(map(tuple, closures.longest_closed(closures.closed_days(plain, no, no)).collect()))
    once = closures.longest_closed(closures.closed_days(sets, no, no, "set"), "set")
    assert sorted(map(tuple, by_set.join(once, "set").select("edge", "first_day", "closed", "reopens", "source").collect())) == each


def test_nearest_in_cells_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(12)
    lines = [(k, *(float(x) for x in rng.integers(0, 40, 4) * 25)) for k in range(400)]
    # Lines that lie alike, and the same the other way round, where the smaller key wins.
    lines += [(1000 + k, *lines[k][1:]) for k in range(40)] + [(2000 - k, *lines[k][3:], *lines[k][1:3]) for k in range(40, 80)] + [(-1, *lines[90][3:], *lines[90][1:3])]
    points = [(k, k % 7, float(x), float(y)) for k, (x, y) in enumerate(rng.random((300, 2)) * 1000)]
    points += [(300 + k, 0, (s[1] + s[3]) / 2, (s[2] + s[4]) / 2) for k, s in enumerate(lines[:100])]

    def best(px, py):
        found = []
        for k, ax, ay, bx, by in lines:
            square = (bx - ax) ** 2 + (by - ay) ** 2
            t = min(1.0, max(0.0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / square)) if square else 0.0
            found.append((round(float(np.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))), 6), k))
        return min(found)

    expect = {(p, c): k for p, c, x, y in points for far, k in [best(x, y)] if far <= 30}
    segs = spark.createDataFrame(lines, "edge long, ax double, ay double, bx double, by double")
    df = spark.createDataFrame(points, "pid long, kind long, x double, y double")
    for most in (spatial.BROADCAST_BYTES, 0):
        monkeypatch.setattr(spatial, "BROADCAST_BYTES", most)
        cells, size = spatial.nearest_cells(segs, "edge", 30.0)
        assert cells.where("edge between 1000 and 1039").isEmpty()
        got = spatial.nearest_in(df, cells, size, ["pid", "kind"], "edge", 30.0, 6).collect()
        assert {(r.pid, r.kind): r.edge for r in got} == expect and len(got) == len(expect)


def test_controls_on_lines_against_brute_force(spark):
    rng = np.random.default_rng(13)
    draw = lambda n, k: (rng.random((n, k)) * 3000).round(1).tolist()
    lines = [(k % 6, *p) for k, p in enumerate(draw(30, 4))] + [(2, 500.0, 500.0, 500.0, 500.0), (7, 0.0, -2000.0, 3000.0, -2000.0), (7, 0.0, -2000.0, 3000.0, -2000.0)]
    controls = [(k, *p) for k, p in enumerate(draw(250, 2))] + [(300, 1000.0, -1950.0), (299, 1200.0, -1950.0)]
    stops = [(k, k % 8, *p) for k, p in enumerate(draw(120, 2))] + [(500, 2, 1100.0, 700.0), (501, 7, 1100.0, -2000.0)]

    def off(x, y, ax, ay, bx, by):
        square = (bx - ax) ** 2 + (by - ay) ** 2
        t = min(1.0, max(0.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / square)) if square else 0.0
        return np.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))

    expect = {}
    for p, drive, x, y in stops:
        on = [(float(np.hypot(x - cx, y - cy)), c) for c, cx, cy in controls if any(d == drive and off(cx, cy, *z) <= 100 for d, *z in lines)]
        if found := [m for m in on if m[0] <= 600]:
            expect[p] = min(found)
    assert expect[501] == (float(np.hypot(100, 50)), 299) and 0 < len(expect) < len(stops)
    s = spark.createDataFrame(stops, "pid long, drive long, x double, y double")
    e = spark.createDataFrame(lines, "drive long, ax double, ay double, bx double, by double")
    q = spark.createDataFrame(controls, "id long, x double, y double")
    got = {r.pid: (r.dist, r.control) for r in driven.controls_on_lines(s, e, q, 600.0, 100.0, 200.0).collect()}
    assert {p: c for p, (_, c) in got.items()} == {p: c for p, (_, c) in expect.items()} and all(abs(got[p][0] - expect[p][0]) < 1e-9 for p in got)
    assert driven.controls_on_lines(s.where("pid < 0"), e, q, 600.0, 100.0).count() == 0
