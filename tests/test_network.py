import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from viamark.operators import network, routing, spatial
from viamark.operators.components import components
from viamark.plans import catalog, tables
from viamark.plans.tables import stage


def graph(seed, n=40, m=70):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), float(rng.randint(1, 20))) for _ in range(m)]


def test_components(spark):
    arcs = graph(1, 60, 45)
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in arcs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    nodes = {x for a, b, _ in arcs if a != b for x in (a, b)}
    got = {r.node: r.root for r in components(spark.createDataFrame([x[:2] for x in arcs], "a long, b long")).collect()}
    assert got == {x: find(x) for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_largest_scc(spark):
    arcs = graph(3, 25, 50)
    out = {x: {b for a, b, _ in arcs if a == x} for x in range(25)}

    def reach(x):
        seen, todo = {x}, [x]
        while todo:
            for y in out[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return seen

    r = {x: reach(x) for x in range(25)}
    best = max(len({y for y in r[x] if x in r[y]}) for x in range(25))
    got = {x.node for x in network.largest_scc(spark.createDataFrame(arcs, "tail long, head long, minutes double")).collect()}
    assert len(got) == best and all(y in r[x] for x in got for y in got)


def test_fields_and_paths(spark):
    arcs = graph(5)
    dist, pred, heap = {0: 0.0}, {}, [(0.0, 0)]
    while heap:
        d, x = heapq.heappop(heap)
        if d > dist[x]:
            continue
        for a, b, w in arcs:
            if a == x and d + w < dist.get(b, 1e9):
                dist[b], pred[b] = d + w, x
                heapq.heappush(heap, (d + w, b))
    df = spark.createDataFrame(arcs, "tail long, head long, minutes double")
    tree = routing.fields(df, spark.createDataFrame([(7, 0)], "trip long, node long"), None, "minutes")
    assert {r.node: r.cost for r in tree.collect()} == dist
    far = max(dist, key=dist.get)
    path = routing.path(tree, spark.createDataFrame([(7, far)], "trip long, node long")).orderBy(F.desc("back")).collect()
    least = {(a, b): min(w for x, y, w in arcs if (x, y) == (a, b)) for a, b, _ in arcs}
    assert path[0].tail == 0 and path[-1].head == far and sum(least[p.tail, p.head] for p in path) == dist[far]


def test_path_sums(spark):
    rows = [(i, (i - 1) // 3 if i else None, float(i)) for i in range(50)]
    got = {r.node: (r.root, r.total) for r in network.path_sums(spark.createDataFrame(rows, "node long, parent long, v double"), "v").collect()}
    for i in range(50):
        total, x = 0.0, i
        while x:
            total, x = total + x, (x - 1) // 3
        assert got[i] == (0, total)


def test_path_sums_leave_what_has_reached_its_root(spark, monkeypatch):
    written = []
    monkeypatch.setattr(network, "stage", lambda df, name: (lambda out: written.append(out.count()) or out)(stage(df, name)))
    rows = [(i, i // 2, 1.0) for i in range(1, 256)] + [(0, 0, 1.0), (900, 999, 1.0), (901, 900, 1.0)]
    got = {r.node: (r.root, r.total) for r in network.path_sums(spark.createDataFrame(rows, "node long, parent long, v double"), "v").collect()}
    assert got == {i: (0, float(i.bit_length())) for i in range(256)} | {900: (999, 1.0), 901: (999, 2.0)}
    assert written[0] == len(rows) and all(b < a for a, b in zip(written, written[1:]))
    circle = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "node long, parent long, v double")
    with pytest.raises(RuntimeError):
        network.path_sums(circle, "v", 3)


def test_shuffles_grow_with_the_tables(spark, tmp_path, monkeypatch):
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(k, None) for k in keys]
    spark.range(5000).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(20).write.parquet(f"{tmp_path}/part.parquet")
    orders_ = catalog.query()(lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("id").count())
    catalog.QUERIES.pop("<lambda>")
    try:
        assert orders_(spark, str(tmp_path)).count() == 5000 and [spark.conf.get(k, None) for k in keys] == before
        monkeypatch.setattr(tables, "PER_PARTITION", 1000)
        assert orders_(spark, str(tmp_path)).count() == 5000 and int(spark.conf.get(keys[0])) > 20
        spark.conf.set(keys[0], "900")
        orders_(spark, str(tmp_path))
        assert spark.conf.get(keys[0]) == "900"
    finally:
        for k, v in zip(keys, before):
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_turn_bans(spark):
    edges = spark.createDataFrame([(1, 10, 100, 200), (2, 20, 200, 300), (3, 30, 200, 400), (4, 40, 200, 500), (5, 50, 600, 200), (6, 50, 200, 700)], "edge long, way_id long, u long, v long")
    rules = spark.createDataFrame([(1, "no_left_turn", 10, 200, 20), (2, "only_straight_on", 20, 200, 30), (3, "no_u_turn", 50, 200, 10)], "id long, kind string, from_way long, via long, to_way long")
    got = {tuple(r) for r in network.turn_bans(rules, edges).collect()}
    assert got == {(200, 1, 2), (200, 2, 1), (200, 2, 4), (200, 2, 5), (200, 2, 6)}  # way 50 comes in by two edges: refused


def test_turn_bans_by_rule(spark):
    """The same as from a table of all restrictions, also where ways share an id or pass a node twice; and no ban is shuffled."""
    import random

    rng = random.Random(5)
    edges, refs = [], []
    for way in range(160):
        nodes = [rng.randrange(9) for _ in range(rng.randrange(2, 5))]
        refs += [(way, n) for n in nodes]
        edges += [(way * 10 + k, way, u, v) for k, (u, v) in enumerate(zip(nodes, nodes[1:]))]
    edges, refs = spark.createDataFrame(edges, "edge long, way_id long, u long, v long"), spark.createDataFrame(refs, "way_id long, node_id long")
    for ids in (1000, 56, 12):
        other = refs.selectExpr("way_id AS b", "node_id")
        pairs = refs.join(other, "node_id").where("way_id <> b AND (way_id * 31 + b * 17) % 7 = 0")
        kind = "CASE (way_id + b) % 4 WHEN 0 THEN 'only_straight_on' WHEN 1 THEN 'no_left_turn' ELSE 'no_u_turn' END AS kind"
        rules = pairs.selectExpr(f"struct(way_id * 1000 + b % {ids} AS id, node_id AS via) AS id", kind, "way_id AS from_way", "node_id AS via", "b AS to_way")
        expect = sorted(tuple(r) for r in network.turn_bans(rules, edges).collect())
        got = network.turn_bans_by_rule(refs, edges, 7, 4, ids)
        assert sorted(tuple(r) for r in got.collect()) == expect and expect
    from viamark.plans import q_routing

    plan = q_routing.j14_turn_bans(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("SortMergeJoin") < plan.index("Exchange")


def test_controls(spark):
    refs = spark.createDataFrame([(1, n, n * 10) for n in range(1, 6)], "way_id long, n long, node_id long")
    signs = spark.createDataFrame([(10, "signal", ""), (30, "stop", "forward"), (40, "giveway", "backward"), (50, "signal", "forward")], "node_id long, kind string, direction string")
    got = network.controls(refs, signs, spark.createDataFrame([(50, 2)], "node_id long, uses long"), spark.createDataFrame([(1, 1, 1, 5)], "way_id long, seq long, first long, last long")).first()
    assert (got.n_signal_fwd, got.n_signal_rev, got.n_stop_fwd, got.n_stop_rev, got.n_giveway_fwd, got.n_giveway_rev) == (1, 1, 1, 0, 0, 1)


def test_searches_go_on_until_all_is_found(spark):
    from viamark.operators import spatial

    tree = spark.createDataFrame([(1, k, k - 1 if k else None) for k in range(50)] + [(2, 5, None)], "trip long, node long, pred long")
    ends = spark.createDataFrame([(1, 49), (2, 5), (3, 1)], "trip long, node long")
    assert sorted(tuple(r) for r in routing.path(tree, ends).collect()) == [(1, b, 48 - b, 49 - b) for b in range(49)]
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 90.0, 0.0)], "pid long, x double, y double")
    segs = spark.createDataFrame([(7, 100.0, 0.0, 110.0, 0.0)], "id long, ax double, ay double, bx double, by double")
    assert spatial.nearest_any(points, segs, "id", 0.5).count() == 2
    assert spatial.nearest_any(points, segs.limit(0), "id", 20.0).count() == 0


def test_many_features_are_narrowed_cell_by_cell(spark):
    rng = np.random.default_rng(5)
    at = [(k, *p) for k, p in enumerate(rng.uniform(-20, 220, (150, 2)).tolist())]
    lines = [(k % 500, *a, *(np.array(a) + d).tolist()) for k, (a, d) in enumerate(zip(rng.uniform(0, 200, (900, 2)).tolist(), rng.normal(0, 6, (900, 2)) * (rng.random((900, 1)) < 0.5)))]
    lines += [(k + 500, *row[1:]) for k, row in enumerate(lines[:100])]
    points = spark.createDataFrame(at, "pid long, x double, y double")
    segs = spark.createDataFrame(lines, "id long, ax double, ay double, bx double, by double")

    def away(x, y, ax, ay, bx, by):
        dx, dy = bx - ax, by - ay
        t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        return np.hypot(x - ax - t * dx, y - ay - t * dy)

    def best(d, rows):
        found = {p: min((away(x, y, *row[1:]), row[0]) for row in rows) for p, x, y in at}
        return {p: m for p, m in found.items() if m[0] <= d}

    want = best(15.0, lines)
    assert spatial._halvings(segs, 40.0, 1) >= 2
    cut, size = spatial._fine(segs.withColumn("reach", F.lit(15.0)), 15.0, 40.0, [])
    held = cut.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n")).first()[0]
    copied = spatial._boxed(segs.withColumn("reach", F.lit(15.0)), size).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n")).first()[0]
    assert size <= 10 and held < copied * 2 / 3
    got = {r.pid: r.dist for r in spatial.least_distance(points, segs, "id", 15.0, 40.0).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p][0]) < 1e-9 for p in got)
    near = {r.pid: r.id for r in spatial.nearest_any(points, segs, "id", 40.0).collect()}
    assert near == {p: m[1] for p, m in best(1e9, lines).items()}
    rings = [(k, [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]) for k, ((x, y), w) in enumerate(zip(rng.uniform(0, 180, (20, 2)).tolist(), rng.uniform(3, 60, 20).tolist()))]
    areas = spark.createDataFrame(rings, "id long, geom array<struct<x: double, y: double>>")
    layers = {"line": (segs.where("id % 9 > 0"), 15.0), "few": (segs.where("id % 9 = 0"), 30.0), "area": (spatial.outlines(areas, "id"), 5.0)}
    out = {r.pid: r for r in spatial.distances(points, layers, {"area": areas}, "id", 40.0).collect()}
    line, few = best(15.0, [x for x in lines if x[0] % 9]), best(30.0, [x for x in lines if x[0] % 9 == 0])
    for p, x, y in at:
        row = out.get(p)
        box = min(np.hypot(max(g[0][0] - x, x - g[2][0], 0), max(g[0][1] - y, y - g[2][1], 0)) for _, g in rings)
        for name, d in (("line", line.get(p, (None,))[0]), ("few", few.get(p, (None,))[0]), ("area", box if box <= 5 else None)):
            have = row and row[f"d_{name}"]
            assert have is None if d is None else abs(have - d) < 1e-9, (p, name)


def test_edges_and_lines_that_lie_alike_are_joined_once(spark):
    from viamark.operators import studies

    lines = [(k * 10 + i, i % 4, i % 4 + 1, float(x), 0.0, float(x + 50), float(y), float(30 * i)) for i, (x, y) in enumerate([(0, 5), (40, 0), (60, 9)]) for k in range(20, 0, -1)]
    segs = spark.createDataFrame(lines, "edge long, u long, v long, ax double, ay double, bx double, by double, bearing double")
    assert spatial.alike(segs.select("edge", "ax", "ay", "bx", "by"), "edge").count() == 3
    at = spark.createDataFrame([(1, 20.0, 3.0, 10.0), (2, 70.0, 2.0, 40.0)], "pid long, x double, y double, heading double")
    once = segs.where("edge < 20")
    got = routing.snap_heading(at, segs, 100.0)
    assert sorted(got.collect()) == sorted(routing.snap_heading(at, once, 100.0).collect()) and {r.edge for r in got.collect()} <= {10, 11, 12}
    samples = at.withColumnRenamed("heading", "bearing")
    same = lambda t: sorted(studies.same_way(samples, t.drop("u", "v"), "edge", 30.0, 40.0).collect())
    assert same(segs) == same(once) and len(same(once)) == 2


def test_polygon_flags_over_many_layers_of_polygons(spark, monkeypatch):
    """Polygons that lie over one another give flags, not a row for each pair of a point and a polygon."""
    from viamark.functions import geometry as g
    from viamark.operators import regions

    rng = np.random.default_rng(14)
    rings = [(k, *(float(v) for v in rng.integers(0, 30, 2) * 20), float(rng.integers(1, 12) * 10), k % 3) for k in range(80)]
    pts = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.random((200, 2)) * 700)]
    pts += [(200 + k, *pts[k][1:]) for k in range(50)] + [(300 + k, r[1], r[2]) for k, r in enumerate(rings[:20])]
    df = spark.createDataFrame(pts, "pid long, x double, y double")
    big = spark.createDataFrame(rings, "id long, x double, y double, side double, class int")
    big = big.withColumn("geom", g.square(F.col("x"), F.col("y"), F.col("side")))
    monkeypatch.setattr(regions, "containing", None)  # pairs of points and polygons
    got = {r.pid: tuple(r)[1:] for r in regions.polygon_flags(df, big, {"a": F.col("class") == 0, "none": F.col("class") > 5, "b": F.col("class") >= 1}, 15.0, 100.0).collect()}

    def flags(x, y, chosen):
        inside = [abs(x - qx) <= s / 2 and abs(y - qy) <= s / 2 and x < qx + s / 2 and y < qy + s / 2 for _, qx, qy, s, c in rings if c in chosen]
        near = [np.hypot(max(abs(x - qx) - s / 2, 0), max(abs(y - qy) - s / 2, 0)) <= 15 for _, qx, qy, s, c in rings if c in chosen]
        return any(inside), any(near)

    assert got == {p: (*flags(x, y, {0}), False, False, *flags(x, y, {1, 2})) for p, x, y in pts} and len(got) == len(pts)
