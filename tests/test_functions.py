import numpy as np
import pytest
from pyspark.sql import functions as F

from viamark.functions import calendar as cal
from viamark.functions import geometry as g
from viamark.functions import tags


def windows(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, v string")
    r = cal.conditional_windows(df, "id", "v").first()
    return ([tuple(w) for w in r.windows], r.refused) if r else ([], [])


@pytest.mark.parametrize(
    "text, expect",
    [
        ("no @ (Dec-Mar)", ([(12, 1, 3, 31)], [])),
        ("no @ (Oct 5-Jun 20)", ([(10, 5, 6, 20)], [])),
        ("no @ (Jan-Feb; Sept.-Oct)", ([(1, 1, 2, 29), (9, 1, 10, 31)], [])),
        ("no @ Nov 3rd - Apr 22nd", ([(11, 3, 4, 22)], [])),
        ("no @ (20 Oct - 7 Mai)", ([(10, 20, 5, 7)], [])),
        ("no @ (9 June)", ([(6, 9, 6, 9)], [])),
        ("no @ (Feb 2-28)", ([(2, 2, 2, 28)], [])),
        ("no @ (March-12)", ([(3, 1, 3, 12)], [])),
        ("no @ (April 4-July)", ([(4, 4, 7, 31)], [])),
        ("no @ snow", ([cal.WINTER], [])),
        ("no @ (width>=2 and winter)", ([], ["vehicle"])),
        ("no @ (2031 Jan 01-Feb 10)", ([], ["dated"])),
        ("no @ Jul-Aug Sa 10:00-18:00", ([], ["part-time"])),
        ("no @ (dusk-dawn)", ([], ["time of day"])),
        ("no @ (wet)", ([], ["unrecognized"])),
        ("no @ (Apr 31-May 2)", ([], ["unrecognized"])),
        ("no @ (Nov15-Dec)", ([], ["unrecognized"])),
        ("customers @ (Jan-Mar)", ([], [])),
        ("yes @ (Jun 10-Sep 30, dawn-dusk)", ([(10, 1, 6, 9)], [])),
        ("yes @ (Sa-Su 08:00-20:00)", ([], [])),
        ("no @ (Mar; 06:00-07:30); yes @ (May-Nov)", ([(3, 1, 3, 31), (12, 1, 4, 30)], ["time of day"])),
    ],
)
def test_conditional_windows(spark, text, expect):
    assert windows(spark, text) == expect


def test_widen_and_complement(spark):
    w = lambda *x: F.array(*[cal.window(*y) for y in x])
    one = lambda c: [tuple(x) for x in spark.range(1).select(c.alias("c")).first().c]
    assert one(cal.widen(w((11, 1, 4, 30)), 0, 15)) == [(11, 1, 5, 15)]
    assert one(cal.widen(w((1, 5, 1, 10), (1, 20, 2, 1)), 5, 5)) == [(12, 31, 2, 6)]
    assert one(cal.widen(w((2, 1, 1, 20)), 10, 10)) == [(1, 1, 12, 31)]
    assert one(cal.complement(w((4, 2, 9, 17)))) == [(9, 18, 4, 1)]
    assert one(cal.complement(w((1, 1, 12, 31)))) == []
    inside = spark.range(1).select(cal.in_window(cal.window(11, 1, 4, 30), F.lit(1), F.lit(15)), cal.in_window(cal.window(11, 1, 4, 30), F.lit(6), F.lit(1))).first()
    assert tuple(inside) == (True, False)


@pytest.mark.parametrize(
    "a, b, exact, same",
    [
        ("Quarry Ln", "QUARRY LANE", False, True), ("Mt Alder", "Mount Alder", False, True), ("Harbor View Drive", "Old Harbor View Dr", False, True),
        ("Harbor View Drive", "Old Harbor View Dr", True, False), ("Route 77", "Long Route 77 Loop", False, False), ("Route 77", "RTE 77", True, True),
        ("East Street", "E ST", False, True), ("East Street", "West Street", False, False), ("The Road", "Massachusetts Road", False, False),
        ("New Hampshire", "New Hampshire", False, False), ("", "Quarry Ln", False, False), ("Elm Court", "Oak Court", False, False),
    ],
)
def test_same_name(spark, a, b, exact, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(tags.same_name(F.array("a"), F.array("b"), exact)).first()[0] == same


def test_barriers(spark):
    rows = [
        ({"ford": "yes"}, {"highway": "primary"}, None), ({"ford": "yes"}, {"highway": "tertiary"}, "ford=yes"), ({"ford": "yes"}, None, "ford=yes"),
        ({"ford": "yes", "surface": "gravel"}, {"highway": "primary"}, "ford=yes"), ({"barrier": "gate"}, {}, None),
        ({"barrier": "gate", "locked": "yes"}, {}, "barrier=gate, locked=yes"), ({"barrier": "gate", "access": "Private "}, {}, "barrier=gate, access=private"),
        ({"barrier": "bollard"}, {}, "barrier=bollard"), ({"barrier": "bollard", "motor_vehicle": "yes", "access": "no"}, {}, None),
        ({"barrier": "bollard", "access": "no"}, {}, "barrier=bollard, access=no"), ({"barrier": "toll_booth", "name": "Bald Hill Checkpoint"}, {}, "barrier=toll_booth, logging checkpoint"), ({}, {}, None),
    ]
    df = spark.createDataFrame([(i, n, w) for i, (n, w, _) in enumerate(rows)], "i int, node map<string,string>, way map<string,string>")
    got = {r.i: r.why for r in df.select("i", tags.barrier_closes("node", "way", ("gravel", "dirt")).alias("why")).collect()}
    assert got == {i: why for i, (_, _, why) in enumerate(rows)}


def test_speed_and_surface(spark):
    rows = [({"maxspeed": "55 mph"}, 88.5137), ({"maxspeed": "50"}, 50.0), ({"maxspeed": "none", "highway": "residential"}, 40.0), ({"maxspeed": "0", "highway": "trunk"}, 64.0), ({"highway": "path"}, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, tags map<string,string>")
    got = {r.i: r.v for r in df.select("i", tags.maxspeed_kmh("tags").alias("v")).collect()}
    assert all(got[i] is None if v is None else abs(got[i] - v) < 1e-6 for i, (_, v) in enumerate(rows))
    df = spark.createDataFrame([({"4wd_only": "yes", "smoothness": "horrible"}, {"tiger:cfcc": "A51;A53"}), ({"smoothness": "horrible", "highway": "trunk"}, {"tiger:cfcc": "A51;A41"})], "a map<string,string>, b map<string,string>")
    assert [(r.x, r.y) for r in df.select(tags.too_rough("a").alias("x"), tags.tiger_unpaved("b").alias("y")).collect()] == [(["4wd_only=yes", "smoothness=horrible"], "tiger:cfcc=A51;A53"), ([], None)]


@pytest.mark.parametrize("label, bearing, expect", [("I 80", 200.0, "West"), ("US 9", 170.0, "South"), ("US 9", 95.0, "South"), ("I 684", 88.0, "East"), ("NY 17K", 275.0, "West"), ("US 44 Business", 12.0, "East"), ("CR 7 Loop", 12.0, ""), ("Elm Court", 10.0, "")])
def test_signed_direction(spark, label, bearing, expect):
    assert spark.range(1).select(tags.signed_direction(F.lit(label), F.lit(bearing))).first()[0] == expect


def test_geometry(spark):
    line = F.array(*[g.point(x, y) for x, y in ((0, 0), (100, 0), (100, 50))])
    ring = F.array(*[g.point(x, y) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10))])
    r = spark.range(1).select(
        g.length(line).alias("length"), g.point_at(line, F.lit(120.0)).alias("at"), g.project(g.point(90, 10), line).alias("p"), g.ring_area(ring).alias("area"),
        g.inside(g.point(5, 5), ring).alias("inside"), g.inside(g.point(15, 5), ring).alias("outside"), g.turn(F.lit(350.0), F.lit(10.0)).alias("turn"),
        g.folded(F.lit(10.0), F.lit(185.0)).alias("folded"), g.modifier(F.lit(-30.0)).alias("mod"), g.octant(F.lit(350.0)).alias("oct"),
        g.curvature(g.located(line), F.lit(150.0), F.lit(150.0)).alias("curve"), F.size(g.stitch(F.array(line, F.reverse(line)))).alias("stitched"),
    ).first()
    assert (r.length, tuple(r.at), tuple(r.p), r.area, r.inside, r.outside, r.turn, r.folded, r.mod, r.oct) == (150.0, (100.0, 20.0), (10.0, 90.0), 100.0, True, False, 20.0, 5.0, "slight left", "north")
    assert abs(r.curve - 50 / 0.3) < 1e-6 and r.stitched == 5  # two capped turns of 25 degrees over the floor of 300 m


def test_curvature_of_pieces(spark):
    """Pieces of one road differ: a straight one has none, one with a corner has; its own length counts, as the road is long."""
    line = F.array(*[g.point(x, y) for x, y in ((0, 0), (400, 0), (400, 60), (800, 60))])
    at = lambda start: g.curvature(g.located(line), F.lit(200.0), F.lit(860.0), F.lit(float(start))).alias(f"p{start}")
    r = spark.range(1).select(at(0), at(300), at(500)).first()
    # From 300 m: 60 m on, then 40 m and up, up and 20 m on, and the last 20 m.
    first, second = np.degrees(np.arctan2(20, 40)), np.degrees(np.arctan2(40, 20))
    turns = [first, second - first, second]
    assert r.p0 == 0 and r.p500 == 0 and abs(r.p300 - sum(min(25.0, t) for t in turns) / 0.2) < 1e-6


def test_lambert_keeps_short_distances(spark):
    x, y = g.lambert(F.col("lon"), F.col("lat"), 41.0, 45.0, 42.0, -71.0)
    a, b = spark.createDataFrame([(-71.0, 42.0), (-71.0, 42.1)], "lon double, lat double").select(x.alias("x"), y.alias("y")).collect()
    assert abs(a.x) < 1e-6 and abs(a.y) < 1e-6 and abs(b.y - a.y - 11119.5) < 40
