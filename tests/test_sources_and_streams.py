import json
import uuid

import pytest
from pyspark.sql import functions as F

from viamark.operators import checks, raster, trips
from viamark.sources import files
from viamark.streaming import live


def test_truncated_trace(spark, tmp_path):
    lines = [json.dumps({"t": "fix", "ts": float(i), "lat": 42.0, "lon": -71.0}) for i in range(3)] + ['{"t": "fix", "ts": 3.0, "la']
    (tmp_path / "d1.ndjson").write_text("\n".join(lines))
    df = files.read_traces(spark, str(tmp_path))
    assert files.records(df, "fix").count() == 3
    r = files.unreadable(df.cache()).first()
    assert (r.drive, r.unreadable, r.records) == ("d1.ndjson", 1, 3)


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, 1.5)], "i int, s string, x double")
    files.write_measurements(df, str(tmp_path / "m"))
    assert sorted(files.read_measurements(spark, str(tmp_path / "m"), "i int, s string, x double").collect()) == sorted(df.collect())


def test_features(spark, tmp_path):
    doc = {"features": [
        {"properties": {"cls": "VI"}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [3, 4]]}},
        {"properties": {"cls": "V"}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2]], [[5, 5], [6, 6]]]}},
        {"properties": {"cls": "I"}, "geometry": None},
    ]}
    (tmp_path / "f.json").write_text(json.dumps(doc))
    got = files.read_features(spark, str(tmp_path / "f.json"), "cls:string").collect()
    assert sorted((r.cls, len(r.geom)) for r in got) == [("V", 2), ("V", 2), ("VI", 2)]


def test_snapshots_parts_and_export(spark):
    paths = spark.createDataFrame([("/x/nh_2026-01-02.parquet",), ("/x/nh_2026-03-01.parquet",), ("/x/vt_2025-01-01.parquet",), ("/x/readme",)], "path string")
    assert {r.layer: r.path for r in files.latest_snapshot(paths).collect()} == {"nh": "/x/nh_2026-03-01.parquet", "vt": "/x/vt_2025-01-01.parquet"}
    a, b = spark.createDataFrame([(1, 2.0)], "u long, s double"), spark.createDataFrame([(3, "x")], "u int, extra string")
    assert sorted(map(tuple, files.append_parts(a, b).collect()), key=str) == [(1, 2.0), (3, None)]
    f = spark.createDataFrame([("motorway", 1.0), ("tertiary", 4.2), ("tertiary", 5.5), ("tertiary", 3.0)], "highway string, score double")
    assert files.export_filter(f, ("motorway",), 10).count() == 3 and files.export_filter(f, ("motorway",), 2).count() == 2


def test_streams_equal_batch(spark, tmp_path):
    rows = [("a", f"2026-01-01 00:00:{s:02d}", 0.2, 10.0, 1) for s in range(0, 30, 5)] + [("a", "2026-01-01 00:03:00", 0.1, 90.0, None), ("a", "2026-01-01 00:03:10", 0.1, 10.0, 1), ("b", "2026-01-01 00:00:05", 9.0, 10.0, 1)]
    df = spark.createDataFrame(rows, "drive string, t string, speed double, off double, x int").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    for name, work in (("stops", live.live_stops), ("counters", live.live_counters)):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        live.run_available(work(stream), str(tmp_path / name), str(tmp_path / f"{name}-cp"))
        got, batch = spark.read.parquet(str(tmp_path / name)), work(df)
        assert batch.count() > 0 and got.exceptAll(batch).isEmpty()  # what the watermark has closed


def test_a_stream_that_is_started_again_gives_what_a_batch_gives(spark):
    import random

    rng = random.Random(3)
    rows = [(f"d{k % 4}", f"2026-02-{1 + k // 40:02d} {rng.randrange(24):02d}:{rng.randrange(60):02d}:{rng.randrange(60):02d}", rng.random() * 1.5, rng.random() * 120, k if k % 9 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "drive string, t string, speed double, off double, x int").withColumn("ts", F.to_timestamp("t")).drop("t")
    for work in (lambda s: live.live_stops(s, "3 hours", "6 hours", 1.0, 60.0, 3600.0), lambda s: live.live_counters(s, "1 hour", "3 hours")):
        got, late = live.replayed(df, work, stops=3)
        batch = work(df)
        assert late == 0 and got.count() == batch.count() > 20 and got.exceptAll(batch).isEmpty() and batch.exceptAll(got).isEmpty()


def test_late_rows_are_counted(spark, tmp_path):
    part = lambda day: spark.createDataFrame([("a", f"2026-03-{day:02d} 00:00:{s:02d}", 0.2, 10.0, 1) for s in range(0, 30, 5)], "drive string, t string, speed double, off double, x int").withColumn("ts", F.to_timestamp("t")).drop("t")
    late = [live._arrive(part(day), live.live_counters, str(tmp_path)) for day in (10, 12, 1)]
    assert late[:2] == [0, 0] and late[2] > 0


def test_menu_against_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = [(t, o, float(rng.randint(1, 60)), rng.randint(1, 4000) / 100) for t in range(30) for o in range(rng.randint(1, 25))]
    front = trips.frontier(spark.createDataFrame(rows, "trip long, option long, extra double, gain double"))
    got = {r.trip: [o.option for o in r.options] for r in trips.menu(front).collect()}
    for t in range(30):
        best, f = -1.0, []
        for _, o, x, g in sorted((r for r in rows if r[0] == t), key=lambda r: (r[2], -r[3], r[1])):
            if g > best:
                f.append((o, g))
                best = g
        step, kept = max(1.609, 0.05 * f[-1][1]), []
        for o, g in f:
            if g >= (kept[-1][1] + step if kept else 0.805):
                kept.append((o, g))
        if not kept or kept[-1][0] != f[-1][0]:
            kept.append(f[-1])
        assert got[t] == [o for o, _ in kept]


def test_reuse_and_guards(spark):
    df, built = spark.range(10), []

    def build():
        built.append(1)
        return df.withColumn("d", F.col("id") * 2)

    run = uuid.uuid4().hex  # the folder outlives a session
    a = checks.reused("t", [df], {"distance": 120, "run": run}, build)
    checks.reused("t", [df.repartition(3)], {"distance": 120, "run": run}, build)  # another order, the same content
    checks.reused("t", [df], {"distance": 150, "run": run}, build)
    assert a.count() == 10 and len(built) == 2
    with pytest.raises(ValueError):
        checks.require_empty(checks.matches(spark.range(12), df, ["id"]), "edges of another graph")
    with pytest.raises(ValueError):
        checks.complete(df, "id", 11)


def test_raster_helpers(spark):
    df = spark.createDataFrame([(0, 0, 0, 128, 10, 0), (1, 2, 255, 0, 0, 0)], "tx int, ty int, c int, r int, g int, b int")
    assert [x.z for x in df.select(raster.terrarium(F.lit(128), F.col("g"), F.col("b")).alias("z")).collect()] == [10.0, 0.0]
    assert [raster.window_px(m, 30.0) for m in (10, 750, 3000)] == [3, 25, 101]
    tiles = spark.range(1).select(raster.tiles_of_box(F.lit(-73.1), F.lit(41.0), F.lit(-69.5), F.lit(42.5))).first()[0]
    assert {tuple(t) for t in tiles} == {(39, -75), (39, -72), (42, -75), (42, -72)}
