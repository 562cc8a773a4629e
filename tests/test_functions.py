import math

import numpy as np

import pytest
from pyspark.sql import functions as F

from vistaframe.functions import geo, sky, text
from vistaframe.operators import panorama, search
from vistaframe.streaming import fusion, sensors

A, B = (47.0566, 8.4851), (46.979, 8.2552)


def one(spark, **columns):
    return spark.range(1).select(*[(c if not isinstance(c, (int, float, str)) else F.lit(c)).alias(k) for k, c in columns.items()]).first()


def test_geodesy(spark):
    r = one(spark, d=geo.distance_m(*A, *B), b=geo.bearing_deg(*A, *B), drop=geo.curvature_drop(100_000.0), near=geo.curvature_drop(3300.0), flat=geo.elevation_angle(1000, 1000, 1000), far=geo.elevation_angle(1000, 1000, 100_000), up=geo.elevation_angle(0, 1000, 1000), x=geo.delta_deg(10, 350), y=geo.delta_deg(350, 10))
    assert abs(r.d / 1000 - 19.3) < 0.5 and 240 < r.b < 250 and abs(r.drop - 682.9) < 0.5 and abs(r.near - 0.74) < 0.01
    assert abs(r.flat) < 0.01 and r.far < -0.38 and abs(r.up - 45) < 0.05 and (r.x, r.y) == (20, -20)
    lat, lon = geo.destination(*A, 123.4, 87_000)
    back = one(spark, d=geo.distance_m(F.lit(A[0]), F.lit(A[1]), lat, lon), b=geo.bearing_deg(F.lit(A[0]), F.lit(A[1]), lat, lon))
    assert abs(back.d - 87_000) < 5 and abs(back.b - 123.4) < 0.05


def test_mercator_and_tiles(spark):
    x, y = geo.lonlat_to_pixel(0.0, 0.0, 0)
    u, v = geo.lonlat_to_pixel(*A, 10)
    r = one(spark, x=x, y=y, u=u, v=v, c=geo.tile_corners(10, 536, 359), t=geo.tiles_for(*A, 100_000))
    assert (r.x, r.y) == (128, 128) and (int(r.u // 256), int(r.v // 256)) == (536, 359)
    assert r.c[2].lat < A[0] < r.c[0].lat and r.c[0].lon < A[1] < r.c[2].lon
    assert (r.t[0].lat, r.t[0].lon, r.t[0].dist) == (47, 8, 0) and 6 <= len(r.t) <= 12
    assert [t.dist for t in r.t] == sorted(t.dist for t in r.t) and max(t.dist for t in r.t) <= 100_000


def test_projection(spark):
    cam = dict(heading=90, pitch=0, roll=0, hfov=90, width=1000, height=500)
    p = lambda az, alt, **k: one(spark, p=geo.project(az, alt, **{**cam, **k})).p
    assert (round(p(90, 0).x), round(p(90, 0).y)) == (500, 250) and round(p(135, 0).x) == 1000 and p(270, 0) is None
    assert p(120, 0, roll=10).x > 500 and p(120, 0, roll=10).y > 250 and p(90, 0, pitch=10).y > 250
    d = one(spark, d=geo.screen_to_dir(700.0, 100.0, 90, 5, 7, 60, 1000, 500)).d
    q = one(spark, p=geo.project(d.az, d.alt, 90, 5, 7, 60, 1000, 500)).p
    assert abs(q.x - 700) < 1e-6 and abs(q.y - 100) < 1e-6
    f = geo.fov_long_from_display(geo.display_hfov(60, 1920, 1080, 390, 844), 1920, 1080, 390, 844)
    assert abs(one(spark, f=f).f - 60) < 1e-9


@pytest.mark.parametrize("raw,query,dataset", [("1797", 1797, 1797), ("2'502", 2502, 2502), ("2106 m", 2106, 2106), ("4478,5", 4478.5, 4479), ("1000 ft", 304.8, 305), ("unknown", None, None), (None, None, None), ("-12", -12, -12), ("9000", None, None), ("100'", 30.48, 100), ("1234;1236", 1234, 1234)])
def test_elevations(spark, raw, query, dataset):
    r = one(spark, q=text.parse_ele(F.lit(raw).cast("string")), d=text.parse_ele(F.lit(raw).cast("string"), dataset=True))
    assert r.q == (query if query is None else pytest.approx(query)) and r.d == dataset


def test_towers(spark):
    h = lambda s: one(spark, h=text.parse_height(F.lit(s))).h
    assert [h("187"), h("45 m"), h("150 ft"), h("hoch"), h("2"), h("700")] == [187, 45, 46, None, None, None]
    k = lambda m, t, v: one(spark, k=text.classify_landmark(F.lit(m), F.lit(t).cast("string"), F.lit(v).cast("int"))).k
    assert [k("tower", "communication", 187), k("tower", "bell_tower", None), k("tower", None, None), k("mast", None, 12), k("chimney", None, 120), k(None, None, 99), k("tower", None, 25)] == ["c", "b", None, None, "h", None, "w"]


def test_search(spark):
    rows = [(1, ["Matterhorn", "Cervin", "Cervino"], 80, False, 4478.0), (2, ["Kleines Matterhorn"], 10, False, 3883.0), (3, ["Mönch"], 40, False, 4107.0), (4, ["Piz Mönchalp"], 0, False, 2900.0), (5, ["Grosser Mythen"], 20, False, 1898.0)]
    peaks = spark.createDataFrame(rows, "id long, names array<string>, fame long, visible boolean, ele double")
    asked = spark.createDataFrame([(1, "MONCH"), (2, " matterhorn"), (3, "myth"), (4, "cerv"), (5, "  ")], "q_id long, q string")
    found: dict = {}
    for x in search.search_peaks(peaks, asked).orderBy("q_id", "rank").collect():
        found.setdefault(x.q_id, []).append(x.id)
    assert found == {1: [3, 4], 2: [1, 2], 3: [5], 4: [1]}
    objects = spark.createDataFrame([("s1", "Mond", "moon", None), ("s2", "Mondstern", "star", 3.0)], "id string, name string, kind string, mag double")
    both = search.search_all(peaks, objects, spark.createDataFrame([(1, "mon")], "q_id long, q string")).orderBy("rank").collect()
    assert [x.id for x in both] == ["s1", "3", "s2", "4"]


def jd(text):
    import datetime as dt

    return dt.datetime.fromisoformat(text + "+00:00").timestamp() / 86400 + 2440587.5


def at(spark, moment, lat=0.0, lon=0.0, **more):
    return spark.createDataFrame([(jd(moment), lat, lon, *more.values())], ["jd", "lat", "lon", *more])


def test_sun_and_moon(spark):
    from vistaframe.functions.steps import apply

    s = apply(at(spark, "1992-10-13T00:00:00"), sky.SUN_STEPS).first()
    assert abs(s.ra - 198.381) < 0.05 and abs(s["dec"] + 7.785) < 0.05
    m = apply(at(spark, "1992-04-12T00:00:00"), sky.MOON_STEPS).first()
    assert abs(m.moon_lon - 133.163) < 0.05 and abs(m.moon_lat + 3.229) < 0.05 and abs(m.moon_dist - 368_410) < 500
    for moment, lat, lon in (("2024-04-08T18:17:16", 25.29, -104.14), ("2017-08-21T18:25:32", 36.97, -87.67), ("2026-08-12T17:46:00", 65.2, -25.2)):
        a, b = sky.sun_position(at(spark, moment, lat, lon)).first(), sky.moon_position(at(spark, moment, lat, lon)).first()
        assert math.hypot((a.az - b.az) * math.cos(math.radians(a.alt)), a.alt - b.alt) < 0.25 and b.fraction < 0.01
    assert sky.moon_position(at(spark, "2024-01-25T17:54:00")).first().fraction > 0.99
    quarter = sky.moon_position(at(spark, "2024-01-18T03:53:00")).first()
    assert abs(quarter.fraction - 0.5) < 0.05 and quarter.waxing


def test_planets_and_stars(spark):
    def planet(name, moment):
        return at(spark, moment, planet=name).select(sky.planet_equatorial("planet", "jd").alias("p")).first().p

    j, s = planet("jupiter", "2020-12-21T18:00:00"), planet("saturn", "2020-12-21T18:00:00")
    assert math.hypot((j.ra - s.ra) * math.cos(math.radians(j.dec)), j.dec - s.dec) < 0.2
    assert planet("mars", "2020-10-13T23:00:00").mag < -2.3
    # Sirius culminates at 90 - 47.37 - 16.72 degrees
    day = spark.range(0, 1440, 4).selectExpr(f"{jd('2026-01-15T00:00:00')} + id / 1440 AS jd", "47.37D AS lat", "8.54D AS lon", "101.287D AS ra2000", "-16.716D AS dec2000")
    assert abs(sky.star_position(day.withColumn("jd", F.col("jd").cast("double"))).agg(F.max("alt")).first()[0] - 25.91) < 0.5


def ridges(d, a):
    d, a = np.array(d, float), np.array(a, float)
    return [(a[i], d[i]) for i in panorama._ridges(d, a)]


def test_ridges():
    d = [500, 1000, 1500, 2000, 3000, 4000, 6000, 8000, 10000, 12000, 15000]
    assert ridges(d, [1, 2, 3, 4, 2, 1, 2, 4.5, 6, 3, 2]) == [(4, 2000), (6, 10000)]
    assert ridges([1000, 1100, 1200, 1300, 5000], [1, 1.2, 1.1, 1.3, 0.5]) == [(1.3, 1300)]
    assert ridges([1, 2, 3], [1, 2, 3]) == []


def test_ridge_lines(spark):
    def lines(points, n):
        df = spark.createDataFrame([(1, b, float(a), float(d)) for b, a, d in points], "obs_id long, az_bin int, angle double, dist double")
        return sorted(x["count"] for x in panorama.link_ridges(df, n).groupBy("line_id").count().collect())

    assert lines([(0, 1, 10000), (1, 1, 10200), (1, 3, 50000), (2, 1, 10300), (2, 3, 51000), (3, 1, 30000)], 4) == [1, 2, 3]
    assert lines([(b, 1, 10000) for b in range(4)], 4) == [4]
    assert lines([(b, 1, 8000) for b in (0, 1, 3, 4, 8)], 12) == [1, 4]


def test_rays_over_a_ridge(spark):
    def terrain(lat, lon):
        import numpy as np

        return np.where(np.abs(lat - (46 + 5000 / 111195)) < 0.002, 1500.0, 500.0)

    obs = spark.createDataFrame([(2**53 + 1, 46.0, 8.0, 20000.0, 502.0), (None, 46.0, 8.0, 10.0, 502.0)], "obs_id long, lat double, lon double, radius double, h0 double")
    found = panorama.scanned_rays(obs.withColumn("az", F.lit(0.0)), terrain).collect()
    assert len(found) == 1 and found[0].obs_id == 2**53 + 1 and found[0].angle > 9 and abs(found[0].dist - found[0].ridges[0].d) < 1e-9
    assert len(found[0].ridges) == 1 and 4700 < found[0].ridges[0].d < 5300 and found[0].haze[0] == (found[0].angle, found[0].dist)
    ring = {r.az_bin: r.angle for r in panorama.ring(obs, terrain, 90.0).collect()}
    assert sorted(ring) == [0, 1, 2, 3] and ring[0] == found[0].angle and max(ring[k] for k in (1, 2, 3)) < 0.1
    t = obs.where("obs_id IS NOT NULL").crossJoin(spark.createDataFrame([(1, 0.0, 15000.0), (2, 0.0, 4000.0), (3, 0.0, 200.0)], "target_id long, az double, dist double"))
    o = {x.target_id: x.occlusion for x in panorama.occlusion_angle(t, terrain).collect()}
    assert o[1] > 9 and o[2] < 0.1 and o[3] is None


def test_relief(spark):
    h = spark.createDataFrame([(1, b, 3 - abs(b / 10 - 10) if b < 200 else b / 10 - 17) for b in range(3600)], "obs_id long, az_bin int, angle double")
    t = spark.createDataFrame([(1, 10.0, 3.0, True), (1, 25.0, 8.0, True), (1, 10.0, 3.0, False)], "obs_id long, az double, angle double, visible boolean")
    got = sorted(round(x.relief, 6) for x in panorama.skyline_relief(t, h).collect())
    assert got == [0, 0, 1.5]


def test_ground_of_a_cone(spark):
    def cone(lat, lon):
        return 2000 - 0.5 * geo.distance_m(F.lit(46.0 + 30 / 111195), F.lit(8.0), lat, lon)

    o = spark.createDataFrame([(1, 46.0, 8.0)], "obs_id long, lat double, lon double")
    assert panorama.observer_ground(o, cone).first().ground > 1998
    assert abs(panorama.observer_ground(o, lambda a, b: 1000 + (a - 46) * 50_000).first().ground - 1000) < 1e-6


def test_smoothing_holds_a_noisy_heading():
    import random

    r, state, out, machine = random.Random(1), None, [], fusion.smoothing()
    for i in range(900):
        state, e = machine(state, {"t_ms": i * 1000 / 60, "heading": (90 + r.uniform(-2, 2)) % 360, "pitch": 0.0, "roll": 0.0})
        out.append(e["s_heading"])
    assert max(abs(x - 90) for x in out[600:]) < 0.3


def test_fused_headings_equal_a_plain_loop(spark):
    import math
    import random

    r = random.Random(5)
    rows = [(d, t, r.choice(["compass", "gyro", "gyro"]), r.uniform(0, 360)) for d in range(4) for t in sorted(r.sample(range(9000), 80))]
    got = {(x.device_id, x.t_ms): x.fused for x in fusion.heading_fusion(spark.createDataFrame(rows, "device_id long, t_ms long, kind string, heading double")).collect()}
    for d in range(4):
        offset, gyro, when = None, None, 0
        for _, t, kind, h in (x for x in rows if x[0] == d):
            if kind == "gyro":
                gyro = (h, t)
                want = None if offset is None else (h + offset) % 360
                assert (got[d, t] is None) == (want is None) and (want is None or abs((got[d, t] - want + 180) % 360 - 180) < 1e-9)
            elif gyro and t - gyro[1] <= 200:
                seen = (h - gyro[0] + 180) % 360 - 180
                step = 0 if offset is None else ((seen - offset + 180) % 360 - 180) * (1 - math.exp(-min(1, (t - when) / 1000) / 4))
                offset, when = (seen if offset is None else offset + step), t
    assert any(v is not None for v in got.values())


def test_orientation_routes(spark):
    e = [
        (0, "relative", 10.0, None), (100, "absolute", 50.0, None), (150, "relative", 12.0, None), (200, "absolute", 52.0, None),
        (220, "relative", 12.0, None), (300, "absolute", 52.0, None), (900, "absolute", 60.0, None), (5000, "relative", 20.0, None), (5100, "relative", 20.0, 90.0), (5200, "relative", None, None),
    ]
    rows = [(1, t, k, 0.0, h, 1.0, 2.0, c, 5.0, False) for t, k, h, c in e]
    df = spark.createDataFrame(rows, "device_id long, t_ms long, kind string, alpha double, heading double, pitch double, roll double, compass_heading double, accuracy double, held boolean")
    got = sorted((r.t_ms, r.route, r.out_heading) for r in fusion.orientation_route(df).collect())
    assert [g[1] for g in got] == ["relative", "absolute", None, None, "fused", None, "absolute", "relative", "compass", None]
    assert got[4][2] == pytest.approx(52.0) and got[8][2] == pytest.approx(110.0)


def test_posture_takes_what_was_learned(spark):
    e = [(0, "p|level", False), (1, "l|level", False), (2, "l|level", False), (3, "p|level", True), (4, "l|level", False), (30_100, "p|level", False), (30_200, "l|up", False)]
    events = spark.createDataFrame([(1, *x) for x in e], "device_id long, t_ms long, posture string, matched boolean")
    learned = spark.createDataFrame([(1, "l|level", 20.0, -30.0), (1, "p|level", 5.0, None)], "device_id long, posture string, heading double, pitch double")
    got = [(r.set_heading, r.set_pitch) for r in fusion.apply_posture(events, learned).orderBy("t_ms").collect()]
    assert got == [(5.0, None), (None, -20.0), (None, None), (None, None), (None, None), (5.0, None), (None, None)]


def test_replay_keeps_long_values_beside_nulls(spark):
    from vistaframe.streaming import machines

    big = [2**53 + 1, None, 2**53 + 3]
    df = spark.createDataFrame([(k, t, b, 30.0) for k in (2**53 + 1, 2**53 + 3) for t, b in enumerate(big)], "k long, t_ms long, n long, pitch double")
    got = sorted((r.k, r.t_ms, r.n, r.band) for r in machines.replay(df, "k", machines.pitch_band).collect())
    assert got == [(k, t, b, "up") for k in (2**53 + 1, 2**53 + 3) for t, b in enumerate(big)]


def test_stream_equals_table(spark, tmp_path):
    rows = [(d, t * 17, float((d * 40 + t * 3) % 360), float(t % 9), float(t % 4)) for d in range(3) for t in range(60)]
    df = spark.createDataFrame(rows, "device_id long, t_ms long, heading double, pitch double, roll double")
    want = {(x.device_id, x.t_ms): (x.heading, x.pitch, x.roll) for x in fusion.smooth_angles(df).collect()}
    for k in range(3):
        df.where(f"t_ms >= {k * 340} AND t_ms < {(k + 1) * 340}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = fusion.smooth_angles(stream, streaming=True).writeStream.format("memory").queryName("smoothed").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {(x.device_id, x.t_ms): (x.heading, x.pitch, x.roll) for x in spark.table("smoothed").collect()}
    assert got == want


def test_learned_profile(spark):
    u = spark.createDataFrame([("a", 358.0, 1.0, 1.0, 0), ("a", 2.0, 1.0, 1.0, 0), ("a", 0.0, 1.0, 1.0, 0), ("b", 1.0, None, 1.0, 0), ("c", None, 2.0, 4.0, 0)], "key string, heading double, pitch double, weight double, t_ms long")
    got = {x.key: x for x in sensors.sensor_profile(u, F.lit(0)).collect()}
    assert set(got) == {"a", "c"} and abs(got["a"].heading) < 1e-9 and got["a"].n == 3 and got["c"].heading is None
    assert sensors.sensor_profile(u, F.lit(63 * 86_400_000)).count() == 0
