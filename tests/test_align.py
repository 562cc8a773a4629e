import math
import random

import numpy as np

from vistaframe.functions.magnetic import field, read_coefficients
from vistaframe.operators import align, skyfit
from vistaframe.streaming import machines


def hills(az):
    base = 1.5 + 1.2 * np.sin(np.radians(3.6 * az)) + 0.8 * np.sin(np.radians(14.1 * az) + 1)
    for a, el, w in ((195, 4.5, 2), (203, 3.8, 1.2), (212, 5.2, 1.5), (221, 3.2, 2.5)):
        base = np.maximum(base, el - np.abs((az - a + 180) % 360 - 180) / w)
    return base


def seen(horizon, heading, pitch, roll, hfov, width=390, height=844, n=160):
    """Skyline pixels of a camera: the row where each column's elevation meets the horizon."""
    xs, ys = np.linspace(1, width - 1, n), []
    rows = np.linspace(0, height, 6001)
    for x in xs:
        az, el = skyfit.rays(np.full(len(rows), x), rows, pitch, roll, hfov, width, height)
        ys.append(rows[np.abs(el - skyfit.on_ring(horizon, heading + az)).argmin()])
    return xs, np.array(ys)


def test_skyline_recovers_the_camera(spark):
    horizon = hills(np.arange(3600) / 10)
    xs, ys = seen(horizon, 205, 2, 3, 34)
    frames = spark.createDataFrame([(1, 7, 210.5, 3.2, 3.0, 34 * 1.08, 390, 844, 160), (2, 8, 210.5, 3.2, 3.0, 36.0, 390, 844, 160), (3, 7, 210.5, 3.2, 3.0, 36.0, 390, 844, 900)], "frame_id long, obs_id long, heading double, pitch double, roll double, hfov double, width int, height int, columns int")
    points = spark.createDataFrame([(f, float(x), float(y)) for f in (1, 2, 3) for x, y in zip(xs, ys)], "frame_id long, x double, y double")
    lines = spark.createDataFrame([(7, b, float(a)) for b, a in enumerate(horizon)] + [(8, b, -0.2) for b in range(3600)], "obs_id long, az_bin int, angle double")
    got = {r.frame_id: r for r in align.match_skyline(frames, points, lines).collect()}
    assert got[1].ok and abs(got[1].d_heading + 5.5) < 0.5 and abs(got[1].d_pitch + 1.2) < 0.5
    assert got[2].reason == "flat-horizon" and got[3].reason == "few-columns"


def test_stars_recover_the_shift(spark):
    r = random.Random(1)
    refs = [(r.uniform(150, 210), r.uniform(5, 60)) for _ in range(40)]
    blobs = [((a + 4) % 360, e - 1.5, 1.0 + i) for i, (a, e) in enumerate(r.sample(refs, 14))]
    b = spark.createDataFrame([(1, *x) for x in blobs] + [(2, 1.0, 1.0, 1.0)], "frame_id long, az double, el double, contrast double")
    s = spark.createDataFrame([(f, *x) for f in (1, 2) for x in refs], "frame_id long, az double, alt double")
    got = {x.frame_id: x for x in align.match_stars(b, s).collect()}
    assert got[1].ok and abs(got[1].d_heading + 4) < 0.15 and abs(got[1].d_pitch - 1.5) < 0.15 and not got[2].ok


def test_first_accepted_match_and_haze(spark):
    m = spark.createDataFrame([(1, "stars", True, 1.0, 0.0), (1, "towers", True, 2.0, 0.0), (1, "skyline", False, 3.0, 0.0), (2, "pitch", False, 0.0, 0.0)], "frame_id long, source string, ok boolean, d_heading double, d_pitch double")
    assert [(x.frame_id, x.source) for x in align.align_frames(m).collect()] == [(1, "towers")]
    f = spark.createDataFrame([(1, 0, 0.10, 1.0, 0.0, True), (1, 1, 0.12, 1.5, 0.0, True), (2, 0, 0.10, 359.9, 0.0, True), (2, 1, 0.12, 0.9, 0.0, True), (3, 0, 0.10, 1.0, 0.0, True), (3, 1, 0.17, 9.0, 0.0, True)], "frame_id long, band int, cost double, d_heading double, d_pitch double, ok boolean")
    assert {x.frame_id: x.ok for x in align.match_skyline_haze(f).collect()} == {1: True, 2: False, 3: True}


def test_labels_keep_apart(spark):
    rows = [(1, 1, 100.0, False, True, 1.0), (1, 2, 110.0, False, True, 2.0), (1, 3, 120.0, True, False, 0.0), (1, 4, 150.0, False, True, 0.5)]
    out = align.thin_labels(spark.createDataFrame(rows, "v long, id long, x double, selected boolean, visible boolean, score double"), ["v"]).collect()
    assert sorted(x.id for x in out) == [1, 3, 4]


def run(machine, events):
    state, out = None, []
    for e in events:
        state, given = machine(state, e)
        out.append(next(iter(given.values())))
    return out


def test_machines():
    assert run(machines.pitch_band, [{"pitch": p} for p in (0, 21, 24, 18, 10, -21, -24)]) == ["level", "level", "up", "up", "level", "level", "down"]
    big = [{"t_ms": t * 1000, "correction": c} for t, c in ((0, 20), (100, -18), (150, 10), (290, 10), (300, 20), (301, 20), (302, 1))]
    assert run(machines.compass_disturbed, big) == [False, True, True, False, False, True, False]
    c = [{"t_ms": t * 1000, "offset": 0.0, "d_heading": d} for t, d in ((0, 1), (1, 9), (2, 9.5), (3, 15), (30, 15))]
    assert run(machines.confirm_heading, c) == [True, False, True, False, False]
    s = [{"t_ms": t * 1000, "lat": 46.0, "lon": 8.0, "heading": h} for t, h in ((0, 0), (10, 90), (20, 9), (45, 10), (145, 10))]
    assert run(machines.training_sampler, s) == [True, False, True, False, True]
    p = [{"t_ms": t * 1000, "lat": 46 + d / 111195, "lon": 8.0, "accuracy": a} for t, d, a in ((0, 0, 10), (5, 500, 10), (20, 500, 300), (21, 500, 10), (60, 560, 10))]
    assert run(machines.recompute_trigger, p) == [True, False, False, True, False]
    u = [{"t_ms": t * 1000, "matched": m, "sun_alt": a} for t, m, a in ((0, False, 9), (59, False, 9), (60, False, 9), (61, False, 1), (62, True, 9), (63, False, 9))]
    assert run(machines.unverified_heading, u) == [None, None, "sun", "pan", None, None]
    t = [{"t_ms": i, "fov": 60.0, "axis": float(i * 2), "pitch": 0.1 * i * 2 + 1} for i in range(8)]
    state = None
    for e in t:
        state, out = machines.tilt_calibration(state, e)
    assert abs(out["tilt"] - 1) < 1e-9 and out["fov_fit"] > 60
    state, out = machines.apply_correction({"heading": 179.0, "pitch": 19.0}, {"d_heading": 6.0, "d_pitch": 9.0})
    assert out == {"offset_heading": -178.0, "offset_pitch": 20.0}


def test_machine_streams_equal_tables(spark, tmp_path):
    r = random.Random(3)
    rows = [(k, t * 40_000, r.choice([1.0, 10.0, 20.0, -30.0])) for k in range(3) for t in range(30)]
    df = spark.createDataFrame(rows, "k long, t_ms long, correction double")
    want = sorted(map(tuple, machines.replay(df, "k", machines.compass_disturbed).collect()))
    for n in range(3):
        df.where(f"t_ms >= {n * 400_000} AND t_ms < {(n + 1) * 400_000}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = machines.stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "k", machines.compass_disturbed)
    q = q.writeStream.format("memory").queryName("machines").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("machines").collect())) == want and any(x[3] for x in want)


def test_declination_of_a_tilted_dipole():
    """A dipole's field points along great circles to its pole."""
    g10, g11, h11 = -30000.0, -2000.0, 5000.0
    text = f"2025.0 TEST\n1 0 {g10} 0 0 0\n1 1 {g11} {h11} 0 0\n999999"
    epoch, table = read_coefficients(text)
    assert epoch == 2025 and table.shape == (2, 6)
    lat, lon = np.array([10.0, -35.0, 60.0, 0.0]), np.array([8.0, 120.0, -70.0, 200.0])
    d = field((epoch, table), lat, lon, np.full(4, 2025.0), np.zeros(4))
    pole = -np.array([g11, h11, g10])
    pole /= np.linalg.norm(pole)
    plat, plon = np.arcsin(pole[2]), np.arctan2(pole[1], pole[0])
    b = np.radians(lat)
    y = np.sin(plon - np.radians(lon)) * np.cos(plat)
    x = np.cos(b) * np.sin(plat) - np.sin(b) * np.cos(plat) * np.cos(plon - np.radians(lon))
    assert np.abs(d - np.degrees(np.arctan2(y, x))).max() < 0.2


def test_a_horizon_without_some_rows_is_still_a_full_ring(spark):
    """Rays without samples have no row; the turn found stays the same."""
    ring = hills(np.arange(3600) / 10).tolist()
    angle = ring.__getitem__
    horizon = [(1, b, angle(b)) for b in range(3600)]
    focal = 195 / math.tan(math.radians(17))
    points = []
    for b in range(1900, 2200, 3):
        az, el = math.radians(b * 0.1 - 205), math.radians(angle(b))
        points.append((1, 195 + focal * math.tan(az), 422 - focal * math.tan(el) / math.cos(az)))
    frames = spark.createDataFrame([(1, 1, 209.5, 0.0, 0.0, 34.0, 390, 844, 100)], "frame_id long, obs_id long, heading double, pitch double, roll double, hfov double, width int, height int, columns int")
    dots = spark.createDataFrame(points, "frame_id long, x double, y double")
    for rows in (horizon, horizon[10:]):
        lines = spark.createDataFrame(rows, "obs_id long, az_bin int, angle double")
        got = align.match_skyline(frames, dots, lines).first()
        assert got.ok and abs(got.d_heading + 4.5) < 0.1, got
