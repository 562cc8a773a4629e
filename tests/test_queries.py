import math

import pandas as pd

from vistaframe.functions.geo import EARTH_M, EQUATOR_M, REFRACTION
from vistaframe.plans import queries


def land(lat, lon):
    return 1000 + 800 * math.sin(lat * 40) * math.cos(lon * 35)


def tables(folder, observers, peaks):
    pd.DataFrame({"c_custkey": pd.Series(observers, dtype="int64")}).to_parquet(folder / "customer.parquet")
    pd.DataFrame({"p_partkey": pd.Series(peaks, dtype="int64"), "p_name": [f"P{k}" for k in peaks], "p_retailprice": [900.0 + k % 100 for k in peaks]}).to_parquet(folder / "part.parquet")
    return str(folder)


def far(lat1, lon1, lat2, lon2):
    a, b, d = math.radians(lat1), math.radians(lat2), math.radians(lon2 - lon1)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(d / 2) ** 2
    az = math.degrees(math.atan2(math.sin(d) * math.cos(b), math.cos(a) * math.sin(b) - math.sin(a) * math.cos(b) * math.cos(d)))
    return 2 * EARTH_M * math.asin(math.sqrt(h)), az % 360


def knot(lat, lon, az, d):
    a, z, d = math.radians(lat), math.radians(az), d / EARTH_M
    s = math.sin(a) * math.cos(d) + math.cos(a) * math.sin(d) * math.cos(z)
    x = lon + math.degrees(math.atan2(math.sin(z) * math.sin(d) * math.cos(a), math.cos(d) - math.sin(a) * s))
    return (x + 180) / 360, 0.5 - math.log((1 + s) / (1 - s)) / (4 * math.pi)


def angles(lat, lon, h0, az, end):
    """(distance, angle) of every sample of a ray."""
    out, d = [], 40.0
    while d <= end:
        k = d // 1000
        (x0, y0), (x1, y1), t = knot(lat, lon, az, k * 1000), knot(lat, lon, az, (k + 1) * 1000), d / 1000 - k
        x, y = x0 + (x1 - x0) * t, y0 + (y1 - y0) * t
        h = land(math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y)))), x * 360 - 180)
        out.append((d, math.degrees(math.atan2(h - h0 - d * d / (2 * EARTH_M) * (1 - REFRACTION), d))))
        d += max(10.0, min(d * 0.01, EQUATOR_M * math.cos(math.radians(lat)) / (256 * 2 ** (12 if d < 8000 else 10))))
    return out


def eye(k):
    lat, lon = 45 + (k * 7919 % 300000) / 1e5, 6 + (k * 104729 % 400000) / 1e5
    return lat, lon, land(lat, lon) + 1.7, 20000 + k % 5 * 20000.0


def test_every_peak_in_range_is_judged(spark, tmp_path):
    observers, peaks = [56, 49, 29], [*range(1, 61), 7000]
    want = {}
    for o in observers:
        lat, lon, h0, radius = eye(o)
        for p in peaks:
            p_lat = 44 + (p // 1000 + 2) % 5 + ((p * p * 31 + p * 7919) % 99991) / 1e5
            p_lon = 8 + p // 5000 % 8 + ((p * p * 57 + p * 4729) % 99989) / 1e5
            d, az = far(lat, lon, p_lat, p_lon)
            if 150 <= d <= radius:
                ground, mapped = land(p_lat, p_lon), None if p % 7 == 0 else 800 + p % 100 * 30
                ele = mapped if mapped is not None and abs(mapped - ground) < 400 else ground
                angle = math.degrees(math.atan2(ele - h0 - d * d / (2 * EARTH_M) * (1 - REFRACTION), d))
                top = max((a for _, a in angles(lat, lon, h0, az, d - max(300, 0.03 * d) - 1e-6)), default=None)
                want[o, p] = (angle, top, top is None or angle >= top - 0.05)
    assert max(sum(o == k for k, _ in want) for o in observers) > 3
    got = {(r.obs_id, r.p_id): r for r in queries.occlusion_visibility(spark, tables(tmp_path, observers, peaks)).collect()}
    assert got.keys() == want.keys()
    for k, (angle, top, visible) in want.items():
        assert abs(got[k].angle - angle) < 1e-4 and abs(got[k].occlusion - top) < 1e-4 and got[k].visible == visible
    assert {v for _, _, v in want.values()} == {True, False}
