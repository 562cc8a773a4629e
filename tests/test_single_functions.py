"""Functions that no query calls."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaframe.functions import geo, text
from vistaframe.functions.magnetic import decimal_year, declination, field
from vistaframe.operators import align, dataset, night
from vistaframe.sources.readers import build_sky_catalogue


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_names(spark):
    names = F.create_map(F.lit("de"), F.lit("Matterhorn"), F.lit("it"), F.lit("Cervino"))
    assert one(spark, text.display_name(names, F.lit("M"), "it")) == "Cervino" and one(spark, text.display_name(names, F.lit("M"), "fr")) == "M"
    assert one(spark, text.name_score(F.array(F.lit(""), F.lit("mont cervin"), F.lit("cervino")), F.lit("cerv"))) == 2
    assert one(spark, text.name_score(F.array(F.lit("")), F.lit("x"))) == 0
    assert one(spark, text.sat_name(F.lit("25544"), F.lit("ISS (ZARYA)"))) == "ISS"
    assert one(spark, text.sat_name(F.lit("1"), F.lit("COSMOS 2251 DEB"))) == "Cosmos 2251 DEB"


def test_pixels_and_views(spark):
    assert abs(one(spark, geo.meters_per_pixel(F.lit(0.0), F.lit(0))) - 40_075_016.686 / 256) < 1e-6
    assert abs(one(spark, geo.meters_per_pixel(F.lit(60.0), F.lit(12))) - 40_075_016.686 / 256 / 4096 / 2) < 1e-6
    seen = lambda az, roll, pitch: one(spark, geo.azimuth_in_view(F.lit(az), F.lit(350.0), F.lit(pitch), F.lit(roll), F.lit(40.0), F.lit(390), F.lit(844), F.lit(5.0)))
    assert seen(14.9, 0.0, 0.0) and not seen(15.1, 0.0, 0.0) and seen(24.0, 0.0, 20.0)
    half = math.degrees(math.atan(math.tan(math.radians(20)) * math.hypot(390, 844) / 390)) + 5
    assert seen(350 + half - 0.1 - 360, 1.0, 0.0) and not seen(350 + half + 0.1 - 360, 1.0, 0.0)


def test_gate(spark):
    assert dataset.require_min_rows(spark.range(5), 5).count() == 5
    with pytest.raises(ValueError):
        dataset.require_min_rows(spark.range(5), 6)


def test_first_after(spark):
    paths = spark.createDataFrame([("a", 1, 5.0, None), ("a", 2, 1.0, 3.0), ("a", 3, 4.0, 3.0), ("a", 4, 9.0, 3.0), ("b", 9, -1.0, None)], "k string, t int, alt double, h double")
    assert [tuple(r) for r in night.first_after(paths, ["k"], F.lit(1)).collect()] == [("a", 3)]


def test_body_correction(spark):
    ring = spark.createDataFrame([(1, b, 2.0) for b in range(3600)], "obs_id int, az_bin int, angle double")
    seen = spark.createDataFrame([(1, 1, "sun", 359.0, 8.0), (2, 1, "sun", 10.0, 2.2), (3, 1, "moon", 10.0, 5.0)], "frame_id int, obs_id int, kind string, az double, alt double")
    true = spark.createDataFrame([(1, "sun", 2.0, 7.5), (2, "sun", 10.0, 2.0), (3, "sun", 10.0, 5.0)], "frame_id int, kind string, az double, alt double")
    got = align.body_correction(seen, true, ring).collect()
    assert [(r.frame_id, r.d_heading, r.d_pitch) for r in got] == [(1, 3.0, -0.5)]


def test_sky_catalogue(spark):
    stars = spark.createDataFrame([(1, -10.12345, 5.0, 1.0, 0.1), (2, 20.0, 6.0, 5.4, None), (3, 30.0, 7.0, 5.6, 0.0), (4, 40.0, 8.0, 2.4, 0.0)], "id int, lon double, lat double, mag double, bv double")
    names = spark.createDataFrame([(1, {"en": "Vega"}, "Wega"), (2, {"en": "Faint"}, "Faint"), (4, {"en": ""}, "Local")], "id int, names map<string,string>, name string")
    cons = spark.createDataFrame([("Lyr", {"en": "Lyra"}, "Lyra", [280.0, 36.0], 1.0, 2.0), ("Xyz", {}, "X", None, 3.0, 4.0)], "id string, names map<string,string>, name string, display array<double>, lon double, lat double")
    lines = spark.createDataFrame([("Lyr", [[[1.0, 2.0], [3.0, 4.0]]])], "id string, lines array<array<array<double>>>")
    s, c = build_sky_catalogue(stars, names, cons, lines)
    assert [(r.id, r.ra, r.name) for r in s.collect()] == [(1, 349.877, "Vega"), (4, 40.0, "Local"), (2, 20.0, None)]
    assert {r.id for r in c.collect()} == {"Lyr", "Xyz"}


def test_declination_columns(spark):
    table = (2025.0, np.array([[1, 0, -30000.0, 0, 0, 0], [1, 1, -2000.0, 5000.0, 10.0, -20.0]]))
    rows = [(46.0, 8.0, 2026.5, 1.5), (-30.0, 120.0, 2027.0, 0.0)]
    got = [r.declination for r in declination(spark.createDataFrame(rows, "lat double, lon double, year double, alt_km double"), table).collect()]
    assert got == pytest.approx(field(table, *(np.array(x) for x in zip(*rows))), abs=1e-9)
    at = spark.createDataFrame([(datetime.datetime(2025, 7, 2, 12),)], "ts timestamp").select(decimal_year(F.col("ts"))).first()[0]
    assert abs(at - 2025.5) < 1e-3
