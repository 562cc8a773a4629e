"""Rays over terrain, horizons, ridge lines and what is visible from where.

Terrain is given as a callable (lat, lon) -> height: of columns, for single points and for samples as rows, or of NumPy
arrays, for rays that stay in the task that makes them (scanned_rays, occlusion_angle).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from vistaframe.functions import geo
from vistaframe.operators.spatial import TOWER_LEAST_M, TOWER_MOST_M, in_range
from vistaframe.shared import dealt, written

# fixed values
START_M, LEAST_STEP_M, STEP, NEAR_M, NEAR_ZOOM, FAR_ZOOM, KNOT_M = 40.0, 10.0, 0.01, 8000.0, 12, 10, 1000.0
AZ_STEP, HAZE_M, COARSE = 0.1, (15_000, 35_000), 16
TOWER_HEIGHT = {"c": 80, "o": 30, "b": 40, "m": 60, "h": 80, "w": 35}

Terrain = Callable[[Column, Column], Column]
Heights = Callable[[np.ndarray, np.ndarray], np.ndarray]


@F.pandas_udf(ArrayType(DoubleType()))
def distance_ladder(lat: pd.Series, radius: pd.Series) -> pd.Series:
    """Sample distances along a ray: steps of 1 % of the distance, at least 10 m, at most a raster cell."""

    def rungs(lat, radius):
        cell = {z: geo.EQUATOR_M * math.cos(math.radians(lat)) / (256 * 2**z) for z in (NEAR_ZOOM, FAR_ZOOM)}
        out, d = [], START_M
        while d <= radius:
            out.append(d)
            d += max(LEAST_STEP_M, min(d * STEP, cell[NEAR_ZOOM] if d < NEAR_M else cell[FAR_ZOOM]))
        return np.array(out)

    return pd.Series([rungs(a, r) for a, r in zip(lat, radius)])


@F.pandas_udf(ArrayType(StructType([StructField("k", IntegerType()), StructField("d", ArrayType(DoubleType()))])))
def ladder_by_knot(lat: pd.Series, radius: pd.Series) -> pd.Series:
    """The rungs of distance_ladder, gathered by the knot before them."""
    out = []
    for ds in distance_ladder.func(lat, radius):
        k = (ds // KNOT_M).astype(int)
        cut = np.flatnonzero(np.diff(k, prepend=-1))
        out.append([{"k": int(k[i]), "d": part} for i, part in zip(cut, np.split(ds, cut[1:]))] if len(ds) else [])
    return pd.Series(out)


def ray_samples(rays: DataFrame, radius: str, terrain: Terrain) -> DataFrame:
    """rays (lat, lon, az, `radius` and any other columns) with d and h at every sample that has a height.

    Points lie on great-circle knots each 1000 m and straight in Mercator between. The knots' trigonometry
    is done once for a knot, before its samples are spread out.
    """
    cols = [c for c in rays.columns if c != radius]
    x = rays.withColumn("_knots", ladder_by_knot("lat", radius)).select(*cols, F.inline("_knots"))
    x = x.withColumnsRenamed({"k": "_k", "d": "_ds"})
    for n in (0, 1):
        lat, lon = geo.destination("lat", "lon", "az", (F.col("_k") + n) * KNOT_M)
        mx, my = geo.to_mercator(lat, lon)
        x = x.withColumns({f"_x{n}": mx, f"_y{n}": my})
    x = x.select(*cols, "_k", "_x0", "_y0", "_x1", "_y1", F.explode("_ds").alias("d"))
    t = F.col("d") / KNOT_M - F.col("_k")
    mx, my = (F.col(f"_{c}0") + (F.col(f"_{c}1") - F.col(f"_{c}0")) * t for c in "xy")
    h = terrain(F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * my)))), mx * 360 - 180)
    return x.select(*cols, "d", h.alias("h")).where("h IS NOT NULL AND NOT isnan(h)")


def with_eye(observers: DataFrame, terrain: Terrain) -> DataFrame:
    """observers with h0: the given ground_ele, if there is such a column and value, else the terrain's, and the
    eye's height. Rows without any elevation are left out."""
    ground = terrain(F.col("lat"), F.col("lon"))
    if "ground_ele" in observers.columns:
        ground = F.coalesce("ground_ele", ground)
    eye = F.coalesce("eye_height", F.lit(1.7)) if "eye_height" in observers.columns else F.lit(1.7)
    return observers.withColumn("h0", ground + eye).where("h0 IS NOT NULL")


def observer_ground(observers: DataFrame, terrain: Terrain) -> DataFrame:
    """observers with ground: on a summit or ridge (6 of 8 directions more than 1 m lower at 60 m) the
    highest point within 40 m, else the terrain's height."""
    center = terrain(F.col("lat"), F.col("lon"))

    def at(az, r):
        return terrain(*geo.destination("lat", "lon", float(az), float(r)))

    lower = sum((F.when(at(az, 60) < center - 1, 1).otherwise(0) for az in range(0, 360, 45)), F.lit(0))
    top = F.greatest(center, *[F.coalesce(at(az, r), center) for r in (10, 20, 30, 40) for az in range(0, 360, 45)])
    return observers.withColumn("ground", F.when(lower >= 6, top).otherwise(center))


class Ladders(dict):
    """Sample distances by latitude, up to the largest radius asked for; a bounded number is remembered."""

    def up_to(self, lat: float, end: float) -> np.ndarray:
        most, rungs = self.get(lat, (-math.inf, None))
        if most < end:
            if len(self) > 4096:
                self.clear()
            most = max(end, 50_000.0)
            rungs = distance_ladder.func([lat], [most])[0]
            self[lat] = most, rungs
        return rungs[: np.searchsorted(rungs, end, side="right")]


def track(lat: float, lon: float, az: float, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mercator coordinates (unit square) of a ray at ascending distances d: great-circle knots each 1000 m, straight
    in between."""
    k = (d // KNOT_M).astype(int)
    step = np.arange(k[0], k[-1] + 2) * (KNOT_M / geo.EARTH_M)
    p, z = math.radians(lat), math.radians(az)
    up = math.sin(p) * np.cos(step) + math.cos(p) * np.sin(step) * math.cos(z)
    east = np.degrees(np.arctan2(math.sin(z) * math.cos(p) * np.sin(step), np.cos(step) - math.sin(p) * up))
    x = ((lon + east + 540) % 360) / 360
    y = 0.5 - np.log((1 + up) / (1 - up)) / (4 * math.pi)
    t = d / KNOT_M - k
    k -= k[0]
    return x[k] + (x[k + 1] - x[k]) * t, y[k] + (y[k + 1] - y[k]) * t


def slopes(h: np.ndarray, h0: float, d: np.ndarray) -> np.ndarray:
    """The tangent of the angle at which height h is seen from h0 at distance d, over the bent earth."""
    return (h - h0 - d * d * ((1 - geo.REFRACTION) / (2 * geo.EARTH_M))) / d


def _slopes(heights: Heights, ladders: Ladders, lat: float, lon: float, h0: float, az: float, end: float, every: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(d, slope) of a ray's samples that have a height; or of some of them, `every` so many."""
    d = ladders.up_to(lat, end)[::every]
    if not len(d):
        return d, d
    x, y = track(lat, lon, az, d)
    slope = slopes(heights(np.degrees(np.arctan(np.sinh(math.pi * (1 - 2 * y)))), x * 360 - 180), h0, d)
    known = ~np.isnan(slope)
    return (d, slope) if known.all() else (d[known], slope[known])


def _highest(d: np.ndarray, slope: np.ndarray) -> tuple[float, float]:
    """(angle, dist) of the highest sample, the last of equal ones."""
    at = len(slope) - 1 - int(slope[::-1].argmax())
    return math.degrees(math.atan(slope[at])), float(d[at])


def _ridges(d: np.ndarray, slope: np.ndarray, least_gap: float = 300, share: float = 0.04) -> np.ndarray:
    """Places of ridges: the last visible sample before a hidden stretch, if what is seen next lies over
    max(least_gap, share of its distance) beyond, or nothing is."""
    seen = rising(slope)
    return seen[_before_gaps(seen, d[seen], len(d), least_gap, share)]


def rising(slope: np.ndarray) -> np.ndarray:
    """Places of the samples that none before them hides."""
    return np.flatnonzero(slope >= np.r_[-np.inf, np.maximum.accumulate(slope)[:-1]])


def _before_gaps(seen: np.ndarray, d: np.ndarray, n: int, least_gap: float = 300, share: float = 0.04) -> np.ndarray:
    """Which of the visible samples (their places among n, and distances) are ridges."""
    after = np.r_[seen[1:], n]
    beyond = np.r_[d[1:], np.inf] - d > np.maximum(least_gap, share * d)
    return (after - seen > 1) & beyond


SCAN = "angle double, dist double, haze_angle array<double>, haze_dist array<double>, ridge_d array<double>, ridge_angle array<double>"


def scanned_rays(rays: DataFrame, heights: Heights) -> DataFrame:
    """rays (lat, lon, h0, az, radius and any other columns) with angle and dist of the horizon, haze (the same up to
    each distance of HAZE_M; angle -90 and no distance without samples) and ridges (d, angle). Rays without any
    sample are left out. A ray's samples are an array in the task that makes them: nothing is exploded or shuffled."""

    @F.pandas_udf(SCAN)
    def scan(lat: pd.Series, lon: pd.Series, h0: pd.Series, az: pd.Series, radius: pd.Series) -> pd.DataFrame:
        ladders, out = Ladders(), []
        for row in zip(lat, lon, h0, az, radius):
            d, slope = _slopes(heights, ladders, *row)
            if not len(d):
                out.append((None, None, (), (), (), ()))
                continue
            near = [int(np.searchsorted(d, band, side="right")) for band in HAZE_M]
            haze = [_highest(d[:n], slope[:n]) if n else (-90.0, None) for n in near]
            at = _ridges(d, slope)
            out.append((*_highest(d, slope), *zip(*haze), d[at], np.degrees(np.arctan(slope[at]))))
        return pd.DataFrame(out, columns=["angle", "dist", "haze_angle", "haze_dist", "ridge_d", "ridge_angle"])

    # else the filter below would be moved before the rays are dealt, and every ray be cast twice
    scan = scan.asNondeterministic()
    haze = F.arrays_zip(F.col("_scan.haze_angle").alias("angle"), F.col("_scan.haze_dist").alias("dist")).alias("haze")
    ridges = F.arrays_zip(F.col("_scan.ridge_d").alias("d"), F.col("_scan.ridge_angle").alias("angle")).alias("ridges")
    return rays.withColumn("_scan", scan("lat", "lon", "h0", "az", "radius")).select(*rays.columns, "_scan.angle", "_scan.dist", haze, ridges).where("angle IS NOT NULL")


def ring(observers: DataFrame, heights: Heights, step: float = AZ_STEP) -> DataFrame:
    """scanned_rays of every observer (obs_id, lat, lon, h0, radius) in every direction: (obs_id, az_bin, angle, dist,
    haze, ridges)."""
    bins = F.explode(F.sequence(F.lit(0), F.lit(round(360 / step) - 1))).alias("az_bin")
    rays = dealt(observers.select("obs_id", "lat", "lon", "h0", "radius", bins))
    return scanned_rays(rays.withColumn("az", F.col("az_bin") * F.lit(step)), heights).select("obs_id", "az_bin", "angle", "dist", "haze", "ridges")


def occlusion_angle(targets: DataFrame, heights: Heights, every: int = 1) -> DataFrame:
    """targets (lat, lon, h0, az, dist and any other columns) with occlusion: the largest angle of the terrain on the
    target's own ray, up to max(300 m, 3 %) before it; null if there is none. With `every`, by some of the samples only: it
    is at most the whole one."""

    @F.pandas_udf(DoubleType())
    def highest(lat: pd.Series, lon: pd.Series, h0: pd.Series, az: pd.Series, end: pd.Series) -> pd.Series:
        ladders, out = Ladders(), []
        for row in zip(lat, lon, h0, az, end):
            _, slope = _slopes(heights, ladders, *row, every)
            out.append(math.degrees(math.atan(slope.max())) if len(slope) else None)
        return pd.Series(out, index=lat.index, dtype=object)

    return targets.withColumn("occlusion", highest.asNondeterministic()("lat", "lon", "h0", "az", before_target()))


def before_target() -> Column:
    """How far a target's ray goes: max(300 m, 3 %) short of it."""
    return F.col("dist") - F.greatest(F.lit(300.0), 0.03 * F.col("dist")) - 1e-6


def peak_views(observers: DataFrame, peaks: DataFrame, terrain: Terrain, heights: Heights) -> DataFrame:
    """Peaks in range with az, angle, dist and visible. The mapped elevation counts unless it is 400 m or more
    off the terrain's; a hill within 0.05 degrees of the line of sight hides nothing."""
    return views_of(in_range(observers, peaks), terrain, heights)


def judged_peaks(near: DataFrame) -> DataFrame:
    """near (h0, dist, p_ele, ground) with ele and angle; pairs without any elevation are left out."""
    mapped = F.col("p_ele").isNotNull() & (F.col("ground").isNull() | (F.abs(F.col("p_ele") - F.col("ground")) < 400))
    t = near.withColumn("ele", F.when(mapped, F.col("p_ele")).otherwise(F.col("ground"))).where("ele IS NOT NULL")
    return t.withColumn("angle", geo.elevation_angle("h0", "ele", "dist"))


def seen_peaks(judged: DataFrame) -> DataFrame:
    return judged.withColumn("visible", F.coalesce(F.col("angle") >= F.col("occlusion") - 0.05, F.lit(True)))


def views_of(near: DataFrame, terrain: Terrain, heights: Heights) -> DataFrame:
    """The same for chosen pairs of observers and peaks, as in_range gives them."""
    judged = judged_peaks(near.withColumn("ground", terrain(F.col("p_lat"), F.col("p_lon")))).drop("ground")
    return seen_peaks(occlusion_angle(judged, heights))


def visible_count(views: DataFrame) -> DataFrame:
    """(obs_id, peaks, visible) of views (obs_id, visible): peaks in range and those of them that can be seen."""
    return views.groupBy("obs_id").agg(F.count("*").alias("peaks"), F.count_if("visible").alias("visible"))


def tile_progress(needed: DataFrame, fetched: DataFrame) -> DataFrame:
    """(obs_id, total, done, failed) of the tiles each observer needs (obs_id, tile) and those fetched (tile, ok)."""
    x = needed.distinct().join(fetched.groupBy("tile").agg(F.bool_or("ok").alias("ok")), "tile", "left")
    return x.groupBy("obs_id").agg(F.count("*").alias("total"), F.count("ok").alias("done"), F.count_if(~F.col("ok")).alias("failed"))


def landmark_views(observers: DataFrame, towers: DataFrame, terrain: Terrain, heights: Heights) -> DataFrame:
    """Towers (id, lat, lon, kind, height) whose top stands 0.1 degrees above the skyline up to 35 km and above
    the terrain before them: az, dist, base, top, height_known."""
    near = in_range(observers, towers, TOWER_LEAST_M, TOWER_MOST_M)
    t = written(maybe_seen(judged_towers(near.withColumn("ground", terrain(F.col("p_lat"), F.col("p_lon")))), heights))
    sky = scanned_rays(dealt(tower_rays(t)), heights).select("obs_id", F.col("az").alias("bin_az"), F.col("angle").alias("sky"))
    return seen_towers(occlusion_angle(t.join(sky, ["obs_id", "bin_az"], "left"), heights))


def maybe_seen(t: DataFrame, heights: Heights) -> DataFrame:
    """The towers that one sample in COARSE of their rays doesn't hide. What hides a tower there hides it on the whole ray too, so
    none is lost; most go here, and whole rays are cast for the rest."""
    hidden = F.col("occlusion") + 0.1 > F.col("top") + 1e-6  # the margin: a rounding error decides nothing here
    return occlusion_angle(t, heights, COARSE).where(~F.coalesce(hidden, F.lit(False))).drop("occlusion")


def judged_towers(near: DataFrame) -> DataFrame:
    """near (h0, dist, az, p_kind, p_height, ground) with tall, base, top, height_known and the azimuth of the ring's ray."""
    usual = F.create_map(*[F.lit(x) for kv in TOWER_HEIGHT.items() for x in kv])
    t = near.withColumn("tall", F.coalesce("p_height", F.try_element_at(usual, F.col("p_kind")))).where("ground IS NOT NULL")
    return t.withColumns({"base": geo.elevation_angle("h0", "ground", "dist"), "top": geo.elevation_angle("h0", F.col("ground") + F.col("tall"), "dist"), "height_known": F.col("p_height").isNotNull(), "bin_az": geo.nearest_bin("az") * AZ_STEP})


def tower_rays(t: DataFrame) -> DataFrame:
    """The rays to 35 km on which towers stand, each once."""
    return t.select("obs_id", "lat", "lon", "h0", F.lit(float(HAZE_M[1])).alias("radius"), F.col("bin_az").alias("az")).distinct()


def seen_towers(t: DataFrame) -> DataFrame:
    return t.where((F.col("top") >= F.coalesce("sky", F.lit(-90.0)) + 0.1) & (F.coalesce(F.col("top") >= F.col("occlusion") + 0.1, F.lit(True))))


def lined(horizon: DataFrame) -> DataFrame:
    """(obs_id, _bins, _angles): a horizon (obs_id, az_bin, angle) as a row of arrays by bin for each obs_id. It is met by
    obs_id alone, so that bins aren't sorted into the other side, and never broadcast: Spark takes rows that a generator
    made for as few as it was given."""
    ring = horizon.groupBy("obs_id").agg(F.sort_array(F.collect_list(F.struct("az_bin", "angle"))).alias("_ring"))
    return ring.select("obs_id", F.col("_ring.az_bin").alias("_bins"), F.col("_ring.angle").alias("_angles")).hint("merge")


def _place(bin: Column) -> Column:
    """Where in _bins a bin stands: at its own number in a ring without gaps; -1 if it isn't there."""
    return F.when(F.get("_bins", bin) == bin, bin).otherwise(F.array_position("_bins", bin).cast("int") - 1)


def bins_near(frames: DataFrame, horizon: DataFrame, reach) -> DataFrame:
    """frames (obs_id, heading and others) with az_bin, az and angle of each bin of their horizon up to `reach` degrees from
    the heading; bins without an angle are left out."""
    low, high = F.floor((F.col("heading") - reach) / AZ_STEP), F.ceil((F.col("heading") + reach) / AZ_STEP)
    n = round(360 / AZ_STEP)

    def found(b):
        b = F.pmod(b, F.lit(n)).cast("int")
        return F.struct(b.alias("az_bin"), F.get("_angles", _place(b)).alias("angle"))

    # the few bins in view are taken out of the ring first: a generator would copy the ring into each of its rows
    near = F.transform(F.sequence(low, F.least(high, low + (n - 1))), found)
    x = frames.join(lined(horizon), "obs_id").select(*frames.columns, F.inline(near))
    x = x.withColumn("az", F.col("az_bin") * AZ_STEP)
    return x.where(F.col("angle").isNotNull() & (F.abs(geo.delta_deg("az", "heading")) <= reach))


def skyline_relief(targets: DataFrame, horizon: DataFrame) -> DataFrame:
    """targets (obs_id, az, angle, visible) with relief: how far a visible one stands above the lowest skyline to
    its left and right, the smaller of the two; 0 for hidden ones."""
    n, k = round(360 / AZ_STEP), round(1.5 / AZ_STEP)
    low = F.coalesce("angle", F.lit(float("-inf"))).alias("angle")  # a bin without samples
    ring = lined(horizon.select("obs_id", "az_bin", low))
    # the bins of both ends once more beyond the other end
    head, tail = F.size(F.filter("_bins", lambda b: b >= n - k)), F.size(F.filter("_bins", lambda b: b < k))
    wide = F.concat(F.slice("_angles", F.size("_angles") - head + 1, head), "_angles", F.slice("_angles", 1, tail))
    ring = ring.select("obs_id", "_bins", wide.alias("_angles"), head.alias("_head")).hint("merge")
    x = targets.join(ring, "obs_id", "left").withColumn("_at", _place(geo.nearest_bin("az")) + F.col("_head") + 1)
    first = F.greatest(F.lit(1), F.col("_at") - k)
    there = F.col("_at") > F.col("_head")
    x = x.withColumns({"low_left": F.when(there, F.array_min(F.slice("_angles", first, F.col("_at") - first))), "low_right": F.when(there, F.array_min(F.slice("_angles", F.col("_at") + 1, k)))})
    relief = F.greatest(F.lit(0.0), F.least(F.col("angle") - F.col("low_left"), F.col("angle") - F.col("low_right")))
    none = (F.col("low_left") == float("-inf")) & (F.col("low_right") == float("-inf"))
    return x.select(*targets.columns, F.when(F.col("visible") & ~none, F.coalesce(relief, F.lit(0.0))).otherwise(F.lit(0.0)).alias("relief"))


def prune_lines(lines: DataFrame, horizon: DataFrame, least: float = 0.8) -> DataFrame:
    """Of ridge lines (obs_id, line_id, seq, az_bin, angle, dist) those that span `least` degrees round the ring
    or touch the horizon within 0.001: (obs_id, line_id, n, span, touches)."""
    x = lines.join(lined(horizon), "obs_id", "left").withColumn("h", F.get("_angles", _place(F.col("az_bin"))))
    g = x.groupBy("obs_id", "line_id").agg(F.count("*").alias("n"), F.min_by("az_bin", "seq").alias("first"), F.max_by("az_bin", "seq").alias("last"), F.coalesce(F.bool_or(F.col("angle") >= F.col("h") - 1e-3), F.lit(False)).alias("touches"))
    g = g.withColumn("span", F.pmod(F.col("last") - F.col("first"), F.lit(round(360 / AZ_STEP))) * F.lit(AZ_STEP))
    return g.where((F.col("span") >= least - 1e-9) | F.col("touches")).select("obs_id", "line_id", "n", "span", "touches")


def link_ridges(ridges: DataFrame, n_bins: int = 3600, rel: float = 0.08, turn: float = 0.6, most_gap: int = 3) -> DataFrame:
    """Ridge points (obs_id, az_bin, angle, dist) joined into lines: (obs_id, line_id, seq, az_bin, angle, dist).

    For gaps of 1 to most_gap bins, each point without a follower takes the best free point that many bins
    on, by relative difference of distance and by angle. Points of a bin come by distance. Lines with
    a beginning come first, then closed rings.
    """

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["az_bin", "dist"], kind="stable").reset_index(drop=True)
        n = len(pdf)
        points = pdf.assign(i=np.arange(n))[["i", "az_bin", "dist", "angle"]]
        ahead, behind = np.full(n, -1), np.full(n, -1)
        for gap in range(1, min(most_gap, n_bins - 1) + 1):
            # all pairs of free ends this far apart that fit, then the best partner of each in the order of its bin
            a = points[ahead == -1]
            b = points[behind == -1].assign(az_bin=lambda x: (x.az_bin - gap) % n_bins)
            fit = a.merge(b, on="az_bin", suffixes=("", "_b"))
            far, high = (fit.dist_b - fit.dist).abs() / fit.dist, (fit.angle_b - fit.angle).abs()
            fit = fit.assign(score=far / rel + high / turn)[(far <= rel) & (high <= turn)].sort_values(["i", "score", "i_b"], kind="stable")
            for i, j in zip(fit.i.tolist(), fit.i_b.tolist()):
                if ahead[i] < 0 and behind[j] < 0:
                    ahead[i], behind[j] = j, i
        # heads by doubling: where each point's line begins, and how many steps away; rings have no head
        up, steps = np.where(behind < 0, np.arange(n), behind), (behind >= 0).astype(np.int64)
        for _ in range(max(1, n.bit_length())):
            steps, up = steps + steps[up], up[up]
        ring = behind[up] >= 0
        for i in np.flatnonzero(ring):
            if ring[i]:  # the ring begins at its first point
                k, at = 0, i
                while ring[at]:
                    ring[at], up[at], steps[at] = False, n + i, k
                    k, at = k + 1, ahead[at]
        line = np.unique(up, return_inverse=True)[1]
        out = pdf.assign(line_id=line.astype(np.int32), seq=steps.astype(np.int32))[["obs_id", "line_id", "seq", "az_bin", "angle", "dist"]]
        return out.sort_values(["line_id", "seq"])

    kind = dict(ridges.dtypes)["obs_id"]
    return ridges.groupBy("obs_id").applyInPandas(link, f"obs_id {kind}, line_id int, seq int, az_bin int, angle double, dist double")


def tree_tolerance(dist, tall: float = 25.0) -> Column:
    """Degrees that trees of 25 m may raise the skyline at a distance; at most 1.2, none without a distance."""
    d = geo._c(dist)
    return F.coalesce(F.when(d > 0, F.least(F.lit(1.2), F.degrees(F.atan(tall / d)))), F.lit(0.0))


def horizon_at(df: DataFrame, horizon: DataFrame, nearest: bool = False) -> DataFrame:
    """df (obs_id, az) with h, the horizon's angle there: interpolated between bins, or the nearest bin's."""
    x = df.join(lined(horizon), "obs_id", "left")
    if nearest:
        return x.withColumn("h", F.get("_angles", _place(geo.nearest_bin("az")))).select(*df.columns, "h")
    low, _, t = geo.horizon_bins("az")
    x = x.withColumns({"_at": _place(low), "_t": t})
    here, after = F.get("_angles", F.col("_at")), F.coalesce(F.get("_angles", F.col("_at") + 1), F.get("_angles", F.lit(0)))
    return x.withColumn("h", here + (after - here) * F.col("_t")).select(*df.columns, "h")


def terrain_events(path: DataFrame, horizon: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rise, set) of paths (keys, obs_id, t, az, alt): the first rise above the terrain and the last set
    below it, interpolated between samples of one obs_id; pairs with a missing horizon are passed over."""
    key = list(dict.fromkeys(["obs_id", *keys]))
    x = horizon_at(path.select(*key, "t", "az", "alt"), horizon, nearest=True).withColumn("over", F.col("alt") - F.col("h"))
    w = Window.partitionBy(*key).orderBy("t")
    x = x.withColumns({"o0": F.lag("over").over(w), "t0": F.lag("t").over(w)})
    at = F.col("t0") + (F.col("t") - F.col("t0")) * F.col("o0") / (F.col("o0") - F.col("over"))
    up, down = (F.col("o0") < 0) & (F.col("over") >= 0), (F.col("o0") >= 0) & (F.col("over") < 0)
    x = x.groupBy(*key).agg(F.min(F.when(up, at)).alias("rise"), F.max(F.when(down, at)).alias("set"))
    return x.groupBy(*keys).agg(F.min("rise").alias("rise"), F.max("set").alias("set")) if len(key) > len(keys) else x


def sat_passes(looks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pass, rise, set, max_alt, visible) of looks (keys, t, alt, sunlit, sun_alt): maximal runs above the
    horizon; visible if any point is sunlit while the sun is below -6 degrees."""
    w = Window.partitionBy(*keys).orderBy("t")
    up = F.col("alt") > 0
    x = looks.withColumn("start", (up & ~F.coalesce(F.lag(up).over(w), F.lit(False))).cast("int"))
    x = x.withColumn("pass", F.sum("start").over(w)).where(up)
    return x.groupBy(*keys, "pass").agg(F.min("t").alias("rise"), F.max("t").alias("set"), F.max("alt").alias("max_alt"), F.bool_or(F.col("sunlit") & (F.col("sun_alt") < -6)).alias("visible"))
