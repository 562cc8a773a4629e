"""Queries over the driver's tables, and the same in SQL for engines that can run it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaframe.functions import geo, sky, text
from vistaframe.functions.steps import nested
from vistaframe.operators import align, dataset, evidence, panorama, publishing, raster_rays, search, spatial
from vistaframe.plans import sqlgeo as g
from vistaframe.plans.derived import derived, doubles, oracle
from vistaframe.shared import dealt, shared_dir, written
from vistaframe.sources import dem, readers
from vistaframe.streaming import fusion, machines, sensors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def terrain(lat, lon):
    """A closed-form landscape."""
    return 1000 + 800 * F.sin(lat * 40) * F.cos(lon * 35)


def heights(lat, lon):
    """The same of arrays."""
    import numpy as np

    return 1000 + 800 * np.sin(lat * 40) * np.cos(lon * 35)


def _eyes(spark, sf_dir) -> DataFrame:
    return derived(spark, sf_dir, "observers").withColumn("h0", terrain(F.col("lat"), F.col("lon")) + 1.7)


EYES = f"(SELECT *, {g.terrain('lat', 'lon')} + 1.7 AS h0 FROM {oracle('observers')})"
NEAR_PEAKS = f"(SELECT *, {g.bearing('lat', 'lon', 'p_lat', 'p_lon')} AS az FROM (SELECT o.*, p.id AS p_id, p.name AS p_name, p.lat AS p_lat, p.lon AS p_lon, p.ele AS p_ele, p.qid AS p_qid, {g.distance('o.lat', 'o.lon', 'p.lat', 'p.lon')} AS dist FROM {g.tiles(EYES)} o JOIN {oracle('peaks')} p ON floor(p.lat) = ty AND floor(p.lon) = tx) WHERE dist >= 150 AND dist <= radius)"


@query(
    f"SELECT obs_id, p_id, p_name, round(dist, 3) AS dist, round(az, 6) AS az, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY round(score, 6) DESC, p_id) AS rank FROM (SELECT *, 0.5 * coalesce(p_ele, 0) / 4000 + 1.5 * least(1, log2(1 + p_id % 80) / 6) AS score FROM {NEAR_PEAKS})) WHERE rank <= 5"
)
def peaks_in_range_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = spatial.label_score(F.col("id") % 80, F.lit(0.0), F.coalesce("ele", F.lit(0.0)))
    peaks = derived(spark, sf_dir, "peaks").select("id", "name", "lat", "lon", F.round(score, 6).alias("score"))
    near = spatial.best_in_range(_eyes(spark, sf_dir).drop("h0"), peaks, [("score", False), ("id", True)], 5)
    best = spatial.top_k(near.withColumn("score", F.col("p_score")), ["obs_id"], [F.desc("score"), "p_id"], 5)
    return best.select("obs_id", "p_id", "p_name", F.round("dist", 3).alias("dist"), F.round("az", 6).alias("az"), "score", F.col("rank").cast("long").alias("rank"))


@query(
    f"SELECT id, round({g.distance('lat', 'lon', '46.5', '8.25')}, 3) AS dist, round({g.bearing('lat', 'lon', '46.5', '8.25')}, 6) AS az, round({g.dest_lat('lat', 'jd', '50000')}, 6) AS to_lat, round({g.dest_lon('lat', 'lon', 'jd', '50000')}, 6) AS to_lon FROM {oracle('times')}"
)
def geo_distance_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived(spark, sf_dir, "times")
    lat, lon = geo.destination("lat", "lon", "jd", 50000)
    return t.select("id", F.round(geo.distance_m("lat", "lon", 46.5, 8.25), 3).alias("dist"), F.round(geo.bearing_deg("lat", "lon", 46.5, 8.25), 6).alias("az"), F.round(lat, 6).alias("to_lat"), F.round(lon, 6).alias("to_lon"))


@query(f"SELECT obs_id, ty AS tile_lat, tx AS tile_lon, round(tdist, 3) AS dist FROM {g.tiles(oracle('observers'))}")
def tiles_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived(spark, sf_dir, "observers").select("obs_id", F.explode(geo.tiles_for("lat", "lon", "radius")).alias("t"))
    return t.select("obs_id", F.col("t.lat").cast("long").alias("tile_lat"), F.col("t.lon").cast("long").alias("tile_lon"), F.round("t.dist", 3).alias("dist"))


_PX = f"(SELECT obs_id, floor(({g.dest_lon('lat', 'lon', '270', 'radius')} + 180) / 360 * 1024) AS x0, floor(({g.dest_lon('lat', 'lon', '90', 'radius')} + 180) / 360 * 1024) AS x1, floor({g.merc_y('n')} * 1024) AS y0, floor({g.merc_y('s')} * 1024) AS y1 FROM (SELECT *, {g.dest_lat('lat', '0', 'radius')} AS n, {g.dest_lat('lat', '180', 'radius')} AS s FROM {oracle('observers')}))"


@query(f"SELECT obs_id, x, unnest(generate_series(CAST(y0 AS BIGINT), CAST(y1 AS BIGINT))) AS y FROM (SELECT *, unnest(generate_series(CAST(x0 AS BIGINT), CAST(x1 AS BIGINT))) AS x FROM {_PX})")
def tiles_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived(spark, sf_dir, "observers").select("obs_id", F.explode(geo.tiles_covering("lat", "lon", "radius", 10)).alias("t"))
    return t.select("obs_id", F.col("t.x").cast("long").alias("x"), F.col("t.y").cast("long").alias("y"))


_ELE = "CAST(nullif(regexp_extract(regexp_replace(regexp_replace(ele_text, '[''’\\s]', '', 'g'), '^([^,]*),', '\\1.'), '-?[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE)"


@query(
    f"SELECT id, CASE WHEN v > -500 AND v < 9000 THEN round(v, 6) END AS ele, CASE WHEN w > -500 AND w < 9000 THEN floor(w + 0.5) END AS ele_whole FROM (SELECT id, v * CASE WHEN regexp_matches(ele_text, 'ft|feet|''$') THEN 0.3048 ELSE 1 END AS v, v * CASE WHEN regexp_matches(ele_text, 'ft|feet') THEN 0.3048 ELSE 1 END AS w FROM (SELECT *, {_ELE} AS v FROM {oracle('towers')}))"
)
def parse_ele(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived(spark, sf_dir, "towers")
    return t.select("id", F.round(text.parse_ele("ele_text"), 6).alias("ele"), text.parse_ele("ele_text", dataset=True).alias("ele_whole"))


_HEIGHT = "(SELECT *, CASE WHEN v > 2 AND v < 700 THEN CAST(floor(v + 0.5) AS INTEGER) END AS height FROM (SELECT *, CAST(nullif(regexp_extract(regexp_replace(height_text, '^([^,]*),', '\\1.'), '[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE) * CASE WHEN regexp_matches(height_text, 'ft|feet|''') THEN 0.3048 ELSE 1 END AS v FROM " + oracle("towers") + "))"
_TOWERS = f"(SELECT *, CASE man_made WHEN 'communications_tower' THEN 'c' WHEN 'tower' THEN CASE WHEN tower_type = 'communication' THEN 'c' WHEN tower_type IN ('observation', 'lookout') THEN 'o' WHEN tower_type IN ('bell_tower', 'minaret') THEN 'b' WHEN height >= 25 THEN 'w' END WHEN 'mast' THEN CASE WHEN height >= 40 THEN 'm' END WHEN 'chimney' THEN CASE WHEN height >= 50 THEN 'h' END END AS kind FROM {_HEIGHT})"


@query(f"SELECT id, height FROM {_HEIGHT}")
def parse_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "towers").select("id", text.parse_height("height_text").alias("height"))


def _towers(spark, sf_dir) -> DataFrame:
    t = derived(spark, sf_dir, "towers").withColumn("height", text.parse_height("height_text"))
    return t.withColumn("kind", text.classify_landmark("man_made", "tower_type", "height"))


@query(f"SELECT id, kind, height FROM {_TOWERS}")
def classify_landmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _towers(spark, sf_dir).select("id", "kind", "height")


_QUERIES = "(SELECT CAST(n_nationkey AS BIGINT) AS q_id, lower(substr(n_name, 1, 2)) AS q FROM nation UNION ALL SELECT CAST(100 + r_regionkey AS BIGINT), lower(substr(r_name, 2, 2)) FROM region)"
_NAMES = "(SELECT c_custkey AS id, 0 AS fame, FALSE AS visible, CAST(NULL AS DOUBLE) AS ele, strip_accents(lower(c_mktsegment)) AS f FROM customer UNION ALL SELECT p_partkey + 100000000, p_partkey % 80, FALSE, p_retailprice, strip_accents(lower(p_name)) FROM part)"
_SCORE = "CASE WHEN f = q THEN 3.0 WHEN starts_with(f, q) THEN 2.0 WHEN len(list_filter(regexp_split_to_array(f, '[\\s\\-''’/]+'), lambda w: starts_with(w, q))) > 0 THEN 1.5 WHEN contains(f, q) THEN 1.0 ELSE 0.0 END"


@query(f"SELECT q_id, id, CAST(score AS DOUBLE) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, fame DESC, ele DESC NULLS LAST, id) AS rank FROM (SELECT *, {_SCORE} AS score FROM {_NAMES}, {_QUERIES}) WHERE score > 0) WHERE rank <= 8")
def fold_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    names = read("customer").selectExpr("c_custkey AS id", "c_mktsegment AS name", "0L AS fame", "CAST(NULL AS DOUBLE) AS ele")
    names = names.union(read("part").selectExpr("p_partkey + 100000000", "p_name", "p_partkey % 80", "p_retailprice"))
    asked = read("nation").selectExpr("CAST(n_nationkey AS BIGINT) AS q_id", "substr(n_name, 1, 2) AS q").union(read("region").selectExpr("CAST(100 + r_regionkey AS BIGINT)", "substr(r_name, 2, 2)"))
    found = search.search_peaks(names.withColumns({"names": F.array("name"), "visible": F.lit(False)}), asked, 8)
    return found.select("q_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT p.id, CAST(CASE WHEN p.qid IS NULL THEN 0 ELSE coalesce(f.n, 1) END AS BIGINT) AS fame FROM {oracle('peaks')} p LEFT JOIN {oracle('fame')} f ON p.qid = f.qid")
def fame_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dataset.fame_join(derived(spark, sf_dir, "peaks"), derived(spark, sf_dir, "fame"))
    return out.select("id", F.col("fame").cast("long").alias("fame"))


@query(f"SELECT qid, CAST(ceil(row_number() OVER (ORDER BY substr(sha1(qid), 1, 3), qid) / 400.0) AS BIGINT) AS batch FROM (SELECT DISTINCT qid FROM {oracle('peaks')} WHERE qid IS NOT NULL AND qid NOT IN (SELECT qid FROM {oracle('fame')}))")
def missing_fame_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.missing_fame(derived(spark, sf_dir, "peaks"), derived(spark, sf_dir, "fame"))


_PAIR = f"(SELECT a.id AS a_id, b.id AS b_id, a.kind <> b.kind AS mixed, a.name = b.name AS same, coalesce(abs(a.ele - b.ele) <= 15, FALSE) AS near_ele, {g.flat('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d FROM (SELECT *, unnest([-1, 0, 1]) AS di FROM {oracle('peaks')}) a JOIN {oracle('peaks')} b ON floor(b.lat / 0.02) = floor(a.lat / 0.02) + a.di AND abs(floor(b.lon / 0.02) - floor(a.lon / 0.02)) <= 1 AND a.id < b.id)"


@query(f"SELECT a_id, b_id FROM {_PAIR} WHERE (mixed OR same) AND d <= 300 OR (same OR mixed AND near_ele) AND d <= 2000")
def duplicate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.duplicate_candidates(derived(spark, sf_dir, "peaks"))


def _merged(spark, sf_dir) -> tuple[DataFrame, int]:
    p = derived(spark, sf_dir, "peaks").withColumns({"ordinal": F.col("id"), "names": F.create_map(F.lit("de"), F.col("name"))})
    return dataset.merge_duplicates(p, derived(spark, sf_dir, "fame"))


@query()
def merge_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[0].select("id", "name", "lat", "lon", "ele", "kind", "qid", "fame")


@query()
def merged_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many peaks are left, and how many were merged into others."""
    rows, merged = _merged(spark, sf_dir)
    return rows.agg(F.count("*").alias("peaks"), F.lit(merged).cast("long").alias("merged"))


_TILE = f"(SELECT concat(CAST(CAST(floor(lat) AS BIGINT) AS VARCHAR), '_', CAST(CAST(floor(lon) AS BIGINT) AS VARCHAR)) AS tile, * FROM {oracle('peaks')})"


@query(
    f"SELECT p.id, p.name, round(lat, 5) AS lat, round(lon, 5) AS lon, ele, CASE WHEN p.qid IS NULL THEN 0 ELSE coalesce(f.n, 1) END AS fame, p.qid FROM {oracle('peaks')} p LEFT JOIN {oracle('fame')} f ON f.qid = p.qid"
)
def tile_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks published as tiles and read back."""
    root = shared_dir(spark)
    peaks = dataset.fame_join(derived(spark, sf_dir, "peaks"), derived(spark, sf_dir, "fame")).withColumn("names", F.create_map(F.lit("de"), F.col("name")))
    publishing.publish(spark, root, dataset.tile_rows(peaks), "first")
    return readers.peaks_of_rows(publishing.published(spark, root), "rows").select("id", "name", "lat", "lon", "ele", "fame", "qid")


@query(f"SELECT tile, count(*) AS n, CAST(min(id) AS BIGINT) AS first_id, CAST(max(id) AS BIGINT) AS last_id FROM {_TILE} GROUP BY tile")
def tile_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = dataset.fame_join(derived(spark, sf_dir, "peaks"), derived(spark, sf_dir, "fame")).withColumn("names", F.create_map(F.lit("de"), F.col("name")))
    rows = F.from_json("rows", "array<array<string>>")
    ids = F.transform(rows, lambda r: r[0].cast("long"))
    return dataset.tile_rows(peaks).select("tile", F.size(rows).cast("long").alias("n"), F.array_min(ids).alias("first_id"), F.array_max(ids).alias("last_id"))


def _tile_of(where: str) -> str:
    return f"(SELECT tile, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS rows FROM {_TILE} WHERE {where} GROUP BY tile)"


@query(
    f"SELECT coalesce(a.tile, b.tile) AS tile, CASE WHEN b.rows IS NULL THEN 'removed' WHEN a.rows IS NULL THEN 'added' ELSE 'changed' END AS change FROM {_tile_of('id % 1000 < 700 AND id % 3000 >= 600')} a FULL JOIN {_tile_of('id % 1000 < 400 OR id % 2 = 0')} b ON a.tile = b.tile WHERE a.rows IS DISTINCT FROM b.rows"
)
def tile_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = derived(spark, sf_dir, "peaks").withColumns({"fame": F.lit(0), "names": F.lit(None).cast("map<string,string>")})
    old, new = (dataset.tile_rows(peaks.where(w)) for w in ("id % 1000 < 700 AND id % 3000 >= 600", "id % 1000 < 400 OR id % 2 = 0"))
    return dataset.tile_changes(old, new)


_LADDER = f"WITH RECURSIVE o AS (SELECT obs_id, lat, lon, radius, h0 FROM {EYES}), {g.ladder('o', 'obs_id', 'radius')}"


@query(f"{_LADDER} SELECT obs_id, count(*) AS n, round(max(d), 3) AS last_d, round(sum(d), 0) AS total FROM ladder GROUP BY obs_id")
def distance_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = derived(spark, sf_dir, "observers").withColumn("d", panorama.distance_ladder("lat", "radius"))
    total = F.round(F.aggregate("d", F.lit(0.0), lambda a, x: a + x), 0)
    return o.select("obs_id", F.size("d").cast("long").alias("n"), F.round(F.array_max("d"), 3).alias("last_d"), total.alias("total"))


AZIMUTHS = (12.5, 101.0, 190.25, 278.75)


def _rays(spark, sf_dir) -> DataFrame:
    rays = _eyes(spark, sf_dir).withColumn("az", F.explode(F.array(*map(F.lit, AZIMUTHS))))
    return panorama.scanned_rays(dealt(rays), heights)


_RAYS = _LADDER + f", rays AS (SELECT obs_id, az, d, {g.angle('h0', 'h', 'd')} AS angle FROM {g.sampled(f'(SELECT *, unnest([{", ".join(f"{a}::DOUBLE" for a in AZIMUTHS)}]) AS az FROM ladder)')})"


@query(_RAYS + " SELECT obs_id, az, round(max(angle), 6) AS angle, round(arg_max(d, angle), 3) AS dist FROM rays GROUP BY obs_id, az")
def horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _rays(spark, sf_dir)
    return h.select("obs_id", "az", F.round("angle", 6).alias("angle"), F.round("dist", 3).alias("dist"))


_BANDS_OF = " UNION ALL ".join(f"SELECT obs_id, az, {m} AS band, round(coalesce(max(angle) FILTER (WHERE d <= {m}), -90), 6) AS angle, round(arg_max(d, angle) FILTER (WHERE d <= {m}), 3) AS dist FROM rays GROUP BY obs_id, az" for m in panorama.HAZE_M)


@query(_RAYS + " " + _BANDS_OF)
def haze_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = F.explode(F.arrays_zip(F.array(*map(F.lit, panorama.HAZE_M)).alias("band"), F.col("haze").alias("h"))).alias("x")
    h = _rays(spark, sf_dir).select("obs_id", "az", bands)
    return h.select("obs_id", "az", "x.band", F.round("x.h.angle", 6).alias("angle"), F.round("x.h.dist", 3).alias("dist"))


@query(
    _RAYS
    + ", x AS (SELECT *, max(angle) OVER (PARTITION BY obs_id, az ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, row_number() OVER (PARTITION BY obs_id, az ORDER BY d) AS pos, count(*) OVER (PARTITION BY obs_id, az) AS n FROM rays), y AS (SELECT *, lead(d) OVER (PARTITION BY obs_id, az ORDER BY d) AS nd, lead(pos) OVER (PARTITION BY obs_id, az ORDER BY d) AS np FROM x WHERE top IS NULL OR angle >= top) SELECT obs_id, az, round(d, 3) AS d, round(angle, 6) AS angle FROM y WHERE np IS NULL AND pos < n OR np - pos > 1 AND nd - d > greatest(300, 0.04 * d)"
)
def extract_ridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rays(spark, sf_dir).select("obs_id", "az", F.inline("ridges"))
    return r.select("obs_id", "az", F.round("d", 3).alias("d"), F.round("angle", 6).alias("angle"))


def _viewpoints(spark, sf_dir) -> DataFrame:
    """Every tower's place as a viewpoint of 40 km."""
    t = derived(spark, sf_dir, "towers").select(F.col("id").alias("obs_id"), "lat", "lon", F.lit(40_000.0).alias("radius"))
    return t.withColumn("h0", terrain(F.col("lat"), F.col("lon")) + 1.7)


@query()
def ring_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ring of 3600 directions from every tower: horizon, both haze bands and number of ridges."""
    r = panorama.ring(_viewpoints(spark, sf_dir), heights)
    return r.select("obs_id", "az_bin", F.round("angle", 6).alias("angle"), F.round("dist", 3).alias("dist"), *[F.round(F.col("haze")[i]["angle"], 6).alias(f"haze_{m // 1000}") for i, m in enumerate(panorama.HAZE_M)], F.size("ridges").cast("long").alias("n_ridges"))


@query()
def occlusion_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each peak in range of each observer is seen."""
    v = panorama.peak_views(_eyes(spark, sf_dir), derived(spark, sf_dir, "peaks"), terrain, heights)
    return v.select("obs_id", "p_id", F.round("angle", 6).alias("angle"), F.round("occlusion", 6).alias("occlusion"), "visible")


_BIN_ANGLE = doubles("CASE WHEN (az_bin + obs_id) % 97 = 0 THEN NULL ELSE 1.5 + 1.2 * sin(radians(az_bin * 0.36) + obs_id % 7) + ((az_bin * 37 + obs_id * 11) % 50) / 50.0 END")
_HORIZON = f"(SELECT obs_id, CAST(az_bin AS INTEGER) AS az_bin, {_BIN_ANGLE} AS angle FROM (SELECT s_suppkey AS obs_id, unnest(generate_series(0, 3599)) AS az_bin FROM supplier))"


def _horizon(spark, sf_dir) -> DataFrame:
    s = dealt(spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey AS obs_id"), "obs_id").selectExpr("obs_id", "explode(sequence(0, 3599)) AS az_bin")
    return s.selectExpr("obs_id", "az_bin", f"{_BIN_ANGLE} AS angle")


_TARGETS = doubles("SELECT l_orderkey, l_linenumber, l_suppkey AS obs_id, (l_orderkey * 7919 % 36000) / 100.0 AS az, (l_partkey % 500) / 100.0 AS angle, l_partkey % 4 > 0 AS visible FROM {lineitem}")


@query(
    f"WITH h AS (SELECT obs_id, az_bin, coalesce(angle, '-inf'::DOUBLE) AS a FROM {_HORIZON}), ring AS (SELECT * FROM h UNION ALL SELECT obs_id, az_bin - 3600, a FROM h WHERE az_bin >= 3585 UNION ALL SELECT obs_id, az_bin + 3600, a FROM h WHERE az_bin < 15), low AS (SELECT *, min(a) OVER (PARTITION BY obs_id ORDER BY az_bin ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS l, min(a) OVER (PARTITION BY obs_id ORDER BY az_bin ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING) AS r FROM ring) SELECT l_orderkey, l_linenumber, round(CASE WHEN visible AND NOT (l = '-inf' AND r = '-inf') THEN greatest(0, least(angle - l, angle - r)) ELSE 0 END, 6) AS relief FROM ({_TARGETS.replace('{lineitem}', 'lineitem')}) t JOIN low ON low.obs_id = t.obs_id AND low.az_bin = CAST(floor(az / 0.1 + 0.5) AS BIGINT) % 3600"
)
def skyline_relief(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.sql(_TARGETS, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    out = panorama.skyline_relief(t.withColumns({"az": F.col("az").cast("double"), "angle": F.col("angle").cast("double")}), _horizon(spark, sf_dir))
    return out.select("l_orderkey", "l_linenumber", F.round("relief", 6).alias("relief"))


_LINES = doubles("SELECT l_suppkey AS obs_id, l_orderkey AS line_id, l_linenumber AS seq, CAST((l_orderkey * 7919 + l_linenumber * (1 + l_orderkey % 3)) % 3600 AS INTEGER) AS az_bin, (l_partkey % 300) / 100.0 AS angle FROM {lineitem}")


@query(
    f"SELECT obs_id, line_id, n, round(span, 6) AS span, touches FROM (SELECT l.obs_id, line_id, count(*) AS n, ((arg_max(l.az_bin, seq) - arg_min(l.az_bin, seq) + 3600) % 3600) * 0.1 AS span, coalesce(bool_or(l.angle >= h.angle - 1e-3), FALSE) AS touches FROM ({_LINES.replace('{lineitem}', 'lineitem')}) l LEFT JOIN {_HORIZON} h ON l.obs_id = h.obs_id AND l.az_bin = h.az_bin GROUP BY l.obs_id, line_id) WHERE span >= 0.8 - 1e-9 OR touches"
)
def prune_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.sql(_LINES, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    out = panorama.prune_lines(lines, _horizon(spark, sf_dir))
    return out.select("obs_id", "line_id", "n", F.round("span", 6).alias("span"), "touches")


@query()
def link_ridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _horizon(spark, sf_dir).where("angle IS NOT NULL AND az_bin % 5 < 4").withColumn("dist", 5000.0 + F.col("obs_id") % 9 * 500 + F.col("az_bin") % 50)
    return panorama.link_ridges(points)


_made: dict[tuple, DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """The written result of make(spark, sf_dir): several queries read it."""
    key = (spark.sparkContext.applicationId, sf_dir, make.__name__)
    if key not in _made:
        _made[key] = written(make(spark, sf_dir))
    return _made[key]


def _raster(spark, sf_dir) -> DataFrame:
    """Tiles of the landscape, with halos, for all that towers see within 40 km."""
    return dem.with_halo(dem.tiles_of(dealt(raster_rays.tiles_for_rays(_viewpoints(spark, sf_dir))), heights))


def _raster_eyes(spark, sf_dir) -> DataFrame:
    return raster_rays.eyes_on(_viewpoints(spark, sf_dir).drop("h0"), _once(spark, sf_dir, _raster))


def _raster_ring(spark, sf_dir) -> DataFrame:
    return raster_rays.ring_on(_once(spark, sf_dir, _raster_eyes), _once(spark, sf_dir, _raster))


def _raster_peaks(spark, sf_dir) -> DataFrame:
    return raster_rays.peak_views_on(_once(spark, sf_dir, _raster_eyes), derived(spark, sf_dir, "peaks"), _once(spark, sf_dir, _raster))


@query()
def raster_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ring_horizon from raster tiles instead of the formula."""
    r = _once(spark, sf_dir, _raster_ring)
    return r.select("obs_id", "az_bin", F.round("angle", 6).alias("angle"), F.round("dist", 3).alias("dist"), *[F.round(F.col("haze")[i]["angle"], 6).alias(f"haze_{m // 1000}") for i, m in enumerate(panorama.HAZE_M)], F.size("ridges").cast("long").alias("n_ridges"))


@query()
def raster_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks in range of each tower, seen or not over raster tiles, with their prominence over the ring and label score."""
    views = panorama.skyline_relief(_once(spark, sf_dir, _raster_peaks), _once(spark, sf_dir, _raster_ring))
    score = spatial.label_score(F.col("p_id") % 80, F.col("relief"), F.col("ele"))
    return views.select("obs_id", "p_id", F.round("angle", 6).alias("angle"), F.round("occlusion", 6).alias("occlusion"), "visible", F.round("relief", 6).alias("relief"), F.round(score, 6).alias("score"))


@query()
def raster_visible_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many peaks each tower has in range, and sees."""
    return panorama.visible_count(_once(spark, sf_dir, _raster_peaks))


@query()
def raster_ridge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge lines round every tower: ridge points of the ring linked, short ones below the skyline left out."""
    ring = _once(spark, sf_dir, _raster_ring)
    points = ring.select("obs_id", "az_bin", F.inline("ridges")).withColumnRenamed("d", "dist")
    kept = panorama.prune_lines(panorama.link_ridges(points), ring)
    return kept.select("obs_id", "line_id", "n", F.round("span", 6).alias("span"), "touches")


@query()
def raster_sun_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the sun rises and sets over each tower's own skyline on a day of its year."""
    steps = _once(spark, sf_dir, _raster_eyes).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(144))))
    path = sky.sun_position(spark.sql(_DAY, steps=steps))
    out = panorama.terrain_events(path, _once(spark, sf_dir, _raster_ring), ["obs_id"])
    return out.select("obs_id", F.round("rise", 4).alias("rise"), F.round("set", 4).alias("set"))


@query()
def raster_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Towers that stand out of the terrain of the tiles, seen from every tower."""
    towers = _towers(spark, sf_dir).where("kind IS NOT NULL").select("id", "lat", "lon", "kind", "height")
    v = raster_rays.landmark_views_on(_once(spark, sf_dir, _raster_eyes), towers, _once(spark, sf_dir, _raster))
    return v.select("obs_id", "p_id", F.round("az", 6).alias("az"), F.round("dist", 3).alias("dist"), F.round("base", 6).alias("base"), F.round("top", 6).alias("top"), "height_known")


def _rounded(df: DataFrame, key: list[str], *columns: str) -> DataFrame:
    return df.select(*key, *[F.round(c, 6).alias(c) for c in columns])


@query(f"SELECT id, round(az, 6) AS az, round(alt, 6) AS alt FROM {nested(oracle('times'), sky.SUN_STEPS)}")
def sun_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sky.sun_position(derived(spark, sf_dir, "times")), ["id"], "az", "alt")


@query(f"SELECT id, round(az, 6) AS az, round(alt, 6) AS alt, round(fraction, 6) AS fraction, waxing, round(moon_dist, 3) AS moon_dist FROM {nested(oracle('times'), sky.MOON_STEPS)}")
def moon_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = sky.moon_position(derived(spark, sf_dir, "times"))
    return m.select("id", F.round("az", 6).alias("az"), F.round("alt", 6).alias("alt"), F.round("fraction", 6).alias("fraction"), "waxing", F.round("moon_dist", 3).alias("moon_dist"))


_STARS = doubles("SELECT *, (id * 7919 % 36000) / 100.0 AS ra2000, (id * 104729 % 17000) / 100.0 - 85 AS dec2000 FROM {times}")


@query(f"SELECT id, round(az, 6) AS az, round(alt, 6) AS alt FROM {nested('(' + _STARS.replace('{times}', oracle('times')) + ')', sky.STAR_STEPS)}")
def star_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    stars = spark.sql(_STARS, times=derived(spark, sf_dir, "times"))
    return _rounded(sky.star_position(stars), ["id"], "az", "alt")


@query()
def planet_equatorial(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, sky.MAGNITUDES))
    t = derived(spark, sf_dir, "times").withColumn("planet", F.element_at(names, (F.col("id") % 5 + 1).cast("int")))
    return t.withColumn("p", sky.planet_equatorial("planet", "jd")).select("id", "planet", "p.ra", "p.dec", "p.mag")


_DAY = doubles("SELECT obs_id, lat, lon, 2461120.5 + obs_id % 300 + step / 144.0 AS jd, step AS t FROM {steps}")
_PATH = nested("(" + _DAY.replace("{steps}", f"(SELECT *, unnest(generate_series(0, 144)) AS step FROM {oracle('observers')})") + ")", sky.SUN_STEPS)
_SUPPLIERS = "(SELECT count(*) FROM supplier)"


@query(
    f"SELECT obs_id, round(min(CASE WHEN o0 < 0 AND over >= 0 THEN t0 + (t - t0) * o0 / (o0 - over) END), 4) AS rise, round(max(CASE WHEN o0 >= 0 AND over < 0 THEN t0 + (t - t0) * o0 / (o0 - over) END), 4) AS set FROM (SELECT *, lag(over) OVER (PARTITION BY obs_id ORDER BY t) AS o0, lag(t) OVER (PARTITION BY obs_id ORDER BY t) AS t0 FROM (SELECT p.obs_id, t, alt - h.angle AS over FROM {_PATH} p LEFT JOIN {_HORIZON} h ON h.obs_id = p.obs_id % {_SUPPLIERS} + 1 AND h.az_bin = CAST(floor(az / 0.1 + 0.5) AS BIGINT) % 3600)) GROUP BY obs_id"
)
def terrain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = derived(spark, sf_dir, "observers").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(144))))
    path = sky.sun_position(spark.sql(_DAY, steps=steps).withColumnRenamed("obs_id", "who"))
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    path = path.withColumn("obs_id", F.col("who") % n + 1)
    out = panorama.terrain_events(path, _horizon(spark, sf_dir), ["who"])
    return out.select(F.col("who").alias("obs_id"), F.round("rise", 4).alias("rise"), F.round("set", 4).alias("set"))


_ORBIT = doubles("SELECT s_suppkey AS obs_id, s_nationkey AS sat, 45.0 + s_suppkey % 9 AS lat, 6.0 + s_suppkey % 7 AS lon, t, 2461120.5 + t / 86400.0 AS jd, 6790 * cos(t / 886.0 + s_nationkey) AS x, 6790 * sin(t / 886.0 + s_nationkey) * cos(radians(51.6)) AS y, 6790 * sin(t / 886.0 + s_nationkey) * sin(radians(51.6)) AS z FROM {steps}")
_LOOKS = nested("(" + _ORBIT.replace("{steps}", "(SELECT *, unnest(generate_series(0, 86370, 30)) AS t FROM supplier)") + ")", sky.SAT_STEPS)


@query(
    f'SELECT obs_id, sat, CAST(pass AS BIGINT) AS pass, CAST(min(t) AS BIGINT) AS rise, CAST(max(t) AS BIGINT) AS set, round(max(alt), 6) AS max_alt, bool_or(sunlit) AS sunlit FROM (SELECT *, sum(start) OVER (PARTITION BY obs_id, sat ORDER BY t) AS pass FROM (SELECT *, CASE WHEN alt > 0 AND NOT coalesce(lag(alt > 0) OVER (PARTITION BY obs_id, sat ORDER BY t), FALSE) THEN 1 ELSE 0 END AS start FROM {_LOOKS})) WHERE alt > 0 GROUP BY obs_id, sat, pass'
)
def sat_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = spark.read.parquet(f"{sf_dir}/supplier.parquet").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(86370), F.lit(30))))
    looks = sky.sat_look(spark.sql(_ORBIT, steps=steps)).withColumn("sun_alt", F.lit(-90.0))
    out = panorama.sat_passes(looks, ["obs_id", "sat"])
    return out.select("obs_id", "sat", "pass", F.col("rise").cast("long").alias("rise"), F.col("set").cast("long").alias("set"), F.round("max_alt", 6).alias("max_alt"), F.col("visible").alias("sunlit"))


def _angles(spark, sf_dir) -> DataFrame:
    return sensors.view_angles(derived(spark, sf_dir, "orient"))


_ANGLES = nested(oracle("orient"), sensors.VIEW_STEPS)


@query(f"SELECT device_id, t_ms, round(heading, 6) AS heading, round(pitch, 6) AS pitch, round(roll, 6) AS roll FROM {_ANGLES}")
def view_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_angles(spark, sf_dir), ["device_id", "t_ms"], "heading", "pitch", "roll")


_STEP = f"CASE WHEN lag(alpha) OVER w IS NULL THEN alpha ELSE {g.delta('alpha', 'lag(alpha) OVER w')} END"


@query(
    f"SELECT device_id, t_ms, round(u, 4) AS unwrapped, round(CASE WHEN count(*) OVER v >= 10 THEN stddev_pop(beta) OVER v END, 5) AS pitch_std FROM (SELECT *, sum(s) OVER (PARTITION BY device_id ORDER BY t_ms ROWS UNBOUNDED PRECEDING) AS u FROM (SELECT *, {_STEP} AS s FROM {oracle('orient')} WINDOW w AS (PARTITION BY device_id ORDER BY t_ms))) WINDOW v AS (PARTITION BY device_id ORDER BY t_ms RANGE BETWEEN 2000 PRECEDING AND CURRENT ROW)"
)
def unwrap_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = derived(spark, sf_dir, "orient").select("device_id", F.col("t_ms").cast("long").alias("t_ms"), F.col("alpha").alias("heading"), F.col("beta").cast("double").alias("pitch"), F.lit(0.0).alias("roll"))
    x = sensors.unwrapped(sensors.angle_noise(o), "heading", ["device_id"], ["t_ms"])
    return x.select("device_id", "t_ms", F.round("heading_unwrapped", 4).alias("unwrapped"), F.round("pitch_std", 5).alias("pitch_std"))


_UPDATES = doubles("SELECT user_id AS key, CASE WHEN event_id % 5 > 0 THEN value * 0.03 END AS heading, CASE WHEN event_id % 3 > 0 THEN event_id % 7 - 3.0 END AS pitch, 0.5 + event_id % 2 AS weight, event_id * 100000 AS t_ms FROM {events}")
_W = "weight * pow(0.5, (5000000000 - t_ms) / 1814400000.0)"


@query(
    f"SELECT key, round(CASE WHEN hw >= 3 THEN degrees(atan2(hs, hc)) END, 6) AS heading, round(CASE WHEN pw >= 3 THEN ps / pw END, 6) AS pitch, round(greatest(hw, pw), 6) AS n FROM (SELECT key, sum({_W} * sin(radians(heading))) AS hs, sum({_W} * cos(radians(heading))) AS hc, coalesce(sum({_W}) FILTER (WHERE heading IS NOT NULL), 0) AS hw, sum({_W} * pitch) AS ps, coalesce(sum({_W}) FILTER (WHERE pitch IS NOT NULL), 0) AS pw FROM ({_UPDATES.replace('{events}', 'events')}) GROUP BY key) WHERE greatest(hw, pw) >= 3"
)
def sensor_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = spark.sql(_UPDATES, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return _rounded(sensors.sensor_profile(u, F.lit(5_000_000_000)), ["key"], "heading", "pitch", "n")


_TILT = doubles("SELECT user_id AS key, (event_id % 300) / 10.0 - 15 AS axis, (user_id % 9 - 4) / 20.0 * ((event_id % 300) / 10.0 - 15) + (event_id % 5) / (10.0 + user_id % 40) AS pitch FROM {events}")


@query(
    f"SELECT key, round(1 + k, 6) AS scale, round(my - k * mx, 6) AS pitch FROM (SELECT key, covar_pop(axis, pitch) / var_pop(axis) AS k, sqrt(greatest(0, var_pop(pitch) - covar_pop(axis, pitch) / var_pop(axis) * covar_pop(axis, pitch))) AS rms, avg(axis) AS mx, avg(pitch) AS my, count(*) AS n, max(axis) - min(axis) AS spread FROM ({_TILT.replace('{events}', 'events')}) GROUP BY key) WHERE n >= 8 AND spread >= 8 AND rms <= 0.25 AND abs(k) <= 0.3"
)
def fit_tilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.sql(_TILT, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    t = t.select("key", F.col("axis").cast("double").alias("axis"), F.col("pitch").cast("double").alias("pitch"))
    return _rounded(sensors.fit_tilt(t, "key"), ["key"], "scale", "pitch")


_FRAMES = doubles("SELECT device_id, t_ms, alpha / 20 AS heading, beta / 30 AS pitch FROM {orient}")


@query(
    f"SELECT device_id, t_ms, CASE WHEN dh < 1.5 AND dp < 1 THEN 'steady' WHEN dh < 6 AND dp < 2 THEN 'moving' ELSE 'skip' END AS gate FROM (SELECT *, abs({g.delta('heading', 'lag(heading) OVER w')}) AS dh, abs(pitch - lag(pitch) OVER w) AS dp FROM ({_FRAMES.replace('{orient}', oracle('orient'))}) WINDOW w AS (PARTITION BY device_id ORDER BY t_ms))"
)
def frame_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spark.sql(_FRAMES, orient=derived(spark, sf_dir, "orient"))
    return sensors.frame_gate(f).select("device_id", "t_ms", "gate")


@query(
    f"WITH a AS (SELECT device_id, CAST(t_ms AS BIGINT) AS t_ms, alpha FROM {oracle('orient')}), f AS (SELECT device_id, t_ms * 2 - 400 AS t_ms FROM a), m AS (SELECT f.device_id, f.t_ms, lo.t_ms AS t0, lo.alpha AS a0 FROM f ASOF LEFT JOIN a lo ON f.device_id = lo.device_id AND f.t_ms >= lo.t_ms), n AS (SELECT m.*, hi.t_ms AS t1, hi.alpha AS a1 FROM m ASOF LEFT JOIN a hi ON m.device_id = hi.device_id AND m.t_ms <= hi.t_ms) SELECT device_id, t_ms, round({g.norm('coalesce(a0, a1) + CASE WHEN t1 > t0 THEN (t_ms - t0) / (t1 - t0)::DOUBLE ELSE 0 END * ' + g.delta('coalesce(a1, a0)', 'coalesce(a0, a1)'))}, 6) AS heading FROM n"
)
def as_of_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = derived(spark, sf_dir, "orient").select("device_id", F.col("t_ms").cast("long").alias("t_ms"), F.col("alpha").alias("heading"), F.lit(0.0).alias("pitch"), F.lit(0.0).alias("roll"))
    f = a.select("device_id", (F.col("t_ms") * 2 - 400).alias("t_ms"), F.col("t_ms").alias("frame_id"))
    return _rounded(sensors.as_of_angles(f, a), ["device_id", "t_ms"], "heading")


_POINTS = doubles("SELECT user_id AS device_id, event_id AS t_ms, value * 3.7 - 360 * floor(value * 3.7 / 360) AS az, event_id % 101 / 10.0 + event_id / 1e6 AS el FROM {events}")


@query(f"SELECT device_id, CAST(floor(az / 0.5) AS INTEGER) % 720 AS bin, round(min(el), 6) AS el, round(arg_min(az, el), 6) AS az FROM ({_POINTS.replace('{events}', 'events')}) WHERE t_ms <= 80000 AND t_ms > -10000 GROUP BY 1, 2")
def panorama_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.sql(_POINTS, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    p = p.select("device_id", "t_ms", "az", F.col("el").cast("double").alias("el"))
    return _rounded(sensors.panorama_profile(p, F.lit(80_000)), ["device_id", "bin"], "el", "az")


_BANDS = doubles("SELECT l_orderkey AS frame_id, l_linenumber AS band, (l_partkey % 100) / 500.0 + l_suppkey / 1e6 AS cost, (l_partkey % 30) / 20.0 AS d_heading, (l_suppkey % 20) / 50.0 AS d_pitch, l_partkey % 3 > 0 AS ok FROM {lineitem}")


@query(
    f"WITH b AS ({_BANDS.replace('{lineitem}', 'lineitem')}), best AS (SELECT * FROM b WHERE ok QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY cost, band) = 1), rival AS (SELECT DISTINCT x.frame_id FROM best x JOIN b y ON x.frame_id = y.frame_id AND y.ok AND (abs({g.delta('x.d_heading', 'y.d_heading')}) >= 0.7 OR abs(x.d_pitch - y.d_pitch) >= 0.3) AND y.cost < 1.6 * x.cost) SELECT frame_id, CAST(band AS INTEGER) AS band, round(cost, 6) AS cost, frame_id NOT IN (SELECT frame_id FROM rival) AS ok FROM best"
)
def haze_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vistaframe.operators.align import match_skyline_haze

    b = spark.sql(_BANDS, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    b = b.withColumns({c: F.col(c).cast("double") for c in ("cost", "d_heading", "d_pitch")})
    out = match_skyline_haze(b)
    return out.select("frame_id", F.col("band").cast("int").alias("band"), F.round("cost", 6).alias("cost"), "ok")


_SEEN = f"e AS (SELECT *, row_number() OVER w AS n, CASE WHEN kind = 'compass' AND t_ms - last_value(CASE WHEN kind = 'gyro' THEN t_ms END IGNORE NULLS) OVER w <= 200 THEN {g.delta('heading', 'gyro')} END AS seen FROM (SELECT *, last_value(CASE WHEN kind = 'gyro' THEN heading END IGNORE NULLS) OVER v AS gyro FROM (SELECT device_id, CAST(t_ms AS BIGINT) AS t_ms, CASE WHEN event_id % 3 = 0 THEN 'compass' ELSE 'gyro' END AS kind, alpha AS heading FROM {oracle('orient')}) WINDOW v AS (PARTITION BY device_id ORDER BY t_ms)) WINDOW w AS (PARTITION BY device_id ORDER BY t_ms))"


@query(
    f"WITH RECURSIVE {_SEEN}, r AS (SELECT device_id, t_ms AS now_ms, n, kind, heading, CAST(NULL AS DOUBLE) AS off, CAST(NULL AS BIGINT) AS off_t FROM e WHERE e.n = 1 UNION ALL SELECT e.device_id, e.t_ms, e.n, e.kind, e.heading, CASE WHEN e.seen IS NULL THEN r.off WHEN r.off IS NULL THEN e.seen ELSE r.off + {g.delta('e.seen', 'r.off')} * (1 - exp(-least(1, (e.t_ms - r.off_t) / 1000.0::DOUBLE) / 4)) END, CASE WHEN e.seen IS NULL THEN r.off_t ELSE e.t_ms END FROM r JOIN e ON e.device_id = r.device_id AND e.n = r.n + 1) SELECT device_id, now_ms AS t_ms, round({g.norm('heading + off')}, 6) AS fused FROM r WHERE kind = 'gyro'"
)
def heading_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = derived(spark, sf_dir, "orient")
    kind = F.when(F.col("event_id") % 3 == 0, "compass").otherwise("gyro")
    out = fusion.heading_fusion(o.select("device_id", F.col("t_ms").cast("long").alias("t_ms"), kind.alias("kind"), F.col("alpha").alias("heading")))
    return out.withColumn("fused", F.round("fused", 6))


def _smoothed(seen: str, at: str, speed: str, cut: float) -> tuple[str, str]:
    """SQL of the next speed and the next value of a smoothed one; e.dt is the time passed."""
    share = lambda hz: f"(1 - exp(-2 * pi() * ({hz}) * e.dt))"
    faster = f"({speed} + {share('0.3::DOUBLE')} * (({seen} - {at}) / e.dt - {speed}))"
    return faster, f"{at} + {share(f'{cut}::DOUBLE + 0.01::DOUBLE * abs({faster})')} * ({seen} - {at})"


_TURNED = f"(r.turned + {g.delta('e.heading', 'r.turned')})"
_SMOOTH = {c: _smoothed(seen, f"r.{c}", f"r.v_{c}", cut) for c, seen, cut in (("h", _TURNED, 0.06), ("p", "e.pitch", 0.15), ("o", "e.roll", 0.1))}


@query(
    f"WITH RECURSIVE e AS (SELECT device_id, CAST(t_ms AS BIGINT) AS t_ms, heading, pitch, roll, row_number() OVER w AS n, least(0.2::DOUBLE, greatest(0.001::DOUBLE, (t_ms - lag(t_ms) OVER w) / 1000.0::DOUBLE)) AS dt FROM {_ANGLES} WINDOW w AS (PARTITION BY device_id ORDER BY t_ms)), r AS (SELECT device_id, t_ms AS now_ms, n, heading AS turned, heading AS h, pitch AS p, roll AS o, 0::DOUBLE AS v_h, 0::DOUBLE AS v_p, 0::DOUBLE AS v_o FROM e WHERE e.n = 1 UNION ALL SELECT e.device_id, e.t_ms, e.n, {_TURNED}, {', '.join(v[1] for v in _SMOOTH.values())}, {', '.join(v[0] for v in _SMOOTH.values())} FROM r JOIN e ON e.device_id = r.device_id AND e.n = r.n + 1) SELECT device_id, now_ms AS t_ms, round({g.norm('h')}, 6) AS heading, round(p, 6) AS pitch, round(o, 6) AS roll FROM r"
)
def smooth_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.smooth_angles(_angles(spark, sf_dir).select("device_id", F.col("t_ms").cast("long").alias("t_ms"), "heading", "pitch", "roll"))
    return _rounded(out, ["device_id", "t_ms"], "heading", "pitch", "roll")


@query()
def landmark_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    towers = _towers(spark, sf_dir).where("kind IS NOT NULL").select("id", "lat", "lon", "kind", "height")
    v = panorama.landmark_views(_eyes(spark, sf_dir), towers, terrain, heights)
    return v.select("obs_id", "p_id", F.round("az", 6).alias("az"), F.round("dist", 3).alias("dist"), F.round("base", 6).alias("base"), F.round("top", 6).alias("top"), "height_known")


@query()
def dem_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of the orders' places from zoom-10 tiles of the landscape round the observers."""
    import numpy as np

    tiles = derived(spark, sf_dir, "observers").select(F.explode(geo.tiles_covering("lat", "lon", "radius", 10)).alias("t"))
    keys = tiles.select(F.lit(10).alias("z"), F.col("t.x").cast("int").alias("x"), F.col("t.y").cast("int").alias("y")).distinct()
    raster = dem.with_halo(dem.tiles_of(keys, lambda lat, lon: 1000 + 800 * np.sin(lat * 40) * np.cos(lon * 35)))
    points = derived(spark, sf_dir, "times").select("id", "lat", "lon")
    return dem.sample_dem(points, raster, 10).select("id", F.round("h", 3).alias("h"))


@query()
def search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks (parts) and sky objects (suppliers as stars) that match the names of nations and regions."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    peaks = read("part").selectExpr("p_partkey AS id", "array(p_name) AS names", "p_partkey % 80 AS fame", "false AS visible", "p_retailprice AS ele")
    objects = read("supplier").selectExpr("CAST(s_suppkey AS STRING) AS id", "s_name AS name", "'star' AS kind", "s_suppkey % 60 / 10D AS mag")
    asked = read("nation").selectExpr("CAST(n_nationkey AS BIGINT) AS q_id", "substr(n_name, 1, 2) AS q").union(read("region").selectExpr("CAST(100 + r_regionkey AS BIGINT)", "substr(r_name, 2, 2)"))
    return search.search_all(peaks, objects, asked)


def _covering(zoom: int, radius: str) -> str:
    n = 2**zoom
    px = f"SELECT floor(({g.dest_lon('lat', 'lon', '270', 'rad')} + 180) / 360 * {n}) AS x0, floor(({g.dest_lon('lat', 'lon', '90', 'rad')} + 180) / 360 * {n}) AS x1, floor({g.merc_y('n')} * {n}) AS y0, floor({g.merc_y('s')} * {n}) AS y1 FROM (SELECT *, {g.dest_lat('lat', '0', 'rad')} AS n, {g.dest_lat('lat', '180', 'rad')} AS s FROM (SELECT *, {radius} AS rad FROM {oracle('observers')}))"
    return f"SELECT 'dem' AS kind, concat('{zoom}/', x, '/', y) AS key FROM (SELECT x, unnest(generate_series(CAST(y0 AS BIGINT), CAST(y1 AS BIGINT))) AS y FROM (SELECT *, unnest(generate_series(CAST(x0 AS BIGINT), CAST(x1 AS BIGINT))) AS x FROM ({px})))"


@query(f"{_covering(12, 'least(radius, 8000)')} UNION {_covering(10, 'radius')} UNION SELECT 'peaks', concat(ty, '_', tx) FROM {g.tiles(oracle('observers'))} WHERE concat(ty, '_', tx) IN (SELECT tile FROM {_TILE})")
def prefetch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = derived(spark, sf_dir, "peaks").select(geo.tile_key("lat", "lon").alias("tile")).distinct()
    return spatial.prefetch_plan(derived(spark, sf_dir, "observers"), peaks)


@query(
    f"SELECT obs_id, lat, lon, least(250000, greatest(10000, radius)) AS radius, 1.7::DOUBLE AS eye_height FROM (SELECT obs_id, CASE WHEN obs_id % 13 = 0 THEN lat * 2 ELSE lat END AS lat, lon, radius * (obs_id % 4) AS radius FROM {oracle('observers')}) WHERE abs(lat) <= 85"
)
def valid_observers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = derived(spark, sf_dir, "observers").selectExpr("obs_id", "IF(obs_id % 13 = 0, lat * 2, lat) AS lat", "lon", "radius * (obs_id % 4) AS radius")
    return spatial.valid_observers(o)


@query(f"SELECT device_id, CASE floor(alpha / 22.5 + 0.5) % 16 WHEN 0 THEN 'N' WHEN 1 THEN 'NNE' WHEN 2 THEN 'NE' WHEN 3 THEN 'ENE' WHEN 4 THEN 'E' WHEN 5 THEN 'ESE' WHEN 6 THEN 'SE' WHEN 7 THEN 'SSE' WHEN 8 THEN 'S' WHEN 9 THEN 'SSW' WHEN 10 THEN 'SW' WHEN 11 THEN 'WSW' WHEN 12 THEN 'W' WHEN 13 THEN 'WNW' WHEN 14 THEN 'NW' ELSE 'NNW' END AS sector, count(*) AS n FROM {oracle('orient')} GROUP BY 1, 2")
def compass_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "orient").groupBy("device_id", text.compass_sector("alpha").alias("sector")).agg(F.count("*").alias("n"))


@query(f"SELECT tile, count(*) AS n, count(DISTINCT qid) AS qids FROM {_TILE} GROUP BY tile")
def peaks_per_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived(spark, sf_dir, "peaks")
    return p.groupBy(geo.tile_key("lat", "lon").alias("tile")).agg(F.count("*").alias("n"), F.countDistinct("qid").alias("qids"))


@query(
    f"SELECT o.obs_id, arg_min(p.ele, (d, p.id)) AS peak_ele FROM {oracle('observers')} o LEFT JOIN (SELECT o.obs_id, p.id, p.ele, {g.distance('o.lat', 'o.lon', 'p.lat', 'p.lon')} AS d FROM {oracle('observers')} o JOIN {oracle('peaks')} p ON floor(o.lat) = floor(p.lat) AND floor(o.lon) = floor(p.lon) WHERE p.ele IS NOT NULL) p ON p.obs_id = o.obs_id AND d <= 80 GROUP BY o.obs_id"
)
def summit_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.summit_snap(derived(spark, sf_dir, "observers"), derived(spark, sf_dir, "peaks")).select("obs_id", "peak_ele")


_HERE = g.terrain("lat", "lon")


def _around(r: int) -> list[str]:
    return [g.terrain(g.dest_lat("lat", str(az), str(r)), g.dest_lon("lat", "lon", str(az), str(r))) for az in range(0, 360, 45)]


@query(
    f"SELECT obs_id, round(CASE WHEN lower >= 6 THEN greatest(c, top) ELSE c END, 6) AS ground FROM (SELECT obs_id, {g.terrain('lat', 'lon')} AS c, {' + '.join(f'({t} < {_HERE} - 1)::INTEGER' for t in _around(60))} AS lower, greatest({', '.join(t for r in (10, 20, 30, 40) for t in _around(r))}) AS top FROM {oracle('observers')})"
)
def observer_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panorama.observer_ground(derived(spark, sf_dir, "observers"), terrain).select("obs_id", F.round("ground", 6).alias("ground"))


@query()
def label_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skyline silhouettes of the orders of supplier horizons, 160 columns each."""
    from vistaframe.operators.align import label_strip as strip

    frames = spark.read.parquet(f"{sf_dir}/customer.parquet")
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    frames = frames.selectExpr("c_custkey AS frame_id", f"c_custkey % {n} + 1 AS obs_id", "'full' AS band", "c_custkey * 7 % 360 + 0D AS heading", "2D AS pitch", "3D AS roll", "34D AS hfov", "160 AS width", "346 AS height")
    return strip(frames, _horizon(spark, sf_dir))


_MACHINE = doubles(
    "SELECT user_id AS device_id, event_id * 1000 AS t_ms, value * 0.4 - 20 AS correction, value * 0.9 - 45 AS pitch, value * 0.1 - 5 AS d_heading, value * 0.02 - 1 AS d_pitch, 0.0 AS offset_now, "
    "46.0 + event_id % 40 * 0.001 AS lat, 8.0 AS lon, value * 3.6 AS heading, event_id % 130 + 0.0 AS accuracy, event_id % 9 = 0 AS matched, event_id % 80 - 10.0 AS sun_alt, 60.0 AS fov, event_id % 300 / 10.0 - 15 AS axis, event_id FROM {events}"
)
_STEPS = f"e AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY t_ms) AS n FROM ({_MACHINE.replace('{events}', 'events')}))"


def _folded(state: dict[str, tuple[str, str]], out: str) -> str:
    """SQL that walks the events (e) of each device one by one with a state (r): its first and its next values."""
    first, then = (", ".join(f"{v[i]} AS {k}" for k, v in state.items()) for i in (0, 1))
    return f"WITH RECURSIVE {_STEPS}, r AS (SELECT device_id, t_ms AS now_ms, n, {first} FROM e WHERE n = 1 UNION ALL SELECT e.device_id, e.t_ms, e.n, {then} FROM r JOIN e ON e.device_id = r.device_id AND e.n = r.n + 1) SELECT device_id, now_ms AS t_ms, {out} FROM r"


def _kept(wanted: str, usable: str = "true") -> dict[str, tuple[str, str]]:
    """A state that holds time, place and heading of the last event kept."""
    go = f"({usable}) AND (r.s_t IS NULL OR ({wanted}))"
    cols = {"s_t": "t_ms", "s_lat": "lat", "s_lon": "lon", "s_heading": "heading"}
    return {"go": (usable, go)} | {k: (f"CASE WHEN {usable} THEN {c} END", f"CASE WHEN {go} THEN e.{c} ELSE r.{k} END") for k, c in cols.items()}


_BAND = "CASE WHEN e.pitch < -20 THEN 'down' WHEN e.pitch > 20 THEN 'up' ELSE 'level' END"
_ENDED = "CASE WHEN e.t_ms <= r.until THEN r.until ELSE 0 END"
_SIZE = "abs(e.correction)"
_WAY = g.distance("r.s_lat", "r.s_lon", "e.lat", "e.lon")
_MACHINE_SQL = {
    "pitch_band": _folded({"band": (_BAND, f"CASE WHEN r.band != {_BAND} AND abs(abs(e.pitch) - 20) < 3 AND (r.band = 'level' OR {_BAND} = 'level') AND (CASE WHEN e.pitch < 0 THEN 'up' ELSE 'down' END) NOT IN (r.band, {_BAND}) THEN r.band ELSE {_BAND} END")}, "band"),
    "compass_disturbed": _folded(
        {
            "big": (f"CASE WHEN {_SIZE} > 15 THEN t_ms END", f"CASE WHEN {_SIZE} > 15 THEN e.t_ms WHEN {_SIZE} < 8 THEN NULL ELSE r.big END"),
            "until": ("0::BIGINT", f"CASE WHEN {_SIZE} > 15 AND e.t_ms - r.big < 180000 THEN e.t_ms + 180000 WHEN {_SIZE} < 8 THEN 0 ELSE {_ENDED} END"),
        },
        "until > 0 AS disturbed",
    ),
    "apply_correction": _folded(
        {"h": (g.delta("0.5 * d_heading", "0"), g.delta("r.h + 0.5 * e.d_heading", "0")), "p": ("greatest(-20, least(20, 0.5 * d_pitch))", "greatest(-20, least(20, r.p + 0.5 * e.d_pitch))")},
        "round(h, 6) AS offset_heading, round(p, 6) AS offset_pitch",
    ),
    "recompute_trigger": _folded(_kept(f"e.t_ms - r.s_t >= 15000 AND {_WAY} >= 120", "e.accuracy <= 100"), "go AS recompute"),
    "training_sampler": _folded(_kept(f"e.t_ms - r.s_t >= 20000 AND ({_WAY} > 200 OR abs({g.delta('e.heading', 'r.s_heading')}) > 8 OR e.t_ms - r.s_t > 120000)"), "go AS kept"),
    "confirm_heading": f"WITH {_STEPS}, big AS (SELECT device_id, n, t_ms - lag(t_ms) OVER w < 15000 AND abs({g.delta('d_heading', 'lag(d_heading) OVER w')}) < 1 AS ok FROM e WHERE abs(d_heading) >= 1.5 WINDOW w AS (PARTITION BY device_id ORDER BY n)) SELECT e.device_id, t_ms, CASE WHEN big.n IS NULL THEN true ELSE coalesce(ok, false) END AS confirmed FROM e LEFT JOIN big ON big.device_id = e.device_id AND big.n = e.n",
    "unverified_heading": f"WITH {_STEPS} SELECT device_id, t_ms, CASE WHEN NOT matched AND t_ms - coalesce(max(CASE WHEN matched THEN t_ms END) OVER w, min(t_ms) OVER w) >= 60000 THEN CASE WHEN sun_alt BETWEEN 3 AND 60 THEN 'sun' ELSE 'pan' END END AS hint FROM e WINDOW w AS (PARTITION BY device_id ORDER BY n)",
}


def _machine(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = getattr(machines, name)
        e = spark.sql(_MACHINE, events=spark.read.parquet(f"{sf_dir}/events.parquet")).withColumnRenamed("offset_now", "offset")
        outs = [c.split() for c in machines.OUTPUTS[m].split(", ")]
        return machines.replay(e, "device_id", m).select("device_id", "t_ms", *[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in outs])

    run.__name__ = name
    return query(_MACHINE_SQL.get(name))(run)


for _m in machines.OUTPUTS:
    if _m is not machines.sensor_profile_update:
        _machine(_m.__name__)


_SOURCE = "CASE event_id % 4 WHEN 0 THEN 'skyline' WHEN 1 THEN 'tower' WHEN 2 THEN 'sun' ELSE 'pitch' END"
_FRESH = f"(CASE e.event_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 ELSE 0.5 END)"
_LEFT = "power(0.5, (e.t_ms - r.s_t) / 1814400000.0)"
_LEARNED = "degrees(atan2(r.hs, r.hc))"
_WEIGHT = f"({_FRESH} * CASE WHEN abs(e.correction) <= 15 AND r.hw * {_LEFT} >= 3 AND abs({g.delta('e.correction', _LEARNED)}) > 8 THEN 0.2 ELSE 1.0 END)"
_ADDED = {"hs": "sin(radians(e.correction))", "hc": "cos(radians(e.correction))", "hw": "1.0"}
_LEARN = {k: tuple(doubles(x) for x in (f"CASE WHEN abs(e.correction) <= 15 THEN {_FRESH} * {v} ELSE 0.0 END", f"r.{k} * {_LEFT} + CASE WHEN abs(e.correction) <= 15 THEN {_WEIGHT} * {v} ELSE 0.0 END")) for k, v in _ADDED.items()}
_LEARN |= {k: tuple(doubles(x) for x in (f"{_FRESH} * {v}", f"r.{k} * {_LEFT} + {_WEIGHT} * {v}")) for k, v in {"ps": "e.d_pitch", "pw": "1.0"}.items()}


@query(
    _folded({"s_t": ("t_ms", "e.t_ms"), **_LEARN}, "round(CASE WHEN hw >= 3 THEN degrees(atan2(hs, hc)) END, 6) AS learned_heading, round(CASE WHEN pw >= 3 THEN ps / pw END, 6) AS learned_pitch, round(greatest(hw, pw), 6) AS n")
)
def sensor_profile_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each device has learned after each correction."""
    e = spark.sql(_MACHINE, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    e = e.select("device_id", "t_ms", F.expr(_SOURCE).alias("source"), F.col("correction").alias("heading"), F.col("d_pitch").alias("pitch"))
    out = machines.replay(e, "device_id", machines.sensor_profile_update)
    return out.select("device_id", "t_ms", *[F.round(c, 6).alias(c) for c in ("learned_heading", "learned_pitch", "n")])


_CAMERA = ["0D AS roll", "34D AS hfov", "390 AS width", "844 AS height"]


def _skyline(frames: DataFrame, horizon: DataFrame, turn: float, tilt: float) -> DataFrame:
    """Points (frame_id, x, y) of the horizon as cameras see it that stand `turn` and `tilt` off the sensors of frames."""
    true = frames.withColumns({"heading": F.col("heading") + turn, "pitch": F.col("pitch") + tilt})
    p = panorama.bins_near(dealt(true), horizon, F.lit(16.0)).where(F.abs(geo.delta_deg("az", "heading")) < 16).where("az_bin % 2 = 0")
    p = p.select("frame_id", F.explode(F.array(geo.project("az", "angle", "heading", "pitch", "roll", "hfov", "width", "height"))).alias("p"))
    return p.select("frame_id", "p.x", "p.y").where("x BETWEEN 0 AND 390 AND y BETWEEN 0 AND 844")


def _ranges(spark, sf_dir) -> DataFrame:
    """Horizons of suppliers that look alike nowhere on the ring."""
    h = _horizon(spark, sf_dir).where("angle IS NOT NULL")
    az = "radians(az_bin * 0.1 + obs_id * 37)"
    return h.withColumn("angle", F.expr(f"2.5 + 1.2 * sin(3.6 * {az}) + 0.8 * sin(14.1 * {az} + 1) + 0.5 * sin(23.3 * {az} + 2)"))


@query()
def match_skyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of suppliers' horizons whose skyline points are the horizon's own, seen by a sensor that is off."""
    frames = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey AS frame_id", "s_suppkey AS obs_id", "s_suppkey * 37 % 360 + 4.5D AS heading", "1D AS pitch", *_CAMERA, "160 AS columns")
    h = _ranges(spark, sf_dir)
    return align.match_skyline(frames, _skyline(frames, h, -4.5, 0.8), h)


@query()
def match_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as frames, orders as the stars seen; every third star is a blob, off by the same shift."""
    stars = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey AS frame_id", "o_orderkey AS star", "o_orderkey * 7919 % 6000 / 100D + 150 AS az", "o_orderkey * 104729 % 5500 / 100D + 5 AS alt")
    blobs = stars.where("star % 3 > 0").selectExpr("frame_id", "az + 4D AS az", "alt - 1.5D AS el", "star % 17 + 0D AS contrast")
    return align.match_stars(blobs, stars)


@query()
def thin_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the peaks in range of every observer, on a strip of four pixels a degree."""
    near = spatial.in_range(_eyes(spark, sf_dir), derived(spark, sf_dir, "peaks"))
    score = spatial.label_score(F.col("p_id") % 80, F.lit(0.0), F.coalesce("p_ele", F.lit(0.0)))
    labels = near.select("obs_id", F.col("p_id").alias("id"), (F.col("az") * 4).alias("x"), F.lit(False).alias("selected"), (F.col("p_id") % 3 > 0).alias("visible"), score.alias("score"))
    return align.thin_labels(labels, ["obs_id"])


_STAR_LIST = "SELECT s_suppkey AS id, (s_suppkey * 7919 % 36000) / 100.0 AS ra, (s_suppkey * 104729 % 17000) / 100.0 - 85 AS dec, (s_suppkey * 31 % 65) / 10.0 AS mag FROM {supplier}"
_STAR_LIST = doubles(_STAR_LIST)
_PLACES = doubles("SELECT c_custkey AS obs_id, 2461120.5 + c_custkey % 300 / 37.0 AS jd, 45.0 + c_custkey % 9 AS lat, 6.0 + c_custkey % 7 AS lon FROM {customer}")
_NIGHT = "(SELECT obs_id, jd, lat, lon, 1 + 4.5 * least(1.0, greatest(0.0, (-alt - 4) / 10)) AS lim FROM " + nested("(" + _PLACES.replace("{customer}", "customer") + ")", sky.SUN_STEPS) + ")"
_NIGHT_STARS = f"(SELECT obs_id, jd, lat, lon, id, ra AS ra2000, dec AS dec2000, mag FROM {_NIGHT} JOIN ({_STAR_LIST.replace('{supplier}', 'supplier')}) ON mag <= lim)"


@query(f"SELECT obs_id, id, round(az, 6) AS az, round(alt, 6) AS alt, row_number() OVER (PARTITION BY obs_id, jd ORDER BY mag, id) AS rank FROM {nested(_NIGHT_STARS, sky.STAR_STEPS)}")
def night_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vistaframe.operators import night

    places = spark.sql(_PLACES, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    stars = spark.sql(_STAR_LIST, supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))
    out = night.night_objects(places, stars)
    return out.select("obs_id", "id", F.round("az", 6).alias("az"), F.round("alt", 6).alias("alt"), F.col("rank").cast("long").alias("rank"))


_SUN_PATH = nested(f"(SELECT obs_id, lat, lon, t_ms, t_ms / 86400000 + 2440587.5 AS jd FROM (SELECT *, unnest(generate_series(1774000000000, 1774086400000, 3600000)) AS t_ms FROM {oracle('observers')}))", sky.SUN_STEPS)


@query(f"SELECT obs_id, t_ms, round(az, 5) AS az, round(alt, 5) AS alt FROM {_SUN_PATH}")
def body_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vistaframe.operators import night

    start, end = F.lit(1774000000000), F.lit(1774086400000)
    path = night.body_path(derived(spark, sf_dir, "observers").select("obs_id", "lat", "lon"), "sun", start, end, 3_600_000)
    return path.select("obs_id", "t_ms", F.round("az", 5).alias("az"), F.round("alt", 5).alias("alt"))


@query("SELECT o_custkey AS tile, max(o_orderkey) AS t_ms FROM orders GROUP BY o_custkey HAVING 3000000000 - max(o_orderkey) * 100000 < 2592000000")
def latest_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vistaframe.operators import night

    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey AS tile", "o_orderkey * 100000 AS t_ms")
    return night.latest_cached(rows, "tile", F.lit(3_000_000_000)).select("tile", (F.col("t_ms") / 100000).cast("long").alias("t_ms"))


@query(
    f"SELECT t.id, round(t.az, 6) AS az, round(t.alt, 6) AS alt FROM (SELECT *, id % (SELECT count(*) FROM supplier) + 1 AS obs_id FROM {nested(oracle('times'), sky.SUN_STEPS)}) t LEFT JOIN {_HORIZON} h ON h.obs_id = t.obs_id AND h.az_bin = CAST(floor(t.az / 0.1::DOUBLE + 0.5) AS BIGINT) % 3600 WHERE h.angle IS NULL OR t.alt > h.angle"
)
def above_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' sun positions over the horizons of suppliers."""
    from vistaframe.operators import night

    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    sun = sky.sun_position(derived(spark, sf_dir, "times")).withColumn("obs_id", F.col("id") % n + 1)
    return night.above_terrain(sun, _horizon(spark, sf_dir)).select("id", F.round("az", 6).alias("az"), F.round("alt", 6).alias("alt"))


@query()
def match_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' frames, 0.8 degrees low, over their horizons drawn flat to a fifth."""
    frames = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey AS frame_id", "s_suppkey AS obs_id", "s_suppkey * 37 % 360 + 0D AS heading", "1D AS pitch", *_CAMERA, "160 AS columns")
    low = _horizon(spark, sf_dir).withColumn("angle", F.col("angle") / 5)
    return evidence.match_pitch(frames, _skyline(frames, low, 0, 0.8), low)


@query()
def match_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' horizons as profiles turned by 6 degrees and 0.4 low, against the horizons."""
    h = _horizon(spark, sf_dir)
    seen = h.where("az_bin % 5 = 0 AND az_bin BETWEEN 900 AND 1900 AND angle IS NOT NULL").select(F.col("obs_id").alias("device_id"), "obs_id", (F.col("az_bin") * 0.1 - 6).alias("az"), (F.col("angle") - 0.4).alias("el"))
    return evidence.match_profile(seen, h)


@query()
def search_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 160 columns in a frame of every customer over suppliers' horizons."""
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    frames = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS frame_id", f"c_custkey % {n} + 1 AS obs_id", "c_custkey * 7 % 360 + 0D AS heading", "2D AS pitch", *_CAMERA)
    return evidence.search_windows(dealt(frames), _horizon(spark, sf_dir))


_SPIKES = doubles("SELECT o_custkey AS frame_id, o_orderkey AS spike, (o_custkey * 7 + o_orderkey * 7919 % 2800 / 100.0) % 360 + 1 AS az, o_orderkey % 37 / 10.0 AS top FROM {orders}")
_TOWERS = doubles("SELECT p_partkey % (SELECT count(*) FROM {supplier}) + 1 AS obs_id, p_partkey AS name, p_partkey * 7919 % 36000 / 100.0 + 0.003 AS az, 0.5 AS base, p_partkey % 31 / 10.0 AS top, 2000.0 + p_partkey % 20000 AS dist, p_partkey % 3 = 0 AS height_known FROM {part}")
_SNAPS = doubles("SELECT c_custkey AS frame_id, c_custkey % (SELECT count(*) FROM {supplier}) + 1 AS obs_id, c_custkey * 7 % 360 + 14.0 AS heading, 34.0 AS hfov FROM {customer}")


def _tower_groups(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    frames = spark.sql(_SNAPS, customer=read("customer"), supplier=read("supplier"))
    spikes, towers = spark.sql(_SPIKES, orders=read("orders")), spark.sql(_TOWERS, part=read("part"), supplier=read("supplier"))
    return frames, evidence.tower_groups(frames, spikes, towers)


_PAIRS = f"(SELECT f.frame_id, f.obs_id, f.heading, f.hfov / 2 AS half, s.spike, t.name, {g.delta('t.az', 's.az')} AS turn FROM ({_SPIKES.replace('{orders}', 'orders')}) s JOIN ({_SNAPS.replace('{customer}', 'customer').replace('{supplier}', 'supplier')}) f ON s.frame_id = f.frame_id JOIN ({_TOWERS.replace('{part}', 'part').replace('{supplier}', 'supplier')}) t ON t.obs_id = f.obs_id WHERE abs({g.delta('t.az', 's.az')}) <= 21 AND CASE WHEN t.height_known THEN abs(s.top - t.top) <= 1.2::DOUBLE ELSE s.top >= t.base - 0.5::DOUBLE AND s.top <= t.base + degrees(atan(300 / t.dist)) + 1.2::DOUBLE END)"


@query(
    f"WITH p AS MATERIALIZED {_PAIRS}, gr AS (SELECT a.frame_id, any_value(a.obs_id) AS obs_id, any_value(a.heading) AS heading, any_value(a.half) AS half, a.turn AS pair, a.spike, a.name, avg(b.turn) AS turn, least(count(DISTINCT b.name), count(DISTINCT b.spike)) AS k FROM p a JOIN p b ON a.frame_id = b.frame_id AND abs(a.turn - b.turn) <= 0.25 GROUP BY a.frame_id, a.turn, a.spike, a.name), "
    f"e AS (SELECT gr.frame_id, gr.pair, gr.spike, gr.name, any_value(gr.turn) AS turn, any_value(k) AS k, count_if(abs({g.delta('t.az - gr.turn', 'gr.heading')}) < half - 1) AS expected FROM gr JOIN ({_TOWERS.replace('{part}', 'part').replace('{supplier}', 'supplier')}) t ON t.obs_id = gr.obs_id GROUP BY gr.frame_id, gr.pair, gr.spike, gr.name), "
    "s AS (SELECT frame_id, pair, turn, CASE WHEN 3 * k >= 2 * expected THEN k ELSE 0 END AS k FROM e), best AS (SELECT frame_id, arg_min(turn, (-k, pair)) AS turn, max(k) AS k, count(*) AS n FROM s GROUP BY frame_id) "
    "SELECT best.frame_id, round(best.turn, 6) AS d_heading, CAST(best.k AS BIGINT) AS k, CAST((SELECT coalesce(max(s.k), 0) FROM s WHERE s.frame_id = best.frame_id AND abs(s.turn - best.turn) > 1) AS BIGINT) AS rival, n FROM best"
)
def tower_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' frames whose orders are spikes, against parts as towers."""
    x = _tower_groups(spark, sf_dir)[1]
    return x.select("frame_id", F.round("d_heading", 6).alias("d_heading"), F.col("k").cast("long").alias("k"), F.col("rival").cast("long").alias("rival"), "n")


@query()
def match_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames with the silhouettes at the turns of their best groups."""
    frames, groups = _tower_groups(spark, sf_dir)
    frames = frames.drop("hfov").selectExpr("*", "2D AS pitch", *_CAMERA)
    h = _ranges(spark, sf_dir)
    groups = written(groups)
    fits = evidence.silhouettes(groups, frames, _skyline(frames, h, 3, 0), h)
    return evidence.match_landmarks(groups, fits, frames.select("frame_id", F.lit(0.05).alias("best_cost")))


@query()
def orientation_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as absolute, relative and compass readings of their devices."""
    a = _angles(spark, sf_dir)
    x = a.selectExpr("device_id", "CAST(t_ms * 7 AS BIGINT) AS t_ms", "IF(event_id % 5 = 0, 'absolute', 'relative') AS kind", "alpha", "heading", "pitch", "roll", "IF(event_id % 11 = 1, event_id % 360 + 0D, NULL) AS compass_heading", "event_id % 13 - 2D AS accuracy", "event_id % 17 = 0 AS held")
    return fusion.orientation_route(x).select("device_id", "t_ms", "route", *[F.round(c, 9).alias(c) for c in ("out_heading", "out_pitch", "out_roll")])


_POSTURES = doubles("SELECT user_id AS device_id, event_id * 1000 AS t_ms, concat(CASE WHEN event_id % 7 < 4 THEN 'p' ELSE 'l' END, '|', CASE WHEN value < 20 THEN 'down' WHEN value < 80 THEN 'level' ELSE 'up' END) AS posture, event_id % 9 = 0 AS matched FROM {events}")
_LEARNED = doubles("SELECT DISTINCT user_id AS device_id, concat(CASE WHEN user_id % 2 = 0 THEN 'p' ELSE 'l' END, '|level') AS posture, user_id % 37 - 18.0 AS heading, user_id % 53 - 26.0 AS pitch FROM {events}")


@query(
    f"WITH e AS ({_POSTURES.replace('{events}', 'events')}), w AS (SELECT *, posture IS DISTINCT FROM lag(posture) OVER d AND coalesce(t_ms - max(CASE WHEN matched THEN t_ms END) OVER d >= 30000, true) AS go FROM e WINDOW d AS (PARTITION BY device_id ORDER BY t_ms)) SELECT w.device_id, t_ms, CASE WHEN go AND abs(heading) <= 15 THEN heading END AS set_heading, CASE WHEN go AND pitch IS NOT NULL THEN greatest(-20, least(20, pitch)) END AS set_pitch FROM w LEFT JOIN ({_LEARNED.replace('{events}', 'events')}) l ON l.device_id = w.device_id AND l.posture = w.posture"
)
def apply_posture(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return fusion.apply_posture(spark.sql(_POSTURES, events=e), spark.sql(_LEARNED, events=e)).select("device_id", "t_ms", "set_heading", "set_pitch")


@query(f"SELECT concat(floor(round(lat, 5))::BIGINT, '_', floor(round(lon, 5))::BIGINT) AS tile, count(*) AS n, max(name) AS last_name FROM {oracle('towers')} GROUP BY 1")
def landmark_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _towers(spark, sf_dir).withColumn("kind", F.coalesce("kind", F.lit("t")))
    rows = F.from_json("rows", "array<array<string>>")
    return dataset.landmark_tile_rows(t).select("tile", F.size(rows).cast("long").alias("n"), F.array_max(F.transform(rows, lambda r: r[4])).alias("last_name"))


@query(f"SELECT obs_id, count(*) AS peaks, CAST(count_if(visible) AS BIGINT) AS visible FROM (SELECT obs_id, p_id % 3 > 0 AND p_ele IS NOT NULL AS visible FROM {NEAR_PEAKS}) GROUP BY obs_id")
def visible_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = spatial.in_range(_eyes(spark, sf_dir), derived(spark, sf_dir, "peaks"))
    return panorama.visible_count(near.select("obs_id", (F.col("p_id") % 3 > 0).alias("_v"), "p_ele").withColumn("visible", F.col("_v") & F.col("p_ele").isNotNull()))
