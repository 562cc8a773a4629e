"""Most hidden towers are told by few samples of their rays; those left are the ones that whole rays show."""

from pyspark.sql import functions as F

from vistaframe.operators import panorama, spatial
from vistaframe.plans import queries


def test_coarse_rays_lose_no_tower(spark):
    eyes = spark.sql("SELECT id AS obs_id, 46 + id * 7 % 60 / 60D AS lat, 7 + id * 11 % 60 / 60D AS lon, 40000D AS radius FROM range(60)")
    eyes = eyes.withColumn("h0", queries.terrain(F.col("lat"), F.col("lon")) + 1.7)
    towers = spark.sql("SELECT id, 46 + id * 13 % 80 / 80D AS lat, 7 + id * 17 % 80 / 80D AS lon, 'c' AS kind, IF(id % 3 = 0, NULL, 60) AS height FROM range(80)")
    near = spatial.in_range(eyes, towers, spatial.TOWER_LEAST_M, spatial.TOWER_MOST_M)
    t = panorama.judged_towers(near.withColumn("ground", queries.terrain(F.col("p_lat"), F.col("p_lon"))))
    sky = panorama.scanned_rays(panorama.tower_rays(t), queries.heights).select("obs_id", F.col("az").alias("bin_az"), F.col("angle").alias("sky"))
    want = panorama.seen_towers(panorama.occlusion_angle(t.join(sky, ["obs_id", "bin_az"], "left"), queries.heights))
    found = {(x.obs_id, x.p_id): (x.top, x.occlusion, x.sky) for x in want.collect()}
    got = panorama.landmark_views(eyes, towers, queries.terrain, queries.heights)
    assert {(x.obs_id, x.p_id): (x.top, x.occlusion, x.sky) for x in got.collect()} == found and len(found) > 10
    assert panorama.maybe_seen(t, queries.heights).count() < t.count() / 3
