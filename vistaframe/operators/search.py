"""Ranked, accent-folded search in multilingual names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaframe.functions.text import fold, match_score
from vistaframe.shared import listed

# fixed values: ranks of sky hits
SKY_RANK = {"sun": 30, "moon": 30, "major_sat": 20, "sat": 5}


def search_peaks(peaks: DataFrame, queries: DataFrame, k: int = 8) -> DataFrame:
    """(q_id, q, id, score, fame, visible, ele, rank) of the k best peaks (id, names array, fame, visible, ele)
    for each query (q_id, q); blank queries find nothing.

    Names are folded once and counted once for each distinct text; every query is held against the distinct
    texts (the stated query set, broadcast if its size allows), and a name's rows meet its scores again by the
    text, so the cost doesn't grow with repeated names. An id that occurs twice counts once.
    """
    names = peaks.select("id", "fame", "visible", "ele", F.explode("names").alias("name")).where("name <> ''").withColumn("f", fold("name"))
    asked = queries.select("q_id", F.trim(fold("q")).alias("q")).where("q <> ''")
    texts = names.select("f").distinct()
    scored = texts.join(listed(asked), match_score("f", "q") > 0).withColumn("score", match_score("f", "q"))
    best = names.join(scored, "f").groupBy("q_id", "q", "id").agg(F.max("score").alias("score"), F.max("fame").alias("fame"), F.max("visible").alias("visible"), F.max("ele").alias("ele"))
    order = Window.partitionBy("q_id").orderBy(F.desc("score"), F.desc("fame"), F.desc("visible"), F.desc_nulls_last("ele"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_all(peaks: DataFrame, sky: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(q_id, kind, id, score, rank) of peaks and sky objects (id, name, kind, mag) together: by score, then
    peaks by their place from the end and sky objects by kind or brightness."""
    hits = search_peaks(peaks, queries, 8).withColumn("weight", 9.0 - F.col("rank")).select("q_id", F.lit("peak").alias("kind"), F.col("id").cast("string").alias("id"), "score", "weight")
    asked = queries.select("q_id", F.trim(fold("q")).alias("q")).where("q <> ''")
    weight = F.coalesce(*[F.when(F.col("kind") == kind, F.lit(float(n))) for kind, n in SKY_RANK.items()], F.when(F.col("kind").isin("star", "planet"), 10 - F.col("mag")), F.lit(0.0))
    found = sky.withColumn("f", fold("name")).join(listed(asked), match_score("f", "q") > 0)
    objects = found.select("q_id", "kind", F.col("id").cast("string").alias("id"), match_score("f", "q").alias("score"), weight.alias("weight"))
    order = Window.partitionBy("q_id").orderBy(F.desc("score"), F.desc("weight"), "id")
    return hits.unionByName(objects).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("weight")
