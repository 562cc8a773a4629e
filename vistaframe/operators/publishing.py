"""The published set of tiles: staged files, and a manifest that is swapped last and only if something has changed.

A set's folder holds `tiles/version=<v>/tile=<key>` with the text of each tile as some version wrote it, `manifests/<v>`
with the tiles (tile, version) of a version, and `CURRENT`, which names the version that readers see. A run writes tiles
that are new or changed, then its manifest, then renames a new `CURRENT` over the old one: until then, and if the run dies
before, readers see the old set whole.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaframe.operators import dataset
from vistaframe.shared import listed, written
from vistaframe.sources.readers import peaks_of_rows, read_osm_geojsonseq

LEAST_PEAKS = 100_000


class _Store:
    """Small files of a folder, by the file system that Spark has for it."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self._path(name)):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def swap(self, name: str, text: str) -> None:
        """Replaces the file in one step."""
        fresh = f"{name}.{uuid.uuid4().hex}"
        out = self.fs.create(self._path(fresh))
        out.write(bytearray(text.encode()))
        out.close()
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        kinds = self.jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        kinds[0] = options.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri() if "://" in self.root else self.fs.getUri())
        context.rename(self._path(fresh), self._path(name), kinds)


def current(spark: SparkSession, root: str) -> dict | None:
    """version, extract, generated and n of the set that readers see; None before the first."""
    text = _Store(spark, root).read("CURRENT")
    return json.loads(text) if text else None


def published(spark: SparkSession, root: str) -> DataFrame:
    """(tile, rows) of the set that readers see; no rows before the first."""
    now = current(spark, root)
    if not now or not now["n"]:
        return spark.createDataFrame([], "tile string, rows string")
    manifest = listed(spark.read.schema("tile string, version string").parquet(f"{root}/manifests/{now['version']}"))
    rows = spark.read.schema("value string, version string, tile string").option("wholetext", True).text(f"{root}/tiles")
    return rows.join(manifest, ["version", "tile"]).select("tile", F.regexp_replace("value", r"\n\z", "").alias("rows"))


def publish(spark: SparkSession, root: str, tiles: DataFrame, extract: str | None = None) -> dict:
    """Makes `tiles` (tile, rows) the set that readers see, and tells how many were added, changed, removed, and whether
    anything was swapped: not if all tiles and the stamp of the extract are as before."""
    now, version = current(spark, root), uuid.uuid4().hex
    tiles = written(tiles)
    changes = written(dataset.tile_changes(published(spark, root), tiles))
    found = {"added": 0, "changed": 0, "removed": 0} | {r.change: r["count"] for r in changes.groupBy("change").count().collect()}
    if now and not any(found.values()) and now["extract"] == extract:
        return found | {"swapped": False, "version": now["version"]}
    fresh = listed(changes.where("change <> 'removed'").select("tile"))
    # each tile is one file of its own
    tiles.join(fresh, "tile", "left_semi").select("tile", F.col("rows").alias("value")).repartition("tile").write.partitionBy("tile").text(f"{root}/tiles/version={version}")
    manifest = tiles.join(fresh, "tile", "left_semi").select("tile", F.lit(version).alias("version"))
    if now and now["n"]:
        kept = spark.read.parquet(f"{root}/manifests/{now['version']}").join(tiles.select("tile"), "tile", "left_semi").join(fresh, "tile", "left_anti")
        manifest = manifest.union(kept.select("tile", "version"))
    manifest.write.parquet(f"{root}/manifests/{version}")
    n = spark.read.parquet(f"{root}/manifests/{version}").count()
    _Store(spark, root).swap("CURRENT", json.dumps({"version": version, "extract": extract, "generated": int(time.time() * 1000), "n": n}))
    return found | {"swapped": True, "version": version}


def rebuild(spark: SparkSession, root: str, fame: DataFrame, extract: str | None = None, stamp: str | None = None, least: int = LEAST_PEAKS) -> dict:
    """Builds the peak tiles anew and publishes them: from an extract (a file of one feature a line) with its duplicates
    merged, or without one from the published tiles themselves, with what is now known of fame (qid, n). Fewer than
    `least` peaks are an error, and the old set stays. Also tells how many duplicates were merged."""
    merged = 0
    if extract is None:
        now = current(spark, root) or {}
        peaks, stamp = dataset.fame_join(peaks_of_rows(published(spark, root), "rows"), fame), now.get("extract")
    else:
        peaks, merged = dataset.merge_duplicates(read_osm_geojsonseq(spark, extract)[0], fame)
    rows = written(dataset.require_min_rows(peaks, least))
    return publish(spark, root, dataset.tile_rows(rows), stamp) | {"merged": merged}
