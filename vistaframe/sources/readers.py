"""Readers of extracts, tiles, two-line elements and sky catalogues, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vistaframe.functions.text import classify_landmark, parse_ele, parse_height
from vistaframe.operators.dataset import require_min_rows

# fixed values
LANGS, LEAST_TLE, FAINTEST, NAMED_MAG = ("de", "en", "fr", "it"), 50, 5.5, 2.5
_FEATURE = "id string, geometry struct<type: string, coordinates: array<double>>, properties map<string, string>"


def _ordinal(df: DataFrame) -> DataFrame:
    """df with ordinal, a key that follows the order of lines: file, place of its split, row within."""
    return df.withColumn("ordinal", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")))


def _some(c: Column) -> Column:
    """Null for empty text."""
    return F.when(c != "", c)


def _names(pairs: dict[str, Column]) -> Column:
    """Map of the names that aren't empty."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull() & (e["value"] != "")))


def read_osm_geojsonseq(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(peaks, towers) of a file with one feature a line. Blank and broken lines are passed over; only points
    with ids n<number> count. Anything with man_made can only be a tower. Peaks need natural = peak or volcano, a
    name, finite coordinates and an id other than 0; the first line of an id wins."""
    lines = _ordinal(spark.read.text(path))
    f = lines.select("ordinal", F.from_json(F.regexp_replace("value", "^\x1e", ""), _FEATURE).alias("x")).select("ordinal", "x.*")
    f = f.withColumns({"num": F.regexp_extract("id", r"^n(\d+)$", 1), "lon": F.try_element_at("geometry.coordinates", F.lit(1)), "lat": F.try_element_at("geometry.coordinates", F.lit(2))})
    f = f.where("geometry.type = 'Point' AND num <> ''").withColumn("id", F.col("num").cast("long"))
    tag = lambda k: F.try_element_at("properties", F.lit(k))
    height = parse_height(tag("height"))
    towers = f.where(tag("man_made").isNotNull()).select("id", "lat", "lon", height.alias("height"), classify_landmark(tag("man_made"), tag("tower:type"), height).alias("kind"), F.coalesce(tag("name"), F.lit("")).alias("name")).where("kind IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    finite = "lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)"
    p = f.where(tag("man_made").isNull() & tag("natural").isin("peak", "volcano") & (F.col("id") != 0) & _some(tag("name")).isNotNull()).where(finite)
    qid = tag("wikidata")
    p = p.select("ordinal", "id", tag("name").alias("name"), _names({k: tag(f"name:{k}") for k in LANGS}).alias("names"), "lat", "lon", parse_ele(tag("ele"), dataset=True).alias("ele"), tag("natural").alias("kind"), F.when(qid.rlike(r"^Q\d+$"), qid).alias("qid"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("ordinal"))
    return p.withColumn("_n", first).where("_n = 1").drop("_n"), towers


def read_overpass_csv(spark: SparkSession, path: str) -> DataFrame:
    """Peaks of tab-separated lines: id, lat, lon, ele, name, names, wikidata. Lines without a name or place are
    passed over; fame is 1 with a wikidata value."""
    schema = "id long, lat double, lon double, ele string, name string, " + ", ".join(f"{k} string" for k in LANGS) + ", wikidata string"
    t = spark.read.csv(path, sep="\t", quote="", schema=schema)
    ok = t.where("name IS NOT NULL AND name <> '' AND lat IS NOT NULL AND lon IS NOT NULL")
    return ok.select("id", "name", _names({k: F.col(k) for k in LANGS}).alias("names"), "lat", "lon", parse_ele("ele").alias("ele"), (F.length(F.trim(F.coalesce("wikidata", F.lit("")))) > 0).cast("int").alias("fame"))


def read_overpass_json(spark: SparkSession, path: str, lat: int, lon: int) -> DataFrame:
    """Towers of one tile from elements with a centre or a place of their own; those on the tile's north and
    east edges belong to its neighbours."""
    schema = "elements array<struct<lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string, string>>>"
    e = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("elements").alias("e"))
    tag = lambda k: F.try_element_at("e.tags", F.lit(k))
    height = parse_height(tag("height"))
    t = e.select(F.coalesce("e.center.lat", "e.lat").alias("lat"), F.coalesce("e.center.lon", "e.lon").alias("lon"), height.alias("height"), classify_landmark(tag("man_made"), tag("tower:type"), height).alias("kind"), F.coalesce(tag("name"), F.lit("")).alias("name"))
    return t.where((F.col("lat") < lat + 1) & (F.col("lon") < lon + 1) & F.col("kind").isNotNull())


def _rows_of(tiles: DataFrame, column: str) -> DataFrame:
    return tiles.select(F.explode(F.from_json(column, "array<array<string>>")).alias("r"))


def _tile_rows(spark: SparkSession, path: str) -> DataFrame:
    return _rows_of(spark.read.text(path, wholetext=True), "value")


def read_peak_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Peaks of tiles of positional rows; empty translations are left out, fame defaults to 0."""
    return peaks_of_rows(spark.read.text(path, wholetext=True), "value")


def peaks_of_rows(tiles: DataFrame, column: str) -> DataFrame:
    """The same of tiles whose text is a column."""
    at = lambda i: F.try_element_at("r", F.lit(i))
    return _rows_of(tiles, column).select(
        at(1).cast("long").alias("id"), at(5).alias("name"), _names({k: at(6 + i) for i, k in enumerate(LANGS)}).alias("names"), at(2).cast("double").alias("lat"), at(3).cast("double").alias("lon"), at(4).cast("double").alias("ele"), F.coalesce(at(10).cast("long"), F.lit(0)).alias("fame"), at(11).alias("qid")
    )


def read_landmark_tiles(spark: SparkSession, path: str) -> DataFrame:
    at = lambda i: F.try_element_at("r", F.lit(i))
    return _tile_rows(spark, path).select(at(1).cast("double").alias("lat"), at(2).cast("double").alias("lon"), at(3).cast("int").alias("height"), at(4).alias("kind"), at(5).alias("name"))


def read_tle(spark: SparkSession, paths: list[str], least: int = LEAST_TLE) -> DataFrame:
    """(cat, name, l1, l2) of files of name and element lines; the first of a catalogue number wins, in the order
    of the paths. Fewer than `least` are an error."""
    order = {p: i for i, p in enumerate(paths)}
    parts = []
    for p, i in order.items():
        lines = spark.read.text(p, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line")).withColumns({"file": F.lit(i), "line": F.regexp_replace("line", r"\s+$", "")})
        w = Window.partitionBy("file").orderBy("at")
        parts.append(lines.withColumns({"l1": F.lead("line", 1).over(w), "l2": F.lead("line", 2).over(w)}))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    rows = rows.where("l1 LIKE '1 %' AND l2 LIKE '2 %'").withColumn("cat", F.trim(F.substring("l1", 3, 5)))
    first = F.row_number().over(Window.partitionBy("cat").orderBy("file", "at"))
    return require_min_rows(rows.withColumn("_n", first).where("_n = 1").select("cat", F.trim("line").alias("name"), "l1", "l2"), least)


def build_sky_catalogue(stars: DataFrame, names: DataFrame, cons: DataFrame, lines: DataFrame, lang: str = "en") -> tuple[DataFrame, DataFrame]:
    """(stars, constellations). stars: id, lon, lat, mag, bv; names: id, names map, name; cons: id, names map,
    name, display array, lon, lat; lines: id, lines. Stars to magnitude 5.5 by brightness, named to 2.5;
    constellations with their lines and label place."""

    def named(prefix=""):
        return F.coalesce(_some(F.try_element_at("names", F.lit(lang))), "name")

    s = stars.where(F.col("mag") <= FAINTEST).join(names, "id", "left")
    s = s.select("id", F.round(F.pmod("lon", F.lit(360.0)), 3).alias("ra"), F.round("lat", 3).alias("dec"), "mag", "bv", F.when(F.col("mag") <= NAMED_MAG, named()).alias("name")).orderBy("mag", "id")
    c = cons.join(lines, "id", "left")
    place = F.coalesce("display", F.array("lon", "lat"))
    return s, c.select("id", named().alias("name"), F.pmod(place[0], F.lit(360.0)).alias("label_ra"), place[1].alias("label_dec"), "lines")
