import json
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaframe.operators import dataset
from vistaframe.sources import dem, readers


def test_extract(spark, tmp_path):
    def f(i, kind="Point", at=(8.1, 46.2), **tags):
        return json.dumps({"id": i, "geometry": {"type": kind, "coordinates": list(at)}, "properties": tags})

    lines = ["\x1e" + f("n1", natural="peak", name="A", ele="1'234 m", wikidata="Q5"), "", "{broken", f("w2", natural="peak", name="B"), f("n3", natural="volcano", name="C", **{"name:de": "Ce", "name:fr": ""}), f("n1", natural="peak", name="A2"), f("n4", natural="peak", name="D", man_made="mast", height="45 m"), f("n0", natural="peak", name="E"), f("n5", natural="peak", name=""), f("n6", natural="peak", name="F", wikidata="x"), f("n7", man_made="mast", height="12"), f("n8", kind="Line", natural="peak", name="G")]
    (tmp_path / "x.geojsonseq").write_text("\n".join(lines))
    peaks, towers = readers.read_osm_geojsonseq(spark, str(tmp_path / "x.geojsonseq"))
    got = {x.id: x for x in peaks.collect()}
    assert set(got) == {1, 3, 6} and got[1].name == "A" and got[1].ele == 1234 and got[1].qid == "Q5"
    assert got[3].names == {"de": "Ce"} and got[3].kind == "volcano" and got[6].qid is None
    assert [(x.id, x.kind, x.height) for x in towers.collect()] == [(4, "m", 45)]


def test_tables_and_tiles(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1\t46.1\t8.1\t1797\tRigi\t\t\t\t\t\n2\t46.2\t8.2\t2'502\tPiz\t\t\tPic\tPizzo\tQ1\n3\t\t8\t\tX\t\t\t\t\t\n")
    rows = {x.id: x for x in readers.read_overpass_csv(spark, str(tmp_path / "a.csv")).collect()}
    assert set(rows) == {1, 2} and rows[2].names == {"fr": "Pic", "it": "Pizzo"} and (rows[1].fame, rows[2].fame) == (0, 1)
    (tmp_path / "t.json").write_text(json.dumps({"elements": [{"lat": 46.5, "lon": 8.5, "tags": {"man_made": "mast", "height": "50"}}, {"center": {"lat": 47.0, "lon": 8.5}, "tags": {"man_made": "mast", "height": "50"}}, {"lat": 46.1, "lon": 8.1, "tags": {"man_made": "mast"}}]}))
    assert [(x.lat, x.kind) for x in readers.read_overpass_json(spark, str(tmp_path / "t.json"), 46, 8).collect()] == [(46.5, "m")]
    peaks = spark.createDataFrame([(2, "B", {"de": "Be"}, -0.5, -71.123456, None, 7, "Q2"), (1, 'A "x"', None, -0.25, -71.5, 1234.0, 0, None)], "id long, name string, names map<string,string>, lat double, lon double, ele double, fame int, qid string")
    tiles = dataset.tile_rows(peaks).collect()
    assert [t.tile for t in tiles] == ["-1_-72"] and [r[0] for r in json.loads(tiles[0].rows)] == [1, 2]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "-1_-72.json").write_text(tiles[0].rows)
    back = {x.id: x for x in readers.read_peak_tiles(spark, str(tmp_path / "p")).collect()}
    assert back[1].name == 'A "x"' and back[1].ele == 1234 and back[1].qid is None and back[1].names == {}
    assert back[2].names == {"de": "Be"} and back[2].lon == -71.12346 and (back[2].fame, back[2].qid, back[2].ele) == (7, "Q2", None)
    changes = dataset.tile_changes(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "tile string, rows string"), spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "tile string, rows string"))
    assert sorted(map(tuple, changes.collect())) == [("b", "changed"), ("c", "removed"), ("d", "added")]


def test_elements(spark, tmp_path):
    one = "ISS (ZARYA)   \n1 25544U 98067A   x\n2 25544  51.6\n"
    (tmp_path / "a.txt").write_text(one + "X\n1 00001U\n2 00001\nbroken\n")
    (tmp_path / "b.txt").write_text("OTHER\n1 25544U\n2 25544\n")
    t = readers.read_tle(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")], 2)
    assert sorted((x.cat, x.name) for x in t.collect()) == [("00001", "X"), ("25544", "ISS (ZARYA)")]
    with pytest.raises(ValueError):
        readers.read_tle(spark, [str(tmp_path / "a.txt")])


def png(pixels, filters):
    h, w, c = pixels.shape
    flat = np.zeros((h + 1, (w + 1) * c), int)
    flat[1:, c:] = pixels.reshape(h, -1)
    raw = b""
    for y in range(1, h + 1):
        kind = filters[y % len(filters)]
        a, b, x, o = flat[y, :-c], flat[y - 1, c:], flat[y, c:], flat[y - 1, :-c]
        p = a + b - o
        paeth = np.where((abs(p - a) <= abs(p - b)) & (abs(p - a) <= abs(p - o)), a, np.where(abs(p - b) <= abs(p - o), b, o))
        raw += bytes([kind]) + ((x - [0 * a, a, b, (a + b) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + b"\0\0\0\0"
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [3, 4])
def test_png_filters(channels):
    p = np.random.default_rng(1).integers(0, 256, (20, 13, channels), dtype=np.uint8)
    assert (dem.decode_png(png(p, (0, 1, 2, 3, 4))) == p).all()
    assert dem.decode_png(b"no") is None
    assert dem.heights(np.array([[[135, 5, 0], [128, 0, 128]]], np.uint8)).tolist() == [[1797.0, 0.5]]


def test_samples_of_a_plane(spark):
    """Tiles whose heights are linear in pixels give linear samples; a missing neighbour gives nulls."""
    z, x0, y0 = 10, 536, 359
    rows = []
    for dx in (0, 1):
        for dy in (0, 1):
            if (dx, dy) != (1, 1):
                i, j = np.mgrid[0:256, 0:256]
                rows.append((z, x0 + dx, y0 + dy, ((x0 + dx) * 256 + j - 137000 + 2 * ((y0 + dy) * 256 + i - 91900)).ravel().astype(float).tolist()))
    tiles = dem.with_halo(spark.createDataFrame(rows, "z int, x int, y int, h array<float>"))
    r = random.Random(2)
    px = [(x0 * 256 + 0.5 + r.random() * 400, y0 * 256 + 0.5 + r.random() * 400) for _ in range(300)]
    n = 256 * 2**z
    pts = [(k, math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / n)))), x / n * 360 - 180) for k, (x, y) in enumerate(px)]
    got = {v.k: v.h for v in dem.sample_dem(spark.createDataFrame(pts, "k int, lat double, lon double"), tiles, z).collect()}
    for k, (x, y) in enumerate(px):
        far_x, far_y = x - 0.5 >= (x0 + 1) * 256 - 1, y - 0.5 >= (y0 + 1) * 256 - 1
        past = x - 0.5 >= (x0 + 2) * 256 - 1 or y - 0.5 >= (y0 + 2) * 256 - 1
        if far_x and far_y or past:
            assert got[k] is None
        else:
            assert abs(got[k] - (x - 0.5 - 137000 + 2 * (y - 0.5 - 91900))) < 0.02


@pytest.mark.parametrize("cells,most,sort", [(64, 100_000, False), (4, 60, True)])
def test_merge_equals_the_whole_loop(spark, monkeypatch, cells, most, sort):
    monkeypatch.setattr(dataset, "BLOCK_CELLS", cells)
    monkeypatch.setattr(dataset, "BLOCK_ROWS", most)
    r = random.Random(7)
    rows = [(k, k, r.choice(["Alp", "Älp", "Horn", "Piz"]), {"de": r.choice(["", "x", "y"])}, 46 + r.random() * 0.2, 8 + r.random() * 0.2, r.choice([None, 1000.0, 1010.0, 1030.0]), r.choice(["peak", "volcano"]), r.choice([None, "Q1", "Q2", "Q3"])) for k in range(1, 160)]
    if sort:  # so that meetings wait for one another from one end to the other
        rows = [(k, k, *x[2:]) for k, x in enumerate(sorted(rows, key=lambda x: x[5]), 1)]
    schema = "ordinal long, id long, name string, names map<string,string>, lat double, lon double, ele double, kind string, qid string"
    fame = {"Q1": 30, "Q2": 5}
    left, merged = dataset.merge_duplicates(spark.createDataFrame(rows, schema), spark.createDataFrame(list(fame.items()), "qid string, n int"))
    got = {x.id: (x.ele, x.qid, dict(x.names)) for x in left.collect()}
    recs = [dict(zip(schema.replace("map<string,string>", "m").replace(" long", "").replace(" string", "").replace(" double", "").replace(" m", "").split(", "), x)) for x in rows]
    fold = lambda s: s.lower().replace("ä", "a")
    rank = lambda v: (0 if v["qid"] is None else fame.get(v["qid"], 1)) * 10 + (v["kind"] == "peak")
    cell = lambda v: (math.floor(v["lat"] / 0.02), math.floor(v["lon"] / 0.02))
    gone = set()
    for a in recs:
        for step in [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
            for b in [v for v in recs if cell(v) == (cell(a)[0] + step[0], cell(a)[1] + step[1])]:
                if a is b or a["id"] in gone or b["id"] in gone:
                    continue
                d = math.hypot((a["lat"] - b["lat"]) * 111195, (a["lon"] - b["lon"]) * 111195 * math.cos(math.radians(a["lat"])))
                mixed, same = a["kind"] != b["kind"], fold(a["name"]) == fold(b["name"])
                ele = a["ele"] is not None and b["ele"] is not None and abs(a["ele"] - b["ele"]) <= 15
                if (mixed or same) and d <= 300 or (same or mixed and ele) and d <= 2000:
                    keep, drop = (a, b) if rank(a) >= rank(b) else (b, a)
                    keep["ele"] = drop["ele"] if keep["ele"] is None else keep["ele"]
                    if same:
                        keep["names"] = {k: keep["names"].get(k) or drop["names"].get(k) for k in keep["names"]}
                    keep["qid"] = keep["qid"] or drop["qid"]
                    gone.add(drop["id"])
    assert gone and merged == len(gone) and got == {v["id"]: (v["ele"], v["qid"], v["names"]) for v in recs if v["id"] not in gone}


def test_tiles_are_written_and_only_changes_rewritten(spark, tmp_path):
    from pyspark.sql import functions as F

    t = spark.createDataFrame([(46.1234567, 8.5, 45, "t", 'A "q"'), (46.2, 8.1, None, "c", None), (-0.5, 7.9999999, 20, "t", "B")], "lat double, lon double, height int, kind string, name string")
    rows = dataset.landmark_tile_rows(t)
    dataset.write_tiles(rows, str(tmp_path / "lm"))
    assert sorted(p.name for p in (tmp_path / "lm").glob("tile=*")) == ["tile=-1_8", "tile=46_8"]
    back = sorted((r.lat, r.lon, r.height, r.kind, r.name) for r in readers.read_landmark_tiles(spark, str(tmp_path / "lm" / "*")).collect())
    assert back == [(-0.5, 8.0, 20, "t", "B"), (46.12346, 8.5, 45, "t", 'A "q"'), (46.2, 8.1, None, "c", "")]
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "lm").rglob("part-*")}
    old = spark.createDataFrame(rows.collect(), rows.schema)
    new = old.where("tile = '46_8'").union(spark.createDataFrame([("1_1", "[]")], old.schema)).union(old.where("tile != '46_8'").withColumn("rows", F.lit("[]")))
    dataset.write_tiles(new, str(tmp_path / "lm"), old)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "lm").rglob("part-*")}
    kept = {p for p in before if after.get(p) == before[p]}
    assert {p.parent.name for p in kept} == {"tile=46_8"} and {p.parent.name for p in after} == {"tile=46_8", "tile=-1_8", "tile=1_1"}


def test_progress_of_tiles(spark):
    from vistaframe.operators import panorama

    needed = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a")], "obs_id long, tile string")
    got = spark.createDataFrame([("a", True), ("b", False)], "tile string, ok boolean")
    assert sorted(map(tuple, panorama.tile_progress(needed, got).collect())) == [(1, 3, 2, 1), (2, 1, 1, 0)]


def test_a_long_chain_of_duplicates_is_merged(spark):
    """Each row is a duplicate of the next only: one component over many blocks."""
    n = 20_000
    rows = spark.range(1, n + 1).selectExpr("id AS ordinal", "id", "'Alp' AS name", "map('de', 'x') AS names", "10D AS lat", "id * 0.01 AS lon", "1000D AS ele", "'peak' AS kind", "CAST(null AS STRING) AS qid")
    left, merged = dataset.merge_duplicates(rows, spark.createDataFrame([], "qid string, n int"))
    # 0.01 degrees are 1095 m: row 1 takes 2; 3 takes 4, and so on
    assert merged == n // 2 and left.agg({"id": "sum"}).first()[0] == (n // 2) ** 2
