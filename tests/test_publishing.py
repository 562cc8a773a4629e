import json

import pytest

from vistaframe.operators import dataset, publishing


def tiles(spark, **rows):
    return spark.createDataFrame([(k.replace("t", "4_"), v) for k, v in rows.items()], "tile string, rows string")


def shown(spark, root):
    return {r.tile: r.rows for r in publishing.published(spark, root).collect()}


def test_versions_swap_whole_and_only_on_change(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "set")
    assert shown(spark, root) == {} and publishing.current(spark, root) is None
    one = publishing.publish(spark, root, tiles(spark, t1="[[1]]", t2="[[2,\"a\\nb\"]]", t3="[[3]]"), "monday")
    assert one["swapped"] and one["added"] == 3 and shown(spark, root) == {"4_1": "[[1]]", "4_2": '[[2,"a\\nb"]]', "4_3": "[[3]]"}
    same = publishing.publish(spark, root, tiles(spark, t1="[[1]]", t2="[[2,\"a\\nb\"]]", t3="[[3]]"), "monday")
    assert not same["swapped"] and same["version"] == one["version"]
    # a run that dies before the swap leaves the old set
    with monkeypatch.context() as m:
        m.setattr(publishing._Store, "swap", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            publishing.publish(spark, root, tiles(spark, t1="[[9]]"), "tuesday")
    assert shown(spark, root)["4_1"] == "[[1]]" and publishing.current(spark, root)["extract"] == "monday"
    two = publishing.publish(spark, root, tiles(spark, t1="[[1]]", t2="[[5]]", t4="[[4]]"), "tuesday")
    assert {k: two[k] for k in ("added", "changed", "removed", "swapped")} == {"added": 1, "changed": 1, "removed": 1, "swapped": True}
    assert shown(spark, root) == {"4_1": "[[1]]", "4_2": "[[5]]", "4_4": "[[4]]"}
    stamp = publishing.publish(spark, root, tiles(spark, t1="[[1]]", t2="[[5]]", t4="[[4]]"), "wednesday")
    assert stamp["swapped"] and publishing.current(spark, root)["n"] == 3 and len(shown(spark, root)) == 3


def test_rebuilds_from_an_extract_and_from_its_tiles(spark, tmp_path):
    root = str(tmp_path / "set")
    feature = lambda i, name, lat, lon, **tags: json.dumps({"type": "Feature", "id": f"n{i}", "geometry": {"type": "Point", "coordinates": [lon, lat]}, "properties": {"natural": "peak", "name": name, **tags}})
    lines = [feature(1, "Alp", 46.1234567, 8.1, ele="2000"), feature(2, "Alp", 46.1235, 8.1, wikidata="Q7"), feature(3, "Horn", 47.5, 8.9, **{"name:en": "Horn peak"})]
    (tmp_path / "extract").write_text("\n".join(lines))
    fame = spark.createDataFrame([("Q7", 4)], "qid string, n int")
    got = publishing.rebuild(spark, root, fame, f"{tmp_path}/extract", "s1", least=2)
    assert got["merged"] == 1 and got["added"] == 2 and got["swapped"]
    peaks = {r.id: r for r in publishing.peaks_of_rows(publishing.published(spark, root), "rows").collect()}
    assert set(peaks) == {2, 3} and peaks[2].fame == 4 and peaks[2].ele == 2000 and peaks[3].names == {"en": "Horn peak"}
    assert not publishing.rebuild(spark, root, fame, least=2)["swapped"]
    more = publishing.rebuild(spark, root, spark.createDataFrame([("Q7", 9)], "qid string, n int"), least=2)
    assert more["changed"] == 1 and publishing.current(spark, root)["extract"] == "s1"
    assert {r.id: r.fame for r in publishing.peaks_of_rows(publishing.published(spark, root), "rows").collect()} == {2: 9, 3: 0}
    with pytest.raises(ValueError):
        publishing.rebuild(spark, root, fame, f"{tmp_path}/extract", "s2", least=3)
    assert publishing.current(spark, root)["extract"] == "s1"


def test_the_manifest_of_tiles(spark):
    got = dataset.tile_manifest(tiles(spark, t2="x", t1="y")).first()
    assert got.tiles == ["4_1", "4_2"] and got.n == 2
