"""Large ids beside a null one come out of every operator and stage as they went in."""

import pytest

from corpus_pipeline import STAGES
from vistaframe.llm import queries

IDS = [2**53 + 1, 2**53 + 3, 2**63 - 1, -(2**53) - 1, None]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("ids"))
    words = lambda i: " ".join(f"w{i}x{j % (60 + i)}" for j in range(90))
    docs = [(d, words(i), "en", "s", 1, None if i else 2**53 + 1) for i, d in enumerate(IDS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, extra long").coalesce(1).write.parquet(f"{at}/documents.parquet")
    pages = [(d, f"http://h/{i}", f"<article>{words(i)}</article>") for i, d in enumerate(IDS)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(d, 1, 0) for d in IDS], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "b c d e f g h i j k l m n o")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def ids(rows, name):
    return sorted((r[name] for r in rows), key=str)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_queries_keep_ids(spark, folder, name):
    rows = queries.QUERIES[name](spark, folder).collect()
    assert ids(rows, "page_id" if "page_id" in rows[0] else "doc_id") == sorted(IDS, key=str)
    if "component_id" in rows[0]:
        assert all(r.component_id == r.doc_id for r in rows)


@pytest.mark.parametrize("name, stage", STAGES)
def test_stages_keep_ids_and_columns(spark, folder, name, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = stage(spark, docs, folder).collect()
    assert ids(rows, "doc_id") == sorted(IDS, key=str)
    if name != "mixing":
        assert {(r.doc_id, r.extra) for r in rows} == {(d, None if i else 2**53 + 1) for i, d in enumerate(IDS)}


@pytest.mark.parametrize("name, stage", STAGES)
def test_stages_take_empty_tables_and_texts(spark, folder, name, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    none = stage(spark, docs.limit(0), folder)
    assert none.collect() == []
    assert name == "mixing" or none.columns == docs.columns
    odd = docs.selectExpr("doc_id", "CASE WHEN doc_id > 0 THEN '' END AS text", "lang", "source", "n_chars", "extra")
    rows = stage(spark, odd, folder).collect()
    # texts without words: all or none are of good quality, and each other stage keeps them
    assert len(rows) in ((0, len(IDS)) if name == "quality" else (len(IDS),))


@pytest.mark.parametrize("name", queries.QUERIES)
def test_queries_take_empty_tables(spark, folder, tmp_path, name):
    for t in ("documents", "pages", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []
