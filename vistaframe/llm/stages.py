"""Pipeline stages: each takes (spark, docs, sf_dir) and returns the documents it leaves, but for the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaframe.llm.common import listed, table, written
from vistaframe.llm.decontaminate import contamination
from vistaframe.llm.mixing import mixed
from vistaframe.llm.quality import quality_scores
from vistaframe.llm.secret_scan import redacted
from vistaframe.llm.shingle_join import shingle_components
from vistaframe.shipping import ship


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject.

    Null and empty texts are scored like others. A row is judged by its text alone, so rows that repeat an id or a text stay or
    go each; other columns, whatever their names, pass unchanged. An empty table gives none."""
    return quality_scores(docs, table(ship(spark), sf_dir, "labels")).where("predicted = 1").select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more) the document with
    the smallest doc_id; of rows that share a doc_id, the one with the smallest text (null first), then the smallest other
    columns in their order.

    Rows with a null doc_id stay, and so do null, empty and wordless texts, which resemble nothing. Other columns, whatever
    their names, pass unchanged. An empty table gives none."""
    ship(spark)
    groups = shingle_components(docs, 5, 80)
    gone = listed(written(groups.where("doc_id <> component_id").select("doc_id").distinct()))
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    twice = listed(written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")))
    once = left.join(twice, "doc_id", "left_anti").select(docs.columns)
    # columns without an order, as maps are, come along as they are
    sorts = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind and kind not in ("variant", "void")]
    row = F.min_by(F.struct(*docs.columns), F.struct("text", *sorts)).alias("row")
    again = left.join(twice, "doc_id", "left_semi").select(docs.columns).groupBy("doc_id").agg(row)
    return once.union(again.select("row.*").select(docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words fewer than a twentieth are in passages of benchmark items.

    Null, empty and wordless texts stay. Rows are judged one by one, so repeated ids and texts don't matter; other columns,
    whatever their names, pass unchanged. An empty table gives none."""
    found = contamination(docs, table(ship(spark), sf_dir, "benchmark"), 13)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.where(~((hit > 0) & (20 * hit >= F.col("n_words")))).select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark.

    Null and empty texts stay as they are. Every row stays, repeated ids and texts too; other columns, whatever their names,
    pass unchanged, but for n_chars, which is counted anew. An empty table gives none."""
    return redacted(docs).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document of the mix.

    Null and empty texts have size 0 and no copies; a null source is a source of its own; rows that repeat an id are
    documents of their own. Other columns are ignored. An empty table gives none."""
    return mixed(docs)
