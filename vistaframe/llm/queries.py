"""The queries of these operators, one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaframe.llm.anomaly import judged as judged_rules
from vistaframe.llm.common import table
from vistaframe.llm.decontaminate import contamination
from vistaframe.llm.html_extract import main_texts
from vistaframe.llm.lexical_search import top_documents
from vistaframe.llm.line_dedup import without_common_lines
from vistaframe.llm.mixing import mixed
from vistaframe.llm.quality import held_out, quality_scores
from vistaframe.llm.secret_scan import KINDS, as_text, secret_spans
from vistaframe.llm.shingle_join import shingle_components
from vistaframe.llm.substring_dedup import without_repeats
from vistaframe.llm.token_alignment import aligned, with_link_counts
from vistaframe.llm.url_filter import BLOCKED_HOSTS, RULES, filtered, listed_hosts
from vistaframe.llm.warc import read_archives, write_archives


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = [(p, v, True) for p, v in RULES] + [(f"{h}/", "block", False) for h in BLOCKED_HOSTS]
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    stated = spark.createDataFrame(entries, "prefix string, verdict string, is_rule boolean")
    judged = filtered(pages, stated.union(listed_hosts(pages)))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"), 13)
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_scores(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"CAST(size(filter(base_spans, x -> x.kind = {i})) AS BIGINT)").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(as_text("base_spans"), 256).alias("base_sha256"), as_text("spans").alias("spans"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages")))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomalous", "score")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = main_texts(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = without_repeats(table(spark, sf_dir, "documents"), 50)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = without_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str, folder: str = "/opt/tokenizers") -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = aligned(docs, f"{folder}/byte_bpe_50k.json", f"{folder}/piece_bpe_32k.model")
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    counted = with_link_counts(found.withColumn("groups_sha256", digest).drop("groups"))
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_benchmark_decontamination,
        op3_quality_classifier,
        op4_secret_scans,
        op5_warc,
        op6_ngram_jaccard_join,
        op7_quality_rules,
        op8_mixing,
        op9_html_extraction,
        op10_substring_dedup,
        op11_line_dedup,
        op12_token_alignment,
        op13_lexical_search,
    )
}
