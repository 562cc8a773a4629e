"""Corpus pipeline: stages over `documents`, each written and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vistaframe.llm import stages
from vistaframe.llm.common import table, written

STAGES = [
    ("quality", stages.good_quality),
    ("near_duplicates", stages.one_of_each_group),
    ("decontamination", stages.decontaminated),
    ("secrets", stages.without_secrets),
    ("mixing", stages.mix),
]

#: SQL can't express a trained model or Newton iterations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
