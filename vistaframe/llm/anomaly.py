"""Quality rules: counts of whole texts, fixed rules, and an isolation forest on the rule statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaframe.llm.common import WordHash, added, written
from vistaframe.llm.textstats import COLUMNS, ratios, text_stats

TREES, TREE_ROWS = 128, 256
#: Labelled rows the trees are drawn from at most: those with the smallest hashes of their doc_id.
FIT_ROWS = TREES * TREE_ROWS
#: Scores are compared with labels in so many steps.
STEPS = 2000
#: Largest share of the rows labelled good that the threshold may reject.
GOOD_LOST = 0.01


def _expected(n):
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees of random splits; rows that few splits set apart score near 1."""

    def __init__(self, x: np.ndarray, seed: int = 5):
        r = np.random.default_rng(seed)
        self.size = min(TREE_ROWS, len(x))
        self.height = max(1, int(np.ceil(np.log2(max(2, self.size)))))
        full = 2 ** (self.height + 1) - 1
        self.feature = np.full((TREES, full), -1, np.int32)
        self.split = np.zeros((TREES, full))
        self.length = np.zeros((TREES, full))
        for t in range(TREES):
            todo = [(0, 0, x[r.choice(len(x), self.size, replace=False)])]
            while todo:
                node, depth, rows = todo.pop()
                low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
                varied = np.flatnonzero(high > low)
                if depth == self.height or len(rows) < 2 or not len(varied):
                    self.length[t, node] = depth + float(_expected(len(rows)))
                    continue
                f = int(r.choice(varied))
                at = r.uniform(low[f], high[f])
                self.feature[t, node], self.split[t, node] = f, at
                left = rows[:, f] < at
                todo += [(2 * node + 1, depth + 1, rows[left]), (2 * node + 2, depth + 1, rows[~left])]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, split, length in zip(self.feature, self.split, self.length):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.height):
                f = feature[node]
                inner = f >= 0
                right = x[np.arange(len(x)), np.maximum(f, 0)] >= split[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += length[node]
        return 2.0 ** (-total / TREES / max(float(_expected(self.size)), 1e-9))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of COLUMNS and their ratios (stats) for each row of docs (doc_id, text)."""

    def make():
        hashes = WordHash()

        def count(texts):
            counts, _, _ = text_stats(texts, hashes)
            return *counts.T, ratios(counts).tolist()

        return count

    gives = ", ".join(f"{c} long" for c in COLUMNS) + ", stats array<double>"
    return added(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["text"], gives, make, drop=("text",))


def best_threshold(tally: list[tuple[int, int, int]]) -> float:
    """From (step, rows labelled bad, good): the least score that is rejected. Of the thresholds that keep
    all but GOOD_LOST of the good rows, the one that rejects the most bad less good rows; 2 if none does."""
    good = sum(g for _, _, g in tally)
    best, at, bad_gone, good_gone = 0, 2.0, 0, 0
    for step, b, g in sorted(tally, reverse=True):
        bad_gone, good_gone = bad_gone + b, good_gone + g
        if good_gone <= GOOD_LOST * good and bad_gone - good_gone > best:
            best, at = bad_gone - good_gone, step / STEPS
    return at


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, the counts of COLUMNS, base_failed, score (of the
    forest), anomalous and kept.

    base_failed: fewer than 50 words, or over half of the words are in three-word windows the text holds
    twice or more. anomalous: the score reaches a threshold set on all rows of `labels` (doc_id, quality)
    that aren't null and don't fail. kept: neither. Null and empty texts have no words and so fail; without labels nothing
    is anomalous. A doc_id labelled twice counts with its lowest label; of rows with one doc_id, one is drawn
    from. Other columns are ignored.
    """
    spark = docs.sparkSession
    counted = written(statistics(docs))
    labels = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS).select("doc_id")
    # one row an id: what reaches the driver is bounded by FIT_ROWS
    drawn = counted.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("stats").alias("stats"))
    sample = sorted(tuple(r.stats) for r in drawn.collect())
    forest = spark.sparkContext.broadcast(IsolationForest(np.array(sample)) if len(sample) > 1 else None)

    def make():
        f = forest.value
        return lambda stats: (f.score(np.array(stats)) if f and len(stats) else np.zeros(len(stats)),)

    scored = written(added(counted, ["stats"], "score double", make, drop=("stats",)))
    base = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    steps = scored.where(~base).join(labels, "doc_id").groupBy(F.floor(F.col("score") * STEPS).alias("step"))
    tally = steps.agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") != 0).alias("good")).collect()
    least = best_threshold([tuple(r) for r in tally])
    return scored.withColumns({"base_failed": base, "anomalous": F.floor(F.col("score") * STEPS) / STEPS >= F.lit(least)}).withColumn("kept", F.expr("NOT base_failed AND NOT anomalous"))
