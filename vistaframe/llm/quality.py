"""Quality classifier: a factorisation machine over hashed words and structure statistics.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise sum is half of the sum over
factors of (sum v x)^2 - sum v^2 x^2, so a text is scored in time linear in its features.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaframe.llm.common import U, WordHash, added
from vistaframe.llm.textstats import ratios, text_stats

#: Labelled rows the model is fitted on at most: those with the smallest hashes of their doc_id.
FIT_ROWS = 8192
BUCKETS = 1 << 15
FACTORS = 8
EPOCHS = 12
BATCH = 128
RATE = 0.08
SHRINK = 1e-5
#: Least score of a text that is predicted good.
GOOD = 0.3


def features(texts: list, hashes: WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(statistics by text, then bucket and text of every distinct hashed word)."""
    counts, words, doc = text_stats(texts, hashes)
    pair = np.unique(doc * BUCKETS + (words % U(BUCKETS)).astype(np.int64))
    return ratios(counts), pair % BUCKETS, pair // BUCKETS


class FactorisationMachine:
    def __init__(self, stats: np.ndarray, seed: int = 7):
        self.mean, self.std = stats.mean(0), stats.std(0) + 1e-3
        n = BUCKETS + stats.shape[1]
        self.bias, self.w = 0.0, np.zeros(n)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (n, FACTORS))

    def rows(self, stats, bucket, doc):
        """Feature, value and text of each non-zero: words share unit length, statistics are scaled."""
        n, d = stats.shape
        size = np.bincount(doc, minlength=n)
        x = np.clip((stats - self.mean) / self.std, -4, 4) / 2
        feature = np.concatenate([bucket, np.tile(np.arange(BUCKETS, BUCKETS + d), n)])
        return feature, np.concatenate([1 / np.sqrt(size[doc]), x.ravel()]), np.concatenate([doc, np.repeat(np.arange(n), d)])

    def raw(self, feature, value, doc, n):
        vx = self.v[feature] * value[:, None]
        total = np.stack([np.bincount(doc, vx[:, f], n) for f in range(FACTORS)], axis=1)
        squares = np.bincount(doc, (vx * vx).sum(1), n)
        return self.bias + np.bincount(doc, self.w[feature] * value, n) + 0.5 * ((total**2).sum(1) - squares), vx, total

    def score(self, stats, bucket, doc) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.rows(stats, bucket, doc), len(stats))[0], -30, 30)))

    def fit(self, stats, words: list[np.ndarray], y: np.ndarray, seed: int = 11):
        order, g_w, g_v, g_b = np.random.default_rng(seed), np.full(len(self.w), 1e-3), np.full(self.v.shape, 1e-3), 1e-3
        for _ in range(EPOCHS):
            shuffled = order.permutation(len(y))
            for s in range(0, len(y), BATCH):
                rows = shuffled[s : s + BATCH]
                doc = np.repeat(np.arange(len(rows)), [len(words[i]) for i in rows])
                bucket = np.concatenate([words[i] for i in rows]) if len(doc) else np.empty(0, np.int64)
                feature, value, doc = self.rows(stats[rows], bucket, doc)
                z, vx, total = self.raw(feature, value, doc, len(rows))
                slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
                used, at = np.unique(feature, return_inverse=True)
                d = slope[doc] * value
                d_w = np.bincount(at, d, len(used)) + SHRINK * self.w[used]
                pull = d[:, None] * (total[doc] - vx)
                d_v = np.stack([np.bincount(at, pull[:, f], len(used)) for f in range(FACTORS)], axis=1) + SHRINK * self.v[used]
                d_b = slope.sum()
                g_w[used] += d_w**2
                g_v[used] += d_v**2
                g_b += d_b**2
                self.w[used] -= RATE * d_w / np.sqrt(g_w[used])
                self.v[used] -= RATE * d_v / np.sqrt(g_v[used])
                self.bias -= RATE * d_b / np.sqrt(g_b)
        return self


def held_out(doc_id="doc_id"):
    """Rows never learned from: crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame) -> FactorisationMachine | None:
    """A model of labels.quality from at most FIT_ROWS rows that aren't held out; None without such rows. Of
    rows of docs that share an id, the one with the smallest hash of its text is learned from."""
    labels = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out())
    labels = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def make():
        hashes = WordHash()

        def describe(texts):
            stats, bucket, doc = features(texts, hashes)
            return stats.tolist(), [x.tolist() for x in np.split(bucket, np.searchsorted(doc, np.arange(1, len(stats))))]

        return describe

    described = added(rows.withColumn("key", F.xxhash64("text")), ["text"], "stats array<double>, words array<int>", make, drop=("text",))
    # one row an id: what reaches the driver is bounded by FIT_ROWS
    one = described.groupBy("doc_id").agg(F.min_by(F.struct("quality", "stats", "words"), F.struct("key", "stats")).alias("x"))
    sample = one.select("doc_id", "x.*").toPandas()
    if not len(sample):
        return None
    sample = sample.sort_values("doc_id")
    stats = np.stack(sample.stats.to_list())
    return FactorisationMachine(stats).fit(stats, [np.asarray(w, np.int64) for w in sample.words], sample.quality.to_numpy(float))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` with score (0 to 1, higher: quality 1 is likelier) and predicted (1 if score >= GOOD).

    The model learns from `labels` (doc_id, quality) rows that aren't held out; scores depend on the text
    alone. Null and empty texts are scored as texts without words. Without labels every score is 0.5. A
    doc_id labelled twice counts with its lowest label, and of rows with one doc_id one is learned from. Columns
    of docs named score or predicted are replaced; all others, ids and nulls among them, stay as they are.
    """
    docs = docs.drop("score", "predicted")
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    def make():
        hashes, m = WordHash(), model.value
        return lambda texts: (m.score(*features(texts, hashes)) if m else np.full(len(texts), 0.5),)

    scored = added(docs, ["text"], "score double", make)
    return scored.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))
