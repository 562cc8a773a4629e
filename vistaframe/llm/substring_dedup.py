"""Substring dedup by difference-cover anchors.

A set D of residues modulo PERIOD is a difference cover if every difference of two residues is a
difference of two members. Then any two equal passages of PERIOD - 1 + ANCHOR words hold an equal
ANCHOR-word window that starts at a cover position of both documents. Only windows at cover positions
are hashed and shuffled; where one is found in two documents, the full windows around it are compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaframe.llm.common import U, WordHash, added, blocks, listed, mix, spaced_words, written

#: A perfect difference set modulo 31: each non-zero residue is a difference exactly once.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)

#: Bytes of text whose passages are compared within a task.
SHARED_BYTES = 32 << 20

BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class Windows:
    """Hashes of all windows of a word sequence, in time that doesn't depend on their width."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def of(self, words: np.ndarray, width: int) -> np.ndarray:
        n = len(words)
        if len(self.up) < n:
            size = max(n, 4096)
            self.up = np.cumprod(np.r_[U(1), np.full(size - 1, self.base, U)], dtype=U)
            self.down = np.cumprod(np.r_[U(1), np.full(size - 1, self.inverse, U)], dtype=U)
        total = np.r_[U(0), np.cumsum(words * self.up[:n], dtype=U)]
        return mix((total[width:] - total[:-width]) * self.down[: n - width + 1])


def cover_positions(n: int) -> np.ndarray:
    """Positions below n whose residue modulo PERIOD is in the cover."""
    at = (np.arange(0, n + PERIOD, PERIOD)[:, None] + np.array(COVER)).ravel()
    return at[at < n]


def _blocked(batches, size):
    """The batches cut into blocks of at most SHARED_BYTES, or of one row."""
    for b in batches:
        for at in blocks(size(b), SHARED_BYTES):
            yield b.iloc[at]


def _anchors(docs: DataFrame, width: int) -> DataFrame:
    """(h, doc_id, tk, shared, meets): each anchor of a document once. One that two documents of a block hold is
    shared without a shuffle, and one of its rows goes on to meet the other blocks'."""

    anchor = width - PERIOD + 1

    def find(batches):
        hashes, rolling = WordHash(), Windows(BASES[0])
        for b in _blocked(batches, lambda b: b.text.str.len().fillna(0)):
            h, row = [], []
            for i, t in enumerate(b.text):
                w = spaced_words(t)
                if len(w) >= width:
                    x = rolling.of(hashes.of(w), anchor)
                    h.append(np.unique(x[cover_positions(len(x))]))
                    row.append(np.full(len(h[-1]), i))
            if not h:
                continue
            h, row = np.concatenate(h), np.concatenate(row)
            ids = b.doc_id.to_numpy()
            order = np.lexsort((ids[row], h))
            h, row = h[order], row[order]
            d = ids[row]
            new = np.r_[True, h[1:] != h[:-1]]
            start = np.flatnonzero(new)
            stop = np.r_[start[1:], len(h)] - 1
            shared = (d[start] != d[stop])[np.cumsum(new) - 1]
            # of a shared anchor the first row speaks for the block; rows of one id with different texts all go on
            yield pd.DataFrame({"h": h.view(np.int64), "doc_id": d, "tk": b.tk.to_numpy()[row], "shared": shared, "meets": new | ~shared})

    return docs.mapInPandas(find, "h long, doc_id long, tk long, shared boolean, meets boolean")


def _shared(anchors: DataFrame) -> DataFrame:
    """(doc_id, tk, h) of anchors that occur in two documents. Of a key only the rows of its smallest document wait
    for the next batch; a block sends one row a key if it has several, so no key has many rows."""

    def meet(batches):
        key, first, many, waiting = None, None, False, []
        for b in batches:
            if not len(b):
                continue
            h, d = b.h.to_numpy(), b.doc_id.to_numpy()
            new = np.r_[True, h[1:] != h[:-1]]
            group = np.cumsum(new) - 1
            start = np.flatnonzero(new)
            stop = np.r_[start[1:], len(h)] - 1
            low, on = d[start].copy(), h[0] == key
            if on:
                low[0] = first
            several = d[stop] != low
            several[0] |= on and many
            if on and several[0]:
                yield from waiting
            if not on or several[0]:
                waiting = []
            out = several[group] | b.shared.to_numpy()
            yield b.loc[out, ["doc_id", "tk", "h"]]
            key, first, many = h[-1], low[-1], bool(several[-1])
            if len(start) > 1:
                waiting = []
            if not many:
                waiting.append(b.loc[(group == group[-1]) & ~out, ["doc_id", "tk", "h"]])

    meeting = anchors.where("meets").repartition("h").sortWithinPartitions("h", "doc_id").mapInPandas(meet, "doc_id long, tk long, h long")
    return meeting.union(anchors.where("NOT meets").select("doc_id", "tk", "h"))


def _windows(docs: DataFrame, width: int) -> DataFrame:
    """(h, c, doc_id, tk, pos, known): the windows around a document's shared anchors (spots), each once for a
    document. Of a block, the smallest document of each window goes on; the others repeat it (known)."""

    anchor = width - PERIOD + 1

    def find(batches):
        hashes, one, two = WordHash(), Windows(BASES[0]), Windows(BASES[1])
        for b in _blocked(batches, lambda b: b.text.str.len() + 8 * b.spots.str.len()):
            ids, tks = b.doc_id.to_numpy(), b.tk.to_numpy()
            h, c, row, pos = [], [], [], []
            for i, (t, spots) in enumerate(zip(b.text, b.spots)):
                a = hashes.of(spaced_words(t))
                at = one.of(a, anchor)
                at = (p := cover_positions(len(at)))[np.isin(at[p], np.asarray(spots, np.int64).view(U))]
                x = one.of(a, width)
                marks = np.zeros(len(x) + 1, np.int32)
                np.add.at(marks, np.clip(at - PERIOD + 1, 0, len(x)), 1)
                np.add.at(marks, np.minimum(at + 1, len(x)), -1)
                p = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
                _, first = np.unique(x[p], return_index=True)
                p = p[first]
                h.append(x[p])
                c.append(two.of(a, width)[p] >> U(33))
                row.append(np.full(len(p), i))
                pos.append(p)
            if not h:
                continue
            h, c, row, pos = np.concatenate(h), np.concatenate(c).astype(np.int32), np.concatenate(row), np.concatenate(pos)
            order = np.lexsort((ids[row], c, h))
            h, c, row, pos = h[order], c[order], row[order], pos[order]
            d = ids[row]
            new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
            known = d > d[np.flatnonzero(new)][np.cumsum(new) - 1]
            # documents that are already known to repeat a window need no meeting: any key will do
            key = np.where(known, mix((pos.astype(U) << U(40)) ^ d.astype(U)), h).view(np.int64)
            yield pd.DataFrame({"h": key, "c": c, "doc_id": d, "tk": tks[row], "pos": pos.astype(np.int32), "known": known})

    return docs.mapInPandas(find, "h long, c int, doc_id long, tk long, pos int, known boolean")


def _repeated(windows: DataFrame) -> DataFrame:
    """(doc_id, tk, pos) of windows that also start in a smaller document; between batches only the last window
    and its smallest document are kept."""

    def meet(batches):
        last = None
        for b in batches:
            if not len(b):
                continue
            h, c, d = b.h.to_numpy(), b.c.to_numpy(), b.doc_id.to_numpy()
            new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
            low = d[np.flatnonzero(new)].copy()
            if last is not None and last[:2] == (h[0], c[0]):
                low[0] = last[2]
            low = low[np.cumsum(new) - 1]
            yield b.loc[d > low, ["doc_id", "tk", "pos"]]
            last = h[-1], c[-1], low[-1]

    meeting = windows.where("NOT known").repartition("h").sortWithinPartitions("h", "c", "doc_id").mapInPandas(meet, "doc_id long, tk long, pos int")
    return meeting.union(windows.where("known").select("doc_id", "tk", "pos"))


def _kept(docs: DataFrame, width: int) -> DataFrame:
    def make():
        hashes, rolling = WordHash(), Windows(BASES[0])

        def keep(texts, spots, wholes):
            n, removed, kept = [], [], []
            for t, at, whole in zip(texts, spots, wholes):
                w = spaced_words(t)
                if whole and len(w) >= width:
                    gone = np.ones(len(w), bool)
                elif at is not None and len(w) >= width:
                    x = rolling.of(hashes.of(w), width)
                    hit = np.isin(x, x[np.asarray(at)])
                    depth = np.r_[hit.astype(np.int32), np.zeros(width, np.int32)]
                    depth[width:] -= hit
                    gone = np.cumsum(depth[: len(w)]) > 0
                else:
                    gone = None
                n.append(len(w))
                removed.append(0 if gone is None else int(gone.sum()))
                kept.append(b" ".join(w if gone is None else [x for x, g in zip(w, gone.tolist()) if not g]).decode())
            return n, removed, kept

        return keep

    return added(docs, ["text", "spots", "whole"], "n_words long, n_removed long, kept string", make, drop=("text", "spots", "whole"))


def without_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_words, n_removed, kept (the words left, joined
    by one space).

    Words are runs of characters other than space and U+0009 to U+000D. A word goes if a window of `width`
    consecutive words covers it whose word sequence also starts in a row with a smaller doc_id; windows are
    judged on the input. A null text has no words. A row with a null doc_id neither loses words nor
    takes part. Rows that share a doc_id don't take words from one another. Other columns are ignored.
    `width` must be over PERIOD. Windows are compared by 95 bits of hashes.
    """
    if width <= PERIOD:
        raise ValueError(f"width must be over {PERIOD}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tk"))
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    # whole copies of a smaller document's text need no anchors
    texts = written(known.select("doc_id", "tk", F.md5("text").alias("md5")))
    first = written(texts.groupBy("md5").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    copies = written(texts.join(listed(first), "md5").where("doc_id > first").select("doc_id", "tk").distinct())
    firsts = known.join(listed(copies), ["doc_id", "tk"], "left_anti")
    spots = written(_shared(written(_anchors(firsts, width))).groupBy("doc_id", "tk").agg(F.collect_set("h").alias("spots")))
    near = known.join(listed(spots.select("doc_id", "tk")), ["doc_id", "tk"], "left_semi").join(spots, ["doc_id", "tk"])
    repeated = _repeated(written(_windows(near, width))).groupBy("doc_id", "tk").agg(F.collect_set("pos").alias("spots"))
    marks = written(repeated.withColumn("whole", F.lit(False)).union(copies.select("doc_id", "tk", F.lit(None).cast("array<int>").alias("spots"), F.lit(True).alias("whole"))))
    keys = listed(marks.select("doc_id", "tk"))
    changed = docs.join(keys, ["doc_id", "tk"], "left_semi").join(marks, ["doc_id", "tk"])
    same = docs.join(keys, ["doc_id", "tk"], "left_anti").withColumns({"spots": F.lit(None).cast("array<int>"), "whole": F.lit(False)})
    return _kept(changed.select("doc_id", "text", "spots", "whole").union(same.select("doc_id", "text", "spots", "whole")), width)


