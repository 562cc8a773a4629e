"""Ranked lexical search: Block-Max MaxScore over the inverted lists of shards.

A shard is a bounded run of documents within a task. For each term that a query has it holds a list of blocks: gaps
between documents and term counts as variable-length bytes, with the block's first and last document and its largest
score part outside the bytes. A query sorts its lists by their bounds; those that together can't lift a document into the best k
are non-essential. Candidates come from essential lists only, and a block's maximum rejects a candidate before the
block of a non-essential list is unpacked. A task keeps its best k from shard to shard; Spark merges those of all tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vistaframe.llm.common import added, alnum_words, blocks, byte_sizes, written

#: UTF-8 bytes of text in a shard, or one document.
SHARD_BYTES = 64 << 20
#: Entries of a block.
BLOCK = 128
#: Documents of the first stretch of a shard that is searched; each further one is this many times as long.
STRETCH, LONGER = 512, 8
#: Bytes that the queries searched for at once may take in Python; more are searched in further passes.
PART_BYTES = 64 << 20


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits, the last byte of each below 128; and where each starts."""
    v = values.astype(np.uint64)
    n = np.ones(len(v), np.int64)
    for k in range(1, 10):
        n += v >= np.uint64(1 << 7 * k)
    start = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.uint8)
    for k in range(int(n.max(initial=0))):
        on = n > k
        more = np.where(n[on] > k + 1, 128, 0)
        out[start[on] + k] = (v[on] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | more.astype(np.uint8)
    return out, start


def unpacked(data: np.ndarray) -> np.ndarray:
    last = data < 128
    if last.all():
        return data.astype(np.int64)
    start = np.flatnonzero(np.r_[True, last[:-1]])[: int(last.sum())]
    at = np.arange(len(data)) - np.repeat(start, np.diff(np.r_[start, len(data)]))
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * at, start) if len(start) else np.zeros(0, np.int64)


class Lists:
    """The lists of one shard: (term, doc, tf) sorted by term and document, and each entry's score part."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, m: np.ndarray):
        part = parts(tf, m[doc])
        fresh = np.r_[True, term[1:] != term[:-1]] if len(term) else np.zeros(0, bool)
        begin = np.flatnonzero(fresh)
        rank = np.arange(len(term)) - np.repeat(begin, np.diff(np.r_[begin, len(term)]))
        head = rank % BLOCK == 0
        gap = np.where(head, 0, np.diff(doc, prepend=0))
        self.data, at = packed(np.stack([gap, tf], axis=1).reshape(-1))
        first = np.flatnonzero(head)
        self.at = np.r_[at[2 * first], len(self.data)]
        end = np.r_[first[1:], len(term)]
        self.first = doc[first]
        self.last = doc[end - 1] if len(first) else np.zeros(0, np.int64)
        self.most = np.maximum.reduceat(part, first) if len(first) else np.zeros(0, np.int64)
        stop = np.r_[begin[1:], len(term)]
        self.of = {int(t): (int(x), int(y)) for t, x, y in zip(term[begin], np.searchsorted(first, begin), np.searchsorted(first, stop))}
        self.bound = {t: int(self.most[x:y].max()) for t, (x, y) in self.of.items()}
        self.m = m

    def read(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, score parts) of blocks `which` (ascending), unpacked."""
        runs = np.split(which, np.flatnonzero(np.diff(which) > 1) + 1) if which[-1] - which[0] >= len(which) else [which]
        bytes_ = [self.data[self.at[r[0]] : self.at[r[-1] + 1]] for r in runs]
        both = unpacked(np.concatenate(bytes_) if len(runs) > 1 else bytes_[0])
        gap, tf = both[::2], both[1::2]
        # blocks of one list are full but for its last, so a block begins at each BLOCK-th entry
        doc = np.cumsum(gap)
        doc += (self.first[which] - doc[::BLOCK])[np.arange(len(doc)) // BLOCK]
        return doc, parts(tf, self.m[doc])


def parts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Best:
    """The k best (score, id) of a query so far: highest score, then smallest id, null ids last."""

    def __init__(self, k: int):
        self.k, self.score, self.ids, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def need(self) -> int:
        """A document that scores less has no place."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = np.r_[self.score, score], np.r_[self.ids, ids], np.r_[self.null, null]
        order = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.ids, self.null = score[order], ids[order], null[order]


def search(lists: Lists, query: dict[int, int], ids: np.ndarray, null: np.ndarray, best: Best) -> None:
    """Adds the shard's best documents. query: the weight of each term, its repeats included."""
    terms = sorted((t for t in query if t in lists.of), key=lambda t: query[t] * lists.bound[t])
    weight = [query[t] for t in terms]
    span = [lists.of[t] for t in terms]
    upto = np.cumsum([0, *(query[t] * lists.bound[t] for t in terms)]).tolist()  # what the first i lists can give together
    low, size = 0, STRETCH
    while low < len(ids) and upto[-1] >= best.need:
        high = min(len(ids), low + size)
        need = best.need
        first = next(i for i in range(len(terms)) if upto[i + 1] >= need)
        score, seen = np.zeros(high - low, np.int64), np.zeros(high - low, bool)
        for (x, y), w in zip(span[first:], weight[first:]):
            a, b = np.searchsorted(lists.last[x:y], [low, high - 1]) + x
            if a < y:
                doc, part = lists.read(np.arange(a, min(b + 1, y)))
                on = slice(*np.searchsorted(doc, [low, high]))
                score[doc[on] - low] += w * part[on]
                seen[doc[on] - low] = True
        doc = np.flatnonzero(seen)
        score, doc = score[doc], doc + low
        for i in range(first - 1, -1, -1):
            stay = score + upto[i + 1] >= need
            score, doc = score[stay], doc[stay]
            (x, y), w = span[i], weight[i]
            block = np.searchsorted(lists.last[x:y], doc) + x
            within = block < y
            most = np.where(within, w * lists.most[np.minimum(block, y - 1)], 0)
            stay = score + most + upto[i] >= need
            score, doc, block, within = score[stay], doc[stay], block[stay], within[stay]
            if within.any():
                there, part = lists.read(np.unique(block[within]))
                at = np.minimum(np.searchsorted(there, doc), len(there) - 1)
                score = score + np.where(there[at] == doc, w * part[at], 0)
        stay = score >= need
        if stay.any():
            best.add(score[stay], ids[doc[stay]], null[doc[stay]])
        low, size = high, size * LONGER


def counted(texts: list, terms: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The number of words of each text; (doc, term, tf) of the words in `terms`, sorted by document and term."""
    words = [alnum_words(t) for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    term = np.fromiter(map(terms.get, chain.from_iterable(words), repeat(-1)), np.int64, int(n.sum()))
    on = term >= 0
    pair, tf = np.unique(np.repeat(np.arange(len(words)), n)[on] * len(terms) + term[on], return_counts=True)
    return n, *np.divmod(pair, max(1, len(terms))), tf


def term_counts(docs: DataFrame, terms) -> tuple[int, int, np.ndarray]:
    """Documents with a word, words in all, and in how many documents each term stands. terms: a broadcast dict."""

    def run(batches):
        df, total = np.zeros(len(terms.value), np.int64), np.zeros(2, np.int64)
        for b in batches:
            for at in blocks(byte_sizes(b.column(0))):
                n, _, term, _ = counted(b.column(0).slice(at.start, at.stop - at.start).to_pylist(), terms.value)
                df += np.bincount(term, minlength=len(df))
                total += [(n > 0).sum(), n.sum()]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, -2, some]), pa.array(np.r_[total, df[some]])], names=["term", "n"])

    found = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(terms.value), np.int64)
    total = {-1: 0, -2: 0}
    for r in found:  # a row for each term of the stated queries
        if r.term < 0:
            total[r.term] = r.n
        else:
            df[r.term] = r.n
    return total[-1], total[-2], df


def top_documents(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score of the k best documents of docs (doc_id long, text) with a score
    above 0 for each row of queries (item_id, text).

    Terms are runs of digits, letters and non-ASCII characters, A-Z lowered. With N documents that have a term, L terms in
    all, n in the document and df documents that hold the term, a term's weight is floor(1000 ln((2N+2)/(2df+1))), and the
    score adds weight * (10^9 tf div (1000 tf + 8 (25 + 75 n N div L))) for each of the item's terms, repeats included.
    Equal scores go by doc_id, null ids last. Texts that are null or without terms match nothing; rows of docs that repeat
    an id or a text are documents of their own; repeated rows of queries count once, an id with several texts is ranked
    for each. Other columns are ignored; empty tables give no rows. 75 n N must stay below 2^63.
    """
    spark, kind = docs.sparkSession, queries.schema["item_id"].dataType

    def make():
        return lambda texts: ([[w.decode() for w in alnum_words(t)] for t in texts],)

    items = written(added(queries.select("item_id", "text").distinct(), ["text"], "words array<string>", make).where("size(words) > 0").select("item_id", "words", F.xxhash64("text").alias("part")))
    size = items.agg(F.sum(F.size("words") * 100 + 100)).first()[0] or 0
    n_parts = 1 + size // PART_BYTES
    docs = docs.select("text", "doc_id")
    out = [spark.createDataFrame([], StructType([StructField("query", LongType()), StructField("item_id", kind), StructField("doc_id", LongType()), StructField("score", LongType())]))]
    for p in range(n_parts):
        rows = items.where(F.pmod("part", F.lit(n_parts)) == p).collect()
        if not rows:
            continue
        terms = spark.sparkContext.broadcast({w.encode(): i for i, w in enumerate(sorted({w for r in rows for w in r.words}))})
        n_docs, n_words, df = term_counts(docs, terms)
        if not n_words:
            continue
        weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()]
        asked = [{t: n * weight[t] for t, n in Counter(terms.value[w.encode()] for w in r.words).items()} for r in rows]
        given = spark.sparkContext.broadcast((asked, [r.item_id for r in rows]))
        out.append(docs.mapInArrow(_searcher(terms, given, n_docs, n_words, k, p, kind, SHARD_BYTES), out[0].schema))
    found = out[0]
    for x in out[1:]:
        found = found.union(x)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _searcher(terms, given, n_docs: int, n_words: int, k: int, part: int, kind, shard_bytes: int):
    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        asked, names = given.value
        best = [Best(k) for _ in asked]
        held: list[tuple] = []
        held_bytes = n_held = 0

        def finish():
            nonlocal held, held_bytes, n_held
            n, doc, term, tf, ids, null = map(np.concatenate, zip(*held))
            order = np.lexsort((doc, term))
            lists = Lists(term[order], doc[order], tf[order], 25 + 75 * n * n_docs // n_words)
            for q, b in zip(asked, best):
                search(lists, q, ids, null, b)
            held, held_bytes, n_held = [], 0, 0

        for b in batches:
            sizes = byte_sizes(b.column(0))
            for at in blocks(sizes):
                s = b.slice(at.start, at.stop - at.start)
                n, doc, term, tf = counted(s.column(0).to_pylist(), terms.value)
                null = np.asarray(s.column(1).is_null())
                held.append((n, doc + n_held, term, tf, np.asarray(s.column(1).fill_null(0), np.int64), null))
                n_held += len(n)
                held_bytes += int(sizes[at].sum())
                if held_bytes >= shard_bytes:
                    finish()
        if held:
            finish()
        of = np.repeat(np.arange(len(best)), [len(b.score) for b in best])
        ids, null, score = (np.concatenate([getattr(b, x) for b in best]) for x in ("ids", "null", "score"))
        cols = [pa.array((part << 40) + of, pa.int64()), pa.array([names[i] for i in of], to_arrow_type(kind)), pa.array(ids, mask=null), pa.array(score)]
        yield pa.RecordBatch.from_arrays(cols, names=["query", "item_id", "doc_id", "score"])

    return run
