"""Benchmark decontamination: an FM-index for each shard of training text.

A shard is a bounded block of documents within a task. Its index is a Burrows-Wheeler transform kept as
a wavelet matrix (ranks) with sampled suffix positions. Test phrases are found by backward search, all
phrases at once, occurrences are located from the samples, and their spans are merged per document.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaframe.llm.common import added, alnum_words, written

#: Bytes that the windows of test items searched for at once may take in Python; more are searched in further passes.
PART_BYTES = 256 << 20
#: One suffix position in so many is kept.
SAMPLE = 8


class FMIndex:
    """Over runs of symbols from 1 up, each run ended by 0; no match crosses a 0."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        ends = text == 0
        # suffixes by doubling; each end counts as a symbol of its own, so runs are compared no further
        first = text.astype(np.int64) + n
        first[ends] = np.arange(n)[ends]
        rank = np.unique(first, return_inverse=True)[1].astype(np.int64)
        step = 1
        while rank.max() < n - 1:
            after = np.zeros(n, np.int64)
            after[:-step] = rank[step:] + 1
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
            step *= 2
        suffix = np.empty(n, np.int64)
        suffix[rank] = np.arange(n)
        starts = np.r_[True, ends[:-1]]
        kept = (suffix % SAMPLE == 0) | starts[suffix]
        self.kept, self.sample, self.before = kept, suffix[kept], np.cumsum(np.r_[0, kept])
        self.less = np.r_[0, np.cumsum(np.bincount(text))]
        self.size = n
        self.ones = []
        self.depth = int(text.max()).bit_length()
        bwt = text[suffix - 1]
        for level in range(self.depth - 1, -1, -1):
            bit = (bwt >> level) & 1
            self.ones.append(np.r_[0, np.cumsum(bit, dtype=np.int32)])
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        # where each symbol's block begins once all levels are sorted
        self.begin = np.zeros(len(self.less), np.int64)
        values, at = np.unique(bwt, return_index=True)
        self.begin[values] = at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position `at` of the transform."""
        for i, ones in enumerate(self.ones):
            bit = (symbol >> (self.depth - 1 - i)) & 1
            r = ones[at]
            at = np.where(bit == 1, self.size - int(ones[-1]) + r, at - r)
        return at - self.begin[symbol]

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for ones in self.ones:
            r = ones[at]
            bit = ones[at + 1] - r
            out = out * 2 + bit
            at = np.where(bit == 1, self.size - int(ones[-1]) + r, at - r)
        return out

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of all occurrences. phrases: a row of symbols each, right-aligned."""
        which = np.arange(len(lengths))
        low, high = np.zeros(len(which), np.int64), np.full(len(which), self.size, np.int64)
        done_which, done_low, done_high = [], [], []
        for k in range(1, phrases.shape[1] + 1):
            full = lengths[which] < k
            if full.any():
                done_which.append(which[full])
                done_low.append(low[full])
                done_high.append(high[full])
                which, low, high = which[~full], low[~full], high[~full]
            c = phrases[which, -k]
            there = c < len(self.begin)
            which, low, high, c = which[there], low[there], high[there], c[there]
            low, high = self.less[c] + self.rank(c, low), self.less[c] + self.rank(c, high)
            some = low < high
            which, low, high = which[some], low[some], high[some]
            if not len(which):
                break
        which, low, high = (np.concatenate([*d, x]) for d, x in ((done_which, which), (done_low, low), (done_high, high)))
        n = high - low
        row = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(which, n), self.locate(row)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order: back to the next sampled one."""
        row, steps = row.copy(), np.zeros(len(row), np.int64)
        todo = np.flatnonzero(~self.kept[row])
        while len(todo):
            c = self.symbol(row[todo])
            row[todo] = self.less[c] + self.rank(c, row[todo])
            steps[todo] += 1
            todo = todo[~self.kept[row[todo]]]
        return self.sample[self.before[row]] + steps


class Phrases:
    """The distinct windows of test items, as symbols of the words that occur in them.

    windows: rows (item ids that share the window, its words), each window once. Held as arrays and one word list, so
    that a part takes memory in proportion to its bytes.
    """

    def __init__(self, windows: list[tuple[list[str], list[str]]], width: int):
        self.ids, at = np.unique(np.array([i for items, _ in windows for i in items], object), return_inverse=True) if windows else (np.array([], object), np.array([], int))
        self.item = at.astype(np.int32)
        self.first = np.cumsum([0, *(len(items) for items, _ in windows)])
        self.words = {w.encode(): i for i, w in enumerate(sorted({w for _, x in windows for w in x}), 1)}
        self.lengths = np.array([len(x) for _, x in windows], np.int64)
        self.shortest = int(self.lengths.min()) if windows else 0
        self.symbols = np.zeros((len(windows), width), np.int32)
        for row, (_, x) in enumerate(windows):
            self.symbols[row, width - len(x) :] = [self.words[w.encode()] for w in x]

    def items_of(self, phrase: int) -> list[str]:
        return self.ids[self.item[self.first[phrase] : self.first[phrase + 1]]].tolist()


def item_windows(tests: DataFrame, width: int) -> DataFrame:
    """(part_of, items, words): the distinct windows of the items (item, text), with the ids of those that have each."""

    def make():
        def cut(texts):
            out = []
            for t in texts:
                w = [x.decode() for x in alnum_words(t)]
                out.append([w[i : i + width] for i in range(max(1, len(w) - width + 1) if w else 0)])
            return (out,)

        return cut

    cut = added(tests, ["text"], "windows array<array<string>>", make, drop=("text",))
    return cut.select("item", F.explode("windows").alias("words")).groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _hits(texts: list, phrases: Phrases) -> list[tuple[int, list, list]]:
    """For each text: number of words, merged word spans [start, end], items found."""
    symbols, counts = [], []
    for t in texts:
        w = alnum_words(t)
        counts.append(len(w))
        symbols.append(np.fromiter(map(phrases.words.get, w, repeat(0)), np.int64, len(w)))
        symbols.append(np.zeros(1, np.int64))
    empty = [(n, [], []) for n in counts]
    if not phrases.shortest:
        return empty
    text = np.concatenate(symbols)
    # a phrase lies within a run of words of phrases that is long enough: the index holds only those
    edge = np.flatnonzero(np.diff(np.r_[0, text != 0, 0].astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    long = stop - start >= phrases.shortest
    start, stop = start[long], stop[long]
    if not len(start):
        return empty
    n = stop - start + 1  # with the 0 after it
    origin = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    which, at = FMIndex(text[origin]).search(phrases.symbols, phrases.lengths)
    at = origin[at]
    depth = np.zeros(len(text) + 1, np.int32)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + phrases.lengths[which], -1)
    edge = np.flatnonzero(np.diff(np.r_[0, np.cumsum(depth) > 0, 0].astype(np.int8)))
    first = np.cumsum(np.r_[0, np.array(counts, np.int64) + 1])
    out = empty
    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
        doc = int(np.searchsorted(first, s, side="right")) - 1
        out[doc][1].append([s - int(first[doc]), e - int(first[doc])])
    found = np.unique(np.stack([np.searchsorted(first, at, side="right") - 1, which]), axis=1)
    items: dict[int, set] = {}
    for doc, p in found.T.tolist():
        items.setdefault(doc, set()).update(phrases.items_of(p))
    for doc, x in items.items():
        out[doc][2].extend(sorted(x))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """`docs` (text and any other columns) with n_words, spans (merged [start, end) word positions covered
    by phrases of `benchmark`) and items (sorted ids, as strings, of the test items with such phrases).

    Words are runs of digits, letters and non-ASCII characters, A-Z lowered. A phrase is `width` consecutive
    words of an item; a shorter item, but not one without words, is one phrase. Null texts have no words;
    items with a null id or text are left out; repeated items count once. Columns of docs that are
    named n_words, spans or items are replaced; all others pass unchanged.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "spans", "items", "_n", "_spans", "_items")
    tests = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text")
    windows = written(item_windows(tests.distinct(), width))
    # in Python a window takes some 100 bytes a word and 60 an item id: a part's size bounds driver and workers
    size = windows.agg(F.sum(F.size("words") * 100 + F.size("items") * 60)).first()[0] or 0
    parts = 1 + size // PART_BYTES
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<array<long>>"), "items": F.array().cast("array<string>")})
    for part in range(parts):
        chosen = windows.where(F.pmod(F.xxhash64("words"), F.lit(parts)) == part) if parts > 1 else windows
        phrases = spark.sparkContext.broadcast(Phrases([(r["items"], r["words"]) for r in chosen.collect()], width))

        def make(phrases=phrases):
            def find(texts, spans, items):
                found = _hits(texts, phrases.value)
                both = [(n, merged(x, y), sorted({*z, *i})) if x or z else (n, y, i) for (n, y, i), x, z in zip(found, spans, items)]
                return tuple(map(list, zip(*both)))

            return find

        out = added(out, ["text", "spans", "items"], "_n long, _spans array<array<long>>, _items array<string>", make, drop=("n_words", "spans", "items"))
        out = out.withColumnsRenamed({"_n": "n_words", "_spans": "spans", "_items": "items"})
        if parts > 1:
            out = written(out)
    return out


def merged(a, b) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted([*map(list, a), *map(list, b)]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([int(s), int(e)])
    return out
