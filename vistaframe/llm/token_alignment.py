"""Alignment of two tokenizers by interval coalescing.

The tokens of both are byte ranges of one text. All ranges are sorted by start, the running maximum of their ends is
taken, and a group breaks where a start reaches it: there both tokenizers end a token. Within groups the overlaps expand
to links. Both tokenizers always end a token before a single space between two characters that aren't white space, so
a text is cut there, and a task tokenises and aligns each distinct piece that it remembers once.
"""

from __future__ import annotations

import re
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaframe.llm.common import added, written

#: UTF-8 bytes of text aligned at once.
BLOCK_BYTES = 1 << 20
#: Pieces that a task remembers, some 400 bytes each, and their greatest length in characters.
REMEMBERED, PIECE_CHARS = 1 << 17, 48
#: Pairs looked up at once: 17 bytes each in the driver and in each Python worker. More are looked up in further passes.
PASS_PAIRS = 2 << 20
#: U+00A1 to U+052F and printable ASCII hold no white space, whatever a library's Unicode version.
PIECES = re.compile("(?<=[!-~¡-ԯ]) (?=[!-~¡-ԯ])")
#: What byte-level vocabularies write for bytes 0 to 255: printable Latin-1 as itself, the rest from U+0100 up.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_OF = {chr(b): b for b in _PLAIN} | {chr(0x100 + i): b for i, b in enumerate(sorted({*range(256)} - {*_PLAIN}))}


NONE = np.zeros(0, np.int64)


class Aligner:
    """Tokenizers A (byte-level BPE, JSON) and B (pieces with byte fallback, a model file), from their files' contents."""

    def __init__(self, a: str, b: bytes, together: bool = True):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b, self.together = Tokenizer.from_str(a), SentencePieceProcessor(model_proto=b), together
        self.a.encode_special_tokens = True
        n = max(self.a.get_vocab(with_added_tokens=True).values()) + 1
        self.a_bytes = [bytes(BYTE_OF.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(n)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([*map(len, x)], np.int64) for x in (self.a_bytes, self.b_bytes))
        # no piece that goes on from another character into a space: so none crosses the places where texts are cut
        self.cut = not any(re.search("[^▁]▁", p) for p in pieces)
        self.marked = [f"{i}{m}" for i in range(max(n, len(pieces))) for m in ",|;"]
        self.known: dict[str, tuple | None] = {}

    def texts(self, texts: list) -> list[tuple | None]:
        """(n_a, n_b, n_groups, groups, link codes) of each text; None without tokens."""
        pieces = [None if not t else PIECES.split(t) if self.cut else [t] for t in texts]
        here, new = {}, []
        for p in {*chain.from_iterable(filter(None, pieces))}:
            if p in self.known:
                here[p] = self.known[p]
            else:
                new.append(p)
        for p, found in zip(new, self.aligned(new)):
            here[p] = found
            if len(p) <= PIECE_CHARS and len(self.known) < REMEMBERED:
                self.known[p] = found
        out: list[tuple | None] = []
        for of in pieces:
            parts = [here[p] for p in of] if of else [None]
            if None in parts:
                out.append(None)
            else:
                a, b, groups, text, codes = zip(*parts)
                out.append((sum(a), sum(b), sum(groups), ";".join(text), np.frombuffer(b"".join(codes), np.int64)))
        return out

    def aligned(self, texts: list[str]) -> list[tuple | None]:
        """The same of whole texts that aren't empty, all at once."""
        both = [" " + t for t in texts]
        of_a = [e.ids for e in self.a.encode_batch_fast(both, add_special_tokens=False)]
        of_b = self.b.encode(texts, num_threads=1)
        good = [True] * len(texts)
        for of, table in ((of_a, self.a_bytes), (of_b, self.b_bytes)):
            if b"".join(map(table.__getitem__, chain.from_iterable(of))) != "".join(both).encode():
                good = [g and b"".join([table[i] for i in x]) == t.encode() for g, t, x in zip(good, both, of)]
        found = self._coalesced([x for x, g in zip(of_a, good) if g], [y for y, g in zip(of_b, good) if g])
        return [next(found) if g else None for g in good]

    def _coalesced(self, of_a: list[list[int]], of_b: list[list[int]]):
        """Texts lie one after another, so one sort serves all: each text's end is a break."""
        n_a, n_b = (np.cumsum([0, *map(len, x)]) for x in (of_a, of_b))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, n[-1]) for x, n in ((of_a, n_a), (of_b, n_b)))
        a_end, b_end = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        a_start, b_start = a_end - self.a_sizes[a], b_end - self.b_sizes[b]
        start, end, side = np.r_[a_start, b_start], np.r_[a_end, b_end], np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((side, start))
        reach = np.maximum.accumulate(end[order])
        breaks = np.r_[True, start[order][1:] >= reach[:-1]][: len(order)]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(breaks) - 1
        # overlaps of each A token: B tokens from the first that ends behind its start to the last that starts before its end
        low, high = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
        n = high - low
        at_a = np.repeat(np.arange(len(a)), n)
        at_b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        if self.together:
            on = a_end[at_a] == b_end[at_b]
            at_a, at_b = at_a[on], at_b[on]
        codes, links = (a[at_a] << 32 | b[at_b]).tobytes(), (8 * np.searchsorted(at_a, n_a)).tolist()
        # as text: each group's A ids, then its B ids
        order = np.lexsort((side, group))
        group, side = group[order], side[order]
        fresh = np.r_[group[1:] > group[:-1], True][: len(order)]
        mark = np.where(fresh, 2, np.r_[side[1:] > side[:-1], False][: len(order)])
        words = list(map(self.marked.__getitem__, (3 * np.r_[a, b][order] + mark).tolist()))
        at = n_a + n_b
        groups = np.diff(np.r_[0, np.cumsum(fresh)][at])
        at = at.tolist()
        return zip(np.diff(n_a).tolist(), np.diff(n_b).tolist(), groups.tolist(), ["".join(words[x:y])[:-1] for x, y in zip(at, at[1:])], [codes[x:y] for x, y in zip(links, links[1:])])


def aligned(docs: DataFrame, a_file: str, b_file: str, together: bool = True) -> DataFrame:
    """`docs` without its text (any other columns pass) with n_a, n_b, n_groups, groups and the links by pair of ids.

    A encodes space + text, B the text, to which it adds the space; special tokens' strings are plain text. groups lists
    the groups as `a1,a2|b1;a3|b2,b3` in order. link_a, link_b and link_n hold the distinct pairs of ids and how many of
    the text's links each has; a link is a pair of an A and a B token whose bytes end together, or overlap if
    together is false. Texts that are null, empty or not given back byte for byte by both tokenizers have zeros, no links
    and '' as groups. Rows are judged one by one, so repeated rows and ids, ties and nulls in other columns don't matter; an
    empty table gives none. Columns of docs with the new names are replaced. groups of a text over some 300 MB don't
    fit a string and fail. The files are read by the driver and sent to the tasks.
    """
    files = docs.sparkSession.sparkContext.broadcast((Path(a_file).read_text(), Path(b_file).read_bytes(), together))

    def make():
        aligner = Aligner(*files.value)

        def align(texts):
            out = []
            for found in aligner.texts(texts):
                a, b, groups, text, codes = found or (0, 0, 0, "", NONE)
                pair, n = np.unique(codes, return_counts=True)
                out.append((a, b, groups, text, (pair >> 32).astype(np.int32), pair.astype(np.int32), n.astype(np.int32)))
            return tuple(map(list, zip(*out)))

        return align

    new = "n_a long, n_b long, n_groups long, groups string, link_a array<int>, link_b array<int>, link_n array<int>"
    docs = docs.drop(*(x.split()[0] for x in new.split(", ")))
    return added(docs, ["text"], new, make, drop=("text",), most=BLOCK_BYTES)


def _links(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, number) of all links of a batch, and how many pairs each row has."""
    a, b, n = (batch.column(c) for c in ("link_a", "link_b", "link_n"))
    code = np.asarray(a.flatten(), np.int64) << 32 | np.asarray(b.flatten(), np.int64)
    return code, np.asarray(n.flatten(), np.int64), np.asarray(a.value_lengths(), np.int64)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair: A id * 2^32 + B id, n, best): how many links each pair of ids has, and whether no pair of its B id has more."""

    def run(batches):
        for b in batches:
            code, n, _ = _links(b)
            pair, at = np.unique(code, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(np.bincount(at, n, len(pair)).astype(np.int64))], names=["pair", "n"])

    counts = links.select("link_a", "link_b", "link_n").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF))  # as many rows as A has ids, at most
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_b))


def with_link_counts(found: DataFrame) -> DataFrame:
    """Rows of aligned() with n_links, n_best (links whose pair is its B id's most frequent in all rows, ties included)
    and count_sum (the pairs' counts, added over links) in place of link_a, link_b and link_n."""
    rows = written(found.drop("n_links", "n_best", "count_sum"))
    pairs = written(pair_counts(rows))
    passes = 1 + pairs.count() // PASS_PAIRS
    out = rows.withColumns({c: F.lit(0).cast("long") for c in ("n_links", "n_best", "count_sum")})
    for k in range(passes):
        part = pairs.where(F.pmod(F.xxhash64("pair"), F.lit(passes)) == k).orderBy("pair").toArrow()
        table = out.sparkSession.sparkContext.broadcast(tuple(np.asarray(part.column(c)) for c in ("pair", "n", "best")))
        out = out.mapInArrow(_looked_up(table), out.schema)
        out = out if k == passes - 1 else written(out)
    return out.drop("link_a", "link_b", "link_n")


def _looked_up(table):
    def run(batches):
        pair, count, best = table.value
        for b in batches:
            code, n, sizes = _links(b)
            at = np.minimum(np.searchsorted(pair, code), max(0, len(pair) - 1))
            there = pair[at] == code if len(pair) else np.zeros(len(code), bool)
            row = np.repeat(np.arange(len(sizes)), sizes)[there]
            at, n = at[there], n[there]
            for name, more in (("n_links", n), ("n_best", n * best[at]), ("count_sum", n * count[at])):
                total = np.asarray(b.column(name), np.int64).copy()
                np.add.at(total, row, more)
                b = b.set_column(b.schema.get_field_index(name), name, pa.array(total))
            yield b

    return run
