"""Lines that many documents share: a sharded minimal perfect hash over the hashes of their keys.

A task hashes its documents' line keys to 128 bits and counts documents by hash; Spark adds the counts. The hashes
that enough documents hold are dealt into shards. A shard is a minimal perfect hash (levels of bits, each key in the
first level where it met no other) that indexes two compact arrays: 64-bit fingerprints and document counts. Tasks then
probe the arrays with the lines of their documents: no line is joined or shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaframe.llm.common import added, blocks, byte_sizes, mix, written

U = np.uint64
#: Keys of a shard, on average; the first half of a hash deals them out, so shards differ by chance only.
SHARD_KEYS = 1 << 16
#: Keys indexed at once: some 13 bytes each in the driver and in each Python worker. More are probed in further passes.
PASS_KEYS = 4 << 20
#: Bits of a level for each key that is still to be placed.
ROOM = 2
#: White space of keys: U+0020, U+0009 to U+000D.
SPACE = b" \t\n\x0b\x0c\r"


class PerfectHash:
    """Distinct 128-bit keys (high, low) to 0 .. n-1, each to a place of its own. Others get any place, or none."""

    def __init__(self, high: np.ndarray, low: np.ndarray):
        sizes, bits = [], [np.zeros(0, bool)]
        while len(high):
            n = ROOM * len(high) + 64
            at = _at(high, low, len(sizes), n)
            alone = np.bincount(at, minlength=n) == 1
            sizes.append(n)
            bits.append(alone)
            stay = ~alone[at]
            high, low = high[stay], low[stay]
        flat = np.concatenate(bits)
        packed = np.packbits(np.concatenate([flat, np.zeros(-len(flat) % 64, bool)]), bitorder="little").view(U)
        self._set(sizes, packed)

    def _set(self, sizes: list[int], bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        self.before = np.cumsum(np.r_[0, np.bitwise_count(bits)])[:-1].astype(np.uint32)

    @staticmethod
    def of(sizes: list[int], bits: np.ndarray) -> PerfectHash:
        h = PerfectHash.__new__(PerfectHash)
        h._set(list(sizes), bits)
        return h

    def places(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where no level holds it."""
        out = np.full(len(high), -1, np.int64)
        todo = np.arange(len(high))
        start = 0
        for level, n in enumerate(self.sizes):
            at = _at(high[todo], low[todo], level, n) + start
            word, bit = at >> 6, (at & 63).astype(U)
            there = (self.bits[word] >> bit) & U(1) == 1
            word, bit = word[there], bit[there]
            out[todo[there]] = self.before[word] + np.bitwise_count(self.bits[word] & ((U(1) << bit) - U(1)))
            todo, start = todo[~there], start + n
        return out


def _at(high: np.ndarray, low: np.ndarray, level: int, n: int) -> np.ndarray:
    return (mix(high + mix(low + U(level))) % U(n)).astype(np.int64)


class Shard:
    """Counts of keys behind a perfect hash; a key's low half is its fingerprint."""

    def __init__(self, high: np.ndarray, low: np.ndarray, counts: np.ndarray):
        high, low = high.view(U), low.view(U)
        self.hash = PerfectHash(high, low)
        at = self.hash.places(high, low)
        self.prints, self.counts = np.empty(len(low), U), np.empty(len(low), np.uint32)
        self.prints[at] = low
        self.counts[at] = np.minimum(counts, np.iinfo(np.uint32).max)

    @staticmethod
    def of(row) -> Shard:
        """As line_index wrote it."""
        s = Shard.__new__(Shard)
        s.hash = PerfectHash.of(row.sizes, np.frombuffer(bytes(row.bits), U))
        s.prints, s.counts = np.frombuffer(bytes(row.prints), U), np.frombuffer(bytes(row.counts), np.uint32)
        return s

    def count(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The count of each key, 0 for those that aren't in the shard."""
        at = self.hash.places(high, low)
        out = np.zeros(len(high), np.int64)
        some = np.flatnonzero(at >= 0)
        some = some[self.prints[at[some]] == low[some]]
        out[some] = self.counts[at[some]]
        return out


def keys(lines: list[bytes], min_chars: int) -> list[bytes | None]:
    """The key of each line, None for keys of fewer than min_chars characters."""
    cut = [x.strip(SPACE).lower() for x in lines]
    if min_chars <= 1:
        return [x or None for x in cut] if min_chars == 1 else cut
    return [x if len(x) >= min_chars and len(x.decode()) >= min_chars else None for x in cut]


def digests(values: list[bytes]) -> np.ndarray:
    """A row (high, low) of each value's 128 bits."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, values)), ">u8").astype(U).reshape(-1, 2)


def line_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(high, low, documents) of each hash of a line key: how many rows of docs hold such a line."""

    def run(batches):
        for b in batches:
            for at in blocks(byte_sizes(b.column(0))):
                held: dict[bytes, int] = {}
                for t in b.column(0).slice(at.start, at.stop - at.start).to_pylist():
                    for k in {*keys((t or "").encode().split(b"\n"), min_chars)} - {None}:
                        held[k] = held.get(k, 0) + 1
                h = digests(list(held)).view(np.int64)
                n = np.fromiter(held.values(), np.int64, len(held))
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(n)], names=["high", "low", "documents"])

    counts = docs.select("text").mapInArrow(run, "high long, low long, documents long")
    return counts.groupBy("high", "low").agg(F.sum("documents").alias("documents"))


def line_index(common: DataFrame, shards: int) -> DataFrame:
    """(shard, sizes, bits, prints, counts): a perfect hash and its arrays for each shard of common (high, low, documents).

    shards is a power of two; the first bits of `high` deal the keys out evenly, so a group stays near SHARD_KEYS rows."""

    def build(key, rows):
        s = Shard(*(np.asarray(rows.column(c)) for c in ("high", "low", "documents")))
        return pa.table({"shard": [key[0].as_py()], "sizes": pa.array([s.hash.sizes], pa.list_(pa.int64())), **{n: pa.array([x.tobytes()], pa.binary()) for n, x in (("bits", s.hash.bits), ("prints", s.prints), ("counts", s.counts))}})

    of = F.shiftrightunsigned("high", 64 - (shards.bit_length() - 1)) if shards > 1 else F.lit(0).cast("long")
    return common.withColumn("shard", of).groupBy("shard").applyInArrow(build, "shard long, sizes array<long>, bits binary, prints binary, counts binary")


def without_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """`docs` (text and any other columns) with dropped (array of line number from 0 and number of documents that hold
    the line's key), n_lines, n_dropped and kept: the text without the lines whose key stands in min_docs rows or more.

    A text is split at U+000A; null and empty texts are one empty line, kept as ''. A key is the line without white space
    (U+0020, U+0009 to U+000D) at its ends, A-Z lowered; keys of fewer than min_chars code points always stay. A document
    is a row: rows that repeat a text or an id count each, a line that stands several times in one counts once. An empty
    table gives none. Columns of docs named n_lines, n_dropped, dropped or kept are replaced; all others pass unchanged.
    """
    docs = docs.drop("n_lines", "n_dropped", "dropped", "kept", "_dropped")
    common = written(line_counts(docs, min_chars).where(F.col("documents") >= min_docs))
    total = common.count()
    shards = 1 << (total // SHARD_KEYS).bit_length()
    passes = min(shards, 1 + total // PASS_KEYS)
    index = written(line_index(common, shards))
    out = docs.withColumn("dropped", F.array().cast("array<struct<line:int,documents:long>>"))
    for k in range(passes):
        rows = index.where(F.col("shard") % passes == k).collect()  # of PASS_KEYS keys or so, whatever the corpus
        part = docs.sparkSession.sparkContext.broadcast({r.shard: Shard.of(r) for r in rows})
        last = k == passes - 1

        def make(part=part, last=last):
            return lambda texts, found: _probed(texts, found, part.value, shards, min_chars, last)

        new = "_dropped array<struct<line:int,documents:long>>" + ", n_lines long, n_dropped long, kept string" * last
        out = added(out, ["text", "dropped"], new, make, drop=("dropped",)).withColumnRenamed("_dropped", "dropped")
        out = out if last else written(out)
    return out


def _probed(texts: list, found: list, index: dict[int, Shard], shards: int, min_chars: int, last: bool) -> tuple:
    lines = [(t or "").encode().split(b"\n") for t in texts]
    place: dict[bytes, int] = {}
    places = [[-1 if x is None else place.setdefault(x, len(place)) for x in keys(of, min_chars)] for of in lines]
    h = digests(list(place))
    count = np.zeros(len(place) + 1, np.int64)  # the last for keys that stay
    shard = (h[:, 0] >> U(65 - shards.bit_length())).astype(np.int64) if shards > 1 else np.zeros(len(h), np.int64)
    order = np.argsort(shard, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
        if s := index.get(int(shard[at[0]])):
            count[at] = s.count(h[at, 0], h[at, 1])
    counts = count.tolist()
    dropped = [[*((x["line"], x["documents"]) for x in old), *((i, counts[p]) for i, p in enumerate(of) if counts[p])] for of, old in zip(places, found)]
    if not last:
        return (dropped,)
    kept = []
    for of, gone in zip(lines, dropped):
        out = {i for i, _ in gone}
        kept.append(b"\n".join([x for i, x in enumerate(of) if i not in out] if out else of).decode())
    return [sorted(x) for x in dropped], [len(x) for x in lines], [len(x) for x in dropped], kept
