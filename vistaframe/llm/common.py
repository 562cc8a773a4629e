"""Helpers the training-text operators share: tables, lineage cuts, word splitting, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from vistaframe.operators.graph import components
from vistaframe.shared import listed, shared_dir, written

__all__ = ["components", "listed", "shared_dir", "written"]

#: UTF-8 bytes handled at once inside a task.
BLOCK_BYTES = 4 << 20

U = np.uint64
#: ASCII characters other than digits and letters become spaces; bytes of non-ASCII characters stay.
ALNUM = bytes(
    c if c >= 128 or chr(c).isdigit() or chr(c).isalpha() else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(sizes: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[slice]:
    """Consecutive slices of at most `most` bytes, or of one row."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield slice(start, len(sizes))


def added(df: DataFrame, takes: list[str], gives: str, make: Callable[[], Callable], drop: tuple = (), most: int = BLOCK_BYTES) -> DataFrame:
    """df with the columns `gives` (DDL), computed by make()(list of values of each column of `takes`).

    All other columns but those in `drop` pass through as Arrow data, so no id or nullable number is converted. A
    call gets rows of at most `most` bytes of the first taken column, or one row.
    """
    kept = [f for f in df.schema.fields if f.name not in drop]
    new = StructType.fromDDL(gives).fields

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        f = make()
        for b in batches:
            for at in blocks(byte_sizes(b.column(takes[0])), most):
                s = b.slice(at.start, at.stop - at.start)
                got = f(*(s.column(t).to_pylist() for t in takes))
                cols = [s.column(c.name) for c in kept] + [pa.array(x, to_arrow_type(c.dataType)) for c, x in zip(new, got)]
                yield pa.RecordBatch.from_arrays(cols, names=[c.name for c in [*kept, *new]])

    return df.mapInArrow(run, StructType([*kept, *new]))


def byte_sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each value of a text column (null: 0), or items of lists at 8 bytes each."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return 8 * np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0), np.int64)
    n = pa.compute.binary_length(column)
    return np.asarray(pa.compute.fill_null(n, 0), np.int64)


class WordHash(dict):
    """64-bit hashes of words, remembered for a bounded vocabulary."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 17:  # some 25 MB; to hash a word again takes little
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def spaced_words(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than space and U+0009 to U+000D."""
    return text.encode().split() if text else []


def lower_spaced_words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z lowered) and non-ASCII characters."""
    return text.encode().lower().translate(ALNUM).split() if text else []
