import collections
import random

import numpy as np
import pytest

from vistaframe.llm import line_dedup
from vistaframe.llm.line_dedup import PerfectHash, Shard, without_common_lines

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(texts, min_docs, min_chars):
    held = collections.Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        gone = [(i, held[key(x)]) for i, x in enumerate(lines) if held[key(x)] >= min_docs]
        out.append((len(lines), len(gone), "\n".join(x for x in lines if held[key(x)] < min_docs), gone))
    return out


def texts_of(n, seed=1):
    r = random.Random(seed)
    common = ["Share this", "  share THIS\t", "ÄRGER", "ärger", "x", "", " ", "\x1c", "a\rb", "All rights reserved.\r"]
    out = [None, "", "\n", "\n\n x", "z" * 300_000, "q\n" * 20_000]
    while len(out) < n:
        out.append("\n".join(r.choice(common) if r.random() < 0.3 else f"line {r.randrange(n)}" for _ in range(r.randrange(1, 12))))
    return out


@pytest.mark.parametrize("min_docs,min_chars", [(10, 1), (2, 1), (3, 5), (1, 0)])
def test_equals_brute_force(spark, min_docs, min_chars):
    texts = texts_of(300)
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(5)
    got = {r.doc_id: r for r in without_common_lines(docs, min_docs, min_chars).collect()}
    for i, (n, gone, kept, which) in enumerate(brute(texts, min_docs, min_chars)):
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept) == (n, gone, kept)
        assert [tuple(x) for x in got[i].dropped] == which


def test_many_shards_and_passes_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts_of(400, 3))), "doc_id long, text string")
    want = sorted(without_common_lines(docs, 2).collect())
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 16)
    monkeypatch.setattr(line_dedup, "PASS_KEYS", 100)
    assert sorted(without_common_lines(docs, 2).collect()) == want


def test_empty_table_repeated_rows_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_lines string")
    assert without_common_lines(empty).collect() == []
    docs = spark.createDataFrame([(None, "a\nb", 1.5)] * 10 + [(7, None, None)], "doc_id long, text string, weight double")
    got = without_common_lines(docs).collect()
    assert [(r.doc_id, r.weight, r.n_dropped, r.kept) for r in got if r.doc_id is None] == [(None, 1.5, 2, "")] * 10
    assert [(r.n_lines, r.n_dropped, r.kept) for r in got if r.doc_id == 7] == [(1, 0, "")]


def test_perfect_hash_is_minimal_and_fingerprints_reject():
    r = np.random.default_rng(5)
    for n in (0, 1, 2, 63, 5000):
        high, low = r.integers(0, 2**64, (2, n), np.uint64)
        high[: n // 2] = high[:1]  # keys that share a half
        h = PerfectHash(high, low)
        assert sorted(h.places(high, low)) == list(range(n))
        s = Shard(high, low, np.arange(n) + 1)
        assert s.count(high, low).tolist() == list(range(1, n + 1))
        others = r.integers(0, 2**64, (2, 4000), np.uint64)
        assert not s.count(*others).any()
