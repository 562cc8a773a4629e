import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from vistaframe.llm import lexical_search
from vistaframe.llm.lexical_search import Best, Lists, packed, search, top_documents, unpacked


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, queries, k):
    of = [(i, words(t)) for i, t in docs]
    n_docs, n_words = sum(bool(w) for _, w in of), sum(len(w) for _, w in of)
    df = Counter(x for _, w in of for x in set(w))
    out = set()
    for item, text in set(queries):
        scores = []
        for i, w in of:
            tf, m = Counter(w), 25 + 75 * len(w) * n_docs // max(1, n_words)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 8 * m)) for x in words(text) if x in tf)
            if s > 0:
                scores.append((-s, i is None, i))
        out |= {(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)}
    return out


def corpus(n, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    zipf = [1 / (i + 1) for i in range(60)]
    docs = [(i * 7 % n, " ".join(r.choices(vocabulary, zipf, k=r.randrange(0, 40)))) for i in range(n)]
    docs += [(docs[3][0], docs[3][1]), (None, docs[5][1]), (None, None), (n + 1, ""), (n + 2, "..., !"), (n + 3, "Été W1 été " * 9000)]
    queries = [(i, " ".join(r.choices(vocabulary, k=r.randrange(1, 12)))) for i in range(12)]
    return docs, queries + [(90, "été Été W1"), (91, ""), (92, None), (93, "nowhere"), (queries[0]), (1, "w5 w5 w7"), (None, "w0")]


@pytest.mark.parametrize("k,shard_bytes,part_bytes", [(10, 16 << 20, 64 << 20), (3, 2000, 3000)])
def test_equals_brute_force(spark, monkeypatch, k, shard_bytes, part_bytes):
    monkeypatch.setattr(lexical_search, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(lexical_search, "PART_BYTES", part_bytes)
    docs, queries = corpus(700, k)
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, score int").repartition(3)
    got = top_documents(d, spark.createDataFrame(queries, "item_id long, text string"), k)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert {tuple(r) for r in got.collect()} == brute(docs, queries, k)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([("x", "a")], "item_id string, text string")
    assert top_documents(docs.where("false"), items).collect() == []
    assert top_documents(docs, items.where("false")).collect() == []
    assert [tuple(r)[:3] for r in top_documents(docs, items).collect()] == [("x", 1, 1)]


def test_packed_numbers():
    v = np.array([0, 1, 127, 128, 16383, 16384, 2**40, 5])
    data, start = packed(v)
    assert unpacked(data).tolist() == v.tolist() and start.tolist() == [0, 1, 2, 3, 5, 7, 10, 16]


def test_blocks_are_rejected_unread_and_nothing_is_missed(monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK", 4)
    monkeypatch.setattr(lexical_search, "STRETCH", 8)
    r = np.random.default_rng(2)
    n, n_terms, read = 3000, 6, []
    hold = r.random((n_terms, n)) < np.array([0.9, 0.7, 0.5, 0.1, 0.02, 0.004])[:, None]
    term, doc = np.nonzero(hold)
    tf, m = r.integers(1, 9, len(term)), r.integers(25, 400, n)
    lists = Lists(term, doc, tf, m)
    plain = Lists.read
    monkeypatch.setattr(Lists, "read", lambda self, which: read.append(len(which)) or plain(self, which))
    query = {0: 20, 1: 300, 2: 900, 3: 4000, 4: 9000, 5: 30000}
    want = np.zeros(n, np.int64)
    np.add.at(want, doc, np.array([query[t] for t in term.tolist()]) * (10**9 * tf // (1000 * tf + 8 * m[doc])))
    best = Best(5)
    search(lists, query, np.arange(n), np.zeros(n, bool), best)
    order = np.lexsort((np.arange(n), -want))[:5]
    assert best.ids.tolist() == order.tolist() and best.score.tolist() == want[order].tolist()
    assert sum(read) < len(lists.most) / 2
