import random
import re

import numpy as np

from vistaframe.llm import decontaminate
from vistaframe.llm.decontaminate import FMIndex, contamination


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, bench, width):
    phrases = {}
    for item, t in bench:
        w = words(t)
        if item is not None and w:
            for i in range(max(1, len(w) - width + 1)):
                phrases.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    out = []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for p, of in phrases.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    items |= of
        out.append((d, len(w), sorted(hit), sorted(items)))
    return sorted(out, key=str)


def test_index_finds_every_occurrence():
    r = np.random.default_rng(1)
    for _ in range(30):
        text = np.r_[r.integers(0, 4, 60), 0]
        phrases = np.array([[0, *x] if len(x) == 2 else x for x in ([1, 2], [3, 3], [1, 1, 1], [2, 3, 1])])
        lengths = np.array([2, 2, 3, 3])
        which, at = FMIndex(text).search(phrases, lengths)
        want = {(k, i) for k, n in enumerate(lengths) for i in range(len(text) - n + 1) if (text[i : i + n] == phrases[k, -n:]).all()}
        assert set(zip(which.tolist(), at.tolist())) == want and len(at) == len(want)


def test_matches_brute_force(spark, monkeypatch):
    r = random.Random(3)
    vocab = ["a", "b", "Été", "d9", "e"]
    text = lambda n: " ".join(r.choices(vocab, k=n))
    bench = [(i, text(r.randrange(3, 9))) for i in range(8)] + [(90, "a b"), (91, None), (None, "a"), (92, "--"), (0, bench_text := text(7)), (93, bench_text)]
    docs = [(i, text(r.randrange(0, 60)).replace(" ", r.choice([" ", "-\n", "_"]))) for i in range(40)] + [(50, None), (51, ""), (None, text(30)), (1, text(9)), (60, " ".join(["a"] * 400))]
    d = spark.createDataFrame([(x, t, 5) for x, t in docs], "doc_id long, text string, items int")
    b = spark.createDataFrame(bench, "item_id long, text string")
    for most in (1 << 28, 3000):
        monkeypatch.setattr(decontaminate, "PART_BYTES", most)
        got = contamination(d, b, 5).collect()
        assert sorted(((x.doc_id, x.n_words, [i for s, e in x.spans for i in range(s, e)], x["items"]) for x in got), key=str) == brute(docs, bench, 5)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert contamination(d, b).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(x) for x in contamination(one, b).collect()] == [(1, "a b", 2, [], [])]
