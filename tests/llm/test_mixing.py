import random
import re
from collections import defaultdict

import pytest

from vistaframe.llm import mixing
from vistaframe.llm.mixing import mixed


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets(rows):
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += words(t)
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, left, out = set(), sum(size.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        out |= {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if out[s] > 3 * size[s]]
        if not over:
            return size, out
        for s in over:
            full.add(s)
            out[s] = 3 * size[s]
            left -= out[s]


@pytest.mark.parametrize("group", [4096, 7])
def test_targets_are_met(spark, monkeypatch, group):
    monkeypatch.setattr(mixing, "GROUP", group)
    r = random.Random(3)
    rows = []
    for i in range(900):
        s = r.choice(["big"] * 12 + ["b", "c", "é", "tiny", None])
        n = r.choice([r.randrange(1, 60), 9, r.randrange(400)]) if s != "tiny" else 2
        rows.append((i, " ".join(["w"] * n), s))
    rows += [(2000, None, "big"), (2001, "", None), (2002, " \n", "empty"), (None, "a b", "c"), (3, rows[3][1], rows[3][2]), (2003, "w " * 20000, "long")]
    size, target = targets(rows)
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, source string, size int, n long")
    out = mixed(docs).collect()
    assert sorted((x.doc_id, x.size) for x in out if x.doc_id is not None) == sorted((d, words(t)) for d, t, _ in rows if d is not None)
    taken = defaultdict(int)
    for x in out:
        assert x.source_size == size[x.source] and abs(x.target - target[x.source]) < 1e-6 * max(1, x.target)
        assert 0 <= x.copies <= 3 and x.taken == x.copies * x.size
        taken[x.source] += x.taken
    for s, n in taken.items():
        if s == "long":  # one document: whole copies only
            assert abs(n - target[s]) <= size[s] / 2
        else:
            assert abs(n - target[s]) <= max(3, 0.01 * target[s]), s
    key = lambda x: (str(x.doc_id), x.size, x.taken)
    assert sorted(map(key, mixed(docs.repartition(7)).collect())) == sorted(map(key, out))


def test_small_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixed(docs).collect() == []
    nothing = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert sorted((x.doc_id, x.size, x.source_size, x.target, x.taken) for x in mixed(nothing).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
