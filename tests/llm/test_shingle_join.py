import random
import re

import pytest

from vistaframe.llm import shingle_join
from vistaframe.llm.shingle_join import shingle_components
from vistaframe.operators import graph


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = rows[i][0] is not None and rows[j][0] is not None
            if both and (rows[i][0] == rows[j][0] or sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])):
                label[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), low[find(i)] if d is not None else None) for i, (d, _) in enumerate(rows)), key=str)


def varied(r, words, n):
    w = list(words)
    for _ in range(n):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


def fixture(seed, group):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(r.choices(vocab, k=r.randrange(1, 90)))) for i in range(60)]
    base = r.choices(vocab, k=120)
    rows += [(100 + i, varied(r, base, r.randrange(0, 5))) for i in range(group)]
    rows += [(500 + i, "The very same short text") for i in range(40)]
    rows += [(600, None), (601, ""), (602, " \t"), (603, "One"), (604, "one"), (None, "One"), (605, "ONE\x0btwo"), (605, "unlike all the others here now"), (606, "unlike ALL the others here now"), (607, "one two")]
    rows += [(700, " ".join(r.choices(vocab, k=5000)))]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("group", [10, 120])
def test_matches_brute_force(spark, group, monkeypatch):
    monkeypatch.setattr(shingle_join, "NODE", 16)
    rows = fixture(group, group)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, n string, first int")
    got = sorted((tuple(r) for r in shingle_components(docs, 4, 85).collect()), key=str)
    assert got == brute(rows, 4, 85)


def test_empty_table(spark):
    assert shingle_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sites_with_a_common_template(spark, monkeypatch):
    """Crowded shingles among documents that mostly don't link, with some pairs and chains that do."""
    monkeypatch.setattr(shingle_join, "NODE", 8)
    r = random.Random(12)
    rows = []
    for site in range(3):
        template = [f"s{site}t{j}" for j in range(100)]
        for i in range(50):
            own = [f"s{site}d{i}w{j}" for j in range(r.choice([3, 9, 16, 17]))]
            rows.append((site * 1000 + i, " ".join(template + own)))
            for k in range(r.choice([0, 0, 1, 3])):
                rows.append((site * 1000 + 100 + 4 * i + k, " ".join(template + own[: -1 - k] + ["new"] * r.randrange(3))))
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(x) for x in shingle_components(docs, 4, 85).collect()), key=str)
    assert got == brute(rows, 4, 85)


@pytest.mark.parametrize("n", [1000, 8000])
def test_a_crowd_of_near_copies_takes_few_comparisons(n):
    import numpy as np

    from vistaframe.llm.shingle_join import Joined, Tree, bitmap, by_likeness, folded

    r = np.random.default_rng(1)
    base, sets = r.integers(0, 2**63, 300, np.uint64), []
    for _ in range(n):
        x = base.copy()
        x[r.integers(0, 300, 8)] = r.integers(0, 2**63, 8, np.uint64)
        sets.append(np.unique(x))
    sizes, maps = np.array([*map(len, sets)]), folded([bitmap(s) for s in sets])
    order, joined, met = by_likeness(sizes, maps), Joined(n), 0
    for i, j in Tree(sizes[order], maps[order]).candidates(85, joined):
        met += 1
        joined.join(i, j)
    assert len(set(joined.root.tolist())) == 1
    assert met < 60 * n  # of n * n / 2 pairs


def test_a_large_cluster_takes_few_steps(spark, monkeypatch):
    """Trees hold each document once, so their labels need no search for components: a table with a large group of near
    copies took hundreds of stages for those."""
    found, tables = [0], [0]

    def counted(f, n):
        return lambda *x: n.__setitem__(0, n[0] + 1) or f(*x)

    monkeypatch.setattr(shingle_join, "NODE", 16)
    monkeypatch.setattr(shingle_join, "components", counted(shingle_join.components, found))
    for module in (graph, shingle_join):
        monkeypatch.setattr(module, "written", counted(module.written, tables))
    rows = fixture(7, 150)
    got = sorted((tuple(x) for x in shingle_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()), key=str)
    assert got == brute(rows, 4, 85)
    assert found[0] <= 2 and tables[0] <= 28, (found, tables)
