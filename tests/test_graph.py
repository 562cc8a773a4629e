import random

import numpy as np
import pytest

from vistaframe.operators import graph
from vistaframe.operators.graph import components, tied


def brute(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return sorted((x, root(x)) for x in list(up))


def shapes():
    r = random.Random(4)
    ids = [r.randrange(-(2**62), 2**62) for _ in range(3000)]
    path = [(ids[i], ids[i + 1]) for i in range(700)]
    star = [(ids[800], ids[801 + i]) for i in range(500)]
    low = min(ids) - 1
    hubs = [(low, ids[1400 + i]) for i in range(300)] + [(ids[1400 + i], ids[1401 + i]) for i in range(0, 300, 3)]
    some = [tuple(r.choices(ids[1800:], k=2)) for _ in range(900)]
    steps = [(2**53 + i, 2**53 + i + 1) for i in range(300)]
    odd = [(5, 5), (None, 7), (8, None), (9, 9)]
    return {"path": path, "steps": steps, "star": star, "hubs": hubs, "some": some, "odd": odd, "none": [], "all": path + star + hubs + some + steps + odd + path[:50]}


@pytest.mark.parametrize("name", shapes())
@pytest.mark.parametrize("parts", [1, 7])
def test_components_match_brute_force(spark, name, parts):
    edges = shapes()[name]
    random.Random(1).shuffle(edges)
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(parts))
    assert sorted(map(tuple, got.collect())) == brute(edges)


def test_ties_of_edges_that_come_in_blocks(spark):
    edges = shapes()["all"]
    a, b = (np.array(x, np.int64) for x in zip(*[e for e in edges if None not in e]))
    assert sorted(zip(*(x.tolist() for x in tied(a, b)))) == [x for x in brute(edges) if x[0] != x[1]]
    assert tied(a[:0], b[:0])[0].tolist() == []


def test_rounds_stay_few(spark, monkeypatch):
    """A star of known labels is found as it is; a long path takes some rounds."""
    n, real = [0], graph.written
    monkeypatch.setattr(graph, "written", lambda df: n.__setitem__(0, n[0] + 1) or real(df))
    star = spark.createDataFrame([(i, 0) for i in range(1, 2000)], "a long, b long").repartition(5)
    assert {r.label for r in components(star).collect()} == {0}
    assert n[0] <= 3
    n[0] = 0
    path = spark.range(4000).selectExpr("id AS a", "id + 1 AS b").repartition(7)
    assert {r.label for r in components(path).collect()} == {0}
    assert n[0] <= 8
