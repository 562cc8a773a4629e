import random
import re

import pytest

from vistaframe.llm.substring_dedup import COVER, PERIOD, without_repeats


def brute(rows, width):
    seqs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, seqs):
        for i in range(len(w) - width + 1):
            if d is not None:
                k = tuple(w[i : i + width])
                first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, seqs):
        gone = set()
        for i in range(len(w) - width + 1):
            if d is not None and first[tuple(w[i : i + width])] < d:
                gone |= set(range(i, i + width))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def test_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


@pytest.mark.parametrize("rows_a_batch", [10000, 3])
def test_matches_brute_force(spark, rows_a_batch):
    """Small batches part the rows of a passage and of a document."""
    r = random.Random(5)
    word = lambda: f"w{r.randrange(10**5)}"
    passages = [[word() for _ in range(n)] for n in (32, 33, 36, 39, 40, 41, 60, 120)]
    rows = []
    for i in range(80):
        w = []
        for _ in range(r.randrange(4)):
            w += [word() for _ in range(r.randrange(50))] + r.choice(passages)
        rows.append((i, r.choice([" ", "\n", " \t"]).join(w)))
    rows += [(100 + i, rows[3 + i % 3][1]) for i in range(20)]
    rows += [(200, None), (201, ""), (None, rows[5][1]), (202, " ".join(["a"] * 500)), (203, " ".join(["a"] * 45)), (5, rows[5][1]), (6, " ".join(passages[7])), (204, " ".join(passages[7]))]
    r.shuffle(rows)
    docs = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, kept string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_a_batch))
    try:
        got = sorted((tuple(x) for x in without_repeats(docs, 40).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows, 40)


def test_empty_table(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    nulls = spark.createDataFrame([(1, None), (None, None)], "doc_id long, text string")
    assert sorted(map(tuple, without_repeats(nulls).collect()), key=str) == [(1, 0, 0, ""), (None, 0, 0, "")]
