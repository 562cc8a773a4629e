import random
import re
import zlib

import numpy as np

from vistaframe.llm.anomaly import IsolationForest, best_threshold, judged
from vistaframe.llm.common import WordHash
from vistaframe.llm.quality import FactorisationMachine, fitted, quality_scores
from vistaframe.llm.textstats import COLUMNS, text_stats


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    again = {i + k for x in at.values() if len(x) > 1 for i in x for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": len(again), "n_distinct": len(set(w)), "n_echoes": sum(a == b for a, b in zip(w, w[1:])), "n_digits": len(re.findall("[0-9]", t))}


def texts(seed):
    r = random.Random(seed)
    out = ["", None, " \n\t", "a", "a a", "a b c a b c", "x y z\x1c", "Été |#| 12\n\n12\n Été |#| 12", "a b c\na b c\n\na b c"]
    return out + [r.choice([" ", "\n"]).join(r.choices("abcd*é", k=r.randrange(60))) for _ in range(60)]


def test_counts_match_brute_force():
    t = texts(1)
    counts, words, doc = text_stats(t, WordHash())
    assert [dict(zip(COLUMNS, map(int, c))) for c in counts] == [brute(x) for x in t]
    assert len(words) == len(doc) == counts[:, 0].sum()


def test_linear_time_score_equals_all_pairs():
    r = np.random.default_rng(0)
    stats = r.normal(size=(6, 3))
    m = FactorisationMachine(stats)
    m.w, m.bias = r.normal(size=len(m.w)), 0.3
    doc, bucket = np.repeat(np.arange(6), 4), r.integers(0, 50, 24)
    feature, value, of = m.rows(stats, bucket, doc)
    for i in range(6):
        f, x = feature[of == i], value[of == i]
        pairs = sum(m.v[f[a]] @ m.v[f[b]] * x[a] * x[b] for a in range(len(f)) for b in range(a))
        z = m.bias + m.w[f] @ x + pairs
        assert np.isclose(m.score(stats, bucket, doc)[i], 1 / (1 + np.exp(-z)))


def labelled(spark, every=3):
    r = random.Random(4)
    rows = []
    for i in range(300):
        good = i % every > 0
        w = r.choices([f"w{k}" for k in range(80)], k=90)
        rows.append((i, " ".join(w if good else [x + "*" * r.randrange(2, 9) for x in w[: r.randrange(50, 90)]]), int(good)))
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(None, "w1 w2", 0.1), (900, None, 0.1), (901, "", 0.1), (5, "w1 " * 3000, 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (7, None), (901, 1)], "doc_id long, quality int")
    return docs, labels, {i: q for i, _, q in rows if i != 5}


def test_held_out_rows_are_told_apart(spark):
    docs, labels, truth = labelled(spark)
    out = quality_scores(docs, labels).collect()
    assert len(out) == 304 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in out)
    held = [x for x in out if x.doc_id in truth and zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    assert len(held) > 30 and np.mean([x.predicted == truth[x.doc_id] for x in held]) > 0.95


def test_model_ignores_held_out_labels(spark):
    docs, labels, _ = labelled(spark)
    a = fitted(docs, labels)
    changed = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    assert np.array_equal(a.w, fitted(docs, changed).w)


def test_no_labels(spark):
    docs, labels, _ = labelled(spark)
    assert {x.score for x in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_scores(docs.limit(0), labels).collect() == []
    assert {x.anomalous for x in judged(docs, labels.limit(0)).collect()} == {False}
    assert judged(docs.limit(0), labels).collect() == []


def test_forest_finds_outliers():
    r = np.random.default_rng(1)
    f = IsolationForest(np.r_[r.normal(size=(2000, 4)), r.normal(size=(20, 4)) + 8])
    assert f.score(np.full((1, 4), 8.0))[0] > f.score(r.normal(size=(500, 4))).max()
    same = IsolationForest(np.ones((5, 2)))
    assert same.score(np.ones((1, 2))).shape == (1,)


def test_threshold():
    assert best_threshold([(1800, 5, 0), (1000, 9, 1), (500, 2, 999)]) == 0.5 * 1000 / 1000
    assert best_threshold([(1, 0, 5)]) == 2 and best_threshold([]) == 2


def test_rules(spark):
    docs, labels, truth = labelled(spark, 15)
    out = judged(docs, labels).collect()
    assert len(out) == 304
    for x in out:
        assert x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words)
        assert x.kept == (not x.base_failed and not x.anomalous)
    assert np.mean([x.kept == bool(truth[x.doc_id]) for x in out if x.doc_id in truth]) > 0.95
