import random

import corpus_pipeline
from corpus_pipeline import STAGES


def fixture(spark, tmp_path):
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: r.choices(vocab, k=n)
    passage = [f"b{i}" for i in range(30)]
    docs, labels = [], []
    for i in range(240):
        w = text(r.randrange(60, 120))
        bad = i % 6 == 0
        docs.append((i, " ".join(x + "***" for x in w) if bad else " ".join(w), "en", f"s{i % 3}"))
        labels.append((i, int(not bad), 0))
    copy = docs[1][1].split()
    copy[5] = "changed"
    docs += [(300, docs[1][1], "en", "s0"), (301, " ".join(copy), "en", "s1"), (302, " ".join(text(50) + passage[:20] + text(50)), "en", "s1"), (303, " ".join(text(1000) + passage[:14]), "en", None), (304, " ".join(text(80)) + " token=abcdef123456", "en", "s2"), (305, None, None, None), (7, docs[7][1], "en", "s1"), (None, " ".join(text(90)), "en", "s0")]
    rows = [(*d, len(d[1] or ""), "x") for d in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs


def test_stages_take_effect(spark, tmp_path):
    docs = fixture(spark, tmp_path)
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = d.columns, []
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, d, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        d = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append(d.collect())
        assert k == len(STAGES) - 1 or d.columns == columns
    ids = [[x.doc_id for x in rows] for rows in seen]
    bad = {i for i in range(240) if i % 6 == 0}
    assert len(bad & {*ids[0]}) < 4 and {i for i in range(240)} - bad <= {*ids[0]}
    assert {300, 301, 7} <= {*ids[0]} and not {300, 301} & {*ids[1]} and 1 in ids[1] and ids[1].count(7) == 1 and None in ids[1]
    assert 302 not in ids[2] and 303 in ids[2]
    assert next(x for x in seen[3] if x.doc_id == 304).text.endswith(" [secret]")
    assert len(seen[3]) == len(seen[2]) == len(seen[4])
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, run)) == sorted(map(str, seen[4])) and docs


def test_the_row_kept_of_an_id_is_defined(spark, tmp_path):
    from vistaframe.llm import stages

    rows = [(7, "beta one two", "de"), (7, "alpha one two", "fr"), (7, "alpha one two", "en"), (8, None, "x"), (8, "something", "a"), (None, None, "n"), (None, None, "n")]
    for order in (rows, rows[::-1]):
        d = spark.createDataFrame(order, "doc_id long, text string, component_id string").repartition(3)
        got = sorted(map(tuple, stages.one_of_each_group(spark, d, str(tmp_path)).collect()), key=str)
        assert got == sorted([(7, "alpha one two", "en"), (8, None, "x"), (None, None, "n"), (None, None, "n")], key=str)
