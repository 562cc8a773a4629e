import random
import string

from vistaframe.llm.secret_scan import _scanned, secret_spans


def test_copies_of_a_token_do_not_move_the_threshold(spark):
    r = random.Random(4)
    tokens = ["".join(r.choices(string.ascii_letters + string.digits + "+/", k=40)) for _ in range(100)]
    scanned = _scanned(spark.createDataFrame(enumerate(tokens), "doc_id long, text string"))
    p = {x.doc_id: x.tested[0].p for x in scanned.collect()}
    copied = min(p, key=lambda i: abs(p[i] - 0.3))
    once = spark.createDataFrame(enumerate(tokens), "doc_id long, text string")
    many = once.union(spark.createDataFrame([(1000 + i, tokens[copied]) for i in range(2000)], "doc_id long, text string"))
    alone = {x.doc_id: x.spans for x in secret_spans(once).collect()}
    out = {x.doc_id: x.spans for x in secret_spans(many).collect()}
    assert all(out[i] == alone[i] for i in range(100)) and all(out[1000 + i] == alone[copied] != [] for i in range(2000))
    assert sum(bool(s) for s in alone.values()) > 90
