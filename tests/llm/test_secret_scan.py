import random
import re
import string

from pyspark.sql import functions as F

from vistaframe.llm.secret_scan import KINDS, as_text, redacted, secret_spans, thresholds

BASE = {
    "assign": (r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def brute(t):
    return sorted((m.start(), i, m.end()) for i, (p, ok) in enumerate(BASE.values()) for m in re.finditer(p, t or "") if ok(m))


def rows():
    r = random.Random(1)
    bits = ["password", "PassWD", "secret", "toKEN", "api_key", "apikey", '"', "'", " ", "  ", ":", "=", "abc", "abcdef", "x1+/_.=-y", "AKIA", "AKIA" + "A1" * 8, "AKIAAKIA" + "Q7" * 7, "0123456789abcdef", "deadbeef", "é", "😀", "\n", "ſecret", "toKen", ","]
    out = [(i, "".join(r.choices(bits, k=r.randrange(40)))) for i in range(150)]
    return out + [(900, None), (901, ""), (None, "token=abcdef"), (3, 'password="token" = abcdefgh'), (902, "token=abcdef " * 300), (903, "z" * 50000)]


def test_base_spans_match_brute_force(spark):
    data = rows()
    docs = spark.createDataFrame([(d, t, "k") for d, t in data], "doc_id long, text string, spans string")
    out = secret_spans(docs).collect()
    assert len(out) == len(data)
    for x in out:
        assert [tuple(s) for s in x.base_spans] == brute(x.text), x.text
        assert set(x.base_spans) <= set(x.spans)


def test_random_tokens_are_added_and_words_are_not(spark):
    r = random.Random(2)
    token = lambda: "".join(r.choices(string.ascii_letters + string.digits + "+/", k=40))
    data = [(i, f"key {token()} end") for i in range(100)]
    data += [(200 + i, "Donaudampfschifffahrtsgesellschaftskapitaen 2026-01-01T00:00:00 zzzzzzzzzzzzzzzzzzzzzzzz1 12345678901234567890123") for i in range(50)]
    out = {x.doc_id: x.spans for x in secret_spans(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert sum([tuple(s) for s in out[i]] == [(4, KINDS.index("random"), 44)] for i in range(100)) > 90
    assert not any(out[200 + i] for i in range(50))


def test_thresholds():
    even = [("hex", 5, s, 10) for s in range(100)]
    assert thresholds(even) == {("hex", 5): 0.01}
    assert thresholds([*even[1:], ("hex", 5, 0, 5000)]) == {("hex", 5): 0.01}
    assert thresholds([("hex", 5, s, 10 if s > 20 else 500) for s in range(100)])["hex", 5] > 0.2
    assert thresholds([("hex", 5, 0, 100)]) == {} and thresholds([]) == {}


def test_text_and_redaction(spark):
    docs = spark.createDataFrame([(1, "a token=abcdef0123456789abcdef0123 é AKIA" + "B" * 16, 0), (2, None, 0), (3, "clean", 0)], "doc_id long, text string, n_chars int")
    assert secret_spans(docs).select(as_text("spans")).first()[0] == "assign:2:34,hex:8:34,access:37:57"
    assert [tuple(x) for x in redacted(docs).orderBy("doc_id").collect()] == [(1, "a [secret] é [secret]", 21), (2, None, None), (3, "clean", 5)]
    assert secret_spans(docs.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    out = secret_spans(spark.createDataFrame([(1, "x")], "doc_id long, text string").where(F.col("doc_id") > 0))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_time_grows_in_proportion_to_the_matches_of_a_text(spark):
    import time

    def took(n):
        docs = spark.createDataFrame([(1, "token=abcdef1 " * n, 0)], "doc_id long, text string, n_chars int").coalesce(1)
        began = time.time()
        out = redacted(docs).selectExpr("length(text) AS n", "size(split(text, 'secret')) AS k").first()
        assert tuple(out) == (9 * n, n + 1)
        return time.time() - began

    took(2000)
    short, long = took(32_000), took(64_000)
    assert long < 3 * short  # four times, if each match took time for all before it


def battery(v):
    """p-value of a token, from the definitions of the tests."""
    import math

    names = ((r"[0-9a-f]+|[0-9A-F]+", "0123456789abcdef", str.lower), (r"[A-Z2-7]+=*", string.ascii_uppercase + "234567", str), (r"[0-9a-z]+|[0-9A-Z]+", string.digits + string.ascii_lowercase, str.lower), (r"[0-9A-Za-z]+", string.digits + string.ascii_uppercase + string.ascii_lowercase, str), (r".*", string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/", str))
    alphabet, fold = next((a, f) for p, a, f in names if re.fullmatch(p, v))
    x = [alphabet.index(c) for c in fold(v).translate(str.maketrans("-_", "+/")) if c in alphabet]
    n, k = len(x), len(alphabet)
    tail = lambda z: 1 / (1 + math.exp(1.5976 * max(-8, min(8, z)) + 0.070565 * max(-8, min(8, z)) ** 3))
    chi = sum((x.count(i) - n / k) ** 2 / (n / k) for i in range(k))
    p1 = tail((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
    turns = sum((2 * a >= k) != (2 * b >= k) for a, b in zip(x, x[1:]))
    p2 = min(1, 2 * tail(abs((turns - (n - 1) / 2) / math.sqrt((n - 1) / 4))))
    mean, var = (k - 1) / 2, (k * k - 1) / 12
    p3 = min(1, 2 * tail(abs(sum((a - mean) * (b - mean) for a, b in zip(x, x[1:])) / var / math.sqrt(n - 1))))
    h = -sum(math.log(max(p, 1e-30)) for p in (p1, p2, p3))
    return math.exp(-h) * (1 + h + h * h / 2)


def test_p_values_match_their_definitions(spark):
    from vistaframe.llm.secret_scan import _scanned

    r = random.Random(8)
    pools = ["0123456789ABCDEF", string.ascii_uppercase + "234567", string.digits + string.ascii_lowercase, string.ascii_letters + string.digits + "+/_-", string.ascii_letters + string.digits, "aB1"]
    tokens = ["".join(r.choices(r.choice(pools), k=r.randrange(20, 90))) for _ in range(200)]
    got = _scanned(spark.createDataFrame([(t,) for t in tokens], "text string")).select("text", "base", "tested").collect()
    seen = 0
    for x in got:
        base = brute(x.text)
        for t in x.tested:
            seen += 1
            assert (t.s, t.e) == (0, len(x.text)) and not any(s < t.e and t.s < e for s, _, e in base)
            assert abs(t.p - battery(x.text)) < 1e-9
    assert seen > 100
