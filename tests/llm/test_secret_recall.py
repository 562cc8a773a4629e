import random
import string

import pytest

from vistaframe.llm.secret_scan import STEPS, secret_spans, thresholds


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 30, 100, 1000])
def test_random_tokens_alone_are_accepted(n):
    r = random.Random(n)
    kept = total = 0
    for _ in range(400):
        steps = [int(r.random() * STEPS) for _ in range(n)]
        least = thresholds([("hex", 5, s, steps.count(s)) for s in set(steps)]).get(("hex", 5), 2)
        kept += sum(s >= least * STEPS for s in steps)
        total += n
    assert kept / total >= 0.95


def test_many_other_tokens_raise_the_threshold():
    tally = [("hex", 5, s, 10) for s in range(STEPS)] + [("hex", 5, 3, 900), ("hex", 5, 10, 400)]
    assert thresholds(tally)[("hex", 5)] > 0.1


POOLS = {"base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "base32": string.ascii_uppercase + "234567", "upper hex": string.digits + "ABCDEF"}


def test_planted_tokens_are_found_in_classes_of_any_size(spark):
    r = random.Random(11)
    rows, planted = [], {}
    for pool in POOLS.values():
        for count, length in ((1, 600), (3, 150), (10, 80), (100, 40), (5, 3000)):
            for _ in range(count):
                token = "".join(r.choices(pool, k=length))
                planted[len(rows)] = (count, pool, len(token))
                rows.append((len(rows), f"some words before {token} and behind"))
    first = len(rows)
    words = ["alpha", "River", "stone", "Bridge", "cloud", "Forest"]
    for _ in range(600):  # names in camel case with numbers, paths and rows of one digit
        kind = r.randrange(3)
        token = "".join(r.choices(words, k=6)) + str(r.randrange(99)) if kind == 0 else "/".join(r.choices(words, k=6)) + str(r.randrange(9)) if kind == 1 else "a1" + "0" * r.randrange(20, 60)
        rows.append((len(rows), f"see {token} here"))
    got = {x.doc_id: sum(s.kind == 3 for s in x.spans) for x in secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for size in (1, 3, 5, 10, 100):
        of = [i for i, x in planted.items() if x[0] == size]
        assert sum(got[i] > 0 for i in of) >= 0.9 * len(of), size
    false = sum(got[i] > 0 for i in range(first, len(rows)))
    assert false <= 0.01 * len(rows[first:])
