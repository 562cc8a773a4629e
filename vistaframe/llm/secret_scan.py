"""Secret scan: fixed patterns, and a battery of randomness tests for tokens that match none.

A long token's encoding is inferred from its characters. Under the hypothesis that its symbols are drawn
evenly from that alphabet, three tests give p-values: chi-squared of the symbol counts, number of runs above
and below the alphabet's middle, and correlation of neighbours. Fisher's method combines them. Within
each encoding and doubling of length, tokens (each counted once) are taken for random above the least p at which the
estimated share of tokens that aren't is within FALSE_SHARE. All of it is built-in functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistaframe.llm.common import written

# fixed values: the base patterns
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
LEAST_VALUE = 6
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
# fixed values: alphabets by name, in the order in which they are tried
ENCODINGS = {
    "hex": ("^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    "base32": ("^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base36": ("^([0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    "base62": ("^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    "base64": (".", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}
#: Only tokens with a letter and a digit, or with a small letter before a capital twice, are tested.
MIXED = r"[0-9][^0-9]*[A-Za-z]|[A-Za-z][^A-Za-z]*[0-9]|[a-z][A-Z].*[a-z][A-Z]"
#: Steps between p-values, least and largest threshold, accepted share of tokens that aren't random.
STEPS, LEAST_P, MOST_P, FALSE_SHARE = 100, 0.01, 0.5, 0.05
#: Standard errors that the estimated number of random tokens is raised by: a class of few tokens must show that it
#: holds others before it loses random ones.
ERRORS = 2
KINDS = (*PATTERNS, "random")
_OWN = ("_text", "_token", "_assign", "_access", "_hex", "_m", "_v", "_e", "_part", "_events", "_top", "_tops", "_cuts")

FEW = 32
_EMPTY = "CAST(array() AS array<struct<s:int,e:int,v:string>>)"


def _running(df: DataFrame, column: str, step: str) -> DataFrame:
    """df with the array of ints `column` replaced by its running values: step is SQL of the value so far ({a}, at
    first 0) and the next item ({y}).

    An array grows by copies, so it is built in parts, each from the value at which the part before ends. With parts
    of cbrt(2 n) items the copies are fewest. FEW items are built at once.
    """
    every = f"sequence(0, size({column}) - 1, _part)"
    # items are read by their places: to slice an array takes time for all of it
    places = f"sequence(i, least(i + _part, size({column})) - 1)"
    ends = f"aggregate({every}, array(0), (h, i) -> array_append(h, aggregate({places}, element_at(h, -1), (a, j) -> {step.format(a='a', y=f'{column}[j]')})))"
    grown = f"aggregate({places}, array(v), (h, j) -> array_append(h, {step.format(a='element_at(h, -1)', y=f'{column}[j]')}))"
    df = df.withColumn("_part", F.expr(f"CAST(greatest(1, ceil(cbrt(2 * size({column})))) AS INT)"))
    # the parts' first values come as a lambda's argument, so that they are computed once
    plain = f"slice(aggregate({column}, array(0), (h, y) -> array_append(h, {step.format(a='element_at(h, -1)', y='y')})), 2, size({column}))"
    parts = f"zip_with({every}, {ends}, (i, v) -> IF(i IS NULL, CAST(array() AS array<int>), slice({grown}, 2, _part)))"
    return df.withColumn(column, F.expr(f"CASE WHEN size({column}) = 0 THEN CAST(array() AS array<int>) WHEN size({column}) <= {FEW} THEN {plain} ELSE flatten({parts}) END")).drop("_part")


def _located(df: DataFrame, name: str, pattern: str, value: int = 0) -> DataFrame:
    """df (_text) with the column `name`: (s, e, v) of each match, leftmost first, without overlaps. What lies between
    matches gives their places in code points; v is the group `value`."""
    text, has = F.col("_text"), F.col("_text").rlike(pattern)
    none = F.array().cast("array<string>")
    df = df.withColumn("_m", F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("_v", F.when(has & F.lit(value > 0), F.regexp_extract_all(text, F.lit(pattern), F.lit(value))).otherwise(F.col("_m")))
    df = df.withColumn("_e", F.when(has, F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size("_m")), "_m", lambda g, m: F.length(g) + F.length(m))).otherwise(F.array().cast("array<int>")))
    df = _running(df, "_e", "{a} + {y}")
    spans = "transform(arrays_zip(_e, _m, _v), x -> named_struct('s', x._e - length(x._m), 'e', x._e, 'v', x._v))"
    return df.withColumn(name, F.expr(f"IF(size(_e) = 0, {_EMPTY}, {spans})")).drop("_m", "_v", "_e")


def _apart(df: DataFrame) -> DataFrame:
    """df with the spans of _token that overlap none of `base`: in one sweep over the starts of base spans and the
    ends of tokens, the furthest end of the base spans that start before a token's end mustn't be past its start."""
    events = "array_sort(concat(transform(_token, x -> named_struct('at', x.e, 'base', 0, 'e', 0)), transform(base, b -> named_struct('at', b.s, 'base', 1, 'e', b.e))))"
    df = df.withColumn("_events", F.expr(f"IF(size(_token) = 0, NULL, {events})")).withColumn("_top", F.expr("coalesce(transform(_events, x -> x.e), CAST(array() AS array<int>))"))
    df = _running(df, "_top", "greatest({a}, {y})")
    # tokens don't overlap one another, so their ends come in their own order
    tops = "transform(filter(arrays_zip(_events, _top), x -> x._events.base = 0), x -> x._top)"
    kept = f"transform(filter(arrays_zip(_token, _tops), x -> x._tops <= x._token.s), x -> x._token)"
    df = df.withColumn("_tops", F.expr(f"IF(size(_token) = 0, CAST(array() AS array<int>), {tops})"))
    return df.withColumn("_token", F.expr(f"IF(size(_token) = 0, _token, {kept})")).drop("_events", "_top", "_tops")


def _steps() -> list[tuple[str, str]]:
    """SQL over x, from a token's start s, end e and text v to the p-value of the battery; id is the text's hash."""
    encoding = "CASE " + " ".join(f"WHEN x.v RLIKE '{pattern}' THEN '{name}'" for name, (pattern, _) in ENCODINGS.items()) + " END"
    alphabet = "CASE x.enc " + " ".join(f"WHEN '{name}' THEN '{a}'" for name, (_, a) in ENCODINGS.items()) + " END"
    tail = "(1 / (1 + exp(1.5976 * least(8d, greatest(-8d, {0})) + 0.070565 * pow(least(8d, greatest(-8d, {0})), 3))))"  # of the normal distribution
    both = f"least(1d, 2 * {tail.format('abs({0})')})"
    return [
        ("named_struct('s', x.s, 'e', x.e, 'id', xxhash64(x.v), 'v', x.v, 'enc', {enc})", encoding),
        ("named_struct('s', x.s, 'e', x.e, 'id', x.id, 'enc', x.enc, 'a', {a}, 'v', translate(IF(x.enc IN ('hex', 'base36'), lower(x.v), x.v), '-_', '+/'))", alphabet),
        ("named_struct('s', x.s, 'e', x.e, 'id', x.id, 'enc', x.enc, 'k', length(x.a), 'v', filter(transform(filter(split(x.v, ''), c -> c <> ''), c -> instr(x.a, c) - 1), i -> i >= 0))", ""),
        (
            "named_struct('s', x.s, 'e', x.e, 'id', x.id, 'enc', x.enc, 'k', CAST(x.k AS DOUBLE), 'n', CAST(size(x.v) AS DOUBLE),"
            " 'same', aggregate(sequence(0, x.k - 1), 0d, (t, i) -> t + pow(size(filter(x.v, j -> j = i)), 2)),"
            " 'turns', aggregate(zip_with(slice(x.v, 1, size(x.v) - 1), slice(x.v, 2, size(x.v) - 1), (i, j) -> IF((2 * i >= x.k) <> (2 * j >= x.k), 1d, 0d)), 0d, (t, i) -> t + i),"
            " 'serial', aggregate(zip_with(slice(x.v, 1, size(x.v) - 1), slice(x.v, 2, size(x.v) - 1), (i, j) -> (i - (x.k - 1) / 2d) * (j - (x.k - 1) / 2d)), 0d, (t, i) -> t + i))",
            "",
        ),
        (
            "named_struct('s', x.s, 'e', x.e, 'id', x.id, 'enc', x.enc, 'len', CAST(floor(log2(x.n)) AS INT),"
            f" 'p1', {tail.format('((x.k / x.n * x.same - x.n - (x.k - 1)) / sqrt(2 * (x.k - 1) * (x.n - 1) / x.n))')},"
            f" 'p2', {both.format('((x.turns - (x.n - 1) / 2) / sqrt((x.n - 1) / 4))')},"
            f" 'p3', {both.format('(x.serial / ((pow(x.k, 2) - 1) / 12) / sqrt(x.n - 1))')})",
            "",
        ),
        ("named_struct('s', x.s, 'e', x.e, 'id', x.id, 'enc', x.enc, 'len', x.len, 'h', -ln(greatest(x.p1, 1e-30)) - ln(greatest(x.p2, 1e-30)) - ln(greatest(x.p3, 1e-30)))", ""),
        ("named_struct('s', x.s, 'e', x.e, 'id', x.id, 'enc', x.enc, 'len', x.len, 'p', exp(-x.h) * (1 + x.h + pow(x.h, 2) / 2))", ""),
    ]


def _scanned(docs: DataFrame) -> DataFrame:
    """docs with base (kind, s, e of all base spans, in order) and tested (s, e, id, enc, len, p of other tokens)."""
    out = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    for k, pattern in PATTERNS.items():
        out = _located(out, f"_{k}", pattern, 2 if k == "assign" else 0)
    out = _located(out, "_token", TOKEN).drop("_text")
    out = out.withColumn("_assign", F.expr(f"filter(_assign, x -> length(x.v) >= {LEAST_VALUE})"))
    ranked = [F.expr(f"transform(_{k}, x -> named_struct('s', x.s, 'kind', {i}, 'e', x.e))") for i, k in enumerate(PATTERNS)]
    out = out.withColumn("base", F.array_sort(F.concat(*ranked))).drop("_assign", "_access", "_hex")
    out = _apart(out.withColumn("_token", F.expr(rf"filter(_token, x -> x.v RLIKE '{MIXED}')")))
    for step, part in _steps():
        out = out.withColumn("_token", F.expr(f"transform(_token, x -> {step.replace('{enc}', part).replace('{a}', part)})"))
    return out.withColumnRenamed("_token", "tested")


def thresholds(tally: list[tuple[str, int, int, int]]) -> dict[tuple[str, int], float]:
    """From (encoding, length class, step of p, distinct tokens): the least p of tokens taken for random.

    Random tokens spread evenly over p, so those above MOST_P tell how many there are in all. The threshold
    is the least at which the share of other tokens above it is within FALSE_SHARE, by the upper bound of that estimate.
    """
    groups: dict = {}
    for enc, length, step, n in tally:
        groups.setdefault((enc, length), {})[min(step, STEPS - 1)] = n
    out = {}
    for key, counts in groups.items():
        high = sum(n for step, n in counts.items() if step >= MOST_P * STEPS)
        random = (high + ERRORS * math.sqrt(high + 1)) / (1 - MOST_P)
        for step in range(round(LEAST_P * STEPS), round(MOST_P * STEPS) + 1):
            above = sum(n for s, n in counts.items() if s >= step)
            if above and above - random * (1 - step / STEPS) <= FALSE_SHARE * above:
                out[key] = step / STEPS
                break
    return out


def secret_spans(docs: DataFrame) -> DataFrame:
    """`docs` (text and any other columns) with base_spans and spans: arrays of (s, kind, e), code points, e
    exclusive, in order of start, then kind as in KINDS.

    Base spans are the matches of PATTERNS, leftmost and not overlapping within a kind; an assignment's value
    has LEAST_VALUE characters or more. spans adds tokens of 20 characters or more that overlap none and
    pass for random. A null or empty text has none. Columns of docs named so are replaced.
    """
    docs = docs.drop("base_spans", "spans", "base", "tested", *_OWN)
    scanned = written(_scanned(docs))
    tokens = scanned.select(F.explode("tested").alias("x"))
    # a token counts once, however often it is copied: copies aren't spread over p
    step = F.floor(F.col("x.p") * STEPS).cast("int").alias("step")
    counts = tokens.select("x.enc", "x.len", "x.id", step).distinct().groupBy("enc", "len", "step").count()
    least = thresholds([tuple(r) for r in counts.collect()])
    pass_ = " OR ".join(f"(x.enc = '{enc}' AND x.len = {length} AND x.p >= {p})" for (enc, length), p in sorted(least.items())) or "false"
    found = F.expr(f"transform(filter(tested, x -> {pass_}), x -> named_struct('s', x.s, 'kind', {len(PATTERNS)}, 'e', x.e))")
    return scanned.withColumn("spans", F.array_sort(F.concat("base", found))).drop("tested").withColumnRenamed("base", "base_spans")


def as_text(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"], x["e"])), ",")


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """`docs` with its text's spans replaced by `mark` (overlapping spans by one) and n_chars counted anew."""

    x = secret_spans(docs).withColumn("_e", F.expr("transform(spans, x -> x.e)"))
    x = _running(x, "_e", "greatest({a}, {y})")
    # before: where the text that isn't yet copied begins. A substring is found from its text's start on, so spans
    # are cut by parts of the text.
    before = "transform(spans, (x, i) -> named_struct('s', x.s, 'b', IF(i = 0, 0, _e[i - 1]), 'e', _e[i]))"
    x = x.withColumn("_cuts", F.expr(before)).withColumn("_part", F.expr("CAST(greatest(1, ceil(sqrt(size(spans)))) AS INT)"))
    x = x.withColumn("_cuts", F.expr("IF(size(_cuts) = 0, NULL, transform(sequence(0, size(_cuts) - 1, _part), i -> transform(sequence(i, least(i + _part, size(_cuts)) - 1), j -> _cuts[j])))"))
    x = x.withColumn("_cuts", F.expr("transform(_cuts, c -> named_struct('c', c, 'b', c[0].b, 't', substring(text, c[0].b + 1, element_at(c, -1).e - c[0].b)))"))
    piece = f"IF(y.s >= y.b, concat(substring(x.t, y.b - x.b + 1, y.s - y.b), '{mark}'), '')"
    whole = f"concat(array_join(transform(_cuts, x -> array_join(transform(x.c, y -> {piece}), '')), ''), substring(text, element_at(_e, -1) + 1))"
    clean = x.withColumn("text", F.expr(f"IF(size(spans) > 0, {whole}, text)")).drop("spans", "base_spans", "_e", "_cuts", "_part")
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean
