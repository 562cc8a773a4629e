"""Mixing sources to target weights by entropy balancing.

Document rates w minimise the entropy sum of q (w ln w - w) under one constraint a source, that the words
taken add up to its target, and 0 <= w <= MOST_COPIES. The dual is convex: w = min(MOST_COPIES,
exp(lambda c)) with c = size / q. Newton iterations find each source's lambda from distributed sums. With
q = size + the source's mean size, c is bounded, so that long documents don't take all of a tilt.
The rates are rounded into copies along the order of sizes, and what a source still lacks is made up by
single documents of about that size. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaframe.llm.common import listed, written

MOST_COPIES = 3
#: Newton steps or bisections after which sources that aren't at their targets are an error: the latter alone need some 60.
ROUNDS = 100
#: Relative difference between a source's words and its target at which the iterations end.
CLOSE = 1e-7
#: Documents of one size that are put in order together.
GROUP = 256


def _targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target. Weights 1, 2, 3 repeat over the sources by code point, null last; each
    target stops at MOST_COPIES times its source's size and the excess is shared out by weight again."""
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    # a line-up of the sources alone: one row each
    t = per.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1).withColumn("cap", F.lit(float(MOST_COPIES)) * F.col("source_size"))
    # with the sources in order of cap / weight, those up to some place stop at their caps; the rest share
    # what is left by weight
    w = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumns({
        "left": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "weights": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    t = t.withColumn("share", F.when(F.col("weights") > 0, F.col("left") / F.col("weights")))
    # the first source that its share doesn't fill sets the level for all after it
    level = F.first(F.when(F.col("share") * F.col("weight") < F.col("cap"), F.col("share")), ignorenulls=True).over(every)
    return t.withColumn("target", F.coalesce(F.least(F.col("cap"), level * F.col("weight")), F.col("cap"))).select("source", "source_size", "target")


def _same(*keys: str):
    return [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]


def _rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """sizes (source, size, n) of documents with words, with rate: a Newton step for all sources at once in
    each round."""
    top = F.lit(float(MOST_COPIES))
    mean = sizes.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    rows = sizes.where("size > 0").alias("a").join(listed(written(mean)).alias("b"), _same("source")).select("a.*", (F.col("size") / (F.col("size") + F.col("mean"))).alias("c"))
    rows = written(rows)
    words = F.col("n") * F.col("size")
    start = rows.groupBy("source").agg(F.min("c").alias("least"), (F.sum(words * F.col("c")) / F.sum(words)).alias("middle"))
    start = start.alias("a").join(targets.alias("b"), _same("source")).select("a.*", "target", "source_size")
    # lambda stays within [low, high]; where a Newton step leaves it, the middle is taken
    high = F.log(top) / F.col("least")
    full = F.col("target") >= top * F.col("source_size") * (1 - CLOSE)
    lam = F.when(full, high).otherwise(F.log(F.col("target") / F.col("source_size")) / F.col("middle"))
    dual = written(start.select("source", "target", lam.alias("lam"), F.lit(-200.0).alias("low"), high.alias("high")))
    for _ in range(ROUNDS):
        w = F.least(top, F.exp(F.col("lam") * F.col("c")))
        taken = F.col("n") * F.col("size") * w
        sums = rows.alias("a").join(listed(dual).alias("b"), _same("source")).select("a.source", "target", "lam", "low", "high", taken.alias("taken"), F.when(w < top, taken * F.col("c")).otherwise(0.0).alias("slope"))
        sums = sums.groupBy("source").agg(*(F.first(k).alias(k) for k in ("target", "lam", "low", "high")), F.sum("taken").alias("taken"), F.sum("slope").alias("slope"))
        over = F.col("taken") > F.col("target")
        sums = sums.withColumns({
            "low": F.when(over, F.col("low")).otherwise(F.col("lam")),
            "high": F.when(over, F.col("lam")).otherwise(F.col("high")),
            "step": F.col("lam") - F.when(F.col("slope") > 0, (F.col("taken") - F.col("target")) / F.col("slope")),
            "off": F.abs(F.col("taken") - F.col("target")) / F.col("target"),
        })
        inside = (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
        new = F.when(F.col("off") <= CLOSE, F.col("lam")).when(inside, F.col("step")).otherwise((F.col("low") + F.col("high")) / 2)
        dual = written(sums.select("source", "target", new.alias("lam"), "low", "high", "off"))
        if (dual.agg(F.max("off")).first()[0] or 0) <= CLOSE:
            break
        dual = dual.drop("off")
    else:
        far = sums.where(F.col("off") > CLOSE).select("source").limit(10).collect()
        raise ArithmeticError(f"no rates found that meet the targets of sources {[r.source for r in far]}")
    found = rows.alias("a").join(listed(dual).alias("b"), _same("source"))
    return found.select("a.source", "size", "n", F.least(top, F.exp(F.col("lam") * F.col("c"))).alias("rate"))


def _copies(slim: DataFrame, rated: DataFrame) -> DataFrame:
    """slim (doc_id, source, size, key) with rank, a number within source and size, and copies.

    Every source is lined up by size. A document takes a further copy where the running sum of the rates'
    fractions passes a whole number, so the copies of any stretch are within one of its rates' sum. Many
    documents of one size are put in order in groups, whose counts are summed up.
    """
    w = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    lined = rated.withColumn("frac", F.col("rate") - F.floor("rate"))
    lined = lined.withColumns({"before": F.coalesce(F.sum(F.col("frac") * F.col("n")).over(w), F.lit(0.0)), "groups": F.ceil(F.col("n") / GROUP).cast("long")})
    joined = slim.where("size > 0").alias("a").join(listed(written(lined)).alias("b"), _same("size", "source")).select("a.*", "rate", "frac", "before", "groups")
    grouped = written(joined.withColumn("sub", F.pmod(F.xxhash64("key", "doc_id"), "groups")))
    w = Window.partitionBy("source", "size").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    subs = grouped.groupBy("source", "size", "sub").agg(F.count("*").alias("n")).withColumn("skip", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    # only sizes with several groups need what the groups before them hold
    many = listed(written(subs.where("skip > 0")))
    rows = grouped.alias("a").join(many.alias("b"), _same("size", "sub", "source"), "left").select("a.*", F.coalesce("skip", F.lit(0)).alias("skip"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "sub").orderBy("key", "doc_id")) + F.col("skip"))

    def passed(k):
        return F.floor(F.round(F.col("before") + k * F.col("frac"), 6) + 0.5)

    copies = F.floor("rate") + passed(F.col("rank")) - passed(F.col("rank") - 1)
    return rows.select("doc_id", "source", "size", "rank", F.least(F.lit(MOST_COPIES), copies).cast("int").alias("copies"))


def _repairs(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, size, rank, change): for each source a few single documents that take one copy more or less,
    each the one whose size comes closest to what is missing, until none brings a source closer."""
    taken = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"))
    lack = written(targets.alias("a").join(taken.alias("b"), _same("source")).select("a.source", (F.col("target") - F.col("taken")).alias("lack")))
    can = written(
        counted.groupBy("source", "size").agg(F.min(F.when(F.col("copies") < MOST_COPIES, F.col("rank"))).alias("more"), F.min(F.when(F.col("copies") > 0, F.col("rank"))).alias("less"))
    )
    changes = None
    while True:
        open_ = can.alias("a").join(listed(lack).alias("b"), _same("source")).select("a.*", "lack")
        if changes is not None:
            open_ = open_.alias("a").join(listed(changes).alias("b"), _same("source", "size"), "left_anti")
        rank = F.when(F.col("lack") > 0, F.col("more")).otherwise(F.col("less"))
        rest = F.abs(F.abs("lack") - F.col("size"))
        best = open_.withColumns({"rank": rank, "rest": rest}).where("rank IS NOT NULL AND rest < abs(lack)")
        best = best.groupBy("source").agg(F.min(F.struct("rest", "size", "rank", F.signum("lack").cast("int").alias("change"))).alias("x")).select("source", "x.size", "x.rank", "x.change")
        best = written(best)
        if changes is not None and best.isEmpty():
            return changes
        changes = best if changes is None else written(changes.union(best))
        lack = written(lack.alias("a").join(best.alias("b"), _same("source"), "left").select("a.source", (F.col("lack") - F.coalesce(F.col("size") * F.col("change"), F.lit(0))).alias("lack")))


def mixed(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source): doc_id, source, size, source_size, target, copies, taken.

    size: runs of characters other than space and U+0009 to U+000D in the text (null: 0). target: the
    source's words in the mix, see _targets. copies: 0 to MOST_COPIES; taken: size times copies. A null source
    is a source, and a null doc_id is a document. Documents without words take no copies. The order in
    which documents are rounded depends on the rows' contents alone, so reruns agree; rows that are equal in
    all three columns may differ in copies. Other columns are ignored.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    slim = written(docs.select("doc_id", "source", size.alias("size"), F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit("mix")).alias("key")))
    sizes = written(slim.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = written(_targets(sizes))
    counted = written(_copies(slim, written(_rates(sizes, targets))))
    changes = listed(_repairs(counted, targets))
    rows = counted.alias("a").join(changes.alias("b"), _same("size", "rank", "source"), "left").select("a.doc_id", "a.source", "a.size", (F.col("copies") + F.coalesce("change", F.lit(0))).alias("copies"))
    rows = rows.union(slim.where("size = 0").select("doc_id", "source", "size", F.lit(0).alias("copies")))
    out = rows.alias("a").join(listed(targets).alias("b"), _same("source")).select("a.doc_id", "a.source", "size", "source_size", "target", "copies")
    return out.withColumn("taken", F.col("size") * F.col("copies"))
