"""N-gram Jaccard join by signature trees.

Documents whose shingle sets are equal count as one. Each set gives a prefix of its shingles, those
found often in some input batch coming last: of two sets that are similar enough, the smaller one has a shingle in
the first part of its prefix that is in the other's prefix too. Pairs that share one are pruned by its place in both
and by token bitmaps, what is left is gathered into clusters, and each cluster is joined by trees whose nodes hold
OR-combined bitmaps and size ranges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaframe.llm.common import U, WordHash, added, blocks, components, listed, lower_spaced_words, mix, written

#: Bits of the shortest token bitmap.
BITS = 1024
#: Documents that share a prefix shingle and are paired at once; more are clustered as a whole.
RUN = 32
#: Documents in one tree.
NODE = 256
#: Shingles kept in the list of frequent ones. It only orders the prefixes: results don't depend on it.
FREQUENT = 1 << 18
#: Bytes of shingle sets that a task joins at once.
PACK_BYTES = 8 << 20
#: Bits of an entry's place in its prefix, below its size.
PLACE = 28
FANOUT = 8


BASE = U(0x9E3779B97F4A7C15)


def shingles(texts: list, k: int, hashes: WordHash) -> list[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its k-word shingles; fewer words count as one."""
    words = [lower_spaced_words(t) for t in texts]
    h = rolled([w for x in words for w in x], k, hashes)
    out, at = [], 0
    for w in words:
        if len(w) >= k:
            x = np.sort(h[at : at + len(w) - k + 1])
            out.append(x[np.r_[True, x[1:] != x[:-1]]])
        elif w:
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(w), seed=len(w))], U))
        else:
            out.append(np.empty(0, U))
        at += len(w)
    return out


def rolled(words: list[bytes], k: int, hashes: WordHash) -> np.ndarray:
    """Hashes of every k consecutive words."""
    a = hashes.of(words)
    n = max(0, len(a) - k + 1)
    h = a[:n].copy()
    for i in range(1, k):
        h *= BASE
        h += a[i : i + n]
    return mix(h)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """BITS bits or two to four for each token, as 64-bit words."""
    n = max(BITS, 2 << (len(tokens) - 1).bit_length()) if len(tokens) else BITS
    bits = np.zeros(n, bool)
    bits[(tokens >> U(7)) % U(n)] = True
    return np.packbits(bits).view(U)


def folded(maps) -> np.ndarray:
    """The bitmaps, each made as short as the shortest."""
    maps = [np.frombuffer(m, U) if isinstance(m, bytes) else m for m in maps]
    least = min(map(len, maps))
    return np.stack([m if len(m) == least else np.bitwise_or.reduce(m.reshape(-1, least)) for m in maps])


def by_likeness(sizes: np.ndarray, maps: np.ndarray) -> np.ndarray:
    """An order of documents that puts near copies side by side: by the first bit set, the bits shuffled, then by size. So a
    node's combined bitmap stays narrow."""
    shuffled = [np.random.default_rng(seed).permutation(64 * maps.shape[1]) for seed in (1, 2)]
    first = np.empty((2, len(maps)), np.int64)
    for s in range(0, len(maps), 512):
        bits = np.unpackbits(np.ascontiguousarray(maps[s : s + 512]).view(np.uint8), axis=1)
        for f, p in zip(first, shuffled):
            f[s : s + 512] = bits[:, p].argmax(1)
    return np.lexsort((sizes, first[1], first[0]))


def alike(overlap, size_a, size_b, percent: int):
    return 100 * overlap >= percent * (size_a + size_b - overlap)


class Tree:
    """Leaves are documents in a given order; each higher node covers FANOUT nodes below it."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray):
        spare = sizes - np.bitwise_count(maps).sum(1).astype(np.int64)  # tokens hidden by shared bits
        self.levels = [(maps, sizes, sizes, spare)]
        while len(self.levels[-1][1]) > 1:
            m, lo, hi, sp = self.levels[-1]
            at = np.arange(0, len(lo), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(m, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(sp, at)))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether documents under nodes a and b can be similar enough, by the largest possible overlap."""
        m, lo, hi, sp = self.levels[level]
        common = np.bitwise_count(m[a] & m[b]).sum(1).astype(np.int64) + np.minimum(sp[a], sp[b])
        top = np.minimum(common, np.minimum(hi[a], hi[b]))
        least = lo[a] + lo[b]
        return (top >= least) | (100 * top >= percent * (least - top))

    def candidates(self, percent: int, joined: Joined) -> Iterator[tuple[int, int]]:
        """Leaf pairs left by a dual traversal from the root. Pairs of nodes whose leaves are all joined already are not
        expanded; a node is compared with itself first, so that copies join before nodes are compared with others."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        grid = np.arange(FANOUT)
        while stack:
            level, a, b = stack.pop()
            root = joined.root
            if level:
                at = np.arange(0, len(root), FANOUT**level)
                low, high = np.minimum.reduceat(root, at), np.maximum.reduceat(root, at)
                apart = (low[a] != high[b]) | (low[b] != high[a])
            else:
                apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            keep = self.possible(level, a, b, percent)
            a, b = a[keep], b[keep]
            if level == 0:
                yield from zip(a.tolist(), b.tolist())
            elif len(a):
                below = len(self.levels[level - 1][1])
                x, y = np.broadcast_arrays(a[:, None, None] * FANOUT + grid[:, None], b[:, None, None] * FANOUT + grid)
                x, y = x.ravel(), y.ravel()
                ok = (x < below) & (y < below) & (x < y if level == 1 else x <= y)
                x, y = x[ok], y[ok]
                order = np.argsort(x == y, kind="stable")  # taken from the end
                for s in range(0, len(x), 1024):
                    stack.append((level - 1, x[order[s : s + 1024]], y[order[s : s + 1024]]))


class Joined:
    """Disjoint sets of 0 to n - 1: root[i] is the same number for all of a set."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.members = {}

    def join(self, i: int, j: int) -> bool:
        i, j = int(self.root[i]), int(self.root[j])
        if i == j:
            return False
        a, b = self.members.pop(i, [i]), self.members.pop(j, [j])
        if len(a) > len(b):
            i, j, a, b = j, i, b, a
        self.root[a] = j
        b.extend(a)
        self.members[j] = b
        return True


def linked(ids: list[int], labels: list, sets: list[np.ndarray], asked: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(label, least) for each label but the least of those that links join.

    Only pairs with an `asked` document are compared, those joined already are passed over. Documents with one label start
    out joined.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    maps = folded([bitmap(s) for s in sets])
    order = by_likeness(sizes, maps)
    tree = Tree(sizes[order], maps[order])
    order = order.tolist()
    joined = Joined(len(ids))
    seen: dict = {}
    for at, i in enumerate(order):
        for x in (("label", labels[i]), ("id", ids[i])):
            joined.join(at, seen.setdefault(x, at))
    for x, y in tree.candidates(percent, joined):
        i, j = order[x], order[y]
        if (asked[i] or asked[j]) and joined.root[x] != joined.root[y]:
            overlap = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if alike(overlap, int(sizes[i]), int(sizes[j]), percent):
                joined.join(x, y)
    least: dict = {}
    for r, i in zip(joined.root.tolist(), order):
        least[r] = min(least.get(r, labels[i]), labels[i])
    return sorted({(labels[i], least[r]) for r, i in zip(joined.root.tolist(), order) if labels[i] != least[r]})


def _frequent(docs: DataFrame, k: int) -> pd.DataFrame:
    """(token, n): shingles found in many documents of some batch, with the sum of those counts."""

    def count(batches):
        hashes = WordHash()
        for b in batches:
            found = [np.empty(0, U)]
            for at in blocks(b.text.str.len().to_numpy()):
                # shingles across two texts are of no account: they only order what is frequent
                found.append(rolled([w for t in b.text.iloc[at] for w in lower_spaced_words(t)], k, hashes))
            h = np.sort(np.concatenate(found))
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
            n = np.diff(np.r_[start, len(h)])
            often = n >= max(4, len(b) // 1000)
            yield pd.DataFrame({"token": h[start[often]].view(np.int64), "n": n[often]})

    rows = docs.select("text").mapInPandas(count, "token long, n long")
    return rows.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()


def _described(docs: DataFrame, k: int, percent: int, frequent) -> DataFrame:
    """doc_id, n, a signature of the whole set, the prefix and the bitmap."""

    def make():
        tokens, ranks = frequent.value
        hashes = WordHash()

        def describe(texts):
            n, sig_a, sig_b, prefix, bits = [], [], [], [], []
            sets = shingles(texts, k, hashes)
            every = np.concatenate(sets)
            spot = np.minimum(np.searchsorted(tokens, every), len(tokens) - 1)
            frequent_rank = np.where(tokens[spot] == every, ranks[spot], -1) if len(tokens) else np.full(len(every), -1)
            done = 0
            for h in sets:
                rank = frequent_rank[done : done + len(h)]
                done += len(h)
                n.append(len(h))
                whole = xxhash.xxh3_128_intdigest(h.tobytes())
                sig_a.append((whole >> 64) - (1 << 63))
                sig_b.append((whole & ((1 << 64) - 1)) - (1 << 63))
                bits.append(bitmap(h).tobytes())
                first = len(h) - -(-percent * len(h) // 100) + 1 if len(h) else 0
                rare = h[rank < 0]
                if len(rare) < first:
                    often = np.flatnonzero(rank >= 0)
                    rare = np.concatenate([rare, h[often[np.argsort(rank[often], kind="stable")]]])
                prefix.append(rare[:first].view(np.int64))
            return n, sig_a, sig_b, prefix, bits

        return describe

    return added(docs.select("doc_id", "text"), ["text"], "n long, sig_a long, sig_b long, prefix array<long>, bits binary", make, drop=("text",))


def _first(n, percent: int):
    """How many shingles a document of n has in the first part of its prefix: enough to meet all that are as large
    or larger."""
    return n + 1 - -(-2 * percent * n // (100 + percent))


def _may_meet(n_a, at_a, n_b, at_b, percent: int):
    """Whether documents of sizes n_a <= n_b may be similar enough, if the first shingle that they share is at
    these places of their prefixes."""
    needed = -(-percent * (n_a + n_b) // (100 + percent))
    return (at_a < _first(n_a, percent)) & (100 * n_a >= percent * n_b) & (np.minimum(n_a - at_a, n_b - at_b) >= needed)


def _meetings(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b, token, n, crowd) of sorted entries (token, size, doc_id): pairs of documents that may be similar by a
    prefix shingle that they share; where more
    than RUN do, each of them alone, marked as one of a crowd."""

    def meet(batches):
        rest = np.empty((0, 3), np.int64)
        crowded, wanted = None, False  # the shingle of a crowd still coming in, whether one has it in its first part

        def pairs(run: np.ndarray, out: list):
            n, at = run[:, 1] >> PLACE, run[:, 1] & ((1 << PLACE) - 1)
            i, j = np.triu_indices(len(run), 1)
            ok = _may_meet(n[i], at[i], n[j], at[j], percent)
            i, j = i[ok], j[ok]
            out.append(np.stack([run[i, 2], run[j, 2], run[i, 0], n[i], np.zeros_like(i)], axis=1))

        def crowd(run: np.ndarray, out: list):
            nonlocal crowded, wanted
            if crowded is None or crowded != run[0, 0]:
                crowded, wanted = run[0, 0], False
            n, at = run[:, 1] >> PLACE, run[:, 1] & ((1 << PLACE) - 1)
            # a document meets none if neither it nor one before it has the shingle in its first part
            use = np.logical_or.accumulate((at < _first(n, percent)) | wanted)
            wanted = wanted or bool(use.any())
            run, n = run[use], n[use]
            out.append(np.stack([run[:, 2], run[:, 2], run[:, 0], n, np.ones(len(run), np.int64)], axis=1))

        def work(rows: np.ndarray, last: bool):
            nonlocal rest
            out: list = [np.empty((0, 5), np.int64)]
            cut = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0], True]) if len(rows) else np.array([0])
            size = np.diff(cut)
            for i in np.flatnonzero((size > 1) | (np.arange(len(size)) == len(size) - 1) | (np.arange(len(size)) == 0)).tolist():
                s, e = int(cut[i]), int(cut[i + 1])
                if e - s > RUN or crowded is not None and crowded == rows[s, 0]:
                    crowd(rows[s:e], out)
                elif not last and e == len(rows):
                    rest = rows[s:]
                elif e - s > 1:
                    pairs(rows[s:e], out)
            return pd.DataFrame(np.concatenate(out), columns=["a", "b", "token", "n", "crowd"])

        for b in batches:
            rows = np.concatenate([rest, b[["token", "size", "doc_id"]].to_numpy(np.int64)])
            rest = rows[:0]
            yield work(rows, False)
        yield work(rest, True)

    return entries.mapInPandas(meet, "a long, b long, token long, n long, crowd long")


def _crowds(members: DataFrame, described: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each shingle (token) with many documents (a), edges that join the documents that aren't
    pruned from one another. Only documents of one size band or of neighbouring ones are compared."""
    width = 1.0001 * math.log(100 / percent)
    band = F.floor(F.log("n") / width).cast("int")
    rows = members.select("token", F.explode(F.array(band, band + 1)).alias("band"), F.col("a").alias("doc_id"))
    rows = rows.join(described.select("doc_id", "n", "bits"), "doc_id")
    rows = rows.withColumn("pack", F.pmod(F.xxhash64("token", "band"), F.lit(max(1, members.count() // 1024))))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        for _, g in pdf.groupby(["token", "band"], sort=False):
            if len(g) < 2:
                continue
            sizes, maps = g.n.to_numpy(np.int64), folded(g.bits)
            order = by_likeness(sizes, maps)
            ids = g.doc_id.to_numpy()[order].tolist()
            joined = Joined(len(ids))
            tree = Tree(sizes[order], maps[order])
            for i, j in tree.candidates(percent, joined):
                if joined.join(i, j):
                    out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return rows.groupBy("pack").applyInPandas(join, "a long, b long")


def _pruned(pairs: DataFrame, described: DataFrame, percent: int) -> DataFrame:
    d = described.select("doc_id", "n", "bits")
    x = pairs.join(d.toDF("a", "n_a", "bits_a"), "a").join(d.toDF("b", "n_b", "bits_b"), "b")

    def prune(batches):
        for b in batches:
            short = np.minimum(b.bits_a.str.len(), b.bits_b.str.len())
            for _, g in b.groupby(short):
                m = folded([*g.bits_a, *g.bits_b])
                a, o = m[: len(g)], m[len(g) :]
                na, nb = g.n_a.to_numpy(), g.n_b.to_numpy()
                top = np.minimum(na - np.bitwise_count(a & ~o).sum(1).astype(np.int64), nb - np.bitwise_count(o & ~a).sum(1).astype(np.int64))
                yield g.loc[alike(top, na, nb, percent), ["a", "b"]]

    return x.mapInPandas(prune, "a long, b long")


def _solved(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """(label, least) for each label but the least of those that links join within a group by `keys`; small groups are
    handed out together."""
    total, size = rows.agg(F.count("*"), F.sum(F.length("tokens"))).first()
    packs = max(1, total // 512, (size or 0) // PACK_BYTES)
    rows = rows.withColumn("pack", F.pmod(F.xxhash64(*keys), F.lit(packs))).select("pack", *keys, "doc_id", "label", "asked", "tokens")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        for _, g in pdf.groupby(keys, sort=False):
            if len(g) > 1:
                sets = [np.frombuffer(t, U) for t in g.tokens]
                out += linked(g.doc_id.tolist(), g.label.tolist(), sets, g.asked.to_numpy(), percent)
        return pd.DataFrame(out, columns=["label", "least"]).astype("int64")

    return rows.groupBy("pack").applyInPandas(solve, "label long, least long")


def _in_nodes(rows: DataFrame, seed: int) -> DataFrame:
    """Adds nodes (how many trees the cluster takes) and node (the one of this document)."""
    sizes = rows.groupBy("cluster").agg(F.ceil(F.count("*") / NODE).cast("long").alias("nodes"))
    return rows.join(sizes, "cluster").withColumn("node", F.pmod(F.xxhash64("doc_id", F.lit(seed)), "nodes"))


def _relabelled(labels: DataFrame, ties: DataFrame) -> DataFrame:
    """The labels (doc_id, label) with each label that `ties` (label, least) hold replaced, and the ties themselves."""
    new = labels.join(ties, "label", "left").select("doc_id", F.coalesce("least", "label").alias("label"))
    return new.union(ties.select("label", "least"))


def _labels(clustered: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, label) of documents linked with a smaller one, and ties (label, least) still to be followed, if any.

    Clusters over NODE documents: trees of NODE documents first, then one document of each component
    found is compared across trees until one tree holds them. Each document is in one tree at a time, so that its tree gives
    its label. Last, each document outside a cluster's largest component is compared with all others, so no link between
    components is missed.
    """
    start = _in_nodes(clustered, 0).withColumns({"label": F.col("doc_id"), "asked": F.lit(True)})
    start = written(start)
    labels = written(_solved(start, ["cluster", "node"], percent).toDF("doc_id", "label"))
    big = start.where("nodes > 1").select("cluster", "doc_id", "tokens")
    if big.limit(1).count() == 0:
        return labels, None
    big = written(big)
    left = big.count()
    while True:
        heads = big.join(labels, "doc_id", "left_anti").withColumns({"label": F.col("doc_id"), "asked": F.lit(True)})
        heads = written(_in_nodes(heads, 1))
        n, most = heads.agg(F.count("*"), F.max("nodes")).first()
        if n > left // 2:
            break
        labels = written(_relabelled(labels, written(_solved(heads, ["cluster", "node"], percent))))
        if most == 1:
            break
        left = n
    labelled = written(big.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")))
    main = labelled.groupBy("cluster", "label").count().groupBy("cluster").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    parts = labelled.join(main, "cluster")
    out = _in_nodes(parts.where("label <> main"), 2).withColumnsRenamed({"node": "o", "nodes": "os"})
    out = written(out)
    if out.limit(1).count() == 0:
        return labels, None
    counts = out.select("cluster", "os").distinct()
    every = written(_in_nodes(parts.join(counts, "cluster"), 3))
    trees = every.select("cluster", "nodes").distinct()
    one = out.join(trees, "cluster").withColumn("node", F.explode(F.sequence(F.lit(0), F.col("nodes") - 1))).withColumn("asked", F.lit(True))
    two = every.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("os") - 1))).withColumn("asked", F.lit(False))
    cols = ["cluster", "o", "node", "doc_id", "label", "asked", "tokens"]
    met = one.select(cols).union(two.select(cols))
    return labels, written(_solved(met, ["cluster", "o", "node"], percent))


def _followed(labels: DataFrame, ties: DataFrame | None, again: DataFrame) -> DataFrame:
    """The labels with ties between them and the pairs `again` (a, b) of documents followed to the least document."""
    again = written(again)
    if again.limit(1).count():
        for end in ("a", "b"):
            again = again.join(labels.toDF(end, "found"), end, "left").withColumn(end, F.coalesce("found", end)).drop("found")
        ties = again.select("a", "b").union(ties) if ties else again
    if ties is None or ties.limit(1).count() == 0:
        return labels
    least = written(components(ties.toDF("a", "b")).toDF("label", "least").where("label <> least"))
    return written(_relabelled(labels, least))


def shingle_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of k-word shingles;
    words are runs of non-space characters, A-Z lowered, and fewer than k words are one shingle.
    component_id is the smallest doc_id reachable by links. Null or wordless texts have no shingles and
    link with nothing. Rows that share a doc_id are one node. A null doc_id joins no component: its
    component_id is null. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    often = _frequent(docs, k)
    token = often.token.to_numpy(np.int64).view(U)
    order = np.argsort(token)
    frequent = spark.sparkContext.broadcast((token[order], (len(often) - order).astype(np.int64)))
    described = written(_described(docs, k, percent, frequent))
    sig = ["sig_a", "sig_b", "n"]
    known = described.where("doc_id IS NOT NULL AND n > 0")
    same = written(known.groupBy(sig).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    copies = written(known.select("doc_id", *sig).join(same, sig).where("doc_id <> first").select("doc_id", *sig, "first").distinct())
    firsts = known.join(listed(copies.drop("first")), ["doc_id", *sig], "left_anti")
    repeated = known.groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = copies.join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    size = (F.col("n") * (1 << PLACE) + F.col("place")).alias("size")
    entries = firsts.select(F.posexplode("prefix").alias("place", "token"), "n", "doc_id").select("token", size, "doc_id").repartition("token").sortWithinPartitions("token", "size", "doc_id")
    met = written(_meetings(entries, percent))
    edges = _pruned(met.where("crowd = 0").select("a", "b").distinct(), known, percent).union(_crowds(met.where("crowd = 1"), known, percent))
    clusters = written(components(edges).toDF("doc_id", "cluster"))

    def sets(batches):
        hashes = WordHash()
        for b in batches:
            for at in blocks(b.text.str.len().to_numpy()):
                s = b.iloc[at]
                yield pd.DataFrame({"cluster": s.cluster.to_numpy(), "doc_id": s.doc_id.to_numpy(), "tokens": [x.tobytes() for x in shingles(s.text.tolist(), k, hashes)]})

    members = docs.join(listed(clusters), "doc_id").select("cluster", "doc_id", "text")
    clustered = written(members.mapInPandas(sets, "cluster long, doc_id long, tokens binary").where("length(tokens) > 0"))
    labels = _followed(*_labels(clustered, percent), again).toDF("first", "label")
    by_set = same.join(labels, "first", "left").select(*sig, F.coalesce("label", "first").alias("of_set"))
    rows = described.select("doc_id", *sig).join(by_set, sig, "left").join(labels.withColumnsRenamed({"first": "doc_id", "label": "of_doc"}), "doc_id", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("of_doc", "of_set", "doc_id")).alias("component_id"))
