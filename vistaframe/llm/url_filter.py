"""URL filter: a sorted array of 64-bit xxhash keys, memory-mapped and probed by binary search.

An entry is `host/path-prefix`. The keys are kept sorted in one file, the full strings beside them in
another; Spark hands the files to every executor, where tasks map them. A key that is found counts only
if the stored string is equal. Of a url, only prefixes of shapes that the entries have (labels of the
host, length of the path) are probed.
"""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

import numpy as np
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaframe.llm.common import added, written

#: Bytes of entries that are handed to every executor; longer lists are split and probed part by part.
LIST_BYTES = 64 << 20
ENTRY_BYTES = 200
VERDICTS = ("allow", "block")
_handed_out: list = []

# fixed values: the rules of the query's contract, longest match first
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
# fixed values: hosts whose names say advertising, betting, pills or link farms; subdomains count
BLOCKED_HOSTS = ("ads-track.example.org", "ads-track.example.com", "ads-track.example.net", "cheap-pills.example.org", "cheap-pills.example.com", "cheap-pills.example.net", "free-bets.example.org", "free-bets.example.com", "free-bets.example.net", "spam-farm.example.org", "spam-farm.example.com", "spam-farm.example.net")

# fixed values: words by category; a host is listed if a label of it, split at whatever isn't a letter, has one of them
CATEGORIES = {
    "advertising": ("ads", "adserver", "adservers", "advert", "adverts", "advertising", "banners", "clicktrack", "popads", "popunder"),
    "betting": ("bet", "bets", "betting", "bookmaker", "bookmakers", "sportsbook", "wager", "wagers"),
    "casino": ("blackjack", "casino", "casinos", "jackpot", "jackpots", "poker", "roulette", "slots"),
    "pills": ("cialis", "pill", "pills", "viagra", "xanax"),
    "adult": ("adult", "adults", "camgirls", "escorts", "milf", "nude", "nudes", "porn", "porno", "sex", "xxx"),
    "link farms": ("backlinks", "linkfarm", "linkfarms", "linkspam", "spam", "spammer"),
}


def url_parts(url: str = "url"):
    """Columns (host, path). Host: after the first :// up to / ? # or the end, A-Z lowered; path: from
    there up to ? or #. Both are empty without ://."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def listed_hosts(pages: DataFrame) -> DataFrame:
    """(prefix, verdict, is_rule): entries that block the hosts of `pages` (url) named by a word of CATEGORIES.

    An entry begins at the rightmost label with such a word, so it holds for all subdomains of that name.
    """
    host, _ = url_parts()
    words = "|".join(sorted({w for of in CATEGORIES.values() for w in of}))
    labels = F.split(host, r"\.")
    named = F.filter(F.transform(labels, lambda x, i: F.when(x.rlike(f"(^|[^a-z])({words})([^a-z]|$)"), i + 1)), lambda i: i.isNotNull())
    hosts = pages.select(labels.alias("labels"), F.array_max(named).alias("at")).where("at IS NOT NULL")
    hosts = hosts.select(F.array_join(F.expr("slice(labels, at, size(labels))"), ".").alias("host")).distinct()
    return hosts.select(F.concat("host", F.lit("/")).alias("prefix"), F.lit("block").alias("verdict"), F.lit(False).alias("is_rule"))


def write_list(entries: list[tuple[str, str, bool]], folder: Path) -> list[Path]:
    """Files of the list's entries (prefix, verdict, is a rule), sorted by digest. Equal entries count once:
    a rule before others, then the first verdict by name."""
    kept: dict[str, tuple[str, bool]] = {}
    for prefix, verdict, rule in sorted(entries, key=lambda e: (e[0], not e[2], e[1])):
        kept.setdefault(prefix, (verdict, rule))
    rows = sorted((xxhash.xxh64_intdigest(p.encode()), p.encode(), VERDICTS.index(v), rule) for p, (v, rule) in kept.items())
    text = b"".join(r[1] for r in rows)
    shapes = sorted({(r[1].partition(b"/")[0].count(b".") + 1, len(r[1].decode().partition("/")[2]) + 1) for r in rows})
    name, out = uuid.uuid4().hex, []
    for kind, a in {
        "keys": np.array([r[0] for r in rows], np.uint64),
        "ends": np.cumsum([0, *(len(r[1]) for r in rows)]).astype(np.int64),
        "text": np.frombuffer(text, np.uint8),
        "says": np.array([r[2] * 2 + r[3] for r in rows], np.uint8),
        "shapes": np.array(shapes, np.int64).reshape(-1, 2),
    }.items():
        out.append(folder / f"{name}.{kind}.npy")
        np.save(out[-1], a)
    return out


class DigestArray:
    def __init__(self, paths: list[str]):
        load = lambda p: np.load(p, mmap_mode="r")
        self.keys, self.ends, self.text, self.says, self.shapes = map(load, paths)

    def find(self, probes: list[str]) -> np.ndarray:
        """The entry equal to each probe, or -1. Entries with one digest stand side by side."""
        if not len(self.keys) or not probes:
            return np.full(len(probes), -1)
        raw = [p.encode() for p in probes]
        digest = np.fromiter((xxhash.xxh64_intdigest(p) for p in raw), np.uint64, len(raw))
        at = np.searchsorted(self.keys, digest)
        out = np.full(len(raw), -1)
        todo = np.arange(len(raw))
        while len(todo):
            todo = todo[at[todo] < len(self.keys)]
            todo = todo[self.keys[at[todo]] == digest[todo]]
            same = np.array([self.text[self.ends[a] : self.ends[a + 1]].tobytes() == raw[i] for i, a in zip(todo.tolist(), at[todo].tolist())], bool)
            out[todo[same]] = at[todo[same]]
            todo = todo[~same]
            at[todo] += 1
        return out


def _probes(hosts: list[str], paths: list[str], shapes: np.ndarray) -> tuple[list[int], list[str]]:
    row, probe = [], []
    for labels, length in shapes.tolist():
        for i, (h, p) in enumerate(zip(hosts, paths)):
            path = p or "/"
            if len(path) >= length and h.count(".") + 1 >= labels:
                row.append(i)
                probe.append(".".join(h.rsplit(".", labels)[-labels:]) + path[:length])
    return row, probe


def filtered(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """`pages` (url and any other columns) with host, path, rule and verdict.

    entries: prefix (`host/path-prefix`, host lowered), verdict (allow or block), is_rule. An entry fits its
    host and all subdomains if the path starts with the entry's; an empty path starts with no rule's, but counts as /
    for other entries. The longest rule that fits decides and is named in `rule`; else the longest other entry that fits; else the url is allowed. A null url
    or one without :// has an empty host and path and fits nothing. Entries with a null column or without a / are
    left out. Columns of pages with these four names are replaced; all others pass unchanged.
    """
    spark = pages.sparkSession
    host, path = url_parts()
    pages = pages.drop("host", "path", "rule", "verdict", "_best").withColumns({"host": host, "path": path})
    known = entries.where(F.col("prefix").contains("/") & F.col("verdict").isin(*VERDICTS) & F.col("is_rule").isNotNull()).select("prefix", "verdict", "is_rule")
    # in Python an entry takes some 200 bytes besides its string: a part's size bounds the driver's memory
    parts = 1 + (known.agg(F.sum(F.octet_length("prefix") + ENTRY_BYTES)).first()[0] or 0) // LIST_BYTES
    known = written(known.withColumn("part", F.pmod(F.xxhash64("prefix"), F.lit(parts)))) if parts > 1 else known.withColumn("part", F.lit(0))
    out = pages.withColumn("_best", F.lit(None).cast("struct<by_rule: boolean, size: int, prefix: string, verdict: string>"))
    for part in range(parts):
        chosen = known.where(F.col("part") == part).drop("part")
        folder = tempfile.TemporaryDirectory(prefix="spark-list-")
        files = write_list([tuple(r) for r in chosen.collect()], Path(folder.name))
        for f in files:
            spark.sparkContext.addFile(str(f))
        names = [f.name for f in files]
        _handed_out.append(folder)  # removed when the driver ends: executors fetch the files when their tasks start

        def make(names=names):
            listed = DigestArray([SparkFiles.get(n) for n in names])

            def judge(hosts, paths):
                best: list = [None] * len(hosts)
                row, probe = _probes(hosts, paths, listed.shapes)
                for i, p, a in zip(row, probe, listed.find(probe).tolist()):
                    # an empty path doesn't start with a rule's /, but a listed host is listed without a path too
                    if a >= 0 and (paths[i] or not listed.says[a] & 1):
                        code = int(listed.says[a])
                        if best[i] is None or (bool(code & 1), len(p)) > (best[i]["by_rule"], best[i]["size"]):
                            best[i] = {"by_rule": bool(code & 1), "size": len(p), "prefix": p, "verdict": VERDICTS[code >> 1]}
                return (best,)

            return judge

        out = added(out, ["host", "path"], "_new struct<by_rule: boolean, size: int, prefix: string, verdict: string>", make)
        out = out.withColumn("_best", F.greatest("_best", "_new")).drop("_new")
        if parts > 1:
            out = written(out)
    rule = F.when(F.col("_best.by_rule"), F.col("_best.prefix"))
    return out.withColumns({"rule": rule, "verdict": F.coalesce("_best.verdict", F.lit("allow"))}).drop("_best")
