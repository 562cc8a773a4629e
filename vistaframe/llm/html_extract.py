"""HTML extraction by consensus host paths.

Each page's containers are scored by the text they hold. A page votes for the generalised tag-class path of its best
container; the votes of a host, and how often the same text recurs under a path of the host, are counted in Spark.
The text is then taken from each page again, from the container on the host path that scores best there.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaframe.llm.common import U, WordHash, added, listed, mix, written
from vistaframe.llm.shingle_join import rolled
from vistaframe.llm.url_filter import url_parts

#: Share of its host's votes (or pages) that a path needs to count for the host; so a host has at most 1 / SHARE
#: winning paths.
SHARE = 0.01
#: A container's text recurs if the rest of the page differs on at least this share of the pages that have the text;
#: its path recurs if this share of the texts on it do. Near copies of a page agree in the rest, so theirs don't.
RECURRING = 0.5
#: Least hashes of runs of words by which articles are told apart: near copies agree in most of them.
SIGNS = 4
#: What a container counts of its inner containers' scores.
INNER = 0.7
#: A container within another that has more than this share of its text is the better of the two.
HALF = 0.5
#: The share of its host's votes that a page gives the path of its own best container at least.
OWN = 0.001
#: What text counts in a container that is named like a page's furniture, or whose text recurs; such a container
#: within an article goes if it then scores less than LEAST of the rest.
LOWERED, LEAST = 0.1, 0.25
#: The share of links from which a container with an uncertain name is furniture.
LINKS = 0.3
VOTE = 1000

TAG = re.compile(r"<(?:!--(.*?)(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[!?/][^>]*>?)", re.S)
#: Attributes whose quoted values all begin after = and end before white space, a slash, the end or another attribute.
CLOSED = re.compile(r"(?:=\s*(?:\"[^\"]*\"|'[^']*')(?=[\s/]|\Z|[a-zA-Z][\w:.-]*\s*=)|[^\"'>])*+", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d+")

# fixed values of HTML and of common page layouts
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "canvas", "object", "select", "button", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
PARAGRAPH = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "figure", "figcaption", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "address", "details", "summary", "hr", "br"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "aside", "nav", "header", "footer", "form", "body", "html"}
# tags that HTML itself defines as not being the article
DROPPED_TAGS = {"head", "nav", "footer", "aside", "dialog", "menu"}
# names that tell of furniture only where it also looks so: mostly links, or recurring text
UNCERTAIN = {"disclaimer", "discussion", "header", "notice", "notices", "notification", "promo", "promotion", "recommended", "related", "replies", "respond", "search", "share", "sharing", "widget", "widgets"}
AUTHOR, TIME, REPLY = {"author", "avatar", "commenter", "nick", "nickname", "poster", "user", "username"}, {"date", "datetime", "posted", "published", "time", "timestamp"}, {"answer", "reply", "respond"}
FURNITURE = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disclaimer", "disqus", "discussion", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "outbrain", "overlay", "pagination", "pager", "popup", "promo", "promoted", "promotion", "recommended", "related", "replies", "respond", "search", "share", "sharing", "shoutbox", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "taboola", "toolbar", "topbar", "widget", "widgets"}
NEUTRAL = {"area", "bar", "block", "bottom", "box", "container", "inner", "left", "list", "outer", "page", "post", "right", "section", "site", "top", "wrap", "wrapper"}
ARTICLE_WORDS = {"article", "content", "entry", "main", "post", "story"}


class Page:
    """Elements in page order, each with its parent, its span of pieces of text and its path."""

    def __init__(self, source: str, paths: dict):
        self.parent, self.path, self.tag, self.dropped, self.good, self.low, self.holder, self.start, self.stop = [-1], [0], [""], [False], [False], [False], [0], [0], [0]
        self.uncertain, self.link, self.marks = [False], [False], [0]
        self._opened: Counter = Counter()
        self.text: list[str] = []
        self.owner: list[int] = []
        self._paths = paths
        self._stack = [0]
        at, n = 0, len(source)
        while at < n:
            m = TAG.search(source, at)
            if not m:
                break
            if m.start() > at:
                self._say(source[at : m.start()])
            at = m.end()
            tag = m[3] or m[6]
            if not tag:
                continue
            tag = tag.lower()
            closing, attributes = (m[2], m[4]) if m[3] else (m[5], m[7])
            if ">" in attributes and not CLOSED.fullmatch(attributes):  # a quote left open: the tag ends at the first >, as with m[6]
                short = LOOSE.match(source, m.start())
                at, attributes = short.end(), short[3]
            if closing:
                self._close(tag)
            elif tag in RAW:
                end = re.compile(f"</{re.escape(tag)}\\b[^>]*>?", re.I).search(source, at)
                at = end.end() if end else n
            else:
                self._open(tag, attributes)
        if at < n:
            self._say(source[at:])
        while len(self._stack) > 1:
            self._pop()
        self.stop[0] = len(self.text)

    def _say(self, text: str):
        self.text.append(html.unescape(text) if "&" in text else text)
        self.owner.append(self._stack[-1])

    def _pop(self):
        e = self._stack.pop()
        self.stop[e] = len(self.text)
        self._opened[self.tag[e]] -= 1
        self.marks[self.parent[e]] |= self.marks[e]

    def _break(self):
        self.text.append(" ")
        self.owner.append(self._stack[-1])

    def _close(self, tag: str):
        if tag not in INLINE:
            self._break()
        if not self._opened[tag]:
            return
        for k in range(len(self._stack) - 1, 0, -1):
            if self.tag[self._stack[k]] == tag:
                del_to = k
                break
            if tag in INLINE and self.tag[self._stack[k]] not in INLINE:
                return
        else:
            return
        while len(self._stack) > del_to:
            self._pop()

    def _open(self, tag: str, attributes: str):
        if tag not in INLINE:
            self._break()
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self._end({"p"})
        elif tag in SIBLINGS:
            self._end(SIBLINGS[tag])
        up = self._stack[-1]
        key = (self.path[up], tag, attributes)
        known = self._paths.get(key)
        if known is None:
            known = _described(*key)
            if len(self._paths) > 20_000:
                self._paths.clear()
            if len(attributes) < 500:
                self._paths[key] = known
        path, article, furniture, uncertain, comments, marks = known
        good = tag in ("article", "main") or article
        inside = self.good[up]
        self._stack.append(len(self.path))
        self.parent.append(up)
        self.path.append(path)
        self.tag.append(tag)
        self.dropped.append(self.dropped[up] or tag in DROPPED_TAGS or tag == "header" and not inside or comments and tag not in ("html", "body", "main"))
        self.good.append(inside or good and tag not in ("html", "body"))
        container = tag not in INLINE and tag not in PARAGRAPH
        self.low.append(tag == "form" or furniture and container and tag not in ("html", "body"))
        self.uncertain.append(uncertain and container and tag not in ("html", "body"))
        self.link.append(self.link[up] or tag == "a")
        self.marks.append(marks)
        self._opened[tag] += 1
        self.holder.append(len(self.holder) if container else self.holder[up])
        self.start.append(len(self.text))
        self.stop.append(0)

    def _end(self, tags: set):
        """Ends the nearest open element of these, with all inside it."""
        for k in range(len(self._stack) - 1, 0, -1):
            t = self.tag[self._stack[k]]
            if t in tags:
                while len(self._stack) > k:
                    self._pop()
                return
            if t in BOUNDS:
                return

    def scored(self, recurring: frozenset = frozenset()) -> list[tuple[float, float, int]]:
        """(score, score without inner containers, element) of the containers with any, best first.

        A score is the text held directly or in paragraphs, less what links hold, and INNER of the inner containers'
        scores. Text in furniture, or held on one of the recurring paths, counts LOWERED.
        """
        n = len(self.path)
        link, low, holder = self.link, [False] * n, self.holder
        for e in range(1, n):
            low[e] = low[self.parent[e]] or self.low[e]
        score, links = [0.0] * n, [0.0] * n
        for text, e in zip(self.text, self.owner):
            if not self.dropped[e]:
                size = len(text.strip()) * (LOWERED if low[e] or self.path[holder[e]] in recurring else 1)
                score[holder[e]] += size
                if link[e]:
                    links[holder[e]] += size
        out = []
        direct = [max(0.0, s - 2 * x) for s, x in zip(score, links)]
        for e in range(n - 1, 0, -1):
            if holder[e] == e and not self.dropped[e]:
                own = max(0.0, score[e] - 2 * links[e])
                if own > 0 or self.tag[e] in ("article", "main"):
                    favour = 3 if self.tag[e] in ("article", "main") or self.good[e] and not self.good[self.parent[e]] else 1
                    out.append(((own + 1) * favour, (direct[e] + 1) * favour, e))
                up = holder[self.parent[e]]
                score[up] += INNER * score[e]
                links[up] += INNER * links[e]
        return sorted(out, key=lambda x: (-x[0], x[2]))

    def top(self, scored: list[tuple[float, float, int]]) -> int:
        """The best container, or one within it that has more than half of its score before discounts."""
        if not scored:
            return 0
        most, _, at = scored[0]
        for whole, _, e in scored[1:]:
            if e > at and self.start[e] < self.stop[at] and whole * INNER > HALF * most:
                most, at = whole, e
        return at

    def on(self, path: int) -> list[int]:
        """The containers on a path, outermost ones."""
        return [e for e in range(1, len(self.path)) if self.path[e] == path and not self.dropped[e] and self.tag[e] not in INLINE]

    def own_texts(self) -> dict[int, str]:
        """The text of each container, without that of its inner containers."""
        parts: dict[int, list[str]] = {}
        for text, e in zip(self.text, self.owner):
            if not self.dropped[e]:
                parts.setdefault(self.holder[e], []).append(text)
        return {e: t for e, x in parts.items() if (t := " ".join("".join(x).split()))}

    def threads(self) -> set[int]:
        """Reader comments by their structure: at least two neighbours on one path, each with an author and a time or a way
        to reply."""
        seen: dict[tuple[int, int], list[int]] = {}
        for e in range(1, len(self.path)):
            if self.holder[e] == e or self.tag[e] in ("li", "dd"):
                if self.marks[e] & 1 and self.marks[e] & 6:
                    seen.setdefault((self.parent[e], self.path[e]), []).append(e)
        return {e for of in seen.values() if len(of) > 1 for e in of}

    def words(self, elements: list[int], recurring: frozenset = frozenset()) -> str:
        """The text of these elements, in page order, without dropped parts, without threads of comments beside other text,
        and without furniture that scores little beside the rest."""
        done, pieces, threads = 0, [], self.threads()
        group = [-1] * len(self.path)  # the outermost furniture within the chosen elements, or a recurring container
        for e in sorted(elements):
            for i in range(e + 1, len(self.path)):
                if self.start[i] >= self.stop[e] and self.parent[i] < e:
                    break
                up = self.parent[i]
                inside = group[up] if up > e else -1
                if inside >= 0 and (self.low[inside] or self.uncertain[inside] or inside in threads or self.holder[i] != i):
                    group[i] = inside
                elif self.low[i] or self.uncertain[i] or i in threads or self.holder[i] == i and self.path[i] in recurring:
                    group[i] = i
            pieces += [*range(max(done, self.start[e]), self.stop[e]), -1]
            done = max(done, self.stop[e])
        size, links = Counter(), Counter()
        for i in pieces:
            if i >= 0 and not self.dropped[e := self.owner[i]]:
                n = len(self.text[i].strip())
                size[group[e]] += n
                links[group[e]] += n * self.link[e]
        rest = size[-1]

        def goes(g: int, n: int) -> bool:
            if g < 0:
                return False
            if g in threads:
                return rest > 0
            sure = self.low[g] or self.path[g] in recurring or links[g] >= LINKS * n
            return sure and LOWERED * n < LEAST * rest

        gone = {g for g, n in size.items() if goes(g, n)}
        keep = [" " if i < 0 else self.text[i] for i in pieces if i < 0 or not self.dropped[self.owner[i]] and group[self.owner[i]] not in gone]
        return " ".join("".join(keep).split())


def _described(above: int, tag: str, attributes: str) -> tuple:
    """The element's path (a digest of the one above and of its own tag and classes, with digits generalised); whether its
    class, id or role names an article, furniture, furniture perhaps, comments; and what marks of a comment it has. A
    name counts as furniture if it is made up of words of FURNITURE and NEUTRAL only, with one of FURNITURE."""
    named = {k.lower(): a or b or c for k, a, b, c in NAMED.findall(attributes)} if "=" in attributes else {}
    names = [{w.lower() for w in WORD.findall(x)} for v in named.values() for x in v.split()]
    article = any(n & ARTICLE_WORDS for n in names)
    comments = any(n & {"comment", "comments"} and n <= FURNITURE | NEUTRAL for n in names)
    told = [n for n in names if n & FURNITURE and n <= FURNITURE | NEUTRAL] if not article else []
    furniture = any(n & FURNITURE - UNCERTAIN for n in told)
    every = set().union(*names)
    marks = bool(every & AUTHOR) + 2 * (tag == "time" or bool(every & TIME)) + 4 * bool(every & REPLY)
    classes = ".".join(sorted(DIGITS.sub("#", named.get("class", "")).split()))
    path = above if tag in INLINE else digest(f"{above}/{tag}{'.' + classes if classes else ''}")
    return path, article and not comments, furniture, bool(told) and not furniture, comments, marks


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def signs(texts: dict[int, str], hashes: WordHash) -> dict[int, list[int]]:
    """For each container, SIGNS least hashes of the runs of three words of all others, -1 where there are none."""
    least = []
    for t in texts.values():
        w = t.lower().encode("utf-8", "surrogatepass").split()
        h = rolled(w, min(3, len(w)), hashes)
        least.append([int(mix(h ^ U(k * 0x9E3779B97F4A7C15 % (1 << 64))).min() >> U(1)) for k in range(SIGNS)])
    low = [[*sorted(x)[:2], -1] for x in zip(*least)]
    return {e: [lo[1] if x == lo[0] else lo[0] for x, lo in zip(own, low)] for e, own in zip(texts, least)}


def _seen(pages: DataFrame) -> DataFrame:
    """(host, path, text, k, sign, vote): SIGNS rows for each container of each page; path and text are digests, sign tells
    the rest of the page apart. A page has VOTE votes, all for the path of its best container."""

    def make():
        paths: dict = {}
        hashes = WordHash()

        def look(sources):
            out = []
            for source in sources:
                page = Page(source, paths)
                top = page.top(page.scored())
                texts = page.own_texts()
                rest = signs({e: t for e, t in texts.items() if e}, hashes)
                rows = [{"path": page.path[e], "text": digest(t), "k": k, "sign": x, "vote": 0} for e, t in texts.items() if e for k, x in enumerate(rest[e])]
                rows.append({"path": page.path[top], "text": None, "k": 0, "sign": 0, "vote": VOTE})
                out.append(rows)
            return (out,)

        return look

    looked = added(pages.select("html", "host"), ["html"], "seen array<struct<path: bigint, text: bigint, k: int, sign: bigint, vote: bigint>>", make)
    return looked.select("host", F.inline("seen"))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, ways, recurring) of pages (host, html): each host's winning paths with their share of its votes, and
    the paths whose texts recur on pages whose articles differ. A host has a bounded number of either; paths are digests."""
    # texts first: a host's rows are spread over its texts before they meet
    one = _seen(pages).groupBy("host", "path", "text", "k", "sign").agg(F.sum("vote").alias("vote"), F.count("text").alias("n"))
    one = one.groupBy("host", "path", "text").agg(F.sum("vote").alias("vote"), (F.sum("n") / SIGNS).alias("n"), (F.count("*") / SIGNS).alias("apart"))
    again = (F.col("n") > 1) & (F.col("apart") - 1 >= RECURRING * (F.col("n") - 1))
    two = one.groupBy("host", "path").agg(F.sum("vote").alias("vote"), F.sum("n").alias("n"), F.sum(F.when(again, F.col("n")).otherwise(0)).alias("again"))
    two = written(two)
    total = two.groupBy("host").agg(F.sum("vote").alias("votes"))
    x = two.join(total, "host")
    wins = (F.col("vote") > 0) & (F.col("vote") >= SHARE * F.col("votes"))
    recurs = (F.col("again") > 0) & (F.col("n") * VOTE >= SHARE * F.col("votes")) & (F.col("again") >= RECURRING * F.col("n"))
    # votes for what recurs are votes for furniture
    share = F.col("vote") / F.col("votes") * F.greatest(F.lit(1e-6), 1 - F.col("again") / F.greatest("n", F.lit(1)))
    x = x.where(wins | recurs).groupBy("host").agg(
        F.array_sort(F.collect_list(F.when(wins, F.struct("path", share.alias("share"))))).alias("ways"),
        F.array_sort(F.collect_list(F.when(recurs, F.col("path")))).alias("recurring"),
    )
    return written(x)


def main_texts(pages: DataFrame) -> DataFrame:
    """`pages` (url, html and any other columns) with text: the article of the page.

    Left out: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup and reader
    comments: by their tags, by lying outside the container on the host's winning path, or, within it, by names
    or recurring text that lower their score. Character references are decoded; runs of white space and block borders
    become one space. A null or empty html has an empty text; pages with a null url share a host. Unclosed tags and
    comments end with the page. A column of pages named text is replaced; all others pass unchanged.
    """
    host, _ = url_parts()
    pages = pages.drop("text").withColumns({"_host": host, "_html": F.coalesce("html", F.lit(""))})
    found = host_paths(pages.select(F.col("_host").alias("host"), F.col("_html").alias("html")))
    joined = pages.join(listed(found.withColumnsRenamed({"host": "_host", "ways": "_ways", "recurring": "_recurring"})), "_host", "left")

    def make():
        paths: dict = {}

        def extract(sources, ways, recurring):
            texts = []
            for source, way, again in zip(sources, ways, recurring):
                page = Page(source, paths)
                share = {w["path"]: w["share"] for w in way or ()}
                lowered = frozenset(again or ())
                best = page.scored(lowered)
                own = page.top(best)
                above = set()  # what lies around the page's own best container counts without it
                e = own
                while e > 0:
                    e = page.parent[e]
                    above.add(e)
                by_path: dict = {}
                for whole, direct, e in best:
                    by_path[page.path[e]] = by_path.get(page.path[e], 0.0) + (direct if e in above else whole)
                said = lambda p: max(share.get(p, 0.0), OWN if p == page.path[own] else 0.0)
                chosen = max(by_path, key=lambda p: (by_path[p] * said(p), p), default=0)
                texts.append(page.words(page.on(chosen) if chosen else [0], lowered - {chosen}))
            return (texts,)

        return extract

    out = added(joined, ["_html", "_ways", "_recurring"], "text string", make, drop=("_html", "_ways", "_recurring", "_host", "html"))
    return out.select(*[c for c in pages.columns if c in out.columns], "text")
