import base64
import gzip
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest

from vistaframe.llm import url_filter, warc
from vistaframe.llm.html_extract import main_texts
from vistaframe.llm.url_filter import RULES, DigestArray, filtered, write_list
from vistaframe.llm.warc import normalise, read_archives, read_indexed, record, write_archives, write_monolithic


def expected(url, entries):
    m = re.match(r".*?://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for prefix, verdict, rule in entries:
        h, _, p = prefix.partition("/")
        if (host == h or host.endswith("." + h)) and (path if rule else path or "/").startswith("/" + p):
            best = max(best or (False, 0, "", ""), (rule, len(prefix), prefix, verdict))
    return host, path, best[2] if best and best[0] else None, best[3] if best else "allow"


URLS = ["http://example.org/es/1", "https://WWW.Example.ORG/en/12?x#y", "http://a.example.org/en/2", "x://b.org", "http://b.org?q", "http://notorg/", "http://m.com/fr/", "http://com/de/1", "http://com/d", "no scheme", "", None, "a://b://c", "http://", "http://spam.net/x", "http://www.spam.net", "http://spam.net.org/", "https://é.org/ü#1", "http://x.com/fr", "http://spam.net/ok/1"]


@pytest.mark.parametrize("most", [1 << 20, 600])
def test_urls_match_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "LIST_BYTES", most)
    entries = [(p, v, True) for p, v in RULES] + [("spam.net/", "block", False), ("spam.net/ok/", "allow", False), ("spam.net/ok/", "allow", False), ("é.org/ü", "block", False)]
    table = spark.createDataFrame([*entries, (None, "block", True), ("x/", None, True), ("y", "block", True)], "prefix string, verdict string, is_rule boolean")
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filtered(pages, table).collect()}
    assert got == {i: expected(u, entries) for i, u in enumerate(URLS)}


def test_url_tables_may_be_empty(spark):
    none = spark.createDataFrame([], "prefix string, verdict string, is_rule boolean")
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert [tuple(r) for r in filtered(pages, none).collect()] == [(1, "http://a.b/c", "a.b", "/c", None, "allow")]
    assert filtered(pages.limit(0), none).collect() == []


def test_collisions_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: 5)
    a = DigestArray(write_list([("a/", "block", False), ("b/", "block", False), ("c/", "allow", True)], tmp_path))
    found = a.find(["c/", "x/", "a/", "b/"])
    assert found[1] == -1 and len({*found}) == 4 and isinstance(a.keys, np.memmap)


def pages_rows():
    r = random.Random(2)
    same = "<p>é</p>" * 9
    rows = [(i, f"http://h/{i}\r\nX: y", r.choice([same, "a", "", None, f"{i}\r\n\r\n" + "x" * r.randrange(3000)])) for i in range(80)]
    return rows + [(None, None, same), (None, "u", "alone"), (300, "u", same), (300, "u", same)]


def test_archives_round_trip(spark):
    rows = pages_rows()
    pages = spark.createDataFrame([(*x, "k") for x in rows], "page_id long, url string, html string, sha string").repartition(4)
    got = sorted((tuple(x) for x in read_archives(write_archives(pages)).collect()), key=str)
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        of = last.get(h or "")
        same = i == of or of is None
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if same else "revisit", None if same else of))
    assert got == sorted(want, key=str)
    assert read_archives(write_archives(pages.limit(0))).collect() == []


def test_each_record_is_a_member(tmp_path):
    rows = [(i, "http://x/", bytes(range(256)) * i, None) for i in range(40)]
    whole, split = f"file://{tmp_path}/w.warc.gz", f"file://{tmp_path}/r.warc.gz"
    assert write_monolithic(iter(rows), whole) == normalise(whole, split) == 40
    text = gzip.decompress((tmp_path / "w.warc.gz").read_bytes())
    assert gzip.decompress((tmp_path / "r.warc.gz").read_bytes()) == text == b"".join(record(*x, k) for k, x in enumerate(rows, 1))
    z = zlib.decompressobj(31)
    z.decompress((tmp_path / "w.warc.gz").read_bytes())
    assert z.eof and not z.unused_data
    assert [x["payload_bytes"] for x in read_indexed(split)] == [256 * i for i in range(40)]
    # an archive of several members is normalised too
    (tmp_path / "m.warc.gz").write_bytes(gzip.compress(text[:1000]) + gzip.compress(text[1000:]))
    assert normalise(f"file://{tmp_path}/m.warc.gz", split) == 40
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(text[:-7]))
    with pytest.raises(ValueError):
        normalise(f"file://{tmp_path}/c.warc.gz", split)
    assert io.BytesIO(text).read(5) == b"WARC/"
    assert not [p for p in tmp_path.iterdir() if p.name.endswith(".part")]


ARTICLE = "<h1>A &amp; B&nbsp;C &lt;</h1><p><b>One\n two<br>three<p>Fo<i>ur</i> &eacute;&am</p><div>Five <a href='x'>six</a></div>"
TEXT = "A & B C < One two three Four é&am Five six"
LAYOUTS = [
    "<html><head><title>T</title><style>p</style></head><body><nav><a>Menu</a></nav><!-- x <p>no</p> --><div class=\"ad\">Buy this long advert text now, it is very good</div><article>{}</article><footer>&copy; F</footer></body></html>",
    "<body><header><h2>Site</h2></header><div id=main><div class='post-body'>{}</div><section class='comments'><p>Reader says a very long thing, over and over, much longer than the text of the article, really</p></section></div><aside>Side</aside><script>var a='</p><p>x';</script></body>",
    "<div class='wrap'><div class='cookie-notice'>We use cookies on this site and more of them</div><form><label>Mail</label><input></form><div class='c1'>{}</div><div class='sidebar'>Also</div></div>",
    "<article>{}</article><footer>cut",
]


@pytest.mark.parametrize("k", range(len(LAYOUTS)))
def test_articles_are_found(spark, k):
    pages = spark.createDataFrame([(i, f"http://h{k}.x/{i}", LAYOUTS[k].replace("{}", ARTICLE + f"<p>Nr {i}</p>" * (i + 1)), "t") for i in range(6)], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in main_texts(pages).collect()}
    assert got == {i: TEXT + f" Nr {i}" * (i + 1) for i in range(6)}


def test_odd_pages(spark):
    odd = [None, "", "plain text", "<", "<p", "a < b > c", "<!-- never closed <p>x", "<script>x", "<p class=\"open>text</p>", "<div>" * 3000 + "deep" + "</div>" * 3000, "</p></div>x", "<p>" + "long " * 40000]
    pages = spark.createDataFrame([(i, None if i % 2 else "u", h) for i, h in enumerate(odd)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_texts(pages).collect()}
    assert len(got) == len(odd) and got[0] == got[1] == got[6] == got[7] == "" and got[2] == "plain text" and got[9] == "deep" and got[10] == "x" and len(got[11]) == 199999
    assert main_texts(pages.limit(0)).collect() == []
