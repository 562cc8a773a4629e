"""Parts of pages that belong to the article, and parts that don't, whatever their size and number."""

import random
import tracemalloc

import pytest
from test_host_consensus import extracted

from vistaframe.llm.html_extract import Page


def near_copies(n):
    r = random.Random(n)
    body = [f"word{r.randrange(10**6)}" for _ in range(120)]
    rows, want = [], {}
    for i in range(n):
        w = list(body)
        w[i % 50] = f"own{i}"
        rows.append((i, f"http://copies.x/{i}", f"<div class=page><h1>One title</h1><p>{' '.join(w)}</p><section><p>{' '.join(body[60:])}</p></section></div>"))
        want[i] = f"One title {' '.join(w)} {' '.join(body[60:])}"
    return rows, want


@pytest.mark.parametrize("n", [2, 9, 12, 60])
def test_near_copies_of_a_page_keep_their_sections(spark, n):
    rows, want = near_copies(n)
    assert extracted(spark, rows) == want


@pytest.mark.parametrize("n", [2, 9, 12, 60])
def test_what_recurs_beside_different_articles_goes(spark, n):
    r = random.Random(n)
    rows, want = [], {}
    for i in range(n):
        body = " ".join(f"word{r.randrange(10**6)}" for _ in range(60))
        rows.append((i, f"http://h.x/{i}", f"<div class=page><h1>Title {i}</h1><p>{body}</p><section class=x9><p>Get our letter every week, it is free and good</p></section></div>"))
        want[i] = f"Title {i} {body}"
    assert extracted(spark, rows) == want


THREADS = [
    "<div class='comments'>{}</div>",
    "<ol>{}</ol>",
    "<div class=k>{}</div>",
]
COMMENT = [
    "<div class='comment'><p>{}</p></div>",
    "<li><cite class=author>Ann</cite> <time>3 May</time><p>{}</p></li>",
    "<div class=c7><span class=username>ann</span><a class=reply href=#>reply</a><p>{}</p></div>",
]


@pytest.mark.parametrize("kind", range(3))
def test_comments_go_even_if_they_outweigh_the_article(spark, kind):
    r = random.Random(kind)
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    rows, want = [], {}
    for i in range(12):
        title, body = words(3), words(14)
        thread = THREADS[kind].replace("{}", "".join(COMMENT[kind].replace("{}", words(60)) for _ in range(5)))
        rows.append((i, f"http://c{kind}.x/{i}", f"<body><div class='post'><h2>{title}</h2><p>{body}</p>{thread}</div></body>"))
        want[i] = f"{title} {body}"
    assert extracted(spark, rows) == want


@pytest.mark.parametrize("name", ["search", "notice", "share", "related", "discussion", "promotion", "disclaimer", "header", "widget"])
def test_a_section_named_by_its_subject_stays(spark, name):
    html = f"<body><nav>Menu</nav><article><h1>On it</h1><p>A short text.</p><section class='{name}'><p>This section is about its subject and longer than the rest of the article.</p></section></article></body>"
    listed = f"<body><article><h1>On it</h1><p>A text that is much longer than the list of links below it.</p><div class='{name}'><a href=a>One more</a> <a href=b>Another</a></div></article></body>"
    got = extracted(spark, [(1, "http://one.x/1", html), (2, "http://two.x/2", listed)])
    assert got == {1: "On it A short text. This section is about its subject and longer than the rest of the article.", 2: "On it A text that is much longer than the list of links below it."}


def test_deep_pages_take_memory_in_proportion():
    peaks = []
    for n in (10_000, 40_000):
        source = "<div class=a>" * n + "text" + "</div>" * n + "</p>" * n
        tracemalloc.start()
        page = Page(source, {})
        assert page.words([0]) == "text"
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 5 * peaks[0] and peaks[1] < 200e6
