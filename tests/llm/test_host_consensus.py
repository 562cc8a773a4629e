import random

import pytest

from vistaframe.llm.html_extract import main_texts


def extracted(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in main_texts(pages).collect()}


@pytest.mark.parametrize("part", ["<section class='related-work'><p>{}</p></section>", "<div class='share-price'>{}</div>", "<blockquote class='notice'>{}</blockquote>", "<math><mi>{}</mi></math>", "<p data-x=\"" + "y" * 380 + " a > b tail\">{}</p>"])
def test_names_alone_take_nothing_from_an_article(spark, part):
    html = f"<nav>Menu</nav><article><h1>Title</h1><p>Some words of an article</p>{part.replace('{}', 'kept words')}</article>"
    assert extracted(spark, [(1, "http://h/1", html)]) == {1: "Title Some words of an article kept words"}


SHELLS = {
    "a.x": "<nav>{m}</nav><div class=ad>{m}</div><article>{t}</article><footer>{m}</footer>",
    "b.x": "<div class='top-bar'>{m}</div><div id=w{i} class='col{i} text'>{t}</div><div class=right><p>{m}</p><p>{c}</p></div>",
    "c.x": "<form><div class=k>{t}<div class='comments'><p>{c}</p></div><div class='x1'>Get our letter each week</div></div><input></form><div class=z>{m} {m}</div>",
    "d.x": "<main><section class=one>{t}</section><section class=one>{u}</section></main><table><tr><td>{m}</td></tr></table>",
}


def written_pages(seed, hosts, n):
    """Pages by known shells, with the articles put into them."""
    r = random.Random(seed)
    words = lambda k: " ".join(r.choice(["ber", "tal", "Wald", "süd", "see", "ost"]) + str(r.randrange(99)) for _ in range(k))
    rows, want = [], {}
    for i in range(n):
        shell = r.choice(hosts)
        title, body, more = words(3), [words(r.randrange(5, 40)) for _ in range(r.randrange(1, 6))], words(20)
        t = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in body)
        rows.append((i, f"http://{shell if len(hosts) < 4 else 'all.x'}/{i}", SHELLS[shell].format(t=t, u=f"<p>{more}</p>", m=f"Menu {i % 3}", c=words(12), i=i)))
        want[i] = " ".join([title, *body] + ([more] if shell == "d.x" else []))
    return rows, want


@pytest.mark.parametrize("hosts", [["a.x"], ["b.x"], ["c.x"], ["d.x"], [*SHELLS]])
def test_pages_of_known_shells_give_back_their_articles(spark, hosts):
    rows, want = written_pages(len(hosts[0]) + len(hosts), hosts, 60)
    got = extracted(spark, rows)
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_a_host_may_have_many_layouts(spark):
    rows, want = [], {}
    r = random.Random(4)
    for i in range(120):
        body = " ".join(f"w{r.randrange(10**6)}" for _ in range(r.randrange(4, 60)))
        rows.append((i, f"http://h.x/{i}", f"<body>Site {i % 2}<div class='l{'abcdefghijklmno'[i % 15]}'><p>{body}</p></div><div class=s><p>{'Side ' * 30}</p></div></body>"))
        want[i] = body
    got = extracted(spark, rows)
    assert {i for i in want if got[i] != want[i]} == set()


def test_rows_may_repeat_and_names_may_clash(spark):
    rows = [(1, "http://h/1", "<article><p>one two</p></article>", "x", "y", [3])] * 3 + [(None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, text string, winners array<int>")
    out = main_texts(pages)
    assert out.columns == ["page_id", "url", "host", "winners", "text"]
    assert sorted((str(r.page_id), r.text) for r in out.collect()) == [("1", "one two")] * 3 + [("None", "")]
