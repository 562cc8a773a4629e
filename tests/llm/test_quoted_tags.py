import time

import pytest

from vistaframe.llm.html_extract import Page


def texts(source):
    page = Page(source, {})
    return page.words([0]), page.path


@pytest.mark.parametrize("size", [5, 399, 401, 5000])
@pytest.mark.parametrize("quote", ["'", '"'])
def test_quoted_tags_are_read_whole_at_any_length(size, quote):
    q, long = quote, "x" * size
    assert texts(f"<p><a title={q}A > B{q} href={q}{long}{q}>link</a> on</p>")[0] == "link on"
    assert texts(f"<div data-json={q}<p>{long}</p>{q} class={q}post{q}>text</div>") == texts("<div class=post>text</div>") != texts("<div>text</div>")
    assert texts(f"<div data-json={q}<p>{long}</p>{q}class={q}comments{q}>no</div>yes")[0] == "yes"


@pytest.mark.parametrize("size", [5, 500])
def test_a_quote_left_open_ends_its_tag_at_the_first_bracket(size):
    long = "word " * size
    assert texts(f'<p class="open>{long}</p><b class="y">end</b>')[0] == f"{long}end"
    assert texts(f'<p class="open>{long}</p>end')[0] == f"{long}end"


def test_many_open_quotes_take_no_time():
    began = time.time()
    assert texts('<p class="open>a</p>' * 2001)[0] == " ".join("a" * 2001)
    assert time.time() - began < 20
