"""Main text of hostile pages, of pages without an article, and of the given pages by a plain parser."""

import time
from html.parser import HTMLParser

import pytest

from tallyhouse.llm import html

LONG = "Some words here, and more of them. " * 6


def test_what_stands_beside_the_best_container():
    page = (
        f"<nav><a href=a>n</a></nav><div><h2>Head</h2><ul><li>one<li>two</ul><section><p>{LONG}</p></section>"
        "<blockquote>quote</blockquote><section><h3>Sub</h3><p>short</p></section>bare <b>text</b> here</div>"
        "<ul><li><a href=x>Home</a><li><a href=y>Shop</a></ul><div class='footer'><p>foot, er</p></div>"
    )
    assert html.main_text(page).split("\n") == ["Head", "one", "two", LONG.strip(), "quote", "Sub", "short", "bare text here"]


def test_words_inside_an_article():
    page = (
        f'<article><p>{LONG}</p><div class="footnote">note</div><div class="notice-board">board</div>'
        '<section id="search"><p>found</p></section><div id="related-work">others</div>'
        "<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> holds</p>"
        '<div class="cookie-notice">c</div><div class="related-posts">r</div><div class="comments">c</div></article>'
    )
    assert html.main_text(page).split("\n") == [LONG.strip(), "note", "board", "found", "others", "so x=2 holds"]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<svg/>text", "text"),
        ("<p>a</p><iframe src='x'/><p>b</p>", "a\nb"),
        ("<p>a</p><svg><text>no</text></svg><p>b</p>", "a\nb"),
        ("<p>a<svg>b", "ab"),
        ("<p>a<script>b", "a"),
        ("<p>a<!-- b", "a"),
        ("<p>1 < 2 & 3 > 2", "1 < 2 & 3 > 2"),
        ('<p title="a>b">c</p>', "c"),
        ('<p title="a>b</p>c', "b\nc"),
        ("<p>a<![CDATA[ x > y ]]>b", "ab"),
        ("a<", "a<"),
    ],
)
def test_markup(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("part", ["<a ", "<a '", "<b>", "<![CDATA[", "</x>", "<svg>", "</svg ", '<a b="', "<li><div><b>", "x<a b='>"])
def test_time_in_proportion(part):
    """Forty thousand parts took minutes where every one looked through the rest of the page."""
    begun = time.process_time()
    html.main_text(part * 40_000 + "t>")
    assert time.process_time() - begun < 10


class Plain(HTMLParser):
    """Blocks of the article by the library's own event parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.out = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag == "br":
            self.out[-1] += " "
        elif tag in html.BLOCK:
            self.out.append("")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in html.BLOCK:
            self.out.append("")

    def handle_data(self, data):
        self.out[-1] += data if self.inside else ""


def test_given_pages_by_a_plain_parser(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    assert rows
    for (page,) in rows:
        plain = Plain()
        plain.feed(page or "")
        plain.close()
        blocks = [" ".join(b.split()) for b in plain.out]
        assert html.main_text(page) == "\n".join([b for b in blocks if b])
