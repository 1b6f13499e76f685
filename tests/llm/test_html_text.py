"""Main text against the standard parser on the given pages, and by hand on pages of other makes."""

from html.parser import HTMLParser

import pytest

from corpuslens.llm.html_text import extract_pages, main_text


class Article(HTMLParser):
    """All text inside ``article``; block tags part words."""

    def __init__(self):
        super().__init__()
        self.inside, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.out.append(" " if tag in ("p", "h1", "br") else "")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.out.append(" " if tag in ("p", "h1") else "")

    def handle_data(self, data):
        if self.inside:
            self.out.append(data)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = extract_pages(pages).collect()
    assert len(got) == 250
    html = {r.page_id: r.html for r in pages.collect()}
    for row in got:
        parser = Article()
        parser.feed(html[row.page_id])
        parser.close()
        assert row.text == " ".join("".join(parser.out).split())
        assert row.n_chars == len(row.text)


LONG = "A sentence that is long enough to surge over any threshold of the page, twice. " * 3


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("  \n", ""), ("<p>", ""), ("just text &amp; more", "just text & more"), ("a < b &lt; c", "a < b < c"),
    ("<p>a<p>b<br>c<b>d</b>", "a b cd"), ("<p>x\n\t y&nbsp;z</p>", "x y z"), ("<p>&#65;&#x42;&eacute;&copy", "ABé©"),
    ("<!-- <p>no</p> --><p>yes<!-- no", "yes"), ("<p title='a>b'>x</p><p title=\"<p>\">y</p>", "x y"), ("<p title='open>x", "x"),
    ("<script>var a = '<p>no</p>';</script>yes<style>p{}</style>", "yes"), ("<SCRIPT>no</script >yes<script>no", "yes"),
    ("<title>no</title><textarea>no</textarea><p>yes</p>", "yes"),
    ("<article>three short words</article><div>" + LONG + "</div>", "three short words"),
    ("<article></article><div>" + LONG + "</div>", LONG.strip()),
    ("<header>no</header><article><header><h1>Head</h1></header>text<footer>no</footer></article>", "Head text"),
    ("<article>a<nav>no</nav><div class='related-posts'>no</div><div id=comments><article>no</article></div>b</article>", "a b"),
    ("<main><p>one</p><form><p>no</p><input value=no></form><p>two</p><aside>no</aside></main>", "one two"),
    ("<div role=navigation>no</div><div class='Cookie-Notice'>" + LONG + "</div><div class=content><p>" + LONG + "</p></div>", LONG.strip()),
    ("<div hidden>no</div><div style='display: none'>no</div><div aria-hidden=true>no</div><p>yes</p>", "yes"),
    ("<ul><li><a href=x>Home page</a><li><a href=y>Second page of menu</a></ul><br><br><p>" + LONG, LONG.strip()),
    ("<article>" + "<p>Ends with a <a href=x>link</a></p><p><a href=y>All link</a></p>" + "</article>", "Ends with a link All link"),
    ("<div class=ad>" * 3 + "no" + "</div>" * 3 + "<p>yes", "yes"), ("</div></p>x</article>", "x"),
])
def test_page(html, text):
    assert main_text(html) == text


def test_runs_by_surge_and_dive():
    """Without a marked article: short lines far from the text fall, short ones among it and at its edges stay."""
    page = "Site name<hr><hr><hr><h1>Title</h1><p>By me</p><p>" + LONG + "</p><p>Short.</p><p>" + LONG + "</p><p>End.</p><hr><hr><hr><div>tiny tail</div>"
    assert main_text(page) == f"Title By me {LONG.strip()} Short. {LONG.strip()} End."


def test_long_and_deep_pages():
    assert main_text("<article>" + "<p>word</p>" * 200_000 + "</article>") == "word " * 199_999 + "word"
    assert main_text("<div>" * 50_000 + "x" + "</div>" * 50_000) == "x"
    assert main_text("<" * 20_000 + "p") == "<" * 20_000 + "p"


def test_odd_rows(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>a</p>", "y"), (2, "", "", None)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string").selectExpr("*", "7 AS n_chars", "8 AS _r")
    got = extract_pages(frame)
    assert got.columns == ["page_id", "url", "_r", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", 8, "", 0), (1, "u", 8, "", 0), (None, None, 8, "a", 1), (2, "", 8, "", 0)], key=str)
    assert extract_pages(frame.where("false")).collect() == []
