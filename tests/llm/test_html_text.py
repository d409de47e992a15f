import os
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from weft.llm import html_text, registry
from weft.llm.html_text import Page


def page(body, head="<title>T</title>"):
    return f"<!DOCTYPE html><html><head>{head}<script>var t='</p>';</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>{body}<footer>&copy; me</footer></body></html>"


ARTICLE = "<div class='ad'>Buy now, a rather long advert that has many more words in it than the text</div><article><h1>A &amp; B</h1><p><b>One\n two.<br><p>Three&nbsp;four</p><aside>side</aside><div class='comments'><p>first!</p></div></article>"
CASES = [
    (1, "http://a.example.com/1", page(ARTICLE), "A & B\nOne two.\nThree four"),
    (2, "http://a.example.com/2", page("<article><h1>Short</h1></article><div class=ad>" + "advert " * 40 + "</div>"), "Short"),
    (3, "http://b.example.com/1", page("<div class='post-12'><h2>H</h2><p>alpha beta</p><form><input name=q>Search</form><p>gamma</p></div>"), "H\nalpha beta\ngamma"),
    (4, "http://b.example.com/2", page("<div class='post-99'><p>delta epsilon <a href=y>link</a></p></div><div class='cookie-notice'>We use cookies, many of them indeed</div>"), "delta epsilon link"),
    (5, "http://b.example.com/3", page("<main><p>no such path here</p></main>"), "no such path here"),
    (6, None, None, ""),
    (7, "", "", ""),
    (8, "http://c.example.com", "plain <unclosed text & more", None),
    (9, "http://c.example.com", page("<article><p>x" + " word" * 30_000 + "</p></article>"), "x" + " word" * 30_000),
]


def test_pages(spark):
    rows = spark.createDataFrame([c[:3] for c in CASES] * 2, "page_id long, url string, html string")
    got = html_text.extract(rows.withColumn("host", F.lit("x")).withColumn("paths", F.lit(1))).collect()
    assert len(got) == 2 * len(CASES)
    want = {c[0]: c[3] for c in CASES}
    for r in got:
        assert r.n_chars == len(r.text)
        if want[r.page_id] is not None:
            assert r.text == want[r.page_id], r.page_id


def test_most_hosts_may_differ(spark):
    rows = [(i, f"http://h{i}.example.com/", page(f"<div class='c{chr(97 + i % 7)}'><p>text {i} here</p></div>")) for i in range(60)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"text {i} here" for i in range(60)}


def texts(spark, rows):
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return {r.page_id: r.text for r in got}


def test_a_host_outvotes_an_odd_page(spark):
    odd = "<div id=x><p>a long block that is found on one page only, by chance</p></div>"
    rows = [(i, "http://e.example.com/", page(f"<div class=text><p>true text {i}</p></div>" + odd * (i == 3))) for i in range(6)]
    assert texts(spark, rows) == {i: f"true text {i}" for i in range(6)}


def test_broken_markup_is_read_to_its_end():
    assert Page('<p title="x>a</p><!-- b').text({}) in ("", "a")
    assert Page("<div><p>a<div>b</div></div></div>c").blocks
    assert Page("<" * 2000 + "a" * 2000 + '"' * 2000).blocks


KEPT = ["content with-sidebar", "no-sidebar", "col no-sidebar", "has-share-buttons", "search-results", "hidden-xs", "notice-of-award", "tags-heading", "related-work", "post print", "adsorption", "headline", "menuisier"]
LEFT = ["ad", "ads-2", "cookie-notice", "sidebar left", "site-footer", "commentList", "post-comments", "share-buttons", "related-posts", "nav_bar", "sideBar", "main-menu", "newsletter-box"]


def test_names_that_contain_a_word_for_boilerplate(spark):
    rows, want = [], {}
    for i, name in enumerate(KEPT + LEFT):
        body = f"<h1>Title {i}</h1><div class='{name}'><p>inner text of this one</p></div><p>more {i}</p>"
        for k, wrap in enumerate(("<article>{}</article>", "<main><div>{}</div></main>", "<div class='page'>{}</div>")):
            rows.append((10 * i + k, f"http://n{i}-{k}.example.com/", page(wrap.format(body))))
            want[10 * i + k] = f"Title {i}\ninner text of this one\nmore {i}" if name in KEPT else f"Title {i}\nmore {i}"
        # Around the whole article, on a page that has nothing else.
        rows.append((10 * i + 3, f"http://n{i}-3.example.com/", page(f"<div class='{name}'><h1>Title {i}</h1><p>all of it</p></div>")))
        want[10 * i + 3] = f"Title {i}\nall of it"
    rows.append((900, "http://m.example.com/", page("<article><h2>T</h2><p>text</p><div class='related-reading-tags'><a href=x>one link</a> <a href=y>another link</a></div></article>")))
    want[900] = "T\ntext"
    assert texts(spark, rows) == want


def test_a_host_with_many_templates(spark):
    """Seven templates on one host; each page also has a block with the first one's path."""
    rows, want = [], {}
    for i in range(42):
        t = "abcdefg"[i % 7] if i > 14 else "a"
        teaser = "<div class='a'><p>short teaser</p></div>" if t != "a" else ""
        rows.append((i, "http://t.example.com/", page(f"<div class='wrap'><div class='{t}'><h1>Page {i}</h1><p>{'its own words ' * 20}{i}</p></div></div>{teaser}")))
        want[i] = f"Page {i}\n{'its own words ' * 20}{i}"
    got = texts(spark, rows)
    assert {k: t.replace("\nshort teaser", "") for k, t in got.items()} == want


def test_split_articles(spark):
    """An article in several containers without an element around it keeps them all, in page order."""
    rows = [(i, "http://s.example.com/", page(f"<div class='intro'><p>first {i}</p></div><div class='post'><p>second, the longest part of it {i}</p></div><section><h2>third</h2><p>third {i}</p></section>")) for i in range(3)]
    rows.append((9, "http://alone.example.com/", rows[0][2]))
    want = {i: f"first {i}\nsecond, the longest part of it {i}\nthird\nthird {i}" for i in range(3)}
    assert texts(spark, rows) == want | {9: want[0]}


def test_comments_longer_than_the_article(spark):
    rows = [(i, "http://k.example.com/", page(f"<div class='post'><p>short {i}</p></div><div id='comments'><p>{'a reader says very much ' * 30}</p></div><ul><li><a href=x>next page</a></li></ul>")) for i in range(3)]
    assert texts(spark, rows) == {i: f"short {i}" for i in range(3)}


class Slow(HTMLParser):
    """A plain reader of generated pages: the blocks of their article elements, by the standard parser."""

    def __init__(self, markup):
        super().__init__(convert_charrefs=True)
        self.inside, self.now, self.blocks = 0, [], []
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("p", "h1", "article"):
            self.end()
        elif tag == "br":
            self.now.append(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.end()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.now.append(data)

    def end(self):
        if words := " ".join("".join(self.now).split()):
            self.blocks.append(words)
        self.now = []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables are not here")
def test_query_against_a_plain_reader(spark):
    given = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = {r.page_id: r.text for r in registry.op6_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    assert got == {k: "\n".join(Slow(x or "").blocks) for k, x in given.items()}


def test_empty_table(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_all_parts_of_an_article_stay(spark):
    parts = "<{0}><header><h1>Head {1}</h1></header><div class='lead'><p>lead</p></div><div class='body'><p>a body that is longer {1}</p></div></{0}>"
    rows = [(i, "http://d.example.com/", page(parts.format("main" if i % 2 else "article", i))) for i in range(4)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Head {i}\nlead\na body that is longer {i}" for i in range(4)}
