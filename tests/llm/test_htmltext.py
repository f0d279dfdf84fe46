import time
from html.parser import HTMLParser

import pytest

from sparkgraft.llm import htmltext
from sparkgraft.llm.queries import op7_html


class Article(HTMLParser):
    """The plain way for the tables' pages: the blocks of their one article element."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.text = False, [], []
        self.feed(html)
        self.close()
        self.flush()

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append(" ")
        elif tag not in ("b", "i", "a", "em", "span"):
            self.flush()
        self.inside = self.inside or tag == "article"

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "a", "em", "span"):
            self.flush()
        self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.text.append(data)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op7_html(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == "\n".join(Article(pages[r.page_id].html).blocks)
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><p>Site head</p></header>
<div class="menu-3"><a href="/">Home</a></div><div id="c" class="post-{n} main"><h1>Title &amp; more</h1><p>One  two<br>three
<p>Four <i>fi</i>ve &lt; six &nbsp; x</p><form><p>Say</p></form><script>var t = "</p><p>no";</script><ul><li>a<li>b</ul>
<div class="comments"><p>A reader's very long comment, longer than all of the article by far, and then some more words.</p></div></div>
<aside>By the way</aside><div class="cookie-notice">We use cookies</div><footer>Foot</footer></body></html>"""
TEXT = "Title & more\nOne two three\nFour five < six x\na\nb"


def test_boilerplate_goes(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.replace("{n}", str(i))) for i in range(4)]
    got = htmltext.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {TEXT}
    few = htmltext.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), few_hosts=0).collect()
    assert sorted(few) == sorted(got)


def test_host_votes_beat_a_page_of_its_own_opinion(spark):
    article = "<body><div class=x>{}</div><div class=y><p>{}</p></div></body>"
    rows = [(i, "http://H.example/", article.format("side", "main " * 50)) for i in range(5)] + [(9, "http://h.example/", article.format("side " * 90, "short"))]
    got = {r.page_id: r.text for r in htmltext.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "short"


def test_edges(spark):
    rows = [(1, None, None), (2, None, ""), (3, "not a url", "<p>x<b>y"), (4, None, "plain & text <"), (5, None, "<article><p>a</p><p cla"), (None, None, "<!-- x"), (7, None, "<div>" * 3000 + "deep"), (8, None, "a < b &am c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", htmltext.F.lit("clash"))
    got = {r.page_id: r.text for r in htmltext.extract_main_text(df).collect()}
    assert got == {1: "", 2: "", 3: "xy", 4: "plain & text <", 5: "a", None: "", 7: "deep", 8: "a < b &am c"}
    assert htmltext.extract_main_text(df.limit(0)).count() == 0


HOSTILE = ["<a " * 340_000, "<div>" * 200_000, "<b>" * 100_000 + "<li>x</li>" * 70_000, "<a '" * 125_000 + '<a "' * 125_001 + ">", "<div class='a'><span>" * 45_000 + "x", "<p>x" * 250_000, "<!" * 500_000, "&#" * 500_000, "<script>" * 120_000, "<" * 1_000_000, "<div class=" + "c " * 400_000 + ">x", '<a ">"' * 150_000 + ">", "<b>" * 200_000 + "</i>" * 200_000, "<i>" * 100_000 + "<p>" + "</i>" * 200_000, "<center>" * 100_000 + "<li>x" * 100_000, "<p a='" + "<p a=\">" * 120_000 + "'>x"]


@pytest.mark.parametrize("html", HOSTILE, ids=range(len(HOSTILE)))
def test_hostile_pages_take_linear_time(html):
    began = time.process_time()
    page = htmltext.Page(html)
    page.main_text(page.path(found[0]) if (found := page.best()) else None)
    assert time.process_time() - began < 12


def test_depth_and_quotes():
    deep = htmltext.Page("<div>" * 400 + "<p>deep</p><nav>menu</nav>" + "</div>" * 400 + "<p>after</p>")
    assert [b[0] for b in deep.blocks] == ["deep", "after"] and deep.main_text(None) == "deep\nafter"
    assert htmltext.Page("<p title='never closed>one</p><p>two</p>").main_text(None) == "one\ntwo"
    assert htmltext.Page("<p title='>'>one</p><p title=\">\">two</p>").main_text(None) == "one\ntwo"


LONG = "many long words of text " * 20
WHOLE = {
    "lead and closing around a div": "<article><h1>Title</h1><p>Intro.<div class='content'>{long}</div><p>Closing.</article>",
    "without an article": "<div id=page><h1>Title</h1><p>Intro.<div class='content'>{long}</div><p>Closing.</div>",
    "quotation": "<div class=post><p>Title</p><p>Intro.<blockquote>{long}</blockquote><p>Closing.</div>",
    "table": "<div class=post><h1>Title</h1><p>Intro.<table><tr><td>{long}<tr><td>Closing.</table></div>",
    "sections": "<article><section class=intro><h1>Title</h1><p>Intro.</section><section class=body>{long}</section><section>Closing.</section></article>",
    "telling classes inline": "<article><h1>Title</h1><p><span class='notice-text ad'>Intro.</span><p class=ads-free>{long}<div class=social-history>Closing.</div></article>",
    "nested wrappers": "<main><h1>Title</h1><div><div><p>Intro.</p><div class=x>{long}</div></div></div><p>Closing.</main>",
    "bare": "<h1>Title</h1><p>Intro.</p><div>{long}</div><p>Closing.",
}
AROUND = "<html><head><title>no</title></head><body><nav><a href=/>Home</a></nav><div class='cookie-notice'><p>no no</p></div>{}<div class='comments'><p>{}</p></div><div id=related-posts><a href=/>no</a></div><footer>no</footer></body></html>"


@pytest.mark.parametrize("name", list(WHOLE))
def test_whole_article(spark, name):
    html = AROUND.format(WHOLE[name].format(long=LONG), "a reader's comment " * 90)
    rows = [(i, "http://h/", html) for i in range(3)]
    want = "\n".join(["Title", "Intro.", LONG.strip(), "Closing."])
    assert {r.text for r in htmltext.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {want}


def test_generated_articles_come_back_whole(spark):
    """Random trees of wanted and unwanted elements: what is kept is known from how they were made."""
    import random

    pick = random.Random(11)
    unwanted = ["<nav>{}</nav>", "<aside>{}</aside>", "<div class='ad'>{}</div>", "<form>{}</form>", "<div class='share-buttons'>{}</div>", "<div id=comments>{}</div>", "<script>{}</script>", "<ul class=related-list><li>{}</ul>", "<!-- {} -->", "<p class='cookieNotice'>{}</p>"]

    def tree(depth):
        html, kept = "", []
        for _ in range(pick.randrange(1, 4)):
            text = " ".join(pick.choices(["eins", "zwei", "drei &amp; vier", "fünf"], k=pick.randrange(1, 12)))
            kind = pick.randrange(8)
            if kind == 0:
                html += pick.choice(unwanted).format("not this")
            elif kind < 4 or depth == 0:
                html += f"<{(tag := pick.choice(['p', 'h2', 'pre', 'li', 'figcaption']))}>{text} <b class=ad>x</b> <i>y</i></{tag}>"
                kept.append(f"{text} x y".replace("&amp;", "&"))
            else:
                inner, below = tree(depth - 1)
                html += f"<{(tag := pick.choice(['div', 'section', 'blockquote', 'ul']))} class='c{pick.randrange(9)}'>{inner}</{tag}>"
                kept += below
        return html, kept

    rows, want = [], {}
    for i in range(150):
        html, kept = tree(4)
        rows.append((i, f"http://host{i % 7}.org/", AROUND.format(f"<article class=a{i % 3}>{html}</article>", "no")))
        want[i] = "\n".join(kept)
    got = {r.page_id: r.text for r in htmltext.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
