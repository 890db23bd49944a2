import html
import re

import pytest
from gleaner.llm import html_main
from pyspark.sql import functions as F

STORY = "<h1>Title &amp; more</h1><p>First   paragraph with a <b>bold</b> word and <a href='/x'>a link</a>, quite long.<p>Second one<br>after a break &#8212; 5 &lt; 6."
TEXT = "Title & more First paragraph with a bold word and a link, quite long. Second one after a break — 5 < 6."
NOISE = {
    "nav": "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News and a very long menu of many words to read</a></ul></nav>",
    "header": "<header><div>Site name</div></header>",
    "aside": "<aside class=x><p>Read this too</aside>",
    "ad": '<div class="ad">Buy now <b>cheap</b></div>',
    "sidebar": '<div id="sidebar"><div><p>Popular posts of the week</p></div></div>',
    "cookie": '<div class="cookie-notice">We use cookies</div>',
    "form": "<form><label>Mail</label><input value=x><textarea>type</textarea></form>",
    "script": '<script>var t="</p>";if(a<b){}</script><style>p{margin:0}</style><noscript>Enable it</noscript>',
    "comments": '<section class="comments"><h2>3 comments</h2><p>I think this is a really great text with many words.</p></section>',
    "footer": "<footer>&copy; me</footer>",
    "markup": "<!-- <p>not this</p> --><?php x ?>",
}


def page(body, noise=NOISE):
    before = "".join(noise.get(k, "") for k in ("nav", "header", "ad", "sidebar", "cookie", "script", "markup"))
    after = "".join(noise.get(k, "") for k in ("aside", "form", "comments", "footer"))
    return f"<!DOCTYPE html><html><head><title>Title &amp; more</title></head><body>{before}{body}{after}</body></html>"


def run(spark, rows):
    got = html_main.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return {r.page_id: r.text for r in got}


LAYOUTS = [
    f"<article>{STORY}</article>",
    f"<div class='content-12'>{STORY}</div>",
    f"<div id=main><div class=post>{STORY}</div></div>",
    f"<main><article><header>{STORY}</header></article></main>",
    f"<table><tr><td>{STORY}</td></tr></table>",
    f"<article><div class='ad'>Buy!</div>{STORY}<div class='share'>Share it</div>{NOISE['comments']}</article>",
    f"<ARTICLE CLASS=x>{STORY}</b></i></p>",
]


@pytest.mark.parametrize("at", range(len(LAYOUTS)))
def test_layouts_of_a_single_page(at):
    read = html_main.Page(page(LAYOUTS[at]))
    assert read.text(read.best()) == TEXT


NAMES = ["post-content with-sidebar", "main-content notice-board", "widget-page", "has-comments", "no_ads body", "page-with-menu story"]


@pytest.mark.parametrize("name", NAMES)
def test_names_that_only_mention_noise(name):
    for tag in ("div", "section"):
        read = html_main.Page(page(f'<{tag} class="{name}">{STORY}</{tag}>'))
        assert read.text(read.best()) == TEXT


def test_parts_of_an_article_stay():
    more = '<section class="related-work"><h2>Related work</h2><p>Others did this before.</p></section>'
    read = html_main.Page(page(f"<article>{STORY}{more}<div class=related-posts>Read on</div></article>"))
    assert read.text(read.best()) == TEXT + " Related work Others did this before."
    for body in (
        f"<article><h1>Title</h1><p class=lede>A lede.</p><div class=content>{STORY * 4}</div></article>",
        f"<div class=wrap><h1>Title</h1><p class=lede>A lede.</p><div class=content>{STORY * 4}</div></div>",
    ):
        read = html_main.Page(page(body))
        assert read.text(read.best()).startswith("Title A lede. Title & more First") and read.text(read.best()).count("5 < 6.") == 4
    for parts in (("text", "text"), ("intro", "text"), ("a", "b")):
        read = html_main.Page(page("<div class=page>" + "".join(f"<div class={c}>{STORY}</div>" for c in parts) + "</div>"))
        assert read.text(read.best()) == f"{TEXT} {TEXT}"
    alone = html_main.Page('<body><div class="comments"><p>' + "all that there is " * 20 + "</p></div></body>")
    assert alone.text(alone.best()).startswith("all that there is")


def test_time_in_proportion_to_the_page():
    import time

    for body in ("<div>" * 100_000 + "deep", "</b>" * 100_000 + "text", "<span>" * 50_000 + "<p>x" * 20_000, "<div class=ad>" * 50_000 + "deep", "<article>" + "<div><p>w</div>" * 30_000, f"<div class=content>{STORY}</div>" + "<div>" * 50_000 + STORY):
        start = time.perf_counter()
        read = html_main.Page(body)
        read.main_text([read.best().path()] if read.best() else [])
        assert time.perf_counter() - start < 5


def plain_votes(pages):
    """The consensus paths of each host, counted one by one."""
    votes = {}
    for _, url, source in pages:
        read = html_main.Page(source)
        if read.best() is not None:
            votes.setdefault(re.match(r"https?://([^/]*)", url)[1], []).append(read.best().path())
    return {h: sorted({p for p in v if v.count(p) > 1 and v.count(p) >= 0.01 * len(v)}, key=lambda p: (-v.count(p), p)) for h, v in votes.items()}


def test_votes_match_brute_force(spark):
    shapes = [lambda k, x, s=s: f"<div class='{s}{k}'>{x}</div>" for s in "abcdefghijk"]
    rows = []
    for k in range(120):
        shape = shapes[(k * k) % 11]
        extra = f"<div class=teaser>{'few words ' * (30 if k % 9 == 0 else 1)}</div>"
        rows.append((k, f"http://h{k % 3}.example.com/{k}", page(shape(k, STORY.replace("First", f"First{k}")) + extra)))
    want = plain_votes(rows)
    got = {r.host: r.paths for r in html_main.host_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {h: p for h, p in want.items() if p} == got and max(map(len, got.values())) > 2
    texts = run(spark, rows)
    for k, url, source in rows:
        assert texts[k] == html_main.Page(source).main_text(got[re.match(r"https?://([^/]*)", url)[1]])
        assert TEXT.replace("First", f"First{k}") in texts[k]


def test_hosts_agree_and_odd_pages(spark):
    rows = [(k, f"http://A.example.com/{k}", page(f"<div class='c{k}'>{STORY}</div><div class=teaser>{'few words ' * (40 if k == 0 else 1)}</div>")) for k in range(8)]
    rows += [
        (20, None, page(LAYOUTS[0])), (21, "http://b.example.com/", None), (22, "http://b.example.com/", ""), (23, "not a url", "just text & more"),
        (24, "http://c.example.com/", "<p>unclosed <b>mark"), (25, "http://c.example.com/", "<div><p>cut <a href='x"), (26, "http://d.example.com/", "<script>only()</script>"),
        (27, "http://d.example.com/", page(f"<article><p>{'word ' * 300_000}</article>")), (27, "http://d.example.com/", page(f"<article><p>{'word ' * 300_000}</article>")),
        (28, "http://e.example.com/", "<" * 500 + "&" * 500), (29, "http://e.example.com/", "<div>" * 3000 + "deep" + "</div>" * 3000),
    ]
    got = run(spark, rows)
    assert [got[k] for k in range(8)] == [TEXT] * 8
    assert got[20] == TEXT and got[21] == got[22] == got[26] == ""
    assert got[23] == "just text & more" and got[24] == "unclosed mark" and got[25] == "cut"
    assert got[27] == " ".join(["word"] * 300_000) and got[29] == "deep"


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_main.extract_main_text(empty).count() == 0
    table = spark.createDataFrame([(1, "http://x.example.com/", page(LAYOUTS[0]))], "page_id long, url string, html string").withColumns({"Text": F.lit(1), "page_host": F.lit(2), "__html": F.lit(3), "a.b": F.lit(4)})
    out = html_main.extract_main_text(table)
    assert out.columns == ["page_id", "url", "page_host", "__html", "a.b", "text", "n_chars"] and out.first().text == TEXT


def test_generated_pages_keep_the_whole_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_main.extract_main_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("</?(?:p|h1|br)>", " ", body))).split())
