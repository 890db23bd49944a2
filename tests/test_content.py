"""Main content and controls on pages with missing end tags, odd nesting and without landmarks."""

import time

import pytest
from pyspark.sql import functions as F

from gleaner.operators import content, html

ROOT = "html:nth-of-type(1) > body:nth-of-type(1) > "


def controls(source):
    return [(c["kind"], c["selector"].removeprefix(ROOT).replace(":nth-of-type", ""), c["label"]) for c in content.read_structure(source, "http://h.example/")["controls"]]


@pytest.mark.parametrize(
    "source, found",
    [
        ("<ul><li role=tab>one<li role=tab>two<ul><li role=tab>in</ul><li>", [("ul(1) > li(1)", "one"), ("ul(1) > li(2)", "two in"), ("ul(1) > li(2) > ul(1) > li(1)", "in")]),
        ("<p>a<p role=tab>b<div role=tab>c</div></p><p role=tab>d", [("p(2)", "b"), ("div(1)", "c"), ("p(4)", "d")]),  # a closing tag alone is an empty paragraph
        ("<table><tr><td role=tab>a<td role=tab>b<tr><td role=tab>c</table>", [("table(1) > tbody(1) > tr(1) > td(1)", "a"), ("table(1) > tbody(1) > tr(1) > td(2)", "b"), ("table(1) > tbody(1) > tr(2) > td(1)", "c")]),
        ("<table><div role=tab>out</div><tr><td><div role=tab>in</div></table>", [("div(1)", "out"), ("table(1) > tbody(1) > tr(1) > td(1) > div(1)", "in")]),
        ("<dl><dt role=tab>t<dd role=tab>d<dt role=tab>u</dl>", [("dl(1) > dt(1)", "t"), ("dl(1) > dd(1)", "d"), ("dl(1) > dt(2)", "u")]),
        ("<head><title>x</title><div role=tab>starts the body</div>", [("div(1)", "starts the body")]),
        ("<span role=tab>a</b></i></span><span role=tab>b", [("span(1)", "a"), ("span(2)", "b")]),
        ("<a role=tab>no</a><h2>x<h3 role=tab>y", [("h3(1)", "y")]),
    ],
)
def test_paths(source, found):
    assert [(path, " ".join(label.split())) for _, path, label in controls(source)] == found


def test_controls_outside_forms():
    got = controls("<form><details>a</details><form><button>Load more</button></form><button>Show more now</button><button>Read morex</button><button>read MORE</button>")
    assert got == [("load_more", "button(1)", "Show more now"), ("load_more", "button(3)", "read MORE")]
    assert len(controls("<details>x</details>" * 40)) == 30
    assert controls("<div>" * 60 + "<details>deep") == []  # a path over 300 characters
    assert controls("<details>" + "word " * 100)[0][2] == ("word " * 100)[:120]


def blocks(source):
    return [(b["kind"], b["markdown"]) for b in content.read_structure(source, "http://h.example/d/")["blocks"]]


def test_markdown():
    assert blocks("<h2>A <i>b</i></h2><p>x <a href='y?q=1'>l  k</a>, z<br>w") == [("heading", "## A b"), ("text", "x [l k](http://h.example/d/y?q=1), z\nw")]
    assert blocks("<ol><li>a<li><p>b<p>c<ul><li>d</ul></ol>") == [("item", "1. a"), ("item", "2. b"), ("item", "  c"), ("item", "  - d")]
    assert blocks("<table><tr><th>k<th>v<tr><td>a|b<td><p>1<p>2</table>") == [("row", "| k | v |\n| --- | --- |"), ("row", "| a\\|b | 1 2 |")]
    assert blocks("<pre>a\n  b\n</pre><blockquote>q<br>r</blockquote>") == [("code", "```\na\n  b\n```"), ("text", "> q\n> r")]
    assert blocks("<p>a<script>x</script><style>y</style><noscript>n</noscript> b<a href='javascript:z'>c</a>") == [("text", "a bc")]


def main(spark, *sources):
    rows = spark.createDataFrame([(k, s, "http://h.example/") for k, s in enumerate(sources)], "k int, html string, url string")
    got = content.with_structure(rows).withColumn("m", content.main_content(F.col("structure"), F.lit("basic"))).select("k", "m.*").collect()
    return [(r.content, r.method, r.warnings) for r in sorted(got, key=lambda r: r.k)]


def test_main_content(spark):
    words = "many plain words of the article stand here " * 5
    menu = "<div>" + "".join(f"<a href='/{k}'>menu entry {k}</a> " for k in range(20)) + "</div>"
    got = main(
        spark,
        f"<nav><p>{words}</nav><article><h1>T</h1><p>{words}<aside>side</aside></article><div>{words}</div><footer>foot</footer>",
        f"{menu}<div><div><p>{words}<p>{words}</div></div><div><p>short note</div>",
        "<nav>only a menu</nav>", "", None, "<p>a few words",
        f"<article>teaser words</article><div><p>{words * 3}</div>",
    )
    plain = " ".join(words.split())
    assert got[0] == (f"# T\n\n{plain}", "http+blocks", [])
    assert got[1] == (f"{plain}\n\n{plain}", "http+blocks", [])
    assert got[2] == got[3] == got[4] == ("basic", "http+basic_html", ["main_extraction_fallback"])
    assert got[5][0] == "a few words"
    assert got[6][0] == " ".join((words * 3).split())


def test_links_of_an_article_stay(spark):
    got = main(spark, "<article><p>see</p><p><a href='/a'>all of this is a link</a></p></article>")[0]
    assert got[0] == "see\n\n[all of this is a link](http://h.example/a)"


@pytest.mark.parametrize("unit", ["<div>w ", "<details>", "<p><b>", "<li>x", "<table><tr><td>", "<a href=x>", "<div><p>", "<span>", "<ul><li>"])
def test_time_follows_length(unit):
    def took(n):
        start = time.process_time()
        content.read_structure(unit * n, "http://h.example/")
        html.read_page(unit * n, "http://h.example/")
        return time.process_time() - start

    took(2_000)
    assert took(32_000) < 8 * max(took(8_000), 0.05)


def test_probe_of_odd_pages():
    probe = html.read_page("<p>text</p><script>x</script>", "")["probe"]
    assert not probe["body_text"] and probe["script_count"] == 1  # no body element
    probe = html.read_page("<body><template>t</template><div id=app>a<noscript>n</noscript></div>b", "")["probe"]
    assert probe["body_text"].split() == ["a", "b"] and probe["app_root_text"].split() == ["a", "n"] and probe["noscript_text"] == "n"
    assert html.read_page("<link rel=canonical>", "http://h.example/x")["attribution"] == "http://h.example/x"
