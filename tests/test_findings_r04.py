"""Cases of the findings of the fourth round."""

import duckdb
import numpy as np
import pytest

from gleaner.llm import passages
from gleaner.operators import content
from gleaner.plans import registry

PAGE = "<html><head><title>{0}</title></head><body><nav>a menu</nav><div class=ad>{1}</div><article><h1>{0}</h1><p><b>{0}<br><p>{2}</p></article><footer>foot</footer>"
TITLES = ["words &quot", "&amp;&quo", "&#x27", "x &amp;lt", "&amp;copy; &amp;amp", "&am", "Forbidden", "call 404", "error 520 origin", "Just a moment...", "!!", "", " a", "captcha 502"]


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    """Pages with titles cut within references, short articles beside long asides, and none at all."""
    path = str(tmp_path_factory.mktemp("cut"))
    rows = [(k, "http://h.org/a", PAGE.format(t, "many words aside " * 20, "" if k % 2 else "a &amp;&copy; c")) for k, t in enumerate(TITLES)] + [(99, "http://h.org/b", None), (98, "http://h.org/c", "<p>words</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


def differences(spark, path, name):
    """Rows that only one of the query and its SQL gives."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{path}/pages.parquet/*.parquet')")
    found = con.execute(registry.ORACLES[name])
    cols = [x[0] for x in found.description]
    return {tuple(r) for r in registry.QUERIES[name](spark, path).select(*cols).collect()} ^ set(found.fetchall())


def test_articles_of_few_words(spark, cut):
    """the article is the content also where it holds few words or none."""
    assert not differences(spark, cut, "html_main")


def test_cut_titles(spark, cut):
    """a title that ends within a reference keeps what is left of it."""
    assert not differences(spark, cut, "html_title")


def test_reports_go_by_titles(spark, cut):
    """the status goes by the signs in the title that the SQL names."""
    assert not differences(spark, cut, "page_report")


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A page of more links and tabs than any limit that there was."""
    path = str(tmp_path_factory.mktemp("many"))
    items = "".join(f'<li><a href="/{k}">t{k}</a></li>' for k in range(700))
    page = f"<html><body><nav><ul>{items}</ul></nav><footer>foot</footer></body></html>"
    spark.createDataFrame([(1, "http://h.org/a", page), (2, "http://h.org/b", page.replace("<footer>foot</footer>", ""))], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


def test_every_control(spark, many):
    """a page gives all its controls, also those deep in it."""
    assert not differences(spark, many, "html_controls")
    rows = spark.createDataFrame([(1, "http://h.org/a", "<div>" * 60 + "<details>deep")], "page_id long, url string, html string")
    found = content.with_structure(rows, every_control=True).first().structure.controls
    assert [c.label for c in found] == ["deep"] and found[0].selector.count(" > ") == 62


def test_every_link(spark, many):
    """a page gives all its links."""
    assert not differences(spark, many, "html_links")


def common(x, y):
    """For each word of x, whether a longest common subsequence with y has it: the table of lengths walked from its end."""
    size = np.zeros((len(x) + 1, len(y) + 1), int)
    for i in range(len(x)):
        for j in range(len(y)):
            size[i + 1, j + 1] = size[i, j] + 1 if x[i] == y[j] else max(size[i, j + 1], size[i + 1, j])
    same, i, j = np.zeros(len(x), bool), len(x), len(y)
    while i and j:
        if size[i, j] == size[i - 1, j]:
            i -= 1
        elif size[i, j] == size[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            same[i] = True
    return same


def test_gaps_are_aligned_together(monkeypatch):
    """F1: rows whose seeds lie equally far apart are scored together, on the same longest common subsequences."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        x, y = (rng.integers(0, 9, n).astype(np.uint16) for n in rng.integers(0, 25, 2))
        assert len(x) == len(y) or (passages._gap(x, y) == common(x, y)).all()
    x = rng.integers(1, 1 << 16, 2 * passages.AROUND + 2 * passages.K + passages.MAX_GAP).astype(np.uint16)
    y = np.insert(x, passages.AROUND + passages.K + 8, 7)[: len(x)]  # a word more between the seeds
    ys, calls, best = np.stack([y] * 20), [], passages._best
    monkeypatch.setattr(passages, "_best", lambda same, *a: calls.append(len(same)) or best(same, *a))
    kinds, spans = passages._uneven(x, 20, ys, np.full(20, 21), 50, 0.8)
    whole = passages.EDGE + passages.K
    assert calls == [20, 20] and (kinds == 4).all() and (spans == [-passages.EDGE, 20 + whole, -passages.EDGE, 21 + whole]).all()
