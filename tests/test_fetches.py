"""Captured responses, redirects, limits and kept answers; headings of long texts."""

import json
import random
import time
from urllib.parse import urljoin

from pyspark.sql import functions as F

from gleaner.operators import focus
from gleaner.sources import fetches


def test_fetches(spark, tmp_path):
    line = lambda url, at, status=200, location=None, length=None, body="b": {"url": url, "captured_at": at, "status": status, "location": location, "content_type": "text/html", "content_length": length, "body": body}
    rows = [
        line("http://a.example", 1.0, body="old"), line("http://A.example/", 5.0, body="new"), line("http://b.example/x/y", 1.0, 301, "../z"), line("http://b.example/x/z", 1.0, 302, "//a.example/"),
        line("http://b.example/x/../z", 1.0, 302, "//a.example/"), line("http://l.example/", 1.0, 307, "/"), line("http://big.example/", 1.0, length=10**7), line("http://fat.example/", 1.0, body="é" * 60), line("http://e.example/", 1.0, 404, "/ignored", body="gone"),
    ]
    path = tmp_path / "archive.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\nnot json\n")
    asked = [(0, "http://a.example/#f", 4.0), (1, "http://a.example", 5.0), (2, "http://a.example/", 0.5), (3, "http://b.example/x/y", 9.0), (4, "http://l.example/", 9.0), (5, "http://big.example/", 9.0), (6, "http://fat.example", 9.0), (7, "http://e.example/", 9.0), (8, "no url", 9.0), (9, None, 9.0)]
    out = fetches.fetched(spark.createDataFrame(asked, "request_id int, url string, at double"), fetches.read_archive(spark, str(path)), max_bytes=100)
    got = {r.request_id: (r.hops, r.status, r.body, r.error) for r in out.collect()}
    assert got == {
        0: (0, 200, "old", None), 1: (0, 200, "new", None), 2: (0, None, None, "not_captured"), 3: (2, 200, "new", None), 4: (5, 307, None, "too_many_redirects"), 5: (0, 200, None, "too_large"),
        6: (0, 200, None, "too_large"), 7: (0, 404, "gone", None), 8: (0, None, None, "not_captured"), 9: (0, None, None, "not_captured"),
    }


def test_locations(spark):
    pairs = [("http://h.example/a/b?q#f", x) for x in ("c", "/c", "//o.example/c", "https://o.example", "c/d?e")] + [("http://h.example", "c"), ("http://h.example?q", "/c")]
    got = spark.createDataFrame(pairs, "base string, location string").withColumn("u", fetches.absolute(F.col("location"), F.col("base"))).collect()
    assert [r.u for r in got] == [urljoin(b, x) for b, x in pairs]


def test_kept_answers(spark):
    rng, at, rows = random.Random(2), 0.0, []
    for k in range(200):
        at += rng.choice([0.0, 1.0, 10.0, 50.0])
        rows.append((k, f"http://{rng.choice('abc')}.example/", at))
    got = {r.request_id: r.looks for r in fetches.stored(spark.createDataFrame(rows, "request_id int, url string, at double"), 10.0, width=100.0).collect()}
    until = {}
    for k, url, at in rows:
        looks = url not in until or at > until[url]
        if looks:
            until[url] = at + 10.0
        assert got[k] == looks


def test_headings(spark):
    rng = random.Random(6)
    text = "\n".join(rng.choice(["# a", "## é b", "text", "", "#no", "####### x", "  # y", "# "]) for _ in range(3000))
    for levels in (1, 6):
        got = spark.createDataFrame([(text,), ("",), (None,), ("# one",)], "t string").select(focus.headings(F.col("t"), levels).alias("h")).collect()
        want, at = [], 0
        for x in text.split("\n"):
            marks = len(x) - len(x.lstrip("#"))
            if 1 <= marks <= levels and x[marks : marks + 1].isspace() and x[marks:].strip():
                want.append((at, x))
            at += len(x) + 1
        assert [tuple(h) for h in got[0].h] == want and got[1].h == [] and got[2].h is None and [tuple(h) for h in got[3].h] == [(0, "# one")]
    start = time.time()
    long = spark.range(1).select(F.size(focus.headings(F.repeat(F.lit("# h\n"), 100_000), 6))).first()[0]
    assert long == 100_000 and time.time() - start < 20
