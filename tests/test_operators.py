import json
import random

import pytest
from pyspark.sql import functions as F

from gleaner.functions.quality import failure_delay
from gleaner.operators import cache, content, evaluate, focus, health, html, search
from gleaner.sources import captured
from gleaner.streaming import state

LEASES = "engine string, granted_at double, lease_until double"
PAGE = """<html><head><title>A &amp; b</title><base href="/docs/"><link rel="canonical" href="/orig">
<meta property="article:published_time" content="bad"><script type="application/ld+json">{"x": [{"datePublished": "2024-05"}]}</script></head>
<body><div id="app"></div><p>One <b>two</b><br>three<noscript>Please enable JavaScript</noscript><a href="x.html#c">l</a><a href="//other.example/r">m</a><a href="mailto:q">n</a>
<details>More</details><button>Load more items</button><form><button>Load more</button></form><script>x()</script></body></html>"""


def test_html_in_one_pass():
    got = html.read_page(PAGE, "http://host.example/a/b.html")
    assert got["title"] == "A & b" and got["links"] == ["http://host.example/docs/x.html#c", "http://other.example/r"]
    assert (got["published_at"], got["published_at_source"], got["attribution"]) == ("2024-05", "json_ld:datePublished", "http://host.example/orig")
    assert got["probe"]["app_root_seen"] and not got["probe"]["app_root_text"] and got["probe"]["script_count"] == 2
    controls = content.read_structure(PAGE, "http://host.example/a/b.html")["controls"]
    assert [(c["kind"], c["label"]) for c in controls] == [("expand", "More"), ("load_more", "Load more items")]
    assert "three" in got["text"] and "x()" not in got["text"]
    assert html.read_page("", "") == html.read_page(None, None)


def test_pages_that_parsers_give_up_on():
    deep = '{"a": ' * 5000 + '{"datePublished": "2020"}' + "}" * 5000
    for source in ("<p>one</p><![foo[ bar ]]>", '<base href="http://[bad"><a href="http://[x">l</a><p>one</p>', f'<p>one</p><script type="application/ld+json">{deep}</script>'):
        assert html.read_page(source, "http://h.example/")["text"] == "one" or "one" in html.read_page(source, "http://h.example/")["text"]
    assert html._values({"x": [{"k": 1}, {"y": {"k": 2}}], "k": 0}, "k") == [0, 1, 2]


def test_echoes_are_no_failures_of_their_own(spark):
    log = spark.createDataFrame([(1, "e", 1.0, True, "captcha", None), (2, "e", 2.0, True, "Suspended: captcha", 1e6)], "event_id int, engine string, at double, failed boolean, reason string, retry_after double")
    states = health.transitions(log)
    got = health.snapshot(states, F.lit(3.0), leases=spark.createDataFrame([("e", 2.5, 4.0)], LEASES)).first()
    assert (got.status, got.failures, got.suspension_reports, got.consecutive_failures, got.retry_at) == ("recovering", 1, 1, 1, 1000002.0)
    assert health.snapshot(states, F.lit(3.0)).first().status == "cooling_down"
    voided = spark.createDataFrame([("e", 0.5, 200.0), ("e", 3.5, 4.0)], LEASES)  # one before the failures, one not yet granted
    assert health.snapshot(states, F.lit(3.0), leases=voided).first().status == "cooling_down"


def test_claims_to_the_last_moment(spark):
    rows = spark.createDataFrame([(1, "k", 0.0, True), (2, "k", 10.0, True), (3, "k", 10.5, False), (4, "k", 11.0, True)], "id int, key string, at double, full boolean")
    granted = lambda **more: [r.granted for r in health.claims(rows, "key", "at", 10.0, "id", **more).orderBy("id").collect()]
    assert granted() == [True, True, False, False]
    assert granted(inclusive=True) == [True, False, True, False]
    assert granted(inclusive=True, stored="full") == [True, False, True, True]


def test_search_results(spark):
    body = {"results": [{"url": "http://a/?utm=1", "engines": ["x"]}, {"url": "http://a/", "engine": "y", "title": " T "}, {"url": ""}, {"url": "HTTP://A:80/#f", "score": 2}, {"url": "http://b/", "publishedDate": "2024"}]}
    rows = search.parse_results(spark.createDataFrame([("q", json.dumps(body))], "q string, body string"), "q", "body")
    got = [(r["rank"], r.url, r.title, list(r.engines), r.published_at) for r in search.first_wins(rows, "q", 3).orderBy("rank").collect()]
    assert got == [(1, "http://a/?utm=1", "http://a/?utm=1", ["x"], None), (2, "http://a/", "T", ["y"], None), (5, "http://b/", "http://b/", [], "2024")]
    down = {"unresponsive_engines": [["e1", "timeout"], {"engine": "e2", "error": "captcha"}, "e3", ["e1", "timeout"], []]}
    found = spark.createDataFrame([(json.dumps(down),)], "b string").select(search.unresponsive(F.col("b")).alias("u")).first().u
    assert [tuple(x) for x in found] == [("e1", "timeout"), ("e2", "captcha"), ("e3", "unresponsive"), ("unknown", "unresponsive")]


def test_prune_keeps_the_newest(spark):
    rows = spark.createDataFrame([(i, float(i % 7), "p" * i) for i in range(40)], "id int, stored_at double, payload string")
    kept = cache.prune(rows, F.lit(7.0), 5.0, 30, 6, "id").collect()
    model = sorted((r for r in ((i, float(i % 7), i) for i in range(40)) if r[1] >= 2 and r[2] <= 30), key=lambda r: (-r[1], r[0]))[:6]
    assert {r.id for r in kept} == {r[0] for r in model}
    total, want = 0, set()
    for i, _, n in sorted(((i, float(i % 7), i) for i in range(40)), key=lambda r: (-r[1], r[0])):
        total += n
        if total <= 200:
            want.add(i)
    assert {r.id for r in cache.keep_bytes(rows, 200, "id", 2.0).collect()} == want


def test_cursors_and_payloads(spark):
    row = spark.createDataFrame([("a" * 32 + ":12", "[1]", '{"retrieved_at": "2024"}')], "c string, old string, new string")
    got = row.select(cache.parse_cursor(F.col("c")).alias("c"), cache.payload_results(F.col("old")).alias("o"), cache.payload_results(F.col("new")).alias("n"), cache.parse_cursor(F.lit("12")).alias("bad")).first()
    assert got.c.offset == 12 and got.o.legacy and got.o.retrieved_at is None and got.n.retrieved_at == "2024" and got.bad is None


def observations(n=400, seed=2):
    rng = random.Random(seed)
    reasons = ["ssl connect", "captcha", "429", "parsing", "suspended: blocked", "timeout"]
    return [(i, f"e{rng.randrange(4)}", float(i * rng.choice((0, 40, 4000)) + i), rng.random() < 0.7, rng.choice(reasons)) for i in range(n)]


SCHEMA = "event_id int, engine string, at double, failed boolean, reason string"


def plain_health(spark, rows):
    waits = {r.reason: r.d for r in spark.createDataFrame([(r,) for r in {r[4] for r in rows}], "reason string").select("reason", failure_delay(F.col("reason")).alias("d")).collect()}
    state_, out = {}, {}
    for i, e, at, failed, reason in sorted(rows, key=lambda r: (r[2], r[0])):
        count, expires, ok = state_.get(e, (0, 0.0, 0))
        if failed:
            count = max(1, count) if "suspended" in reason else count + 1
            local, declared = reason == "ssl connect", reason in ("captcha", "429", "suspended: blocked")
            ceiling = 1800 if local else max(waits[reason], 604800)
            if not (local or declared or ok):
                ceiling = min(ceiling, 3600)
            expires = max(expires, at + min(waits[reason] * 2 ** min(count - 1, 8), ceiling))
        else:
            count, expires, ok = 0, 0.0, ok + 1
        state_[e] = (count, expires, ok)
        out[i] = (count, expires)
    return out


def test_back_off_in_batch_and_stream(spark, tmp_path):
    rows = observations()
    want = plain_health(spark, rows)
    got = health.transitions(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.event_id: (r.consecutive_failures, r.expires_at) for r in got} == want
    ordered = sorted(rows, key=lambda r: (r[2], r[0]))
    for k in range(4):
        spark.createDataFrame(ordered[k * 100 : (k + 1) * 100], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    done = state.health_stream(stream).writeStream.format("memory").queryName("health_out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    done.awaitTermination(120)
    assert {r.event_id: (r.consecutive_failures, r.expires_at) for r in spark.table("health_out").collect()} == want


@pytest.mark.parametrize("seconds", [10.0, 500.0])
def test_claims_match_a_plain_fold(spark, seconds):
    rows = observations(300, 5)
    until, want = {}, {}
    for i, e, at, _, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = e not in until or at >= until[e]
        if want[i]:
            until[e] = at + seconds
    got = health.claims(spark.createDataFrame(rows, SCHEMA), "engine", "at", seconds, "event_id").collect()
    assert {r.event_id: r.granted for r in got} == want


def test_epochs_and_recovery(spark):
    rows = spark.createDataFrame([(1, "e", 1.0, "a"), (2, "e", 2.0, "a"), (3, "e", 3.0, "b"), (4, "e", 4.0, "a")], "id int, engine string, at double, config string")
    assert [r.epoch for r in health.epochs(rows, "engine", "config", "at", "id").orderBy("id").collect()] == [0, 0, 1, 2]
    asked = spark.createDataFrame([("q", 1, "recovery_due"), ("q", 2, "working"), ("q", 3, "recovery_due")], "q string, place int, status string")
    assert [r.deferred for r in health.one_recovering(asked, "q", "place").orderBy("place").collect()] == [False, False, True]


def test_focus(spark):
    long = "nav " * 1500 + "\n\n# Other\n\nintro text here " + "x " * 300 + "\n## Deep\nthe rare needle stands here " + "y " * 2000
    rows = spark.createDataFrame([(1, long), (2, "# needle rare stands\n" + "z " * 3000), (3, "short"), (4, "q " * 4000)], "id int, t string")
    got = {r.id: r.focus_start for r in focus.focus_start(rows, "id", "t", F.lit("rare needle stands")).collect()}
    assert got[2] == got[3] == got[4] == 0 and long[got[1] :].startswith("# Other")


def test_citations_match_a_theta_join(spark):
    rng = random.Random(4)
    passages = [(i, " ".join(rng.choices("ab cd ef gh".split(), k=30))) for i in range(30)]
    quotes = [(i, t) for i, t in enumerate(["ab  CD", "cd", "b c", "ab cd ef", "d ef gh a", "zz", "", "gh gh gh gh"])]
    got = evaluate.citation_match(spark.createDataFrame(quotes, "q int, t string"), spark.createDataFrame(passages, "p int, t string"), "q", "t", "p", "t").collect()
    assert sorted(tuple(r) for r in got) == sorted((i, j) for i, q in quotes for j, p in passages if q and " ".join(q.lower().split()) in p)


def test_reports(spark):
    assert evaluate.recover_report(['```json\n{"findings": {}}\n```']) == {"findings": {}}
    assert evaluate.recover_report(["old", 'so {"findings": {"a": 1}} then {"kind": "k", "reason": "r"}', "no json"])["stop"] == {"kind": "k", "reason": "r"}
    assert evaluate.recover_report(["nothing {"]) == {}
    expected = spark.createDataFrame([("c", "f", "X  y"), ("c", "g", None), ("c", "h", "z")], "c string, field string, value string")
    actual = spark.createDataFrame([("c", "f", "x Y"), ("c", "g", None)], "c string, field string, value string")
    assert {r.field: r.value_ok for r in evaluate.findings_check(expected, actual, "c").collect()} == {"f": True, "g": True, "h": False}


def test_sources(spark, tmp_path):
    calls = spark.createDataFrame([("read_url", "{}", "{}", False, None, 1.5)], captured.TRACE)
    captured.write_trace(calls, f"{tmp_path}/t")
    assert captured.read_trace(spark, f"{tmp_path}/t").collect() == calls.collect()
    hops = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "url string, location string")
    got = {r.url: (r.final_url, r.hops, r.too_many) for r in captured.resolve_redirects(spark.createDataFrame([("a",), ("c",), ("x",)], "url string"), hops).collect()}
    assert got == {"a": ("c", 2, False), "c": ("c", 0, False), "x": ("y", 5, True)}
    raw = spark.createDataFrame([(bytearray("Привет".encode("cp1251")), "cp1251"), (bytearray(b"\xef\xbb\xbfok"), None), (bytearray(b"\xff"), None)], "b binary, c string")
    assert [(r.d.text, r.d.lossy) for r in raw.select(captured.decoded("b", "c").alias("d")).collect()] == [("Привет", False), ("ok", False), ("�", True)]


def test_as_of_lookup_over_spans(spark):
    rng = random.Random(1)
    events = [(i, f"k{rng.randrange(3)}", float(rng.randrange(2000))) for i in range(300)]
    df = spark.createDataFrame(events, "id int, k string, at double")
    asks, puts = df.filter("id % 2 = 0"), df.filter("id % 2 = 1")
    got = {r.id: (r.found_at, r.found_id) for r in cache.lookup_as_of(asks, puts, "k", "at", 50.0, "id").collect()}
    for i, k, t in events[::2]:
        fits = [(u, j) for j, o, u in events[1::2] if o == k and t - 50 <= u <= t]
        assert got[i] == (max(fits) if fits else (None, None))
