import random
from urllib.parse import urlsplit, urlunsplit

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.functions import quality, text, urls


def one(spark, column, **values):
    df = spark.createDataFrame([(1,)], "one int").select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(1).alias("one"))
    return df.select(column.alias("r")).first().r


def many(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.r for r in df.select("i", make(F.col("v")).alias("r")).orderBy("i").collect()]


CANONICAL = {
    "HTTPS://Example.COM:443/products/?utm_source=test&b=2&a=1#details": "https://example.com/products/?utm_source=test&b=2&a=1",
    "http://Example.com": "http://example.com/", "http://example.com:80?x=1": "http://example.com/?x=1", "http://example.com:8080/a#b": "http://example.com:8080/a",
    "https://[2001:DB8::1]:443/x": "https://[2001:db8::1]/x", "http://me:pw@example.com/": None, "http://example.com/?": "http://example.com/", "no url": None, " https://a.b/c d": "https://a.b/c d",
    "https://[2001:db8::1]/": "https://[2001:db8::1]/", "http://a.example:65535/": "http://a.example:65535/", "http://a.example:65536/": None, "http://a.example:99999999999999999999/": None, "http://a:x/": None,
    "http://[::1/": None, "http://a[b]/": None, "http://a:/p": "http://a/p",
}


def test_canonical_url(spark):
    assert many(spark, list(CANONICAL), urls.canonical_url) == list(CANONICAL.values())
    done = [v for v in CANONICAL.values() if v]
    assert many(spark, done, urls.canonical_url) == done


def plain_canonical(url):
    p = urlsplit(url)
    host = f"[{p.hostname}]" if ":" in (p.hostname or "") else p.hostname
    port = p.port
    if port and (p.scheme, port) not in (("http", 80), ("https", 443)):
        host = f"{host}:{port}"
    return urlunsplit((p.scheme.lower(), host.lower(), p.path or "/", p.query, ""))


def test_canonical_url_matches_a_plain_model(spark):
    rng = random.Random(3)
    made = [f"{rng.choice(['http', 'HTTPS', 'https'])}://{rng.choice(['a.B', 'x.example', '10.0.0.1'])}{rng.choice(['', ':80', ':443', ':8443', ':'])}{rng.choice(['', '/', '/P/a%20b', '/x//y'])}{rng.choice(['', '?', '?a=1&a=2', '?q=#'])}{rng.choice(['', '#f', '#'])}" for _ in range(200)]
    assert many(spark, made, urls.canonical_url) == [plain_canonical(u) for u in made]


def test_safety(spark):
    cases = {
        "http://127.0.0.1/": "non_public_address", "http://198.18.0.7/": "non_public_address", "http://198.20.0.1/": None, "ftp://example.com/": "scheme", "http:///x": "no_host",
        "http://u:p@example.com/": "credentials", "http://LOCALHOST/": "localhost", "http://a.localhost./": "localhost", "http://8.8.8.8/": None, "http://256.1.1.1/": None, "http://100.127.0.1/": "non_public_address", "https://example.com/": None,
    }
    assert many(spark, list(cases), lambda u: urls.safety_reason(u)) == list(cases.values())
    assert many(spark, ["2606:4700::1111", "::1", "fe80::1", "2001:db8::1", "x", None], urls.is_public_ipv6) == [True, False, False, False, None, None]


def test_link_lists(spark):
    links = F.array(*map(F.lit, ["http://a/", "mailto:x", "https://b/", "http://a/"]))
    assert one(spark, urls.web_links(links)) == ["http://a/", "https://b/"]
    assert one(spark, urls.web_links(links, 1)) == ["http://a/"]
    assert one(spark, urls.merged_links(F.array(F.lit("a")), F.array(F.lit("b"), F.lit("a")))) == ["a", "b"]
    assert one(spark, urls.frame_names(F.array(*map(F.lit, ["http://w/x?1", "http://w/x?2", "http://y/"])), "//w/")) == ["http://w/x"]


def test_tokens_and_likeness(spark):
    assert one(spark, text.tokens(F.lit("Don't re-do É été A 42 x_y"))) == ["don't", "re-do", "été", "42", "x_y"]
    a, b = text.tokens(F.lit("one two three")), text.tokens(F.lit("two three four"))
    assert one(spark, text.jaccard(a, b)) == 0.5 and one(spark, text.jaccard(a, text.tokens(F.lit("")))) == 0.0
    assert one(spark, text.compact(F.lit(" a \t b\x1fc\n"))) == "a b c"
    assert one(spark, text.published_at(F.lit("2024-05"))) == "2024-05" and one(spark, text.published_at(F.lit("2024-05-06T07:08:09Z"))) == "2024-05-06T07:08:09+00:00"
    assert one(spark, text.published_at(F.lit("Tue, 01 Oct 2024 10:00:00 +0200"))) == "2024-10-01T10:00:00+02:00" and one(spark, text.published_at(F.lit("soon"))) is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00"), max_size=40), min_size=1, max_size=5), st.integers(1, 9))
def test_chunks_join_to_the_text(spark, texts, size):
    rows = text.chunks(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", size).collect()
    for i, t in enumerate(texts):
        assert "".join(r.chunk for r in sorted((r for r in rows if r.i == i), key=lambda r: r.chunk_no)) == t


def test_headers(spark):
    now = F.lit(1704067200.0)
    got = many(spark, ["5", " 0.2", "", "soon", "inf", "Mon, 01 Jan 2024 00:01:30 GMT"], lambda v: text.retry_after(v, now))
    assert got == [5.0, 1.0, None, None, None, 90.0]
    assert one(spark, text.server_timing(F.lit("total_0_a;dur=1, total_1_b c;dur=2.5, total_2_a;dur=3, x"))) == {"a": 3.0, "b c": 2.5}
    assert one(spark, text.comma_list(F.lit("a, B,b ,,A,c"))) == ["a", "B", "c"] and one(spark, text.comma_list(F.lit("a,A,a"), False)) == ["a", "A"]
    assert one(spark, quality.header_warnings(F.array(F.lit("-set-cookie"), F.lit("cookie")))) == ["response_header_dropped:set-cookie", "request_header_dropped:cookie"]


@pytest.mark.parametrize(
    "title,content,status,reasons",
    [
        ("Error 525: SSL handshake failed", "", None, ["cloudflare_525"]), ("Page not found", "", 404, ["http_404", "soft_404"]), ("Just a moment...", "", 200, ["bot_challenge"]),
        ("On captchas", "An article that discusses a captcha and Cloudflare. " * 50, 200, []), ("", "# Checking your browser before you go on", 200, ["bot_challenge"]), ("502 Bad Gateway", "", None, ["server_error"]), ("Access denied | x", "", 200, ["access_denied"]),
    ],
)
def test_page_diagnostics(spark, title, content, status, reasons):
    assert one(spark, quality.page_diagnostics(F.lit(title), F.lit(content), F.lit(status).cast("int"))) == reasons


@pytest.mark.parametrize("content,signals", [("Waiting for JavaScript", ["loading_placeholder"]), ("Home\nLoading...", ["loading_placeholder"]), ("a\nb\nLoading", []), ("Please enable JavaScript.", ["javascript_required"]), ("just a moment…", ["browser_check_interstitial"]), ("", []), ("We discuss loading pages.", [])])
def test_rendering_signals(spark, content, signals):
    assert one(spark, quality.rendering_signals(F.lit(content))) == signals


@pytest.mark.parametrize(
    "reason,delay", [("SSL connect error", 120), ("CAPTCHA challenge", 86400), ("too many requests", 3600), ("parsing error", 300), ("recaptcha", 604800), ("cloudflare captcha", 1296000), ("timeout", 120), ("DNS blocked", 120)]
)
def test_failure_delay(spark, reason, delay):
    assert one(spark, quality.failure_delay(F.lit(reason))) == delay


def test_routing_keeps_a_sound_page(spark):
    doc = lambda title, content, *w: F.struct(F.lit(title).alias("title"), F.lit(content).alias("content"), F.lit(200).alias("status_code"), F.array(*map(F.lit, w)).cast("array<string>").alias("warnings"))
    good, shell = doc("A", "Real words"), doc("B", "Loading...")
    assert one(spark, quality.route("auto", F.lit(True), good, shell)["title"]) == "A"
    assert one(spark, quality.route("auto", F.lit(True), shell, good)["title"]) == "A"
    assert one(spark, quality.route("always", F.lit(False), good, doc("C", "Other"))["title"]) == "C"
    assert one(spark, quality.route("never", F.lit(True), shell, good)["title"]) == "B"
    assert one(spark, quality.page_status(F.lit(200), F.array(F.lit("content_truncated:5>3:http")))) == "incomplete"
    assert one(spark, quality.structural_recovery(F.lit(False), F.lit("x"), F.lit(200), F.lit("Blocked by anti-bot protection: Structural: minimal_text, on small page"))) == "minimal_text"
