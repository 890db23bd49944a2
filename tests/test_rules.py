"""Single rules on written-out cases: the inputs and, last, what the rule must give, as text."""

from __future__ import annotations

import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import quality, text, urls
from gleaner.operators import cache, evaluate, health, search
from gleaner.sources.captured import compact_bytes, decoded


CASES: list = []


def cases(name, schema, rows, rule):
    CASES.append(pytest.param(schema, rows, rule, id=name))


def joined(c: Column) -> Column:
    return F.array_join(c.cast("array<string>"), "|", "-")


cases("address_safety", "url string", [
    ("http://[::1]/", "non_public_address"), ("http://[fd00::1]/x", "non_public_address"), ("https://[2001:4860:4860::8888]/", None), ("http://224.0.0.1/", None), ("http://192.88.99.1/", None),
    ("http://240.0.0.1/", "non_public_address"), ("http://100.64.1.1/", "non_public_address"), ("http://198.19.0.1/", "non_public_address"), ("http://8.8.8.8/", None), ("http://a.localhost./", "localhost"),
    ("ftp://8.8.8.8/", "scheme"), ("http://u:p@8.8.8.8/", "credentials"), ("http:///x", "no_host"), ("http://[fe80::1]:80/", "non_public_address"), ("http://[::ffff:10.0.0.1]/", "non_public_address"),
], lambda c: urls.safety_reason(c("url")))
cases("address_public", "name string", [
    ("8.8.8.8", "true"), ("224.0.0.1", "false"), ("192.88.99.1", "false"), ("10.1.2.3", "false"), ("172.32.0.1", "true"), ("2001:4860:4860::8888", "true"), ("::1", "false"), ("fd00::1", "false"),
    ("2001:db8::1", "false"), ("example.com", None), ("203.0.113.9", "false"), ("1.2.3", None),
], lambda c: urls.public_address(c("name")))
cases("link_lists", "a array<string>, b array<string>", [
    (["http://x/1", "mailto:q", "https://y/", "http://x/1"], ["http://z/", "http://x/1"], "http://x/1|https://y/;http://x/1|mailto:q|https://y/|http://z/"), ([], ["ftp://a/"], ";ftp://a/"), ([], [], ";"),
], lambda c: F.concat(joined(urls.web_links(c("a"))), F.lit(";"), joined(urls.merged_links(c("a"), c("b")))))
cases("frame_names", "a array<string>", [
    (["https://w/anchor?k=1", "https://w/anchor?k=2#x", "https://other/"], "https://w/anchor"), (["https://w/a1/anchor", "https://w/a2/anchor", "https://w/a3/anchor", "https://w/a4/anchor"], "https://w/a1/anchor|https://w/a2/anchor|https://w/a3/anchor"), ([], ""),
], lambda c: joined(urls.frame_names(c("a"), "anchor")))
cases("first_published", "a string, b string, c string", [
    ("2024", "2023", None, "2024"), ("no date", "2024-05-06T07:08:09Z", None, "2024-05-06T07:08:09+00:00"), (None, " ", "Wed, 21 Oct 2026 07:28:00 GMT", "2026-10-21T07:28:00+00:00"), ("x", "y", "z", None), (None, "2024-05", "2020", "2024-05"),
], lambda c: text.first_published(c("a"), c("b"), c("c")))
cases("metadata_date", "a string, b string, c string", [
    ("2024-05", "2020", None, "2024-05"), ("", "2020", None, "2020"), ("no date", "2020", None, None), (None, None, "2021-02", "2021-02"), (None, None, None, None),
], lambda c: quality.metadata_date(c("a"), c("b"), c("c")))
cases("markdown_choice", "a string, b string, c string", [
    ("plain", "raw", "fit", "plain;false"), (None, "raw", "fit", "raw;false"), (None, " ", "fit", "fit;true"), (None, None, None, ";false"), (None, None, "fit", "fit;true"),
], lambda c: F.concat(quality.markdown_choice(c("a"), c("b"), c("c"))["text"], F.lit(";"), quality.markdown_choice(c("a"), c("b"), c("c"))["filtered"].cast("string")))
cases("effective_status", "a string, b string", [("200", "301", "200"), (None, "404", "404"), ("x", "302", "302"), (None, None, None)], lambda c: quality.effective_status(c("a"), c("b")))
cases("query_rendering", "a string, b string, c string", [
    ("spark joins", "Spark guide", "loading", "true"), ("spark joins", "Spark guide", "all about joins", "false"), ("spark", "other", "loading", "false"),
], lambda c: quality.query_needs_rendering(text.tokens(c("a")), text.tokens(c("b")), text.tokens(c("c"))))
cases("structural_recovery", "ok boolean, m string, st int, e string", [
    (False, "text", 200, "Blocked by anti-bot protection: Structural: minimal_text on small page", "minimal_text"), (False, " ", 200, "Blocked by anti-bot protection: Structural: minimal_text on small page", None),
    (False, "text", 403, "Blocked by anti-bot protection: Structural: minimal_text on small page", None), (True, "text", 200, "Blocked by anti-bot protection: Structural: minimal_text on small page", None), (False, "text", 204, "Blocked by anti-bot protection: Structural: captcha_form on small page", None),
], lambda c: quality.structural_recovery(c("ok"), c("m"), c("st"), c("e")))
cases("guidance", "o string, p string", [
    ("success", "ok", ";"), ("empty", "incomplete", f"{quality.EMPTY_GUIDANCE};{quality.READ_GUIDANCE}"), ("backend_unavailable", "ok", f"{quality.BACKEND_GUIDANCE};"), ("success", "suspected_error", f";{quality.READ_GUIDANCE}"),
], lambda c: F.concat(joined(quality.search_guidance(c("o"))), F.lit(";"), joined(quality.read_guidance(c("p")))))
cases("header_policy", "a array<string>", [(["-Set-Cookie", "Referer"], "response_header_dropped:Set-Cookie|request_header_dropped:Referer"), ([], "")], lambda c: joined(quality.header_warnings(c("a"))))
cases("argument_bounds", "q string, l int, p int, r string", [
    ("x", 1, 1, None, "true"), ("", 5, 1, None, "false"), ("x", 21, 1, None, "false"), ("x", 20, 10, "day", "true"), ("x", 20, 11, "day", "false"), ("x", 3, 3, "week", "false"), ("y" * 2001, 3, 3, None, "false"),
], lambda c: quality.valid_arguments(c("q"), c("l"), c("p"), c("r")))
cases("engine_choice", "a string, l string", [
    ("beta", " alpha, beta ,alpha", "beta"), (None, " alpha, beta ,alpha,Alpha", "alpha|beta|Alpha"), ("Beta", "alpha,beta", None), (None, "", ""),
], lambda c: joined(quality.chosen_engines(c("a"), text.comma_list(c("l"), False))))
cases("search_outcome", "n int, f boolean, t boolean, e string", [
    (3, False, False, None, "success;"), (0, False, False, None, "empty;"), (0, True, False, "no backend", "backend_unavailable;search_failed: no backend"), (0, True, True, "late", "backend_unavailable;search_timeout:30s"),
], lambda c: F.concat(quality.outcome(c("n"), c("f")), F.lit(";"), joined(quality.search_warnings(c("f"), c("t"), c("e")))))
_ACTION = "kind string, selector string, frame string, x double, y double, text string, duration_ms int"
cases("action_validity", _ACTION, [
    ("scroll", None, None, None, None, None, None, "ok"), ("scroll", "a", None, None, None, None, None, "extra:selector"), ("scroll", None, None, None, None, None, 0, "extra:duration_ms"),
    ("click", "a", "f", None, None, None, None, "ok"), ("expand", None, None, None, None, None, None, "missing:selector"), ("tab", "a", None, 1.0, None, None, None, "extra:x"), ("load_more", "a", None, None, None, "t", None, "extra:text"),
    ("click_at", None, None, 1.0, 0.0, None, None, "ok"), ("click_at", None, None, 1.0, None, None, None, "missing:y"), ("click_at", "a", None, 1.0, 2.0, None, None, "extra:selector"),
    ("wait_for", None, None, None, None, "t", None, "ok"), ("wait_for", None, None, None, None, "", 0, "missing:duration_ms|text"), ("wait_for", "a", None, None, None, "t", 5, "extra:selector"), ("dance", None, None, None, None, None, None, "unknown_kind"),
], lambda c: F.coalesce(quality.action_problem(F.struct(*(c(n) for n in ("kind", *quality.ACTION_FIELDS)))), F.lit("ok")))
cases("output_caps", "n int", [(5, "5;5"), (1000, "1000;1000"), (1001, "1000;1001"), (4001, "1000;4000")], lambda c: F.concat(*(F.length(search.as_hit(F.repeat(F.lit("x"), c("n")), F.repeat(F.lit("y"), c("n")))[k]).cast("string") if k != ";" else F.lit(";") for k in ("title", ";", "snippet"))))
cases("optional_fields", "a int, g array<string>, f boolean", [
    (None, [], False, "{}"), (5, [], True, '{"elapsed_ms":5,"cached":true}'), (None, ["x"], False, '{"guidance":["x"]}'),
], lambda c: search.without_empty(elapsed_ms=c("a"), list__guidance=c("g"), flag__cached=c("f")))
cases("available_engines", "a array<string>, b array<string>, k boolean", [
    (["Alpha", "beta"], ["ALPHA"], True, "beta"), (["Alpha"], [], False, ""), (["Alpha"], ["SearXNG"], True, ""), (["Alpha"], [], True, "Alpha"),
], lambda c: joined(search.available(c("a"), c("b"), c("k"))))
cases("unresponsive_engines", "b string", [
    ('{"unresponsive_engines": [["e1", "timeout"], {"engine": "e2", "error": "captcha"}, "e3", []]}', "e1=timeout|e2=captcha|e3=unresponsive|unknown=unresponsive"), ("{}", ""),
], lambda c: joined(F.transform(search.unresponsive(c("b")), lambda u: F.concat(u["engine"], F.lit("="), u["reason"]))))
cases("snapshot_cursors", "a string", [("a" * 32 + ":12", "12"), ("12", None), ("A" * 32 + ":1", None), ("0" * 32 + ":0", "0"), ("0" * 32 + ":", None)], lambda c: cache.parse_cursor(c("a"))["offset"])
cases("payload_formats", "a string", [("[1]", "true;-"), ('{"retrieved_at": "2024"}', "false;2024"), (" [ ]", "true;-"), ("{}", "false;-")], lambda c: F.concat(cache.payload_results(c("a"))["legacy"].cast("string"), F.lit(";"), F.coalesce(cache.payload_results(c("a"))["retrieved_at"], F.lit("-"))))
cases("document_age", "s double, r double", [(100.0, 100.0, "true"), (100.0, 10.0, "false"), (40.0, 40.0, "true"), (39.0, 39.0, "false"), (100.0, 101.0, "false")], lambda c: cache.document_fresh(c("s"), c("r"), F.lit(100.0), 60.0))
cases("storage_warnings", "l double, b double", [(5.0, 5.0, ""), (11.0, 5.0, "document_over_ceiling"), (10.0, 100000001.0, "store_over_100_mb"), (11.0, 2e8, "document_over_ceiling|store_over_100_mb")], lambda c: joined(cache.storage_report(c("l"), 10.0, c("b"))))
cases("health_lines", "s string, r string, u double", [("cooling_down", "captcha", 130.9, "captcha (30s; cooling_down)"), ("working", "", None, None), ("missing", "not there", None, "not there (0s; missing)"), ("recovering", "x", 90.0, "x (0s; recovering)")], lambda c: health.health_line(c("s"), c("r"), c("u"), F.lit(100.0)))
cases("stop_checks", "k string, r string, g array<string>, e string", [("sufficient", "done", [], "sufficient", "true|true|true"), ("sufficient", " ", [], "gaps", "false|false|false"), (None, None, None, "gaps", "false|false|false"), ("gaps", "x", ["y"], "gaps", "true|true|true")], lambda c: F.concat_ws("|", *(evaluate.stop_checks(c("k"), c("r"), c("g"), c("e"))[n].cast("string") for n in ("stop_kind", "stop_explained", "gaps_reported"))))
cases("extra_findings", "a map<string,string>, b map<string,string>", [({"z": "1", "x": "2", "y": "3"}, {"y": "0"}, "x|z"), ({}, {"y": "0"}, "")], lambda c: joined(evaluate.extra_findings(c("a"), c("b"))))
cases("required_sources", "a array<string>, b array<string>", [(["u"], ["u", "v"], "true"), (["u", "w"], ["u"], "false"), ([], [], "true")], lambda c: evaluate.sources_read(c("a"), c("b")))
cases("finding_evidence", "e array<struct<url:string,quote:string>>, r map<string,array<string>>, s map<string,string>", [
    ([("u", "A  b")], {"u": ["x a B y"]}, {}, "true"), ([("u", "zz")], {"u": ["x a B y"]}, {}, "false"), ([("u", "a b")], {"u": ["x a b y"]}, {"u": "b"}, "true"), ([("u", "a b")], {"u": ["x a b y"]}, {"u": "c"}, "false"), ([], {"u": ["a"]}, {}, "true"), ([("w", "a")], {"u": ["a"]}, {}, "false"),
], lambda c: evaluate.evidence_ok(c("e"), c("r"), c("s")))
_CALL = (
    "tool string, is_error boolean, outcome string, page_status string, retrieved_at string, content string, method string, content_end int, snapshot string, expected_text string, expected_target string, "
    "expected_method string, access_probe boolean, again struct<is_error:boolean,cache_hit:boolean,same:boolean>, next struct<is_error:boolean,snapshot:string,retrieved_at:string,start:int>"
)
_NAMES = [part.split()[0] for part in _CALL.replace(",cache_hit:boolean,same:boolean", "").replace(",snapshot:string,retrieved_at:string,start:int", "").split(", ")]
cases("call_checks", _CALL, [
    ("web_search", False, "success", None, "t", None, None, None, None, None, None, None, False, (False, True, True), None, "cache_provenance_preserved=true|results_available=true|retrieval_time_present=true|tool_completed=true"),
    ("web_search", False, "empty", None, None, None, None, None, None, None, None, None, False, None, None, "results_available=false|retrieval_time_present=false|tool_completed=true"),
    ("read_url", False, None, "ok", "t", "see [x](/y) here", "http", 9, "s", "here", "/y", "http", False, None, (False, "s", "t", 9), "continuation_preserved=true|expected_method_used=true|expected_text_present=true|page_ok=true|relative_link_preserved=true|tool_completed=true"),
    ("read_url", True, None, None, None, None, None, None, None, "here", None, None, True, None, None, "access_status_reported=true|expected_text_present=false|tool_completed=false"),
    ("read_url", False, None, "incomplete", "t", "a", "http", 9, "s", None, None, "browser", False, None, (False, "s", "t", 8), "continuation_preserved=false|expected_method_used=false|page_ok=false|tool_completed=true"),
], lambda c: joined(F.array_sort(F.transform(F.map_entries(evaluate.call_checks(F.struct(*(c(n) for n in _NAMES)))), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))))
cases("charset_decoding", "b binary, c string", [(bytearray("Привет".encode("cp1251")), "cp1251", "Привет;false"), (bytearray(b"\xef\xbb\xbfok"), None, "ok;false"), (bytearray(b"a\xff"), None, "a\ufffd;true"), (bytearray(b"x"), "no-such", "x;false")], lambda c: F.concat(decoded(c("b"), c("c"))["text"], F.lit(";"), decoded(c("b"), c("c"))["lossy"].cast("string")))
cases("compact_size", "a int, b string", [(1, "x", "15"), (10, "é", "17"), (None, "", "8")], lambda c: compact_bytes(F.struct(c("a"), c("b"))))


@pytest.mark.parametrize("schema, rows, rule", CASES)
def test_rule(spark, schema, rows, rule):
    given = spark.createDataFrame([(k, *r[:-1]) for k, r in enumerate(rows)], f"case_no int, {schema}")
    found = given.select("case_no", rule(F.col).cast("string").alias("result")).orderBy("case_no").collect()
    assert [r.result for r in found] == [r[-1] for r in rows]
