"""Queries of single rules over whole tables.

Each rule judges values that columns of its rows give (links of a page, words of a turn, moments and amounts of an
event), row by row; the SQL states the rule a second time, in its own words and with its own constants.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import quality, text, urls
from gleaner.operators import cache, evaluate, health, search
from gleaner.plans.registry import AS_OF, _log, _LOG_SQL, query
from gleaner.sources.captured import compact_bytes, decoded, digest
from gleaner.sources.tables import table


def rule(name: str, on: str, key: str, found: str, given: dict[str, tuple[str, str] | str], result) -> None:
    """Registers a query of (key, result) over a table. `given` are the inputs, in Spark's SQL and the other's (one text if both
    read the same); `found` computes the result from them, `result` is the engine's rule."""
    both = {n: (x, x) if isinstance(x, str) else x for n, x in given.items()}
    inputs = ", ".join(f"{x} AS {n}" for n, (_, x) in both.items() if n not in key.split(", "))

    def run(spark, d):
        keys = key.split(", ")
        rows = table(spark, d, on).select(*keys, *(F.expr(x).alias(n) for n, (x, _) in both.items() if n not in keys))
        return rows.select(*keys, result(F.col).cast("string").alias("result"))

    query(name, f"SELECT {key}, {found} AS result FROM (SELECT {key}, {inputs} FROM {on})")(run)


def joined(c: Column) -> Column:
    return F.array_join(c.cast("array<string>"), "|", "-")


# --- Addresses and links ---------------------------------------------------------------------------

_OCTETS = {
    "o1": ("element_at(array(8, 10, 100, 127, 169, 172, 192, 198, 203, 224, 240, 0), cast(event_id % 12 + 1 as int))", "[8, 10, 100, 127, 169, 172, 192, 198, 203, 224, 240, 0][event_id % 12 + 1]"),
    "o2": ("CASE WHEN user_id % 3 = 0 THEN element_at(array(0, 168, 254, 51, 18, 88), cast(user_id % 6 + 1 as int)) ELSE cast(round(value * 100) as bigint) % 256 END", "CASE WHEN user_id % 3 = 0 THEN [0, 168, 254, 51, 18, 88][user_id % 6 + 1] ELSE round(value * 100)::BIGINT % 256 END"),
    "o3": "CASE WHEN event_id % 5 = 0 THEN 113 WHEN event_id % 5 = 1 THEN 0 WHEN event_id % 5 = 2 THEN 2 WHEN event_id % 5 = 3 THEN 99 ELSE 100 END",
    "o4": "event_id % 300",
    "kind": "event_type",
}
_NAME = "concat_ws('.', c.o1, c.o2, c.o3, c.o4)"
_VALID = "o4 < 256"
_LOCAL = """(o1 IN (0, 10, 127) OR o1 >= 240 OR (o1 = 100 AND o2 BETWEEN 64 AND 127) OR (o1 = 169 AND o2 = 254) OR (o1 = 172 AND o2 BETWEEN 16 AND 31) OR (o1 = 192 AND o2 = 168)
    OR (o1 = 192 AND o2 = 0 AND o3 = 0 AND o4 NOT IN (9, 10)) OR (o1 = 192 AND o2 = 0 AND o3 = 2) OR (o1 = 198 AND o2 IN (18, 19)) OR (o1 = 198 AND o2 = 51 AND o3 = 100) OR (o1 = 203 AND o2 = 0 AND o3 = 113))"""
_dotted = lambda c: F.concat_ws(".", *(c(o).cast("string") for o in ("o1", "o2", "o3", "o4")))
rule(
    "address_safety", "events", "event_id",
    f"CASE WHEN kind = 'click' THEN 'scheme' WHEN kind = 'view' THEN 'credentials' WHEN kind = 'signup' THEN 'localhost' WHEN {_VALID} AND {_LOCAL} THEN 'non_public_address' END", _OCTETS,
    lambda c: urls.safety_reason(F.concat(F.when(c("kind") == "click", "ftp").otherwise("http"), F.lit("://"), F.when(c("kind") == "view", "u:p@").otherwise(""), F.when(c("kind") == "signup", F.concat(_dotted(c), F.lit(".localhost."))).otherwise(_dotted(c)), F.lit(":8080/x"))),
)
rule(
    "address_public", "events", "event_id", f"CASE WHEN {_VALID} THEN (NOT ({_LOCAL} OR o1 BETWEEN 224 AND 239 OR (o1 = 192 AND o2 = 88 AND o3 = 99)))::VARCHAR END", _OCTETS, lambda c: urls.public_address(_dotted(c)),
)
_HREFS = ("regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)", "regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)")
_once = lambda x: f"list_filter({x}, lambda y, i: list_position({x}, y) = i)"
_LINKS = {
    "a": (f"transform({_HREFS[0]}, (x, i) -> concat(CASE i % 3 WHEN 0 THEN 'http://h' WHEN 1 THEN 'mailto:' ELSE 'https://h' END, x))", f"list_transform({_HREFS[1]}, lambda x, i: CASE (i - 1) % 3 WHEN 0 THEN 'http://h' WHEN 1 THEN 'mailto:' ELSE 'https://h' END || x)"),
    "b": (f"transform({_HREFS[0]}, x -> concat('http://h', x))", f"list_transform({_HREFS[1]}, lambda x: 'http://h' || x)"),
}
_WEB, _BOTH = "list_filter(a, lambda x: x LIKE 'http%')", "list_concat(a, b)"
rule("link_lists", "pages", "page_id", f"array_to_string({_once(_WEB)}, '|') || ';' || array_to_string({_once(_BOTH)}, '|')", _LINKS, lambda c: F.concat(joined(urls.web_links(c("a"))), F.lit(";"), joined(urls.merged_links(c("a"), c("b")))))
_FRAMES = (f"transform({_HREFS[0]}, (x, i) -> concat('https://w', x, CASE i % 2 WHEN 0 THEN '/anchor?k=' ELSE '#x' END, i))", f"list_transform({_HREFS[1]}, lambda x, i: 'https://w' || x || CASE (i - 1) % 2 WHEN 0 THEN '/anchor?k=' ELSE '#x' END || (i - 1))")
_BARE = "list_transform(list_filter(a, lambda x: contains(x, 'anchor')), lambda x: regexp_replace(x, '[?#].*$', ''))"
rule("frame_names", "pages", "page_id", f"array_to_string(({_once(_BARE)})[1:3], '|')", {"a": _FRAMES}, lambda c: joined(urls.frame_names(c("a"), "anchor")))
rule("required_sources", "pages", "page_id", "(len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0)::VARCHAR", {"a": (f"slice({_HREFS[0]}, 1, 2)", f"({_HREFS[1]})[1:2]"), "b": (f"slice({_HREFS[0]}, 1 + cast(page_id % 2 as int), 4)", f"({_HREFS[1]})[1 + page_id % 2 : 4 + page_id % 2]")}, lambda c: evaluate.sources_read(c("a"), c("b")))
rule("header_policy", "pages", "page_id", "array_to_string(list_transform(a, lambda x: CASE WHEN x[1] = '-' THEN 'response_header_dropped:' || x[2:] ELSE 'request_header_dropped:' || x END), '|')",
     {"a": (f"transform({_HREFS[0]}, (x, i) -> concat(CASE i % 2 WHEN 0 THEN '-' ELSE '' END, x))", f"list_transform({_HREFS[1]}, lambda x, i: CASE (i - 1) % 2 WHEN 0 THEN '-' ELSE '' END || x)")}, lambda c: joined(quality.header_warnings(c("a"))))

# --- Dates, texts and pages ------------------------------------------------------------------------

_DATES = {
    "a": ("CASE event_id % 4 WHEN 0 THEN date_format(ts, 'yyyy') WHEN 1 THEN 'no date' WHEN 3 THEN '' END", "CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y') WHEN 1 THEN 'no date' WHEN 3 THEN '' END"),
    "b": ("CASE user_id % 3 WHEN 0 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") WHEN 1 THEN ' ' END", "CASE user_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN ' ' END"),
    "c": ("date_format(ts, 'yyyy-MM')", "strftime(ts, '%Y-%m')"),
}
_ISO = "replace(b, 'Z', '+00:00')"
rule("first_published", "events", "event_id", f"CASE WHEN regexp_full_match(a, '[0-9]{{4}}') THEN a WHEN contains(b, 'T') THEN {_ISO} ELSE c END", _DATES, lambda c: text.first_published(c("a"), c("b"), c("c")))
rule("metadata_date", "events", "event_id", f"CASE WHEN a <> '' THEN CASE WHEN a <> 'no date' THEN a END WHEN b <> '' THEN CASE WHEN b <> ' ' THEN {_ISO} END ELSE c END", _DATES, lambda c: quality.metadata_date(c("a"), c("b"), c("c")))
rule("markdown_choice", "conversations", "conv_id, turn", "CASE WHEN a IS NOT NULL THEN a || ';false' WHEN trim(b) <> '' THEN b || ';false' WHEN c IS NOT NULL THEN c || ';true' ELSE ';false' END",
     {"a": "CASE WHEN turn % 3 = 0 THEN text END", "b": "CASE turn % 4 WHEN 1 THEN '  ' WHEN 2 THEN text END", "c": "CASE WHEN length(text) % 2 = 0 THEN concat('fit ', role) END"},
     lambda c: F.concat(quality.markdown_choice(c("a"), c("b"), c("c"))["text"], F.lit(";"), quality.markdown_choice(c("a"), c("b"), c("c"))["filtered"].cast("string")))
rule("effective_status", "events", "event_id", "coalesce(try_cast(a AS INT), try_cast(b AS INT))::VARCHAR", {"a": ("CASE event_id % 3 WHEN 0 THEN string(200 + event_id % 400) WHEN 1 THEN event_type END", "CASE event_id % 3 WHEN 0 THEN (200 + event_id % 400)::VARCHAR WHEN 1 THEN event_type END"), "b": ("CASE WHEN user_id % 4 > 0 THEN string(300 + user_id) END", "CASE WHEN user_id % 4 > 0 THEN (300 + user_id)::VARCHAR END")}, lambda c: quality.effective_status(c("a"), c("b")))
_TERMS = lambda x: f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_''-]{{2,}}')"
rule("query_rendering", "documents", "doc_id", f"(list_has_any({_TERMS('a')}, {_TERMS('b')}) AND NOT list_has_any({_TERMS('a')}, {_TERMS('c')}))::VARCHAR", {"a": "substring(text, 1, 12)", "b": "substring(text, 8, 60)", "c": "substring(text, 100, 60)"}, lambda c: quality.query_needs_rendering(text.tokens(c("a")), text.tokens(c("b")), text.tokens(c("c"))))
rule("structural_recovery", "pages", "page_id", "CASE WHEN NOT ok AND trim(m) <> '' AND st >= 200 AND st < 300 AND e LIKE 'Blocked by anti-bot protection: Structural: %' AND w IN ('minimal_text', 'no_content_elements', 'script_heavy_shell') THEN w END",
     {"ok": "page_id % 5 = 0", "m": "CASE WHEN page_id % 7 > 0 THEN url ELSE ' ' END", "st": ("cast(150 + length(html) % 200 as int)", "(150 + length(html) % 200)::INT"), "w": ("element_at(array('minimal_text', 'no_content_elements', 'script_heavy_shell', 'other'), cast(page_id % 4 + 1 as int))", "['minimal_text', 'no_content_elements', 'script_heavy_shell', 'other'][page_id % 4 + 1]"),
      "e": ("concat(CASE WHEN page_id % 6 > 0 THEN '' ELSE 'Not ' END, 'Blocked by anti-bot protection: Structural: ', element_at(array('minimal_text', 'no_content_elements', 'script_heavy_shell', 'other'), cast(page_id % 4 + 1 as int)), ' on small page')", "CASE WHEN page_id % 6 > 0 THEN '' ELSE 'Not ' END || 'Blocked by anti-bot protection: Structural: x on small page'")},
     lambda c: quality.structural_recovery(c("ok"), c("m"), c("st"), c("e")))
rule("output_caps", "documents", "doc_id", "least(length(text), 1000) || ';' || least(length(text), 4000)", {"text": "text"}, lambda c: F.concat(F.length(search.as_hit(c("text"), c("text"))["title"]), F.lit(";"), F.length(search.as_hit(c("text"), c("text"))["snippet"])))
rule("charset_decoding", "documents", "doc_id", "CASE doc_id % 4 WHEN 3 THEN text || chr(65533) || ';true' ELSE text || ';false' END", {"doc_id": "doc_id", "text": "text"}, lambda c: F.concat(_decoded(c)["text"], F.lit(";"), _decoded(c)["lossy"].cast("string")))
rule("compact_size", "documents", "doc_id", """strlen('{"a":' || doc_id || ',"b":"' || source || '"}')::VARCHAR""", {"doc_id": "doc_id", "source": "source"}, lambda c: compact_bytes(F.struct(c("doc_id").alias("a"), c("source").alias("b"))))


def _decoded(c) -> Column:
    """A text in UTF-8, in UTF-16 as declared, in UTF-8 with a charset that nobody knows, and with a byte that is no UTF-8."""
    i, plain = c("doc_id") % 4, F.encode(c("text"), "UTF-8")
    body = F.when(i == 1, F.encode(c("text"), "UTF-16BE")).when(i == 3, F.concat(plain, F.unhex(F.lit("FF")))).otherwise(plain)
    return decoded(body, F.when(i == 1, "utf-16-be").when(i == 2, "no-such"))


# --- Searches and reads ----------------------------------------------------------------------------

_EMPTY = "No matches. Try a more specific query, another language, or a known source URL."
_BACKEND = "Access failure is not evidence of absence. Read known URLs or use an accessible alternative; avoid immediately retrying blocked engines."
_READ = "Inspect warnings before using this page. Try rendering, a visual, or another source if relevant text is missing."
rule("guidance", "events", "event_id", f"CASE o WHEN 'backend_unavailable' THEN '{_BACKEND}' WHEN 'empty' THEN '{_EMPTY}' ELSE '' END || ';' || CASE WHEN p <> 'ok' THEN '{_READ}' ELSE '' END",
     {"o": "CASE event_type WHEN 'error' THEN 'backend_unavailable' WHEN 'view' THEN 'empty' ELSE 'success' END", "p": "CASE user_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'incomplete' ELSE 'suspected_error' END"},
     lambda c: F.concat(joined(quality.search_guidance(c("o"))), F.lit(";"), joined(quality.read_guidance(c("p")))))
rule("argument_bounds", "documents", "doc_id", "(length(q) >= 1 AND length(q) <= 2000 AND l >= 1 AND l <= 20 AND p >= 1 AND p <= 10 AND (r IS NULL OR r IN ('day', 'month', 'year')))::VARCHAR",
     {"q": "CASE WHEN doc_id % 9 > 0 THEN text ELSE '' END", "l": ("cast(doc_id % 23 as int)", "(doc_id % 23)::INT"), "p": ("cast(doc_id % 12 as int)", "(doc_id % 12)::INT"), "r": "CASE doc_id % 5 WHEN 0 THEN 'day' WHEN 1 THEN 'week' WHEN 2 THEN 'year' END"},
     lambda c: quality.valid_arguments(c("q"), c("l"), c("p"), c("r")))
rule("engine_choice", "documents", "doc_id", "CASE WHEN a IS NULL THEN 'src0|src1|src2|Src1' || CASE WHEN lang <> '' THEN '|' || lang ELSE '' END WHEN a IN ('src0', 'src1', 'src2', 'Src1', lang) THEN a END",
     {"a": "CASE WHEN doc_id % 3 > 0 THEN source END", "lang": "lang", "l": ("concat(' src0, src1 ,src2,src0,Src1,,', lang)", "''")}, lambda c: joined(quality.chosen_engines(c("a"), text.comma_list(c("l"), False))))
rule("search_outcome", "events", "event_id", "CASE WHEN f THEN 'backend_unavailable' WHEN n > 0 THEN 'success' ELSE 'empty' END || ';' || CASE WHEN t THEN 'search_timeout:30s' WHEN f THEN 'search_failed: ' || e ELSE '' END",
     {"n": "event_id % 3", "f": "event_type = 'error'", "t": "event_type = 'error' AND user_id % 2 = 0", "e": "props"}, lambda c: F.concat(quality.outcome(c("n"), c("f")), F.lit(";"), joined(quality.search_warnings(c("f"), c("t"), c("e")))))
_ACTION = {
    "kind": ("element_at(array('scroll', 'expand', 'tab', 'load_more', 'click', 'click_at', 'wait_for', 'dance'), cast(event_id % 8 + 1 as int))", "['scroll', 'expand', 'tab', 'load_more', 'click', 'click_at', 'wait_for', 'dance'][event_id % 8 + 1]"),
    "selector": "CASE WHEN user_id % 3 = 0 THEN event_type WHEN user_id % 3 = 1 THEN '' END", "frame": "CASE WHEN user_id % 11 = 0 THEN props END", "x": "CASE WHEN value > 15 THEN value END", "y": "CASE WHEN value > 18 AND event_id % 5 > 0 THEN value - 18 END",
    "text": "CASE WHEN user_id % 7 = 0 THEN props WHEN user_id % 7 = 1 THEN '' END", "duration_ms": ("CASE WHEN user_id % 5 < 2 THEN cast(user_id % 5 * 100 as int) END", "CASE WHEN user_id % 5 < 2 THEN (user_id % 5 * 100)::INT END"),
}
_named = lambda f, allowed: " ".join(f"WHEN {c} THEN 'extra:{n}'" for n, c in (("selector", "selector <> ''"), ("frame", "frame <> ''"), ("x", "x IS NOT NULL"), ("y", "y IS NOT NULL"), ("text", "text <> ''"), ("duration_ms", "duration_ms <> 0")) if n not in allowed)
rule("action_validity", "events", "event_id", f"""CASE WHEN kind = 'dance' THEN 'unknown_kind'
    WHEN kind = 'scroll' THEN CASE WHEN selector IS NOT NULL THEN 'extra:selector' WHEN frame IS NOT NULL THEN 'extra:frame' WHEN x IS NOT NULL THEN 'extra:x' WHEN y IS NOT NULL THEN 'extra:y' WHEN text IS NOT NULL THEN 'extra:text' WHEN duration_ms IS NOT NULL THEN 'extra:duration_ms' ELSE 'ok' END
    WHEN kind = 'click_at' THEN CASE WHEN x IS NULL THEN 'missing:x' WHEN y IS NULL THEN 'missing:y' {_named('', ('x', 'y'))} ELSE 'ok' END
    WHEN kind = 'wait_for' THEN CASE WHEN coalesce(text, '') = '' AND coalesce(duration_ms, 0) = 0 THEN 'missing:duration_ms|text' {_named('', ('text', 'duration_ms'))} ELSE 'ok' END
    ELSE CASE WHEN coalesce(selector, '') = '' THEN 'missing:selector' {_named('', ('selector', 'frame'))} ELSE 'ok' END END""", _ACTION,
     lambda c: F.coalesce(quality.action_problem(F.struct(*(c(n) for n in ("kind", *quality.ACTION_FIELDS)))), F.lit("ok")))
rule("optional_fields", "events", "event_id", """'{' || array_to_string(list_filter([CASE WHEN a IS NOT NULL THEN '"elapsed_ms":' || a END, CASE WHEN len(g) > 0 THEN '"guidance":["' || g[1] || '"]' END, CASE WHEN f THEN '"cached":true' END], lambda x: x IS NOT NULL), ',') || '}'""",
     {"a": "CASE WHEN event_id % 2 = 0 THEN event_id END", "g": ("CASE WHEN event_type = 'view' THEN array(props) ELSE array() END", "CASE WHEN event_type = 'view' THEN [user_id::VARCHAR] ELSE [] END"), "f": "event_type = 'error'", "user_id": "user_id"},
     lambda c: search.without_empty(elapsed_ms=c("a"), list__guidance=F.transform(c("g"), lambda x: c("user_id").cast("string")), flag__cached=c("f")))
rule("available_engines", "events", "event_id", "CASE WHEN NOT k OR (len(b) > 0 AND b[1] = 'SearXNG') THEN '' ELSE array_to_string(list_filter(a, lambda x: len(b) = 0 OR lower(x) <> lower(b[1])), '|') END",
     {"a": ("array(event_type, upper(event_type), 'Click', 'other')", "[event_type, upper(event_type), 'Click', 'other']"), "b": ("CASE user_id % 4 WHEN 0 THEN array(upper(event_type)) WHEN 1 THEN array('SearXNG') WHEN 2 THEN array('CLICK') ELSE cast(array() as array<string>) END", "CASE user_id % 4 WHEN 0 THEN [upper(event_type)] WHEN 1 THEN ['SearXNG'] WHEN 2 THEN ['CLICK'] ELSE [] END"), "k": "event_id % 5 > 0"},
     lambda c: joined(search.available(c("a"), c("b"), c("k"))))
_BITS = lambda k: f"(event_id >> {k}) % 2 = 1"
_NAMED = """list_filter([CASE WHEN p THEN 'e' || u || '=timeout' END, CASE WHEN r THEN kind || '=captcha' END, CASE WHEN s THEN kind || '=unresponsive' END, CASE WHEN t THEN 'unknown=unresponsive' END, CASE WHEN p AND s THEN 'e' || u || '=late' END], lambda x: x IS NOT NULL)"""
rule("unresponsive_engines", "events", "event_id", f"array_to_string({_NAMED}, '|')",
     {"u": "user_id", "kind": "event_type", "p": (_BITS(0).replace(">> 0", "div 1"), _BITS(0)), "r": ("(event_id div 2) % 2 = 1", _BITS(1)), "s": ("(event_id div 4) % 2 = 1", _BITS(2)), "t": ("(event_id div 8) % 2 = 1", _BITS(3))},
     lambda c: joined(F.transform(search.unresponsive(_failures(c)), lambda u: F.concat(u["engine"], F.lit("="), u["reason"]))))


def _failures(c) -> Column:
    """A response body with failures in the forms that backends use: pairs, objects, names and empty lists."""
    user, kind = c("u").cast("string"), c("kind")
    parts = [
        F.when(c("p"), F.concat(F.lit('["e'), user, F.lit('", " timeout "]'))), F.when(c("r"), F.concat(F.lit('{"engine": "'), kind, F.lit('", "error": "captcha"}'))),
        F.when(c("s"), F.concat(F.lit('"'), kind, F.lit('"'))), F.when(c("t"), F.lit("[]")), F.when(c("p") & c("s"), F.concat(F.lit('["e'), user, F.lit('", "", "late"]'))),
    ]
    return F.concat(F.lit('{"unresponsive_engines": ['), F.concat_ws(", ", *parts), F.lit("]}"))


# --- Stores ----------------------------------------------------------------------------------------

rule("snapshot_cursors", "documents", "doc_id", "CASE WHEN doc_id % 3 <> 1 AND doc_id % 5 <> 2 AND doc_id % 7 <> 3 THEN doc_id::VARCHAR END",
     {"doc_id": "doc_id", "a": ("concat(CASE WHEN doc_id % 3 = 1 THEN upper(concat('a', substring(md5(text), 2))) ELSE md5(text) END, CASE WHEN doc_id % 5 = 2 THEN '' ELSE ':' END, CASE WHEN doc_id % 7 = 3 THEN 'x' ELSE string(doc_id) END)", "''")}, lambda c: cache.parse_cursor(c("a"))["offset"])
rule("payload_formats", "events", "event_id", "CASE event_id % 4 WHEN 0 THEN 'true;-' WHEN 1 THEN 'false;' || kind WHEN 2 THEN 'true;-' ELSE 'false;-' END",
     {"event_id": "event_id", "kind": "event_type", "a": ("CASE event_id % 4 WHEN 0 THEN concat('[', props, ']') WHEN 1 THEN concat('{\"results\": [', props, '], \"retrieved_at\": \"', event_type, '\"}') WHEN 2 THEN '  [ ]' ELSE props END", "''")},
     lambda c: F.concat(cache.payload_results(c("a"))["legacy"].cast("string"), F.lit(";"), F.coalesce(cache.payload_results(c("a"))["retrieved_at"], F.lit("-"))))
_AT = ("unix_micros(cast(ts as timestamp)) / 1e6D", "epoch_us(ts) / 1e6")
rule("document_age", "events", "event_id", f"(s >= {AS_OF} - 864000 AND {AS_OF} - r >= 0 AND {AS_OF} - r <= 864000)::VARCHAR", {"s": _AT, "r": tuple(f"{x} - value * 10000 + 50000" for x in _AT)}, lambda c: cache.document_fresh(c("s"), c("r"), F.lit(AS_OF), 864000.0))
rule("storage_warnings", "documents", "doc_id", "array_to_string(list_filter([CASE WHEN l > 2000 THEN 'document_over_ceiling' END, CASE WHEN b > 100000000 THEN 'store_over_100_mb' END], lambda x: x IS NOT NULL), '|')",
     {"l": ("double(length(text))", "length(text)::DOUBLE"), "b": ("double(length(text)) * 50000 + doc_id", "length(text)::DOUBLE * 50000 + doc_id")}, lambda c: joined(cache.storage_report(c("l"), 2000.0, c("b"))))
rule("health_lines", "events", "event_id", f"CASE WHEN s IN ('cooling_down', 'recovering', 'disabled', 'missing') THEN r || ' (' || coalesce(greatest(0, floor(u - {AS_OF})), 0)::BIGINT || 's; ' || s || ')' END",
     {"s": "CASE event_type WHEN 'error' THEN 'cooling_down' WHEN 'view' THEN 'recovering' WHEN 'click' THEN 'missing' WHEN 'signup' THEN 'disabled' ELSE 'working' END", "r": "props", "u": tuple(f"CASE WHEN user_id % 4 > 0 THEN {x} + 86400 * 5 END" for x in _AT)},
     lambda c: health.health_line(c("s"), c("r"), c("u"), F.lit(AS_OF)))

# --- Runs ------------------------------------------------------------------------------------------

rule("stop_checks", "conversations", "conv_id, turn", "coalesce(k = e, false) || '|' || (trim(coalesce(r, '')) <> '') || '|' || (e = 'sufficient' OR g > 0)",
     {"k": "CASE WHEN turn % 4 > 0 THEN role END", "r": "CASE turn % 3 WHEN 0 THEN ' ' WHEN 1 THEN text END", "g": "length(text) % 2", "e": "CASE WHEN conv_id % 2 = 0 THEN 'sufficient' ELSE 'user' END"},
     lambda c: F.concat_ws("|", *(evaluate.stop_checks(c("k"), c("r"), F.when(c("g") > 0, F.array(c("r"))).otherwise(F.array().cast("array<string>")), c("e"))[n].cast("string") for n in ("stop_kind", "stop_explained", "gaps_reported"))))
_WORDS = ("split(text, ' ')", "string_split(text, ' ')")
rule("extra_findings", "conversations", "conv_id, turn", "array_to_string(list_sort(list_filter(list_distinct(w[1:4]), lambda x: NOT list_contains(w[3:6], x))), '|')", {"w": _WORDS},
     lambda c: joined(evaluate.extra_findings(_map(F.slice("w", 1, 4)), _map(F.slice("w", 3, 4)))))
_ONE_LINE = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
rule("finding_evidence", "conversations", "conv_id, turn", f"(((turn % 5 = 0) OR ({_ONE_LINE('q')} <> '' AND turn % 7 > 0 AND contains(t, {_ONE_LINE('q')}))) AND (turn % 3 > 0 OR (turn % 5 > 0 AND contains({_ONE_LINE('q')}, {_ONE_LINE('h')}))))::VARCHAR",
     {"turn": "turn", "q": tuple(f"lower(trim({x}))" for x in ("array_join(slice(split(text, ' '), 2, 4), ' ')", "array_to_string(string_split(text, ' ')[2:5], ' ')")), "t": ("lower(array_join(filter(split(text, '\\\\s+'), x -> x <> ''), ' '))", "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"), "h": tuple(f"lower({x})" for x in ("get(split(text, ' '), cast(2 - turn % 2 as int))", "string_split(text, ' ')[3 - turn % 2]"))},
     lambda c: evaluate.evidence_ok(F.when(c("turn") % 5 > 0, F.array(F.struct(F.lit("u").alias("url"), c("q").alias("quote")))).otherwise(F.array().cast("array<struct<url:string,quote:string>>")),
                                    F.create_map(F.when(c("turn") % 7 > 0, "u").otherwise("v"), F.array(c("t"))), F.when(c("turn") % 3 == 0, F.create_map(F.lit("u"), c("h"))).otherwise(F.create_map().cast("map<string,string>"))))
_CALLS = {
    "tool": "CASE WHEN role = 'user' THEN 'web_search' ELSE 'read_url' END", "is_error": "length(text) % 7 = 0", "outcome": "CASE WHEN turn % 3 = 0 THEN 'empty' ELSE 'success' END", "page_status": "CASE length(text) % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'incomplete' WHEN 2 THEN 'odd' END",
    "retrieved_at": "CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN role END", "content": "text", "method": "CASE WHEN turn % 2 = 0 THEN 'http' END", "content_end": ("cast(length(text) as int)", "length(text)::INT"), "snapshot": "CASE WHEN turn % 6 > 0 THEN role END",
    "expected_text": "CASE WHEN turn % 5 = 0 THEN substring(text, 3, 5) WHEN turn % 5 = 1 THEN 'nowhere to be found' END", "expected_target": "CASE WHEN turn % 8 = 0 THEN '/y' END", "expected_method": "CASE WHEN turn % 3 = 1 THEN 'http' END", "access_probe": "conv_id % 4 = 0",
    "same": "length(text) % 3 > 0", "follows": "length(text) % 5 > 1", "next_start": ("cast(length(text) - length(text) % 2 as int)", "(length(text) - length(text) % 2)::INT"),
}
_check = lambda name, applies, ok: f"CASE WHEN {applies} THEN '{name}=' || coalesce({ok}, false) END"
_PASSED = ", ".join(_check(*x) for x in (
    ("tool_completed", "true", "NOT is_error"), ("results_available", "tool = 'web_search'", "outcome = 'success'"), ("retrieval_time_present", "tool = 'web_search'", "retrieved_at <> ''"),
    ("cache_provenance_preserved", "tool = 'web_search' AND outcome = 'success'", "same"), ("access_status_reported", "tool = 'read_url' AND access_probe", "is_error OR coalesce(page_status IN ('ok', 'incomplete', 'suspected_error'), false)"),
    ("page_ok", "tool = 'read_url' AND NOT access_probe", "page_status = 'ok'"), ("expected_text_present", "tool = 'read_url' AND expected_text <> ''", "contains(content, expected_text)"),
    ("relative_link_preserved", "tool = 'read_url' AND expected_target <> ''", "contains(content, '](/y)')"), ("expected_method_used", "tool = 'read_url' AND expected_method <> ''", "coalesce(method, '') = expected_method"),
    ("continuation_preserved", "tool = 'read_url' AND follows", "next_start = content_end"),
))
rule("call_checks", "conversations", "conv_id, turn", f"array_to_string(list_sort(list_filter([{_PASSED}], lambda x: x IS NOT NULL)), '|')", _CALLS,
     lambda c: joined(F.array_sort(F.transform(F.map_entries(evaluate.call_checks(_call(c))), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))))


def _map(names: Column) -> Column:
    return F.map_from_arrays(F.array_distinct(names), F.array_distinct(names))


def _call(c) -> Column:
    again = F.struct(F.lit(False).alias("is_error"), F.lit(True).alias("cache_hit"), c("same").alias("same"))
    follow = F.when(c("follows"), F.struct(F.lit(False).alias("is_error"), c("snapshot").alias("snapshot"), c("retrieved_at").alias("retrieved_at"), c("next_start").alias("start")))
    return F.struct(*(c(n).alias(n) for n in list(_CALLS)[:13]), again.alias("again"), follow.alias("next"))


# --- Rules on whole logs ---------------------------------------------------------------------------

_OK_SQL = f"SELECT user_id, event_id, stored_at FROM {_LOG_SQL}"


@query("cooldowns_active", f"SELECT user_id, max(stored_at + event_id % 7 * 86400) AS expires_at FROM {_LOG_SQL} WHERE event_type = 'error' GROUP BY user_id HAVING max(stored_at + event_id % 7 * 86400) > {AS_OF}")
def cooldowns_active(spark, d):
    """Cooldowns of up to six days after an error, where an earlier end never replaces a later one."""
    log = _log(spark, d).filter("event_type = 'error'").select("user_id", (F.col("stored_at") + F.col("event_id") % 7 * 86400).alias("expires_at"), F.col("stored_at").alias("updated_at"))
    return cache.active_cooldowns(cache.extend_cooldowns(log, "user_id"), F.lit(AS_OF), "user_id").select("user_id", "expires_at")


@query("health_pruned", f"SELECT event_id FROM {_LOG_SQL} WHERE NOT (stored_at < {AS_OF} - 20 * 86400 AND stored_at + event_id % 30 * 86400 <= {AS_OF})")
def health_pruned(spark, d):
    rows = _log(spark, d).select("event_id", F.col("stored_at").alias("updated_at"), (F.col("stored_at") + F.col("event_id") % 30 * 86400).alias("expires_at"))
    return cache.prune_health(rows, F.lit(AS_OF), 20).select("event_id")


@query(
    "snapshots_live",
    f"""WITH f AS (SELECT user_id, min(stored_at) AS stored_at, arg_min(payload, (stored_at, event_id)) AS payload FROM {_LOG_SQL} GROUP BY user_id),
    n AS (SELECT * FROM f WHERE stored_at >= {AS_OF} - 2592000 ORDER BY stored_at DESC, user_id LIMIT 100)
    SELECT user_id FROM (SELECT user_id, sum(strlen(payload)) OVER (ORDER BY stored_at DESC, user_id ROWS UNBOUNDED PRECEDING) AS total FROM n) WHERE total <= 1500""",
)
def snapshots_live(spark, d):
    """First writes of each user, of the last thirty days, the newest hundred, 1,500 bytes in all."""
    log = _log(spark, d).select("user_id", "stored_at", "event_id", "payload")
    return cache.live_snapshots(cache.put_snapshots(log, "user_id"), F.lit(AS_OF), "user_id", 100, 1500, 2592000.0).select("user_id")


@query(
    "backend_epochs",
    f"""SELECT event_id, (sum(changed) OVER (PARTITION BY user_id ORDER BY stored_at, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS epoch FROM (
    SELECT *, coalesce((event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY stored_at, event_id))::INT, 0) AS changed FROM {_LOG_SQL})""",
)
def backend_epochs(spark, d):
    """Stretches of a user's events of one type, as evidence is kept per configuration."""
    return health.epochs(_log(spark, d), "user_id", "event_type", "stored_at", "event_id").select("event_id", "epoch")


@query(
    "recovery_deferred",
    """SELECT event_id, event_id % 3 = 0 AND row_number() OVER (PARTITION BY user_id, event_id % 3 = 0 ORDER BY event_id) > 1 AS deferred FROM events""",
)
def recovery_deferred(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, "recovery_due").otherwise("working").alias("status"))
    return health.one_recovering(rows, "user_id", "event_id").select("event_id", "deferred")


@query("inventory_overlay", "SELECT DISTINCT user_id AS engine, CASE WHEN user_id % 5 = 0 THEN 'missing' WHEN user_id % 7 = 0 THEN 'disabled' ELSE 'working' END AS status, user_id % 5 <> 0 AS configuration_verified FROM events")
def inventory_overlay(spark, d):
    users = table(spark, d, "events").select(F.col("user_id").alias("engine")).distinct()
    known = users.filter("engine % 5 <> 0").withColumn("enabled", F.col("engine") % 7 != 0)
    return health.overlay_inventory(users.withColumn("status", F.lit("working")), known).select("engine", "status", "configuration_verified")


@query("passages_by_url", "SELECT conv_id // 2 AS url, count(*) AS passages, sum(length(text))::BIGINT AS chars FROM conversations WHERE turn % 3 <> 1 AND role <> 'system' GROUP BY conv_id // 2")
def passages_by_url(spark, d):
    c = F.col("conv_id")
    calls = table(spark, d, "conversations").select(F.floor(c / 2).alias("url"), F.col("text").alias("content"), F.when(F.col("turn") % 3 != 1, "ok").otherwise("incomplete").alias("page_status"), (F.col("role") == "system").alias("is_error"))
    found = evaluate.passages_by_url(calls)
    return found.select("url", F.size("passages").cast("long").alias("passages"), F.aggregate("passages", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("chars"))


@query("unknown_cases", "SELECT DISTINCT conv_id AS id FROM conversations WHERE conv_id % 4 = 0")
def unknown_cases(spark, d):
    ids = table(spark, d, "conversations").select(F.col("conv_id").alias("id")).distinct()
    return evaluate.unknown_cases(ids, ids.filter("id % 4 <> 0"))


@query("policy_digest", """SELECT sha256('[' || string_agg('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}', ',' ORDER BY r_regionkey) || ']') AS digest FROM region""")
def policy_digest(spark, d):
    return table(spark, d, "region").agg(digest("r_regionkey", "r_name").alias("digest"))
