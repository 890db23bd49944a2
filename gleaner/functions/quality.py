"""Rules on pages and responses: diagnostics, status, routing, failures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import compact, meaningful, published_at

# The phrases of error pages, interstitials and placeholders, in order of their rules.
JAVASCRIPT_REQUIRED = (
    r"^(?:please )?(?:enable|turn on) javascript[.! ]*$|"
    r"\bplease (?:enable|turn on) javascript\b|"
    r"\byou need to enable javascript to run this app\b|"
    r"\b(?:enable|turn on) javascript (?:in your browser|to (?:access|continue|proceed|use|view))\b|"
    r"\bjavascript is required(?: to (?:access|continue|proceed|use|view))?\b|"
    r"\b(?:this|the) (?:app|application|page|site) requires javascript\b|"
    r"\bdoesn['\x{2019}]t work properly without javascript\b"
)
LOADING_PLACEHOLDER = r"^(?:loading|loading[.]{1,3}|please wait|redirecting|initializing|waiting for javascript)[.!\x{2026} ]*$"
BROWSER_CHECK = r"^(?:just a moment|checking your browser|verifying (?:that )?you are human|performing security verification|please stand by)[.!\x{2026} ]*$"
SOFT_NOT_FOUND = r"(?:^|\b)(?:404|page not found|not found|page (?:does not|doesn['\x{2019}]t) exist)(?:\b|$)"
SERVER_ERROR = r"(?:^|\b)(?:500|502|503|504|internal server error|bad gateway|service unavailable|gateway timeout|web server is down|origin is unreachable)(?:\b|$)"
ACCESS_DENIED = r"^(?:access denied|forbidden|request blocked|unauthorized)(?:\b|\s*[-:|])"
CLOUDFLARE_ERROR = r"\b(52[0-7])\b"
CHALLENGE_TITLE = r"^(?:just a moment|checking your browser|security (?:check|verification)|verify (?:that )?you are (?:a )?human|attention required[! ]*\|\s*cloudflare)[.!\x{2026} ]*$"
CHALLENGE_PROMPT = (
    r"^\b(?:verify (?:that )?you are (?:a )?human|verifying (?:that )?you are human|checking your browser|performing security verification|"
    r"please (?:solve|complete) (?:the |this )?(?:captcha|security check)|enable javascript and cookies to continue)\b"
)
CHALLENGE_MARKERS = ["verifying your browser", "just a moment", "attention required", "cf-chl", "challenge-platform", "antibot", "pardon our interruption", "enable javascript and cookies"]
LOCAL_FAULT_TERMS = ["network policy", "local network", "transfer limit", "byte limit", "ssl connect", "certificate", "could not resolve", "dns", "cancelled", "saturated", "no result", "proxy"]
UPSTREAM_WAIT_TERMS = ["recaptcha", "captcha", "access denied", "blocked", "suspended", "too many", "rate limit", "403", "429"]
QUOTA_TERMS = ["429", "too many", "rate limit"]
DENIAL_TERMS = ["captcha", "access denied", "403", "blocked"]
CONNECTION_TERMS = ["timeout", "timed out", "connection", "reset", "503"]
INCOMPLETE_WARNINGS = [
    "browser_recommended:", "browser_output_incomplete:", "browser_render_skipped:", "document_page_unreadable:", "document_pages_truncated:",
    "ocr_unavailable:", "ocr_failed:", "content_truncated:", "browser_content_filtered", "text_decoding_lossy",
]
UNCACHEABLE_WARNINGS = ["browser_output_incomplete:", "browser_fallback_failed:", "browser_result_rejected:"]
STRUCTURAL_SIGNALS = ["minimal_text", "no_content_elements", "script_heavy_shell"]
BACKEND_GUIDANCE = "Access failure is not evidence of absence. Read known URLs or use an accessible alternative; avoid immediately retrying blocked engines."
EMPTY_GUIDANCE = "No matches. Try a more specific query, another language, or a known source URL."
READ_GUIDANCE = "Inspect warnings before using this page. Try rendering, a visual, or another source if relevant text is missing."
WAITS = {"local": 120, "recaptcha": 604800, "cloudflare captcha": 1296000, "quota": 3600, "denial": 86400, "connection": 120, "other": 300}


def ci(pattern: str) -> str:
    return "(?i)" + pattern


def any_term(text: Column, terms: list[str]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(text, F.lit(term))
    return found


def any_prefix(warnings: Column, prefixes: list[str]) -> Column:
    return F.exists(warnings, lambda w: w.rlike("^(?:" + "|".join(prefixes) + ")"))


def page_diagnostics(title: Column, content: Column, status: Column) -> Column:
    """Signs of an error page, in order, each once."""
    head = compact(title)
    body = compact(F.substring(content, 1, 4000))
    both = F.lower(F.concat_ws(" ", head, body))
    challenge = head.rlike(ci(CHALLENGE_TITLE)) | ((F.length(content) < 2000) & F.ltrim(F.regexp_replace(body, r"^[# *]+", "")).rlike(ci(CHALLENGE_PROMPT)))
    edge = head.rlike(CLOUDFLARE_ERROR) & any_term(both, ["cloudflare", "ssl handshake failed", "web server", "origin"])
    kind = (
        F.when(edge, F.concat(F.lit("cloudflare_"), F.regexp_extract(head, CLOUDFLARE_ERROR, 1)))
        .when(head.rlike(ci(SOFT_NOT_FOUND)), "soft_404")
        .when(head.rlike(ci(SERVER_ERROR)), "server_error")
        .when(head.rlike(ci(ACCESS_DENIED)), "access_denied")
    )
    return F.array_distinct(F.array_compact(F.array(F.when(status >= 400, F.concat(F.lit("http_"), status.cast("string"))), F.when(challenge, F.lit("bot_challenge")), kind)))


def error_titles(title: Column) -> Column:
    """Signs of an error page that its title alone gives; of no title, none."""
    head = compact(F.coalesce(title, F.lit("")))
    return F.array_compact(F.array(F.when(head.rlike(ci(SOFT_NOT_FOUND)), F.lit("soft_404")), F.when(head.rlike(ci(SERVER_ERROR)), F.lit("server_error"))))


def rendering_signals(content: Column) -> Column:
    """Signs that a text is what a page shows before its scripts run."""
    whole = compact(content)
    lines = F.filter(F.transform(F.split(content, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"), lambda x: compact(x)), lambda x: x != "")
    alone = F.when(F.size(lines) == 2, F.element_at(lines, -1)).otherwise(whole)
    found = F.array(
        F.when(whole.rlike(ci(JAVASCRIPT_REQUIRED)), F.lit("javascript_required")),
        F.when(alone.rlike(ci(LOADING_PLACEHOLDER)), F.lit("loading_placeholder")),
        F.when(alone.rlike(ci(BROWSER_CHECK)), F.lit("browser_check_interstitial")),
    )
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.array_compact(found))


def html_quality(probe: Column, title: Column, content: Column, status: Column) -> Column:
    """browser_reasons and diagnostics of a page; probe as `operators.html` makes it."""
    signals, diagnostics = rendering_signals(content), page_diagnostics(title, content, status)
    shell = (
        F.when(probe["app_root_seen"] & (probe["script_count"] > 0) & ~meaningful(probe["app_root_text"]), "empty_app_shell")
        .when((probe["script_count"] > 0) & ~meaningful(probe["body_text"]), "script_only_page")
        .when(~meaningful(content), "no_extracted_content")
    )
    more = F.array(
        F.when(F.array_contains(rendering_signals(probe["noscript_text"]), "javascript_required"), F.lit("javascript_required")),
        shell,
        F.when(F.array_contains(diagnostics, "bot_challenge"), F.lit("browser_check_interstitial")),
        F.when(F.array_contains(diagnostics, "access_denied"), F.lit("access_denied")),
        F.when(status.isin(401, 403, 429), F.concat(F.lit("http_"), status.cast("string"))),
    )
    return F.struct(F.array_distinct(F.concat(signals, F.array_compact(more))).alias("browser_reasons"), diagnostics.alias("diagnostics"))


def needs_rendering(title: Column, content: Column, warnings: Column) -> Column:
    asked = any_prefix(warnings, ["browser_recommended:", "possibly_incomplete:"])
    return (F.size(rendering_signals(content)) > 0) | asked | F.array_contains(page_diagnostics(title, content, F.lit(None).cast("int")), "bot_challenge")


def has_error(title: Column, content: Column, status: Column, warnings: Column) -> Column:
    return (F.size(page_diagnostics(title, content, status)) > 0) | any_prefix(warnings, ["suspected_error_page:"])


def cacheable(title: Column, content: Column, status: Column, warnings: Column) -> Column:
    bad = needs_rendering(title, content, warnings) | has_error(title, content, status, warnings) | any_prefix(warnings, UNCACHEABLE_WARNINGS)
    return meaningful(content) & ~bad


def page_status(status: Column, warnings: Column) -> Column:
    return (
        F.when(F.coalesce(status >= 400, F.lit(False)) | any_prefix(warnings, ["suspected_error_page:"]), "suspected_error")
        .when(any_prefix(warnings, INCOMPLETE_WARNINGS), "incomplete")
        .otherwise("ok")
    )


def content_kind(content_type: Column, head: Column, path: Column) -> Column:
    """html, binary, json, unsupported or text, from the declared type, the first bytes as text and the path."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    start = F.lower(F.ltrim(head))
    html = kind.isin("text/html", "application/xhtml+xml") | ((kind == "") & (F.startswith(start, F.lit("<!doctype html")) | F.startswith(start, F.lit("<html"))))
    text = F.startswith(kind, F.lit("text/")) | kind.isin("", "application/xml") | F.endswith(kind, F.lit("+xml"))
    return (
        F.when((kind == "application/pdf") | F.startswith(head, F.lit("%PDF-")) | kind.isin("image/png", "image/jpeg", "image/webp"), "binary")
        .when(html, "html")
        .when((kind == "application/json") | F.endswith(kind, F.lit("+json")) | F.endswith(F.lower(path), F.lit(".json")), "json")
        .when(text, "text")
        .otherwise("unsupported")
    )


def response_problem(status: Column, content_type: Column, body: Column) -> Column:
    """Why a search backend's answer cannot be used, the first of this order; null if it can."""
    parsed = F.try_parse_json(body)
    return (
        F.when(status.isin(429, 503), F.concat(F.lit("rate_limited_"), status.cast("string")))
        .when(status == 403, "access_denied")
        .when(status >= 400, F.concat(F.lit("http_"), status.cast("string")))
        .when(~F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("json")), "non_json")
        .when(parsed.isNull(), "malformed_json")
        .when(~F.ltrim(body).startswith("{"), "not_an_object")
        .when(~F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, "$.results", "variant")).startswith("ARRAY"), F.lit(False)), "no_results_array")
    )


def challenge_marker(body: Column) -> Column:
    """The first marker of the list that a body holds; '' if none."""
    text = F.lower(body)
    return F.coalesce(*(F.when(F.contains(text, F.lit(m)), F.lit(m)) for m in CHALLENGE_MARKERS), F.lit(""))


def local_fault(reason: Column) -> Column:
    return any_term(F.lower(reason), LOCAL_FAULT_TERMS)


def upstream_declared_wait(reason: Column) -> Column:
    return any_term(F.lower(reason), UPSTREAM_WAIT_TERMS)


def failure_delay(reason: Column) -> Column:
    """Seconds to wait after a failure for this reason."""
    text = F.lower(reason)
    return (
        F.when(local_fault(reason), WAITS["local"])
        .when(F.contains(text, F.lit("recaptcha")), WAITS["recaptcha"])
        .when(F.contains(text, F.lit("cloudflare")) & F.contains(text, F.lit("captcha")), WAITS["cloudflare captcha"])
        .when(any_term(text, QUOTA_TERMS), WAITS["quota"])
        .when(any_term(text, DENIAL_TERMS), WAITS["denial"])
        .when(any_term(text, CONNECTION_TERMS), WAITS["connection"])
        .otherwise(WAITS["other"])
    )


def query_needs_rendering(query: Column, title: Column, body: Column) -> Column:
    """Whether the title answers to the query while the body does not; all three as token arrays."""
    return F.arrays_overlap(query, title) & ~F.arrays_overlap(query, body)


def route(render: str, needs: Column, http: Column, rendered: Column) -> Column:
    """The reading to keep of two structs (title, content, status_code, warnings): `never` and an `auto` that needs
    nothing keep the HTTP one; else the rendered one, unless it is an error or incomplete and the HTTP one is sound."""
    if render == "never":
        return http
    of = lambda d: (d["title"], d["content"], d["status_code"], d["warnings"])
    title, content, status, warnings = of(rendered)
    bad = has_error(title, content, status, warnings) | needs_rendering(title, content, warnings) | ~meaningful(content) | any_prefix(warnings, ["browser_output_incomplete:"])
    chosen = F.when(rendered.isNull() | (http.isNotNull() & cacheable(*of(http)) & bad), http).otherwise(rendered)
    return chosen if render == "always" else F.when(http.isNotNull() & ~needs, http).otherwise(chosen)


def outcome(results: Column, failed: Column) -> Column:
    """success, empty or backend_unavailable."""
    return F.when(failed, "backend_unavailable").when(results > 0, "success").otherwise("empty")


def search_guidance(outcome: Column) -> Column:
    return F.when(outcome == "backend_unavailable", F.array(F.lit(BACKEND_GUIDANCE))).when(outcome == "empty", F.array(F.lit(EMPTY_GUIDANCE))).otherwise(F.array().cast("array<string>"))


def read_guidance(status: Column) -> Column:
    return F.when(status != "ok", F.array(F.lit(READ_GUIDANCE))).otherwise(F.array().cast("array<string>"))


def header_warnings(filtered: Column) -> Column:
    """A warning for each header name a policy removed; those of the response are marked with a leading '-'."""
    return F.transform(filtered, lambda x: F.when(F.startswith(x, F.lit("-")), F.concat(F.lit("response_header_dropped:"), F.substr(x, F.lit(2)))).otherwise(F.concat(F.lit("request_header_dropped:"), x)))


def structural_recovery(success: Column, markdown: Column, status: Column, message: Column) -> Column:
    """The one weak structural signal that a page with text disproves; null if the block stands."""
    reason = F.rtrim(F.regexp_replace(F.regexp_extract(message, r"^Blocked by anti-bot protection: Structural: (\S+) on small page", 1), r"[.,]+$", ""))
    fits = ~success & (F.trim(markdown) != "") & status.between(200, 299) & reason.isin(STRUCTURAL_SIGNALS)
    return F.when(fits, reason)


def valid_arguments(query: Column, limit: Column, page: Column, range_: Column) -> Column:
    return F.length(query).between(1, 2000) & limit.between(1, 20) & page.between(1, 10) & (range_.isNull() | range_.isin("day", "month", "year"))


# What an action on a page may and must name.
ACTION_FIELDS = ("selector", "frame", "x", "y", "text", "duration_ms")
ACTIONS = {
    "scroll": (set(), []),
    **{kind: ({"selector", "frame"}, [{"selector"}]) for kind in ("expand", "tab", "load_more", "click")},
    "click_at": ({"x", "y"}, [{"x"}, {"y"}]),
    "wait_for": ({"text", "duration_ms"}, [{"text", "duration_ms"}]),
}


def action_problem(action: Column) -> Column:
    """What is wrong with an action (kind and ACTION_FIELDS): unknown_kind, extra:<field> or missing:<fields>; null if
    nothing. Empty texts and a duration of 0 count as not named, but for scroll, which takes nothing at all."""
    given = {f: action[f].isNotNull() for f in ACTION_FIELDS}
    named = {f: given[f] & (action[f] != ("" if f in ("selector", "frame", "text") else 0)) if f not in ("x", "y") else given[f] for f in ACTION_FIELDS}
    out = F.when(~action["kind"].isin(*ACTIONS), "unknown_kind")
    for kind, (allowed, needed) in ACTIONS.items():
        here = action["kind"] == kind
        for group in needed:
            missing = F.lit(True)
            for f in sorted(group):
                missing = missing & ~F.coalesce(named[f], F.lit(False))
            out = out.when(here & missing, "missing:" + "|".join(sorted(group)))
        for f in ACTION_FIELDS:
            if f not in allowed:
                out = out.when(here & F.coalesce(given[f] if kind == "scroll" else named[f], F.lit(False)), f"extra:{f}")
    return out


def markdown_choice(plain: Column, raw: Column, fit: Column) -> Column:
    """(text, filtered): a plain text, else the raw Markdown if it says anything, else the filtered one."""
    kept = F.when(plain.isNotNull(), plain).when(F.trim(raw) != "", raw).otherwise(F.coalesce(fit, F.lit("")))
    return F.struct(kept.alias("text"), (plain.isNull() & ~F.coalesce(F.trim(raw) != "", F.lit(False)) & fit.isNotNull()).alias("filtered"))


def metadata_date(*values: Column) -> Column:
    """The first value that is not empty, normalised; a later one does not stand in for one that is no date."""
    return published_at(F.coalesce(*(F.nullif(v, F.lit("")) for v in values)))


def effective_status(last_hop: Column, first_hop: Column) -> Column:
    return F.coalesce(last_hop.try_cast("int"), first_hop.try_cast("int"))


def chosen_engines(asked: Column, configured: Column) -> Column:
    """The one configured engine asked for, in its very spelling, or all where none is asked for; null for another."""
    return F.when(asked.isNull(), configured).when(F.array_contains(configured, asked), F.array(asked))


def search_warnings(failed: Column, timed_out: Column, reason: Column, seconds: int = 30) -> Column:
    return F.array_compact(F.array(F.when(timed_out, F.lit(f"search_timeout:{seconds}s")), F.when(failed & ~timed_out, F.concat(F.lit("search_failed: "), reason))))
