"""One pass over a page's HTML in an Arrow UDF: title, text, links, date, attribution, structure."""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.text import _published
from gleaner.sources.staging import bounded_batches

# Tags and keys that carry meaning here.
BLOCKED = {"script", "style", "noscript", "svg"}
BREAKING = {"p", "div", "li", "br", "h1", "h2", "h3", "h4", "tr"}
DATE_KEYS = {"article:published_time", "date", "datecreated", "datepublished", "dc.date", "og:published_time", "publishdate", "pubdate"}
ORIGIN_KEYS = {"original-source", "syndication-source"}
APP_ROOTS = {"__next", "__nuxt", "app", "app-root", "application", "root"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
UNSEEN = {"script", "style", "svg", "template"}  # whose text no reader sees; that of noscript is told apart
WHOLE = re.compile(r"&[#A-Za-z0-9]+;")  # a character reference with its semicolon
ESCAPED = re.compile(r"&(?:quot|lt|gt|#x27|amp);")  # what escaping a text leaves
PART_CHARS = 1_000_000

# What a start tag tells of the date and of the origin of a page.
DATED = [
    lambda tag, a: (a["content"], f"html_meta:{key}") if tag == "meta" and (key := _meta_key(a)) in DATE_KEYS and a.get("content") else None,
    lambda tag, a: (a["datetime"], "html_time") if tag == "time" and a.get("datetime") else None,
]
ORIGINS = [
    lambda tag, a: a.get("href", "") if tag == "link" and "canonical" in a.get("rel", "").lower().split() else None,
    lambda tag, a: a.get("content", "") if tag == "meta" and a.get("name", "").lower() in ORIGIN_KEYS else None,
]


def _meta_key(a: dict) -> str:
    return (a.get("property") or a.get("name") or a.get("itemprop") or "").casefold()


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


SCHEMA = T.StructType(
    [
        *_strings("title", "text"),
        T.StructField("links", T.ArrayType(T.StringType())),
        *_strings("published_at", "published_at_source", "attribution"),
        T.StructField("probe", T.StructType([T.StructField("script_count", T.IntegerType()), T.StructField("app_root_seen", T.BooleanType()), *_strings("app_root_text", "noscript_text", "body_text")])),
    ]
)


class _Reader(HTMLParser):
    """How many of each kind of element are open is counted, so that depth costs nothing."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.base = url, None
        self.out, self.title, self.links, self.dates, self.origin = [], [], [], [], None
        self.scripts, self.root_seen, self.root, self.noscript, self.body = 0, False, [], [], []
        self.stack: list[tuple[str, bool]] = []  # tag, whether an app root
        self.within: Counter = Counter()  # of each open tag; under "" the app roots
        self.json_ld = None

    def _any(self, tags) -> bool:
        return any(self.within[t] for t in tags)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "base" and self.base is None and a.get("href"):
            self.base = _joined(self.url, a["href"])
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        for found in (value for rule in DATED + ORIGINS if (value := rule(tag, a)) is not None):
            if isinstance(found, tuple):
                self.dates.append(found)
            else:
                self.origin = found
        if tag == "script":
            self.scripts += 1
            if a.get("type", "").casefold() == "application/ld+json":
                self.json_ld = []
        if tag in BREAKING:
            self.out.append("\n")
        root = a.get("id", "").strip().lower() in APP_ROOTS or "data-reactroot" in a or "data-react-root" in a
        self.root_seen = self.root_seen or root
        if tag in VOID and not root:
            return
        self.stack.append((tag, root))
        self.within[tag] += 1
        self.within[""] += root

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BREAKING and tag != "br":
            self.out.append("\n")
        if tag == "script" and self.json_ld is not None:
            try:
                self.dates += [(str(v), "json_ld:datePublished") for v in _values(json.loads("".join(self.json_ld)), "datePublished")]
            except (ValueError, RecursionError):
                pass
            self.json_ld = None
        while self.within[tag]:
            top, root = self.stack.pop()
            self.within[top] -= 1
            self.within[""] -= root
            if top == tag:
                break

    def handle_data(self, data):
        if self.json_ld is not None:
            self.json_ld.append(data)
        if self.within["noscript"]:
            self.noscript.append(data)
        if not self._any(UNSEEN):
            if self.within[""]:
                self.root.append(data)
            if self.within["body"] and not self.within["noscript"]:
                self.body.append(data)
        if self._any(BLOCKED):
            return
        self.out.append(WHOLE.sub(lambda m: html.unescape(m[0]), data))  # a second time: kept, as a page may be escaped twice
        if self.within["title"]:
            self.title.append(ESCAPED.sub(lambda m: html.unescape(m[0]), data))  # no other reference: a title may be cut within one

    def result(self) -> dict:
        base = self.base or self.url
        links = [link for href in self.links if (link := _joined(base, href) or "").startswith(("http://", "https://"))]
        published = next(((d, s) for v, s in self.dates if (d := _published(v))), (None, None))
        origin = None if self.origin is None else _joined(self.url, self.origin)
        lines = (" ".join(x.split()) for x in "".join(self.out).splitlines())
        return {
            "title": " ".join(re.sub(r"&amp\Z", "&", " ".join(self.title)).split()),
            "text": "\n\n".join(x for x in lines if x),
            "links": list(dict.fromkeys(links)),
            "published_at": published[0],
            "published_at_source": published[1],
            "attribution": origin if origin and origin.startswith(("http://", "https://")) else None,
            "probe": {"script_count": self.scripts, "app_root_seen": self.root_seen, "app_root_text": " ".join(self.root), "noscript_text": " ".join(self.noscript), "body_text": " ".join(self.body)},
        }


def _joined(base: str, href: str) -> str | None:
    try:
        return urljoin(base, href)
    except ValueError:
        return None


def _values(document, key: str) -> list:
    """What stands under a key at any depth, in reading order."""
    out, waiting = [], [document]
    while waiting:
        value = waiting.pop()
        if isinstance(value, dict):
            out += [value[key]] if key in value else []
            waiting += reversed(value.values())
        elif isinstance(value, list):
            waiting += reversed(value)
    return out


def read_page(source: str | None, url: str | None) -> dict:
    """Everything of a page; of one that the parser gives up on, what came before."""
    reader = _Reader(url or "")
    try:
        reader.feed(source or "")
        reader.close()
    except (AssertionError, ValueError, RecursionError):
        pass
    return reader.result()


def read_in_parts(read: Callable[[str | None, str | None], dict], names: list[str]):
    """A pandas UDF's body over pages (html, url): a batch is answered in parts of at most PART_CHARS characters of
    HTML, so that only the batch itself is held whole."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for sources, urls in batches:
            part, chars = [], 0
            for source, url in zip(sources, urls):
                part.append(read(source, url))
                chars += len(source or "")
                if chars >= PART_CHARS:
                    yield pd.DataFrame(part, columns=names)
                    part, chars = [], 0
            if part or not len(sources):
                yield pd.DataFrame(part, columns=names)

    return run


@F.pandas_udf(SCHEMA)
def parsed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    yield from read_in_parts(read_page, SCHEMA.names)(batches)


parsed = parsed.asNondeterministic()  # it is not, but a filter that Spark infers for an explode would read every page again


def with_document(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """pages with `document`, everything read from the HTML in one pass."""
    bounded_batches(pages.sparkSession)
    return pages.withColumn("document", parsed(F.col(html_col), F.col(url_col)))
