"""Main content of a page as Markdown, and its controls, from one walk over the repaired tree.

The walk (an Arrow UDF) gives a page's blocks in order: Markdown, words, words in links, whether a landmark takes
them out (navigation, footer, form ...), whether they stand in an article or main element, and whether they stand in
the container that holds most words outside links. Which blocks are content is decided by column expressions over
that array."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.text import WORD
from gleaner.operators.html import _joined, read_in_parts
from gleaner.operators.tree import HEADINGS, SPECIAL, Tree
from gleaner.sources.staging import bounded_batches

# Tags that carry meaning here.
HIDDEN = {"head", "iframe", "noscript", "object", "script", "style", "svg", "math", "template", "textarea", "title", "select"}
OUTSIDE = {"aside", "button", "dialog", "footer", "form", "menu", "nav"}
WITHIN = {"article", "main"}
CONTAINERS = {"article", "body", "div", "main", "section", "td", "blockquote"}
BLOCKS = SPECIAL - HIDDEN
MAX_CONTROLS, MAX_LABEL, MAX_SELECTOR = 30, 120, 300
MAX_INDENT = 8  # levels; deeper lists and quotes stand at this one
MORE = re.compile(r"(load|show|read) more(?:\s|$)", re.I)
WORDS = re.compile(r"\w+")

STRUCTURE = T.StructType(
    [
        T.StructField(
            "blocks",
            T.ArrayType(
                T.StructType(
                    [T.StructField("kind", T.StringType()), T.StructField("markdown", T.StringType()), T.StructField("words", T.IntegerType()), T.StructField("link_words", T.IntegerType())]
                    + [T.StructField(c, T.BooleanType()) for c in ("outside", "within", "densest", "joins")]
                )
            ),
        ),
        T.StructField("controls", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "selector", "label")]))),
    ]
)


class _Walk(Tree):
    def __init__(self, url: str):
        self.url, self.base = url, None
        self.blocks: list[dict] = []
        self.hidden = self.outside = self.within = self.quotes = self.pre = self.forms = 0
        self.lists: list[int | None] = []  # of each open list the number of its next item, None if it has no numbers
        self.item = ""  # the mark of the list item that has begun
        self.heading = 0
        self.words = self.link_words = 0
        self.line: list[str] = []
        self.link: tuple[int, str] | None = None
        self.rows: list[list[str]] = []  # cells of each open table row
        self.tables: list[int] = []  # rows of each open table
        self.containers: list[list] = []  # [score, first block, blocks] of each open container
        self.best = [0, 0, 0]
        self.texts: list[str] = []
        self.controls: list[list] = []
        super().__init__()

    def text(self, data: str) -> None:
        self.texts.append(data)
        if self.hidden or not data:
            return
        self.line.append(data)
        n = len(WORDS.findall(data))
        self.words += n
        if self.link:
            self.link_words += n

    def opened(self, node, attrs) -> None:
        tag = node.tag
        kind = "expand" if tag == "details" else "tab" if attrs.get("role") == "tab" and tag != "a" else "load_more" if tag == "button" else None
        if kind and not self.forms:
            node.note = len(self.controls)
            self.controls.append([kind, node, len(self.texts)])
        self.forms += tag == "form"
        if tag in BLOCKS:
            self._flush()
        if tag in HIDDEN:
            self.hidden += 1
        if tag == "base" and self.base is None and attrs.get("href"):
            self.base = _joined(self.url, attrs["href"])
        elif tag == "br":
            self.line.append("\n")
        elif tag == "a" and attrs.get("href"):
            target = _joined(self.base or self.url, attrs["href"]) or ""
            self.link = (len(self.line), target if target.startswith(("http://", "https://")) else "")
        elif tag == "img" and attrs.get("alt", "").strip() and not self.hidden:
            self.line.append(attrs["alt"])
        self.outside += tag in OUTSIDE or (tag == "header" and not self.within)
        if tag == "header" and not self.within:
            node.note = "outside"
        self.within += tag in WITHIN
        self.quotes += tag == "blockquote"
        self.pre += tag == "pre"
        if tag in ("ul", "ol", "menu"):
            self.lists.append(1 if tag == "ol" else None)
        elif tag == "li":
            number = self.lists[-1] if self.lists else None
            self.item = "  " * min(MAX_INDENT, max(0, len(self.lists) - 1)) + ("- " if number is None else f"{number}. ")
            if number is not None:
                self.lists[-1] += 1
        elif tag in HEADINGS:
            self.heading = int(tag[1])
        elif tag == "table":
            self.tables.append(0)
        elif tag == "tr":
            self.rows.append([])
        if tag in CONTAINERS:
            self.containers.append([0.0, len(self.blocks), 0])

    def closed(self, node) -> None:
        tag = node.tag
        if type(node.note) is int:
            kind, _, start = self.controls[node.note]
            label = _label(self.texts, start)
            self.controls[node.note] = [kind, node, label] if kind != "load_more" or MORE.match(label) else None
        self.forms -= tag == "form"
        if tag == "a":
            self._end_link()
        if tag in BLOCKS:
            self._flush(cell=tag in ("td", "th"))
        if tag in HIDDEN:
            self.hidden -= 1
        self.outside -= tag in OUTSIDE or (tag == "header" and node.note == "outside")
        self.within -= tag in WITHIN
        self.quotes -= tag == "blockquote"
        self.pre -= tag == "pre"
        if tag in ("ul", "ol", "menu"):
            self.lists.pop()
        elif tag == "li":
            self.item = ""
        elif tag in HEADINGS:
            self.heading = 0
        elif tag == "tr":
            self._row(self.rows.pop())
        elif tag == "table":
            self.tables.pop()
        if tag in CONTAINERS:
            score, first, _ = self.containers.pop()
            if score > self.best[0]:
                self.best = [score, first, len(self.blocks)]
            if self.containers:  # what an inner container holds counts half for the one around it
                self.containers[-1][0] += score / 2

    def _end_link(self) -> None:
        if self.link:
            at, target = self.link
            words = " ".join("".join(self.line[at:]).split())
            if target and words and not self.hidden:
                before = "".join(self.line[at:])
                self.line[at:] = [" " * before[:1].isspace(), f"[{words}]({target})", " " * before[-1:].isspace()]
            self.link = None

    def _flush(self, cell: bool = False) -> None:
        self._end_link()
        raw, words, linked = "".join(self.line), self.words, self.link_words
        self.line, self.words, self.link_words = [], 0, 0
        text = raw.strip("\n") if self.pre else "\n".join(x for line in raw.split("\n") if (x := " ".join(line.split())))
        if self.rows and not self.pre:
            row = self.rows[-1]
            if text or cell:
                row.append((" ".join(text.split()).replace("|", "\\|"), words, linked, cell))
            return
        if not text.strip():
            return
        kind, mark = "text", ""
        if self.pre:
            kind, text = "code", "```\n" + text + "\n```"
        elif self.heading:
            kind, text = "heading", "#" * self.heading + " " + " ".join(text.split())
        elif self.lists:
            kind, mark = "item", self.item or "  " * min(MAX_INDENT, len(self.lists))
            self.item = ""
        quote = "> " * min(MAX_INDENT, self.quotes)
        pad = quote + " " * len(mark)
        self._block(kind, quote + mark + text.replace("\n", "\n" + pad), words, linked, kind == "item")

    def _row(self, parts: list) -> None:
        cells, words, linked, held = [], 0, 0, []
        for text, n, m, ends in parts:
            held += [text] if text else []
            words, linked = words + n, linked + m
            if ends:
                cells.append(" ".join(held))
                held = []
        if held:
            cells.append(" ".join(held))
        if not any(cells):
            return
        if self.rows:  # a table within a cell: its text joins that cell
            self.rows[-1].append((" ".join(c for c in cells if c), words, linked, False))
            return
        first = bool(self.tables) and self.tables[-1] == 0
        if self.tables:
            self.tables[-1] += 1
        line = "| " + " | ".join(cells) + " |"
        self._block("row", line + ("\n|" + " --- |" * len(cells) if first else ""), words, linked, not first)

    def _block(self, kind: str, markdown: str, words: int, linked: int, joins: bool) -> None:
        outside = self.outside > 0
        if self.containers and not outside:
            self.containers[-1][0] += words - linked
        joins = joins and bool(self.blocks) and self.blocks[-1]["kind"] == kind
        self.blocks.append({"kind": kind, "markdown": markdown, "words": words, "link_words": linked, "outside": outside, "within": self.within > 0, "densest": False, "joins": joins})

    def result(self, most: float, longest: float) -> dict:
        _, first, end = self.best
        for block in self.blocks[first:end]:
            block["densest"] = True
        out = []
        for kind, node, label in filter(None, self.controls):
            if path := node.path(longest):
                out.append({"kind": kind, "selector": path, "label": label})
            if len(out) == most:
                break
        return {"blocks": self.blocks, "controls": out}


def _label(texts: list[str], start: int) -> str:
    """The first characters of the texts from there, joined by blanks and without blanks around them."""
    out = ""
    for k in range(start, len(texts)):
        out = (out + " " + texts[k]) if out else texts[k].lstrip()
        if len(out) > MAX_LABEL and out[MAX_LABEL:].strip():
            return out[:MAX_LABEL]
    return out.rstrip()[:MAX_LABEL]


def read_structure(source: str | None, url: str | None, most: float = MAX_CONTROLS, longest: float = MAX_SELECTOR) -> dict:
    """Blocks and controls of a page, so many of these at most and with paths of so many characters; of a page that the
    parser gives up on, what came before."""
    walk = _Walk(url or "")
    try:
        walk.feed(source or "")
    except (AssertionError, ValueError):
        pass
    walk.finish()
    return walk.result(most, longest)


@F.pandas_udf(STRUCTURE)
def structured(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    yield from read_in_parts(read_structure, STRUCTURE.names)(batches)


@F.pandas_udf(STRUCTURE)
def whole(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    yield from read_in_parts(partial(read_structure, most=math.inf, longest=math.inf), STRUCTURE.names)(batches)


structured, whole = structured.asNondeterministic(), whole.asNondeterministic()  # see html.parsed


def with_structure(pages: DataFrame, html_col: str = "html", url_col: str = "url", every_control: bool = False) -> DataFrame:
    """pages with `structure`: blocks and controls, the first short paths of these or every one. Paths of every control
    grow with the square of a page's depth."""
    bounded_batches(pages.sparkSession)
    return pages.withColumn("structure", (whole if every_control else structured)(F.col(html_col), F.col(url_col)))


MIN_SHARE = 0.25  # of the candidates' words that an article or main element must hold to be the content alone
LINKS = 0.5  # a block with a larger share of its words in links is no candidate


def main_blocks(blocks: Column) -> Column:
    """The blocks that are content. Candidates stand in no landmark outside it and are not mostly links, unless an
    article or main element holds them. Article and main elements are the content if they hold MIN_SHARE of the
    candidates' words; else the densest container is; without one all candidates are."""
    candidates = F.filter(blocks, lambda b: ~b["outside"] & (b["within"] | (b["link_words"] <= LINKS * b["words"])))
    words = lambda some: F.aggregate(some, F.lit(0), lambda n, b: n + b["words"])
    within, densest = F.filter(candidates, lambda b: b["within"]), F.filter(candidates, lambda b: b["densest"])
    by_landmark = (words(within) > 0) & (words(within) >= MIN_SHARE * words(candidates))
    return F.when(by_landmark, within).when(words(densest) > 0, densest).otherwise(candidates)


def markdown(blocks: Column) -> Column:
    return F.array_join(F.transform(blocks, lambda b, k: F.concat(F.when(k == 0, "").when(b["joins"], "\n").otherwise("\n\n"), b["markdown"])), "")


def main_content(structure: Column, basic: Column) -> Column:
    """(content, method, warnings): the content blocks as Markdown, or the basic text with a warning if they hold no
    word."""
    text = markdown(main_blocks(structure["blocks"]))
    held = F.coalesce(text.rlike(WORD), F.lit(False))
    return F.struct(
        F.when(held, text).otherwise(basic).alias("content"),
        F.when(held, "http+blocks").otherwise("http+basic_html").alias("method"),
        F.when(held, F.array().cast("array<string>")).otherwise(F.array(F.lit("main_extraction_fallback"))).alias("warnings"),
    )
