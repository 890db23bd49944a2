"""Main text of web pages by consensus paths per host.

First pass: every page is read into a tree, each container is scored by the words it holds outside
links, menus, headers, footers, sidebars, notices, adverts, forms and reader comments, and the
page's best container votes for its path, a chain of tag.class steps from the root with digits
generalised. Spark adds up the votes of a host (tasks send partial sums). Second pass: each page
takes, of the paths it has, the one that won most votes on its host, and all its containers of that
path in page order; without one, its own best. A path that holds less than a tenth of the page's own
best is passed over.

The best container is the one of most words, articles and the like counting twice; it is widened
to what it has in common with other containers of a quarter of its words and more, with the page's
h1, and with the article around it, and to its parent where headings or paragraphs stand beside it.

What is noise: tags such as nav and form with all they hold, and elements whose class or id names
it (`sidebar`, `cookie-notice`), but not those that only mention it (`with-sidebar`,
`notice-board`), that also name content (`main-content`), or without which next to nothing is left.

A path is consensus with at least two votes and a hundredth of the host's (`least_share`); the vote
table so has at most a hundred paths a host. It is written to the shared folder, so the planner
knows its size: under the broadcast threshold the pages stay where they are, beyond it they are
shuffled by host with skewed hosts split.

The text: character references decoded, white space within a block one space, blocks joined by one
space in page order; markup, comments, scripts and styles left out.

Cases: a null or empty page, and one without text, gives an empty text of length 0. A null or
unreadable url is host '' and votes with its like. Rows repeating a page_id are separate pages that
give one row each. Unclosed, crossed or stray tags and truncated pages are read to their end; the
time is in proportion to the page, however long it is or deeply it nests. An empty table gives no rows. Other columns
are kept under their names, but text and n_chars replace columns so called, whatever their case.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import fresh, q, without, written

LEAST_SHARE = 0.01  # of a host's votes, and two at least, make a path consensus

# The tags of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "template", "xmp")
DROPPED = frozenset("nav footer aside form script style noscript template button select option textarea iframe svg math object canvas audio video dialog menu head title".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article main section div body td blockquote".split())
CLOSES_P = BLOCKS - {"br", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "option", "optgroup"}
CLOSES_SAME = {t: (same.split(), until.split()) for t, same, until in (("li", "li", "ul ol menu dir"), ("dt", "dt dd", "dl"), ("dd", "dt dd", "dl"), ("tr", "tr td th", "table"), ("td", "td th", "tr table"), ("th", "td th", "tr table"), ("option", "option", "select"), ("p", "p", ""))}
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# Names of noise in class and id tokens: anywhere in a token, or as all or the end of one.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promos promotion sidebar menu navbar nav navigation breadcrumb breadcrumbs footer masthead "
    "cookie cookies consent gdpr popup modal newsletter subscribe subscription signup comment comments commentlist disqus share sharing social toolbar pagination pager login".split()
)
NOISE_END = frozenset("banner notice related recommended widget widgets replies respond reply searchbox search sidebox topbar".split())
NOISE_PAIR = re.compile(r"(?:related|recommended|site|page|search|skip|side|widget|notice|banner|more)-(?:posts?|articles?|links?|stories|items?|news|reading|header|head|form|box|bar|list|wrapper|container|area)$")
MENTIONS = frozenset("with has have no without show hide is not".split())
NOISE_ROLE = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
GOOD = frozenset("article content entry post story main body text".split())
SURE = frozenset("article main articlebody".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*(?=>|$)|[^>]*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|itemprop|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
END_OF = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"[0-9]+")


@lru_cache(maxsize=4096)
def _judged(marks: str) -> tuple[bool, bool]:
    """(names noise, names content) of the class and id of an element."""
    noise = good = False
    for token in marks.replace("_", "-").split():
        parts = [x for x in token.split("-") if x]
        named = GOOD.intersection(parts)
        if not parts or parts[0] in MENTIONS:
            continue
        if not NOISE.intersection(parts) and not parts[-1] in NOISE_END and not NOISE_PAIR.search(token):
            good = good or bool(named)
        elif not named or parts[-1] not in GOOD:
            noise = True
    return noise and not good, good


@lru_cache(maxsize=4096)
def path_key(path: str) -> int:
    key = 0
    for step in path.split(">") if path else ():
        key = _next_key(key, step)
    return key


def _next_key(key: int, step: str) -> int:
    return xxhash.xxh64_intdigest(step.encode("utf-8", "surrogatepass"), key)


class Node:
    __slots__ = ("tag", "step", "up", "noise", "soft", "good", "sure", "inside", "start", "end", "words", "linked", "own", "depth", "key", "box")

    def __init__(self, tag: str, step: str, up: Node | None, start: int, noise: bool = False, soft: bool = False, good: bool = False, sure: bool = False):
        self.tag, self.step, self.up, self.start, self.noise, self.good, self.sure = tag, step, up, start, noise, good, sure
        self.soft = self if soft else up.soft if up else None  # the nearest element that is named as noise
        self.inside = sure or (up is not None and up.inside)
        self.end, self.words, self.linked, self.own = -1, 0, 0, 0
        self.depth = 0 if up is None else up.depth + 1
        self.key = 0 if up is None else _next_key(up.key, step)
        self.box = self if up is None or tag in CONTAINERS else up.box

    def path(self) -> str:
        steps, node = [], self
        while node is not None and node.step:
            steps.append(node.step)
            node = node.up
        return ">".join(reversed(steps))

    def prose(self) -> int:
        return self.words - self.linked


def common(a: Node, b: Node) -> Node:
    """The lowest element that holds both."""
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
    return a


class Page:
    """A tolerant reading: containers with what they hold, and the pieces of text with their place."""

    def __init__(self, source: str):
        self.root = Node("", "", None, 0)
        self.nodes: list[Node] = [self.root]
        self.pieces: list[tuple[str, Node]] = []  # text, or "" for the end of a block, and its element
        self.open: Counter = Counter()
        self.named: dict[int, Node] = {}  # elements named as noise
        self.heads: list[Node] = []
        self.kept: set[int] = set()
        self._read(source)
        self._keep_the_rest()

    def _read(self, source: str) -> None:
        node, at, pieces = self.root, 0, self.pieces
        n = len(source)
        while at < n:
            m = TOKEN.search(source, at)
            if m is None:
                self._text(source[at:], node)
                break
            if m.start() > at:
                self._text(source[at : m.start()], node)
            at = max(m.end(), at + 1)
            tag = m[2]
            if tag is None:
                if m[0].startswith("<![CDATA["):
                    self._text(m[0][9:].removesuffix("]]>"), node)
                continue
            tag = tag.lower()
            if m[1]:
                node = self._close(node, tag)
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    pieces.append(("", node))
                continue
            if tag in CLOSES_P:
                node = self._close_implied(node, ("p",), ("td", "th", "button", "object", "caption"))
            if tag in CLOSES_SAME:
                node = self._close_implied(node, *CLOSES_SAME[tag])
            if tag in ("body", "html") and self.open[tag]:
                continue
            node = self._open(node, tag, m[3] or "")
            if tag in END_OF:
                end = END_OF[tag].search(source, at)
                self._text(source[at : end.start() if end else n], node)
                at = end.end() if end else n
                node = self._leave(node)
        while node.up is not None:
            node = self._leave(node)
        self.root.end = len(pieces)

    def _open(self, up: Node, tag: str, attributes: str) -> Node:
        noise, sure, step = up.noise or tag in DROPPED or (tag == "header" and not up.inside), tag in ("article", "main"), tag
        good, soft = sure, False
        if attributes.strip():
            seen = {}
            for a in ATTRIBUTE.finditer(attributes):
                seen.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or ""))
            marks = f"{seen.get('class', '')} {seen.get('id', '')}".lower()
            role = seen.get("role", "").lower()
            if marks.strip():
                named, content = _judged(marks)
                good, soft = good or content, named and not sure and tag not in ("body", "html")
                first = (seen.get("class", "").split() or [""])[0] or "#" + seen.get("id", "")
                step = f"{tag}.{DIGITS.sub('N', first).replace('>', '')}"
            sure = sure or role in ("main", "article") or seen.get("itemprop", "").lower() == "articlebody"
            good = good or sure
            noise = noise or role in NOISE_ROLE or "hidden" in seen or seen.get("aria-hidden", "").lower() == "true" or "display:none" in seen.get("style", "").replace(" ", "").lower()
        node = Node(tag, step, up, len(self.pieces), noise, soft, good, sure)
        self.open[tag] += 1
        if tag in BLOCKS:
            self.pieces.append(("", up))
        if tag in CONTAINERS and not noise:
            self.nodes.append(node)
        if soft and not noise:
            self.named[id(node)] = node
        if tag == "h1" and not noise and node.soft is None:
            self.heads.append(node)
        return node

    def _leave(self, node: Node) -> Node:
        node.end = len(self.pieces)
        self.open[node.tag] -= 1
        if node.tag in BLOCKS:
            self.pieces.append(("", node.up))
        if not node.noise and node.soft is not node:
            node.up.words += node.words
            node.up.linked += node.words if node.tag == "a" else node.linked
        return node.up

    def _close(self, node: Node, tag: str) -> Node:
        if not self.open[tag]:
            return node
        while node.tag != tag:
            node = self._leave(node)
        return self._leave(node)

    def _close_implied(self, node: Node, tags: tuple, until: tuple) -> Node:
        """Closes the innermost of these tags, unless a container or one of `until` stands between."""
        if not any(self.open[t] for t in tags):
            return node
        found = node
        while found.tag not in tags:
            if found.up is None or found.tag in until or found.tag in CONTAINERS:
                return node
            found = found.up
        while node is not found:
            node = self._leave(node)
        return self._leave(node)

    def _text(self, raw: str, node: Node) -> None:
        if node.noise:
            return
        text = html.unescape(raw) if "&" in raw else raw
        self.pieces.append((text, node))
        n = len(text.split())
        node.words += n
        if node.soft is None:
            node.box.own += n

    def _keep_the_rest(self) -> None:
        """What is named as noise stays where next to nothing is left without it."""
        while self.named:
            most = max(self.named.values(), key=lambda x: (x.words, -x.start))
            if self.root.words * 10 >= most.words:
                return
            node = most
            while node is not None:  # elements around it stay as well
                if node.soft is node and id(node) not in self.kept:
                    self.kept.add(id(node))
                    del self.named[id(node)]
                    up = node.up
                    while up is not None:
                        up.words += node.words
                        up.linked += node.linked
                        if up.soft is up and id(up) not in self.kept:
                            break
                        up = up.up
                node = node.up

    def live(self, node: Node) -> bool:
        """Whether neither the element nor one around it is left out as noise."""
        soft, passed = node.soft, []
        while soft is not None and soft not in self._dead():
            if id(soft) not in self.kept:
                self._dead()[soft] = True
                break
            passed.append(soft)
            soft = soft.up.soft
        dead = soft is not None and self._dead()[soft]
        for x in passed:
            self._dead()[x] = dead
        return not dead

    def _dead(self) -> dict[Node, bool]:
        if not hasattr(self, "_of"):
            self._of: dict[Node, bool] = {}
        return self._of

    def best(self) -> Node | None:
        """The best container, widened as the module says; of equal ones the innermost."""
        open_ = [x for x in self.nodes if x.words and self.live(x)]
        if not open_:
            return None
        score = lambda x: (max(x.prose(), 0) or x.words / 1e6) * (2 if x.good else 1)
        top = max(map(score, open_))
        found = max((x for x in open_ if score(x) >= 0.8 * top), key=lambda x: (x.good, x.depth, -x.start))
        least = found.prose() / 4
        for x in open_:
            around, within = x.start <= found.start and x.end >= found.end, x.start >= found.start and x.end <= found.end
            if x.prose() >= max(least, 1) and 3 * x.linked < x.words and not around and not within:
                found = common(found, x)
        if len(self.heads) == 1 and (wide := common(found, self.heads[0])).tag not in ("", "html", "body"):
            found = wide
        if found.inside:
            while not found.sure:
                found = found.up
        found = found.box
        while (up := found.up) is not None and (box := up.box).own and box.words - found.words - box.own <= box.own and self.live(box):
            found = box
        return found

    def find(self, path: str) -> list[Node]:
        """The containers of this path, in page order."""
        if not hasattr(self, "by_key"):
            self.by_key: dict[int, list[Node]] = {}
            for x in self.nodes:
                if x.words and self.live(x):
                    self.by_key.setdefault(x.key, []).append(x)
        return self.by_key.get(path_key(path), [])

    def text(self, nodes: Node | list[Node]) -> str:
        out: list[str] = []
        for node in [nodes] if isinstance(nodes, Node) else nodes:
            block: list[str] = []
            for piece, at in itertools.islice(self.pieces, node.start, node.end + 1):
                if piece:
                    if at.soft is None or self.live(at):
                        block.append(piece)
                elif block:
                    if line := SPACE.sub(" ", "".join(block)).strip():
                        out.append(line)
                    block = []
            if block and (line := SPACE.sub(" ", "".join(block)).strip()):
                out.append(line)
        return " ".join(out)

    def main_text(self, paths: list[str]) -> str:
        """The text of the first of these paths that the page has, else of its own best container."""
        best = self.best()
        if best is None:
            return ""
        for path in paths:
            nodes = self.find(path)
            if nodes and sum(x.prose() for x in nodes) * 10 >= best.prose():
                return self.text(nodes)
        return self.text(best)


def host_of(url):
    """The host of a url column, lower-cased; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: Counter = Counter()

    def out():
        keys = list(sums)
        cols = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([sums[k] for k in keys], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["host", "path", "votes"])

    for batch in batches:
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if source:
                page = Page(source)
                if (best := page.best()) is not None:
                    sums[host, best.path()] += 1
        if len(sums) > 50_000:
            yield out()
            sums.clear()
    yield out()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_columns
        texts = []
        for source, paths in zip(batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist()):
            texts.append(Page(source).main_text(paths or []) if source else "")
        cols = [batch.column(k) for k in range(n - 2)]
        names = [batch.schema.field(k).name for k in range(n - 2)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string())], names=[*names, "text"])


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html", least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, paths): the consensus paths of each host, most votes first, ties by path."""
    votes = pages.select(host_of(q(url_col)).alias("host"), q(html_col).alias("html")).mapInArrow(_votes, "host string, path string, votes long")
    votes = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    share = F.col("votes") / F.sum("votes").over(W.partitionBy("host"))
    top = votes.withColumn("share", share).filter((F.col("votes") > 1) & (F.col("share") >= least_share))
    return top.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path"))), lambda x: x["path"]).alias("paths"))


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages without html_col, with text and n_chars (its code points), which replace columns of these names."""
    of, host, found, page = (fresh(x, pages) for x in ("page_host", "path_host", "host_paths", "page_html"))
    paths = written(host_paths(pages, url_col, html_col), "host-paths").toDF(host, found)
    kept = without(pages, html_col, "text", "n_chars")
    n = len(kept.columns)
    flat = pages.select(*(q(c) for c in kept.columns), host_of(q(url_col)).alias(of), q(html_col).alias(page))
    flat = flat.join(paths, q(of) == q(host), "left").select(*(q(c) for c in kept.columns), q(page), q(found)).toDF(*(f"c{k}" for k in range(n + 2)))
    schema = T.StructType([*(T.StructField(f"c{k}", f.dataType) for k, f in enumerate(kept.schema)), T.StructField("text", T.StringType())])
    return flat.mapInArrow(_extract, schema).toDF(*kept.columns, "text").withColumn("n_chars", F.length("text").cast("long"))
