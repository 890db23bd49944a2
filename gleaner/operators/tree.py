"""A page's elements with the end tags and elements that HTML leaves out, told to a listener as they open and close.

Nothing is kept but the open elements and, for each, how many children of a type it has had, so paths by
`nth-of-type` are those a browser would give. Whether an element is in scope is a count kept for the innermost
boundary, not a walk over the open elements: a page of any depth takes time in proportion to its length.
Formatting elements are not opened again in the next block, which changes no path of other elements.
"""

from __future__ import annotations

from html.parser import HTMLParser

# Element names that the rules for parsing HTML single out.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
IN_HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROWS, CELLS, SECTIONS = {"tr"}, {"td", "th"}, {"tbody", "thead", "tfoot"}
TABLE_PARTS = {"caption", "col", "colgroup"} | ROWS | CELLS | SECTIONS
IN_TABLE = {"table"} | SECTIONS | ROWS
CLOSES_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dd", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "header",
    "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "plaintext", "pre", "listing", "search", "section", "summary", "table", "ul", "xmp",
} | HEADINGS
SPECIAL = (CLOSES_P | TABLE_PARTS | {"applet", "body", "button", "frameset", "head", "html", "iframe", "marquee", "noscript", "object", "select", "template", "textarea", "title"}) - {"dialog", "col"}
GENERAL = {"applet", "caption", "html", "table", "td", "th", "marquee", "object", "template"}
STOPS = {"scope": GENERAL, "p": GENERAL | {"button"}, "list": GENERAL | {"ol", "ul"}, "item": SPECIAL - {"address", "div", "p", "li", "dd", "dt"}, "table": {"html", "table", "template"}, "plain": SPECIAL}


def _kinds(tag: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(boundaries that an element of this name sets, within which boundaries it is looked for)"""
    asked = ["p"] if tag == "p" else ["list", "item"] if tag == "li" else ["item", "scope"] if tag in ("dd", "dt") else ["table"] if tag in TABLE_PARTS | {"table"} else ["scope"] if tag in SPECIAL | {"dialog"} else ["plain"]
    return tuple(k for k, stops in STOPS.items() if tag in stops), tuple(asked)


class _Known(dict):
    def __missing__(self, tag):
        found = _kinds(tag)
        if len(self) < 1000:  # names that pages make up are not kept without end
            self[tag] = found
        return found


KINDS = _Known()


class Node:
    __slots__ = ("tag", "nth", "parent", "types", "note")

    def __init__(self, tag: str, nth: int, parent: Node | None):
        self.tag, self.nth, self.parent, self.types, self.note = tag, nth, parent, None, None

    def child(self, tag: str) -> int:
        """Counts a child of this type; its number."""
        if self.types is None:
            self.types = {}
        n = self.types[tag] = self.types.get(tag, 0) + 1
        return n

    def path(self, longest: float) -> str | None:
        """html:nth-of-type(1) > ..., or nothing if it is longer; so many steps at most are taken."""
        parts, room, node = [], longest, self
        while node is not None:
            parts.append(f"{node.tag}:nth-of-type({node.nth})")
            room -= len(parts[-1]) + 3
            if room < -3:
                return None
            node = node.parent
        return " > ".join(reversed(parts))


class Tree(HTMLParser):
    """Override opened, closed and text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[Node] = []
        self.counts: dict[str, list[dict[str, int]]] = {kind: [{}] for kind in STOPS}
        self.body = self.form = None
        self._push("html", {}, None)

    def opened(self, node: Node, attrs: dict) -> None: ...

    def closed(self, node: Node) -> None: ...

    def text(self, data: str) -> None: ...

    def has(self, kind: str, *tags: str) -> bool:
        """Whether an element of such a name is open within the innermost boundary of this kind."""
        here = self.counts[kind][-1]
        return bool(here) and any(here.get(t) for t in tags)

    def _push(self, tag: str, attrs: dict, parent: Node | None, stays: bool = True) -> None:
        node = Node(tag, parent.child(tag) if parent else 1, parent)
        if stays:
            self.open.append(node)
            sets, asked = KINDS[tag]
            for kind in sets:
                self.counts[kind].append({})
            for kind in asked:
                here = self.counts[kind][-1]
                here[tag] = here.get(tag, 0) + 1
        self.opened(node, attrs)
        if not stays:
            self.closed(node)

    def _pop(self) -> Node:
        node = self.open.pop()
        sets, asked = KINDS[node.tag]
        for kind in asked:
            self.counts[kind][-1][node.tag] -= 1
        for kind in sets:
            self.counts[kind].pop()
        self.closed(node)
        return node

    def _close(self, *tags: str) -> None:
        while self._pop().tag not in tags:
            pass

    def _back_to(self, *tags: str) -> None:
        while self.open[-1].tag not in tags and len(self.open) > 1:
            self._pop()

    def _need_body(self) -> None:
        if self.body is None:
            self._back_to("html")
            self._push("body", {}, self.open[0])
            self.body = self.open[-1]

    def _place(self, tag: str) -> Node:
        """Where an element goes: what is no part of a table stands before it."""
        top = self.open[-1]
        if top.tag not in IN_TABLE or tag in TABLE_PARTS or tag in {"script", "style", "template"}:
            return top
        while top.tag != "table":
            top = top.parent
        return top.parent or self.open[0]

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}  # of an attribute that repeats the first counts
        if tag == "html":
            return
        if self.body is None and tag in IN_HEAD | {"head"}:
            if not any(n.tag == "head" for n in self.open[:2]):
                if self.open[0].types and self.open[0].types.get("head"):
                    self._insert(tag, a)  # after the head, before the body: kept at the top
                    return
                self._push("head", a if tag == "head" else {}, self.open[0])
            if tag != "head":
                self._insert(tag, a)
            return
        if tag in ("head", "frameset"):
            return
        if tag == "body":
            if self.body is None:
                self._back_to("html")
                self._push("body", a, self.open[0])
                self.body = self.open[-1]
            return
        self._need_body()
        if tag in TABLE_PARTS:
            if not self.has("table", "table"):
                return
            self._table_part(tag, a)
            return
        if tag == "form":
            if self.form is not None:
                return
        elif tag == "table" and self.open[-1].tag in IN_TABLE:
            self._close("table")
        elif tag == "button" and self.has("scope", "button"):
            self._close("button")
        elif tag == "a" and self.has("plain", "a"):
            self._close("a")
        elif tag == "li" and self.has("item", "li"):
            self._close("li")
        elif tag in ("dd", "dt") and self.has("item", "dd", "dt"):
            self._close("dd", "dt")
        elif tag in ("option", "optgroup") and self.open[-1].tag in ("option", tag):
            self._pop()
        if tag in CLOSES_P and self.has("p", "p"):
            self._close("p")
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._pop()
        self._insert(tag, a)
        if tag == "form":
            self.form = self.open[-1]

    def _insert(self, tag: str, a: dict) -> None:
        self._push(tag, a, self._place(tag), tag not in VOID)

    def _table_part(self, tag: str, a: dict) -> None:
        if tag in CELLS | ROWS | SECTIONS | {"caption", "colgroup"} and self.has("table", "caption", *CELLS):
            self._close("caption", *CELLS)
        if tag in CELLS:
            self._back_to("tr", "table", *SECTIONS, "template")
            if self.open[-1].tag != "tr":
                if self.open[-1].tag == "table":
                    self._push("tbody", {}, self.open[-1])
                self._push("tr", {}, self.open[-1])
        elif tag == "tr":
            self._back_to("table", *SECTIONS, "template")
            if self.open[-1].tag == "table":
                self._push("tbody", {}, self.open[-1])
        elif tag == "col":
            if self.open[-1].tag != "colgroup":
                self._back_to("table", "template")
                self._push("colgroup", {}, self.open[-1])
        else:
            self._back_to("table", "template")
        self._insert(tag, a)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.open[-1].tag == tag and self.has("plain", "svg", "math"):  # elsewhere the slash means nothing
            self._pop()

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if tag == "head":
            if self.body is None and len(self.open) > 1:
                self._back_to("html")
            return
        if tag in ("p", "br"):
            self._need_body()
        if tag == "p" and not self.has("p", "p"):
            self._push("p", {}, self._place("p"), stays=False)
        elif tag == "br":
            self._push("br", {}, self._place("br"), stays=False)
        elif tag in HEADINGS:
            if self.has("scope", *HEADINGS):
                self._close(*HEADINGS)
        elif tag == "form":
            self.form = None
            if self.has("scope", "form"):
                self._close("form")
        else:
            kind = "p" if tag == "p" else "list" if tag == "li" else "table" if tag in TABLE_PARTS or tag == "table" else "scope" if tag in SPECIAL or tag == "dialog" else "plain"
            if self.has(kind, tag):
                self._close(tag)

    def handle_data(self, data):
        if self.body is None and (data.isspace() or self.open[-1].tag not in ("html", "head")):
            self.text(data)  # of a title, script or style
            return
        self._need_body()
        self.text(data)

    def finish(self) -> None:
        self.close()
        while self.open:
            self._pop()
