"""Read fields out of one HTML text. Runs inside Spark tasks; knows nothing of Spark.

Elements are kept in document order with the position where each one ends, so looking at the
inside of an element is a walk over a range and deep nesting needs no recursion.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser

# Elements that never have content, and elements whose text is not page text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style template rt rp".split())

# Elements whose content a parser may treat as raw text, depending on its version.
RAW = set("textarea title".split())
UNUSUAL = set("iframe noembed noframes noscript plaintext xmp".split())

# Tags, comments and document types in their regular form, which every parser reads alike.
_REGULAR = re.compile(
    r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s+[a-zA-Z][-a-zA-Z0-9_]*(?:=(?:"[^"]*"|'[^']*'))?)*)\s*(/?)>"""
    r"""|<!--[^->][^-]*(?:-[^-]+)*-->|<![dD][oO][cC][tT][yY][pP][eE]\s[^<>"'\[\]]*>"""
)
_ATTRIBUTE = re.compile(r"""\s+([a-zA-Z][-a-zA-Z0-9_]*)(?:=(?:"([^"]*)"|'([^']*)'))?""")
_RAW_END = re.compile(r"<!--|</\s*(?:script|style)", re.IGNORECASE)
_OPEN_REFERENCE = re.compile(r"&(?!#?[a-zA-Z0-9]+;)")


@dataclass(frozen=True)
class Step:
    """Go to the nth matching element inside the current one, or among its next siblings."""

    tag: str
    css: str | None = None
    id: str | None = None
    nth: int = 0
    sibling: bool = False


@dataclass(frozen=True)
class Rule:
    """Follow the steps, then take 'text', 'count' (of the last step) or an attribute."""

    steps: tuple[Step, ...]
    take: str = "text"
    default: str | None = None


class PageElements(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self._clear()
        if not self._read_regular(html):
            self._clear()
            self.feed(html)
            self.close()
        for place in self._open:
            self.ends[place] = len(self.tags)

    def _clear(self):
        self.tags: list[str | None] = []
        self.values: list = []
        self.ends: list[int] = []
        self.parents: list[int] = []
        self._open: list[int] = []
        self._open_count: dict[str, int] = {}
        self._silent = 0

    def _read_regular(self, html):
        """Read a page of regular tags only; False as soon as anything else turns up.

        Several times faster than the full parser, which then reads the page instead.
        """
        at, raw = 0, None
        while True:
            begin = html.find("<", at)
            stop = len(html) if begin < 0 else begin
            if stop > at:
                text = html[at:stop]
                self.handle_data(unescape(text) if "&" in text else text)
            if begin < 0:
                return raw is None
            token = _REGULAR.match(html, begin)
            if token is None:
                return False
            at = token.end()
            slash, tag, attributes, empty = token.groups()
            if raw is not None:
                if not slash or tag.lower() != raw:
                    return False
                raw = None
            if tag is None:
                continue
            tag = tag.lower()
            if slash:
                if attributes or empty:
                    return False
                self.handle_endtag(tag)
                continue
            attrs = []
            if attributes:
                if "&" in attributes and _OPEN_REFERENCE.search(attributes):
                    return False
                for name, double, single in _ATTRIBUTE.findall(attributes):
                    attrs.append((name.lower(), unescape(double or single)))
            if empty:
                self.handle_startendtag(tag, attrs)
                continue
            self.handle_starttag(tag, attrs)
            if tag in self.CDATA_CONTENT_ELEMENTS or tag in UNUSUAL:
                begin = html.find(f"</{tag}>", at)
                if begin < 0 or tag in UNUSUAL or _RAW_END.search(html, at, begin):
                    return False
                self.handle_data(html[at:begin])
                at = begin
            elif tag in RAW:
                raw = tag

    def updatepos(self, i, j):
        """Line numbers are not wanted."""
        return j

    def _add(self, tag, value):
        self.tags.append(tag)
        self.values.append(value)
        self.parents.append(self._open[-1] if self._open else -1)
        self.ends.append(len(self.tags))
        return len(self.tags) - 1

    def handle_starttag(self, tag, attrs):
        place = self._add(tag, {name: value or "" for name, value in attrs})
        if tag not in VOID:
            self._open.append(place)
            self._open_count[tag] = self._open_count.get(tag, 0) + 1
            self._silent += tag in SILENT

    def handle_startendtag(self, tag, attrs):
        self._add(tag, {name: value or "" for name, value in attrs})

    def handle_endtag(self, tag):
        if not self._open_count.get(tag):
            return
        while True:
            place = self._open.pop()
            name = self.tags[place]
            self.ends[place] = len(self.tags)
            self._open_count[name] -= 1
            self._silent -= name in SILENT
            if name == tag:
                return

    def handle_data(self, data):
        if not self._silent:
            self._add(None, data)

    def _matches(self, place, step):
        if self.tags[place] != step.tag:
            return False
        attrs = self.values[place]
        if step.id is not None and attrs.get("id") != step.id:
            return False
        if step.css is not None:
            tokens = attrs.get("class", "").split()
            return step.css in tokens or step.css == " ".join(tokens)
        return True

    def find_all(self, place, step):
        """Matching elements inside `place`; -1 stands for the whole page."""
        if step.sibling:
            parent = self.parents[place]
            stop = self.ends[parent] if parent >= 0 else len(self.tags)
            inside = (
                i for i in range(self.ends[place], stop) if self.parents[i] == parent
            )
        else:
            inside = range(place + 1, self.ends[place] if place >= 0 else len(self.tags))
        return (i for i in inside if self._matches(i, step))

    def follow(self, place, steps):
        for step in steps:
            for seen, found in enumerate(self.find_all(place, step)):
                if seen == step.nth:
                    place = found
                    break
            else:
                return None
        return place

    def text(self, place):
        span = range(place + 1, self.ends[place])
        return "".join(self.values[i] for i in span if self.tags[i] is None)

    def read(self, place, rule):
        if rule.take == "count":
            holder = self.follow(place, rule.steps[:-1])
            if holder is None:
                return rule.default
            return str(sum(1 for _ in self.find_all(holder, rule.steps[-1])))
        found = self.follow(place, rule.steps)
        if found is None:
            return rule.default
        if rule.take == "text":
            return self.text(found)
        return self.values[found].get(rule.take, rule.default)

    def pairs(self, place, table, row, label, value):
        """(label text, value text) of every row of a table that has both."""
        holder = self.follow(place, (table,))
        found = []
        if holder is not None:
            for line in self.find_all(holder, row):
                name, content = self.follow(line, (label,)), self.follow(line, (value,))
                if name is not None and content is not None:
                    found.append({"key": self.text(name), "value": self.text(content)})
        return found


@dataclass(frozen=True)
class PageSpec:
    """What to read from a page.

    One record per element that the last of the `records` steps matches, or one for the
    whole page without steps.
    """

    fields: dict[str, Rule]
    records: tuple[Step, ...] = ()
    pairs: tuple[Step, Step, Step, Step] | None = None
    markers: tuple[str, ...] = ()


def page_records(html: str | None, spec: PageSpec) -> list[dict]:
    """Raw texts of each record; a page that cannot be read gives one record with an error."""
    try:
        page = PageElements(html or "")
    except (AssertionError, ValueError) as problem:
        return [{"pos": 0, "page_error": str(problem) or "unreadable page"}]
    places = [-1]
    if spec.records:
        holder = page.follow(-1, spec.records[:-1])
        places = [] if holder is None else page.find_all(holder, spec.records[-1])
    records = []
    for pos, place in enumerate(places):
        record = {name: page.read(place, rule) for name, rule in spec.fields.items()}
        record["pos"] = pos
        record["page_error"] = None
        if spec.pairs:
            record["pairs"] = page.pairs(place, *spec.pairs)
        records.append(record)
    return records
