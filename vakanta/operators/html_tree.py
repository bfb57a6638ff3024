"""Reading one stored page: text, outgoing partner link, and titled blocks.

A small helper for the Arrow pass in ``pages.py``. Unclosed tags stay open until an enclosing tag closes,
and text inside scripts, styles, templates and ruby notes, comments and declarations do not count.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser
from itertools import islice

# Elements without content, elements whose text is not page text, elements that keep spaces.
VOID_TAGS = {
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img",
    "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr",
}
HIDDEN_TAGS = {"script", "style", "template", "rt", "rp"}
SPACED_TAGS = {"pre", "textarea"}
HEADER_TAGS = {"h2", "h3"}
RAW_TAGS = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}

# Markup that every version of the standard parser reads alike: text, end tags, start tags whose attributes have no value or a
# quoted one, and, as a whole, elements with raw text, comments and document types.
_NAME = "[a-zA-Z][a-zA-Z0-9]*"
_ATTRIBUTES = r"""(?:[ \t\n\r\f]+[a-zA-Z][a-zA-Z0-9:_-]*(?:="[^"]*"|='[^']*')?)*[ \t\n\r\f]*"""
PLAIN = re.compile(
    rf"(?P<text>[^<]+)|</(?P<end>{_NAME})>"
    rf"|(?P<whole><(?P<code>script|style){_ATTRIBUTES}>[^<]*(?:<(?!/)[^<]*)*</(?P=code)>|<(?P<words>title|textarea){_ATTRIBUTES}>[^<]*</(?P=words)>"
    r"|<!--(?!-?>)[^-]*(?:-[^-]+)*-->|<!(?i:doctype)[^>]*>)"
    rf"|<(?P<start>{_NAME})(?P<attributes>{_ATTRIBUTES})(?P<slash>/?)>"
)


class Element:
    """An element knows its range in the page's list of strings, so its text needs no walk of the tree.

    It does not know its parent: without cycles a page's elements are let go of as soon as it is read.
    """

    __slots__ = ("tag", "children", "place", "start", "end")

    def __init__(self, tag, place, start):
        self.tag, self.children, self.place, self.start, self.end = tag, [], place, start, None


class PageReader(HTMLParser):
    """Headings, with what follows them, and anchors are noted as they open; open elements that hide or keep text are counted.

    ``headers`` holds (heading, elements of its parent, its place) and ``strongs`` (heading, elements around its parent, the parent's place).
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.strings = []
        self.headers, self.strongs, self.anchors = [], [], []
        self.root = Element("", 0, 0)
        self.open = [self.root]
        self.open_count = {}
        self.hidden = self.spaced = 0
        self.pending = []

    def updatepos(self, i, j):
        """Line numbers are not asked for."""
        return j

    def read(self, html):
        """Plain markup is taken apart here, at less cost; from the first that is not, the standard parser reads on."""
        at, match = 0, PLAIN.match
        while found := match(html, at):
            kind = found.lastgroup
            if kind == "text":
                text = found[0]
                self.pending.append(unescape(text) if "&" in text else text)
            elif kind == "end":
                self.handle_endtag(found["end"].lower())
            elif kind == "whole":
                self.feed(found[0])
            else:
                tag = found["start"].lower()
                if tag in RAW_TAGS:
                    break
                if tag == "a" and found["attributes"]:
                    self.feed(found[0])
                elif found["slash"]:
                    self.handle_startendtag(tag, ())
                else:
                    self.handle_starttag(tag, ())
            at = found.end()
        if at < len(html):
            self.feed(html[at:])
        self.finish()

    def _flush(self):
        text, self.pending = "".join(self.pending), []
        if not text or self.hidden:
            return
        if not self.spaced and not text.strip(" \n\t\f\r"):
            text = "\n" if "\n" in text else " "
        self.strings.append(text)

    def _count(self, tag, by):
        self.open_count[tag] = self.open_count.get(tag, 0) + by
        if tag in HIDDEN_TAGS:
            self.hidden += by
        elif tag in SPACED_TAGS:
            self.spaced += by

    def _close_last(self):
        element = self.open.pop()
        element.end = len(self.strings)
        self._count(element.tag, -1)

    def handle_starttag(self, tag, attrs):
        if self.pending:
            self._flush()
        parent = self.open[-1]
        element = Element(tag, len(parent.children), len(self.strings))
        parent.children.append(element)
        if tag in HEADER_TAGS:
            self.headers.append((element, parent.children, element.place))
        elif tag == "strong":
            self.strongs.append((element, self.open[-2].children if len(self.open) > 1 else [], parent.place))
        elif tag == "a":
            self.anchors.append({k: v or "" for k, v in attrs})
        if tag in VOID_TAGS:
            element.end = element.start
        else:
            self.open.append(element)
            self._count(tag, 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.pending:
            self._flush()
        if self.open_count.get(tag):
            while self.open[-1].tag != tag:
                self._close_last()
            self._close_last()

    def handle_data(self, data):
        self.pending.append(data)

    def _skip(self, _data):
        self._flush()

    handle_comment = handle_decl = handle_pi = _skip

    def unknown_decl(self, data):
        """Character data sections count as text."""
        self._flush()
        if data[:6].upper() == "CDATA[":
            self.pending.append(data[6:])
            self._flush()

    def finish(self):
        self.close()
        self._flush()
        while len(self.open) > 1:
            self._close_last()
        self.root.end = len(self.strings)

    def text(self, element):
        return "\n".join(self.strings[element.start:element.end])

    def title(self, element):
        return "".join(s.strip() for s in self.strings[element.start:element.end])


def _block(page, heading, body, body_tags):
    texts = []
    for element in body:
        if element.tag not in body_tags:
            break
        texts.append(page.text(element).strip())
    text = "\n".join(texts).strip()
    return {"title": heading, "text": text} if text else None


def read_page(html: str, link_id: str, titles: list[str], body_tags: set[str]) -> dict:
    """Text, partner link, and titled blocks under h2/h3 or, if there are none, under bold headings."""
    page = PageReader()
    try:
        page.read(html)
    except AssertionError:  # the standard parser refuses a few malformed declarations
        return {"raw_text": "", "link": None, "header_blocks": [], "strong_blocks": [], "refused": True}

    def blocks(noted):
        found = []
        for element, around, place in noted:
            heading = page.title(element)
            lower = heading.lower()
            if any(t in lower for t in titles):
                found.append(_block(page, heading, islice(around, place + 1, None), body_tags))
        return [b for b in found if b]

    anchor = next((attrs for attrs in page.anchors if attrs.get("id") == link_id), {})
    headers = blocks(page.headers)
    return {
        "raw_text": page.text(page.root),
        "link": anchor["href"].strip() if "href" in anchor else None,
        "header_blocks": headers,
        "strong_blocks": [] if headers else blocks(page.strongs),
        "refused": False,
    }
