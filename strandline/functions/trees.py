"""Extraction that needs an HTML tree, on the standard library's tokeniser, as Arrow UDFs and table functions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
IMPLIED = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "li": ("li",)}


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def everything(self) -> Iterator[Node | str]:
        """All below, in order; a loop, as pages nest deeper than Python's stack."""
        todo = list(reversed(self.children))
        while todo:
            c = todo.pop()
            yield c
            if isinstance(c, Node):
                todo.extend(reversed(c.children))

    def text(self) -> str:
        return "".join(c for c in self.everything() if isinstance(c, str))

    def walk(self) -> Iterator[Node]:
        return (c for c in self.everything() if isinstance(c, Node))

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()


class _Builder(HTMLParser):
    """A tree with the recoveries that the pages need: cells, rows and items close each other."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        #: Open elements of each tag, so that nothing is looked for in vain.
        self.open: Counter[str] = Counter()

    def _leave(self, node: Node) -> None:
        """node, and what is open in it, ends."""
        while True:
            ended, self.at = self.at, self.at.parent
            self.open[ended.tag] -= 1
            if ended is node:
                return

    def handle_starttag(self, tag, attrs):
        closes, node = IMPLIED.get(tag, ()), self.at
        if not any(self.open[c] for c in closes):
            node = self.root
        last = None
        while node.parent is not None and node.tag not in ("table", "ul", "ol"):
            if node.tag in closes:
                last = node
            node = node.parent
        if last is not None:
            self._leave(last)
        child = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(child)
        if tag not in VOID:
            self.at = child
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return
        node = self.at
        while node.tag != tag:
            node = node.parent
        self._leave(node)

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _first(root: Node, test) -> str:
    return next((n.text().strip() for n in root.walk() if test(n)), "")


def _inside(n: Node, container: str) -> bool:
    p = n.parent
    while p is not None:
        if p.attrs.get("id") == container:
            return True
        p = p.parent
    return False


def _titles(html: str) -> dict:
    root = tree(html)
    return {
        "page": _first(root, lambda n: n.attrs.get("id") == "page-title"),
        "site": _first(root, lambda n: n.tag == "h1" and _inside(n, "header")),
        "subtitle": _first(root, lambda n: n.tag == "h2" and _inside(n, "header")),
    }


def titles(html: Column) -> Column:
    """Page title, site title and subtitle: the first match each, '' if none."""

    @F.pandas_udf("struct<page:string,site:string,subtitle:string>")
    def run(a: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_titles(x or "") for x in a], columns=["page", "site", "subtitle"])

    return run(html)


def _tags(html: str) -> list[str]:
    out = []
    for n in tree(html).walk():
        p = n.parent
        while n.tag == "a" and p is not None:
            if p.has_class("page-tags"):
                out.append(n.text().strip())
                break
            p = p.parent
    return [t for t in out if t]


def page_tags(html: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([_tags(x or "") for x in a])

    return run(html)


def page_source(html: Column) -> Column:
    """Text of the source element without literal <br />; null if there is none."""

    @F.pandas_udf("string")
    def run(a: pd.Series) -> pd.Series:
        found = [next((n.text() for n in tree(x or "").walk() if n.has_class("page-source")), None) for x in a]
        return pd.Series([None if t is None else t.replace("<br />", "").strip() for t in found], dtype=object)

    return run(html)


def _time(n: Node) -> int:
    return next((int(m[1]) for x in n.walk() if (m := re.search(r"time_(\d+)", x.attrs.get("class", "")))), 0)


def _author(n: Node) -> int:
    for x in n.walk():
        if x.attrs.get("data-id", "").isdigit():
            return int(x.attrs["data-id"])
        if m := re.search(r"userInfo\((\d+)\)", x.attrs.get("onclick", "")):
            return int(m[1])
    return 0


def _change_rows(html: str) -> Iterator[tuple]:
    for row in (n for n in tree(html).walk() if n.has_class("changes-list-item")):
        href = next((a.attrs["href"] for c in row.walk() if c.has_class("title") for a in c.walk() if a.tag == "a" and a.attrs.get("href")), None)
        if href is None:
            continue
        revision = next((c.text() for c in row.walk() if c.has_class("revision-no")), "")
        last = re.sub(r"[()]", "", revision).split()[-1:]
        yield href.lstrip("/").strip().lower(), int(last[0]) if last and last[0].isdigit() else 0, _time(row), _author(row)


def _revision_rows(html: str) -> Iterator[tuple]:
    for row in (n for n in tree(html).walk() if n.tag == "tr"):
        rev_id = next((n.attrs["value"] for n in row.walk() if n.tag == "input" and n.attrs.get("value")), None)
        numbers = (c.text().strip().replace(".", "") for c in row.walk() if c.tag == "td")
        number = next((int(x) for x in numbers if x.isdigit()), None)
        if rev_id and number is not None:
            yield rev_id, number, _time(row), _author(row)


@F.udtf(returnType="slug string, rev_no bigint, ts bigint, author bigint")
class ChangeRows:
    """Rows of a page of the change list."""

    def eval(self, html: str):
        yield from _change_rows(html or "")


@F.udtf(returnType="rev_id string, rev_no bigint, ts bigint, author bigint")
class RevisionRows:
    """Rows of a page's revision list."""

    def eval(self, html: str):
        yield from _revision_rows(html or "")


@F.udtf(returnType="href string")
class FileLinks:
    """Links to attached files of a listing, once each."""

    def eval(self, html: str):
        hrefs = [n.attrs["href"] for n in tree(html or "").walk() if n.tag == "a" and "local--files/" in n.attrs.get("href", "")]
        for href in dict.fromkeys(hrefs):
            yield (href,)


#: Leading bytes -> media type.
SIGNATURES = [
    (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"), (b"BM", "image/bmp"), (b"%PDF", "application/pdf"),
    (b"PK\x03\x04", "application/zip"), (b"\x1f\x8b", "application/gzip"), (b"ID3", "audio/mpeg"), (b"OggS", "audio/ogg"), (b"fLaC", "audio/x-flac"),
    (b"wOFF", "application/font-woff"), (b"wOF2", "application/font-woff"), (b"\x1aE\xdf\xa3", "video/webm"), (b"7z\xbc\xaf\x27\x1c", "application/x-7z-compressed"),
]


def sniff_bytes(content: bytes | None, name: str | None) -> str | None:
    """By leading bytes (the listed signatures only), then by the name's extension before ? and #."""
    import mimetypes

    content = content or b""
    for lead, kind in SIGNATURES:
        if content.startswith(lead):
            return kind
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
        return "image/webp"
    if content[4:8] == b"ftyp":
        return "video/mp4"
    return mimetypes.guess_type(re.split(r"[?#]", name or "")[0].rsplit("/", 1)[-1], strict=False)[0]


def sniff(content: Column, name: Column) -> Column:
    """Media type of the first 8 KiB, or null."""

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([sniff_bytes(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return run(F.substring(content, 1, 8192), name)
