"""HTML of entries: cleaning, links, blocks, tokens and layout.

Column functions wherever a pattern can say it; Arrow-batched Python where a document must be walked in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.lazy import arrow_udf
from quire.functions.text import WHITE_CHARACTERS
from quire.schemas import BLOCK_BYTES

_DROPPED = frozenset("script style table sup sub noscript meta link header footer nav aside math figcaption".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start ends an open element of the first kind within the same parent; fixed values of HTML.
_BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_DASH = re.compile("[‐-―−⁃﹘﹣－]")


def normalised(title: str) -> str:
    """As functions.text.normalise_title, for use inside a batch."""
    return " ".join(_DASH.sub("-", title).lower().split())


class _Node:
    __slots__ = ("name", "attrs", "parts", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: _Node | None):
        self.name, self.attrs, self.parts, self.parent = name, attrs, [], parent


class _Tree(HTMLParser):
    """A lenient tree: what is left open ends with its parent, what nothing opened is ignored; comments are left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, name, attrs):
        if name in _BLOCKS:
            self._end("p", {"table", "td", "th", "li", "div", "body"})
        if name in _ENDS:
            for other in _ENDS[name]:
                self._end(other, {"ul", "ol", "dl", "table", "select", "body"})
        node = _Node(name, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.parts.append(node)
        if name not in _VOID:
            self.at = node

    def _end(self, name, walls):
        node = self.at
        while node.parent is not None and node.name not in walls:
            if node.name == name:
                self.at = node.parent
                return
            node = node.parent

    def handle_startendtag(self, name, attrs):
        self.handle_starttag(name, attrs)
        if name not in _VOID:
            self.at = self.at.parent

    def handle_endtag(self, name):
        node = self.at
        while node.parent is not None:
            if node.name == name:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data):
        self.at.parts.append(data)


def _find(node: _Node, name: str) -> _Node | None:
    todo = [node]
    while todo:
        n = todo.pop()
        if n.name == name:
            return n
        todo += [p for p in reversed(n.parts) if not isinstance(p, str)]
    return None


def skeleton(html: str) -> tuple[list[str], list[tuple[str, str]]]:
    """A document's body without chrome, parsed once: the texts around its holes (one more than these), and the holes, which are what
    other entries decide: ("a", normalised title) where a link to an entry begins and ("/a", the same) where it ends, ("img", source).
    Links elsewhere lose their target, and all other attributes go. Without a body, all of the document counts."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    parts: list[str] = []
    holes: list[tuple[str, str]] = []
    out: list[str] = []
    todo: list = [_find(tree.root, "body") or tree.root]
    while todo:
        part = todo.pop()
        hole = None
        if isinstance(part, tuple):
            if len(part) == 1:
                out.append(part[0])
            else:
                hole = part
        elif isinstance(part, str):
            out.append(escape(part, quote=False))
        elif part.name in _DROPPED or part.name == "div" and "zim-footer" in part.attrs.get("class", "").split():
            continue
        elif part.name == "img":
            hole = ("img", part.attrs.get("src", ""))
        else:
            tail = (f"</{part.name}>",)
            href = part.attrs.get("href", "") if part.name == "a" else ""
            if part.name in _VOID:
                out.append(f"<{part.name}/>")
                tail = ("",)
            elif part.name in ("", "figure"):
                tail = ("",)
            elif href and not href.startswith(("#", "http", "./", "../")) and "://" not in href:
                key = normalised(href.split("#")[0].replace("_", " "))
                hole, tail = ("a", key), ("/a", key)
            else:
                out.append(f"<{part.name}>")
            todo.append(tail)
            todo += reversed(part.parts)
        if hole:
            parts.append("".join(out))
            holes.append(hole)
            out = []
    return [*parts, "".join(out)], holes


def fill(parts: list[str], holes: list[tuple[str, str]], targets: dict[str, int], images: dict[str, tuple[int, int, int]]) -> str:
    """The document of a skeleton: links to known titles become /wiki/ID, unknown ones lose their tag, pictures become /img/ID or go."""
    out = [parts[0]]
    for (kind, key), text in zip(holes, parts[1:], strict=True):
        if kind == "img":
            if info := images.get(key):
                out.append(f'<img h="{info[2]}" src="/img/{info[0]}" w="{info[1]}"/>')
        elif (found := targets.get(key)) is not None:
            out.append(f'<a href="/wiki/{found}">' if kind == "a" else "</a>")
        out.append(text)
    return "".join(out)


def clean(html: str, targets: dict[str, int], images: dict[str, tuple[int, int, int]] | None = None) -> str:
    """The cleaned document, where all targets (by normalised title) and pictures (by source) are at hand."""
    return fill(*skeleton(html), targets, images or {})


SKELETON = "parts array<string>, holes array<struct<kind string, key string>>"


@arrow_udf(SKELETON)
def skeletons(html: pd.Series) -> pd.DataFrame:
    """skeleton() by rows; a null document gives null parts and holes."""
    made = [(None, None) if h is None else skeleton(h) for h in html]
    return pd.DataFrame({"parts": [p for p, _ in made], "holes": [None if h is None else [{"kind": k, "key": x} for k, x in h] for _, h in made]})


@arrow_udf("string")
def filled(parts: pd.Series, holes: pd.Series, targets: pd.Series, images: pd.Series) -> pd.Series:
    """fill() by rows, with a map of normalised titles to ids and one of sources to (img_id, w, h), each of them or null."""
    entry = lambda v: (v["img_id"], v["w"], v["h"])
    known = lambda t, i: ({} if t is None else dict(t), {} if i is None else {k: entry(v) for k, v in dict(i).items()})
    rows = zip(parts, holes, targets, images, strict=True)
    return pd.Series([None if p is None else fill(list(p), [(x["kind"], x["key"]) for x in h], *known(t, i)) for p, h, t, i in rows], dtype=object)


def hole_keys(holes: Column | str, kind: str) -> Column:
    """The distinct keys of a kind of holes."""
    return F.array_distinct(F.transform(F.filter(holes, lambda x: x["kind"] == kind), lambda x: x["key"]))


class _Targets(HTMLParser):
    """The values of one attribute of one kind of tag, in order."""

    def __init__(self, tag: str, attribute: str):
        super().__init__(convert_charrefs=True)
        self.wanted, self.found = (tag, attribute), []

    def handle_starttag(self, name, attrs):
        if name == self.wanted[0]:
            self.found += [v or "" for k, v in attrs if k == self.wanted[1]][:1]


def _targets(tag: str, attribute: str):
    @arrow_udf("array<string>")
    def found(html: pd.Series) -> pd.Series:
        out = []
        for h in html:
            parser = _Targets(tag, attribute)
            if h is not None:
                parser.feed(h)
                parser.close()
            out.append(None if h is None else parser.found)
        return pd.Series(out, dtype=object)

    return found


#: Column functions: the targets of all links, or the sources of all pictures, of a document in order, however they are spelt.
hrefs, sources = _targets("a", "href"), _targets("img", "src")


def entry_links(html: Column | str) -> Column:
    """Ids of links to entries in cleaned HTML."""
    return F.transform(F.regexp_extract_all(F.col(html) if isinstance(html, str) else html, F.lit(r'href="/wiki/(\d{1,18})"'), F.lit(1)), lambda x: x.cast("long"))


def entry_images(html: Column | str) -> Column:
    """(img_id, w, h) of pictures in cleaned HTML; 0 where a side is not given."""
    tags = F.regexp_extract_all(F.col(html) if isinstance(html, str) else html, F.lit(r'<img [^>]*src="/img/\d{1,18}"[^>]*>'), F.lit(0))
    number = lambda tag, p: F.coalesce(F.nullif(F.regexp_extract(tag, p, 1), F.lit("")).cast("long"), F.lit(0))
    return F.transform(tags, lambda t: F.struct(number(t, r'src="/img/(\d+)"').alias("img_id"), number(t, r'[ "]w="(\d+)"').cast("int").alias("w"), number(t, r'[ "]h="(\d+)"').cast("int").alias("h")))


def split_blocks(data: bytes, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    """Slices of size bytes at most, cut behind the last ">" that is not a slice's first byte, else at size. Nothing for no bytes."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            close = data.rfind(b">", at, end)
            end = close + 1 if close > at else end
        yield data[at:end]
        at = end


def html_blocks(size: int = BLOCK_BYTES):
    """Column function: text or bytes to its blocks."""

    @arrow_udf("array<binary>")
    def blocks(html: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else list(split_blocks(h.encode() if isinstance(h, str) else bytes(h), size)) for h in html], dtype=object)

    return blocks


def tokens(html: str) -> Iterator[tuple[int, str, str, bool, str, str]]:
    """(seq, kind, name, closing, attrs, text) of texts and tags in order; an open tag at the end is left out, a ">" outside of tags is text."""
    seq = 0
    for m in re.finditer(r"(?s)<([^<>]*)(>?)|([^<]+)", html):
        if m[3] is not None:
            yield seq, "text", "", False, "", m[3]
        elif m[2]:
            tag = m[1].strip()
            if not tag:
                continue
            closing = tag.startswith("/")
            name, _, attrs = tag[closing:].partition(" ")
            yield seq, "tag", name.lower(), closing, attrs, ""
        else:
            continue
        seq += 1


def _pieces(html: Column | str) -> Column:
    return F.regexp_extract_all(F.col(html) if isinstance(html, str) else html, F.lit(r"<[^<>]*>?|[^<]+"), F.lit(0))


def _tag_of(x: Column) -> Column:
    """What is in the brackets of a piece, empty for texts and for what is no tag."""
    return F.when(x.startswith("<") & x.endswith(">"), F.btrim(F.substring(x, F.lit(2), F.length(x) - 2), F.lit(WHITE_CHARACTERS))).otherwise("")


def _fields(x: Column, tag: Column) -> list[Column]:
    """kind, name, closing, attrs, text of a piece."""
    is_tag, closing = x.startswith("<"), tag.startswith("/")
    body = F.when(closing, F.substring(tag, 2, 1 << 30)).otherwise(tag)
    name = F.substring_index(body, " ", 1)
    attrs = F.substring(body, F.length(name) + 2, F.length(body))
    return [F.when(is_tag, "tag").otherwise("text").alias("kind"), F.lower(name).alias("name"), closing.alias("closing"), attrs.alias("attrs"), F.when(is_tag, "").otherwise(x).alias("text")]


def token_list(html: Column | str) -> Column:
    """Column function: the tokens of a document in order, as structs (kind, name, closing, attrs, text); the place is the seq."""
    both = F.transform(_pieces(html), lambda x: F.struct(x.alias("x"), _tag_of(x).alias("tag")))
    return F.transform(F.filter(both, lambda p: ~p["x"].startswith("<") | (p["tag"] != "")), lambda p: F.struct(*_fields(p["x"], p["tag"])))


def token_rows(df: DataFrame, html: str, *keys: str) -> DataFrame:
    """(keys.., place, kind, name, closing, attrs, text): the same as rows, of which Spark generates code; place grows with the seq."""
    rows = df.select(*keys, F.posexplode(_pieces(html)).alias("place", "x")).withColumn("tag", _tag_of(F.col("x")))
    return rows.where(~F.col("x").startswith("<") | (F.col("tag") != "")).select(*keys, "place", *_fields(F.col("x"), F.col("tag")))


CHAR_WIDTH, BODY_LINE, GAP, MARGIN, INDENT = 7, 16, 6, 4, 14
_HEADINGS = {"h1": 29, "h2": 22, "h3": 16, "h4": 16, "h5": 16, "h6": 16}


class _Page:
    """Cursor of a page of words of fixed character width."""

    def __init__(self, width: int):
        self.width, self.y, self.height, self.line = width, 0, 0, BODY_LINE
        self.listed = self.no_gap = False
        self.link = 0
        self.links: list[tuple[int, int, int, int, int]] = []
        self.images: list[tuple[int, int, int, int, int]] = []
        self.x = self.left

    @property
    def left(self) -> int:
        return MARGIN + INDENT * self.listed

    def reach(self, y: int) -> None:
        self.height = max(self.height, y)

    def newline(self) -> None:
        self.y, self.x = self.y + self.line, self.left
        self.reach(self.y + self.line)

    def gap(self) -> None:
        if self.x > self.left:
            self.newline()
        self.y, self.no_gap, self.x = self.y + (0 if self.no_gap else GAP), False, self.left
        self.reach(self.y)

    def write(self, text: str) -> None:
        if text[:1] in (" ", "\n") and self.x > self.left:
            self.x += CHAR_WIDTH
        for m in re.finditer(r"([^ \n]+)( *)", text):
            size = CHAR_WIDTH * len(m[1])
            if self.x + size > self.width - MARGIN and self.x > self.left:
                self.newline()
            advance = size + CHAR_WIDTH * bool(m[2])
            if self.link:
                self.links.append((self.x, self.y, advance, self.line, self.link))
            self.x += advance
            self.reach(self.y + self.line)

    def tag(self, name: str, closing: bool, attrs: str) -> None:
        if name == "p":
            self.gap()
        elif name == "br":
            self.newline()
        elif name in _HEADINGS and not closing:
            self.gap()
            self.line = _HEADINGS[name]
        elif name in _HEADINGS:
            if self.x > self.left:
                self.newline()
            self.x, self.line, self.no_gap = self.left, BODY_LINE, self.no_gap or name not in ("h1", "h2")
        elif name in ("ul", "ol"):
            self.gap()
            self.listed = not closing
            if closing:
                self.gap()
        elif name == "li":
            self.gap()
            if not closing:
                self.x = MARGIN + INDENT
        elif name == "a":
            found = re.search(r'href="/wiki/(\d+)[^"]*"', attrs)
            self.link = 0 if closing else int(found[1]) if found else self.link
        elif name == "img" and not closing:
            if found := re.search(r'src="/img/(\d+)"', attrs):
                w, h = (int(m[1]) if (m := re.search(rf'{k}="(\d+)"', attrs)) else 0 for k in "wh")
                thumb = min(max(h // 2 if h > 0 else 60, 8), 120)
                self.images.append((int(found[1]), self.y, w, h, thumb))
                self.y += thumb + 4
                self.reach(self.y)
            self.x = self.left
        elif name in ("div", "section", "main") and self.x > self.left:
            self.gap()


def layout(html: str, width: int = 314) -> _Page:
    """Places of links and pictures, and the height of a page, for cleaned HTML whose entities and characters are plain."""
    page = _Page(width)
    for _, kind, name, closing, attrs, text in tokens(html):
        page.write(text) if kind == "text" else page.tag(name, closing, attrs)
    if page.x > page.left:
        page.y += page.line
    page.reach(page.y)
    return page


@arrow_udf("links array<struct<x int, y int, w int, h int, article_id long>>, images array<struct<img_id long, doc_y int, img_w int, img_h int, thumb_h int>>, content_height int")
def page_layout(html: pd.Series) -> pd.DataFrame:
    """layout() by rows."""
    link, image = ("x", "y", "w", "h", "article_id"), ("img_id", "doc_y", "img_w", "img_h", "thumb_h")
    pages = [layout(h or "") for h in html]
    return pd.DataFrame({"links": [[dict(zip(link, x, strict=True)) for x in p.links] for p in pages], "images": [[dict(zip(image, x, strict=True)) for x in p.images] for p in pages], "content_height": [p.height for p in pages]})


#: Numbers that stand for the next and the previous page in links; fixed values.
NEXT_PAGE, PREVIOUS_PAGE = 0xFFFFFFFE, 0xFFFFFFFD


def with_page_links(html: Column | str, page: Column, has_next: Column) -> Column:
    """A page with links to the pages before and behind it, in the words that the device shows."""
    h = F.col(html) if isinstance(html, str) else html
    link = lambda i, t: f'<a href="/wiki/{i}">{t}</a>'
    before = F.when(page > 0, link(PREVIOUS_PAGE, "&lt; Prev page") + "<p></p>").otherwise("")
    return F.concat(before, h, F.when(has_next, "<p></p>" + link(NEXT_PAGE, "Next page &gt;")).otherwise(""))


def page_of(data: bytes, page: int, known: list[int], size: int = BLOCK_BYTES) -> tuple[int, int, bool]:
    """(start, end, whether another follows) of a page of an entry that was stored whole: size bytes at most, cut behind the last ">",
    be it the first byte, else at size. known has the starts found so far, from 0 on, and gets those up to the page behind this one;
    pages before it are found on the way. A page past the end is empty."""

    def end(start: int) -> int:
        return len(data) if start + size >= len(data) else data.rfind(b">", start, start + size) + 1 or start + size

    while len(known) <= page + 1 and end(known[-1]) < len(data):
        known.append(end(known[-1]))
    start = known[page] if page < len(known) else len(data)
    return start, end(start), end(start) < len(data)


def page_bounds(size: int = BLOCK_BYTES):
    """Column function: (start, end) of every page of an entry that was stored whole, found as a reader who turns its pages finds them."""

    @arrow_udf("array<struct<start int, end int>>")
    def bounds(html: pd.Series) -> pd.Series:
        out = []
        for h in html:
            data, known, page, own = (h.encode() if isinstance(h, str) else bytes(h or b"")), [0], 0, []
            more = len(data) > 0
            while more:
                start, end, more = page_of(data, page, known, size)
                own.append({"start": start, "end": end})
                page += 1
            out.append(None if h is None else own)
        return pd.Series(out, dtype=object)

    return bounds
