"""HTML pages to metadata, blocks, links and attached files.

The one place where a tree has to be built, so the one Python kernel of the parser: an Arrow-batched UDF that takes
(url, html) and returns one struct. Its tree builder recovers as browsers do where it matters for text: implied ends of
paragraphs, items and cells, void and raw-text elements, stray end tags, formatting carried into the next paragraph.
"""

from __future__ import annotations

import posixpath
import re
from datetime import datetime
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import DOCUMENT_TYPES, IMAGE_TYPES

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "noscript"}
CLOSES_P = set(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
FORMATTING = set("a b big code em font i s small strike strong tt u".split())
HEADINGS = [f"h{i}" for i in range(1, 7)]

# Elements without readable text.
NOISE_TAGS = set(
    "script style noscript template iframe object embed video audio picture source canvas img svg math form button select input textarea".split()
)
NOISE_ROLES = {"navigation", "complementary", "contentinfo", "banner", "search", "dialog"}
# Parts of a style that hide an element for good, all of a group at once.
HIDING = [
    ("opacity:0",), ("opacity: 0",), ("clip:rect(0",), ("clip: rect(0",), ("height:0",), ("height: 0",), ("width:0",), ("width: 0",),
    ("overflow:hidden", "height:0"), ("position:absolute", "left:-"), ("position: absolute", "left: -"),
]
FOLDED = ("display:none", "display: none", "visibility:hidden", "visibility: hidden")
BLOCKS = set("p h1 h2 h3 h4 h5 h6 ul ol blockquote dl li".split())
# Class and id words of furniture, and of content.
NOISE_WORDS = """advert(?:isement)? ambox banner breadcrumb combx comment community cookie disqus gdpr hatnote legend menu modal
overlay popup promo related rss share shoutbox sidebar skyscraper social sponsor widget""".split()
STRONG = "article content entry post story".split()
WEAK = "body column main text".split()
_noise = re.compile(r"(-ad-|\b(?:" + "|".join(NOISE_WORDS) + r")\b)", re.I | re.A)
_strong = re.compile(r"\b(?:" + "|".join(STRONG) + r")\b", re.I | re.A)
_weak = re.compile(r"\b(?:" + "|".join(WEAK) + r")\b", re.I | re.A)
SEMANTIC = ("main", "article", "section", "aside", "nav", "footer", "header")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self):
        """This element and all below it in document order, without recursion."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def below(self):
        it = self.walk()
        next(it)
        return it

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack += reversed(n.children)
        return "".join(out)

    def up(self):
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document", {}, None)
        self.html = self._child(self.root, "html", {})
        self.head = self._child(self.html, "head", {})
        self.body: Node | None = None
        self.at = self.head
        self.again: list[tuple[str, dict]] = []

    @staticmethod
    def _child(parent: Node, tag: str, attrs: dict) -> Node:
        node = Node(tag, attrs, parent)
        parent.children.append(node)
        return node

    def _in_body(self) -> None:
        if self.body is None:
            self.body = self._child(self.html, "body", {})
        if self.at is self.head or self.at is self.html:
            self.at = self.body

    def _close(self, tags: set[str], stop: set[str]) -> None:
        """End the nearest open element of ``tags``, unless one of ``stop`` is nearer; formatting inside is reopened later."""
        n, inside = self.at, []
        while n is not None and n.tag not in tags:
            if n.tag in stop or n.tag in ("body", "html", "#document"):
                return
            if n.tag in FORMATTING:
                inside.append((n.tag, n.attrs))
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent
            self.again = inside[::-1]

    def _reopen(self) -> None:
        for tag, attrs in self.again:
            self.at = self._child(self.at, tag, dict(attrs))
        self.again = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = {k.lower(): v or "" for k, v in reversed(attrs)}
        if tag in ("html", "body"):
            if tag == "body":
                self._in_body()
            (self.html if tag == "html" else self.body).attrs.update(own)
            return
        if tag == "head":
            return
        if self.body is None and tag in ("title", "meta", "link", "base", "script", "style", "noscript", "template"):
            parent = self.at
        else:
            self._in_body()
            if tag in CLOSES_P:
                self._close({"p"}, {"table", "td", "th", "caption", "button", "li", "div", "section", "article", "main"})
            if tag == "li":
                self._close({"li"}, {"ul", "ol"})
            elif tag in ("dt", "dd"):
                self._close({"dt", "dd"}, {"dl"})
            elif tag in ("td", "th"):
                self._close({"td", "th"}, {"tr", "table"})
            elif tag == "tr":
                self._close({"tr"}, {"table"})
            elif tag == "option":
                self._close({"option"}, {"select"})
            if tag not in FORMATTING and tag not in VOID:
                keep, self.again = self.again, []
                parent = self.at
                node = self._child(parent, tag, own)
                self.at = node
                self.again = keep
                if tag == "p" or tag in HEADINGS:
                    self._reopen()
                return
            self._reopen()
            parent = self.at
        node = self._child(parent, tag, own)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # the slash says nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None and tag not in ("html", "body"):
            self.at = n.parent
            self.again = []

    def handle_data(self, data: str) -> None:
        if self.at in (self.head, self.html) and not data.strip():
            return
        if self.at is self.head:
            self._in_body()
        if data.strip():
            self._reopen()
        self.at.children.append(data)


def parse_html(text: str) -> Node:
    b = _Builder()
    b.feed(text)
    b.close()
    if b.body is None:
        b.body = b._child(b.html, "body", {})
    return b.root


def _protected(names: str) -> bool:
    return bool(_strong.search(names)) or len(_weak.findall(names)) >= 2


def _names(n: Node) -> str:
    return f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}"


def prune(root: Node) -> None:
    """P01-P06 in their order."""
    for n in [x for x in root.walk() if x.tag == "template" and "shadowrootmode" in x.attrs]:
        at = n.parent.children.index(n)
        for c in n.children:
            if isinstance(c, Node):
                c.parent = n.parent
        n.parent.children[at : at + 1] = n.children
    for n in [x for x in root.below() if x.tag in NOISE_TAGS]:
        n.remove()

    def page_header(n: Node) -> bool:
        p = n.parent
        return n.tag == "header" and p is not None and (p.tag == "body" or (p.tag == "div" and p.parent is not None and p.parent.tag == "body"))

    for n in [x for x in root.below() if x.tag in ("nav", "footer", "aside") or page_header(x) or x.attrs.get("role") in NOISE_ROLES]:
        n.remove()

    def hidden(n: Node) -> bool:
        style = n.attrs.get("style", "")
        return (
            n.attrs.get("aria-hidden") == "true"
            or "hidden" in n.attrs
            or (n.attrs.get("role") == "presentation" and "aria-hidden" in n.attrs)
            or any(all(s in style for s in group) for group in HIDING)
        )

    for n in [x for x in root.below() if hidden(x)]:
        n.remove()
    for n in [x for x in root.below() if any(s in x.attrs.get("style", "") for s in FOLDED)]:
        inner = [x.tag for x in n.below()]
        if "table" not in inner and sum(t in BLOCKS for t in inner) < 2:
            n.remove()
    shielded: set[int] = set()
    for n in [x for x in root.below() if ("class" in x.attrs or "id" in x.attrs) and x.tag not in ("html", "body")]:
        names = _names(n)
        if any(id(p) in shielded for p in n.up()) or not _noise.search(names):
            continue
        inner = list(n.below())
        if _protected(names) or any(x.tag in ("article", "main") or _protected(_names(x)) for x in inner):
            shielded.add(id(n))
        else:
            n.remove()


def _words(text: str) -> int:
    return len(text.split())


def table_text(table: Node, linear: bool = False) -> str:
    """Headers, then rows; no rows, no text."""
    heads = [h.text().strip() for h in table.below() if h.tag == "th"]
    rows = [[c.text().strip() for c in tr.children if isinstance(c, Node) and c.tag == "td"] for tr in table.below() if tr.tag == "tr"]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    if linear:
        return "\n".join(". ".join(f"{h}: {c}" if h else c for h, c in zip(heads + [""] * len(r), r)) for r in rows)
    return "\n".join(([", ".join(heads) + "."] if heads else []) + [", ".join(r) + "." for r in rows])


def segment(root: Node, long_items: bool = True) -> list[dict]:
    """Blocks in document order. Lists in which at least half of the items have over ten words become one block,
    as in the reference; ``long_items`` False turns that round."""
    order = {id(n): i for i, n in enumerate(root.walk())}
    taken: dict[int, tuple[Node, str, str]] = {}

    def free(n: Node) -> bool:
        return id(n) not in taken and not any(id(p) in taken for p in n.up())

    def take(n: Node, text: str, tag: str) -> None:
        if text.strip():
            taken[id(n)] = (n, text.strip(), tag)

    everything = list(root.walk())
    tables = [n for n in everything if n.tag == "table"]
    inside_table = {id(x) for t in tables for x in t.below()}
    for n in everything:
        if n.tag in (*HEADINGS, "p", "blockquote", "pre", "dt", "dd", "figcaption") and id(n) not in inside_table and free(n):
            take(n, n.text(), n.tag)
    for n in everything:
        if n.tag in ("ul", "ol") and id(n) not in inside_table and free(n):
            items = [c for c in n.children if isinstance(c, Node) and c.tag == "li"]
            texts = [c.text().strip() for c in items]
            long = sum(_words(t) > 10 for t in texts)
            if items and (long if long_items else len(items) - long) / len(items) >= 0.5:
                take(n, "\n".join(t for t in texts if t), n.tag)
            else:
                for c, t in zip(items, texts):
                    if not any(id(x) in taken for x in c.below()):
                        take(c, t, "li")
    for n in tables:
        if free(n):
            take(n, table_text(n), "table")
    for tags, bars in ((("div",), BLOCKS | {"table", "div", "pre", "dt", "dd"}), (("section", "article", "main"), BLOCKS | {"table", "div", "pre"})):
        for n in everything:
            if n.tag in tags and free(n) and not any(x.tag in bars or id(x) in taken for x in n.below()):
                take(n, n.text(), n.tag)
    rows = sorted(taken.values(), key=lambda r: order[id(r[0])])
    counts: dict[int, int] = {}
    for n, _, _ in rows:
        for p in n.up():
            counts[id(p)] = counts.get(id(p), 0) + 1
    return _rows(rows, order, counts)


def _rows(rows: list[tuple[Node, str, str]], order: dict[int, int], counts: dict[int, int]) -> list[dict]:
    """The blocks with all that is told of them; ``counts`` has the blocks below each element that forms a group."""
    out = []
    for i, (n, text, tag) in enumerate(rows):
        level = int(tag[1]) if tag in HEADINGS else 0 if tag == "dt" else None
        kind = "heading" if level is not None else "listItem" if tag in ("li", "dd") else "paragraph"
        words = _words(text)
        linked = sum(_words(a.text()) for a in n.below() if a.tag == "a")
        group = next((order[id(p)] for p in n.up() if counts.get(id(p), 0) >= 2), -1)
        out.append(
            {
                "idx": i, "html_id": n.attrs.get("id") or None, "tag": tag, "type": kind, "heading_level": level, "text": text,
                "word_count": words, "link_density": linked / words if words else 0.0, "dom_depth": sum(1 for _ in n.up()),
                "position": i / len(rows), "ancestors": [p.tag for p in n.up() if p.tag in SEMANTIC][::-1], "group_idx": group,
            }
        )
    return out


_stamp = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)")


def _time(text: str | None) -> str | None:
    """A time by RFC 3339, or none."""
    if not text or not _stamp.fullmatch(text):
        return None
    try:
        datetime.fromisoformat(re.sub(r"\.\d+", "", text).replace("Z", "+00:00"))
    except ValueError:
        return None
    return text


def content_root(root: Node) -> Node:
    """The first main element, else the first article, else the body, else all."""
    every = list(root.walk())
    return next((n for tag in ("main", "article", "body") for n in every if n.tag == tag), root)


def segment_plain(root: Node) -> list[dict]:
    """The older segmenter: headings, paragraphs, items, quotations, code and cells that lie in none of them, then div
    elements without such elements inside, in this order; texts are left as they are."""
    order, taken = {id(n): i for i, n in enumerate(root.walk())}, []
    seen: set[int] = set()
    kinds = {*HEADINGS, "p", "li", "blockquote", "pre", "td"}

    def collect(found) -> None:
        for n in found:
            text = n.text()
            if text and id(n) not in seen and not any(id(p) in seen for p in n.up()):
                seen.add(id(n))
                taken.append((n, text, n.tag))

    collect(n for n in root.below() if n.tag in kinds)
    collect(n for n in root.below() if n.tag == "div" and not any(x.tag in kinds for x in n.below()))
    return _rows(taken, order, {})


def metadata(root: Node) -> dict:
    """Title, description, preview, icon, language, last change."""
    metas = [n for n in root.walk() if n.tag == "meta"]

    def meta(attr: str, name: str) -> str | None:
        return next((m.attrs.get("content", "").strip() or None for m in metas if m.attrs.get(attr, "").lower() == name), None)

    title = next((n.text().strip() for n in root.walk() if n.tag == "title"), "") or meta("property", "og:title") or "Untitled"
    icons = {n.attrs.get("rel", "").lower(): n.attrs.get("href") for n in root.walk() if n.tag == "link"}
    return {
        "title": title,
        "description": meta("name", "description") or meta("property", "og:description"),
        "preview_url": meta("property", "og:image"),
        "icon_url": icons.get("icon") or icons.get("shortcut icon"),
        "language": next((n.attrs.get("lang") or None for n in root.walk() if n.tag == "html"), None),
        "last_modified": _time(meta("property", "article:modified_time") or meta("http-equiv", "last-modified")),
        "page_type": "unknown",  # H03: no analyzer tells kinds of pages apart yet
    }


def _clean_url(url: str) -> str:
    head, _, query = url.partition("#")[0].partition("?")
    items = [x for x in query.split("&") if x and not x.lower().startswith("utm_")]
    return f"{head}?{'&'.join(sorted(items, key=lambda x: x.partition('=')[0]))}" if items else head


def _ext(url: str) -> str:
    return posixpath.splitext(url)[1].lower() if "/" not in url.rpartition(".")[2] else ""


def links(root: Node, base: str) -> list[dict]:
    """Resolved links that are no attached files, the first of each URL."""
    own, seen, out = (urlsplit(base).hostname or "").lower(), set(), []
    for n in root.walk():
        href = n.attrs.get("href", "").strip() if n.tag == "a" else ""
        if not href or href.startswith("#") or re.match(r"(?i)(javascript|mailto|tel|data):", href):
            continue
        try:
            url = urljoin(base, href)
            host = (urlsplit(url).hostname or "").lower()
        except ValueError:
            url, host = href, ""
        if _ext(url) in DOCUMENT_TYPES:
            continue
        url = _clean_url(url)
        if url not in seen:
            seen.add(url)
            kind = "internal" if not host or host == own or host.endswith("." + own) else "external"
            out.append({"href": url, "type": kind, "anchor_text": n.text().strip() or None, "position": 0})
    return out


def documents(root: Node, base: str) -> list[dict]:
    """Attached files and images of links, then other images, the first of each URL."""
    seen, out = set(), []

    def add(url: str, mime: str, text: str, source: str) -> None:
        if url not in seen:
            seen.add(url)
            out.append({"url": url, "mime_type": mime, "description": text or None, "description_source": source if text else None})

    for n in root.walk():
        href = n.attrs.get("href", "").strip() if n.tag == "a" else ""
        if href and _ext(href) in {**DOCUMENT_TYPES, **IMAGE_TYPES}:
            url, text = urljoin(base, href), n.text().strip()
            name = posixpath.basename(url).removesuffix(_ext(url))
            add(url, {**DOCUMENT_TYPES, **IMAGE_TYPES}[_ext(href)], text or name, "PARAGRAPH" if text else "FILENAME")
    for n in root.walk():
        src = n.attrs.get("src", "").strip() if n.tag == "img" else ""
        if src and _ext(src) in IMAGE_TYPES:
            parent = next((p for p in n.up() if p.tag == "a"), None)
            if parent is not None and urljoin(base, parent.attrs.get("href", "")) in seen:
                continue
            add(urljoin(base, src), IMAGE_TYPES[_ext(src)], n.attrs.get("alt", "").strip(), "ALT_TEXT")
    return out


_BLOCK = (
    "array<struct<idx:int,html_id:string,tag:string,type:string,heading_level:int,text:string,word_count:int,link_density:double,"
    "dom_depth:int,position:double,ancestors:array<string>,group_idx:int>>"
)
_PAGE = (
    "title string, description string, preview_url string, icon_url string, language string, last_modified string, page_type string, "
    f"blocks {_BLOCK}, links array<struct<href:string,type:string,anchor_text:string,position:int>>, "
    "documents array<struct<url:string,mime_type:string,description:string,description_source:string>>, error string"
)
_FIELDS = [f.split()[0] for f in "title description preview_url icon_url language last_modified page_type blocks links documents error".split()]


def parse_page(url: str | None, text: str | None, with_links: bool = True) -> dict:
    """All of a page; a page without HTML has an error."""
    if text is None:
        return {"error": "PARSE_ERROR"}
    root = parse_html(text)
    page = metadata(root)
    if with_links:
        page |= {"links": links(root, url or ""), "documents": documents(root, url or "")}
    prune(root)
    return page | {"blocks": segment(root)}


def parse_pages(pages: DataFrame, url: str = "url", html: str = "html", with_links: bool = True) -> DataFrame:
    """Adds ``page``, the struct of everything that is read from the HTML."""

    @F.pandas_udf(_PAGE)
    def parse(urls: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for u, t in zip(urls, texts):
            try:
                rows.append(parse_page(u, t, with_links))
            except Exception as e:  # noqa: BLE001 - one page's failure is its own row's error
                rows.append({"error": f"PARSE_ERROR: {type(e).__name__}"})
        return pd.DataFrame([{f: r.get(f) for f in _FIELDS} for r in rows], columns=_FIELDS, dtype=object)

    out = pages.withColumn("page", parse(F.col(url), F.col(html)))
    return out.withColumn("page", F.col("page").withField("last_modified", F.try_to_timestamp(F.col("page.last_modified"))))
