"""HTML and feeds through Python functions on the standard parsers; Spark has no native HTML reader."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Elements and roles without prose, notices by class or id, tags that end a line, tags without an end.
SKIPPED = frozenset(("script", "style", "noscript", "template", "svg", "canvas", "nav", "footer"))
SKIPPED_ROLES = frozenset(("navigation", "banner", "contentinfo"))
NOTICES = re.compile(r"cookie|consent|gdpr", re.IGNORECASE)
BLOCKS = frozenset((
    "address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
FEED_TYPES = ("application/rss+xml", "application/atom+xml", "application/rdf+xml", "application/feed+json", "text/xml")
#: Last path segments that name a feed.
FEED_NAMES = ("feed", "feeds", "feed.xml", "feed.atom", "feed.json", "rss", "rss.xml", "atom", "atom.xml", "index.xml", "index.rss")


class _Page(HTMLParser):
    """Text, title, links and advertised feeds of a page in one pass. Open elements are kept with whether they are quiet: inside
    a region without prose. An end tag closes everything left open inside its element, and is ignored without one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title: list[str] | None = None
        self.links: list[str] = []
        self.feeds: list[str] = []
        self.open: list[tuple[str, bool]] = []
        self.in_title = False

    def quiet(self) -> bool:
        return bool(self.open) and self.open[-1][1]

    def handle_starttag(self, tag, attrs):
        self.noted(tag, dict(attrs))
        if tag == "title" and self.title is None and not self.quiet():
            self.in_title, self.title = True, []
        if tag not in VOID:
            self.open.append((tag, self.quiet() or self.skips(tag, attrs)))
        self.line(tag)

    def handle_startendtag(self, tag, attrs):
        self.noted(tag, dict(attrs))
        self.line(tag)

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            del self.open[at:]
        self.line(tag)

    def handle_data(self, data):
        if not self.quiet():
            (self.title if self.in_title else self.out).append(data)

    def line(self, tag) -> None:
        if tag in BLOCKS and not self.quiet():
            self.out.append("\n")

    def noted(self, tag, a) -> None:
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag == "link" and a.get("href") and {"alternate", "feed"} & set((a.get("rel") or "").lower().split()):
            kind = (a.get("type") or "").partition(";")[0].strip().lower()
            if kind in FEED_TYPES or urlsplit(a["href"]).path.lower().rstrip("/").rpartition("/")[2] in FEED_NAMES:
                self.feeds.append(a["href"].strip())

    @staticmethod
    def skips(tag, attrs) -> bool:
        a = [(k, v) for k, v in attrs if v]
        return tag in SKIPPED or any(k == "role" and v.strip().lower() in SKIPPED_ROLES or k in ("class", "id") and NOTICES.search(v) for k, v in a)


def tidy(text: str) -> str:
    """Lines with single spaces, trimmed, and at most one empty line between them."""
    lines = (re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in text.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def page_parts(html: str | None) -> dict:
    p = _Page()
    p.feed(html or "")
    p.close()
    return {"text": tidy("".join(p.out)), "title": tidy("".join(p.title or [])) or None, "links": p.links, "feeds": p.feeds}


_S, _L = StringType(), ArrayType(StringType())
#: Types as objects: workers import this module without a session that could read DDL.
PAGE = StructType([StructField("text", _S), StructField("title", _S), StructField("links", _L), StructField("feeds", _L)])
ENTRIES = ArrayType(StructType([StructField(c, _S) for c in ("title", "url", "published", "summary")]))


def by_hundreds(kind):
    """A plain Python function of pages. Spark hands it a hundred rows at a time; of an Arrow batch a worker would hold up to ten
    thousand pages, and all that is read from them, at once."""
    return F.udf(returnType=kind, useArrow=False)


@by_hundreds(PAGE)
def page(html: str | None) -> dict:
    """text, title, links and advertised feeds of a page."""
    return page_parts(html)


def feed_parts(xml: str | None) -> list[dict]:
    """Entries of an RSS or Atom feed; malformed or oversized (over 2 MB) feeds have none. Of several bodies the longest
    counts, of several dates the first."""
    if not xml or len(xml) > 2_000_000:
        return []
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return []
    name = lambda e: e.tag.rpartition("}")[2].lower()
    out = []
    for e in root.iter():
        if name(e) not in ("item", "entry"):
            continue
        kids = [(name(c), c) for c in e]
        of = lambda *names: [(c.text or "").strip() for k, c in kids if k in names and (c.text or "").strip()]  # noqa: B023, E731
        hrefs = [c.get("href") for k, c in kids if k == "link" and c.get("href") and c.get("rel", "alternate") == "alternate"]
        link = next(iter(hrefs + of("link") + [x for x in of("guid") if x.startswith("http")]), None)
        out.append({"title": next(iter(of("title")), None), "url": link, "published": next(iter(of("pubdate", "published", "updated", "date", "modified")), None),
                    "summary": max(of("content", "encoded", "description", "summary", "subtitle"), key=len, default=None)})
    return out


@by_hundreds(ENTRIES)
def feed(xml: str | None) -> list[dict]:
    return feed_parts(xml)


@by_hundreds(PAGE)
def page_at(url: str | None, html: str | None) -> dict:
    """page() with links and feeds made absolute, without fragments, each once."""
    p = page_parts(html)
    for k in ("links", "feeds"):
        p[k] = list(dict.fromkeys(x for x in (_join(url or "", h) for h in p[k]) if x))
    return p


def _join(base: str, href: str) -> str:
    try:
        return urljoin(base, href.strip()).split("#", 1)[0]
    except ValueError:
        return ""


class _Marked(HTMLParser):
    """Texts of elements that a rule names, in order: (name, text, link) whenever one ends."""

    def __init__(self, rule) -> None:
        super().__init__(convert_charrefs=True)
        self.rule, self.open, self.found = rule, None, []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        name = self.rule(tag, a)
        if name:
            self.end()
            self.open = (name, tag, [], a.get("href", ""))

    def handle_endtag(self, tag):
        if self.open and tag == self.open[1]:
            self.end()

    def handle_data(self, data):
        if self.open:
            self.open[2].append(data)

    def end(self) -> None:
        if self.open:
            name, _, text, href = self.open
            self.found.append((name, " ".join("".join(text).split()), href))
            self.open = None


def _marked(html: str | None, rule) -> list[tuple[str, str, str]]:
    p = _Marked(rule)
    p.feed(html or "")
    p.close()
    p.end()
    return p.found


def result_parts(html: str | None) -> list[dict]:
    """Results of a search page: titles with links, each with the snippet after it. The classes that mark them."""
    def rule(tag, a):
        have = set(a.get("class", "").split())
        return "title" if tag == "a" and have & {"result__a", "result-link"} else "snippet" if have & {"result__snippet", "result-snippet"} else None

    out = []
    for name, text, href in _marked(html, rule):
        if name == "title":
            out.append({"url": "https:" + href if href.startswith("//") else href, "title": text, "content": ""})
        elif out:
            out[-1]["content"] = text
    return out


RESULTS = ArrayType(StructType([StructField(c, _S) for c in ("url", "title", "content")]))


@by_hundreds(RESULTS)
def results(html: str | None) -> list[dict]:
    return result_parts(html)


class _Officers(HTMLParser):
    """First cells of rows of class employee-row (a fixed value): the name, and the title in a span."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: dict[str, None] = {}
        self.cell, self.span, self.said = None, 0, ("", "")

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.end()
            self.cell = 0 if "employee-row" in (dict(attrs).get("class") or "").split() else None
        elif self.cell is not None:
            self.cell += tag == "td"
            self.span = int(tag == "span" and self.cell == 1)

    def handle_endtag(self, tag):
        if tag == "span":
            self.span = 0
        elif tag == "tr":
            self.end()

    def handle_data(self, data):
        if self.cell == 1:
            name, title = self.said
            self.said = (name, title + data) if self.span else (name + data, title)

    def end(self) -> None:
        name, title = (" ".join(x.split()) for x in self.said)
        title = title.strip("()")
        if self.cell is not None and name:
            self.lines[f"{name} ({title})" if title else name] = None
        self.cell, self.span, self.said = None, 0, ("", "")


def officer_parts(html: str | None) -> list[str]:
    p = _Officers()
    p.feed(html or "")
    p.close()
    p.end()
    return list(p.lines)


@by_hundreds(ArrayType(StringType()))
def officers(html: str | None) -> list[str]:
    """Officers listed on an organisation's page, each once."""
    return officer_parts(html)


def is_feed_url(url: Column) -> Column:
    """Whether the last segment of an address names a feed."""
    path = F.rtrim(F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))), F.lit("/"))
    return F.substring_index(path, "/", -1).isin(*FEED_NAMES)


def conventional_feed(url: Column) -> Column:
    """Where a site without an advertised feed tends to have one, null without a host."""
    return F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("/feed"))


#: Byte-order marks, longest first, and the bounds under which bytes read as Western text.
MARKS = ((b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
SNIFF, CONTROL_SHARE, HIGH_SHARE = 4096, 0.02, 0.2


def decoded(body: bytes | None, declared: str | None = None) -> str:
    """A body as text: the declared charset, a mark, UTF-8, the charset in its markup, Western text, else UTF-8 with
    replacement characters. A charset counts only if it decodes the whole body."""
    body = bytes(body or b"")
    mark = next((c for m, c in MARKS if body.startswith(m)), None)
    inside = re.search(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([\w.:-]+)|<\?xml[^>]+encoding\s*=\s*[\"']([\w.:-]+)", body[:SNIFF], re.IGNORECASE)
    stated = (inside[1] or inside[2]).decode("ascii", "ignore") if inside else None
    for charset in (declared, mark, "utf-8", stated):
        try:
            if charset:
                return body.decode(charset)
        except (LookupError, ValueError):
            if charset == mark:
                break
    head = body[:SNIFF]
    control = sum(b < 32 and b not in b"\t\n\r\x0b\x0c" or b == 127 for b in head)
    western = not mark and 0 not in head and control <= CONTROL_SHARE * len(head) and sum(b > 127 for b in head) <= HIGH_SHARE * len(head)
    return body.decode("cp1252" if western else mark or "utf-8", "replace")


@by_hundreds(StringType())
def decode_body(body: bytes | None, declared: str | None) -> str:
    return decoded(body, declared)
