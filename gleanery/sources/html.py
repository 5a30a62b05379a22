"""What HTML pages hold: title, headings, links, text and tables. Parsing runs in Arrow tasks, page by page; the parts
that patterns can find are column expressions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose text is no text of the page, and those that end a line.
_SKIP = {"script", "style", "noscript"}
_BREAK = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "article", "section", "table", "main", "nav", "header", "footer", "ul", "ol"}
#: Elements of a head; any other begins the body.
_HEAD = {"head", "title", "meta", "link", "base", "script", "style", "noscript", "html"}
PAGE = "title string, meta map<string, string>, open_graph map<string, string>, schema_org array<string>, headings array<string>, links array<string>, body string"
TABLE = "table_index int, columns array<string>, n_rows int, summary string"
#: Pages whose results a task holds at once, whatever the size of a batch.
PAGE_BLOCK = 64
_TEXTS, _PAIRS = pa.list_(pa.string()), pa.map_(pa.string(), pa.string())
_PAGE_ROWS = pa.schema([("page_id", pa.int64()), ("title", pa.string()), ("meta", _PAIRS), ("open_graph", _PAIRS), ("schema_org", _TEXTS), ("headings", _TEXTS), ("links", _TEXTS), ("body", pa.string())])
_TABLE_ROWS = pa.schema([("page_id", pa.int64()), ("table_index", pa.int32()), ("columns", _TEXTS), ("n_rows", pa.int32()), ("summary", pa.string())])


def links(html: Column) -> Column:
    """Targets of links, by pattern."""
    return F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1))


def title(html: Column) -> Column:
    return F.regexp_extract(html, "<title>([^<]*)</title>", 1)


def headings(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit("<h[123]>([^<]*)</h[123]>"), F.lit(1))


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.meta, self.graph, self.schema, self.headings, self.links = "", {}, {}, [], [], []
        self.body, self.main = [""], [""]
        self.skipped, self.inside, self.tables = None, "", []
        self.open: list[list] = []  # tables that are not closed yet, the innermost last: [rows, whether in a cell]
        self.in_head, self.mains, self.data = False, 0, None

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        self.in_head = tag == "head" or (self.in_head and tag in _HEAD)  # a head may lack its end tag
        if tag in _SKIP:
            self.skipped = tag
            self.data = "" if tag == "script" and (found.get("type") or "").lower() == "application/ld+json" else None
        elif tag in ("title", "h1", "h2", "h3"):
            self.inside = tag
            if tag != "title":
                self.headings.append("")
        elif tag == "meta":
            name, content = found.get("name") or found.get("property"), found.get("content")
            if name and content:
                (self.graph if name.startswith("og:") else self.meta)[name] = content
        elif tag == "a" and found.get("href"):
            self.links.append(found["href"])
        elif tag == "main":
            self.mains += 1
        elif tag == "table":
            self.tables.append([])
            self.open.append([self.tables[-1], False])
        elif tag == "tr" and self.open:
            self.open[-1][0].append([])
        elif tag in ("td", "th") and self.open and self.open[-1][0]:
            self.open[-1][0][-1].append("")
            self.open[-1][1] = True
        self._break(tag)

    def handle_endtag(self, tag):
        if tag == self.skipped:
            if self.data is not None:
                self.schema.append(self.data)
            self.skipped, self.data = None, None
        elif tag == "head":
            self.in_head = False
        elif tag in ("td", "th") and self.open:
            self.open[-1][1] = False
        elif tag == "table" and self.open:
            self.open.pop()
        if tag == self.inside:
            self.inside = ""
        self._break(tag)
        if tag == "main" and self.mains:
            self.mains -= 1

    def _break(self, tag):
        if tag in _BREAK:
            self.body.append("")
            if self.mains:
                self.main.append("")

    def handle_data(self, data):
        if self.skipped:
            if self.data is not None:
                self.data += data
            return
        if self.inside == "title":
            self.title += data
            return
        if self.inside:
            self.headings[-1] += data
        if self.open and self.open[-1][1]:
            self.open[-1][0][-1][-1] += data
        if not self.in_head:
            self.body[-1] += data
            if self.mains:
                self.main[-1] += data


def _parsed(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def _squeezed(text: str) -> str:
    return " ".join(text.split())


def _is_json(text: str) -> bool:
    try:
        json.loads(text or "{}")
    except ValueError:
        return False
    return True


def _text(lines: list[str]) -> str:
    return "\n".join(x for x in map(_squeezed, lines) if x)


def _absolute(base: str | None, link: str) -> str:
    try:
        return urljoin(base or "", link)
    except ValueError:
        return link


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of batches of ``PAGE_BLOCK`` rows."""
    for batch in batches:
        for i in range(0, len(batch), PAGE_BLOCK):
            yield batch.slice(i, PAGE_BLOCK)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def parsed_pages(pages: DataFrame) -> DataFrame:
    """(page_id, title, meta, open_graph, schema_org, headings, links, body) of pages (page_id, url, html).

    body is the text of ``main`` elements, or of the body where there is none or it is empty; scripts, styles and
    noscript are no text. All headings and links are told, links as absolute ones; schema_org are the JSON-LD scripts
    that are JSON. A head ends with its end tag or before the first element that belongs to a body. A null page is empty.
    """

    def told(page_id: int | None, url: str | None, html: str | None) -> tuple:
        p = _parsed(html)
        schema = [x.strip() for x in p.schema if _is_json(x)]
        heads = [h for h in map(_squeezed, p.headings) if h]
        return page_id, _squeezed(p.title), list(p.meta.items()), list(p.graph.items()), schema, heads, [_absolute(url, x) for x in p.links], _text(p.main) or _text(p.body)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            yield _rows([told(*page) for page in zip(*(c.to_pylist() for c in block.columns), strict=True)], _PAGE_ROWS)

    return pages.select("page_id", "url", "html").mapInArrow(task, f"page_id long, {PAGE}")


def _summaries(html: str | None, rows: int) -> Iterator[tuple[int, list[str], int, str]]:
    for i, table in enumerate(t for t in _parsed(html).tables if t):
        head, body = [_squeezed(c) for c in table[0]], table[1:]
        told = ["; ".join(f"{h}: {_squeezed(c)}" for h, c in zip(head, r, strict=False)) for r in body[:rows]]
        yield i, head, len(body), "\n".join(told)


def tables(pages: DataFrame, rows: int = 25) -> DataFrame:
    """(page_id, table_index, columns, n_rows, summary): each table of a page; its first row names the columns, and up
    to ``rows`` of the others are told in the summary. A table inside another is one of its own, after it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            pages = zip(*(c.to_pylist() for c in block.columns), strict=True)
            yield _rows([(page_id, *t) for page_id, html in pages for t in _summaries(html, rows)], _TABLE_ROWS)

    return pages.select("page_id", "html").mapInArrow(task, f"page_id long, {TABLE}")


class TablesOf:
    """A table function of SQL: html_tables(html, rows) gives the rows of tables() for one page."""

    def eval(self, html: str, rows: int = 25) -> Iterator[tuple[int, list[str], int, str]]:
        yield from _summaries(html, rows)
