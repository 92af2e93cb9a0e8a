"""Web pages and uploaded documents: what kind a body is, what an HTML page says, which of its links is best."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions import numeric

SKIPPED = {"script", "style", "noscript", "template"}
MAX_CHARS, MAX_TABLES, MAX_ROWS, MAX_COLS, MAX_LINKS = 200_000, 50, 2000, 200, 500
#: Addresses that lead to no page.
NO_PAGE = ("#", "javascript:", "mailto:", "tel:")
SUFFIXES = ("pdf", "xlsx", "xls", "csv", "docx")


class Table:
    """A table as it is read: its caption, and its rows, each with whether all its cells are headings."""

    def __init__(self):
        self.caption: list[str] = []
        self.rows: list[tuple[list[str], list[bool]]] = []
        self.row: tuple[list[str], list[bool]] | None = None

    def cells(self) -> list[list[str]]:
        return [cells for cells, _ in self.rows]

    def parts(self) -> dict:
        """caption, header: the first row whose cells are all headings, and all other rows that have cells."""
        header, rows = [], []
        for cells, heads in self.rows:
            if not header and cells and all(heads):
                header = cells
            elif cells:
                rows.append(cells)
        return {"caption": " ".join("".join(self.caption).split()) or None, "header": header, "rows": rows}


class _Page(HTMLParser):
    """Text, links and tables of a page. A cell ends where the next one, its row or its table does; rows and cells belong to the innermost table. What is beyond a limit is left out as a whole and the page is said to be cut."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.text, self.links, self.quiet, self.title, self.in_title, self.cut = url, [], {}, 0, [], False, False
        self.tables: list[Table] = []
        self.open: list[Table | None] = []  # tables around this place; None for one that is left out
        self.cell: list[list[str] | None] = []  # beside each its open cell
        self.in_caption = False

    def room(self, held: list | dict, most: int) -> bool:
        """Whether one more fits; if not, the page is said to be cut."""
        self.cut |= len(held) >= most
        return len(held) < most

    def end_cell(self) -> None:
        if self.cell and self.cell[-1] is not None:
            self.open[-1].row[0].append(" ".join("".join(self.cell[-1]).split()))
            self.cell[-1] = None

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.quiet += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "a" and (href := (dict(attrs).get("href") or "").strip()) and not href.startswith(NO_PAGE):
            try:
                target = urljoin(self.url, href)
            except ValueError:  # no address
                return
            if target.startswith(("http://", "https://")) and target not in self.links and self.room(self.links, MAX_LINKS):
                self.links[target] = None
        elif tag == "table":
            self.open.append(Table() if self.room(self.tables, MAX_TABLES) else None)
            self.cell.append(None)
            if self.open[-1] is not None:
                self.tables.append(self.open[-1])
        elif self.open and self.open[-1] is not None:
            table = self.open[-1]
            if tag == "caption":
                self.in_caption = True
            elif tag == "tr":
                self.end_cell()
                table.row = ([], []) if self.room(table.rows, MAX_ROWS) else None
                if table.row is not None:
                    table.rows.append(table.row)
            elif tag in ("td", "th") and table.row is not None:
                self.end_cell()
                if self.room(table.row[0], MAX_COLS):
                    self.cell[-1] = []
                    table.row[1].append(tag == "th")

    def handle_endtag(self, tag):
        if tag in SKIPPED and self.quiet:
            self.quiet -= 1
        elif tag == "title":
            self.in_title = False
        elif tag == "caption":
            self.in_caption = False
        elif tag in ("td", "th"):
            self.end_cell()
        elif tag == "tr" and self.open and self.open[-1] is not None:
            self.end_cell()
            self.open[-1].row = None
        elif tag == "table" and self.open:
            self.end_cell()
            self.open.pop()
            self.cell.pop()
            self.in_caption = False

    def close(self):
        super().close()
        while self.open:
            self.handle_endtag("table")

    def handle_data(self, data):
        if self.quiet:
            return
        if self.in_title:
            self.title.append(data)
            return
        if self.in_caption and self.open and self.open[-1] is not None:
            self.open[-1].caption.append(data)
        elif self.cell and self.cell[-1] is not None:
            self.cell[-1].append(data)
        self.text.append(data)


def parse_html(html: str | None, url: str | None) -> dict:
    page = _Page(url or "")
    try:
        page.feed(html or "")
        page.close()
    except (ValueError, AssertionError):  # broken markup: what was read so far counts
        pass
    text = " ".join(" ".join(page.text).split())
    return {
        "title": " ".join("".join(page.title).split()), "text": text[:MAX_CHARS], "links": list(page.links), "n_tables": len(page.tables), "n_cells": sum(len(r) for t in page.tables for r in t.cells()),
        "tables": [t.parts() for t in page.tables], "cut": page.cut or len(text) > MAX_CHARS,
    }


TABLE = pa.struct([("caption", pa.string()), ("header", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string())))])


def extract_html(pages: DataFrame) -> DataFrame:
    """page_id, title, text, links (absolute, in order, each once), n_tables, n_cells, tables (of each its caption, header and rows), cut (a limit left something out); html.parser is the only Python in it."""

    bound_batches(pages.sparkSession)
    columns = (("title", pa.string()), ("text", pa.string()), ("links", pa.list_(pa.string())), ("n_tables", pa.int32()), ("n_cells", pa.int32()), ("tables", pa.list_(TABLE)), ("cut", pa.bool_()))
    schema = pa.schema([("page_id", pa.int64()), *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [parse_html(h, u) for h, u in zip(batch.column("html").to_pylist(), batch.column("url").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array([g[name] for g in got], kind) for name, kind in columns)], schema=schema)

    some = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return some.mapInArrow(run, "page_id long, title string, text string, links array<string>, n_tables int, n_cells int, tables array<struct<caption: string, header: array<string>, rows: array<array<string>>>>, cut boolean")


def cells(extracted: DataFrame) -> DataFrame:
    """The tables of extracted pages in long form: page_id, table_no, caption, row_no, column_no (from 0), head, cell, value (the cell as a number of the Turkish format, null where it isn't one)."""
    x = extracted.select("page_id", F.posexplode("tables").alias("table_no", "t"))
    x = x.select("page_id", "table_no", F.col("t.caption").alias("caption"), F.col("t.header").alias("header"), F.posexplode("t.rows").alias("row_no", "row"))
    x = x.select("page_id", "table_no", "caption", "row_no", "header", F.posexplode("row").alias("column_no", "cell"))
    return x.select("page_id", "table_no", "caption", "row_no", "column_no", F.get("header", F.col("column_no")).alias("head"), "cell", numeric.parse_tr(F.col("cell")).cast("double").alias("value"))



def bound_batches(spark: SparkSession, most: int = 1 << 20) -> None:
    """Bounds the bytes of Arrow batches, so that long pages travel few at a time; a session's own lower setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > most:
        spark.conf.set(key, str(most))


def kind_of(media_type: Column, body: Column) -> Column:
    """html, pdf, excel, image or text by media type, else by the first bytes, else null. Never by a name's ending."""
    media = F.lower(F.btrim(F.substring_index(F.coalesce(media_type, F.lit("")), ";", 1)))
    head = F.hex(F.substring(body, 1, 8))
    begins = lambda *marks: head.rlike("^(?:" + "|".join(marks) + ")")
    return (
        F.when(media.isin("text/html", "application/xhtml+xml"), "html")
        .when(media == "application/pdf", "pdf")
        .when(F.contains(media, F.lit("spreadsheet")) | (media == "application/vnd.ms-excel"), "excel")
        .when(F.startswith(media, F.lit("image/")), "image")
        .when(F.startswith(media, F.lit("text/")), "text")
        .when(begins("255044462D"), "pdf")
        .when(begins("504B0304", "D0CF11E0"), "excel")
        .when(begins("89504E47", "FFD8FF", "47494638"), "image")
        .when(F.lower(F.substring(body.cast("string"), 1, 15)).rlike(r"^\s*<(?:!doctype|html)"), "html")
    )


MAX_PAGES = 50


def pdf_refusal(body: Column) -> Column:
    """Why a PDF isn't read, by its objects as far as they aren't compressed: damaged (it doesn't begin as one), encrypted, page_limit (more than MAX_PAGES pages), no_text_layer (no font, so pictures at most), else unsupported, as there is no reader of its text here."""
    said = F.decode(body, "ISO-8859-1")
    pages = F.regexp_count(said, F.lit(r"/Type\s*/Page(?![A-Za-z])"))
    return F.when(~F.startswith(said, F.lit("%PDF-")), "damaged").when(F.contains(said, F.lit("/Encrypt")), "encrypted").when(pages > MAX_PAGES, "page_limit").when(~F.contains(said, F.lit("/Font")), "no_text_layer").otherwise("unsupported")


def score_link(text: Column, url: Column, terms: list[str]) -> Column:
    """Two for each term in the text, one for each in the address alone, one more for a document's ending if any matched."""
    t, u = F.lower(text), F.lower(url)
    found = sum((F.when(F.contains(t, F.lit(w)), 2).when(F.contains(u, F.lit(w)), 1).otherwise(0) for w in terms), F.lit(0))
    return found + F.when((found > 0) & F.regexp_extract(u, r"\.([a-z0-9]+)(?:[?#].*)?$", 1).isin(*SUFFIXES), 1).otherwise(0)


WORD = re.compile(r"[^\W_]+")
