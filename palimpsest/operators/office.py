"""Workbooks and word-processor files into blocks, by the standard library's zip and XML readers.

Both are zip archives of XML parts. A part is read up to ``MOST_BYTES``; a file
that can't be read gives no blocks and ``unreadable``. Workbooks give a row
block for each row with text, with the header row beside it; document bodies
become simple HTML, which the HTML operator turns into blocks.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from html import escape
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.parsing import html_blocks

#: What is read of a workbook at most, and of its merged ranges.
MOST_ROWS, MOST_SHEETS, MOST_COLUMNS, MERGED_CELLS, MERGED_COLUMNS, HEADER_ROWS, SHORT = 5_000, 50, 512, 200_000, 256, 20, 60
MOST_BYTES = 256 << 20
#: Built-in number formats that show a date.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
BAD = (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError, OSError, NotImplementedError, EOFError)


def _part(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    if name not in z.namelist():
        return None
    if z.getinfo(name).file_size > MOST_BYTES:
        raise ValueError("part too large")
    with z.open(name) as f:
        raw = f.read(MOST_BYTES + 1)
    if len(raw) > MOST_BYTES or b"<!ENTITY" in raw:
        raise ValueError("part too large, or with entities")
    root = ET.fromstring(raw)
    for e in root.iter():  # names without their namespaces
        e.tag = e.tag.rsplit("}", 1)[-1]
        e.attrib = {k.rsplit("}", 1)[-1]: v for k, v in e.attrib.items()}
    return root


def _place(ref: str) -> tuple[int, int]:
    """Row and column of a cell's name, from 0."""
    m = re.fullmatch(r"\$?([A-Z]+)\$?([0-9]+)", ref)
    if not m:
        raise ValueError(ref)
    col = 0
    for c in m[1]:
        col = col * 26 + ord(c) - 64
    return int(m[2]) - 1, col - 1


def _name(row: int, col: int) -> str:
    letters, col = "", col + 1
    while col:
        col, k = divmod(col - 1, 26)
        letters = chr(65 + k) + letters
    return f"{letters}{row + 1}"


def _texts(e: ET.Element) -> str:
    """The text of a shared or inline string, phonetic guides left out."""
    return "".join((t.text or "") for c in e if c.tag in ("t", "r") for t in ([c] if c.tag == "t" else c.iter("t")))


def _dated(z: zipfile.ZipFile) -> list[bool]:
    """Whether each cell style shows a date."""
    styles = _part(z, "xl/styles.xml")
    if styles is None:
        return []
    own = {int(n.get("numFmtId", 0)) for n in styles.iter("numFmt") if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", n.get("formatCode", "").lower()))}
    return [int(x.get("numFmtId", 0)) in own | DATE_FORMATS for group in styles.iter("cellXfs") for x in group]


class _Lost:
    """A formula without a stored value."""


def _value(c: ET.Element, shared: list[str], dated: list[bool], first_day: dt.date):
    kind, v = c.get("t", "n"), c.findtext("v")
    if kind == "inlineStr":
        inner = c.find("is")
        return _texts(inner) if inner is not None else ""
    if v is None:
        return _Lost if c.find("f") is not None else None
    if kind == "s":
        return shared[int(v)]
    if kind == "b":
        return "TRUE" if v == "1" else "FALSE"
    if kind != "n":
        return v
    number = float(v)
    style = int(c.get("s", 0))
    if style < len(dated) and dated[style] and 0 <= number < 2_958_466:
        return first_day + dt.timedelta(days=int(number))
    return int(number) if number.is_integer() and abs(number) < 1e15 else number


def _cell(v) -> str:
    if v is None or v is _Lost:
        return ""
    return v.isoformat() if isinstance(v, dt.date) else str(v) if isinstance(v, (int, float)) else " ".join(v.split())


def _line(row: dict, first: int, last: int) -> str:
    cells = [_cell(row.get(c)) for c in range(first, last + 1)]
    while cells and not cells[-1]:
        cells.pop()
    return " | ".join(cells)


def _header(rows: dict[int, dict], first: int, last: int) -> int | None:
    """The first row of two or more short texts with a number or a date in the row below it."""
    for r in range(first, min(last, first + HEADER_ROWS) + 1):
        here = [v for v in rows.get(r, {}).values() if v is not None and v is not _Lost]
        if len(here) > 1 and all(isinstance(v, str) and len(v.strip()) <= SHORT for v in here) and any(isinstance(v, (int, float, dt.date)) for v in rows.get(r + 1, {}).values()):
            return r
    return None


def _spread(sheet: ET.Element, rows: dict[int, dict], last: int) -> None:
    """Merged ranges hold their first cell's value everywhere, so columns keep their names."""
    room = MERGED_CELLS
    for m in sheet.iter("mergeCell"):
        a, _, b = m.get("ref", "").partition(":")
        (r0, c0), (r1, c1) = _place(a), _place(b or a)
        anchor = rows.get(r0, {}).get(c0)
        if anchor is None or r0 > last:
            continue
        for r in range(r0, min(r1, last) + 1):
            for c in range(c0, min(c1, c0 + MERGED_COLUMNS - 1) + 1):
                if room <= 0:
                    return
                if (r, c) != (r0, c0):
                    rows.setdefault(r, {})[c] = anchor
                    room -= 1


def xlsx_to_blocks(content: bytes) -> tuple[list[dict], int, int]:
    """(row blocks with their sheet, cells and header, rows that lost a value or lie beyond the limit, dropped columns)."""
    out, lost, dropped = [], 0, 0
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        strings, book, links = _part(z, "xl/sharedStrings.xml"), _part(z, "xl/workbook.xml"), _part(z, "xl/_rels/workbook.xml.rels")
        if book is None or links is None:
            raise ValueError("no workbook")
        shared = [_texts(s) for s in strings if s.tag == "si"] if strings is not None else []
        old_mac = any(p.get("date1904") in ("1", "true") for p in book.iter("workbookPr"))
        dated, first_day = _dated(z), dt.date(1904, 1, 1) if old_mac else dt.date(1899, 12, 30)
        target = {r.get("Id"): r.get("Target", "") for r in links.iter("Relationship")}
        for s in [*book.iter("sheet")][:MOST_SHEETS]:
            path = target.get(s.get("id"), "")
            sheet = _part(z, path.lstrip("/") if path.startswith("/") else f"xl/{path}")
            if sheet is None:
                continue
            rows: dict[int, dict] = {}
            for c in sheet.iter("c"):
                r, col = _place(c.get("r", ""))
                rows.setdefault(r, {})[col] = _value(c, shared, dated, first_day)
            if not rows:
                continue
            first, end = min(rows), max(rows)
            left, right = min(map(min, rows.values())), max(map(max, rows.values()))
            last, wide = min(end, first + MOST_ROWS - 1), min(right, left + MOST_COLUMNS - 1)
            dropped += right - wide
            lost += end - last
            _spread(sheet, rows, last)
            head = _header(rows, first, last)
            header = None if head is None else _line(rows[head], left, wide) or None
            for r in sorted(k for k in rows if (first if head is None else head + 1) <= k <= last):
                lost += any(rows[r].get(c) is _Lost for c in range(left, wide + 1))
                if text := _line(rows[r], left, wide):
                    out.append({"kind": "row", "text": text, "header": header, "sheet": s.get("name"), "cell_from": _name(r, left), "cell_to": _name(r, wide)})
    return out, lost, dropped


def docx_to_html(content: bytes) -> str:
    """A document's body as HTML: headings by their style, list items, tables and paragraphs."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        doc = _part(z, "word/document.xml")
    body = doc.find("body") if doc is not None else None
    if body is None:
        raise ValueError("no document")

    def text(p: ET.Element) -> str:
        signs = {"t": lambda e: e.text or "", "tab": lambda e: " ", "br": lambda e: " "}
        return escape("".join(signs[e.tag](e) for e in p.iter() if e.tag in signs), quote=False)

    def paragraph(p: ET.Element) -> str:
        style = next((s.get("val", "") for s in p.iter("pStyle")), "")
        h = re.fullmatch(r"(?i)heading\s*([1-6])", style)
        tag = f"h{h[1]}" if h else "h1" if style.lower() == "title" else "li" if p.find("pPr/numPr") is not None else "p"
        return f"<{tag}>{text(p)}</{tag}>"

    def table(t: ET.Element) -> str:
        row = lambda r: "".join(f"<td>{' '.join(text(p) for p in c.iter('p'))}</td>" for c in r.iter("tc"))
        return "".join(f"<tr>{row(r)}</tr>" for r in t.iter("tr"))

    return "\n".join(paragraph(e) if e.tag == "p" else table(e) for e in body if e.tag in ("p", "tbl"))


def xlsx_blocks(files: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(doc_id, pos, kind, text, header, sheet, cell_from, cell_to, unreadable, locator) of workbooks; an unreadable or null one is one row without text."""
    names = ["kind", "text", "header", "sheet", "cell_from", "cell_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = [(doc, i, *(b[n] for n in names), False) for i, b in enumerate(xlsx_to_blocks(raw or b"")[0])]
                except BAD:
                    rows = [(doc, 0, *[None] * 6, True)]
                if rows:
                    kinds = [pa.int64(), pa.int32(), *[pa.string()] * 6, pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "pos", *names, "unreadable"])

    rows = files.select(F.col(key).cast("long"), F.col(content)).mapInArrow(run, "doc_id long, pos int, " + ", ".join(f"{n} string" for n in names) + ", unreadable boolean")
    n = F.lit(None)
    at = F.struct(F.lit("sheet").alias("kind"), F.col("sheet").alias("place"), n.cast("long").alias("first"), n.cast("long").alias("last"), "cell_from", "cell_to")
    return rows.withColumn("locator", F.when(F.col("sheet").isNotNull(), at))


def docx_blocks(files: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """Blocks of documents, as the HTML operator gives them; an unreadable or null one gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = []
            for raw in batch.column(1).to_pylist():
                try:
                    pages.append(docx_to_html(raw or b""))
                except BAD:
                    pages.append("")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pages, pa.string())], ["page_id", "html"])

    return html_blocks(files.select(F.col(key).cast("long"), F.col(content)).mapInArrow(run, "page_id long, html string"))
