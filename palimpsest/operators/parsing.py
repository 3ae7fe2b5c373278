"""Documents' formats into blocks ``(pos, kind, level, text, header)``.

HTML is read by built-in functions. Text with fences, delimited text and JSON
need a state from line to line and run as Arrow batches of plain functions,
each of which can be called on its own.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.locators import ARROW, LOCATOR, locator

BLOCK_TAGS = "h[1-6]|p|li|pre|tr|blockquote"
MOST_COLUMNS, MOST_LINES = 512, 400
#: What a kind of file is called, and what its owner can do.
REMEDIES = (
    (".doc)", "Save it in Word as a Word Document (.docx) and upload that."),
    (".xls)", "Save it in Excel as an Excel Workbook (.xlsx) and upload that."),
    (".msg", "Mail files can't be read yet; paste the text instead."),
    (".pptx", "Slides can't be read yet; export them as PDF and upload that."),
    ("empty", "The file has no contents."),
)


def decode_entities(t: Column) -> Column:
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    return t


def flat(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, "[ \\t\\n\\r\\f]+", " "))


def without_scripts(html: Column) -> Column:
    for p in ("(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "(?s)<!--.*?-->"):
        html = F.regexp_replace(html, p, " ")
    return html


def html_text(html: Column) -> Column:
    return flat(decode_entities(F.regexp_replace(without_scripts(html), "<[^>]*>", " ")))


def html_title(html: Column) -> Column:
    return flat(decode_entities(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)))


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, tag, kind, level, text) of block elements; a page without any is one paragraph. Empty cells keep their place."""
    pattern = rf"(?is)<({BLOCK_TAGS})(?=[\s>])[^>]*>.*?</\1>"
    clean = pages.select(key, without_scripts(F.col(html)).alias("_h"))
    found = F.regexp_extract_all("_h", F.lit(pattern), 0)
    rows = clean.select(key, F.posexplode(F.when(F.size(found) > 0, found).otherwise(F.array("_h"))).alias("pos", "raw"))
    tag = F.lower(F.regexp_extract("raw", rf"(?i)^<({BLOCK_TAGS})(?=[\s>])", 1))
    cells = F.transform(F.regexp_extract_all("raw", F.lit(r"(?is)<t[dh](?=[\s>])[^>]*>(.*?)</t[dh]>"), 1), lambda c: flat(decode_entities(F.regexp_replace(c, "<[^>]*>", " "))))
    text = F.when(tag == "tr", F.rtrim(F.array_join(cells, " | "))).otherwise(flat(decode_entities(F.regexp_replace("raw", "<[^>]*>", " "))))
    kind = F.when(tag.rlike("^h[1-6]$"), "heading").when(tag == "li", "list").when(tag == "tr", "row").when(tag == "pre", "code").otherwise("paragraph")
    level = F.when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int"))
    return rows.select(key, "pos", tag.alias("tag"), kind.alias("kind"), level.alias("level"), text.alias("text")).where("text != ''")


def detect_format(content: Column, name: Column) -> Column:
    """By magic bytes, then by text shape and extension."""
    head = F.hex(F.substring(content, 1, 8))
    text = F.decode(F.substring(content, 1, 4096), "UTF-8")
    low = F.lower(name)
    sample = F.substring(content, 1, 4096)
    bytes_ = F.regexp_replace(F.hex(sample), "(..)", "$1 ")
    odd = F.regexp_count(bytes_, F.lit("(0[1-8EF]|1[0-9A-F]) "))  # control bytes that text has no use for
    nul = F.contains(bytes_, F.lit("00 ")) | (20 * odd >= F.greatest(F.lit(1), F.length(sample)))
    both = F.decode(F.concat(F.substring(content, 1, 8192), F.substring(content, -8192, 8192)), "ISO-8859-1")
    lead = F.lower(F.ltrim(text))
    return (
        F.when(head.startswith("25504446"), "pdf")
        .when(head.startswith("504B0304") & both.contains("word/"), "docx")
        .when(head.startswith("504B0304") & both.contains("xl/"), "xlsx")
        .when(head.startswith("504B0304") | head.startswith("89504E47") | head.startswith("FFD8FF") | nul, "unsupported")
        .when(lead.rlike("^[\\[{]") & F.try_parse_json(F.decode(content, "UTF-8")).isNotNull(), "json")
        .when(lead.rlike("^<(!doctype html|html|head|body)\\b"), "html")
        .when(low.rlike("\\.(csv|tsv)$"), "csv")
        .when(low.rlike("\\.(md|markdown)$") | text.rlike("(?m)^#{1,6}\\s") | text.startswith("---\n"), "markdown")
        .otherwise("text")
    )


def remediation(looks_like: Column) -> Column:
    """What to tell the owner of a file that can't be read, by what it looks like."""
    every = "Supported: PDF, Word (.docx), Excel (.xlsx), CSV, JSON, HTML, Markdown, plain text."
    out = F.when(F.lit(False), "")
    for mark, say in REMEDIES:
        out = out.when(looks_like.contains(mark), say)
    return out.otherwise(every)


def text_to_blocks(text: str) -> list[dict]:
    """Fences, headings (both styles), lists and paragraphs, each with its character span."""
    out: list[dict] = []
    held: list[str] = []
    kind, begin, at, fence = "paragraph", 0, 0, None

    def flush(stop: int) -> None:
        nonlocal held
        body = "\n".join(held).strip("\n") if kind == "code" else "\n".join(held).strip()
        if body.strip():
            out.append({"kind": kind, "level": None, "text": body, "off_from": begin, "off_to": stop})
        held = []

    for line in text.split("\n"):
        end = at + len(line)
        mark = re.match(r"^\s{0,3}(```+|~~~+)", line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence):
                flush(at)
                fence, kind = None, "paragraph"
            else:
                held.append(line)
        elif mark:
            flush(at)
            fence, kind, begin = mark[1], "code", end + 1
        elif (h := re.match(r"^(#{1,6})\s+(.*?)\s*#*\s*$", line)) and h[2]:
            flush(at)
            out.append({"kind": "heading", "level": len(h[1]), "text": h[2], "off_from": at, "off_to": end})
        elif held and kind == "paragraph" and len(held) == 1 and re.match(r"^(=+|-{2,})\s*$", line):
            out.append({"kind": "heading", "level": 1 if line[0] == "=" else 2, "text": held[0].strip(), "off_from": begin, "off_to": end})
            held = []
        elif not line.strip():
            flush(at)
            kind = "paragraph"
        else:
            now = "list" if re.match(r"^\s*([-*+]|[0-9]+[.)])\s+", line) else "paragraph"
            if not held or (now == "list" and kind != "list"):
                flush(at)
                kind, begin = now, at
            held.append(line)
        at = end + 1
    flush(len(text))
    return out


def csv_to_blocks(text: str) -> tuple[list[dict], int]:
    """(row blocks with their header apart, dropped columns). Tabs part the cells if there are no commas early on."""
    lead = text[:2000]
    rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(text), delimiter="\t" if "\t" in lead and "," not in lead else ",")]
    rows = [r for r in rows if any(r)]
    wide = max(map(len, rows), default=0)
    line = lambda r: " | ".join(r[: max((i + 1 for i, c in enumerate(r[:MOST_COLUMNS]) if c), default=0)])
    if not rows:
        return [], 0
    return [{"kind": "row", "level": None, "text": line(r), "header": line(rows[0])} for r in rows[1:]], max(0, wide - MOST_COLUMNS)


def json_to_blocks(text: str) -> list[dict]:
    """``pointer: value`` lines of each top-level key, in groups of so many."""

    def walk(value, at: str):
        items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else None
        if not items:
            yield f"{at or '/'}: {json.dumps(value, ensure_ascii=False) if not isinstance(value, str) else value}"
            return
        for k, v in items:
            yield from walk(v, f"{at}/{str(k).replace('~', '~0').replace('/', '~1')}")

    try:
        value = json.loads(text)
    except ValueError:
        return []
    groups = value.items() if isinstance(value, dict) else [("", value)]
    out = []
    for k, v in groups:
        pointer = f"/{str(k).replace('~', '~0').replace('/', '~1')}" if isinstance(value, dict) else ""
        lines = [*walk(v, pointer)]
        out += [{"kind": "paragraph", "level": None, "text": "\n".join(lines[i : i + MOST_LINES]), "pointer": pointer or "/"} for i in range(0, len(lines), MOST_LINES)]
    return out


def front_matter(text: str) -> tuple[dict, str]:
    """Title and tags of a leading block between ``---`` lines, and the rest."""
    m = re.match(r"^---\n(.*?)\n---\n?", text, re.S)
    if not m:
        return {}, text
    title = re.search(r"^title:\s*(.+)$", m[1], re.M)
    tags = re.search(r"^tags:\s*\[(.*)\]", m[1], re.M)
    meta = {"title": title[1].strip().strip("\"'") if title else None, "tags": [t.strip().strip("\"'") for t in tags[1].split(",") if t.strip()] if tags else []}
    return meta, text[m.end() :]


def _place(b: dict) -> dict | None:
    if "off_from" in b:
        return locator("offset", None, b["off_from"], b["off_to"])
    return locator("path", b["pointer"]) if "pointer" in b else None


def _blocks(parse):
    names = ["doc_id", "pos", "kind", "level", "text", "header", "locator"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), ARROW]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, i, b["kind"], b.get("level"), b["text"], b.get("header"), _place(b)) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, b in enumerate(parse(text or ""))]
            cols = [*zip(*rows, strict=True)] or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return run


def _parsed(docs: DataFrame, parse, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(_blocks(parse), f"doc_id long, pos int, kind string, level int, text string, header string, locator {LOCATOR}")


def markdown_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return _parsed(docs, text_to_blocks, key, text)


def csv_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return _parsed(docs, lambda t: csv_to_blocks(t)[0], key, text)


def json_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return _parsed(docs, json_to_blocks, key, text)
