"""Files to elements: text, Markdown, CSV, HTML, DOCX and XLSX by the standard library."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Element, markdown_table, split_blocks
from .formats import Styles, cell_text

SCHEMA = "doc_id long, n long, modality string, extractor string, reason string, section string, text string, line_start long, line_end long"
ARROW = pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in (c.split() for c in SCHEMA.split(", "))])
#: Elements, and their characters, that a task gathers before it gives them on.
HELD_ROWS, HELD = 5000, 2_000_000
#: Archives beyond these are refused: entries, expanded bytes, expanded to packed ratio.
MAX_ENTRIES, MAX_BYTES, MAX_RATIO, MAX_ROWS, MAX_SPAN = 10_000, 500_000_000, 200, 100_000, 1000


class Unsafe(ValueError):
    """Content that must not be tried again."""


def decode(data: bytes) -> str:
    return data.decode("utf-8-sig", "replace")


def safe_archive(data: bytes) -> zipfile.ZipFile:
    archive = zipfile.ZipFile(io.BytesIO(data))
    sizes = [(i.file_size, i.compress_size) for i in archive.infolist()]
    total, packed = sum(s for s, _ in sizes), sum(c for _, c in sizes)
    if len(sizes) > MAX_ENTRIES or total > MAX_BYTES or total > MAX_RATIO * max(packed, 1):
        raise Unsafe("archive exceeds its limits")
    return archive


def load_text(data: bytes) -> list[Element]:
    return split_blocks(decode(data), "text")


def load_markdown(data: bytes) -> list[Element]:
    return split_blocks(decode(data), "markdown")


def load_rtf(data: bytes) -> list[Element]:
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), decode(data))
    text = re.sub(r"\{\\\*?\\?(?:fonttbl|colortbl|stylesheet|info|pict)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", text)
    text = re.sub(r"\\(?:par|line)\b ?", "\n", text)
    return split_blocks(re.sub(r"\\[a-z]+-?\d* ?|[{}]", "", text), "rtf")


def load_csv(data: bytes) -> list[Element]:
    rows = [[c for c in row] for row in csv.reader(io.StringIO(decode(data))) if row]
    if len(rows) > MAX_ROWS:
        raise Unsafe("too many rows")
    return [Element(markdown_table(rows), "table", "csv", "csv_table")] if rows else []


def spanned(value: str | None) -> int:
    """Rows or columns of a cell; a table that asks for more than MAX_SPAN is refused."""
    size = int(value) if (value or "").strip().isdigit() else 1
    if size > MAX_SPAN:
        raise Unsafe("a table's cell spans too much")
    return max(size, 1)


class _Walk(HTMLParser):
    """Headings stack up, paragraphs and items are text, tables expand their spans."""

    HIDDEN = frozenset("script style head noscript template".split())
    LEAVES = frozenset("p li pre blockquote".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[Element] = []
        self.stack: list[tuple[int, str]] = []
        self.hidden, self.held, self.level, self.rows, self.cell = 0, [], 0, None, None

    def section(self) -> str:
        return " > ".join(t for _, t in self.stack)

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held = []
        if not text:
            return
        if self.level:
            while self.stack and self.stack[-1][0] >= self.level:
                self.stack.pop()
            self.stack.append((self.level, text))
        self.out.append(Element(text, "text", "html", "html_heading" if self.level else "html_text", self.section()))

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag == "table" and self.rows is None:
            self.flush()
            self.rows = []
        elif self.rows is not None:
            if tag == "tr":
                self.rows.append([])
            elif tag in ("td", "th") and self.rows:
                found = dict(attrs)
                self.cell = [[], spanned(found.get("rowspan")), spanned(found.get("colspan"))]
                self.rows[-1].append(self.cell)
        elif tag in self.LEAVES or re.fullmatch("h[1-6]", tag):
            self.flush()
            self.level = int(tag[1]) if tag[0] == "h" else 0
        elif tag in ("img", "svg", "canvas", "video"):
            self.out.append(Element("", "image", "html", "omitted_visual", self.section()))

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "table" and self.rows is not None:
            grid = expand_spans([[("".join(c[0]), c[1], c[2]) for c in row] for row in self.rows])
            if grid:
                self.out.append(Element(markdown_table(grid), "table", "html", "html_table", self.section()))
            self.rows = self.cell = None
        elif tag in ("td", "th"):
            self.cell = None
        elif tag in self.LEAVES or re.fullmatch("h[1-6]", tag):
            self.flush()
            self.level = 0

    def handle_data(self, data):
        if self.hidden:
            return
        if self.rows is None:
            self.held.append(data)
        elif self.cell is not None:
            self.cell[0].append(data)


def expand_spans(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Cells with row and column spans as a full grid; a spanned place repeats its cell."""
    grid: dict[tuple[int, int], str] = {}
    for r, row in enumerate(rows):
        c = 0
        for text, down, across in row:
            while (r, c) in grid:
                c += 1
            for i in range(min(down, len(rows) - r)):
                for j in range(across):
                    grid[r + i, c + j] = " ".join(text.split())
            c += across
    width = max((c for _, c in grid), default=-1) + 1
    return [[grid.get((r, c), "") for c in range(width)] for r in range(len(rows))] if width else []


def load_html(data: bytes) -> list[Element]:
    walk = _Walk()
    walk.feed(decode(data))
    walk.close()
    walk.flush()
    return walk.out


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def load_docx(data: bytes) -> list[Element]:
    """Paragraphs and tables of the body in order; heading styles stack up."""
    archive = safe_archive(data)
    body = next(x for x in ElementTree.fromstring(archive.read("word/document.xml")) if _local(x.tag) == "body")
    text_of = lambda x: "".join((t.text or "") if _local(t.tag) == "t" else "\t" if _local(t.tag) == "tab" else "" for t in x.iter())
    out, stack = [], []
    for part in body:
        kind = _local(part.tag)
        if kind == "p":
            text = text_of(part).strip()
            style = next((v for x in part.iter() if _local(x.tag) == "pStyle" for k, v in x.attrib.items() if _local(k) == "val"), "")
            head = re.fullmatch(r"(?i)heading\s*(\d+)", style)
            if text and head:
                level = min(max(int(head[1]), 1), 6)
                while stack and stack[-1][0] >= level:
                    stack.pop()
                stack.append((level, text))
            if text:
                out.append(Element(text, "text", "docx", "docx_heading" if head else "docx_text", " > ".join(t for _, t in stack)))
        elif kind == "tbl":
            rows = [[text_of(c) for c in row if _local(c.tag) == "tc"] for row in part if _local(row.tag) == "tr"]
            out.append(Element(markdown_table(rows), "table", "docx", "docx_table", " > ".join(t for _, t in stack)))
    out += [Element("", "image", "docx", "omitted_visual") for n in archive.namelist() if n.startswith("word/media/")]
    return out


def load_xlsx(data: bytes) -> list[Element]:
    """Each sheet's cached values as a table, numbers and dates as their formats show them."""
    archive = safe_archive(data)
    names = set(archive.namelist())
    styles = Styles(archive.read("xl/styles.xml") if "xl/styles.xml" in names else None)
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))]
    workbook = ElementTree.fromstring(archive.read("xl/workbook.xml"))
    sheets = [x.attrib for x in workbook.iter() if _local(x.tag) == "sheet"]
    since_1904 = any(x.attrib.get("date1904") in ("1", "true") for x in workbook.iter() if _local(x.tag) == "workbookPr")
    targets = {}
    if "xl/_rels/workbook.xml.rels" in names:
        targets = {x.attrib["Id"]: x.attrib["Target"] for x in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels")).iter() if _local(x.tag) == "Relationship"}
    out = []
    for number, attributes in enumerate(sheets, 1):
        title = attributes.get("name", "")
        link = next((v for k, v in attributes.items() if _local(k) == "id"), "")
        # by its relationship, as sheets may have been moved or deleted; by number only where there is none
        target = targets.get(link, f"worksheets/sheet{number}.xml")
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if path not in names:
            continue
        grid: dict[tuple[int, int], str] = {}
        for cell in ElementTree.fromstring(archive.read(path)).iter():
            if _local(cell.tag) != "c":
                continue
            letters, row = re.fullmatch(r"([A-Z]+)(\d+)", cell.attrib["r"]).groups()
            column = 0
            for x in letters:
                column = column * 26 + ord(x) - 64
            value = next((v.text or "" for v in cell if _local(v.tag) == "v"), None)
            if cell.attrib.get("t") == "s" and value is not None:
                value = shared[int(value)]
            elif cell.attrib.get("t") == "inlineStr":
                value = "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t")
            else:
                formula = next((f.text or "" for f in cell if _local(f.tag) == "f"), None)
                value = cell_text(cell.attrib.get("t", "n"), value, formula, styles.code(cell.attrib.get("s")), since_1904)
            if value is not None:
                grid[int(row), column] = value
        if grid:
            rows = sorted({r for r, _ in grid})
            width = max(c for _, c in grid)
            out.append(Element(markdown_table([[grid.get((r, c), "") for c in range(1, width + 1)] for r in rows]), "table", "xlsx", "xlsx_sheet", title))
    return out


# Fixed map of file extensions.
LOADERS = {
    "csv": load_csv, "docx": load_docx, "htm": load_html, "html": load_html, "markdown": load_markdown, "md": load_markdown,
    "rtf": load_rtf, "text": load_text, "txt": load_text, "xlsm": load_xlsx, "xlsx": load_xlsx,
}
#: Extensions whose loaders need a library or model that is not here; each gives an omission.
PLUGINS: dict[str, object] = dict.fromkeys(("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp", "xls"))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def load(name: str, data: bytes) -> list[Element]:
    kind = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    loader = LOADERS.get(kind) or PLUGINS.get(kind)
    if loader is None:
        return [Element("", "omission", kind or "none", "loader_missing" if kind in PLUGINS else "unknown_extension")]
    try:
        return loader(data)
    except Unsafe:
        return [Element("", "omission", kind, "unsafe_content")]
    except Exception:  # noqa: BLE001  a broken file is reported, not fatal for the job
        return [Element("", "omission", kind, "unreadable")]


def extract(files: DataFrame) -> DataFrame:
    """``doc_id, filename, content`` (bytes) -> one row for each element, in order.

    A task holds the elements of one file, and of those before it HELD rows and characters at most.
    """

    def told(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(ARROW)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc, name, data in zip(*batch.columns, strict=True):
                for n, e in enumerate(load(name.as_py() or "", data.as_py() or b"")):
                    rows.append((doc.as_py(), n, e.modality, e.extractor, e.reason, e.section, e.text, e.line_start, e.line_end))
                    held += len(e.text) + len(e.section or "")
                if len(rows) > HELD_ROWS or held > HELD:
                    yield told(rows)
                    rows, held = [], 0
            yield told(rows)

    return files.select(F.col("doc_id").cast("long"), F.col("filename").cast("string"), F.col("content").cast("binary")).mapInArrow(run, SCHEMA)


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """A folder of files as content-addressed blobs: ``doc_id, filename, content, sha, length``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "content", F.sha2("content", 256).alias("sha"), "length")


def verified(blobs: DataFrame) -> DataFrame:
    """Blobs whose bytes still have the hash they are stored under."""
    return blobs.filter(F.sha2("content", 256) == F.col("sha"))


def blob_range(content: Column, first: Column, last: Column) -> Column:
    return F.substring(content, (first + 1).cast("int"), (last - first + 1).cast("int"))
