"""Words on pages: lines, heights, and the order in which a page is read."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a line begin at most so far below its first word; a wider gap between words parts a line.
LINE_GAP, SEGMENT_GAP = 3.0, 36.0
#: Words of an element that spans columns and is prose; a band of labels is less deep than so many lines.
PROSE_WORDS, BAND_LINES = 12, 6


def line_heights(boxes: DataFrame, by: str) -> DataFrame:
    """The median height of a page's boxes (top, bottom)."""
    return boxes.groupBy(by).agg(F.percentile(F.col("bottom") - F.col("top"), 0.5).alias("height"), F.count("*").alias("n"))


def word_lines(words: DataFrame) -> DataFrame:
    """``page, word_id, x0, x1, top`` -> the number of each word's line and of its segment in that.

    A word more than LINE_GAP below the first of a line begins the next. Within a line, from
    left to right, a gap of more than SEGMENT_GAP begins a segment. The first word of a line
    is known only from the line before, so words are folded in order; a task holds a line.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, number, line = None, 0, []

        def done() -> list[tuple]:
            out, segment, end = [], 0, None
            for x0, word, x1, _ in sorted(line):
                segment += end is not None and x0 - end > SEGMENT_GAP
                end = x1
                out.append((page, word, number, segment))
            return out

        for frame in batches:
            rows = []
            for w in frame.itertuples(index=False):
                if w.page != page or abs(w.top - line[0][3]) > LINE_GAP:
                    rows += done()
                    page, number, line = w.page, number + 1 if w.page == page else 0, []
                line.append((w.x0, w.word_id, w.x1, w.top))
            yield pd.DataFrame(rows, columns=["page", "word_id", "line", "segment"])
        yield pd.DataFrame(done(), columns=["page", "word_id", "line", "segment"])

    rows = words.select("page", "word_id", "x0", "x1", "top").repartition("page").sortWithinPartitions("page", "top", "x0", "word_id")
    return rows.mapInPandas(run, "page long, word_id long, line long, segment long")


def by_rows(items: list[dict]) -> list[dict]:
    """From the top down, and from left to right where tops are less than LINE_GAP below the row's first."""
    found: list[list[dict]] = []
    for x in sorted(items, key=lambda x: (x["top"], x["x0"])):
        if found and x["top"] - found[-1][0]["top"] <= LINE_GAP:
            found[-1].append(x)
        else:
            found.append([x])
    return [x for row in found for x in sorted(row, key=lambda x: x["x0"])]


def read_page(items: list[dict], width: float) -> list[dict]:
    """Elements (x0, top, x1, bottom, n_words) in reading order.

    A page with two elements or more on either side of its middle has columns: between
    elements that span them, the left one is read before the right one. Around prose that
    spans the page, short bands are rows of labels and no columns.
    """
    side = lambda x: "left" if x["x1"] < width / 2 else "right" if x["x0"] > width / 2 else "both"
    sides = {s: [x for x in items if side(x) == s] for s in ("left", "right", "both")}
    if min(len(sides["left"]), len(sides["right"])) < 2:
        return by_rows(items)
    prose = any(x["n_words"] > PROSE_WORDS for x in sides["both"])
    dividers = sorted(sides["both"], key=lambda x: (x["top"], x["x0"]))
    out: list[dict] = []
    above = float("-inf")
    for divider in [*dividers, None]:
        below = divider["top"] if divider else float("inf")
        band = [x for x in items if side(x) != "both" and above <= x["top"] < below]
        if band:
            depth = max(x["bottom"] for x in band) - min(x["top"] for x in band)
            labels = prose and depth < BAND_LINES * median(x["bottom"] - x["top"] for x in band)
            out += by_rows(band) if labels else by_rows([x for x in band if side(x) == "left"]) + by_rows([x for x in band if side(x) == "right"])
        if divider:
            out.append(divider)
            above = max(above, below)
    return out


def reading_order(elements: DataFrame) -> DataFrame:
    """``page, element_id, x0, top, x1, bottom, n_words, page_width`` -> each element's place on its page; a task holds a page
    and a batch, not a frame for each page."""
    names = ["page", "element_id", "x0", "top", "x1", "bottom", "n_words", "page_width"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, held = None, []

        def done() -> list[tuple]:
            return [(page, x["element_id"], place) for place, x in enumerate(read_page(held, held[0]["page_width"]))] if held else []

        def told(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["page", "element_id", "place"])

        for batch in batches:
            rows = []
            ids = [batch.column(i).to_pylist() for i in range(2)]
            # absent numbers are NaN, which no comparison holds for
            numbers = [batch.column(i).to_numpy(zero_copy_only=False).astype(float).tolist() for i in range(2, len(names))]
            for own in zip(*ids, *numbers, strict=True):
                if own[0] != page:
                    rows += done()
                    page, held = own[0], []
                held.append(dict(zip(names, own, strict=True)))
            yield told(rows)
        yield told(done())

    rows = elements.select(*[F.col(c).cast("long") for c in names[:2]], *[F.col(c).cast("double") for c in names[2:]])
    return rows.repartition("page").sortWithinPartitions("page", "element_id").mapInArrow(run, "page long, element_id long, place long")


# Words of a heading and of body text, sizes of headings beside body text (plain and bold), shares
# of the page's width where headings and labels begin, the gap that parts heading lines, letters of a major heading.
HEADING_WORDS, BODY_WORDS, LARGER, LARGER_BOLD = 18, 10, 1.08, 1.05
HEADING_LEFT, MAJOR_LEFT, GAP, GAP_LINES, MAJOR_LETTERS = 0.65, 0.25, 8.0, 0.75, 4
SECTION = "order_no long, block_type string, section_path string, section_source string"
# Texts of so many words; of those shaped like headings none has a mark of a list, two commas, a colon or the end of a sentence.
LONG_TEXT = rf"^\s*+(?:\S++\s++){{{BODY_WORDS - 1}}}\S"
SHORT_TEXT = rf"^(?=\s*+\S++(?:\s++\S++){{0,{HEADING_WORDS - 1}}}+\s*+\z)(?![●•▪*-]\s)[^:,]*+(?:,[^:,]*+)?+(?<![.;!?](?:\r\n|[\n\r\x85\u2028\u2029])?)\z"


def visible_sections(elements: DataFrame) -> DataFrame:
    """``doc_id`` and SECTION: which elements are headings, and the section each element stands in.

    ``elements``: doc_id, order_no, text, page, x0, y0, x1, y1, page_width, font_size,
    font_bold, extractor, layout_label, section_path (of an outline, or null), omission.
    Body size is the median of a document's longer text elements. Heading lines close
    together form one heading, with labels at their right; it holds for what follows, over
    pages too, until the next one or another outline section. A heading in capitals that is
    set in stands above those after it. What heads an element is known from the elements
    before it alone, so they are folded in order; a task holds one heading and a batch.

    Elements are read and shuffled once: those of body text also send their sizes, as rows of
    their own that sort before the elements of their document.
    """
    c = F.col
    at = elements.select(
        c("doc_id").cast("long"), c("order_no").cast("long"), F.trim("text").alias("text"), "page", c("y0").cast("double"), c("y1").cast("double"), "section_path",
        F.nanvl(c("font_size").cast("double"), F.lit(None)).alias("size"), F.coalesce(c("omission"), F.lit(False)).alias("omission"), (c("extractor") == "pdf_text").alias("printed"),
        F.when(F.coalesce(c("layout_label") == "title", F.lit(False)), 0.0).when(c("font_bold"), LARGER_BOLD).otherwise(LARGER).alias("larger"),
        (c("x0") < c("page_width") * HEADING_LEFT).alias("left"), F.coalesce(c("x0") > c("page_width") * HEADING_LEFT, F.lit(False)).alias("right"), (c("x0") > c("page_width") * MAJOR_LEFT).alias("inset"),
    )
    # shaped like a heading: short, without marks of a sentence or list, not far right; its size is judged when that of body text is known
    shaped = F.coalesce(c("printed") & c("left") & c("text").rlike(SHORT_TEXT), F.lit(False))
    sized = F.coalesce(c("doc_id").isNotNull() & c("printed") & (c("size") > 0) & c("text").rlike(LONG_TEXT), F.lit(False))
    at = at.withColumn("shaped", shaped).withColumn("letters", F.when(c("shaped") & c("inset"), F.regexp_replace(F.substring_index("text", "(", 1), r"[^\p{L}]", "")))
    major = F.coalesce((F.length("letters") >= MAJOR_LETTERS) & (c("letters") == F.upper("letters")) & (c("letters") != F.lower("letters")), F.lit(False))
    own = {
        "order_no": c("order_no"), "page": c("page"), "y0": c("y0"), "y1": c("y1"), "right": c("right"), "section_path": c("section_path"), "text": F.when(c("shaped"), c("text")),
        "larger": F.when(c("shaped"), c("larger")), "size": F.coalesce("size", F.lit(0.0)), "major": major,
    }
    nothing = F.lit(None)
    element = F.struct(F.lit(1).alias("kind"), *[v.alias(k) for k, v in own.items()])
    size = F.struct(F.lit(0).alias("kind"), *[(c("size") if k == "size" else nothing.cast(at.select(v).schema[0].dataType)).alias(k) for k, v in own.items()])
    both = F.when(c("omission") & sized, F.array(size)).when(c("omission"), nothing).when(sized, F.array(size, element)).otherwise(F.array(element))
    # outer, as Spark would otherwise work out the rows of an element a second time, to see whether there are any
    rows = at.select("doc_id", F.inline_outer(both)).filter(c("kind").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = _Sections()
        for batch in batches:
            yield fold.take(batch)
        yield fold.close()

    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "kind", "order_no").mapInArrow(run, f"doc_id long, {SECTION}")


class _Sections:
    """The fold over sorted batches: sizes of the document at hand, the section at hand, and the rows of a heading that may go on."""

    def __init__(self):
        self.doc, self.sizes, self.counts = None, np.empty(0), np.empty(0, np.int64)
        self.where, self.above, self.section = None, "", ""
        self.rest: pa.Table | None = None
        self.due = 0

    def _bodies(self, batch: pa.RecordBatch, doc: np.ndarray) -> np.ndarray:
        """The body size of each document of a batch, 0 without one; ``doc`` numbers them by row, from 0."""
        size_row = batch["kind"].to_numpy() == 0
        at, sizes = doc[size_row], batch["size"].to_numpy(zero_copy_only=False)[size_row]
        counts = np.ones(len(at), np.int64)
        if self.doc is not None and batch["doc_id"][0].as_py() == self.doc:
            at, sizes, counts = np.concatenate((np.zeros(len(self.sizes), np.int64), at)), np.concatenate((self.sizes, sizes)), np.concatenate((self.counts, counts))
        order = np.lexsort((sizes, at))
        at, sizes, upto = at[order], sizes[order], np.cumsum(counts[order])
        self.doc = batch["doc_id"][-1].as_py()
        last = at == doc[-1]
        self.sizes, back = np.unique(sizes[last], return_inverse=True)
        self.counts = np.bincount(back, counts[order][last], len(self.sizes)).astype(np.int64)
        body = np.zeros(doc[-1] + 1)
        if len(at):
            first = np.flatnonzero(np.diff(at, prepend=-1))
            before, total = upto[first] - counts[order][first], np.add.reduceat(counts[order], first)
            low, high = (sizes[np.searchsorted(upto, before + middle, "right")] for middle in ((total - 1) // 2, total // 2))
            body[at[first]] = np.where(low == high, low, 0.5 * low + 0.5 * high)
        return body

    def take(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        if batch.num_rows:
            doc = np.cumsum(np.concatenate(([0], ~_equal(batch["doc_id"]))))
            body = self._bodies(batch, doc)[doc]
            larger, size = batch["larger"].to_numpy(zero_copy_only=False).astype(float), batch["size"].to_numpy(zero_copy_only=False)
            heads = (larger == 0) | ((body > 0) & (size >= body * larger))
            rows = pa.Table.from_batches([batch]).append_column("heads", pa.array(heads)).filter(pc.equal(batch["kind"], 1))
            self.rest = rows if self.rest is None else pa.concat_tables([self.rest, rows])
        # a heading that goes on over many batches is gone through again only when its rows have doubled
        return self._told(False) if self.rest is not None and self.rest.num_rows >= self.due else _sections([], [], [], [], [])

    def close(self) -> pa.RecordBatch:
        return self._told(True)

    def _told(self, last: bool) -> pa.RecordBatch:
        """Rows whose section is known: all but those of a heading that may go on in the next batch."""
        if self.rest is None or not self.rest.num_rows:
            return _sections([], [], [], [], [])
        rows = self.rest.combine_chunks()
        column = lambda name: rows[name].combine_chunks() if isinstance(rows[name], pa.ChunkedArray) else rows[name]
        flag = lambda name: column(name).to_numpy(zero_copy_only=False).astype(bool)
        number = lambda name: column(name).to_numpy(zero_copy_only=False).astype(float)
        ids, outlines = column("doc_id"), column("section_path").dictionary_encode()
        outline = outlines.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        names = [*outlines.dictionary.to_pylist(), None]
        place = lambda i: (ids[i].as_py(), names[outline[i]])
        heads, major, right, y0, y1 = flag("heads"), flag("major"), flag("right"), number("y0"), number("y1")
        begins = np.concatenate(([ids[0].as_py() is None or place(0) != self.where], ~_equal(ids) | (outline[1:] != outline[:-1])))
        near = np.concatenate(([False], _equal(column("page")))) & ~begins
        above = np.concatenate(([np.nan], y1[:-1]))
        # labels at the right of a heading line or of such a label wait with it
        fresh = heads | ~(near & right & (y0 <= above))
        waits = heads[np.maximum.accumulate(np.where(fresh, np.arange(len(heads)), 0))]
        goes_on = np.concatenate(([False], waits[:-1])) & ~begins
        opens = heads & (~goes_on | (near & (y0 - above > np.fmax(GAP, (y1 - y0) * GAP_LINES))) | major)
        firsts = np.flatnonzero(begins | opens | (np.arange(len(heads)) == 0))
        told = len(heads) if last or not waits[-1] else int(firsts[-1])
        lines, bounds = column("text").filter(pa.array(heads)).to_pylist(), np.concatenate(([0], np.cumsum(heads)))
        paths, found = [], []
        for first, end in zip(firsts.tolist(), [*firsts[1:].tolist(), len(heads)], strict=True):
            if first >= told:
                break
            if begins[first]:
                self.above = self.section = ""
            if opens[first]:
                own = lines[bounds[first] : bounds[end]]
                if major[first]:
                    self.above = own[0]
                self.section = " > ".join(dict.fromkeys(p for p in (self.above, *own) if p))
            paths.append(" > ".join(p for p in (names[outline[first]], self.section) if p) or None)
            found.append("pdf_visible_heading" if self.section else None)
        if told:
            self.where = place(told - 1)
        self.rest = rows.slice(told)
        self.due = 2 * self.rest.num_rows
        part = pa.array(np.cumsum(np.isin(np.arange(told), firsts)) - 1)
        return _sections(ids[:told], column("order_no")[:told], heads[:told], pa.array(paths, pa.string()).take(part), pa.array(found, pa.string()).take(part))


def _equal(column: pa.Array) -> np.ndarray:
    """Whether each row but the first has the value of the one before; null is like nothing."""
    return pc.fill_null(pc.equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)


def _sections(doc_id, order_no, heads, path, source) -> pa.RecordBatch:
    block = pc.if_else(pa.array(heads, pa.bool_()), pa.scalar("heading"), pa.scalar(None, pa.string()))
    kinds = {"doc_id": pa.int64(), "order_no": pa.int64(), "block_type": pa.string(), "section_path": pa.string(), "section_source": pa.string()}
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip((doc_id, order_no, block, path, source), kinds.values(), strict=True)], names=list(kinds))
