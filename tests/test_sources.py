import io
import zipfile

import pytest
from hypothesis import given
from hypothesis import strategies as st

from grainline.sources import blocks, chunker, loaders
from grainline.streaming import jobs


def test_blocks_of_a_markdown_text():
    text = "# A\n\npara one\n\n```\ncode | x\n```\n## T\n| a | b |\n|---|---|\n| 1 | 2 |\nx\ty\n1\t2\n3\t4\nend"
    found = [(e.modality, e.reason, e.section, e.line_start, e.line_end) for e in blocks.split_blocks(text, "md")]
    assert found == [
        ("text", "prose", "# A", 1, 4),
        ("text", "code_block", "# A", 5, 7),
        ("table", "pipe_table", "# A > ## T", 9, 11),
        ("table", "tab_table", "# A > ## T", 12, 14),
        ("text", "prose", "# A > ## T", 15, 15),
    ]


@given(st.text(alphabet="ab. \n", max_size=400), st.integers(5, 40))
def test_hard_split_is_lossless_and_within_budget(text, budget):
    parts = chunker.hard_split(text, budget, len)
    assert "".join(parts) == text
    assert all(len(p) <= budget for p in parts)


@given(st.text(alphabet="ab .!?\n1", max_size=600))
def test_prose_ranges_cover_all_words_within_the_limit(text):
    spec = chunker.Spec(20, 5, 30, 4)
    ranges = chunker.prose_ranges(text, spec, len)
    covered = set().union(*(range(a, b) for a, b in ranges)) if ranges else set()
    assert all(i in covered for i, c in enumerate(text) if not c.isspace())
    assert all(b - a <= spec.hard for a, b in ranges)


def test_spec_of_known_models():
    s = chunker.Spec.for_model(256)
    assert (s.target, s.overlap, s.hard) == (180, 20, 220)
    assert chunker.Spec.for_model(512).hard == 476
    with pytest.raises(ValueError):
        chunker.Spec.for_model(3)


def test_table_rows_repeat_the_header():
    table = "| k | v |\n| --- | --- |\n" + "\n".join(f"| {i} | value {i} |" for i in range(40))
    parts = chunker.table_parts(table, chunker.Spec(100, 5, 140, 4), len)
    assert len(parts) > 3 and all(p.startswith("| k | v |\n| --- | --- |\n") and len(p) <= 140 for p in parts)
    assert all(any(f"| {i} | value {i} |" in p for p in parts) for i in range(40))


def test_html_spans_and_sections():
    page = b"<h1>T</h1><p>x &amp; y<script>no</script></p><table><tr><th colspan=2>h</th></tr><tr><td>1</td><td>2</td></tr></table><img src=a>"
    found = [(e.reason, e.section, e.text) for e in loaders.load_html(page)]
    assert found == [("html_heading", "T", "T"), ("html_text", "T", "x & y"), ("html_table", "T", "| h | h |\n| --- | --- |\n| 1 | 2 |"), ("omitted_visual", "T", "")]


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_docx_and_xlsx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    assert [(e.reason, e.section, e.text) for e in loaders.load("x.docx", archive({"word/document.xml": doc}))] == [("docx_heading", "Head", "Head"), ("docx_text", "Head", "Body"), ("docx_table", "Head", "| a |\n| --- |")]
    book = {
        "xl/workbook.xml": '<workbook><sheets><sheet name="S"/></sheets></workbook>',
        "xl/sharedStrings.xml": "<sst><si><t>k</t></si></sst>",
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>2</v></c></row></sheetData></worksheet>',
    }
    assert [(e.section, e.text) for e in loaders.load("x.xlsx", archive(book))] == [("S", "| k | 2 |\n| --- | --- |")]


def test_sheets_are_found_by_their_relationships():
    sheet = '<worksheet><sheetData><row><c r="A1"><v>{}</v></c></row></sheetData></worksheet>'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    book = {
        "xl/workbook.xml": f'<workbook {r}><sheets><sheet name="B" r:id="rId7"/><sheet name="A" r:id="rId3"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId3" Target="worksheets/sheet1.xml"/><Relationship Id="rId7" Target="/xl/worksheets/sheet4.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": sheet.format(1),
        "xl/worksheets/sheet4.xml": sheet.format(4),
    }
    assert [(e.section, e.text.split("\n")[0]) for e in loaders.load("x.xlsx", archive(book))] == [("B", "| 4 |"), ("A", "| 1 |")]


def test_too_wide_cells_are_refused():
    page = b"<table><tr><td colspan=%d>x</td></tr></table>"
    assert [loaders.load("x.html", page % n)[0].reason for n in (1000, 1001)] == ["html_table", "unsafe_content"]


def test_wide_tables_name_their_cells():
    table = "cap\n| key | " + "long name " * 15 + "|\n| --- | --- |\n| k1 | " + "v " * 90 + "|\n| k2 |  |"
    spec = chunker.Spec(60, 5, 160, 4)
    found = chunker.table_parts(table, spec, len)
    assert all(len(x) <= 160 for x in found) and all(x.startswith("Table ") for x in found)
    assert any(x.endswith("Row 2; column 2: (empty)") for x in found) and any("column 2 header: long name" in x for x in found)
    named = chunker.wide_records("| a | b |", ["| 1 | x |"], "", spec, len)
    assert named == ["Row 1; column 1 (a); key 1: 1", "Row 1; column 2 (b); key 1: x"]
    with pytest.raises(ValueError):
        chunker.wide_records("| a | b |", ["| 1 |"], "", spec, len)


def test_prose_of_one_context_is_joined(spark):
    rows = [(1, 0, "text", "text", "prose", "# A", "one", 1, 1), (1, 1, "text", "text", "prose", "# A", "two", 3, 4), (1, 2, "text", "text", "code_block", "# A", "x = 1", 5, 6), (1, 3, "text", "text", "prose", "# A", "three", 7, 7), (1, 4, "text", "text", "prose", "# B", "four", 8, 8), (2, 0, "text", "text", "prose", "# B", "five", 1, 1)]
    found = chunker.join_prose(spark.createDataFrame(rows, loaders.SCHEMA)).orderBy("doc_id", "n").collect()
    assert [(r.doc_id, r.n, r.text) for r in found] == [(1, 0, "one\n\ntwo"), (1, 2, "x = 1"), (1, 3, "three"), (1, 4, "four"), (2, 0, "five")]
    assert [(s.element, s.start, s.end, s.element_end, s.line_end) for s in found[0].sources] == [(0, 0, 3, 3, 1), (1, 5, 8, 3, 4)]
    small, large = (chunker.chunk(spark.createDataFrame(rows, loaders.SCHEMA), spec, len).orderBy("doc_id", "element", "part").collect() for spec in (chunker.Spec(8, 1, 16, 1), chunker.Spec(30, 1, 40, 1)))
    told = lambda chunks: [(c.text.removeprefix(c.section + "\n\n"), [s.element for s in c.sources]) for c in chunks]
    assert told(small)[:4] == [("one", [0]), ("two", [1]), ("x = 1", [2]), ("three", [3])]
    assert told(large)[:3] == [("one\n\ntwo", [0, 1]), ("x = 1", [2]), ("three", [3])]
    assert chunker.source_range("a  b\nc d", "b c") == (3, 6) and chunker.source_range("abc", "x") is None and chunker.source_range("abc", " ") is None


def test_unsafe_broken_and_unknown_files_are_reported():
    bomb = archive({"a": "0" * 10_000_000})
    assert [loaders.load(n, d)[0].reason for n, d in (("x.docx", bomb), ("x.docx", b"zz"), ("x.zzz", b""), ("x.pdf", b""))] == ["unsafe_content", "unreadable", "unknown_extension", "loader_missing"]


def test_csv_keeps_text():
    assert loaders.load_csv(b"\xef\xbb\xbfid,v\n01,NA\n2,\n")[0].text == "| id | v |\n| --- | --- |\n| 01 | NA |\n| 2 |  |"


def test_refused_requests_leave_no_trace():
    assert jobs.admit([0, 1, 2, 59, 60.5, 61.5], 2, 60.0)[0] == [True, True, False, False, True, True]


def test_elements_leave_a_task_piece_by_piece(spark):
    import pyarrow as pa

    from grainline.sources import loaders

    class Frame:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    page = b"<p>a</p>" * 400 + b"<p>" + b"x" * 1000 + b"</p>"
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(["p.html"] * 100), pa.array([page] * 100, pa.binary())], names=["doc_id", "filename", "content"])
    found = list(loaders.extract(Frame())(iter([batch])))
    # as many as are held and those of one file, not those of the whole batch
    assert sum(b.num_rows for b in found) == 40_100 and max(b.num_rows for b in found) <= loaders.HELD_ROWS + 401
    assert [b.column(1)[0].as_py() for b in found if b.num_rows] == [0] * len([b for b in found if b.num_rows])
