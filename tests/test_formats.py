"""Cells as they are shown: numbers, shares, padded codes, days and times."""

import random
from datetime import datetime, time
from fractions import Fraction

import pytest

from grainline.sources import loaders
from grainline.sources.formats import cell_text, is_date, moment, shown

from .test_sources import archive


@pytest.mark.parametrize(
    "value,code,text",
    [
        (7, "000", "007"), (-7, "000", "-07"), (7.5, "000", "7.5"), (1234.5, "#,##0", "1,235"), (1234.5, "0", "1234.5"), (-0.125, "0.00", "-0.13"), (0.125, "0.0%", "12.5%"), (1234567, "$#,##0.00", "$1,234,567.00"), (2.5, "€0", "€3"),
        (1.005, "0.00", "1.01"), (3, "General", "3"), (3.0, "General", "3.0"), (1e21, "0", "1000000000000000000000"), (3, "# ?/?", "3"), (True, "0.00", "True"), (None, "0", ""), ("text", "0", "text"),
        (datetime(2024, 3, 5, 14, 30), "yyyy-mm-dd", "2024-03-05"), (datetime(2024, 3, 5), "DD/MM/YYYY", "05/03/2024"), (datetime(2024, 3, 5, 14, 30), "yyyy-mm-dd hh:mm:ss", "2024-03-05 14:30:00"), (datetime(2024, 3, 5), "mm-dd-yy", "2024-03-05T00:00:00"), (time(6), "h:mm", "06:00:00"),
    ],
)
def test_shown(value, code, text):
    assert shown(value, code) == text


def test_rounding_is_half_up_on_the_digits_as_written():
    draw = random.Random(1)
    for _ in range(2000):
        digits, places = draw.randint(0, 6), draw.randint(0, 4)
        value = round(draw.uniform(-5000, 5000), digits)
        exact = abs(Fraction(repr(value))) * 10**places
        want = (exact + Fraction(1, 2)).__floor__()
        text = shown(value, "#,##0" + ("." + "0" * places if places else ""))
        assert int(text.replace(",", "").replace(".", "").replace("-", "")) == want


def test_days_and_formats_of_days():
    assert moment(45356.604166666664) == datetime(2024, 3, 5, 14, 30) and moment(1) == datetime(1900, 1, 1) and moment(61) == datetime(1900, 3, 1)
    assert moment(0.25) == time(6) and moment(0, True) == time(0) and moment(1, True) == datetime(1904, 1, 2)
    assert [is_date(c) for c in ("yyyy", "0.00", '0 "days"', "[Red]0", "[h]:mm", "General", "d-mmm;@", r"0\d")] == [True, False, False, False, True, False, True, False]
    assert cell_text("n", None, "A1+1", "General", False) == "Formula =A1+1 (cached value unavailable)"
    assert [cell_text("b", "1", None, "0", False), cell_text("e", "#N/A", None, "0", False), cell_text("n", None, None, "0", False)] == ["True", "#N/A", None]


def test_a_workbook_shows_its_formats():
    cells = '<c r="A1" t="inlineStr"><is><t>k</t></is></c><c r="B1" s="1"><v>1234.5</v></c><c r="C1" s="2"><v>45356</v></c><c r="D1" s="3"><v>0.125</v></c><c r="E1"><v>7</v></c><c r="F1"><f>A1</f></c><c r="G1" s="9"><v>1.50</v></c>'
    book = {
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/styles.xml": '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/></numFmts><cellXfs><xf/><xf numFmtId="4"/><xf numFmtId="164"/><xf numFmtId="10"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f"<worksheet><sheetData><row r='1'>{cells}</row></sheetData></worksheet>",
    }
    (sheet,) = loaders.load("x.xlsx", archive(book))
    assert sheet.text.split("\n")[0] == "| k | 1,234.50 | 2024-03-05 | 12.50% | 7 | Formula =A1 (cached value unavailable) | 1.5 |"
