"""Cells of sheets as they are shown: number and date formats."""

from __future__ import annotations

import re
from datetime import date, datetime, time, timedelta
from decimal import ROUND_HALF_UP, Decimal
from xml.etree import ElementTree

# The formats that numbers stand for, those of dates, and which are followed to the letter.
BUILT_IN = {0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 49: "@"}
DATES = {"yyyy-mm-dd": "%Y-%m-%d", "mm/dd/yyyy": "%m/%d/%Y", "dd/mm/yyyy": "%d/%m/%Y", "yyyy-mm-dd hh:mm:ss": "%Y-%m-%d %H:%M:%S"}
NUMBER = re.compile(r"(?P<sign>[$€£]?)(?P<whole>#,##0|0)(?:\.(?P<places>0+))?(?P<percent>%?)")
PADDED = re.compile(r"0+")
QUOTED = re.compile(r'"[^"]*"|\\.|\[(?!hh?\]|mm?\]|ss?\])[^\]]*\]')


def is_date(code: str) -> bool:
    """Whether a format shows a date or a time: a letter of one outside quotes and brackets."""
    return bool(re.search(r"[dmhysDMHYS]", QUOTED.sub("", code.split(";")[0]))) and code.lower() != "general"


def moment(serial: float, since_1904: bool = False) -> datetime | time:
    """The day and time of a serial number; less than one day is a time alone. The day that never was, in 1900, is skipped."""
    days, rest = divmod(serial, 1)
    part = timedelta(milliseconds=round(rest * 86_400_000))
    if 0 <= serial < 1 and part.days == 0:
        return (datetime.min + part).time()
    days += 1 if 1 <= serial < 60 and not since_1904 else 0
    return (datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30)) + timedelta(days=days) + part


def number(text: str) -> int | float:
    return int(text) if re.fullmatch(r"[+-]?\d+", text) else float(text)


def shown(value, code: str) -> str:
    """A value under a format code; formats that aren't known leave it as it is."""
    if value is None:
        return ""
    if isinstance(value, date):
        known = DATES.get(code.lower())
        return value.strftime(known) if known else value.isoformat()
    if isinstance(value, bool) or not isinstance(value, int | float):
        return str(value)
    if PADDED.fullmatch(code):
        return f"{int(value):0{len(code)}d}" if value == int(value) else str(value)
    parts = NUMBER.fullmatch(code)
    if not parts:
        return str(value)
    places, share = len(parts["places"] or ""), bool(parts["percent"])
    amount = (Decimal(str(value)) * (100 if share else 1)).quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_UP)
    return f"{parts['sign']}{amount:{',' if ',' in parts['whole'] else ''}.{places}f}{parts['percent']}"


class Styles:
    """The format code of each cell style of a workbook."""

    def __init__(self, styles: bytes | None):
        own, self.codes = {}, []
        for part in ElementTree.fromstring(styles) if styles else ():
            kind = part.tag.rsplit("}", 1)[-1]
            if kind == "numFmts":
                own = {int(x.attrib["numFmtId"]): x.attrib["formatCode"] for x in part}
            elif kind == "cellXfs":
                ids = [int(x.attrib.get("numFmtId", 0)) for x in part]
                self.codes = [own.get(i) or BUILT_IN.get(i, "General") for i in ids]

    def code(self, style: str | None) -> str:
        at = int(style or 0)
        return self.codes[at] if at < len(self.codes) else "General"


def cell_text(kind: str, raw: str | None, formula: str | None, code: str, since_1904: bool) -> str | None:
    """What a numeric, logical or formula cell shows; None for an empty one."""
    if raw is None:
        return None if formula is None else f"Formula ={formula} (cached value unavailable)"
    if kind == "b":
        return str(raw.strip() == "1")
    if kind in ("e", "str", "d"):
        return raw
    value = number(raw)
    return shown(moment(value, since_1904) if is_date(code) else value, code)
