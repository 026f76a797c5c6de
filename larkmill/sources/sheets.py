"""Small tables as Office Open XML sheets: a writer of one sheet, and a reader of what it writes."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

from . import store

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
#: A sheet's own limit, less the header.
MOST_ROWS = 1_048_575
#: Letters that XML can't hold.
BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _letters(column: int) -> str:
    out = ""
    while column >= 0:
        out, column = chr(65 + column % 26) + out, column // 26 - 1
    return out


def _cell(value: object, column: int, row: int) -> str:
    at = f"{_letters(column)}{row}"
    if value is None or isinstance(value, float) and (value != value or abs(value) == float("inf")):
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(BAD.sub("", str(value)))}</t></is></c>'


def sheet_bytes(columns: list[str], rows: list[tuple], name: str = "Sheet1") -> bytes:
    """A workbook of one sheet: a header and rows. Nulls and numbers that a sheet can't hold are empty cells."""
    lines = [f'<row r="{i}">{"".join(_cell(v, j, i) for j, v in enumerate(own))}</row>' for i, own in enumerate([tuple(columns), *rows], 1)]
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets><sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, text in parts.items():
            z.writestr(zipfile.ZipInfo(path), (HEAD + text).encode())
    return out.getvalue()


def write_sheet(df: DataFrame, path: str, order: list) -> int:
    """df, ordered, as one sheet; for reports, which are small: more rows than a sheet holds raise. Returns the number of rows."""
    rows = [tuple(r) for r in df.orderBy(*order).limit(MOST_ROWS + 1).collect()]
    if len(rows) > MOST_ROWS:
        raise ValueError("more rows than a sheet holds")
    store.put_bytes(df.sparkSession, path, sheet_bytes(df.columns, rows))
    return len(rows)


def read_sheet(spark: SparkSession, path: str) -> tuple[list[str], list[tuple]]:
    """(header, rows) of a workbook's first sheet with inline texts; empty cells are None."""
    with zipfile.ZipFile(io.BytesIO(store.read_bytes(spark, path))) as z:
        root = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
    table = []
    for row in root.iter(f"{{{MAIN}}}row"):
        own: dict[int, object] = {}
        for c in row.iter(f"{{{MAIN}}}c"):
            place = 0
            for letter in re.match("[A-Z]+", c.get("r"))[0]:
                place = place * 26 + ord(letter) - 64
            if c.get("t") == "inlineStr":
                own[place - 1] = "".join(t.text or "" for t in c.iter(f"{{{MAIN}}}t"))
            else:
                text = c.find(f"{{{MAIN}}}v").text
                own[place - 1] = text == "1" if c.get("t") == "b" else float(text) if re.search("[.en]", text) else int(text)
        table.append(own)
    width = len(table[0]) if table else 0
    rows = [tuple(own.get(i) for i in range(width)) for own in table]
    return list(rows[0]) if rows else [], rows[1:]
