"""Workbooks without a spreadsheet library: a writer of small sheets with values, formulas and a few styles.

A workbook is a report for people: it takes the rows of a selection, whose number is checked, not a whole table.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Sequence
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

MOST_ROWS = 100_000
FORBIDDEN = re.compile(r"[\[\]:*?/\\]")
STYLES = {"plain": 0, "title": 1, "head": 2, "number": 3, "good": 4, "bad": 5}
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_PACK = "http://schemas.openxmlformats.org/package/2006"
_DRAW = "http://schemas.openxmlformats.org/drawingml/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


class Formula(str):
    """A cell that the viewer calculates; without the equals sign."""


def column_name(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def unique_names(names: Sequence[str]) -> list[str]:
    """Names of sheets: allowed characters, at most 31 of them, different whatever the case."""
    out: list[str] = []
    for name in names:
        base = FORBIDDEN.sub("-", name).strip("' ")[:31] or "Sheet"
        pick, k = base, 1
        while pick.lower() in {x.lower() for x in out}:
            k += 1
            pick = f"{base[: 31 - len(str(k)) - 3]} ({k})"
        out.append(pick)
    return out


def _cell(ref: str, value: object, style: int) -> str:
    s = f' s="{style}"' if style else ""
    if value is None or value == "":
        return f'<c r="{ref}"{s}/>' if style else ""
    if isinstance(value, Formula):
        return f'<c r="{ref}"{s}><f>{escape(value)}</f></c>'
    if isinstance(value, bool):
        return f'<c r="{ref}"{s} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"{s}><v>{value!r}</v></c>'
    return f'<c r="{ref}"{s} t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


@dataclass
class Chart:
    """Columns side by side: titles, where the categories are, (name, values) of each series, and the cell (column, row from
    0) at which its corner lies."""

    title: str
    across: str
    up: str
    categories: str
    series: list[tuple[str, str]]
    at: tuple[int, int]

    def xml(self) -> str:
        said = lambda t: f'<c:title><c:tx><c:rich><a:bodyPr/><a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p></c:rich></c:tx><c:overlay val="0"/></c:title>'
        drawn = "".join(
            f'<c:ser><c:idx val="{i}"/><c:order val="{i}"/><c:tx><c:strRef><c:f>{escape(name)}</c:f></c:strRef></c:tx>'
            f"<c:cat><c:strRef><c:f>{escape(self.categories)}</c:f></c:strRef></c:cat><c:val><c:numRef><c:f>{escape(values)}</c:f></c:numRef></c:val></c:ser>"
            for i, (name, values) in enumerate(self.series)
        )
        axis = lambda kind, own, other, side, t: f'<c:{kind}><c:axId val="{own}"/><c:scaling><c:orientation val="minMax"/></c:scaling><c:delete val="0"/><c:axPos val="{side}"/>{said(t)}<c:crossAx val="{other}"/></c:{kind}>'
        return (
            f'{_XML}<c:chartSpace xmlns:c="{_DRAW}/chart" xmlns:a="{_DRAW}/main"><c:chart>{said(self.title)}<c:plotArea><c:layout/>'
            f'<c:barChart><c:barDir val="col"/><c:grouping val="clustered"/>{drawn}<c:axId val="1"/><c:axId val="2"/></c:barChart>'
            f'{axis("catAx", 1, 2, "b", self.across)}{axis("valAx", 2, 1, "l", self.up)}</c:plotArea><c:legend><c:legendPos val="r"/></c:legend></c:chart></c:chartSpace>'
        )


def _drawing(charts: Sequence[Chart]) -> str:
    """Where the charts of a sheet lie; the i-th is relation i."""
    frames = "".join(
        f"<xdr:oneCellAnchor><xdr:from><xdr:col>{c.at[0]}</xdr:col><xdr:colOff>0</xdr:colOff><xdr:row>{c.at[1]}</xdr:row><xdr:rowOff>0</xdr:rowOff></xdr:from><xdr:ext cx=\"5760000\" cy=\"2880000\"/>"
        f'<xdr:graphicFrame><xdr:nvGraphicFramePr><xdr:cNvPr id="{i + 1}" name="Chart {i}"/><xdr:cNvGraphicFramePr/></xdr:nvGraphicFramePr><xdr:xfrm><a:off x="0" y="0"/><a:ext cx="0" cy="0"/></xdr:xfrm>'
        f'<a:graphic><a:graphicData uri="{_DRAW}/chart"><c:chart xmlns:c="{_DRAW}/chart" r:id="rId{i}"/></a:graphicData></a:graphic></xdr:graphicFrame><xdr:clientData/></xdr:oneCellAnchor>'
        for i, c in enumerate(charts, 1)
    )
    return f'{_XML}<xdr:wsDr xmlns:xdr="{_DRAW}/spreadsheetDrawing" xmlns:a="{_DRAW}/main" xmlns:r="{_OFFICE}">{frames}</xdr:wsDr>'


class Sheet:
    def __init__(self, name: str, freeze: str | None = None, filtered: str | None = None):
        self.name, self.freeze, self.filtered, self.rows = name, freeze, filtered, []
        self.charts: list[Chart] = []

    def add(self, *values: object, style: str = "plain") -> int:
        """Appends a row of values, or of (value, style) pairs; returns its number."""
        self.rows.append([v if isinstance(v, tuple) else (v, style) for v in values])
        return len(self.rows)

    def xml(self) -> str:
        view = ""
        if self.freeze:
            m = re.fullmatch(r"([A-Z]+)(\d+)", self.freeze)
            x = sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(m[1]))) - 1
            view = f'<sheetViews><sheetView workbookViewId="0"><pane xSplit="{x}" ySplit="{int(m[2]) - 1}" topLeftCell="{self.freeze}" activePane="bottomRight" state="frozen"/></sheetView></sheetViews>'
        body = "".join(f'<row r="{r}">{"".join(_cell(f"{column_name(c)}{r}", v, STYLES[s]) for c, (v, s) in enumerate(row))}</row>' for r, row in enumerate(self.rows, 1))
        tail = f'<autoFilter ref="{self.filtered}"/>' if self.filtered else ""
        return f'{_XML}<worksheet xmlns="{_MAIN}" xmlns:r="{_OFFICE}">{view}<sheetData>{body}</sheetData>{tail}{'<drawing r:id="rId1"/>' if self.charts else ""}</worksheet>'


def workbook(sheets: Sequence[Sheet]) -> bytes:
    """B1: the file of sheets, in order."""
    names = unique_names([s.name for s in sheets])
    n = range(1, len(sheets) + 1)
    font = lambda x: f"<font><sz val=\"11\"/>{x}<name val=\"Calibri\"/></font>"
    fill = lambda x: f'<fill><patternFill patternType="solid"><fgColor rgb="{x}"/></patternFill></fill>'
    xf = lambda f, p, k: f'<xf numFmtId="{k}" fontId="{f}" fillId="{p}" borderId="0" xfId="0" applyFont="1" applyFill="1" applyNumberFormat="1"/>'
    styles = (
        f'{_XML}<styleSheet xmlns="{_MAIN}"><fonts count="2">{font("")}{font("<b/>")}</fonts><fills count="5"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>'
        f'{fill("FFD9E1F2")}{fill("FFC6EFCE")}{fill("FFFFC7CE")}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs>'
        f'<cellXfs count="6">{xf(0, 0, 0)}{xf(1, 0, 0)}{xf(1, 2, 0)}{xf(0, 0, 2)}{xf(0, 3, 0)}{xf(0, 4, 0)}</cellXfs></styleSheet>'
    )
    parts = {
        "[Content_Types].xml": f'{_XML}<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n) + "</Types>",
        "_rels/.rels": f'{_XML}<Relationships xmlns="{_PACK}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{_XML}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>' + "".join(f'<sheet name="{escape(x, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, x in zip(n, names, strict=True)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'{_XML}<Relationships xmlns="{_PACK}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + f'<Relationship Id="rId{len(sheets) + 1}" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": styles,
    }
    parts |= {f"xl/worksheets/sheet{i}.xml": s.xml() for i, s in zip(n, sheets, strict=True)}
    kinds, drawn = [], 0
    relations = lambda of: f'{_XML}<Relationships xmlns="{_PACK}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_OFFICE}/{kind}" Target="{to}"/>' for i, (kind, to) in enumerate(of, 1)) + "</Relationships>"
    for i, s in zip(n, sheets, strict=True):
        if not s.charts:
            continue
        parts[f"xl/worksheets/_rels/sheet{i}.xml.rels"] = relations([("drawing", f"../drawings/drawing{i}.xml")])
        parts[f"xl/drawings/drawing{i}.xml"] = _drawing(s.charts)
        parts[f"xl/drawings/_rels/drawing{i}.xml.rels"] = relations([("chart", f"../charts/chart{drawn + j}.xml") for j in range(1, len(s.charts) + 1)])
        kinds.append((f"/xl/drawings/drawing{i}.xml", "drawing"))
        for c in s.charts:
            drawn += 1
            parts[f"xl/charts/chart{drawn}.xml"] = c.xml()
            kinds.append((f"/xl/charts/chart{drawn}.xml", "drawingml.chart"))
    own = "".join(f'<Override PartName="{name}" ContentType="application/vnd.openxmlformats-officedocument.{kind}+xml"/>' for name, kind in kinds)
    parts["[Content_Types].xml"] = parts["[Content_Types].xml"].replace("</Types>", f"{own}</Types>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def rows_of(df: DataFrame, most: int = MOST_ROWS) -> list:
    """The rows of a report; an error if there are more than a workbook should hold."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write a table instead of a workbook")
    return rows
