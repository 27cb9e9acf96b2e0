"""Report sinks of bounded size: workbooks, manifests that are replaced as a whole, and packages."""

from __future__ import annotations

import io
import uuid
import json
import math
import zipfile
from datetime import date, datetime
from typing import Any, NamedTuple
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession

#: Rows that a sheet can have below its header.
MAX_ROWS = 1_048_575
_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_TYPES = "http://schemas.openxmlformats.org"


class Sheet(NamedTuple):
    """A table of a workbook: column widths and number formats by column name; formulas fill a column, `{row}` being the row's number."""

    name: str
    table: DataFrame
    widths: dict[str, float] = {}
    formats: dict[str, str] = {}
    formulas: dict[str, str] = {}
    frozen: int = 1


def column_letters(index: int) -> str:
    """A for 0, Z for 25, AA for 26."""
    out = ""
    index += 1
    while index:
        index, digit = divmod(index - 1, 26)
        out = chr(65 + digit) + out
    return out


def _cell(place: str, value: Any, style: int) -> str:
    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return f'<c r="{place}" s="{style}"/>'
    if isinstance(value, bool):
        return f'<c r="{place}" s="{style}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (date, datetime)):
        day = datetime(value.year, value.month, value.day)
        return f'<c r="{place}" s="{style}"><v>{(day - datetime(1899, 12, 30)).days}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{place}" s="{style}"><v>{value}</v></c>'
    return f'<c r="{place}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def _sheet_xml(sheet: Sheet, styles: dict[str, int]) -> tuple[str, int]:
    columns = sheet.table.columns
    rows = sheet.table.limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"sheet {sheet.name!r} has over {MAX_ROWS} rows")
    widths = "".join(f'<col min="{i}" max="{i}" width="{sheet.widths.get(c, 16)}" customWidth="1"/>' for i, c in enumerate(columns, 1))
    out = ["<row r=\"1\">" + "".join(_cell(f"{column_letters(i)}1", c, 1) for i, c in enumerate(columns)) + "</row>"]
    for r, row in enumerate(rows, 2):
        cells = []
        for i, c in enumerate(columns):
            place, style = f"{column_letters(i)}{r}", styles.get(sheet.formats.get(c, "yyyy-mm-dd" if isinstance(row[i], date) else ""), 0)
            cells.append(f'<c r="{place}" s="{style}"><f>{escape(sheet.formulas[c].format(row=r))}</f></c>' if c in sheet.formulas else _cell(place, row[i], style))
        out.append(f'<row r="{r}">{"".join(cells)}</row>')
    pane = f'<pane xSplit="{sheet.frozen}" ySplit="1" topLeftCell="{column_letters(sheet.frozen)}2" state="frozen"/>' if sheet.frozen else '<pane ySplit="1" topLeftCell="A2" state="frozen"/>'
    bounds = f"A1:{column_letters(len(columns) - 1)}{len(rows) + 1}"
    return f'{_HEAD}<worksheet {_NS}><sheetViews><sheetView showGridLines="0" workbookViewId="0">{pane}</sheetView></sheetViews><cols>{widths}</cols><sheetData>{"".join(out)}</sheetData><autoFilter ref="{bounds}"/></worksheet>', len(rows)


def workbook_bytes(sheets: list[Sheet]) -> bytes:
    """An XLSX file of the sheets in order, each with a header, widths, formats, formulas, frozen panes and a filter."""
    formats = sorted({f for s in sheets for f in s.formats.values()} | {"yyyy-mm-dd"})
    styles = {f: i for i, f in enumerate(formats, 2)}
    numbers = "".join(f'<numFmt numFmtId="{163 + i}" formatCode={quoteattr(f)}/>' for f, i in styles.items())
    style = (
        f'{_HEAD}<styleSheet {_NS}><numFmts count="{len(styles)}">{numbers}</numFmts><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders>'
        f'<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(styles) + 2}"><xf/><xf fontId="1" applyFont="1"/>{"".join(f"<xf numFmtId=\"{163 + i}\" applyNumberFormat=\"1\"/>" for i in styles.values())}</cellXfs></styleSheet>'
    )
    ids = range(1, len(sheets) + 1)
    book = "".join(f'<sheet name={quoteattr(s.name)} sheetId="{i}" r:id="r{i}"/>' for i, s in zip(ids, sheets, strict=True))
    links = "".join(f'<Relationship Id="r{i}" Type="{_TYPES}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in ids)
    links += f'<Relationship Id="s" Type="{_TYPES}/officeDocument/2006/relationships/styles" Target="styles.xml"/>'
    main = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = f'<Override PartName="/xl/workbook.xml" ContentType="{main}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{main}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{main}.worksheet+xml"/>' for i in ids)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_TYPES}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_TYPES}/package/2006/relationships"><Relationship Id="w" Type="{_TYPES}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f"{_HEAD}<workbook {_NS}><sheets>{book}</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_TYPES}/package/2006/relationships">{links}</Relationships>')
        z.writestr("xl/styles.xml", style)
        for i, sheet in zip(ids, sheets, strict=True):
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet_xml(sheet, styles)[0])
    return buffer.getvalue()


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def replace_file(spark: SparkSession, path: str, content: bytes) -> None:
    """Written beside the target and renamed onto it in one step, so that a reader sees the old or the new whole, and a failure leaves the old."""
    target, fs = _path(spark, path)
    temporary, _ = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(temporary, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()
    hadoop, gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    over = gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    own = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    own.rename(fs.makeQualified(temporary), fs.makeQualified(target), over)


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """A JSON document that is replaced as a whole each time an item is done."""
    replace_file(spark, path, (json.dumps(manifest, indent=2) + "\n").encode())


def write_workbook(spark: SparkSession, path: str, sheets: list[Sheet]) -> None:
    replace_file(spark, path, workbook_bytes(sheets))


def package(spark: SparkSession, base: str, required: list[str], out: str, prefix: str) -> int:
    """A ZIP of the required files below base, under prefix; the number of them. A missing one raises before anything is written."""
    for name in required:
        path, fs = _path(spark, f"{base}/{name}")
        if not fs.exists(path):
            raise FileNotFoundError(f"{base}/{name}")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as z:
        for row in spark.read.format("binaryFile").load([f"{base}/{name}" for name in required]).select("path", "content").toLocalIterator():
            z.writestr(f"{prefix}/{next(n for n in required if row.path.endswith('/' + n))}", bytes(row.content))
    replace_file(spark, out, buffer.getvalue())
    return len(required)
