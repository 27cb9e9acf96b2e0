"""GeoJSON and spreadsheets as formats of spark.read and of df.write: files are read and written by tasks, and filters skip files, sheets and features."""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, WriterCommitMessage

_BOUNDS = ("xmin", "ymin", "xmax", "ymax")
#: Bytes from a collection's beginning in which its bounds are looked for.
_HEAD = 4096
#: Small files share a partition up to so many bytes.
_TOGETHER = 32 << 20
#: Rows of a file that a task writes; then it begins another.
_FEATURES, _SHEET_ROWS = 200_000, 1_000_000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (pafs.LocalFileSystem(), path)


def _files(path: str, ending: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of those below a folder that end so; what begins with a dot or an underscore is not read."""
    store, own = _store(path)
    info = store.get_file_info(own)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(own, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.endswith(ending) and not f.base_name.startswith((".", "_")))


def holds(filter_: Filter, value) -> bool:
    """Whether a pushed filter holds for a value; for null none does."""
    if value is None:
        return False
    if isinstance(filter_, In):
        return value in filter_.value
    own = filter_.value
    if isinstance(filter_, StringEndsWith):
        return value.endswith(own)
    kinds = {EqualTo: value == own, GreaterThan: value > own, GreaterThanOrEqual: value >= own, LessThan: value < own, LessThanOrEqual: value <= own}
    return kinds[type(filter_)]


_KNOWN = (EqualTo, In, StringEndsWith, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)


@dataclass
class Files(InputPartition):
    """Files of a task, each with the sheet it is to read, if that matters."""

    paths: list[tuple[str, str | None]]


class _Reader(DataSourceReader):
    """What both formats share: filters on `columns` are kept and rows that fail them skipped; a filter on the path leaves files out."""

    columns: tuple[str, ...] = ()
    ending = ""

    def __init__(self, options: dict):
        self.path, self.filters = options["path"], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, _KNOWN) and len(f.attribute) == 1 and f.attribute[0] in self.columns:
                self.filters.append(f)
            else:
                yield f

    def of(self, column: str) -> list[Filter]:
        return [f for f in self.filters if f.attribute[0] == column]

    def files(self) -> list[tuple[str, int]]:
        return [(p, n) for p, n in _files(self.path, self.ending) if all(holds(f, p) for f in self.of("path"))]

    def partitions(self) -> list[Files]:
        out, size = [], _TOGETHER
        for path, n in self.files():
            if size + n > _TOGETHER:
                out.append(Files([]))
                size = 0
            out[-1].paths.append((path, None))
            size += n
        return out or [Files([])]


# GeoJSON -----------------------------------------------------------------------------------------------------------------


def _corners(coordinates) -> Iterator[tuple[float, float]]:
    if coordinates and isinstance(coordinates[0], (int, float)):
        yield coordinates[0], coordinates[1]
    else:
        for c in coordinates or ():
            yield from _corners(c)


def _bounds(geometry: dict | None) -> tuple:
    parts = [geometry] if geometry and "geometries" not in geometry else (geometry or {}).get("geometries", [])
    pts = [p for g in parts for p in _corners(g.get("coordinates"))]
    return (min(x for x, _ in pts), min(y for _, y in pts), max(x for x, _ in pts), max(y for _, y in pts)) if pts else (None,) * 4


class GeoJsonReader(_Reader):
    columns, ending = ("path", "geometry_type", *_BOUNDS), ".geojson"

    def skipped(self, head: bytes) -> bool:
        """Whether the bounds that a collection states before its features rule all of them out."""
        found = re.match(rb'\s*\{[^\[{]*"bbox"\s*:\s*(\[[^\]]*\])', head)
        if not found:
            return False
        box = json.loads(found[1])
        low, high = box[: len(box) // 2], box[len(box) // 2 :]
        for i, (a, b) in enumerate((("xmin", "xmax"), ("ymin", "ymax"))):
            for f in self.of(a) + self.of(b):  # some value between low and high must do
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and not holds(f, high[i]) or isinstance(f, (LessThan, LessThanOrEqual)) and not holds(f, low[i]):
                    return True
        return False

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, _ in partition.paths:
            store, own = _store(path)
            with store.open_input_file(own) as f:
                head = f.read(_HEAD)
                if self.skipped(head):
                    continue
                f.seek(0)
                document = json.loads(f.read())
            features = document["features"] if document.get("type") == "FeatureCollection" else [document]
            for number, feature in enumerate(features):
                geometry = feature.get("geometry")
                row = {"path": path, "geometry_type": geometry and geometry["type"], **dict(zip(_BOUNDS, map(lambda v: None if v is None else float(v), _bounds(geometry)), strict=True))}
                if all(holds(f, row[f.attribute[0]]) for f in self.filters):
                    yield path, number, *[row[c] for c in ("geometry_type", *_BOUNDS)], json.dumps(feature.get("properties"), ensure_ascii=False), json.dumps(geometry)


class _Writer(DataSourceWriter):
    """Each task writes files of its own; they get their names when all have ended, so a failed or repeated task leaves nothing behind."""

    def __init__(self, options: dict, schema, overwrite: bool):
        self.path, self.columns, self.overwrite = options["path"], [f.name for f in schema.fields], overwrite

    def commit(self, messages: list) -> None:
        store, own = _store(self.path)
        store.create_dir(own, recursive=True)
        if self.overwrite:
            for path, _ in _files(self.path, ""):
                store.delete_file(path)
        for message in messages:
            for name in message.files if message else ():
                store.move(f"{own}/{name}", f"{own}/{name[1:]}")

    def abort(self, messages: list) -> None:
        store, own = _store(self.path)
        for message in messages:
            for name in message.files if message else ():
                store.delete_file(f"{own}/{name}")


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def _plain(value):
    if hasattr(value, "asDict"):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else value


class GeoJsonWriter(_Writer):
    """Rows with a column `geometry` of GeoJSON text; the other columns are properties."""

    def write(self, rows: Iterator) -> Written:
        store, own = _store(self.path)
        store.create_dir(own, recursive=True)
        names, features, bounds = [], [], []

        def close() -> None:
            names.append(f".part-{uuid.uuid4().hex}.geojson")
            box = [f(b[i] for b in bounds if b[i] is not None) if any(b[i] is not None for b in bounds) else None for i, f in enumerate((min, min, max, max))]
            head = {"type": "FeatureCollection"} | ({} if None in box else {"bbox": box})
            with store.open_output_stream(f"{own}/{names[-1]}") as out:
                out.write((json.dumps(head)[:-1] + ', "features": [' + ",\n".join(features) + "]}").encode())
            features.clear()
            bounds.clear()

        for row in rows:
            values = dict(zip(self.columns, row, strict=True))
            geometry = json.loads(values.pop("geometry") or "null")
            features.append(json.dumps({"type": "Feature", "properties": _plain_all(values), "geometry": geometry}, ensure_ascii=False))
            bounds.append(_bounds(geometry))
            if len(features) >= _FEATURES:
                close()
        if features:
            close()
        return Written(names)


def _plain_all(values: dict) -> dict:
    return {k: _plain(v) for k, v in values.items()}


class GeoJson(DataSource):
    """format("geojson"): a row a feature; properties and geometry as JSON text, and the geometry's bounds."""

    @classmethod
    def name(cls) -> str:
        return "geojson"

    def schema(self) -> str:
        return "path string, feature_no long, geometry_type string, xmin double, ymin double, xmax double, ymax double, properties string, geometry string"

    def reader(self, schema) -> GeoJsonReader:
        return GeoJsonReader(self.options)

    def writer(self, schema, overwrite: bool) -> GeoJsonWriter:
        return GeoJsonWriter(self.options, schema, overwrite)


# spreadsheets ------------------------------------------------------------------------------------------------------------


def _sheets(z: zipfile.ZipFile) -> dict[str, str]:
    """Path in the archive of each sheet, by name."""
    targets = {r.get("Id"): r.get("Target").lstrip("/") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    own = lambda t: t if t.startswith("xl/") else f"xl/{t}"
    return {s.get("name"): own(targets[s.get(f"{_REL}id")]) for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")}


def _text(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


class XlsxReader(_Reader):
    columns, ending = ("path", "sheet", "row", "col"), ".xlsx"

    def partitions(self) -> list[Files]:
        out = []
        for path, _ in self.files():
            store, own = _store(path)
            with store.open_input_file(own) as f, zipfile.ZipFile(f) as z:
                out += [Files([(path, name)]) for name in _sheets(z) if all(holds(x, name) for x in self.of("sheet"))]
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, sheet in partition.paths:
            store, own = _store(path)
            with store.open_input_file(own) as f, zipfile.ZipFile(f) as z:
                shared = [_text(si) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in z.namelist() else []
                with z.open(_sheets(z)[sheet]) as body:
                    for _, node in ET.iterparse(body):  # a row at a time
                        if node.tag == f"{_MAIN}row":
                            yield from self.cells(node, path, sheet, shared)
                            node.clear()

    def cells(self, node: ET.Element, path: str, sheet: str, shared: list[str]) -> Iterator[tuple]:
        for c in node.iter(f"{_MAIN}c"):
            letters, row = re.fullmatch("([A-Z]+)([0-9]+)", c.get("r")).groups()
            col = 0
            for x in letters:
                col = col * 26 + ord(x) - 64
            v = c.find(f"{_MAIN}v")
            value = _text(c) if c.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
            at = {"path": path, "sheet": sheet, "row": int(row), "col": col - 1}
            if value is not None and all(holds(f, at[f.attribute[0]]) for f in self.filters):
                yield path, sheet, int(row), col - 1, value


class XlsxWriter(_Writer):
    """Each file one sheet with a header row; nulls are empty cells."""

    def write(self, rows: Iterator) -> Written:
        store, own = _store(self.path)
        store.create_dir(own, recursive=True)
        names, body = [], []

        def close() -> None:
            names.append(f".part-{uuid.uuid4().hex}.xlsx")
            with store.open_output_stream(f"{own}/{names[-1]}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("[Content_Types].xml", _TYPES)
                z.writestr("_rels/.rels", _RELS.format("officeDocument", "xl/workbook.xml"))
                z.writestr("xl/_rels/workbook.xml.rels", _RELS.format("worksheet", "worksheets/sheet1.xml"))
                z.writestr("xl/workbook.xml", _BOOK)
                with z.open("xl/worksheets/sheet1.xml", "w") as sheet:
                    sheet.write(f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
                    for number, row in enumerate([self.columns, *body], 1):
                        cells = "".join(_cell(i, number, v) for i, v in enumerate(row) if v is not None)
                        sheet.write(f'<row r="{number}">{cells}</row>'.encode())
                    sheet.write(b"</sheetData></worksheet>")
            body.clear()

        for row in rows:
            body.append(tuple(row))
            if len(body) >= _SHEET_ROWS:
                close()
        if body:
            close()
        return Written(names)


def _cell(column: int, row: int, value) -> str:
    letters, column = "", column + 1
    while column:
        column, rest = divmod(column - 1, 26)
        letters = chr(65 + rest) + letters
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f'<c r="{letters}{row}"><v>{value!r}</v></c>'
    return f'<c r="{letters}{row}" t="inlineStr"><is><t xml:space="preserve">{escape(str(_plain(value)))}</t></is></c>'


# The parts that the format asks for.
_TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
_RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{}" Target="{}"/></Relationships>'
_BOOK = f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>'


class Xlsx(DataSource):
    """format("xlsx"): a row a cell, a partition a sheet; what is written is a file a task with a header row."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return "path string, sheet string, row long, col long, value string"

    def reader(self, schema) -> XlsxReader:
        return XlsxReader(self.options)

    def writer(self, schema, overwrite: bool) -> XlsxWriter:
        return XlsxWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Both formats made known to a session, which may hand them filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (GeoJson, Xlsx):
        spark.dataSource.register(source)
    return spark


def read(spark: SparkSession, kind: str, path: str) -> DataFrame:
    return register(spark).read.format(kind).load(path)
