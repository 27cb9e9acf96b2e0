"""Cells of spreadsheet files, without a spreadsheet library, and their header projection."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _text(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def sheet_cells(content: bytes, sheet: str | None = None) -> Iterator[tuple[int, int, str]]:
    """(row from 1, column from 0, value) of a named sheet, or the first."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [_text(si) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = list(ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"))
        chosen = next((s for s in sheets if sheet in (None, s.get("name"))), None)
        if chosen is None:
            raise ValueError(f"no sheet {sheet!r}")
        target = targets[chosen.get(f"{_REL}id")].lstrip("/")
        for c in ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_MAIN}c"):
            letters, row = re.fullmatch("([A-Z]+)([0-9]+)", c.get("r")).groups()
            column = 0
            for x in letters:
                column = column * 26 + ord(x) - 64
            v = c.find(f"{_MAIN}v")
            value = _text(c) if c.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
            if value is not None:
                yield int(row), column - 1, value


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """(path, row, col, value) of all files; one task reads one file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch.path, batch.content, strict=True):
                yield pd.DataFrame([(name, *cell) for cell in sheet_cells(content, sheet)], columns=["path", "row", "col", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row long, col long, value string")


def header_rows(cells: DataFrame, names: list[str], key: list[str] | None = None) -> DataFrame:
    """(…key, row, col, value) -> one row per sheet row with a column for each place; empty values null, rows without a first value dropped.
    The first sheet row is the header and is left out."""
    key = key or []
    wide = cells.where("row > 1").groupBy(*key, "row").pivot("col", list(range(len(names)))).agg(F.first("value"))
    wide = wide.select(*key, "row", *[F.nullif(F.trim(F.col(str(i))), F.lit("")).alias(n) for i, n in enumerate(names)])
    return wide.where(F.col(names[0]).isNotNull())
