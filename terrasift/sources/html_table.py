"""Rows of HTML tables."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame


class _Rows(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[list[str], list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append(([], []))
        elif tag == "td" and self.rows:
            self.cell = []
        elif tag == "a" and self.cell is not None and (href := dict(attrs).get("href")):
            self.rows[-1][1].append(href)

    def handle_endtag(self, tag):
        if tag in ("td", "tr") and self.cell is not None:
            self.rows[-1][0].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def rows_of(page: str | None) -> list[tuple[list[str], list[str]]]:
    parser = _Rows()
    parser.feed(page or "")
    parser.close()
    return parser.rows


def table_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, row_no from 0, cells, hrefs) of every table row; header cells don't count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, cells, hrefs) for k, page in zip(batch[key], batch[html], strict=True) for i, (cells, hrefs) in enumerate(rows_of(page))]
            yield pd.DataFrame(rows, columns=[key, "row_no", "cells", "hrefs"])

    return pages.select(key, html).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, row_no int, cells array<string>, hrefs array<string>")
