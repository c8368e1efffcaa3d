"""Workbook (.xlsx) folders as one table: each file is one task's input record.

A worksheet is capped at 1,048,576 rows by its format, so one file always fits a
task; a folder of any number of files spreads over the cluster.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

_NS = {
    "m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
    "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
    "p": "http://schemas.openxmlformats.org/package/2006/relationships",
}
_ROW = "{%s}row" % _NS["m"]
_BATCH = 10_000


def _sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet name to its part inside the archive, in workbook order."""
    links = {
        rel.get("Id"): rel.get("Target", "")
        for rel in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).findall("p:Relationship", _NS)
    }
    out = {}
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _NS):
        target = links[sheet.get("{%s}id" % _NS["r"])]
        out[sheet.get("name")] = target.lstrip("/") if target.startswith("/") else "xl/" + target
    return out


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter("{%s}t" % _NS["m"])) for item in root.findall("m:si", _NS)]


def _column_index(ref: str) -> int:
    n = 0
    for letter in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def _cell_text(cell, shared: list[str]) -> str:
    if cell.get("t") == "inlineStr":
        return "".join(t.text or "" for t in cell.iter("{%s}t" % _NS["m"]))
    value = cell.find("m:v", _NS)
    text = "" if value is None else value.text or ""
    if cell.get("t") == "s":
        return shared[int(text)]
    if cell.get("t") == "b":
        return "TRUE" if text == "1" else "FALSE"
    return text


def _rows(content: bytes, sheet: str) -> Iterator[tuple[str, int, dict[str, str]]]:
    """(sheet, row number, header name to cell text) of one workbook, the header row left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        sheets = _sheets(book)
        name = sheet or next(iter(sheets))
        if name not in sheets:
            raise ValueError(f"no sheet named {name!r}; the workbook has {list(sheets)}")
        shared = _shared_strings(book)
        header: dict[int, str] | None = None
        with book.open(sheets[name]) as part:
            for position, (_, row) in enumerate(((e, x) for e, x in ElementTree.iterparse(part) if x.tag == _ROW), 1):
                number = int(row.get("r") or position)
                cells = {
                    _column_index(c.get("r")) if c.get("r") else i: _cell_text(c, shared)
                    for i, c in enumerate(row.findall("m:c", _NS))
                }
                row.clear()
                if header is None:
                    header = cells
                else:
                    yield name, number, {header[i]: v for i, v in cells.items() if i in header}


def read_cells(spark: SparkSession, path: str, sheet: str = "") -> DataFrame:
    """Long form ``(path, sheet, row_no, cells)`` of every workbook under ``path``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                rows = []
                for name, number, cells in _rows(content, sheet):
                    rows.append((file, name, number, cells))
                    if len(rows) == _BATCH:
                        yield pd.DataFrame(rows, columns=["path", "sheet", "row_no", "cells"])
                        rows = []
                yield pd.DataFrame(rows, columns=["path", "sheet", "row_no", "cells"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select("path", "content").mapInPandas(parse, "path string, sheet string, row_no int, cells map<string,string>")


def read_workbooks(spark: SparkSession, path: str, sheet: str = "", columns: Sequence[str] = ()) -> DataFrame:
    """One text column per header name; cells a row lacks are null.

    Without ``columns`` a first pass collects the distinct header names, which
    the format caps at 16,384 per sheet.
    """
    cells = read_cells(spark, path, sheet)
    names = list(columns) or sorted(
        r["name"] for r in cells.select(F.explode(F.map_keys("cells")).alias("name")).distinct().collect()
    )
    return cells.select("path", "sheet", "row_no", *[F.col("cells")[n].alias(n) for n in names])


def list_sheets(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sheet)`` of every workbook, in workbook order."""

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    found = list(_sheets(book))
                yield pd.DataFrame({"path": [file] * len(found), "position": range(1, len(found) + 1), "sheet": found})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select("path", "content").mapInPandas(names, "path string, position int, sheet string").orderBy("path", "position")
