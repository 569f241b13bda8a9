"""Spreadsheet workbooks (.xlsx) as rows of cells and as stacked sheets.

A workbook is a zip archive of XML parts; tasks unpack it with the standard
library, and each task streams the cells of its own workbooks.
"""

from __future__ import annotations

from collections.abc import Iterator
import io
import re
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "workbook string, sheet_no int, sheet_name string, row int, col int, value string"
_BATCH = 50_000


def _tag(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - ord("A") + 1
    return n


def _sheets(book: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    """(name, archive path) of the sheets, in workbook order."""
    targets = {}
    for rel in ET.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        target = rel.attrib["Target"]
        targets[rel.attrib["Id"]] = target.lstrip("/") if target.startswith("/") else "xl/" + target
    for el in ET.fromstring(book.read("xl/workbook.xml")).iter():
        if _tag(el) == "sheet":
            ref = next(v for k, v in el.attrib.items() if k.endswith("}id"))
            yield el.attrib["name"], targets[ref]


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter() if _tag(t) == "t")
            for si in ET.fromstring(book.read("xl/sharedStrings.xml"))]


def _cells(book: zipfile.ZipFile, path: str, shared: list[str]):
    row = col = 0
    with book.open(path) as part:
        for _, el in ET.iterparse(part):
            if _tag(el) != "row":
                continue
            row = int(el.attrib.get("r", row + 1))
            col = 0
            for c in el:
                col = _column(c.attrib["r"]) if "r" in c.attrib else col + 1
                kind = c.attrib.get("t", "n")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter() if _tag(t) == "t")
                else:
                    text = next((v.text for v in c if _tag(v) == "v"), None)
                    if kind == "s" and text is not None:
                        text = shared[int(text)]
                if text is not None:
                    yield row, col, text
            el.clear()


def _read_books(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in CELLS.split(", ")]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as book:
                shared = _shared(book)
                rows = []
                for no, (sheet, part) in enumerate(_sheets(book), 1):
                    for row, col, text in _cells(book, part, shared):
                        rows.append((path, no, sheet, row, col, text))
                        if len(rows) == _BATCH:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Every cell of every workbook under ``path``."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
             .select("path", "content"))
    return files.mapInPandas(_read_books, CELLS)


def read_sheets_long(spark: SparkSession, path: str, ids: list[str]) -> DataFrame:
    """All sheets stacked: ``workbook, sheet_name, *ids, column, value``.

    Row 1 of a sheet is its header; ``sheet_name`` is the sheet's position as text.
    The identifying columns come from their cells by name, so sheets may order
    or lack columns; every other column becomes a row.
    """
    cells = read_cells(spark, path)
    sheet = ["workbook", "sheet_no"]
    header = cells.filter("row = 1").select(*sheet, "col", F.col("value").alias("column"))
    body = cells.filter("row > 1").join(header, [*sheet, "col"])
    is_id = F.col("column").isin(ids)
    # grouped aggregates rather than a pivot: the ids of a row are a handful of cells
    labels = body.filter(is_id).groupBy(*sheet, "row").agg(
        *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in ids])
    values = body.filter(~is_id).select(*sheet, "row", "column", "value")
    return values.join(labels, [*sheet, "row"], "left").select(
        "workbook", F.col("sheet_no").cast("string").alias("sheet_name"), *ids, "column", "value")
