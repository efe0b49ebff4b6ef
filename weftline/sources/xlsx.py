"""XLSX workbooks: the rows of a sheet as arrays of text, and sheets with a header as columns.

Workbooks are read by Spark's binary source, so any file system that Spark reads will do, and parsed
on the executors, one workbook a time.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: XML name spaces of the file format
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _column(reference: str) -> int:
    """The place from 0 of a cell's column, from letters as in AB12."""
    place = 0
    for c in re.match(r"[A-Z]*", reference).group():
        place = 26 * place + ord(c) - 64
    return place - 1


def sheet_cells(content: bytes, name: str | None) -> Iterator[list[str | None]]:
    """Each row of the sheet `name` (the first one for None) as text, gaps as None, no longer than its last cell."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(f"{_REL}Relationship")}
        sheets = {s.get("name"): links[s.get(f"{_LINK}id")] for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")}
        if name is not None and name not in sheets:
            raise ValueError(f"no sheet {name!r} among {sorted(sheets)}")
        target = sheets[name] if name is not None else next(iter(sheets.values()))
        at = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in root.findall(f"{_MAIN}si")]
        with book.open(at) as stream:
            for _, row in ElementTree.iterparse(stream):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list[str | None] = []
                for cell in row.findall(f"{_MAIN}c"):
                    place = _column(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (place - len(cells))
                    kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
                    if kind == "inlineStr":
                        cells.append("".join(t.text or "" for t in cell.iter(f"{_MAIN}t")))
                    elif value is None or value.text is None:
                        cells.append(None)
                    else:
                        cells.append(shared[int(value.text)] if kind == "s" else value.text)
                yield cells
                row.clear()


def sheet_rows(books: DataFrame, name: str | None = None) -> DataFrame:
    """(path, row, cells) of the sheet `name` of each workbook of `books` (path, content)."""

    def parse(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = list(sheet_cells(bytes(content), name))
                yield pd.DataFrame({"path": path, "row": range(len(rows)), "cells": rows})

    return books.select("path", "content").mapInPandas(parse, "path string, row int, cells array<string>")


def read_sheet(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """(path, row, cells) of a sheet of the workbooks at `path`."""
    return sheet_rows(spark.read.format("binaryFile").load(path), name)


def with_header(rows: DataFrame, columns: list[str], missing: str | None = None) -> DataFrame:
    """(path, row, columns): sheet rows by the names in each workbook's first row; a cell that isn't there is `missing`."""
    head = rows.where("row = 0").select("path", F.col("cells").alias("_head"))
    body = rows.where("row > 0").join(head, "path")
    place = lambda c: F.array_position("_head", c).cast("int") - 1
    return body.select("path", "row", *[F.coalesce(F.when(place(c) >= 0, F.get("cells", place(c))), F.lit(missing)).alias(c) for c in columns])


def dictionary(rows: DataFrame, key: str, numeric: list[str], at: int, low: str = "year_from", high: str = "year_to") -> DataFrame:
    """The last version by `low` of each key that began by year `at`: `numeric` columns as doubles (others than numbers null), the key as long, rows without one gone, and whether it is `active` in that year (closed)."""
    got = rows
    for c in numeric:
        got = got.withColumn(c, F.col(c).try_cast("double"))
    got = got.where(F.col(key).isNotNull()).withColumn(key, F.col(key).cast("long")).where(F.col(low) <= at)
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(low), F.desc("row")))
    return got.withColumn("active", F.coalesce((F.col(low) <= at) & (F.col(high) >= at), F.lit(False))).withColumn("_n", last).where("_n = 1").drop("_n", "path", "row")


def income_rows(sheets: dict[int, DataFrame]) -> DataFrame:
    """(code, year, value) of one sheet a year: rows whose first cell is a number and whose third is a code; a code twice in a year is an error."""
    parts = None
    for year, rows in sheets.items():
        good = (F.size("cells") >= 4) & F.coalesce(F.get("cells", F.lit(0)).rlike("^[0-9]+$"), F.lit(False)) & F.get("cells", F.lit(2)).isNotNull()
        part = rows.where(good).select(F.get("cells", F.lit(2)).alias("_code"), F.lit(year).alias("year"), F.get("cells", F.lit(3)).cast("double").alias("value"))
        parts = part if parts is None else parts.unionByName(part)
    from weftline.operators.reconcile import code8

    got = parts.withColumn("code", code8(F.col("_code"))).groupBy("code", "year").agg(F.count("*").alias("_n"), F.first("value").alias("value"))
    return got.select("code", "year", F.when(F.col("_n") == 1, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("repeated code: "), F.col("code")))).alias("value"))
