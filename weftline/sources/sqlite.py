"""SQLite and GeoPackage files: the rows of a query, read on the executors, a file a time."""

from __future__ import annotations

import sqlite3

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def database_rows(files: DataFrame, query: str, schema: str) -> DataFrame:
    """The rows of `query` over each database of `files` (path, content), with the names and types of `schema`; null is null. Databases are opened in memory and never written."""

    def run(batches):
        for batch in batches:
            for content in batch["content"]:
                with sqlite3.connect(":memory:") as connection:
                    connection.deserialize(bytes(content))
                    cursor = connection.execute(query)
                    names = [c[0] for c in cursor.description]
                    while rows := cursor.fetchmany(50_000):
                        yield pd.DataFrame(rows, columns=names).astype(object).where(lambda v: v.notna(), None)

    return files.select("content").mapInPandas(run, schema)


def read_table(spark: SparkSession, path: str, table: str, schema: str, where: str = "1") -> DataFrame:
    """The columns of `schema` of a table of the databases at `path`, with SQLite doing the filter."""
    columns = ", ".join('"' + part.split()[0] + '"' for part in schema.split(","))
    return database_rows(spark.read.format("binaryFile").load(path), f'SELECT {columns} FROM "{table}" WHERE {where}', schema)


def centres_query(table: str, key: str = "territory_id", index: str | None = None, at: int | None = None) -> str:
    """SQL for (key, year_from, lon, lat): the middle of each row's box in the R-tree of a GeoPackage's table, of versions valid in year `at` (closed)."""
    index = index or f"rtree_{table}_geom"
    valid = "1" if at is None else f"p.year_from <= {int(at)} AND p.year_to >= {int(at)}"
    return f'SELECT CAST(p."{key}" AS INTEGER) AS "{key}", p.year_from AS year_from, (r.minx + r.maxx) / 2 AS lon, (r.miny + r.maxy) / 2 AS lat FROM "{table}" p JOIN "{index}" r ON p.fid = r.id WHERE {valid}'
