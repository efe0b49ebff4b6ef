"""Sinks: CSV in a given order, JSON documents without NaN, Markdown tables, and manifests of SHA-256."""

from __future__ import annotations

import hashlib
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fixed(df: DataFrame, digits: int = 6) -> DataFrame:
    """`df` with doubles as text of `digits` places; null stays null."""
    return df.select(*[F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.col(c).cast("double"))).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, order: list, digits: int | None = None, one_file: bool = False) -> None:
    """CSV with a header, rows in `order`: files in that order, or one where the table is known to be small."""
    rows = df.orderBy(*order)
    rows = rows.coalesce(1) if one_file else rows
    (rows if digits is None else fixed(rows, digits)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def without_nan(value: Column, kind) -> Column:
    """`value` of a Spark type, an error where a number in it is NaN or infinite."""
    name = kind.typeName()
    if name in ("double", "float"):
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.raise_error(F.lit("JSON has no NaN or infinity"))).otherwise(value)
    if name == "array":
        return F.transform(value, lambda v: without_nan(v, kind.elementType))
    if name == "struct":
        inner = F.struct(*[without_nan(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), inner)
    return value


def documents(df: DataFrame) -> DataFrame:
    """(value): a JSON document a row, nulls kept; NaN and infinity are errors."""
    cells = [without_nan(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str, order: list) -> None:
    """A JSON document a line, in `order`."""
    documents(df.orderBy(*order)).write.mode("overwrite").text(path)


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """An aligned Markdown table of a small result; more than `most` rows are an error, as a report is for reading."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table holds at most {most} rows")
    text = [df.columns, *[["" if v is None else str(v) for v in r] for r in rows]]
    numeric = [t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal") for _, t in df.dtypes]
    width = [max(3, *(len(r[i].replace("|", "\\|")) for r in text)) for i in range(len(df.columns))]
    line = lambda cells: "| " + " | ".join(c.rjust(w) if n else c.ljust(w) for c, w, n in zip(cells, width, numeric, strict=True)) + " |"
    head, *body = [[c.replace("|", "\\|").replace("\n", " ") for c in r] for r in text]
    return "\n".join([line(head), "| " + " | ".join("-" * (w - 1) + ":" if n else "-" * w for w, n in zip(width, numeric, strict=True)) + " |", *map(line, body)])


def write_report(spark: SparkSession, path: str, title: str, sections: dict[str, DataFrame], most: int = 200) -> None:
    """A Markdown report of a heading and an aligned table a section, as one text file; no table may have more than `most` rows."""
    parts = [f"# {title}", *[f"## {name}\n\n{markdown_table(df, most)}" for name, df in sections.items()]]
    spark.createDataFrame([("\n\n".join(parts),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def report_rows(spark: SparkSession, path: str, cells: int) -> DataFrame:
    """(c0, c1, ...): the cells of the tables' rows of reports, without headings and rules."""
    lines = spark.read.text(path).where("value like '|%'")
    # the line above a rule is a heading, and reports are small: a file is one partition
    place = F.monotonically_increasing_id()
    lines = lines.withColumn("at", place).withColumn("next", F.lead("value").over(Window.partitionBy(F.input_file_name()).orderBy("at")))
    rule = lambda c: F.coalesce(F.col(c).rlike(r"^(\| -+:? )+\|$"), F.lit(False))
    cut_ = F.split(F.regexp_replace("value", r"^\| | \|$", ""), r" \| ")
    return lines.where(~rule("value") & ~rule("next")).select(*[F.trim(F.get(cut_, F.lit(i))).alias(f"c{i}") for i in range(cells)])


def _digest(uri: str, chunk: int) -> tuple[int, str]:
    """Length and SHA-256 of a file's bytes, never more than `chunk` of them in memory."""
    parts = urlsplit(uri)
    files, at = (fs.LocalFileSystem(), unquote(parts.path)) if parts.scheme == "file" else fs.FileSystem.from_uri(uri)
    digest, length = hashlib.sha256(), 0
    with files.open_input_stream(at, compression=None) as stream:
        while block := stream.read(chunk):
            digest.update(block)
            length += len(block)
    return length, digest.hexdigest()


def manifest(spark: SparkSession, paths: list[str], chunk: int = 1 << 23) -> DataFrame:
    """(file, path, length, sha256) of files of any length, empty ones too, each read by one task in pieces of `chunk` bytes; file systems that both Spark and pyarrow know.

    The names come to the driver, as for any table of files.
    """
    names = spark.read.format("binaryFile").load(paths).inputFiles()

    def run(batches):
        for batch in batches:
            got = [_digest(u, chunk) for u in batch["uri"]]
            whole = batch["uri"].map(unquote)
            yield pd.DataFrame({"file": whole.str.rsplit("/", n=1).str[-1], "path": whole, "length": [n for n, _ in got], "sha256": [h for _, h in got]})

    listed = spark.createDataFrame([(n,) for n in names], "uri string").repartition("uri")
    return listed.mapInPandas(run, "file string, path string, length long, sha256 string")
