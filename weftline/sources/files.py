"""Text sources: CSV with inferred types or all as text, JSON documents, and a check that files are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def required(spark: SparkSession, paths: list[str]) -> None:
    """Raise FileNotFoundError naming every path that isn't there; any file system that Spark reads."""
    conf, hadoop = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    gone = [p for p in paths if not (at := hadoop(p)).getFileSystem(conf).exists(at)]
    if gone:
        raise FileNotFoundError("required files are missing: " + ", ".join(gone))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True) -> DataFrame:
    """A CSV file with a header; types by `schema`, or inferred by a pass over the file. Empty cells are null. Where no cell has a line break, `multi_line` False lets a file be split among tasks."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_csv_text(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A CSV file with a header, every cell as text; empty cells are empty texts. `multi_line` as in read_csv()."""
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path)
    return rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns])


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One JSON document a file, or an array of them."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)
