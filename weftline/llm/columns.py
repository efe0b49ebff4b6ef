"""Column helpers that several operators share."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole(text: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the quick way where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def no_spaces(text: Column) -> Column:
    """The text without any white space."""
    return F.translate(text, SPACES, "")


def strip(text: Column) -> Column:
    """The text without white space at both ends."""
    return F.btrim(text, F.lit(SPACES))


def let(value: Column, body) -> Column:
    """body(value), with `value` evaluated once however often the body has it."""
    return F.transform(F.array(value), body)[0]


def free(df: DataFrame, *names: str) -> list[str]:
    """For each name, one that no column of `df` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500, size: str = "4m"):
    """Arrow batches of at most `rows` rows and `size` for the jobs run within, so that a Python worker holds few whole texts at once; then the session's own again."""
    ours = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in ours}
    smaller = 0 < int(before["spark.sql.execution.arrow.maxRecordsPerBatch"]) <= rows
    try:
        for k, v in ours.items() if not smaller else ():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items() if not smaller else ():
            spark.conf.set(k, v)
