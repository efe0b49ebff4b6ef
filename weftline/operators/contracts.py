"""Contracts on tables: each raises ValueError with a few of the keys that break it, and returns its input.

A check is one aggregate with a limit; what it finds is at most `SHOWN` keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHOWN = 5


def _refuse(broken: DataFrame, what: str) -> None:
    rows = broken.limit(SHOWN).collect()
    if rows:
        raise ValueError(f"{what}: {', '.join(str(tuple(r)) for r in rows)}")


def unique(df: DataFrame, keys: list[str], what: str = "repeated keys") -> DataFrame:
    """At most one row a key."""
    _refuse(df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys), what)
    return df


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """`left` joined to `right`, in which a key may stand once."""
    return left.join(unique(right, keys, "keys that repeat on the right"), keys, how)


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """`left` joined to `right`; a key may stand once on either side."""
    return many_to_one(unique(left, keys, "keys that repeat on the left"), right, keys, how)


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """`left`, if both have the same keys, as often."""
    a, b = left.select(*keys), right.select(*keys)
    _refuse(a.exceptAll(b).unionAll(b.exceptAll(a)), "keys of one side alone")
    return left


def complete(df: DataFrame, group: list[str], rows: int | None = None, groups: int | None = None) -> DataFrame:
    """Exactly `rows` rows in every group, and exactly `groups` groups."""
    n = df.groupBy(*group).agg(F.count("*").alias("n"))
    if rows is not None:
        _refuse(n.where(F.col("n") != rows), f"groups of other than {rows} rows")
    if groups is not None and (found := n.count()) != groups:
        raise ValueError(f"{found} groups, not {groups}")
    return df


def holds(df: DataFrame, condition: Column, what: str) -> DataFrame:
    """Every row meets the condition; null doesn't."""
    _refuse(df.where(~F.coalesce(condition, F.lit(False))), what)
    return df
