"""Scalar functions: rounding, formats, months, names, search and places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounded to the nearest, ties to the even digit."""
    return F.bround(x, digits)


def percent(x: Column, digits: int = 1) -> Column:
    """A share as text, 0.123 as 12.3%."""
    return F.format_string(f"%.{digits}f%%", (100 * x).cast("double"))


def clamp(x: Column, low: float, high: float) -> Column:
    """Where x lies between low and high, from 0 to 1."""
    return F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def finite(x: Column) -> Column:
    """Whether x is a number: not null, NaN or infinite."""
    v = x.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def log10_bounds(low: Column, high: Column) -> tuple[Column, Column]:
    """The powers of ten around positive values."""
    return F.pow(F.lit(10.0), F.floor(F.log10(low))), F.pow(F.lit(10.0), F.ceil(F.log10(high)))


def month_index(period: Column, first_year: int) -> Column:
    """Months since January of first_year, of a period as YYYY-MM."""
    return (F.substring(period, 1, 4).cast("int") - first_year) * 12 + F.substring(period, 6, 2).cast("int") - 1


def month_label(index: Column, first_year: int) -> Column:
    """The period as YYYY-MM of a month's index."""
    return F.format_string("%04d-%02d", (F.floor(index / 12) + first_year).cast("int"), (F.pmod(index, F.lit(12)) + 1).cast("int"))


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def prefix_key(code: Column, length: int = 8, whole: int = 10) -> Column:
    """The first digits of a code of `whole` digits once white space is gone; null for any other."""
    v = F.regexp_replace(code, r"(?U)\s", "")
    return F.when(v.rlike(f"^[0-9]{{{whole}}}$"), F.substring(v, 1, length))


def shortened(text: Column, most: int = 20) -> Column:
    """At most `most` characters, the last an ellipsis where some are cut off."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def projected(lon: Column, lat: Column, width: float = 930, height: float = 360, left: float = 35, top: float = 28, west: float = 19, span: float = 171, north: float = 82, tall: float = 41) -> tuple[Column, Column]:
    """A linear place on a map; longitudes below 0 are beyond the date line and go on from 360."""
    east = F.when(lon < 0, lon + 360).otherwise(lon)
    return left + (east - west) / span * width, top + (north - lat) / tall * height


def centre(known: Column, low: Column, high: Column) -> Column:
    """A known coordinate, or the middle of a box where there is none."""
    return F.coalesce(known, (low + high) / 2)


def labels(df: DataFrame, name: str, region: str, full: str) -> DataFrame:
    """`df` with `search_label`: name and region, and the full name where that alone is ambiguous."""
    key = F.concat_ws(", ", name, region)
    n = F.count("*").over(Window.partitionBy(name, region))
    return df.withColumn("search_label", F.when(n > 1, F.concat_ws(", ", key, F.col(full))).otherwise(key))


def search(df: DataFrame, query: str, key: str, name: str, region: str) -> DataFrame:
    """(df, exact): the rows whose search_label is the query, whatever its case, first, then by key those with it in the name or region. An empty query finds nothing."""
    q = F.lower(F.lit(query.strip()))
    exact = F.lower("search_label") == q
    part = F.lower(name).contains(q) | F.lower(region).contains(q)
    return df.withColumn("exact", exact).where((q != "") & (exact | part)).orderBy(F.desc("exact"), key)
