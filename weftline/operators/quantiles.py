"""Exact quantiles by group that never meet in one buffer.

One pass keeps, per group and column, a summary of bounded size that names two values with the place
sought between them (ranks are known to a ten-thousandth). A second pass counts what lies below them
as one number and the rows between them by value, both summed on the map side. A running sum over
those few values, sorted and spilled if need be, finds the place. So no task's memory grows with the
rows of a group. A result that the bounds don't hold is an error and not a wrong number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks in the summary are right to 1 / ACCURACY of the rows; the bounds lie MARGIN of them off the place.
ACCURACY, MARGIN = 10_000, 5e-4
#: A group of no more rows is counted by value as a whole.
SMALL = 20_000


def group_quantiles(df: DataFrame, by: list[str], wanted: dict[str, list[float]], interpolate: bool = True) -> DataFrame:
    """(by, q_<column>: array<double>, ...): for each column the exact quantiles asked for, in order.

    Interpolated between the two places around (n - 1) * p, or else the value at place floor(n * p)
    (the last, if that is none). Nulls don't count; a group without values has null. Null keys are a
    group. `df` is read twice: hand in a table, or something cheap.
    """
    wants = [(c, k, p) for c, ps in wanted.items() for k, p in enumerate(ps)]
    value = lambda c: F.col(c).cast("double")
    ends = [F.percentile_approx(value(c), F.array(F.lit(max(0.0, p - MARGIN)), F.lit(min(1.0, p + MARGIN))), F.lit(ACCURACY)).alias(f"_b{i}") for i, (c, _, p) in enumerate(wants)]
    bounds = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)]).agg(*ends, *[F.count(value(c)).alias(f"_n_{c}") for c in wanted])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)], F.lit(True))
    rows = df.select(*by, *wanted)
    rows = rows.join(bounds, same) if by else rows.crossJoin(F.broadcast(bounds))
    # the bounds are a few places wide only in groups of some size; all rows of a smaller one lie between them
    end = lambda i, c, at: F.when(F.col(f"_n_{c}") > SMALL, F.col(f"_b{i}")[at])
    each = [F.struct(F.lit(i).alias("i"), value(c).alias("v"), end(i, c, 0).alias("low"), end(i, c, 1).alias("high"), F.col(f"_n_{c}").alias("n")) for i, (c, _, _) in enumerate(wants)]
    long = rows.select(*by, F.explode(F.array(*each)).alias("r")).select(*by, "r.*").where("v is not null and (high is null or v <= high)")
    # all that lies below the bounds is one cell, of null value
    cells = long.groupBy(*by, "i", "n", F.when(F.col("low").isNull() | (F.col("v") >= F.col("low")), F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    upto = cells.withColumn("upto", F.sum("c").over(Window.partitionBy(*by, "i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)))
    p = F.get(F.array(*[F.lit(float(x)) for _, _, x in wants]), F.col("i"))
    place = (F.col("n") - 1) * p if interpolate else F.least(F.floor(F.col("n") * p), F.col("n") - 1).cast("double")
    upto = upto.withColumn("place", place)
    at = lambda where: F.min(F.when(F.col("upto") > (F.floor("place") if where == "a" else F.ceil("place")), F.struct("upto", "v"))).alias(where)
    found = upto.groupBy(*by, "i").agg(at("a"), at("b"), F.first("place").alias("place"))
    exact = F.col("a.v").isNotNull() & F.col("b.v").isNotNull()
    between = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("place") - F.floor("place"))
    value_at = F.when(exact, between).otherwise(F.raise_error(F.lit("a quantile lies outside its bounds")))
    found = found.select(*by, "i", value_at.alias("v"))
    out = found.groupBy(*by).agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"_v{i}") for i in range(len(wants))])
    # groups without any value have no cell
    names = [F.array(*[F.col(f"_v{i}") for i, (c, _, _) in enumerate(wants) if c == name]).alias(f"q_{name}") for name in wanted]
    kept = out.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(by)], *[f"_v{i}" for i in range(len(wants))])
    back = reduce(lambda a, b: a & b, [F.col(f"_k{i}").eqNullSafe(F.col(f"_o{i}")) for i in range(len(by))], F.lit(True))
    keys = bounds.select(*[f"_k{i}" for i in range(len(by))]) if by else None
    if keys is None:
        return kept.select(*names)
    return keys.join(kept, back, "left").select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(by)], *names)


def group_medians(df: DataFrame, by: list[str], columns: list[str], suffix: str = "") -> DataFrame:
    """(by, <column><suffix>, ...): the exact median of each column."""
    got = group_quantiles(df, by, {c: [0.5] for c in columns})
    return got.select(*by, *[first(c).alias(f"{c}{suffix}") for c in columns])


def first(column: str, at: int = 0) -> Column:
    """The quantile at a place of what group_quantiles() returns for a column."""
    return F.get(F.col(f"q_{column}"), F.lit(at))
