"""Registers: validity intervals, latest versions, name matching, crosswalks and status cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_at(versions: DataFrame, at: Column, low: str = "valid_from", high: str = "valid_to", closed: bool = False) -> DataFrame:
    """Versions whose interval holds `at`, half-open or closed at its end; an open end is null."""
    upper = F.col(high) >= at if closed else F.col(high) > at
    return versions.where((F.col(low) <= at) & (F.col(high).isNull() | upper))


#: The ratio of the cell widths of neighbouring levels.
_FINER = 8


def _line(column: Column, kind: str) -> Column:
    """A date, time or number as a place on a line, in the same order."""
    if kind == "date":
        return F.unix_date(column).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(column.cast("timestamp")).cast("double")
    return column.cast("double")


def interval_join(facts: DataFrame, versions: DataFrame, keys: list[str], at: str, low: str = "valid_from", high: str = "valid_to", closed: bool = False) -> DataFrame:
    """`facts` with the columns of the versions of equal `keys` whose interval holds column `at`, half-open or closed at its end.

    Time is cut into cells, eight times wider from level to level. A version lies in the one or two
    cells of the level that is as wide as itself, a fact in one cell of each level in use, and both
    are joined by key, level and cell: so a key with many short versions and many facts meets cell
    by cell, and pairs that the exact condition then rejects are those of one cell. An open end is
    null and reaches to the last fact. Facts without a version go, as do null keys and null times.
    """
    facts_at, from_, to = (_line(F.col(c), dict(df.dtypes)[c]) for df, c in ((facts, at), (versions, low), (versions, high)))
    own = [c for c in versions.columns if c not in keys]
    last = facts.agg(F.max(facts_at).alias("_last"))
    named = versions.where(F.col(low).isNotNull()).crossJoin(F.broadcast(last))
    end = F.greatest(F.coalesce(to, "_last"), from_)
    level = F.greatest(F.lit(0), F.ceil(F.log(float(_FINER), F.greatest(end - from_, F.lit(1.0))))).cast("int")
    named = named.select(*[F.col(k).alias(f"_{k}") for k in keys], *own, from_.alias("_from"), end.alias("_end"), level.alias("_level"))
    cell = lambda x, lv: F.floor(x / F.pow(F.lit(float(_FINER)), lv))
    named = named.withColumn("_cell", F.explode(F.sequence(cell(F.col("_from"), F.col("_level")), cell(F.col("_end"), F.col("_level"))))).drop("_from", "_end")
    # a level for each power of eight between the shortest and the longest version: at most some twenty
    levels = named.agg(F.array_sort(F.collect_set("_level")).alias("_levels"))
    marked = facts.where(F.col(at).isNotNull()).crossJoin(F.broadcast(levels)).withColumn("_at_level", F.explode("_levels")).drop("_levels")
    marked = marked.withColumn("_at_cell", cell(facts_at, F.col("_at_level")))
    upper = F.col(high) >= F.col(at) if closed else F.col(high) > F.col(at)
    cond = (F.col("_level") == F.col("_at_level")) & (F.col("_cell") == F.col("_at_cell")) & (F.col(low) <= F.col(at)) & (F.col(high).isNull() | upper)
    for k in keys:
        cond &= F.col(k) == F.col(f"_{k}")
    return marked.join(named, cond).drop(*[f"_{k}" for k in keys], "_level", "_cell", "_at_level", "_at_cell")


def box_join(left: DataFrame, right: DataFrame, width: float = 1.0) -> DataFrame:
    """(left_id, right_id): the boxes (id, x0, x1, y0, y1) of both sides that meet, their edges included.

    A grid of cells is the index: levels of cells twice as wide from one to the next, from `width` on,
    and a box in the at most four cells of the first level that is as wide as itself, and in those of
    all coarser levels in use. Two boxes are joined on the level of the larger one, and reported from
    the one cell that holds the lower corner of what they share. Boxes with a null or an end before
    their beginning meet nothing.
    """
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    level = F.greatest(F.lit(0), F.ceil(F.log(2.0, F.greatest(side, F.lit(width)) / width))).cast("int")
    ok = (F.col("x1") >= F.col("x0")) & (F.col("y1") >= F.col("y0"))
    both = [df.where(ok).select(*[F.col(c).cast("double").alias(c) if c != "id" else F.col(c) for c in ("id", "x0", "x1", "y0", "y1")]).withColumn("own", level) for df in (left, right)]
    levels = both[0].select("own").unionByName(both[1].select("own")).agg(F.array_sort(F.collect_set("own")).alias("levels"))
    at = lambda v, lv: F.floor(v / (width * F.pow(F.lit(2.0), lv)))
    sides = []
    for df, name in zip(both, ("l", "r"), strict=True):
        rows = df.crossJoin(F.broadcast(levels)).withColumn("level", F.explode(F.filter("levels", lambda v: v >= F.col("own")))).drop("levels")
        rows = rows.withColumn("cx", F.explode(F.sequence(at(F.col("x0"), F.col("level")), at(F.col("x1"), F.col("level")))))
        rows = rows.withColumn("cy", F.explode(F.sequence(at(F.col("y0"), F.col("level")), at(F.col("y1"), F.col("level")))))
        sides.append(rows.select("level", "cx", "cy", *[F.col(c).alias(f"{name}_{c}") for c in ("id", "x0", "x1", "y0", "y1", "own")]))
    found = sides[0].join(sides[1], ["level", "cx", "cy"]).where(F.greatest("l_own", "r_own") == F.col("level"))
    meets = (F.col("l_x0") <= F.col("r_x1")) & (F.col("r_x0") <= F.col("l_x1")) & (F.col("l_y0") <= F.col("r_y1")) & (F.col("r_y0") <= F.col("l_y1"))
    here = (at(F.greatest("l_x0", "r_x0"), F.col("level")) == F.col("cx")) & (at(F.greatest("l_y0", "r_y0"), F.col("level")) == F.col("cy"))
    return found.where(meets & here).select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"))


def crosswalk(register: DataFrame, ids: DataFrame, key: str, code: str, years: list[int], low: str = "year_from", high: str = "year_to") -> DataFrame:
    """(key, year, code): each id's normalised code in each year, from the version that is valid then (half-open)."""
    per_year = ids.select(key).distinct().withColumn("year", F.explode(F.array(*[F.lit(y) for y in years])))
    return interval_join(per_year, register.select(key, code, low, high), [key], "year", low, high).select(key, "year", code8(F.col(code)).alias("code"))


def latest(versions: DataFrame, key: str, by: str, tie: str) -> DataFrame:
    """The last version of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(by), F.desc(tie))
    return versions.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def normal_name(name: Column) -> Column:
    """Lower-cased letters and digits only, yo folded to ye."""
    return F.regexp_replace(F.translate(F.lower(name), "ё", "е"), "[^a-zа-я0-9]", "")


def name_candidates(entities: DataFrame, register: DataFrame, key: str, other: str) -> DataFrame:
    """(key, candidates): how many different `other` of `register` have a normalised name of the entity in its region; both have (id, region, names array). Empty names match nothing."""

    def aliases(df, ident):
        names = F.array_distinct(F.transform("names", normal_name))
        return df.select(ident, "region", F.explode(names).alias("name")).where("name <> ''")

    m = aliases(entities, key).join(aliases(register, other), ["region", "name"]).groupBy(key).agg(F.count_distinct(other).alias("candidates"))
    return entities.select(key).distinct().join(m, key, "left").fillna(0, ["candidates"])


def code8(value: Column) -> Column:
    """A municipal code as 8 digits: white space of any kind and hyphens go, 7 digits get a zero, 11 are cut; others are null."""
    v = F.regexp_replace(value, r"(?U)[\s-]", "")
    return F.when(v.rlike("^[0-9]{7}$"), F.concat(F.lit("0"), v)).when(v.rlike("^[0-9]{8}$"), v).when(v.rlike("^[0-9]{11}$"), F.substring(v, 1, 8))


def match_status(n: Column) -> Column:
    return F.when(n == 1, "matched").when(n > 1, "ambiguous").otherwise("missing")


def value_status(values: Column) -> Column:
    """missing, invalid (any that isn't finite or is negative), conflict or ok for the list of an entity's values."""
    bad = F.exists(values, lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf")))
    return F.when(F.size(values) == 0, "missing").when(bad, "invalid").when(F.size(F.array_distinct(values)) > 1, "conflict").otherwise("ok")


def status_cascade(value: Column, *reviews: tuple[str, Column]) -> Column:
    """The status of the list of values, where that is ok the first of (name, whether it applies) that does, else ok."""
    first = value_status(value)
    out = F.lit("ok")
    for name, applies in reversed(reviews):
        out = F.when(F.coalesce(applies, F.lit(False)), name).otherwise(out)
    return F.when(first == "ok", out).otherwise(first)


def value_lists(facts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, values): the values of each key in a list, those that are null as well."""
    held = F.collect_list(F.struct(value))
    return facts.groupBy(*keys).agg(F.transform(held, lambda x: x[value]).alias("values"))


def with_lists(rows: DataFrame, lists: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with `values` of their key, an empty list where it has none."""
    kind = dict(lists.dtypes)["values"]
    return rows.join(lists, keys, "left").withColumn("values", F.coalesce("values", F.array().cast(kind)))


def both_years(coverage: DataFrame, key: str, year: str, n: str, years: list[int]) -> DataFrame:
    """(key, status_<year>..., complete): a status by the number of candidates of each year, complete where every year has exactly one."""
    count = lambda y: F.coalesce(F.max(F.when(F.col(year) == y, F.col(n))), F.lit(0)).alias(f"n_{y}")
    got = coverage.groupBy(key).agg(*[count(y) for y in years])
    whole = F.lit(True)
    for y in years:
        whole &= F.col(f"n_{y}") == 1
    return got.select(key, *[match_status(F.col(f"n_{y}")).alias(f"status_{y}") for y in years], whole.alias("complete"))


def consistent(total: Column, *parts: Column) -> Column:
    """Whether numbers given as text are whole, none is negative, and the parts add up to the total."""
    values = [F.expr("cast(null as bigint)") if p is None else p.try_cast("bigint") for p in (total, *parts)]
    good = F.lit(True)
    for v in values:
        good &= v.isNotNull() & (v >= 0)
    return F.coalesce(good & (values[0] == sum(values[1:], F.lit(0))), F.lit(False))


def read_indicator(rows: DataFrame, code: str, unit: str, period: str, level: str, **extra: str) -> DataFrame:
    """(code, year, value) of one indicator for one period and level, and other columns with given values; another unit than `unit` is an error."""
    got = rows.where((F.col("indicator_code") == code) & (F.col("indicator_period") == period) & (F.col("mun_level") == level))
    for column, value in extra.items():
        got = got.where(F.col(column) == value)
    held = F.when(F.col("indicator_unit").eqNullSafe(F.lit(unit)), F.col("indicator_value")).otherwise(F.raise_error(F.concat(F.lit("unexpected unit: "), F.coalesce("indicator_unit", F.lit("none")))))
    return got.select(F.col("oktmo").alias("code"), "year", held.alias("value"))


def coverage_counts(audit: DataFrame, metric: str = "metric", year: str = "year", status: str = "status") -> DataFrame:
    """(metric, year, status, n)."""
    return audit.groupBy(metric, year, status).agg(F.count("*").alias("n"))


def covered_in_all(audit: DataFrame, key: str, years: int, metric: str = "metric", status: str = "status") -> DataFrame:
    """(metric, both): how many keys are ok in all `years` years."""
    per = audit.groupBy(metric, key).agg(F.count_if(F.col(status) == "ok").alias("n_ok"))
    return per.groupBy(metric).agg(F.count_if(F.col("n_ok") == years).alias("both"))
