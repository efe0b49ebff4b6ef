"""Panel operators: completeness, pivoted features, standardising, audits, reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.quantiles import first, group_medians, group_quantiles
from weftline.shared import cut


def complete(panel: DataFrame, entity: str = "entity", period: str = "period") -> DataFrame:
    """Rows of entities that are observed in all periods of the panel."""
    total = panel.agg(F.count_distinct(period).alias("n_all"))
    full = panel.groupBy(entity).agg(F.count_distinct(period).alias("n")).join(F.broadcast(total)).where("n = n_all").select(entity)
    return panel.join(full, entity, "left_semi")


def pivoted(panel: DataFrame, categories: list[str], entity: str = "entity", period: str = "period") -> DataFrame:
    """Long to wide, one column a category; missing cells are 0."""
    cell = lambda c: F.coalesce(F.sum(F.when(F.col("category") == c, F.col("value"))), F.lit(0.0)).alias(f"c_{c.lower()}")
    return panel.groupBy(entity, period).agg(*[cell(c) for c in categories])


def features(wide: DataFrame, period: str = "period") -> DataFrame:
    """total, relative level ln(total / median of the period) and a share for each category but the last."""
    cats = [c for c in wide.columns if c.startswith("c_")]
    wide = cut(wide.withColumn("total", sum((F.col(c) for c in cats[1:]), F.col(cats[0]))), "wide")
    wide = wide.join(group_medians(wide, [period], ["total"]).withColumnRenamed("total", "_mid"), period)
    level = F.log(F.try_divide(F.col("total"), F.col("_mid")))
    return wide.withColumn("relative_level", level).drop("_mid").select("*", *[F.try_divide(F.col(c), F.col("total")).alias(f"s_{c[2:]}") for c in cats[:-1]])


def centred(df: DataFrame, columns: list[str], period: str = "period") -> DataFrame:
    """`columns` less their period's median, which is one row a period."""
    mids = group_quantiles(df, [period], {c: [0.5] for c in columns}).select(period, *[first(c).alias(f"_mid_{c}") for c in columns])
    return df.join(mids, period).select(*[(F.col(c) - F.col(f"_mid_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def zscored(df: DataFrame, columns: list[str], centre: list[str] = (), period: str = "period", by: tuple[str, ...] = ()) -> DataFrame:
    """Columns standardised over all rows, or those of a value of `by`, with the population deviation, those of `centre` less their period's median first; a constant column is 0. The input is written once, as it is read for the moments and for the rows."""
    if centre:
        df = cut(centred(cut(df, "panel"), list(centre), period), "centred")
    stats = df.groupBy(*by).agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"d_{c}") for c in columns])
    out = df.join(stats, list(by)) if by else df.join(F.broadcast(stats))
    for c in columns:
        out = out.withColumn(c, F.when(F.col(f"d_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"d_{c}")).otherwise(F.col(c) - F.col(f"m_{c}")))
    return out.select(*df.columns)


def imputed(df: DataFrame, column: str, missing: Column) -> DataFrame:
    """`column` with missing values replaced by the median of the others, and whether it was."""
    gap = df.withColumn("imputed", missing).withColumn(column, F.when(missing, None).otherwise(F.col(column)))
    mid = group_quantiles(gap, [], {column: [0.5]}).select(first(column).alias("mid"))
    return gap.join(F.broadcast(mid)).withColumn(column, F.coalesce(column, "mid")).drop("mid")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """One row: rows, distinct keys and the difference."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.sum(F.col("n") - 1).alias("n_duplicates"))


def coverage(panel: DataFrame, entity: str = "entity", period: str = "period") -> DataFrame:
    """How many entities are observed in how many periods."""
    return panel.groupBy(entity).agg(F.count_distinct(period).alias("periods")).groupBy("periods").agg(F.count("*").alias("entities"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of all pairs of labels, zeros included, and each as a percentage of its `a`. Labels are few and known to be."""
    n = df.groupBy(a, b).agg(F.count("*").alias("n"))
    grid = n.select(a).distinct().withColumn("k", F.lit(1)).join(n.select(b).distinct().withColumn("k", F.lit(1)), "k").drop("k")
    full = grid.join(n, [a, b], "left").fillna(0, ["n"])
    return full.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(a)))


def histogram(df: DataFrame, column: str, step: float) -> DataFrame:
    """Counts of fixed-width bins from that of the least value (0, if that is more) to that of the greatest, empty ones included, a bin's upper bound in the next; nulls are in none."""
    n = df.where(F.col(column).isNotNull()).groupBy(F.floor(F.col(column) / step).alias("bin")).agg(F.count("*").alias("n"))
    ends = n.agg(F.least(F.min("bin"), F.lit(0)).alias("lo"), F.max("bin").alias("hi")).where("hi is not null")
    bins = ends.select(F.explode(F.sequence("lo", F.greatest("lo", "hi"))).alias("bin"))
    return bins.join(n, "bin", "left").fillna(0, ["n"]).withColumn("low", F.col("bin") * F.lit(float(step)))


def location_quotient(df: DataFrame, region: str, label: str, least: int = 1, top: int = 3) -> DataFrame:
    """(share of a label in a region) / (its share overall), the `top` regions of each label among regions of `least` rows."""
    n = df.groupBy(region, label).agg(F.count("*").alias("n"))
    # regions without a label have a quotient of 0, which can be among the top where few regions are
    cell = n.select(region).distinct().crossJoin(n.select(label).distinct()).join(n, [region, label], "left").fillna(0, ["n"])
    r, c = Window.partitionBy(region), Window.partitionBy(label)
    total = df.agg(F.count("*").alias("all_n"))
    cell = cell.withColumn("region_n", F.sum("n").over(r)).withColumn("label_n", F.sum("n").over(c)).join(F.broadcast(total))
    cell = cell.where(F.col("region_n") >= least).withColumn("lq", (F.col("n") / F.col("region_n")) / (F.col("label_n") / F.col("all_n")))
    rank = F.row_number().over(c.orderBy(F.desc(F.round("lq", 9)), region))
    return cell.withColumn("rank", rank).where(F.col("rank") <= top).select(label, region, "n", "region_n", "lq", "rank")


def profiles(df: DataFrame, label: str, region: str, level: str | None, shares: list[str]) -> DataFrame:
    """Size, regions, exp(median) * 100 of the log `level`, and the median shares of each label with their differences from the median of all rows in percentage points."""
    wanted = {c: [0.5] for c in [*([] if level is None else [level]), *shares]}
    index = [] if level is None else [(100 * F.exp(first(level))).alias("level_index")]
    mids = group_quantiles(df, [label], wanted).select(label, *index, *[first(c).alias(f"median_{c}") for c in shares])
    sizes = df.groupBy(label).agg(F.count("*").alias("size"), F.count_distinct(region).alias("regions"))
    all_ = group_quantiles(df, [], {c: [0.5] for c in shares}).select(*[first(c).alias(f"all_{c}") for c in shares])
    out = sizes.join(mids, label).join(F.broadcast(all_))
    return out.select(label, "size", "regions", *(["level_index"] if level else []), *[f"median_{c}" for c in shares], *[(100 * (F.col(f"median_{c}") - F.col(f"all_{c}"))).alias(f"delta_pp_{c}") for c in shares])


def leading(df: DataFrame, keys: list[str], category: str, value: str) -> DataFrame:
    """(keys, category): the category of the greatest value in each group, ties to the first by name; null values lose to any. One pass, summed on the map side."""
    least = F.min(F.struct(F.col(value).isNull().alias("none"), (-F.col(value)).alias("v"), F.col(category).alias("c")))
    return df.groupBy(*keys).agg(least.alias("_best")).select(*keys, F.col("_best.c").alias(category))


def latest_slice(df: DataFrame, period: str = "period") -> DataFrame:
    """The rows of the last period."""
    last = df.agg(F.max(period).alias("_last"))
    return df.join(F.broadcast(last), F.col(period) == F.col("_last")).drop("_last")


def near_best(df: DataFrame, score: str, *order: Column, slack: float = 0.001) -> DataFrame:
    """One row: of those whose score is at most `slack` below the best, the first by `order`."""
    best = df.agg(F.max(score).alias("_best"))
    return df.join(F.broadcast(best)).where(F.col(score) >= F.col("_best") - slack).drop("_best").orderBy(*order).limit(1)


def reaching(df: DataFrame, baseline: Column, slack: dict[str, float]) -> DataFrame:
    """The rows other than the `baseline` one whose columns are each at least the baseline's less their slack; none where there is no baseline, an error where there are several."""
    several = F.when(F.count("*") > 1, F.raise_error(F.lit("several baselines")))
    least = df.where(baseline).agg(several.alias("_several"), *[(F.max(c) - v).alias(f"_least_{c}") for c, v in slack.items()])
    rows = df.where(~F.coalesce(baseline, F.lit(False))).join(F.broadcast(least))
    for c in slack:
        rows = rows.where(F.col(c) >= F.col(f"_least_{c}"))
    return rows.where("_several is null").drop("_several", *[f"_least_{c}" for c in slack])


def missing_names(columns: list[str], *dropped: str) -> list[str]:
    """The columns without those `dropped`, in order."""
    return [c for c in columns if c not in dropped]


def total_ratio(wide: DataFrame, parts: list[str], total: str) -> DataFrame:
    """One row: the least, median and greatest ratio of the sum of `parts` to `total`."""
    ratio = F.try_divide(sum((F.col(c) for c in parts[1:]), F.col(parts[0])), F.col(total))
    r = wide.select(ratio.alias("ratio"))
    return r.agg(F.min("ratio").alias("low"), F.max("ratio").alias("high")).join(F.broadcast(group_medians(r, [], ["ratio"]))).select("low", F.col("ratio").alias("mid"), "high")


def means(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Mean, least, greatest and count of the valid values (neither null nor NaN) of each column by group."""
    valid = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c))
    return df.groupBy(*by).agg(*[f(valid(c)).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max), ("n", F.count))])


def covariances(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, cov): the sample covariances of all pairs of columns, in one aggregate."""
    cells = df.agg(*[F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{min(i, j)}_{max(i, j)}").alias("cov")) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return cells.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def pair_audit(pairs: DataFrame, layer: str, x: str = "x", y: str = "y", distance: str = "distance") -> DataFrame:
    """For each layer: rows, directed and undirected pairs, repeated rows, pairs with more than one distance, zero distances, nodes of either end, least and greatest distance."""
    p = pairs.select(layer, x, y, distance)
    rows = p.groupBy(layer).agg(F.count("*").alias("n_rows"), F.count_if(F.col(distance) == 0).alias("zero"), F.min(distance).alias("low"), F.max(distance).alias("high"))
    exact = p.groupBy(layer, x, y, distance).agg(F.count("*").alias("n")).groupBy(layer).agg(F.sum(F.col("n") - 1).alias("repeated"))
    both = p.groupBy(layer, F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).agg(F.count_distinct(distance).alias("d"), F.count_distinct(x).alias("ways"))
    both = both.groupBy(layer).agg(F.count("*").alias("pairs"), F.sum("ways").alias("directed"), F.count_if(F.col("d") > 1).alias("conflicts"))
    nodes = p.select(layer, F.col(x).alias("node")).unionByName(p.select(layer, F.col(y).alias("node"))).distinct().groupBy(layer).agg(F.count("*").alias("nodes"))
    return rows.join(exact, layer).join(both, layer).join(nodes, layer)


def coverage_split(ids: DataFrame, panel: DataFrame, model: DataFrame, entity: str = "entity", period: str = "period") -> DataFrame:
    """(part, n): ids in the model, those with an incomplete series, and those with a complete one that the model lacks."""
    total = panel.agg(F.count_distinct(period).alias("_all"))
    seen = panel.groupBy(entity).agg(F.count_distinct(period).alias("_n"))
    rows = ids.select(entity).distinct().join(seen, entity, "left").join(F.broadcast(total)).join(model.select(entity).distinct().withColumn("_in", F.lit(True)), entity, "left")
    part = F.when(F.col("_in"), "in model").when(F.coalesce("_n", F.lit(0)) < F.col("_all"), "incomplete series").otherwise("complete, not in model")
    return rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))


def top_and_selected(df: DataFrame, key: str, by: str, n: int, selected) -> DataFrame:
    """The `n` rows with the greatest `by` (ties by key) and the row of the `selected` key, once."""
    top = df.orderBy(F.desc(by), key).limit(n)
    return top.unionByName(df.where(F.col(key) == F.lit(selected))).distinct()


def floor_percentile(df: DataFrame, column: str, p: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, value): the value at place floor(n * p) of the sorted column, not interpolated."""
    got = group_quantiles(df.where(F.col(column).isNotNull()), list(by), {column: [p]}, interpolate=False)
    return got.select(*by, first(column).alias("value"))


def pivot_years(df: DataFrame, entity: str, year: str, value_cols: list[str], years: list[int]) -> DataFrame:
    """One row an entity with <column>_<year> for every pair, null where it has no row."""
    cells = [F.max(F.when(F.col(year) == y, F.col(c))).alias(f"{c}_{y}") for c in value_cols for y in years]
    return df.groupBy(entity).agg(*cells)


def histories(df: DataFrame, entity: str, period: str, columns: list[str]) -> DataFrame:
    """(entity, history): a struct of arrays, one a column, in order of periods."""
    got = F.array_sort(F.collect_list(F.struct(period, *columns)))
    rows = df.groupBy(entity).agg(got.alias("_h"))
    field = lambda c: F.transform("_h", lambda x: x[c]).alias(c)
    return rows.select(entity, F.struct(*[field(c) for c in [period, *columns]]).alias("history"))
