"""Trajectories: changes, runs, persistent transitions, flows and stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.quantiles import group_medians


def majority(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The most frequent label of each key, the first by order on ties, and its share."""
    n = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    ranked = n.withColumn("all_n", F.sum("n").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), label)))
    return ranked.where("rn = 1").select(*keys, label, "n", (F.col("n") / F.col("all_n")).alias("share"))


def trajectories(df: DataFrame, entity: str, period: str, label: str) -> DataFrame:
    """Each entity's labels in order of periods, as one array."""
    got = F.array_sort(F.collect_list(F.struct(period, label)))
    return df.groupBy(entity).agg(F.transform(got, lambda x: x[label]).alias("labels"))


def changes(df: DataFrame, entity: str, period: str, label: str) -> DataFrame:
    """The label before, whether it changed (not in the first period), and changes so far."""
    w = Window.partitionBy(entity).orderBy(period)
    out = df.withColumn("previous", F.lag(label).over(w)).withColumn("changed", F.coalesce(F.col("previous") != F.col(label), F.lit(False)))
    return out.withColumn("changes", F.sum(F.col("changed").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def runs(df: DataFrame, entity: str, period: str, label: str) -> DataFrame:
    """Maximal runs of one label: number, label, first and last period, length."""
    islands = changes(df, entity, period, label)
    return islands.groupBy(entity, F.col("changes").alias("run")).agg(F.min(label).alias(label), F.min(period).alias("start"), F.max(period).alias("end"), F.count("*").alias("length"))


def persistent_transitions(df: DataFrame, entity: str, period: str, label: str, least: int = 3, margin: str | None = None) -> DataFrame:
    """Neighbouring runs that both last `least` periods; runs at the panel's edges count. With `margin`, its mean over the first three periods of the new run as new_run_margin."""
    w = Window.partitionBy(entity).orderBy("run")
    islands = changes(df, entity, period, label)
    first = [] if margin is None else [F.avg(F.when(F.col("_nth") <= 3, F.col(margin))).alias("new_run_margin")]
    nth = F.row_number().over(Window.partitionBy(entity, "changes").orderBy(period))
    r = islands.withColumn("_nth", nth).groupBy(entity, F.col("changes").alias("run")).agg(F.min(label).alias(label), F.min(period).alias("start"), F.count("*").alias("length"), *first)
    r = r.withColumn("from_label", F.lag(label).over(w)).withColumn("previous_run", F.lag("length").over(w))
    r = r.where((F.col("previous_run") >= least) & (F.col("length") >= least))
    return r.select(entity, F.col("start").alias("period"), "from_label", F.col(label).alias("to_label"), "previous_run", F.col("length").alias("new_run"), *(["new_run_margin"] if margin else []))


def stability(df: DataFrame, entity: str, period: str, label: str, margin: str, core: tuple[float, float] = (22 / 24, 0.15), border: tuple[float, float] = (0.75, 0.10)) -> DataFrame:
    """Dominant label and share, mean and least margin, transitions, trailing run and class of each entity.

    Core types hold a share of at least core[0] with a mean margin of at least core[1]; of the others
    those below border[0] or with a mean margin below border[1] are borderline, the rest stable. Mean
    margins meet the limits by nine places, as the last bits of a mean at a limit depend on the order of its sum.
    """
    r = runs(df, entity, period, label)
    facts = r.groupBy(entity).agg(F.sum("length").alias("periods"), (F.count("*") - 1).alias("transitions"), F.max_by("length", "run").alias("trailing_run"), F.max_by(label, "run").alias("last_label"))
    top = majority(df, [entity], label).withColumnRenamed(label, "dominant")
    margins = df.groupBy(entity).agg(F.avg(margin).alias("mean_margin"), F.min(margin).alias("least_margin"))
    mean = F.round("mean_margin", 9)
    kind = F.when((F.col("share") >= core[0]) & (mean >= core[1]), "core").when((F.col("share") < border[0]) | (mean < border[1]), "borderline").otherwise("stable")
    return facts.join(top.drop("n"), entity).join(margins, entity).withColumn("class", kind)


def class_counts(stable: DataFrame, order: tuple[str, ...] = ("core", "stable", "borderline")) -> DataFrame:
    """(class, place, n): how many entities each class has, in the given order, none as 0."""
    names = stable.sparkSession.createDataFrame([(c, i) for i, c in enumerate(order)], "class string, place int")
    return names.join(stable.groupBy("class").agg(F.count("*").alias("n")), "class", "left").fillna(0, ["n"])


def all_changes(df: DataFrame, entity: str, period: str, label: str) -> DataFrame:
    """(entity, period, from_label, to_label): every change, however short the runs."""
    return changes(df, entity, period, label).where("changed").select(entity, period, F.col("previous").alias("from_label"), F.col(label).alias("to_label"))


def run_as_of(df: DataFrame, entity: str, period: str, label: str) -> DataFrame:
    """`df` with `run_length`, how long the current run has lasted in each period."""
    c = changes(df, entity, period, label)
    return c.withColumn("run_length", F.row_number().over(Window.partitionBy(entity, "changes").orderBy(period))).select(*df.columns, "run_length")


def monthly_summary(df: DataFrame, entity: str, period: str, label: str) -> DataFrame:
    """(period, label, n, changed_ids): each period's composition, and in order the entities that came to the label in it."""
    c = changes(df, entity, period, label)
    ids = F.sort_array(F.collect_list(F.when(F.col("changed"), F.col(entity))))
    return c.groupBy(period, label).agg(F.count("*").alias("n"), ids.alias("changed_ids"))


def adjacent_changes(df: DataFrame, entity: str, period: str, label: str) -> DataFrame:
    """(period, n, changed_share): the share of entities whose label differs from the period before; the first period has none."""
    c = changes(df, entity, period, label).where("previous is not null")
    return c.groupBy(period).agg(F.count("*").alias("n"), F.avg(F.col("changed").cast("int")).alias("changed_share"))


def unchanged(df: DataFrame, entity: str, label: str) -> DataFrame:
    """One row: entities, and those that have one label in all periods."""
    per = df.groupBy(entity).agg(F.count_distinct(label).alias("labels"))
    return per.agg(F.count("*").alias("entities"), F.count_if(F.col("labels") == 1).alias("unchanged"))


def cohort_medians(df: DataFrame, entity: str, period: str, label: str, value: str) -> DataFrame:
    """(cohort, period, n, median): the median value by period of the entities that began with each label."""
    first = df.groupBy(entity).agg(F.min_by(label, period).alias("cohort"))
    rows = df.join(first, entity).select("cohort", period, F.col(value).alias("median"))
    return rows.groupBy("cohort", period).agg(F.count("*").alias("n")).join(group_medians(rows, ["cohort", period], ["median"]), ["cohort", period])


def unchanged_and_growing(df: DataFrame, entity: str, period: str, label: str, value: str) -> DataFrame:
    """(n, unchanged, growing): entities, those of one label all along, and those whose value is greater in their last period than in their first; a null label or end value counts for neither."""
    same = (F.count(label) == F.count("*")) & (F.min(label) == F.max(label))
    each = df.groupBy(entity).agg(same.alias("same"), (F.max_by(value, period) > F.min_by(value, period)).alias("more"))
    return each.agg(F.count("*").alias("n"), F.count_if("same").alias("unchanged"), F.count_if("more").alias("growing"))


def direction_counts(transitions: DataFrame) -> DataFrame:
    """(from_label, to_label, n), the most frequent first."""
    return transitions.groupBy("from_label", "to_label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "from_label", "to_label")


def yearly_means(series: DataFrame, key: str, values: str, length: int = 12) -> DataFrame:
    """(key, year, mean): the mean of each stretch of `length` values of an array, from year 0; null where the stretch has none."""
    part = lambda i: F.filter(F.slice(values, i * length + 1, length), lambda v: v.isNotNull())
    years = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / length).cast("int"))
    got = series.where(F.size(values) > 0).select(key, values, F.explode(years).alias("year"))
    total = F.aggregate(part(F.col("year")), F.lit(0.0), lambda s, v: s + v)
    return got.select(key, "year", F.try_divide(total, F.size(part(F.col("year")))).alias("mean"))


def transition_matrix(df: DataFrame, entity: str, period: str, label: str) -> DataFrame:
    """Counts of (period, from, to)."""
    c = changes(df, entity, period, label).where("previous is not null")
    return c.groupBy(period, F.col("previous").alias("from_label"), F.col(label).alias("to_label")).agg(F.count("*").alias("n"))


def endpoint_flows(df: DataFrame, entity: str, period: str, label: str) -> DataFrame:
    """Counts of (first label, last label) of entities whose ends differ."""
    ends = df.groupBy(entity).agg(F.min_by(label, period).alias("from_label"), F.max_by(label, period).alias("to_label"))
    return ends.where("from_label <> to_label").groupBy("from_label", "to_label").agg(F.count("*").alias("n"))
