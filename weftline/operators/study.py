"""Studies of a panel on a graph: representations, fits, bundles of metrics, and sweeps, refits and checks made of them.

Nodes are (period, node, features), edges (src, dst, w) of the transport graph. A study that fits many
settings stacks their points with a column for the setting and fits all of them in the same passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import graph, learning, panel, quality
from weftline.shared import cut

P = ("period",)


def vectors(nodes: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, period, id, x) of the columns of `nodes`."""
    return nodes.select(*by, "period", F.col("node").alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))


def dynamic_graph(nodes: DataFrame, edges: DataFrame, economic: list[str], h: float) -> DataFrame:
    """The transport graph's weights in each period, by how alike the nodes are."""
    return graph.reweighted(edges, nodes, economic, h, P)


def static_nodes(nodes: DataFrame, edges: DataFrame, columns: list[str], mix: float) -> DataFrame:
    return graph.smoothed(nodes, edges, columns, mix, P)


def dynamic_nodes(nodes: DataFrame, edges: DataFrame, columns: list[str], economic: list[str], mix: float, h: float) -> DataFrame:
    return graph.resmoothed(nodes, edges, columns, economic, mix, h, P)


def stacked(settings: dict, by: str = "setting") -> DataFrame:
    """The tables of a dict in one, with their name in column `by`."""
    return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias(by), *df.columns) for name, df in settings.items()))


def fitted(points: DataFrame, k: int | dict, by: tuple[str, ...] = (), starts: int = 10, seed: int = 42, level: str | None = None, own_seeds: bool = False) -> DataFrame:
    """`points` with label and margin of the best of several starts for each value of `by`; with `level`, labels count from 1 by its median."""
    points = cut(points, "points")
    got = cut(learning.assigned_many(points, learning.kmeans_many(points, k, by, starts, seed=seed, own_seeds=own_seeds), by), "labels")
    return learning.ordered_labels(got, level, by=by) if level else got


def standardised(nodes: DataFrame, columns: list[str], shares: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, period, node, columns): shares less their period's median, then all columns standardised over the periods, each value of `by` on its own."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in (*by, "period")])
    z = panel.zscored(nodes.select(*by, "period", "node", *columns, key.alias("_k")), columns, shares, "_k", by)
    return z.select(*by, "period", "node", *columns)


def layered_nodes(z: DataFrame, first: DataFrame, second: DataFrame, columns: list[str], mix: float, weight: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, period, node, columns): (1 - mix) of each node's features and `mix` of its neighbours' over two layers, each normalised on its own."""
    keys = (*by, "period")
    near = graph.two_layers(z.select(*keys, "node", *columns), first, second, columns, weight, keys)
    both = z.join(near.select(*keys, "node", *[F.col(c).alias(f"n_{c}") for c in columns]), [*keys, "node"])
    return both.select(*keys, "node", *[((1 - mix) * F.col(c) + mix * F.col(f"n_{c}")).alias(c) for c in columns])


def layered_fit(nodes: DataFrame, first: DataFrame, second: DataFrame, columns: list[str], shares: list[str], k: int, by: tuple[str, ...] = (), mix: float = 0.2, weight: float = 0.25, starts: int = 10, level: str | None = None) -> DataFrame:
    """(by, period, id, x, label, margin): the types of plain features (by, period, node, columns), standardised, smoothed over both layers and fitted for each value of `by` on its own; x are the standardised features.

    What is compared with a fit, refits and draws alike, goes this way too, so that a draw of
    everything gives the same types. With `level`, labels count from 1 by its median.
    """
    z = cut(standardised(nodes, columns, shares, by), "standardised")
    points = vectors(layered_nodes(z, first, second, columns, mix, weight, by), columns, by)
    keys = [*by, "period", "id"]
    if level:
        points = points.join(z.select(*by, "period", F.col("node").alias("id"), F.col(level).alias("_level")), keys)
    got = fitted(points, k, by, starts, level="_level" if level else None)
    return got.select(*keys, "label", "margin").join(vectors(z, columns, by), keys)


def monthly_metrics(points: DataFrame, graphs: DataFrame, by: tuple[str, ...] = (), over: str | None = None) -> DataFrame:
    """(by, period, silhouette, calinski_harabasz, davies_bouldin, s_dbw, avi, avu, anui, mq, modularity) of labelled points (by, period, id, x, label) on each period's graph; `over` names a column of `by` whose values label the same points."""
    keys = [*by, "period"]
    sil = quality.silhouettes(points, over, tuple(k for k in keys if k != over)) if over else quality.silhouette(points, tuple(keys))
    parts = [sil, quality.centre_indices(points, tuple(keys)), quality.s_dbw(points, tuple(keys))]
    parts.append(graph.network_indices(graphs, points.select(*keys, F.col("id").alias("node"), "label"), tuple(keys)))
    return reduce(lambda a, b: a.join(b, keys), parts)


def temporal_ari(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, period, temporal_ari): labels against the same ids' of the period before."""
    w = Window.partitionBy(*by, "id").orderBy("period")
    both = points.withColumn("_before", F.lag("label").over(w)).where("_before is not null")
    return quality.ari(both, "_before", "label", (*by, "period")).withColumnRenamed("ari", "temporal_ari")


def summary(monthly: DataFrame, temporal: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Means over the periods of both."""
    names = [c for c in monthly.columns if c not in (*by, "period")]
    return monthly.groupBy(*by).agg(*[F.avg(c).alias(c) for c in names]).join(temporal.groupBy(*by).agg(F.avg("temporal_ari").alias("temporal_ari")), list(by))


def stability_share(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, stability): the share of ids that keep their label from one period to the next."""
    w = Window.partitionBy(*by, "id").orderBy("period")
    both = points.withColumn("_before", F.lag("label").over(w)).where("_before is not null")
    return quality.agreement(both, "_before", "label", by).withColumnRenamed("agreement", "stability")


def least_shares(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, least_share): the least share of a label in a period, 0 where it has no member."""
    keys = [*by, "period"]
    n = points.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    labels = n.select(*by, "label").distinct()
    grid = n.select(*keys).distinct().join(labels, list(by)) if by else n.select("period").distinct().crossJoin(labels)
    full = grid.join(n, [*keys, "label"], "left").fillna(0, ["n"])
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return full.withColumn("share", share).groupBy(*by).agg(F.min("share").alias("least_share"))


def bundle(points: DataFrame, graphs: DataFrame, by: tuple[str, ...], sample: int | None = None) -> DataFrame:
    """(by, silhouette, modularity, stability, least_share): the pooled silhouette and means over periods.

    The values of the first column of `by` label the same points, whose distances are made once. The
    silhouette is of all points, or, where `sample` is given, of that many of each value of `by`, taken by a hash.
    """
    keys = [*by, "period"]
    some = points
    if sample is not None:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("period", "id", F.lit(42)), "period", "id"))
        some = points.withColumn("_n", place).where(F.col("_n") <= sample)
    some = some.select(*by, F.concat_ws("|", "period", F.col("id").cast("string")).alias("id"), "label", "x")
    sil = quality.silhouettes(cut(some, "pooled"), by[0], by[1:])
    mod = graph.modularity(graphs, points.select(*keys, F.col("id").alias("node"), "label"), tuple(keys)).groupBy(*by).agg(F.avg("modularity").alias("modularity"))
    return sil.join(mod, list(by)).join(stability_share(points, by), list(by)).join(least_shares(points, by), list(by))


def with_reference(points: DataFrame, reference: DataFrame) -> DataFrame:
    """Labelled points with `reference`, the label of the same (period, id) in another table."""
    return points.join(reference.select("period", "id", F.col("label").alias("reference")), ["period", "id"])


def aligned_by(points: DataFrame, by: str) -> DataFrame:
    """Points with `aligned`: for each value of `by` labels renamed to those of `reference` so that most agree."""
    return learning.aligned(points, "reference", "label", by)


def aligned_to(points: DataFrame, reference: DataFrame, by: str) -> DataFrame:
    """(by, period, id, reference, aligned): labels of each value of `by` renamed to a reference's."""
    return cut(aligned_by(cut(with_reference(points, reference), "referenced"), by), "aligned")


def against_reference(points: DataFrame, reference: DataFrame, by: str, period: bool = True) -> DataFrame:
    """(by, period, ari, agreement) of labels with a reference, names aligned over all periods at once."""
    rows = aligned_to(points, reference, by)
    keys = (by, "period") if period else (by,)
    return quality.ari(rows, "reference", "aligned", keys).join(quality.agreement(rows, "reference", "aligned", keys), list(keys))


def jaccards(points: DataFrame, by: str) -> DataFrame:
    """(by, label, jaccard) of aligned and reference labels."""
    both = points.select(by, F.col("reference").alias("_a"), F.col("aligned").alias("_b"))
    e = both.select(by, "_a", "_b", F.explode(F.array_distinct(F.array_compact(F.array("_a", "_b")))).alias("label"))
    return e.groupBy(by, "label").agg((F.sum(F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).cast("long")) / F.count("*")).alias("jaccard"))


def select_setting(metrics: DataFrame, *order: Column, needs: Column, score: str = "silhouette", slack: float = 0.0, required: bool = True) -> DataFrame:
    """The chosen row: of those that meet the needs and whose score is at most `slack` below the best of them, the first by `order`.

    That none meets the needs is an error, or no row where the choice isn't `required`.
    """
    eligible = cut(metrics.where(needs), "eligible")
    if required and not eligible.limit(1).count():
        raise ValueError("no setting meets the needs")
    return panel.near_best(eligible, score, *order, F.desc(score), slack=slack)


def marked(metrics: DataFrame, key: str, *order: Column, needs: Column, slack: float = 0.0) -> DataFrame:
    """`metrics` with `eligible` and `chosen`; where no setting is eligible none is chosen."""
    pick = select_setting(metrics, *order, needs=needs, slack=slack, required=False).select(key, F.lit(True).alias("chosen"))
    return metrics.withColumn("eligible", needs).join(pick, key, "left").fillna(False, ["chosen"])


def four_methods(nodes: DataFrame, static: DataFrame, dynamic: DataFrame, columns: list[str], k: int, starts: int = 10) -> DataFrame:
    """(model, period, id, x, label): k-means and a diagonal mixture of the features, and k-means of both smoothed ones; x are the plain features, which all are judged on."""
    plain = cut(vectors(nodes, columns), "plain")
    sets = {"kmeans": plain, "static": vectors(static, columns), "dynamic": vectors(dynamic, columns)}
    fits = fitted(stacked(sets, "model"), k, ("model",), starts).select("model", "period", "id", "label")
    mixture = learning.diagonal_mixture(plain, k, starts).select(F.lit("mixture").alias("model"), "period", "id", "label")
    return cut(fits.unionByName(mixture).join(plain, ["period", "id"]), "four")


def winners(means: DataFrame, key: str, higher: list[str], lower: list[str], tie: str | None = None) -> DataFrame:
    """(metric, winner): the key with the best mean of each metric; on ties the first by name, or the text `tie` where it is given."""
    order = lambda c: -F.col(c) if c in higher else F.col(c)
    best = [F.struct(F.lit(c).alias("metric"), F.min(F.struct(order(c).alias("v"), F.col(key))).alias("b")) for c in [*higher, *lower]]
    got = means.agg(F.array(*best).alias("r")).select(F.explode("r").alias("r")).select("r.metric", F.col("r.b.v").alias("_v"), F.col(f"r.b.{key}").alias("winner"))
    if tie is None:
        return got.drop("_v")
    each = means.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), order(c).cast("double").alias("_v")) for c in [*higher, *lower]])).alias("r")).select("r.*")
    first = got.join(each.groupBy("metric", "_v").agg(F.count("*").alias("_n")), ["metric", "_v"])
    return first.select("metric", F.when(F.col("_n") > 1, F.lit(tie)).otherwise(F.col("winner")).alias("winner"))


def accepted(row: DataFrame, **least: float) -> DataFrame:
    """`row` with `accepted`: whether every named column is at least its threshold."""
    good = reduce(lambda a, b: a & b, (F.coalesce(F.col(c) >= v, F.lit(False)) for c, v in least.items()))
    return row.withColumn("accepted", good)


def trial_panels(wide: DataFrame, trials: int, share: float = 0.8, seed: int = 0) -> DataFrame:
    """(trial, ...): the wide panel of each trial's entities, drawn without replacement."""
    return learning.subsample(wide, "entity", trials, share, seed)


def trial_features(drawn: DataFrame, columns: list[str], shares: list[str], by: str = "trial") -> DataFrame:
    """(by, period, node, columns): levels, shares, medians and standardising of each trial on its own."""
    key = F.concat_ws("|", F.col(by).cast("string"), "period")
    f = panel.features(drawn.withColumn("_k", key).drop("total", "relative_level", *shares), "_k")
    z = panel.zscored(f.select(by, "_k", "period", F.col("entity").alias("node"), *columns), columns, shares, "_k", (by,))
    return z.select(by, "period", "node", *columns)


def trial_graph(pairs: DataFrame, drawn: DataFrame, k: int, by: str = "trial") -> DataFrame:
    """(by, src, dst, w): the nearest-neighbour layer among each trial's nodes, with a scale of its own."""
    ids = drawn.select(by, F.col("entity").alias("node")).distinct()
    near = pairs.join(ids.select(by, F.col("node").alias("x")), "x").join(ids.select(by, F.col("node").alias("y")), [by, "y"])
    return graph.knn_layer(near, k, (by,))
