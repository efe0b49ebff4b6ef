"""Queries of whole studies: fits, sweeps, refits, checks and the compositions that a user runs.

Fitted labels differ with the order of sums, so what has no SQL is a table of metrics or a statement
that holds for any good fit; tests check the pieces against numpy.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline import sinks
from weftline.operators import contracts, graph, learning, panel, quality, sequence, study
from weftline.operators.quantiles import group_medians
from weftline.plans.catalogue import AUDIT_SQL, PANEL, SHARES, feature_panel, layer_audits, long_panel, nation_near, nation_pairs, query, region_labels, rounded, supply_near, supply_pairs
from weftline.plans.networks import COLUMNS, MIX, WIDTH, panel_edges, scaled_panel
from weftline.shared import cut, shared_dir
from weftline.tables import table

K, STARTS = 3, 10
#: The second layer's weight; the least share of labels that stay and of a type in a period for a setting to be chosen.
WEIGHT, STABLE, BALANCED = 0.25, 0.95, 0.15
#: Points of the pooled silhouette by which a width is chosen, as the study defines it; other silhouettes are of all points.
POOLED = 10_000
#: The most neighbours in both layers that a yearly study takes.
MOST = 10, 4


def _inputs(s, d):
    z = scaled_panel(s, d)
    return z, panel_edges(s, d, z)


def _fit(nodes, columns=COLUMNS, k=K, by=(), level=None):
    p = study.vectors(nodes, columns, by)
    if level:
        p = p.join(nodes.select(*by, "period", F.col("node").alias("id"), F.col(level).alias("_level")), [*by, "period", "id"])
    got = study.fitted(p, k, by, STARTS, level="_level" if level else None)
    return got.drop("_level")


def dynamic_labels(s, d) -> DataFrame:
    """(period, id, label, margin): types from 1 by the level of what is spent, fitted on each period's smoothed features."""
    z, edges = _inputs(s, d)
    near = study.dynamic_nodes(z, edges, COLUMNS, COLUMNS, MIX, WIDTH)
    near = near.join(z.select("period", "node", F.col("relative_level").alias("plain_level")), ["period", "node"])
    return _fit(near, level="plain_level").select("period", "id", "label", "margin")


# fits -----------------------------------------------------------------------------------------


@query()
def dynamic_model(s, d):
    """Every supplier's type and margin in every period, and whether it changed from the period before."""
    rows = sequence.changes(dynamic_labels(s, d), "id", "period", "label")
    return rounded(rows.select("period", "id", "label", "margin", "changed"))


@query()
def annual_model(s, d):
    """Types of suppliers by year, from yearly medians smoothed over both layers, each normalised on its own."""
    points_ = annual_points(s, d)
    return points_.select("year", "id", "label").orderBy("year", "id")


class Annual:
    """What the yearly studies of one query share, each made once, when it is first read."""

    def __init__(self, s, d):
        self.s, self.d, self.layers = s, d, {}

    @cached_property
    def features(self) -> DataFrame:
        """(node, period, year, features) of every month."""
        f = feature_panel(self.s, self.d).select(F.col("entity").alias("node"), "period", F.substring("period", 1, 4).alias("year"), *COLUMNS)
        return cut(f, "features")

    @cached_property
    def medians(self) -> DataFrame:
        """(period, node, features) of each year's medians; the year is the period."""
        f = self.features.select("node", F.col("year").alias("period"), *COLUMNS)
        return cut(group_medians(f, ["node", "period"], COLUMNS), "annual_medians")

    @cached_property
    def near(self) -> tuple[DataFrame, DataFrame]:
        """The neighbours of both layers of the transport graph, as many as any study takes; fewer are those of a lower rank."""
        return cut(supply_near(self.s, self.d, MOST[0]), "supply_near"), cut(nation_near(self.s, self.d, MOST[1]), "nation_near")

    def layers_of(self, ks=(8, 3)) -> tuple[DataFrame, DataFrame]:
        """Both layers among the panel's suppliers, of the given numbers of neighbours."""
        if ks not in self.layers:
            ids = self.medians.select("node").distinct()
            parts = (graph.scaled_layer(near.where(F.col("rank") <= k)) for near, k in zip(self.near, ks, strict=True))
            self.layers[ks] = tuple(cut(graph.within(e, ids), "layer") for e in parts)
        return self.layers[ks]

    @cached_property
    def points(self) -> DataFrame:
        """(period, id, x, label, margin, year): the yearly types."""
        got = study.layered_fit(self.medians, *self.layers_of(), COLUMNS, SHARES, K, (), MIX, WEIGHT, STARTS, level="relative_level")
        return cut(got.withColumn("year", F.col("period").cast("int")), "annual_points")


def annual_nodes(s, d) -> DataFrame:
    """(period, node, features) of each year's medians, standardised."""
    return cut(study.standardised(Annual(s, d).medians, COLUMNS, SHARES), "annual")


def annual_points(s, d) -> DataFrame:
    return Annual(s, d).points


@query()
def four_models(s, d):
    """Means over the periods of all indices of four methods, judged on the plain features and each period's graph."""
    z, edges = _inputs(s, d)
    static, dynamic = study.static_nodes(z, edges, COLUMNS, MIX), study.dynamic_nodes(z, edges, COLUMNS, COLUMNS, MIX, WIDTH)
    rows = study.four_methods(z, static, dynamic, COLUMNS, K, STARTS)
    monthly = study.monthly_metrics(rows, cut(study.dynamic_graph(z, edges, COLUMNS, WIDTH), "graphs"), ("model",), "model")
    return rounded(study.summary(monthly, study.temporal_ari(rows, ("model",)), ("model",)), 4)


@query()
def metric_winners(s, d):
    """The best method by each index, or that several share the best value."""
    means = cut(four_models(s, d), "means")
    return study.winners(means, "model", ["silhouette", "calinski_harabasz", "avi", "mq", "modularity", "temporal_ari"], ["davies_bouldin", "s_dbw", "avu"], tie="tie")


@query()
def density_comparison(s, d):
    """By period: clusters of HDBSCAN, the share of suppliers in one, and the silhouette of those by both labellings."""
    z = scaled_panel(s, d)
    p = cut(study.vectors(z, COLUMNS), "points")
    least = max(5, p.select("id").distinct().count() // 40)
    dense = learning.density_clusters(p, "period", least, 5).withColumnRenamed("label", "dense")
    rows = cut(study.fitted(p, K).join(dense, ["period", "id"]), "both")
    cover = rows.groupBy("period").agg(F.avg((F.col("dense") >= 0).cast("int")).alias("coverage"), F.count_distinct(F.when(F.col("dense") >= 0, F.col("dense"))).alias("clusters"))
    inside = rows.where("dense >= 0")
    parts = [(inside.withColumn("label", F.col("dense")), "dense_silhouette"), (inside, "kmeans_assigned"), (rows, "kmeans_all")]
    out = cover
    for df, name in parts:
        out = out.join(quality.silhouette(df.select("period", "id", "x", "label"), ("period",)).withColumnRenamed("silhouette", name), "period", "left")
    return rounded(out)


# sweeps ---------------------------------------------------------------------------------------


@query()
def bandwidth_selection(s, d):
    """Six widths of the kernel, by what each fit is like on its own graph, how much weight that keeps and how like the fit of the static graph it is; of the stable and balanced fits that with the best silhouette, by its definition of POOLED points, is chosen."""
    z, edges = _inputs(s, d)
    widths = (0.5, 1.0, 1.5, 2.0, 3.0, 5.0)
    nodes = {str(h): study.dynamic_nodes(z, edges, COLUMNS, COLUMNS, MIX, h) for h in widths} | {"static": study.static_nodes(z, edges, COLUMNS, MIX)}
    fits = cut(_fit(study.stacked(nodes), by=("setting",)).select("setting", "period", "id", "label"), "fits")
    rows = cut(fits.where("setting <> 'static'").join(study.vectors(z, COLUMNS), ["period", "id"]), "rows")
    graphs = cut(study.stacked({str(h): study.dynamic_graph(z, edges, COLUMNS, h) for h in widths}), "graphs")
    static = fits.where("setting = 'static'").select("period", "id", F.col("label").alias("static"))
    like = quality.ari(rows.join(static, ["period", "id"]), "static", "label", ("setting",)).withColumnRenamed("ari", "ari_static")
    periods = z.select("period").distinct().count()
    kept = graph.weight_ratio(graphs, edges, "setting").select("setting", (F.col("ratio") / periods).alias("edge_weight_ratio"))
    metrics = cut(study.bundle(rows, graphs, ("setting",), POOLED).join(like, "setting").join(kept, "setting"), "metrics")
    return rounded(study.marked(metrics, "setting", needs=(F.col("stability") >= STABLE) & (F.col("least_share") >= BALANCED)))


@query()
def cluster_count_sweep(s, d):
    """Two to eight types: silhouette by period, likeness of neighbouring periods, and the least share of a type."""
    z, edges = _inputs(s, d)
    near = cut(study.dynamic_nodes(z, edges, COLUMNS, COLUMNS, MIX, WIDTH), "near")
    ks = range(2, 9)
    nodes = study.stacked({str(k): near for k in ks})
    labels = study.fitted(study.vectors(nodes, COLUMNS, ("setting",)), {(str(k),): k for k in ks}, ("setting",), STARTS).select("setting", "period", "id", "label")
    rows = cut(labels.join(study.vectors(z, COLUMNS), ["period", "id"]), "rows")
    sil = quality.silhouettes(rows, "setting", ("period",)).groupBy("setting").agg(F.avg("silhouette").alias("silhouette"))
    ari = study.temporal_ari(rows, ("setting",)).groupBy("setting").agg(F.avg("temporal_ari").alias("temporal_ari"))
    return rounded(sil.join(ari, "setting").join(study.least_shares(rows, ("setting",)), "setting"))


@query()
def seed_stability(s, d):
    """The least likeness of ten fits from other seeds to the first one's."""
    z = scaled_panel(s, d)
    p = cut(study.vectors(z, COLUMNS), "points")
    runs = study.fitted(study.stacked({str(i): p for i in range(10)}, "seed"), K, ("seed",), STARTS, own_seeds=True).select("seed", "period", "id", "label")
    first = runs.where("seed = '0'").select("period", "id", F.col("label").alias("first"))
    return rounded(quality.ari(runs.where("seed <> '0'").join(first, ["period", "id"]), "first", "label", ("seed",)).agg(F.min("ari").alias("least_ari"), F.count("*").alias("runs")))


@query()
def annual_grid(s, d):
    """Weights of the second layer and shares of the neighbourhood, each fit judged on its own graph; of those as stable as the fit without a graph, and balanced, the simplest within 0.001 of the best silhouette is chosen."""
    annual = Annual(s, d)
    z = cut(study.standardised(annual.medians, COLUMNS, SHARES), "annual")
    first, second = annual.layers_of()
    years, settings, graphs = z.select("period").distinct(), {"none": z}, {}
    for weight in (0.0, 0.25, 0.5):
        for mix in (0.1, 0.2, 0.3):
            settings[f"{weight}|{mix}"] = study.layered_nodes(z, first, second, COLUMNS, mix, weight)
            graphs[f"{weight}|{mix}"] = graph.mixed(first, second, weight).where("w > 0").crossJoin(F.broadcast(years))
    rows = cut(_fit(study.stacked(settings), by=("setting",)).select("setting", "period", "id", "label").join(study.vectors(z, COLUMNS), ["period", "id"]), "rows")
    plain = rows.where("setting = 'none'")
    base = study.stability_share(plain).first()[0]
    like = study.with_reference(rows.where("setting <> 'none'"), plain)
    like = quality.ari(like, "reference", "label", ("setting",)).withColumnRenamed("ari", "ari_plain")
    metrics = study.bundle(rows.where("setting <> 'none'"), cut(study.stacked(graphs), "graphs"), ("setting",)).join(like, "setting")
    part = F.split("setting", r"\|")
    metrics = cut(metrics.withColumn("second_weight", part[0].cast("double")).withColumn("mix", part[1].cast("double")), "metrics")
    needs = (F.col("stability") >= (base or 0.0) - 0.005) & (F.col("least_share") >= BALANCED)
    return rounded(study.marked(metrics, "setting", F.asc("second_weight"), F.asc("mix"), F.desc("modularity"), needs=needs, slack=0.001))


@query()
def neighbour_grid(s, d):
    """Three numbers of neighbours in both layers and three shares of the neighbourhood: likeness to the yearly types and what each fit is like on its own graph."""
    return neighbour_rows(Annual(s, d))


def neighbour_rows(annual: Annual) -> DataFrame:
    z = cut(study.standardised(annual.medians, COLUMNS, SHARES), "annual")
    years, settings, graphs = z.select("period").distinct(), {}, {}
    for ks in ((6, 2), (8, 3), (10, 4)):
        first, second = annual.layers_of(ks)
        for mix in (0.1, 0.2, 0.3):
            name = f"{ks[0]}|{ks[1]}|{mix}"
            settings[name] = study.layered_nodes(z, first, second, COLUMNS, mix, WEIGHT)
            graphs[name] = graph.mixed(first, second, WEIGHT).crossJoin(F.broadcast(years))
    rows = cut(_fit(study.stacked(settings), by=("setting",)).select("setting", "period", "id", "label").join(study.vectors(z, COLUMNS), ["period", "id"]), "rows")
    like = quality.ari(study.with_reference(rows, annual.points.select("period", "id", "label")), "reference", "label", ("setting",)).withColumnRenamed("ari", "ari_reference")
    return rounded(study.bundle(rows, cut(study.stacked(graphs), "graphs"), ("setting",)).join(like, "setting"))


@query()
def feature_ablation(s, d):
    """Fits without one feature each, and without two: likeness to the fit with all, by period, and the overlap of the least alike type."""
    z, edges = _inputs(s, d)
    drops = [(c,) for c in COLUMNS] + [tuple(SHARES[:2])]
    whole = cut(study.fitted(study.vectors(study.dynamic_nodes(z, edges, COLUMNS, COLUMNS, MIX, WIDTH), COLUMNS), K).select("period", "id", "label"), "whole")
    points_ = {}
    for gone in drops:
        kept = panel.missing_names(COLUMNS, *gone)
        points_[" + ".join(gone)] = study.vectors(study.dynamic_nodes(z, edges, kept, kept, MIX, WIDTH), kept)
    labels = study.fitted(study.stacked(points_, "removed"), K, ("removed",), STARTS).select("removed", "period", "id", "label")
    rows = cut(study.aligned_by(cut(study.with_reference(labels, whole), "referenced"), "removed"), "aligned")
    ari = quality.ari(rows, "reference", "aligned", ("removed", "period")).groupBy("removed").agg(F.avg("ari").alias("ari"))
    return rounded(ari.join(study.jaccards(rows, "removed").groupBy("removed").agg(F.min("jaccard").alias("least_jaccard")), "removed"))


@query()
def network_grid(s, d):
    """Graphs of economic neighbours by two distances, four numbers of neighbours and three widths: 24 fits, by their means over periods."""
    z, edges = _inputs(s, d)
    p = cut(study.vectors(z, COLUMNS), "points")
    near = {m: cut(quality.neighbours(p, 16, ("period",), m), "near") for m in ("euclidean", "cosine")}
    settings = {m: graph.smoothed_by_similarity(z, n, COLUMNS, MIX, (2, 4, 8, 16), (0.5, 1.0, 2.0), ("period",)) for m, n in near.items()}
    name = F.concat_ws("|", "metric", F.col("k").cast("string"), F.col("h").cast("string"))
    settings = cut(study.stacked(settings, "metric").withColumn("setting", name), "settings")
    labels = _fit(settings, by=("setting",)).select("setting", "period", "id", "label")
    rows = cut(labels.join(p, ["period", "id"]), "rows")
    indices = graph.network_indices(cut(study.dynamic_graph(z, edges, COLUMNS, WIDTH), "graphs"), rows.select("setting", "period", F.col("id").alias("node"), "label"), ("setting", "period"))
    means = indices.groupBy("setting").agg(*[F.avg(c).alias(c) for c in ("avi", "avu", "anui", "mq", "modularity")])
    sil = quality.silhouettes(rows, "setting", ("period",)).groupBy("setting").agg(F.avg("silhouette").alias("silhouette"))
    ari = study.temporal_ari(rows, ("setting",)).groupBy("setting").agg(F.avg("temporal_ari").alias("temporal_ari"))
    degree = settings.groupBy("setting", "period").agg(F.sum("edges").alias("m"), F.count("*").alias("n")).where("m > 0")
    degree = degree.groupBy("setting").agg(F.avg(F.col("m") / F.col("n")).alias("mean_degree"))
    return rounded(means.join(sil, "setting").join(ari, "setting").join(degree, "setting"))


# refits ---------------------------------------------------------------------------------------


def _reference(z, edges):
    return cut(study.fitted(study.vectors(study.dynamic_nodes(z, edges, COLUMNS, COLUMNS, MIX, WIDTH), COLUMNS), K).select("period", "id", "label"), "reference")


def _trials(s, d, trials):
    """(trial, period, node, features) smoothed as the whole panel is, from 80 % of the suppliers each: medians, standardising and both layers made anew."""
    drawn = cut(study.trial_panels(cut(feature_panel(s, d), "wide"), trials), "drawn")
    nodes = cut(study.trial_features(drawn, COLUMNS, SHARES), "trial_nodes")
    layers = [study.trial_graph(cut(pairs, "pairs"), drawn, k) for pairs, k in ((supply_pairs(s, d), 8), (nation_pairs(s, d), 3))]
    transport_ = cut(graph.mixed(*layers, WEIGHT, ("trial",)), "trial_graph")
    by = ("trial", "period")
    return cut(graph.smoothed(nodes, graph.reweighted(transport_, nodes, COLUMNS, WIDTH, by), COLUMNS, MIX, by, transport_), "trial_smoothed")


@query()
def subsample_refit(s, d):
    """Twenty fits of 80 % of the suppliers each, with medians, standardising and the graph made anew: likeness to the fit of all."""
    z, edges = _inputs(s, d)
    labels = study.fitted(study.vectors(_trials(s, d, 20), COLUMNS, ("trial",)), K, ("trial",), STARTS).select("trial", "period", "id", "label")
    monthly = study.against_reference(labels, _reference(z, edges), "trial")
    per = monthly.groupBy("trial").agg(F.avg("ari").alias("ari"), F.avg("agreement").alias("agreement"))
    return rounded(per.agg(F.count("*").alias("trials"), F.median("ari").alias("median_ari"), F.min("ari").alias("least_ari"), F.max("ari").alias("greatest_ari"), F.avg("agreement").alias("agreement")))


@query()
def cluster_count_checks(s, d):
    """Two to eight types: silhouette, likeness of neighbouring periods and least share of a type in the fit of all; median, least and greatest likeness to it of fits of 80 % of the suppliers, and the least overlap of a type."""
    z, edges = _inputs(s, d)
    near, trials, ks = cut(study.dynamic_nodes(z, edges, COLUMNS, COLUMNS, MIX, WIDTH), "near"), _trials(s, d, 10), range(2, 9)
    all_ = study.fitted(study.vectors(study.stacked({str(k): near for k in ks}, "k"), COLUMNS, ("k",)), {(str(k),): k for k in ks}, ("k",), STARTS)
    all_ = cut(all_.select("k", "period", "id", "label").join(study.vectors(z, COLUMNS), ["period", "id"]), "all")
    sil = quality.silhouettes(all_, "k", ("period",)).groupBy("k").agg(F.avg("silhouette").alias("silhouette"))
    time = study.temporal_ari(all_, ("k",)).groupBy("k").agg(F.avg("temporal_ari").alias("temporal_ari"))
    some = study.stacked({str(k): trials for k in ks}, "k").withColumn("fit", F.concat_ws("|", "k", F.col("trial").cast("string")))
    counts = {(f"{k}|{t}",): k for k in ks for t in range(10)}
    labels = study.fitted(study.vectors(some, COLUMNS, ("fit",)), counts, ("fit",), STARTS).select("fit", F.split("fit", r"\|")[0].alias("k"), "period", "id", "label")
    rows = labels.join(all_.select("k", "period", "id", F.col("label").alias("reference")), ["k", "period", "id"])
    rows = cut(study.aligned_by(cut(rows, "referenced"), "fit"), "aligned")
    ari = quality.ari(rows, "reference", "label", ("k", "fit", "period")).groupBy("k", "fit").agg(F.avg("ari").alias("ari"))
    ari = ari.groupBy("k").agg(F.median("ari").alias("median_ari"), F.min("ari").alias("least_ari"), F.max("ari").alias("greatest_ari"))
    jac = study.jaccards(rows, "fit").groupBy(F.split("fit", r"\|")[0].alias("k")).agg(F.min("jaccard").alias("least_jaccard"))
    out = sil.join(time, "k").join(study.least_shares(all_, ("k",)), "k").join(ari, "k").join(jac, "k")
    return rounded(out.withColumn("k", F.col("k").cast("int")))


def bootstrap_rows(annual: Annual, draws: int) -> DataFrame:
    """(iteration, period, id, reference, aligned) of fits of yearly medians over months drawn with replacement."""
    f = annual.features
    drawn = learning.drawn_medians(f, ["node", "year"], "period", COLUMNS, learning.block_weights(f, "period", draws))
    nodes = cut(drawn.withColumnRenamed("year", "period"), "bootstrap")
    # a draw has every supplier of a whole series in every year, so its layers are those of all
    labels = study.layered_fit(nodes, *annual.layers_of(), COLUMNS, SHARES, K, ("iteration",), MIX, WEIGHT, STARTS).select("iteration", "period", "id", "label")
    return study.aligned_to(labels, annual.points.select("period", "id", "label"), "iteration")


def draw_medians(rows: DataFrame) -> DataFrame:
    """One row: the draws' median likeness and agreement."""
    draws = quality.ari(rows, "reference", "aligned", ("iteration",)).join(quality.agreement(rows, "reference", "aligned", ("iteration",)), "iteration")
    return draws.agg(F.median("ari").alias("median_ari"), F.median("agreement").alias("median_agreement"))


@query()
def bootstrap_refit(s, d):
    """Fits of yearly medians over months drawn with replacement: by supplier and year the share of draws that keep its type, as quantiles, and the draws' median likeness and agreement."""
    rows = bootstrap_rows(Annual(s, d), 50)
    per = learning.bootstrap_agreement(rows, ["period", "id"], "reference", "aligned")
    q = F.percentile("agreement", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    got = per.agg(q.alias("q"), F.avg((F.col("agreement") < 0.8).cast("int")).alias("unsure"), F.count("*").alias("n"))
    draws = draw_medians(rows)
    return rounded(got.crossJoin(F.broadcast(draws)).select("n", *[F.get("q", F.lit(i)).alias(f"p{p}") for i, p in enumerate((10, 50, 90))], "unsure", "median_ari", "median_agreement"))


@query()
def yearly_fits(s, d):
    """A fit of each year by itself: likeness to the fit of all years, its silhouette, modularity and least share, and likeness of each two years that follow."""
    return yearly_rows(Annual(s, d))


def yearly_rows(annual: Annual) -> DataFrame:
    first, second = annual.layers_of()
    alone = annual.medians.withColumn("setting", F.col("period"))
    rows = cut(study.layered_fit(alone, first, second, COLUMNS, SHARES, K, ("setting",), MIX, WEIGHT, STARTS, level="relative_level").drop("setting"), "yearly")
    whole = annual.points.select("period", "id", "label")
    out = quality.ari(study.with_reference(rows, whole), "reference", "label", ("period",)).withColumnRenamed("ari", "ari_pooled")
    out = out.join(quality.silhouette(rows, ("period",)), "period")
    years = rows.select("period").distinct()
    out = out.join(graph.modularity(graph.mixed(first, second, WEIGHT).crossJoin(F.broadcast(years)), rows.select("period", F.col("id").alias("node"), "label"), ("period",)), "period")
    out = out.join(study.least_shares(rows.withColumn("year", F.col("period")), ("year",)).withColumnRenamed("year", "period"), "period")
    return rounded(out.join(study.temporal_ari(rows.select("period", "id", "label")), "period", "left"))


@query()
def missing_covariate(s, d):
    """The fit with a covariate imputed for some suppliers, against a fit without those: likeness on the rest."""
    z = scaled_panel(s, d)
    gaps = panel.imputed(table(s, d, "supplier").select(F.col("s_suppkey").alias("node"), "s_acctbal"), "s_acctbal", F.col("s_acctbal") <= 0)
    covered = cut(panel.zscored(z.join(gaps, "node"), ["s_acctbal"]), "covered")
    columns = [*COLUMNS, "s_acctbal"]
    settings = {"all": covered.drop("imputed"), "known": covered.where("not imputed").drop("imputed")}
    labels = cut(_fit(study.stacked(settings), columns, by=("setting",)).select("setting", "period", "id", "label"), "labels")
    rows = study.with_reference(labels.where("setting = 'known'"), labels.where("setting = 'all'"))
    return rounded(quality.ari(rows, "reference", "label").crossJoin(gaps.agg(F.count_if("imputed").alias("imputed"))))


@query()
def reduced_features(s, d):
    """Fewer features, with and without the graph: silhouette, modularity and stability."""
    z, edges = _inputs(s, d)
    sets = {"all": COLUMNS, "shares": SHARES, "two": COLUMNS[:2]}
    points_ = {}
    for name, columns in sets.items():
        points_[f"{name}|plain"] = study.vectors(z, columns)
        points_[f"{name}|graph"] = study.vectors(study.static_nodes(z, edges, columns, MIX), columns)
    labels = study.fitted(study.stacked(points_), K, ("setting",), STARTS).select("setting", "period", "id", "label")
    rows = cut(labels.join(study.vectors(z, COLUMNS), ["period", "id"]), "rows")
    return rounded(study.bundle(rows, cut(study.dynamic_graph(z, edges, COLUMNS, WIDTH), "graphs"), ("setting",)))


@query()
def annual_agreement(s, d):
    """The yearly majority of the monthly types against the yearly types: likeness and agreement."""
    monthly = dynamic_labels(s, d).withColumn("year", F.substring("period", 1, 4))
    major = sequence.majority(monthly, ["id", "year"], "label").select(F.col("year").alias("period"), "id", "label")
    rows = cut(contracts.one_to_one(major, annual_points(s, d).select("period", "id", F.col("label").alias("reference")), ["period", "id"]), "major")
    return rounded(quality.ari(rows, "reference", "label").crossJoin(quality.agreement(rows, "reference", "label")))


_LEADING = f"""{PANEL}, mo AS (SELECT entity, period, category AS label FROM panel QUALIFY row_number() OVER (PARTITION BY entity, period ORDER BY value DESC, category) = 1),
ct AS (SELECT entity, substr(period, 1, 4) AS year, label, count(*) AS n FROM mo GROUP BY ALL), mj AS (SELECT entity, year, label FROM ct QUALIFY row_number() OVER (PARTITION BY entity, year ORDER BY n DESC, label) = 1),
yr AS (SELECT entity, substr(period, 1, 4) AS year, category AS reference, sum(value) AS v FROM panel GROUP BY ALL), ye AS (SELECT entity, year, reference FROM yr QUALIFY row_number() OVER (PARTITION BY entity, year ORDER BY v DESC, reference) = 1),
j AS (SELECT year, reference, label FROM mj JOIN ye USING (entity, year)), jn AS (SELECT year, reference, label, count(*) AS n FROM j GROUP BY ALL),
ra AS (SELECT year, sum(x * (x - 1) / 2) AS ra FROM (SELECT year, sum(n) AS x FROM jn GROUP BY year, reference) GROUP BY year), rb AS (SELECT year, sum(x * (x - 1) / 2) AS rb FROM (SELECT year, sum(n) AS x FROM jn GROUP BY year, label) GROUP BY year),
jt AS (SELECT year, sum(n * (n - 1) / 2) AS idx, sum(n) AS m, sum(n) FILTER (WHERE reference = label) AS same FROM jn GROUP BY year), je AS (SELECT *, CASE WHEN m > 1 THEN ra * rb / (m * (m - 1) / 2) END AS e FROM jt JOIN ra USING (year) JOIN rb USING (year))"""


@query(f"WITH {_LEADING} SELECT year, round(coalesce(CASE WHEN (ra + rb) / 2 - e <> 0 THEN (idx - e) / ((ra + rb) / 2 - e) END, 1), 6) AS ari, round(coalesce(same, 0) / m, 6) AS agreement FROM je")
def leading_category_agreement(s, d):
    """For each year, the majority of the suppliers' monthly leading categories against the year's leading one."""
    p = cut(long_panel(s, d).withColumn("year", F.substring("period", 1, 4)), "panel")
    monthly = panel.leading(p, ["entity", "year", "period"], "category", "value")
    yearly = panel.leading(p.groupBy("entity", "year", "category").agg(F.sum("value").alias("value")), ["entity", "year"], "category", "value")
    major = sequence.majority(monthly, ["entity", "year"], "category").select("entity", "year", F.col("category").alias("label"))
    rows = cut(contracts.one_to_one(major, yearly.withColumnRenamed("category", "reference"), ["entity", "year"]), "major")
    return rounded(quality.ari(rows, "reference", "label", ("year",)).join(quality.agreement(rows, "reference", "label", ("year",)), "year"))


@query()
def extended_model(s, d):
    """Two further features, the log of the balance and the share of what is returned, smoothed over the same graph as the others: by period, likeness of the types with and without them on the same suppliers, and valid counts."""
    z, edges = _inputs(s, d)
    back = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.avg((F.col("l_returnflag") == "R").cast("int")).alias("returned"))
    more = table(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("node"), F.log1p("s_acctbal").alias("log_balance")).join(back, "node")
    columns = [*COLUMNS, "log_balance", "returned"]
    both = cut(panel.zscored(cut(z.join(more, "node"), "joined"), columns[-2:]), "extended")
    edges = cut(graph.within(edges, both.select("node").distinct()), "edges")
    weights = cut(study.dynamic_graph(both, edges, COLUMNS, WIDTH), "weights")
    near = cut(graph.smoothed(both, weights, columns, MIX, ("period",), edges), "near")
    with_ = study.fitted(study.vectors(near, columns), K).select("period", "id", "label")
    without = study.fitted(study.vectors(near, COLUMNS), K).select("period", "id", "label")
    rows = cut(study.with_reference(with_, without), "both")
    return rounded(quality.ari(rows, "reference", "label", ("period",)).join(rows.groupBy("period").agg(F.count("*").alias("n")), "period"))


# interpretation, checks, exports --------------------------------------------------------------


@query()
def interpretation(s, d):
    """Each supplier's dominant type, margins, transitions, current run and class."""
    return rounded(sequence.stability(dynamic_labels(s, d), "id", "period", "label", "margin"))


@query()
def type_profiles(s, d):
    """Size, regions, level and shares of the types of the last period, and differences from the median of all."""
    last = panel.latest_slice(dynamic_labels(s, d)).select("id", "label")
    f = panel.latest_slice(feature_panel(s, d)).withColumnRenamed("entity", "id")
    r = region_labels(s, d).select(F.col("node").alias("id"), F.col("label").alias("region"))
    rows = contracts.one_to_one(last, f, ["id"]).join(r, "id")
    return rounded(panel.profiles(rows, "label", "region", "relative_level", SHARES))


@query()
def comparable_suppliers(s, d):
    """The three nearest of the same type in the last period, those of other regions first."""
    z = scaled_panel(s, d)
    last = panel.latest_slice(dynamic_labels(s, d)).select("id", "label")
    r = region_labels(s, d).select(F.col("node").alias("id"), F.col("label").alias("region"))
    p = panel.latest_slice(study.vectors(z, COLUMNS)).select("id", "x").join(last, "id").join(r, "id")
    return rounded(quality.neighbours(p, 3, other_first="region"))


@query()
def persistent_types(s, d):
    """Transitions between types that last three periods on either side, with the margin of the new run."""
    return rounded(sequence.persistent_transitions(dynamic_labels(s, d), "id", "period", "label", 3, "margin"))


@query()
def external_validation(s, d):
    """Whether a customer's segment tells more of an order's log price than the nation does: errors over held-out customers by ridge regression."""
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.log1p(F.avg("o_totalprice")).alias("target"), F.log(F.count("*")).alias("n_orders"))
    c = table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    rows = c.join(o, "c_custkey").withColumn("fold", F.pmod(F.xxhash64("c_custkey"), F.lit(5)).cast("int"))
    return rounded(learning.ridge_gain(rows, ["n_orders"], "nation", "segment", "target", "fold"))


def _matrix(cells: DataFrame, columns: list[str]) -> np.ndarray:
    got = {(r["a"], r["b"]): r["cov"] or 0.0 for r in cells.collect()}
    return np.array([[got[a, b] for b in columns] for a in columns])


def calibrated(s, d) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, covariances of the suppliers' effects and of the noise, of the types of the plain panel."""
    z = scaled_panel(s, d)
    labels = study.fitted(study.vectors(z, COLUMNS), K).select("period", F.col("id").alias("node"), "label")
    centres, effect, noise = learning.calibration(z.join(labels, ["period", "node"]), "node", "label", COLUMNS)
    c = np.array([[r[k] for k in COLUMNS] for r in centres.orderBy("label").collect()])
    return c, _matrix(effect, COLUMNS), _matrix(noise, COLUMNS)


@query()
def residual_calibration(s, d):
    """The standard deviations of the suppliers' effects and of the noise, by feature."""
    _, effect, noise = calibrated(s, d)
    rows = [(c, float(np.sqrt(max(a, 0))), float(np.sqrt(max(b, 0)))) for c, a, b in zip(COLUMNS, np.diag(effect), np.diag(noise), strict=True)]
    return rounded(s.createDataFrame(rows, "feature string, effect_std double, noise_std double"))


@query()
def acceptance(s, d):
    """Whether the yearly types pass: median likeness and agreement of the draws, least likeness over the grid of neighbours, likeness of years that follow."""
    annual = Annual(s, d)
    draws = rounded(draw_medians(bootstrap_rows(annual, 50)))
    grid = neighbour_rows(annual).agg(F.min("ari_reference").alias("least_grid_ari"))
    years = yearly_rows(annual).agg(F.min("temporal_ari").alias("cross_year_ari"))
    return study.accepted(draws.crossJoin(grid).crossJoin(years), median_ari=0.8, median_agreement=0.9, least_grid_ari=0.85, cross_year_ari=0.8)


_FACTS = "SELECT count(*) AS cells, count(DISTINCT entity) AS entities, count(DISTINCT period) AS periods, count(*) FILTER (WHERE value IS NULL) AS \"empty cells\", (SELECT count(DISTINCT entity) FROM whole_panel) AS \"whole series\", count(*) - count(DISTINCT (entity, period, category)) AS \"repeated keys\" FROM panel"
_FACT_NAMES = ["cells", "entities", "periods", "empty cells", "whole series", "repeated keys"]
_PAIR_NAMES = ["n_rows", "zero", "low", "high", "repeated", "pairs", "directed", "conflicts", "nodes"]


def _long_sql(table: str, names: list[str], prefix: str = "") -> str:
    """Rows of (name, value) of the columns `names` of a table, in DuckDB SQL."""
    return " UNION ALL ".join(f"SELECT {prefix}'{c}' AS name, round(CAST(\"{c}\" AS DOUBLE), 6) AS value FROM {table}" for c in names)


@query(f"WITH {PANEL}, fa AS ({_FACTS}), au AS ({AUDIT_SQL}) {_long_sql('fa', _FACT_NAMES)} UNION ALL {_long_sql('au', _PAIR_NAMES, "layer || ' ' || ")}")
def data_audit(s, d):
    """A report's rows: cells, entities, periods, whole series, repeated keys and pairs by layer, as names and values."""
    p = cut(long_panel(s, d), "panel")
    facts = p.agg(F.count("*").alias("cells"), F.count_distinct("entity").alias("entities"), F.count_distinct("period").alias("periods"), F.count_if(F.col("value").isNull()).alias("empty cells"))
    whole = panel.complete(p).agg(F.count_distinct("entity").alias("whole series"))
    twice = panel.duplicate_keys(p, "entity", "period", "category").select(F.col("n_duplicates").alias("repeated keys"))
    row = facts.crossJoin(whole).crossJoin(twice)
    first = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("value")) for c in row.columns])).alias("r")).select("r.*")
    layers = cut(layer_audits(s, d), "audits")
    names = [c for c in layers.columns if c != "layer"]
    pairs = layers.select(F.explode(F.array(*[F.struct(F.concat(F.col("layer"), F.lit(f" {c}")).alias("name"), F.col(c).cast("double").alias("value")) for c in names])).alias("r")).select("r.*")
    return rounded(first.unionByName(pairs))


@query()
def site_export(s, d):
    """A JSON document a supplier: its types in order, margins and comparable suppliers; written, read again and checked for completeness."""
    labels = cut(dynamic_labels(s, d), "labels")
    periods = labels.select("period").distinct().count()
    contracts.complete(labels, ["id"], rows=periods)
    h = panel.histories(labels, "id", "period", ["label", "margin"])
    z = scaled_panel(s, d)
    last = panel.latest_slice(study.vectors(z, COLUMNS)).select("id", "x").join(panel.latest_slice(labels).select("id", "label"), "id")
    peers = quality.neighbours(last, 3).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "peer", F.bround("distance", 6).alias("distance")))).alias("peers"))
    import uuid

    path = f"{shared_dir(s)}/weftline-site-{uuid.uuid4().hex}"
    sinks.write_json(h.join(peers, "id", "left").select("id", "history", "peers"), path, ["id"])
    got = s.read.json(path, "id long, history struct<period:array<string>,label:array<int>,margin:array<double>>, peers array<struct<rank:int,peer:long,distance:double>>")
    return got.select("id", F.size("history.label").alias("periods"), F.coalesce(F.size("peers"), F.lit(0)).alias("peers"))
