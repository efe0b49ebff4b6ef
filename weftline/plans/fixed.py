"""Queries of learning operators with fixed labels, centres or predictions, which SQL can follow, and reconciliation over two years."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from weftline.functions import scalars
from weftline.operators import learning, quality, reconcile, study
from weftline.plans.catalogue import POINTS, points, query, region_labels, rounded
from weftline.plans.networks import _INDICES, COLUMNS, WIDTH, panel_edges, scaled_panel
from weftline.shared import cut
from weftline.tables import table

_CENTRES = f"{POINTS}, ce AS (SELECT id AS k, x AS c FROM p WHERE id < 3), dd AS (SELECT id, k, list_distance(x, c) AS d FROM p, ce), rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, k) AS rn FROM dd)"


@query(f"WITH {_CENTRES} SELECT a.id, CAST(a.k AS INT) AS label, round(CASE WHEN b.d > 0 THEN (b.d - a.d) / b.d ELSE 0 END, 6) AS margin FROM rk a JOIN rk b ON a.id = b.id AND a.rn = 1 AND b.rn = 2")
def nearest_centres(s, d):
    """Each vector's nearest of the first three, and its relative margin."""
    p = points(s, d).select("id", "x")
    centres = np.array([r["x"] for r in p.where("id < 3").orderBy("id").collect()])
    return rounded(learning.assigned_many(p, {(): (centres, 0.0)}).select("id", "label", "margin"))


@query(f"WITH {_CENTRES} SELECT id, " + ", ".join(f"round(max(d) FILTER (WHERE k = {i}), 6) AS d{i}" for i in range(3)) + " FROM dd GROUP BY id")
def centre_distances(s, d):
    """The distances to the first three vectors."""
    p = points(s, d).select("id", "x")
    centres = [r["x"] for r in p.where("id < 3").orderBy("id").collect()]
    return rounded(p.select("id", *[F.sqrt(learning._sq(F.col("x"), c)).alias(f"d{i}") for i, c in enumerate(centres)]))


@query("WITH m AS (SELECT c_mktsegment AS old, median(c_acctbal) AS m FROM customer GROUP BY 1), o AS (SELECT old, row_number() OVER (ORDER BY m, old) AS label FROM m) SELECT c_custkey, CAST(label AS INT) AS label FROM customer JOIN o ON old = c_mktsegment")
def canonical_labels(s, d):
    """Segments numbered by their median balance."""
    c = table(s, d, "customer").select("c_custkey", "c_acctbal", F.col("c_mktsegment").alias("label"))
    return learning.ordered_labels(c, "c_acctbal").select("c_custkey", "label")


@query("WITH g AS (SELECT o_orderpriority AS p, o_totalprice AS y, avg(o_totalprice) OVER () AS base, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS fit FROM orders), e AS (SELECT avg(pow(y - base, 2)) AS b, avg(pow(y - fit, 2)) AS f FROM g) SELECT round(b / 1e6, 4) AS base_mse, round(f / 1e6, 4) AS mse, round(sqrt(b), 4) AS base_rmse, round(sqrt(f), 4) AS rmse, round(100 * (1 - f / b), 6) AS reduction_percent FROM e")
def error_reduction(s, d):
    """Squared errors of an order's price by the mean of all and of its priority."""
    o = table(s, d, "orders").select("o_orderpriority", "o_totalprice")
    fit = o.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("fit"))
    rows = o.join(fit, "o_orderpriority").join(F.broadcast(o.agg(F.avg("o_totalprice").alias("base"))))
    e = rows.agg(F.avg(F.pow(F.col("o_totalprice") - F.col("base"), 2)).alias("b"), F.avg(F.pow(F.col("o_totalprice") - F.col("fit"), 2)).alias("f"))
    return e.select(F.round(F.col("b") / 1e6, 4).alias("base_mse"), F.round(F.col("f") / 1e6, 4).alias("mse"), F.round(F.sqrt("b"), 4).alias("base_rmse"), F.round(F.sqrt("f"), 4).alias("rmse"), F.round(100 * (1 - F.col("f") / F.col("b")), 6).alias("reduction_percent"))


_RUNS = "r AS (SELECT vec_id AS id, label AS reference, i, CASE WHEN (vec_id * 7 + i) % 11 < 3 THEN (label + 1) % 10 ELSE label END AS aligned FROM embeddings, (SELECT unnest(range(20)) AS i))"


@query(f"WITH {_RUNS}, a AS (SELECT id, avg(CAST(reference = aligned AS INT)) AS agreement FROM r GROUP BY 1) SELECT round(min(agreement), 6) AS least, round(avg(agreement), 6) AS mean, round(quantile_cont(agreement, 0.1), 6) AS p10, round(avg(CAST(agreement < 0.8 AS INT)), 6) AS unsure FROM a")
def run_agreement(s, d):
    """How often twenty runs give a vector its label, where which run errs is fixed."""
    i = F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i")
    rows = points(s, d).select("id", F.col("label").alias("reference"), i)
    rows = rows.withColumn("aligned", F.when((F.col("id") * 7 + F.col("i")) % 11 < 3, (F.col("reference") + 1) % 10).otherwise(F.col("reference")))
    a = learning.bootstrap_agreement(rows, ["id"], "reference", "aligned")
    return rounded(a.agg(F.min("agreement").alias("least"), F.avg("agreement").alias("mean"), F.percentile("agreement", 0.1).alias("p10"), F.avg((F.col("agreement") < 0.8).cast("int")).alias("unsure")))


_FLAT = "v AS (SELECT l_suppkey AS node, n_regionkey AS label, l_quantity / 10 AS a, l_discount * 10 AS b FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey), rs AS (SELECT node, a - avg(a) OVER (PARTITION BY label) AS a, b - avg(b) OVER (PARTITION BY label) AS b FROM v), ef AS (SELECT node, avg(a) AS ea, avg(b) AS eb FROM rs GROUP BY 1), no AS (SELECT a - ea AS a, b - eb AS b FROM rs JOIN ef USING (node))"
_CELLS = "SELECT '{p}' AS part, 'a' AS x, 'a' AS y, var_samp({a}) AS cov FROM {t} UNION ALL SELECT '{p}', 'a', 'b', covar_samp({a}, {b}) FROM {t} UNION ALL SELECT '{p}', 'b', 'a', covar_samp({a}, {b}) FROM {t} UNION ALL SELECT '{p}', 'b', 'b', var_samp({b}) FROM {t}"


@query(f"WITH {_FLAT}, c AS ({_CELLS.format(p='effect', a='ea', b='eb', t='ef')} UNION ALL {_CELLS.format(p='noise', a='a', b='b', t='no')}) SELECT part, x, y, round(cov, 6) AS cov FROM c")
def region_calibration(s, d):
    """Covariances of the suppliers' effects and of the noise, with regions as types."""
    line = table(s, d, "lineitem").select(F.col("l_suppkey").alias("node"), (F.col("l_quantity") / 10).alias("a"), (F.col("l_discount") * 10).alias("b"))
    _, effect, noise = learning.calibration(line.join(region_labels(s, d), "node"), "node", "label", ["a", "b"])
    tag = lambda df, name: df.select(F.lit(name).alias("part"), F.col("a").alias("x"), F.col("b").alias("y"), "cov")
    return rounded(tag(effect, "effect").unionByName(tag(noise, "noise")))


@query("WITH g AS (SELECT c_mktsegment AS model, round(avg(c_acctbal), 6) AS up, round(stddev_pop(c_acctbal), 6) AS down FROM customer GROUP BY 1) SELECT 'up' AS metric, arg_max(model, up) AS winner FROM g UNION ALL SELECT 'down', arg_min(model, down) FROM g")
def segment_winners(s, d):
    """The segment with the highest mean and the one with the least spread of balances."""
    g = table(s, d, "customer").groupBy(F.col("c_mktsegment").alias("model")).agg(F.round(F.avg("c_acctbal"), 6).alias("up"), F.round(F.stddev_pop("c_acctbal"), 6).alias("down"))
    return study.winners(g, "model", ["up"], ["down"])


@query("WITH g AS (SELECT c_nationkey AS nation, round(avg(c_acctbal), 6) AS mean, CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY 1) SELECT *, mean >= 4000 AND n >= 5 AS accepted FROM g")
def threshold_acceptance(s, d):
    """Nations whose mean balance and number of customers both reach a threshold."""
    g = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.round(F.avg("c_acctbal"), 6).alias("mean"), F.count("*").cast("double").alias("n"))
    return study.accepted(g, mean=4000, n=5)


_SIL = """w AS (SELECT z.period, z.node AS id, label, [relative_level, s_economy, s_large, s_medium, s_promo, s_small] AS x FROM z JOIN lab USING (node)),
sd AS (SELECT a.period, a.id, a.label AS own, b.label AS other, avg(list_distance(a.x, b.x)) AS m FROM w a JOIN w b ON a.period = b.period AND a.id <> b.id GROUP BY ALL),
sf AS (SELECT period, id, max(m) FILTER (WHERE own = other) AS a, min(m) FILTER (WHERE own <> other) AS b FROM sd GROUP BY ALL)"""


@query(f"WITH {_INDICES}, {_SIL} SELECT period, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM sf GROUP BY period")
def monthly_silhouette(s, d):
    """The silhouette of the suppliers' regions in every period."""
    z = scaled_panel(s, d)
    labels = region_labels(s, d).withColumnRenamed("node", "id")
    return rounded(quality.silhouette(study.vectors(z, COLUMNS).join(labels, "id"), ("period",)))


@query(f"WITH {_INDICES}, k AS (SELECT period, node, (label + CASE WHEN period > '1996' AND node % 3 = 0 THEN 1 ELSE 0 END) % 5 AS label FROM pl), st AS (SELECT avg(CAST(label = b AS INT)) AS stability FROM (SELECT label, lag(label) OVER (PARTITION BY node ORDER BY period) AS b FROM k) WHERE b IS NOT NULL), n AS (SELECT period, label, count(*) AS n FROM k GROUP BY ALL), gr AS (SELECT p.period, l.label, coalesce(n, 0) AS n FROM (SELECT DISTINCT period FROM n) p CROSS JOIN (SELECT DISTINCT label FROM n) l LEFT JOIN n ON n.period = p.period AND n.label = l.label) SELECT round(stability, 6) AS stability, round((SELECT min(n / t) FROM (SELECT n, sum(n) OVER (PARTITION BY period) AS t FROM gr)), 6) AS least_share FROM st")
def label_bundle(s, d):
    """The share of labels that stay from period to period, and the least share of one, of regions that a third of the suppliers leave in 1996."""
    z = scaled_panel(s, d).select("period", F.col("node").alias("id"))
    moved = F.when((F.col("period") > "1996") & (F.col("id") % 3 == 0), 1).otherwise(0)
    rows = z.join(region_labels(s, d).withColumnRenamed("node", "id"), "id").withColumn("label", (F.col("label") + moved) % 5)
    return rounded(study.stability_share(rows).crossJoin(F.broadcast(study.least_shares(rows))))


_TWO = """a AS (SELECT s_suppkey AS id, s_nationkey AS region, unnest([lower(s_name), replace(lower(s_name), 'supplier', 'customer')]) AS x, lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS code FROM supplier),
nm AS (SELECT DISTINCT id, region, regexp_replace(x, '[^a-z0-9]', '', 'g') AS name FROM a), cn AS (SELECT c_nationkey AS region, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS name, c_custkey FROM customer WHERE c_acctbal >= 0),
y1 AS (SELECT id, count(DISTINCT c_custkey) AS n FROM nm JOIN cn USING (region, name) GROUP BY 1), cc AS (SELECT lpad(CAST(c_custkey % 60 AS VARCHAR), 8, '0') || '00' AS whole, c_custkey FROM customer WHERE c_acctbal >= 5000),
y2 AS (SELECT s.id, count(*) AS n FROM (SELECT DISTINCT id, code FROM a) s JOIN cc ON substr(whole, 1, 8) = code GROUP BY 1)"""
_ST = "CASE WHEN coalesce({0}.n, 0) = 1 THEN 'matched' WHEN {0}.n > 1 THEN 'ambiguous' ELSE 'missing' END"


@query(f"WITH {_TWO} SELECT s_suppkey AS id, {_ST.format('y1')} AS status_2023, {_ST.format('y2')} AS status_2024, coalesce(y1.n, 0) = 1 AND coalesce(y2.n, 0) = 1 AS complete FROM supplier LEFT JOIN y1 ON y1.id = s_suppkey LEFT JOIN y2 ON y2.id = s_suppkey")
def population_reconciliation(s, d):
    """Suppliers in two registers: by normalised names and aliases of the nation in one, by the first digits of a code in the other; complete where each has exactly one."""
    v, c = table(s, d, "supplier"), table(s, d, "customer")
    names = F.array(F.lower("s_name"), F.replace(F.lower("s_name"), F.lit("supplier"), F.lit("customer")))
    ours = v.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("region"), names.alias("names"))
    theirs = c.where("c_acctbal >= 0").select("c_custkey", F.col("c_nationkey").alias("region"), F.array("c_name").alias("names"))
    first = reconcile.name_candidates(ours, theirs, "id", "c_custkey").select("id", F.lit(2023).alias("year"), F.col("candidates").alias("n"))
    code = F.concat(F.lpad((F.col("c_custkey") % 60).cast("string"), 8, "0"), F.lit(" 0 0"))
    held = c.where("c_acctbal >= 5000").select(scalars.prefix_key(code).alias("key"))
    second = v.select(F.col("s_suppkey").alias("id"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("key")).join(held, "key").groupBy("id").agg(F.count("*").alias("n")).select("id", F.lit(2024).alias("year"), "n")
    return reconcile.both_years(first.unionByName(second), "id", "year", "n", [2023, 2024])


@query()
def annual_baseline(s, d):
    """Two to eight types of yearly features without a graph: silhouette, indices of the centres, and agreement of neighbouring years."""
    from weftline.plans.studies import annual_nodes

    nodes = annual_nodes(s, d)
    p = cut(study.vectors(nodes, COLUMNS), "points")
    ks = range(2, 9)
    labels = study.fitted(study.stacked({str(k): p for k in ks}), {(str(k),): k for k in ks}, ("setting",)).select("setting", "period", "id", "label", "x")
    pooled = labels.withColumn("id", F.concat_ws("|", "period", F.col("id").cast("string")))
    sil = quality.silhouettes(pooled, "setting").join(quality.centre_indices(pooled, ("setting",)), "setting")
    return rounded(sil.join(study.stability_share(labels, ("setting",)), "setting"))


@query()
def dynamic_summary(s, d):
    """Weight of the periods' graphs against the transport graph's, on average, and the mean indices of the fitted types."""
    from weftline.operators import graph
    from weftline.plans.studies import dynamic_labels

    z = scaled_panel(s, d)
    edges = panel_edges(s, d, z)
    graphs = cut(study.dynamic_graph(z, edges, COLUMNS, WIDTH), "graphs")
    ratio = graph.weight_ratio(graphs, edges, "period").agg(F.avg("ratio").alias("weight_ratio"))
    rows = cut(dynamic_labels(s, d).select("period", "id", "label").join(study.vectors(z, COLUMNS), ["period", "id"]), "rows")
    monthly = study.monthly_metrics(rows, graphs)
    means = monthly.agg(*[F.avg(c).alias(c) for c in monthly.columns if c != "period"])
    temporal = study.temporal_ari(rows).agg(F.avg("temporal_ari").alias("temporal_ari"))
    return rounded(means.crossJoin(F.broadcast(temporal)).crossJoin(F.broadcast(ratio)))
