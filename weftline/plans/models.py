"""Queries of the fitted models, and of joins and exports that need more than one table's operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import graph, learning, sequence
from weftline.plans.catalogue import _PERSIST, LAYERS, NODES, knn_layers, points, query, rounded, states_with_margin, supplier_nodes, transport
from weftline.shared import cut
from weftline.tables import table


@query()
def kmeans_labels(s, d):
    """The best of ten starts over the vectors, with each one's relative margin."""
    p = points(s, d).drop("label")
    return learning.assigned(p, learning.kmeans(p, 10)[0]).select("id", "label", F.round("margin", 6).alias("margin"))


@query()
def mixture_labels(s, d):
    """The likeliest of ten diagonal mixtures started from k-means centres."""
    return learning.diagonal_mixture(points(s, d).drop("label"), 10).select("id", "label")


@query("WITH x AS (SELECT vec_id AS id, label, (label * 7 + CASE WHEN vec_id % 5 = 0 THEN 4 ELSE 3 END) % 10 AS renamed FROM embeddings), n AS (SELECT renamed, label, count(*) AS n FROM x GROUP BY ALL), m AS (SELECT renamed, arg_max(label, n) AS aligned FROM n GROUP BY 1) SELECT id, aligned FROM x JOIN m USING (renamed)")
def label_alignment(s, d):
    """Renamed labels get their names back, those of a fifth of the vectors another label's."""
    rows = points(s, d).select("id", "label", ((F.col("label") * 7 + F.when(F.col("id") % 5 == 0, 4).otherwise(3)) % 10).alias("renamed"))
    return learning.aligned(rows, "label", "renamed").select("id", "aligned")


@query()
def ridge_validation(s, d):
    """Held-out errors of an order's price by its lines, in five folds of orders."""
    line = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    o = table(s, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.pmod(F.xxhash64("o_orderkey"), F.lit(5)).cast("int").alias("fold"))
    return learning.ridge_folds(o.join(line, F.col("o_orderkey") == F.col("l_orderkey")), ["n", "quantity", "discount"], "price", "fold")


@query()
def entity_subsamples(s, d):
    """Mean price by trial, over 80 % of the customers each."""
    return learning.subsample(table(s, d, "orders"), "o_custkey", 20).groupBy("trial").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 6).alias("price"))


@query()
def month_bootstrap(s, d):
    """Mean price by bootstrap of months within their year."""
    o = table(s, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_totalprice")
    months = cut(o.groupBy("month").agg(F.count("*").alias("n"), F.count("o_totalprice").alias("known"), F.sum("o_totalprice").alias("total")), "months")
    drawn = months.join(F.broadcast(learning.block_weights(months, "month", 50)), "month")
    times = lambda c: F.sum(F.col(c) * F.col("weight"))
    return drawn.groupBy("iteration").agg(times("n").alias("n"), F.round(times("total") / times("known"), 6).alias("price"))


_EVENTS = "WITH " + _PERSIST.replace("{n}", "2") + ", e AS (SELECT DISTINCT entity FROM st), ac AS (SELECT entity FROM ch WHERE changed), x AS (SELECT (SELECT count(*) FROM ac) AS true_events, (SELECT count(*) FROM pt) AS found_events, (SELECT count(*) FROM e WHERE entity NOT IN (SELECT entity FROM ac)) AS stable_nodes)"


@query(_EVENTS + " SELECT true_events, found_events, found_events AS matched, CAST(0 AS BIGINT) AS false_events, CAST(CASE WHEN found_events > 0 THEN 1 END AS DOUBLE) AS precision, round(found_events / true_events, 6) AS recall, stable_nodes, CAST(0 AS BIGINT) AS false_stable, CAST(CASE WHEN stable_nodes > 0 THEN 0 END AS DOUBLE) AS false_stable_percent FROM x")
def event_scores(s, d):
    """Transitions that last two days on both sides, scored against all changes of state; each matches the change that it is."""
    rows = states_with_margin(s, d)
    place = rows.select("entity", "period", F.row_number().over(Window.partitionBy("entity").orderBy("period")).alias("at"))
    at = lambda df: df.join(place, ["entity", "period"]).select("entity", "from_label", "to_label", "at")
    found = sequence.persistent_transitions(rows, "entity", "period", "label", 2)
    return rounded(learning.event_scores(at(sequence.all_changes(rows, "entity", "period", "label")), at(found), rows.select("entity")))


@query("SELECT c_custkey, s_suppkey, s_name FROM (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '000' AS code FROM customer) JOIN (SELECT s_suppkey, s_name, lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS code8 FROM supplier) ON substr(code, 1, 8) = code8")
def prefix_join(s, d):
    c = table(s, d, "customer").select("c_custkey", F.concat(F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.lit("000")).alias("code"))
    v = table(s, d, "supplier").select("s_suppkey", "s_name", F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("code8"))
    return c.join(v, F.substring("code", 1, 8) == F.col("code8")).select("c_custkey", "s_suppkey", "s_name")


@query(f"WITH {LAYERS} SELECT src, dst, round(w, 6) AS w, s_name FROM mix JOIN supplier ON s_suppkey = dst WHERE src = 1")
def ego_network(s, d):
    """One supplier's neighbours and the weights of its links."""
    names = table(s, d, "supplier").select("s_suppkey", "s_name")
    return rounded(transport(s, d).where("src = 1").join(names, F.col("dst") == F.col("s_suppkey")).select("src", "dst", "w", "s_name"))


@query("""SELECT n_nationkey, n_name, CAST(to_json(coalesce(list({'id': s_suppkey, 'name': s_name} ORDER BY s_suppkey) FILTER (WHERE s_suppkey IS NOT NULL), [])) AS VARCHAR) AS suppliers
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name""")
def nested_export(s, d):
    """A JSON document a nation, with its suppliers in order."""
    v = table(s, d, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))).alias("v"))
    rows = table(s, d, "nation").join(v, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return rows.select("n_nationkey", "n_name", F.coalesce(F.to_json("v"), F.lit("[]")).alias("suppliers"))


@query(f"""WITH {NODES}, {LAYERS}, h AS (SELECT src, sum(w * level) / sum(w) AS h FROM g1 JOIN nd ON node = dst GROUP BY src), r AS (SELECT src, sum(w * level) / sum(w) AS r FROM g2 JOIN nd ON node = dst GROUP BY src)
SELECT node, round(0.8 * level + 0.2 * coalesce(0.75 * h + 0.25 * r, h, r, level), 6) AS level FROM nd LEFT JOIN h ON h.src = node LEFT JOIN r ON r.src = node""")
def smooth_two_layers(s, d):
    """Each layer normalised on its own; a node with one layer takes it whole, one with none keeps its value."""
    nodes = supplier_nodes(s, d).select("node", "level")
    near = graph.two_layers(nodes, *knn_layers(s, d), ["level"], 0.25).withColumnRenamed("level", "near")
    return rounded(nodes.join(near, "node").select("node", (0.8 * F.col("level") + 0.2 * F.col("near")).alias("level")))
