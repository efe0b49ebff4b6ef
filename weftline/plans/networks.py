"""Queries of graphs by period: representations, weights, indices, neighbours and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import graph, panel, quality
from weftline.plans.catalogue import _ECON, FEATURES, LAYERS, POINTS, REGION, SHARES, feature_panel, nation_layer, points, query, region_labels, rounded, supplier_nodes, transport
from weftline.shared import cut
from weftline.tables import table

COLUMNS = ["relative_level", *SHARES]
MIX, WIDTH = 0.2, 1.0


def scaled_panel(s, d):
    """(period, node, features): the standardised features of suppliers with a whole series."""
    f = feature_panel(s, d).select(F.col("entity").alias("node"), "period", *COLUMNS)
    return cut(panel.zscored(f, COLUMNS, SHARES), "scaled")


def panel_edges(s, d, nodes):
    """The transport graph among the panel's suppliers, written once, as each period reads it."""
    return cut(graph.within(transport(s, d), nodes.select("node").distinct()), "transport")


_CENTRED = ", ".join(f"{c} - median({c}) OVER (PARTITION BY period) AS {c}" for c in SHARES)
_Z = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in COLUMNS)
_PANEL = f"{FEATURES}, cen AS (SELECT entity AS node, period, relative_level, {_CENTRED} FROM feat), z AS (SELECT node, period, {_Z} FROM cen)"
_GAP = " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in COLUMNS)
_GRAPHS = f"{LAYERS}, {_PANEL}, tr AS (SELECT * FROM mix WHERE src IN (SELECT node FROM z) AND dst IN (SELECT node FROM z)), dyn AS (SELECT a.period, src, dst, w * exp(-({_GAP}) / 2) AS w FROM tr JOIN z a ON a.node = src JOIN z b ON b.node = dst AND b.period = a.period), con AS (SELECT src AS node, sum(w) AS deg FROM tr GROUP BY src)"


@query(f"WITH {_GRAPHS} SELECT period, src, dst, round(w, 6) AS w FROM dyn")
def dynamic_weights(s, d):
    """Every edge's weight in every period."""
    z = scaled_panel(s, d)
    return rounded(graph.reweighted(panel_edges(s, d, z), z, COLUMNS, WIDTH, ("period",)))


def _smooth_sql(edges: str, on: str) -> str:
    mean = ", ".join(f"sum(e.w * b.{c}) / sum(e.w) AS m_{c}" for c in COLUMNS)
    blend = ", ".join(f"round(CASE WHEN deg > 0 THEN 0.8 * z.{c} + 0.2 * coalesce(m_{c}, 0) ELSE z.{c} END, 6) AS {c}" for c in COLUMNS)
    return f"m AS (SELECT b.period, e.src AS node, {mean} FROM {edges} e JOIN z b ON {on} GROUP BY ALL) SELECT z.period, z.node, {blend} FROM z LEFT JOIN m ON m.node = z.node AND m.period = z.period LEFT JOIN con ON con.node = z.node"


@query(f"WITH {_GRAPHS}, {_smooth_sql('tr', 'b.node = e.dst')}")
def static_representation(s, d):
    """The panel smoothed over the one transport graph, in every period."""
    z = scaled_panel(s, d)
    return rounded(graph.smoothed(z, panel_edges(s, d, z), COLUMNS, MIX, ("period",)))


@query(f"WITH {_GRAPHS}, {_smooth_sql('dyn', 'b.node = e.dst AND b.period = e.period')}")
def dynamic_representation(s, d):
    """The panel smoothed over each period's own weights; who has neighbours is decided on the transport graph."""
    z = scaled_panel(s, d)
    edges = panel_edges(s, d, z)
    return rounded(graph.resmoothed(z, edges, COLUMNS, COLUMNS, MIX, WIDTH, ("period",)))


@query(f"WITH {_GRAPHS} SELECT period, round(sum(w) / (SELECT sum(w) FROM tr), 6) AS ratio FROM dyn GROUP BY period")
def weight_ratio(s, d):
    z = scaled_panel(s, d)
    edges = panel_edges(s, d, z)
    return rounded(graph.weight_ratio(graph.reweighted(edges, z, COLUMNS, WIDTH, ("period",)), edges, "period"))


_INDICES = f"""{_GRAPHS}, {REGION}, pl AS (SELECT DISTINCT period, node, label FROM z JOIN lab USING (node)), bt AS (SELECT dyn.period, a.label AS ls, b.label AS ld, sum(w) AS w FROM dyn JOIN lab a ON a.node = src JOIN lab b ON b.node = dst GROUP BY ALL),
c AS (SELECT period, ls, coalesce(sum(w) FILTER (WHERE ls = ld), 0) AS i, coalesce(sum(w) FILTER (WHERE ls <> ld), 0) AS o FROM bt GROUP BY ALL), q AS (SELECT l.period, l.label AS ls, coalesce(i, 0) AS i, coalesce(o, 0) AS o FROM (SELECT DISTINCT period, label FROM pl) l LEFT JOIN c ON c.ls = l.label AND c.period = l.period),
iso AS (SELECT period, avg(CASE WHEN i + o > 0 THEN i / (i + o) ELSE 0 END) AS avi, sum(CASE WHEN i + o > 0 THEN i / (i + o) ELSE 0 END) AS mq, count(*) AS k, CASE WHEN sum(i + o) > 0 THEN sum(i) / sum(i + o) - sum(pow(i + o, 2)) / pow(sum(i + o), 2) END AS modularity FROM q GROUP BY period),
u AS (SELECT x.period, sum(CASE WHEN p.o + r.o - w <> 0 THEN w / (p.o + r.o - w) ELSE 0 END) AS u FROM bt x JOIN q p ON p.ls = x.ls AND p.period = x.period JOIN q r ON r.ls = x.ld AND r.period = x.period WHERE x.ls <> x.ld GROUP BY x.period)"""


@query(f"WITH {_INDICES} SELECT period, round(avi, 6) AS avi, round(coalesce(u, 0) / k, 6) AS avu, round(avi / (1 + avi * coalesce(u, 0) / k), 6) AS anui, round(mq, 6) AS mq, round(modularity, 6) AS modularity FROM iso LEFT JOIN u USING (period)")
def monthly_indices(s, d):
    """The indices of each period's graph for the suppliers' regions as labels."""
    z = scaled_panel(s, d)
    labels = z.select("period", "node").join(region_labels(s, d), "node")
    return rounded(graph.network_indices(graph.reweighted(panel_edges(s, d, z), z, COLUMNS, WIDTH, ("period",)), labels, ("period",)))


def _near_sql(distance: str) -> str:
    return f"{POINTS}, dd AS (SELECT a.label, a.id, b.id AS peer, {distance} AS distance FROM p a JOIN p b USING (label) WHERE a.id <> b.id), near AS (SELECT * FROM dd QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(distance, 9), peer) <= 4)"


def _graph_sql(width: float) -> str:
    return f"g AS (SELECT label, id AS src, peer AS dst, exp(-pow(greatest(distance, 0), 2) / (2 * {width} * {width})) AS w FROM near), sy AS (SELECT label, src, dst, max(w) AS w FROM (SELECT * FROM g UNION ALL SELECT label, dst, src, w FROM g) GROUP BY ALL HAVING max(w) > 0)"


@query(f"WITH {_near_sql('list_distance(a.x, b.x)')}, {_graph_sql(5.0)} SELECT label, src, dst, round(w, 6) AS w FROM sy")
def economic_graph(s, d):
    """Four Euclidean neighbours of each vector of a label, with Gaussian weights, made symmetric."""
    near = quality.neighbours(points(s, d), 4)
    return rounded(graph.similarity_graph(near, 4, 5.0, ("label",)))


@query(f"WITH {_near_sql('1 - list_cosine_similarity(a.x, b.x)')}, {_graph_sql(1.0)} SELECT label, src, dst, round(w, 6) AS w FROM sy")
def cosine_graph(s, d):
    """The same by cosine distance."""
    return rounded(graph.similarity_graph(quality.neighbours(points(s, d), 4, metric="cosine"), 4, 1.0, ("label",)))


@query(f"WITH {_near_sql('list_distance(a.x, b.x)')}, {_graph_sql(5.0)}, n AS (SELECT label, count(*) AS n FROM p GROUP BY 1) SELECT n.label, round(coalesce(count(src), 0) / any_value(n), 6) AS mean_degree FROM n LEFT JOIN sy ON sy.label = n.label GROUP BY n.label")
def mean_degree(s, d):
    p = points(s, d)
    return rounded(graph.mean_degree(graph.similarity_graph(quality.neighbours(p, 4), 4, 5.0, ("label",)), p.select("label", F.col("id").alias("node")), ("label",)))


_REACH = f"WITH RECURSIVE {LAYERS}, lnk AS (SELECT src, dst FROM g2 WHERE w > 0), rc AS (SELECT s_suppkey AS node, s_suppkey AS seen FROM supplier UNION SELECT rc.node, dst FROM rc JOIN lnk ON src = rc.seen), cp AS (SELECT node, min(seen) AS component FROM rc GROUP BY node)"


@query(f"{_REACH} SELECT node, component FROM cp")
def graph_components(s, d):
    """The components of the layer of three neighbours of the nation."""
    return graph.components(nation_layer(s, d), table(s, d, "supplier").select(F.col("s_suppkey").alias("node")))


@query(f"{_REACH} SELECT (SELECT count(DISTINCT component) FROM cp) AS components, (SELECT max(n) FROM (SELECT count(*) AS n FROM cp GROUP BY component)) AS largest, (SELECT count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT src FROM lnk)) AS isolated")
def component_summary(s, d):
    return graph.component_summary(nation_layer(s, d), table(s, d, "supplier").select(F.col("s_suppkey").alias("node")))


@query(f"WITH {_GRAPHS}, c AS (SELECT min(src) AS src FROM tr) SELECT tr.dst, round(any_value(tr.w), 6) AS w, string_agg(printf('%.4f', dyn.w), ',' ORDER BY period) AS weights FROM tr JOIN c USING (src) LEFT JOIN dyn ON dyn.src = tr.src AND dyn.dst = tr.dst GROUP BY tr.dst")
def ego_weights(s, d):
    """The first supplier's links with their weights in all periods, in order."""
    z = scaled_panel(s, d)
    edges = panel_edges(s, d, z)
    first = edges.agg(F.min("src")).first()[0]
    got = graph.ego(edges, graph.reweighted(edges, z, COLUMNS, WIDTH, ("period",)), first)
    return rounded(got.select("dst", "w", F.array_join(F.transform("weights", lambda v: F.format_string("%.4f", v)), ",").alias("weights")))


_SDBW = """u AS (SELECT id, label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM p), c AS (SELECT label, i, avg(v) AS m, var_pop(v) AS s FROM u GROUP BY ALL), nv AS (SELECT label, sqrt(sum(s * s)) AS nv FROM c GROUP BY 1),
al AS (SELECT sqrt(sum(s * s)) AS av FROM (SELECT i, var_pop(v) AS s FROM u GROUP BY i)), r AS (SELECT sqrt(sum(nv)) / count(*) AS r, avg(nv) AS mv, count(*) AS k FROM nv),
dn AS (SELECT label, count(*) FILTER (WHERE dist <= (SELECT r FROM r)) AS d FROM (SELECT u.id, u.label, sqrt(sum(pow(v - m, 2))) AS dist FROM u JOIN c ON c.label = u.label AND c.i = u.i GROUP BY ALL) GROUP BY 1),
pr AS (SELECT a.label AS a, b.label AS b, a.i, (a.m + b.m) / 2 AS m FROM c a JOIN c b ON a.i = b.i AND a.label < b.label),
bw AS (SELECT a, b, count(*) FILTER (WHERE dist <= (SELECT r FROM r)) AS d FROM (SELECT pr.a, pr.b, u.id, sqrt(sum(pow(v - m, 2))) AS dist FROM pr JOIN u ON u.i = pr.i AND u.label IN (pr.a, pr.b) GROUP BY ALL) GROUP BY ALL),
bs AS (SELECT sum(CASE WHEN greatest(x.d, y.d) > 0 THEN bw.d / greatest(x.d, y.d) ELSE 0 END) AS s FROM bw JOIN dn x ON x.label = a JOIN dn y ON y.label = b)"""


@query(f"WITH {POINTS}, {_SDBW} SELECT round(mv / av + 2 * s / (k * (k - 1)), 6) AS s_dbw FROM r, al, bs")
def s_dbw(s, d):
    return rounded(quality.s_dbw(points(s, d)))


@query("WITH p AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR) || '|42'), vec_id LIMIT 200), dd AS (SELECT a.id, a.label AS own, b.label AS other, sum(list_distance(a.x, b.x)) / count(*) AS m FROM p a JOIN p b ON a.id <> b.id GROUP BY ALL), f AS (SELECT id, sum(m) FILTER (WHERE own = other) AS a, min(m) FILTER (WHERE own <> other) AS b FROM dd GROUP BY id) SELECT (SELECT count(*) FROM p) AS n, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM f")
def sampled_silhouette(s, d):
    """The silhouette of 200 vectors drawn by a hash."""
    rows = cut(quality.sampled(points(s, d), 200), "sample")
    return quality.silhouette(rows).crossJoin(rows.agg(F.count("*").alias("n"))).select("n", F.round("silhouette", 6).alias("silhouette"))


_JACC = "x AS (SELECT label AS ref, CASE WHEN vec_id % 6 = 0 THEN (label + 1) % 10 ELSE label END AS aligned FROM embeddings), e AS (SELECT ref, aligned, ref AS label FROM x UNION ALL SELECT ref, aligned, aligned FROM x WHERE aligned <> ref), j AS (SELECT label, sum(CAST(ref = aligned AS INT)) / count(*) AS jaccard FROM e GROUP BY 1)"


@query(f"WITH {_JACC} SELECT round(min(jaccard), 6) AS least FROM j")
def aligned_jaccard(s, d):
    """The least overlap of a label with what it is called elsewhere, once names are aligned."""
    from weftline.operators import learning

    p = points(s, d)
    other = F.when(F.col("id") % 6 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = learning.aligned(p.select("id", "label", ((other * 7 + 3) % 10).alias("renamed")), "label", "renamed")
    return rounded(quality.jaccard(rows, "label", "aligned").agg(F.min("jaccard").alias("least")))


@query(f"WITH {_ECON}, m AS (SELECT src AS node, sum(w * level) / sum(w) AS ml FROM eco JOIN nd ON node = dst GROUP BY src) SELECT CAST(count(*) AS BIGINT) AS nodes, round(avg(abs(level - coalesce(ml, level))), 6) AS gap FROM nd LEFT JOIN m USING (node)")
def neighbour_gap(s, d):
    """How far suppliers are from their neighbours' mean level, on average."""
    n = supplier_nodes(s, d)
    near = graph.smoothed(n, graph.reweighted(transport(s, d), n, ["level", "balance"], 1.0), ["level"], 1.0).withColumnRenamed("level", "near")
    return rounded(n.join(near, "node").agg(F.count("*").alias("nodes"), F.avg(F.abs(F.col("level") - F.col("near"))).alias("gap")))
