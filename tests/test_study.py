"""Refits go the way of the fit they are compared with: a draw of everything changes nothing. Choices with needs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import graph, quality, study

COLUMNS, SHARES = ["level", "a", "b"], ["a", "b"]


@pytest.fixture(scope="module")
def nodes(spark):
    rng = np.random.default_rng(3)
    kind = rng.integers(0, 3, 60)
    rows = [(p, int(i), *(np.array([[0, 0, 0], [2, 1, -1], [-1, 2, 2]])[kind[i]] * 2 + rng.normal(0, 0.8, 3)).tolist()) for p in ("2001", "2002") for i in range(60)]
    return spark.createDataFrame(rows, "period string, node long, level double, a double, b double").cache()


@pytest.fixture(scope="module")
def layers(spark):
    rng = np.random.default_rng(4)
    pairs = lambda n: spark.createDataFrame([(int(a), int(b), float(rng.uniform(1, 9))) for a, b in rng.integers(0, 50, (n, 2)) if a != b], "x long, y long, distance double")
    return graph.knn_layer(pairs(400), 4).cache(), graph.knn_layer(pairs(150), 2).cache()


def test_a_draw_of_everything_changes_nothing(spark, nodes, layers):
    fit = study.layered_fit(nodes, *layers, COLUMNS, SHARES, 3, starts=4, level="level")
    draws = nodes.crossJoin(spark.createDataFrame([(0,), (1,)], "draw int"))
    refit = study.layered_fit(draws, *layers, COLUMNS, SHARES, 3, ("draw",), starts=4)
    rows = study.aligned_to(refit.select("draw", "period", "id", "label"), fit, "draw")
    assert {r["draw"]: r["ari"] for r in quality.ari(rows, "reference", "aligned", ("draw",)).collect()} == {0: 1.0, 1: 1.0}
    assert {r["agreement"] for r in quality.agreement(rows, "reference", "aligned", ("draw",)).collect()} == {1.0}
    mids = [r[0] for r in fit.join(nodes.withColumnRenamed("node", "id"), ["period", "id"]).groupBy("label").agg(F.median("level").alias("m")).orderBy("label").select("m").collect()]
    assert mids == sorted(mids) and len(mids) == 3


def test_layers_are_normalised_each_by_itself(spark):
    nodes = spark.createDataFrame([("p", i, v) for i, v in enumerate([1.0, 5.0, 9.0, 20.0])], "period string, node long, v double")
    edges = lambda rows: spark.createDataFrame(rows, "src long, dst long, w double")
    first, second = edges([(0, 1, 10.0), (0, 2, 30.0)]), edges([(0, 3, 0.001), (1, 3, 0.5), (2, 3, 0.0)])
    got = {r["node"]: r["v"] for r in graph.two_layers(nodes, first, second, ["v"], 0.25, ("period",)).collect()}
    assert got == {0: pytest.approx(0.75 * 8.0 + 0.25 * 20.0), 1: 20.0, 2: 9.0, 3: 20.0}
    near = {r["node"]: r["v"] for r in study.layered_nodes(nodes, first, second, ["v"], 0.2, 0.25).collect()}
    assert near[0] == pytest.approx(0.8 * 1.0 + 0.2 * 11.0) and near[2] == pytest.approx(9.0)


def test_isolates_are_decided_by_trial(spark):
    nodes = spark.createDataFrame([(t, i, float(i)) for t in (0, 1) for i in range(3)], "trial int, node long, v double")
    edges = spark.createDataFrame([(0, 0, 1, 1.0), (1, 0, 1, 0.0), (1, 2, 1, 0.5)], "trial int, src long, dst long, w double")
    there = spark.createDataFrame([(0, 0, 1, 1.0), (1, 0, 1, 1.0), (1, 2, 1, 1.0)], "trial int, src long, dst long, w double")
    got = {(r["trial"], r["node"]): r["v"] for r in graph.smoothed(nodes, edges, ["v"], 0.5, ("trial",), there).collect()}
    assert got[0, 0] == 0.5 and got[1, 0] == 0.0 and got[0, 2] == 2.0 and got[1, 2] == 1.5


def test_choice_with_needs(spark):
    m = spark.createDataFrame([("a", 0.50, 0.97, 0.2), ("b", 0.60, 0.90, 0.3), ("c", 0.499, 0.96, 0.16), ("d", 0.55, 0.99, 0.1)], "setting string, silhouette double, stability double, least_share double")
    needs = (F.col("stability") >= 0.95) & (F.col("least_share") >= 0.15)
    assert study.select_setting(m, needs=needs).first()["setting"] == "a"
    assert study.select_setting(m, F.desc("setting"), needs=needs, slack=0.001).first()["setting"] == "c"
    assert {r["setting"]: (r["eligible"], r["chosen"]) for r in study.marked(m, "setting", needs=needs).collect()} == {"a": (True, True), "b": (False, False), "c": (True, False), "d": (False, False)}
    with pytest.raises(ValueError, match="needs"):
        study.select_setting(m, needs=F.col("stability") > 1)
    assert {r["chosen"] for r in study.marked(m, "setting", needs=F.col("stability") > 1).collect()} == {False}


def test_pooled_silhouette_is_of_all_points(spark):
    """More points than the sample that it once took; both settings label the same points."""
    rng = np.random.default_rng(9)
    n = 10_400
    x = np.where(np.arange(n) % 2, 3.0, 0.0)[:, None] + rng.normal(0, 1, (n, 2))
    labels = {"a": np.arange(n) % 2, "b": (x[:, 0] > 1).astype(int)}
    rows = [(s, "2001" if i < n // 2 else "2002", i % (n // 2), int(y[i]), x[i].tolist()) for s, y in labels.items() for i in range(n)]
    points = spark.createDataFrame(rows, "setting string, period string, id long, label int, x array<double>").repartition(8).cache()
    graphs = spark.createDataFrame([(s, p, a, b, 1.0) for s in labels for p in ("2001", "2002") for a, b in ((0, 1), (1, 0), (1, 2), (2, 1))], "setting string, period string, src long, dst long, w double")
    got = {r["setting"]: r["silhouette"] for r in study.bundle(points, graphs, ("setting",)).collect()}
    for s, y in labels.items():
        total = 0.0
        for i in range(0, n, 800):
            d = np.sqrt(((x[i : i + 800, None] - x) ** 2).sum(2))
            sums = np.column_stack([d[:, y == c].sum(1) for c in (0, 1)])
            own, m = y[i : i + 800], np.bincount(y)
            a, b = sums[np.arange(len(own)), own] / (m[own] - 1), sums[np.arange(len(own)), 1 - own] / m[1 - own]
            total += ((b - a) / np.maximum(a, b)).sum()
        assert got[s] == pytest.approx(total / n, abs=1e-9)


def test_yearly_studies_share_their_tables(spark):
    """Layers of fewer neighbours come of the same neighbours, found once."""
    from weftline.plans import catalogue, studies

    d = "/root/testdata/sf0.001"
    annual, cells = studies.Annual(spark, d), lambda df: {(r["src"], r["dst"]): round(r["w"], 9) for r in df.select("src", "dst", "w").collect()}
    assert annual.near is annual.near and annual.medians is annual.medians and annual.layers_of((6, 2)) is annual.layers_of((6, 2))
    ids = annual.medians.select("node").distinct()
    for got, want in zip(annual.layers_of((6, 2)), (catalogue.supply_layer(spark, d, 6), catalogue.nation_layer(spark, d, 2)), strict=True):
        assert cells(got) == cells(graph.within(want, ids))


def test_graphs_of_all_settings_smooth_as_each_alone(spark, nodes):
    near = quality.neighbours(study.vectors(nodes, COLUMNS), 6, ("period",)).where("id <> 5 or rank > 2").cache()
    got = {(r["k"], r["h"], r["period"], r["node"]): r for r in graph.smoothed_by_similarity(nodes, near, COLUMNS, 0.2, (1, 3, 6), (0.02, 1.0), ("period",)).collect()}
    for k in (1, 6):
        for h in (0.02, 1.0):
            g = graph.similarity_graph(near, k, h, ("period",)).cache()
            edges = {(r["period"], r["src"]): r["count"] for r in g.groupBy("period", "src").count().collect()}
            for r in graph.smoothed(nodes, g, COLUMNS, 0.2, ("period",)).collect():
                one = got[k, h, r["period"], r["node"]]
                assert one["edges"] == edges.get((r["period"], r["node"]), 0) and all(one[c] == pytest.approx(r[c], abs=1e-9) for c in COLUMNS)
    assert len(got) == 6 * 120
