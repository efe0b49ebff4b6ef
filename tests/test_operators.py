"""Hand-checkable cases, and every query with SQL against DuckDB at the smallest scale."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.operators import graph, panel, quality, reconcile, sequence, study
from weftline.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, w) for x, y, w in pairs for a, b in ((x, y), (y, x))], "src long, dst long, w double")


def test_network_indices(spark):
    e = edges(spark, [(0, 1, 1.0), (2, 3, 1.0)])
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "node long, label int")
    r = graph.network_indices(e, labels).first()
    assert (r["avi"], r["avu"], r["anui"], r["mq"]) == (1, 0, 1, 2) and r["modularity"] == pytest.approx(0.5)
    assert graph.modularity(e, labels).first()[0] == pytest.approx(0.5)


def test_network_indices_with_weight_between(spark):
    """By hand: labels a = {0, 1}, b = {2, 3}; 0-1 weighs 3, 2-3 weighs 1, 1-2 weighs 1. Inside 6 and 2, outside 1 and 1:
    isolability 6/7 and 2/3, avi 16/21; unifiability 1 / (1 + 1 - 1) both ways, avu 2 / 2 = 1; anui = avi / (1 + avi), and not avi / 2."""
    e = edges(spark, [(0, 1, 3.0), (2, 3, 1.0), (1, 2, 1.0)])
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "node long, label int")
    r = graph.network_indices(e, labels).first()
    assert r["avi"] == pytest.approx(16 / 21) and r["avu"] == pytest.approx(1) and r["mq"] == pytest.approx(32 / 21)
    assert r["anui"] == pytest.approx((16 / 21) / (1 + 16 / 21))
    both = spark.createDataFrame([(p, n, n // 2 if p == 1 else 0) for p in (1, 2) for n in range(4)], "period int, node long, label int")
    per = {x["period"]: x for x in graph.network_indices(e, both, ("period",)).collect()}
    assert per[1]["anui"] == pytest.approx(r["anui"]) and (per[2]["avi"], per[2]["avu"], per[2]["modularity"]) == (1, 0, 0)


def labels_of(spark, *series):
    return spark.createDataFrame([(i, t, v) for i, s in enumerate(series) for t, v in enumerate(s)], "e long, t long, label int")


def test_trailing_runs_and_transitions(spark):
    df = labels_of(spark, [1, 1, 1], [1, 2, 2], [1, 2, 1])
    df = df.withColumn("m", F.lit(0.5))
    assert {r["e"]: r["trailing_run"] for r in sequence.stability(df, "e", "t", "label", "m").collect()} == {0: 3, 1: 2, 2: 1}
    got = sequence.persistent_transitions(labels_of(spark, [1, 1, 1, 2, 2, 2], [1, 1, 2, 2]), "e", "t", "label").collect()
    assert [(r["e"], r["period"], r["from_label"], r["to_label"]) for r in got] == [(0, 3, 1, 2)]
    flows = sequence.endpoint_flows(labels_of(spark, [1, 2, 1], [1, 1, 2]), "e", "t", "label").collect()
    assert [(r["from_label"], r["to_label"], r["n"]) for r in flows] == [(1, 2, 1)]


def test_a_mean_margin_at_a_limit_meets_it(spark):
    """The mean of these is 0.55, of their doubles just below in any order."""
    rows = [(0, t, 1, m) for t, m in enumerate([1 / 3, 2 / 3, 0.5, 0.7])] + [(1, t, 1, m) for t, m in enumerate([1 / 3, 2 / 3, 0.5, 0.69999])]
    got = sequence.stability(spark.createDataFrame(rows, "e long, t long, label int, m double"), "e", "t", "label", "m", (0.6, 0.7), (0.4, 0.55))
    assert {r["e"]: r["class"] for r in got.collect()} == {0: "stable", 1: "borderline"}


def test_stability_needs_share_and_margin(spark):
    """22 of 24 periods and a mean margin of 0.15 make a core type; a share below 0.75 or a margin below 0.10 a borderline one."""
    cases = [(22, 0.1501, "core"), (22, 0.14, "stable"), (21, 0.9, "stable"), (24, 0.09, "borderline"), (18, 0.5, "stable"), (17, 0.5, "borderline"), (23, 0.1001, "stable")]
    rows = [(i, t, 1 if t < n else 2, m) for i, (n, m, _) in enumerate(cases) for t in range(24)]
    got = {r["e"]: r["class"] for r in sequence.stability(spark.createDataFrame(rows, "e long, t long, label int, m double"), "e", "t", "label", "m").collect()}
    assert got == {i: c for i, (_, _, c) in enumerate(cases)}


def test_margin_of_a_new_run(spark):
    rows = [(0, t, 1 if t < 3 else 2, float(t)) for t in range(8)]
    got = sequence.persistent_transitions(spark.createDataFrame(rows, "e long, t long, label int, m double"), "e", "t", "label", 3, "m").collect()
    assert [(r["period"], r["new_run"], r["new_run_margin"]) for r in got] == [(3, 5, 4.0)]


def test_summaries_by_hand(spark):
    df = labels_of(spark, [1, 2, 2], [2, 1, 2], [1, 1, 1])
    m = {(r["t"], r["label"]): (r["n"], r["changed_ids"]) for r in sequence.monthly_summary(df, "e", "t", "label").collect()}
    assert m[1, 2] == (1, [0]) and m[1, 1] == (2, [1]) and m[2, 2] == (2, [1])
    assert {r["t"]: r["changed_share"] for r in sequence.adjacent_changes(df, "e", "t", "label").collect()} == {1: pytest.approx(2 / 3), 2: pytest.approx(1 / 3)}
    assert {(r["e"], r["t"]): r["run_length"] for r in sequence.run_as_of(df, "e", "t", "label").collect()}[0, 2] == 2
    lists = spark.createDataFrame([(1, [10.0] * 12 + [30.0] * 12), (2, []), (3, [1.0, None, 3.0])], "k long, v array<double>")
    assert {(r["k"], r["year"]): r["mean"] for r in sequence.yearly_means(lists, "k", "v").collect()} == {(1, 0): 10, (1, 1): 30, (3, 0): 2}


def test_histogram_has_no_cap(spark):
    df = spark.createDataFrame([(0.0,), (4999.0,), (5000.0,), (10000.0,), (-1.0,), (None,)], "v double")
    assert {r["bin"]: r["n"] for r in panel.histogram(df, "v", 5000).collect()} == {-1: 1, 0: 2, 1: 1, 2: 1}
    assert panel.histogram(df.limit(0), "v", 5000).count() == 0


def test_quotients_of_empty_cells(spark):
    df = spark.createDataFrame([("a", 1)] * 3 + [("b", 2)] * 3, "r string, l int")
    got = {(r["l"], r["r"]): r["lq"] for r in panel.location_quotient(df, "r", "l", 3).collect()}
    assert got == {(1, "a"): 2.0, (1, "b"): 0.0, (2, "b"): 2.0, (2, "a"): 0.0}


def test_floor_percentile_and_split(spark):
    df = spark.createDataFrame([(float(i),) for i in (40, 10, 30, 20)], "v double")
    assert panel.floor_percentile(df, "v", 0.5).first()["value"] == 30 and panel.floor_percentile(df, "v", 0.05).first()["value"] == 10
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1), (3, 2)], "entity long, period int")
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "entity long")
    got = {r["part"]: r["n"] for r in panel.coverage_split(ids, rows, rows.where("entity = 1")).collect()}
    assert got == {"in model": 1, "incomplete series": 2, "complete, not in model": 1}


def test_intervals_at_their_ends(spark):
    v = spark.createDataFrame([(1, "a", 10, 20), (1, "b", 20, None), (2, "c", 10, 20)], "k long, name string, valid_from int, valid_to int")
    f = spark.createDataFrame([(1, 10), (1, 20), (2, 20), (2, 9)], "k long, at int")
    got = lambda closed: sorted((r["k"], r["at"], r["name"]) for r in reconcile.interval_join(f, v, ["k"], "at", closed=closed).collect())
    assert got(False) == [(1, 10, "a"), (1, 20, "b")] and got(True) == [(1, 10, "a"), (1, 20, "a"), (1, 20, "b"), (2, 20, "c")]


def test_similarity_graph_with_ties(spark):
    """Two equal points, one near and one far, one neighbour each: weight 1, no loops, symmetric; a weight that underflows to 0 isn't an edge."""
    p = spark.createDataFrame([(i, 0, [float(a), 0.0]) for i, a in enumerate((0, 0, 1, 10))], "id long, label int, x array<double>")
    w = {(r["src"], r["dst"]): r["w"] for r in graph.similarity_graph(quality.neighbours(p, 1), 1, 1.0).collect()}
    assert w[0, 1] == w[1, 0] == 1 and (0, 3) not in w and w[2, 3] == w[3, 2] > 0 and all(a != b for a, b in w)
    far = {(r["src"], r["dst"]) for r in graph.similarity_graph(quality.neighbours(p, 1), 1, 0.1).collect()}
    assert (2, 3) not in far


def test_smoothing_by_period_decides_isolates_on_the_given_graph(spark):
    nodes = spark.createDataFrame([(t, n, float(n + 10 * t)) for t in (0, 1) for n in range(3)], "period int, node long, x double")
    e = edges(spark, [(0, 1, 1.0)])
    got = {(r["period"], r["node"]): r["x"] for r in graph.smoothed(nodes, e, ["x"], 1.0, ("period",)).collect()}
    assert got == {(0, 0): 1, (0, 1): 0, (0, 2): 2, (1, 0): 11, (1, 1): 10, (1, 2): 12}
    faded = e.withColumn("w", F.lit(0.0)).crossJoin(nodes.select("period").distinct())
    on_itself = {r["x"] for r in graph.smoothed(nodes, faded, ["x"], 1.0, ("period",)).where("period = 1 and node < 2").collect()}
    on_transport = {r["x"] for r in graph.smoothed(nodes, faded, ["x"], 1.0, ("period",), e).where("period = 1 and node < 2").collect()}
    assert on_itself == {10, 11} and on_transport == {0}


def test_components_of_chains(spark):
    chain = [(i, i + 1, 1.0) for i in range(30)] + [(40, 41, 1.0)]
    nodes = spark.createDataFrame([(i,) for i in [*range(31), 40, 41, 50]], "node long")
    got = {r["node"]: r["component"] for r in graph.components(edges(spark, chain), nodes).collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 41: 40, 50: 50}
    r = graph.component_summary(edges(spark, chain), nodes).first()
    assert (r["components"], r["largest"], r["isolated"]) == (3, 31, 1)


def test_blocks_of_pairs_do_not_matter(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 4))
    p = spark.createDataFrame([(i, int(i % 3), v.tolist()) for i, v in enumerate(x)], "id long, label int, x array<double>")
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    lab = np.arange(90) % 3
    own = np.array([d[i][(lab == lab[i]) & (np.arange(90) != i)].mean() for i in range(90)])
    near = np.array([min(d[i][lab == k].mean() for k in range(3) if k != lab[i]) for i in range(90)])
    assert quality.silhouette(p).first()[0] == pytest.approx(((near - own) / np.maximum(near, own)).mean())
    small = quality.pairwise(p, (), lambda a, b: pd.DataFrame({"n": [len(a) * len(b)]}), "n long", rows=20)
    assert small.agg(F.sum("n")).first()[0] == 90 * 90
    alone = spark.createDataFrame([(1, 0, [0.0]), (2, 0, [1.0]), (3, 1, [9.0])], "id long, label int, x array<double>")
    assert quality.silhouette(alone).first()[0] == pytest.approx((8 / 9 + 7 / 8) / 3)


def test_scatter_density_by_hand(spark):
    """Two labels of two points at -1, -0.8 and 0.8, 1: variances 0.01, 0.01 of 0.82; radius sqrt(0.02) / 2; nothing between."""
    p = spark.createDataFrame([(0, 0, [-1.0]), (1, 0, [-0.8]), (2, 1, [0.8]), (3, 1, [1.0])], "id long, label int, x array<double>")
    assert quality.s_dbw(p).first()[0] == pytest.approx(0.01 / 0.82)


def test_smoothing_keeps_isolates(spark):
    nodes = spark.createDataFrame([(0, 1.0), (1, 4.0), (2, 7.0)], "node long, x double")
    got = {r["node"]: r["x"] for r in graph.smoothed(nodes, edges(spark, [(0, 1, 1.0)]), ["x"], 1.0).collect()}
    assert got == {0: 4.0, 1: 1.0, 2: 7.0}


def test_nearest_layer_is_symmetric(spark):
    pairs = spark.createDataFrame([(0, 1, 0.0), (0, 2, 1.0), (1, 2, 1.0), (2, 3, 9.0), (3, 3, 0.0)], "x long, y long, distance double")
    w = {(r["src"], r["dst"]): r["w"] for r in graph.knn_layer(pairs, 1).collect()}
    assert w[0, 1] == w[1, 0] == 1 and (0, 3) not in w and w[2, 3] == w[3, 2] > 0 and all(a != b for a, b in w)


def test_ari_ignores_names(spark):
    df = spark.createDataFrame(list(zip([1, 1, 2, 2, 3, 3], [8, 8, 5, 5, 9, 9], strict=True)), "a int, b int")
    assert quality.ari(df).first()[0] == pytest.approx(1)
    assert quality.ari(spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")).first()[0] == 1


def test_codes_and_statuses(spark):
    df = spark.createDataFrame([("1 512 000",), ("79-701-000-000",), ("1\t512\u00a0000",), ("x",), ("12345678901",), ("1234567890",)], "c string").select(reconcile.code8(F.col("c")).alias("c"))
    assert [r["c"] for r in df.collect()] == ["01512000", "79701000", "01512000", None, "12345678", None]
    lists = spark.createDataFrame([([],), ([0.0],), ([123.0, 123.0],), ([123.0, 456.0],), ([math.nan],), ([math.inf],), ([-1.0],), ([None],)], "v array<double>")
    assert [r[0] for r in lists.select(reconcile.value_status(F.col("v"))).collect()] == ["missing", "ok", "ok", "conflict", *["invalid"] * 4]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_names_decide_candidates(spark):
    a = spark.createDataFrame([(1, 7, ["Орёл-2", "орел 2", "x"]), (2, 7, ["Two Names", "Other"]), (3, 8, ["Орёл 2"]), (4, 7, ["--", None])], "id long, region long, names array<string>")
    b = spark.createDataFrame([(10, 7, ["ОРЕЛ 2", "X"]), (11, 7, ["two-names"]), (12, 7, ["other", "--"])], "other long, region long, names array<string>")
    got = {r["id"]: r["candidates"] for r in reconcile.name_candidates(a, b, "id", "other").collect()}
    assert got == {1: 1, 2: 2, 3: 0, 4: 0}


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert got == sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in found.fetchall())


def test_reaching_a_baseline(spark):
    g = spark.createDataFrame([("base", 5.0, 10), ("a", 4.9, 10), ("b", 4.0, 30), ("c", 9.0, 8), ("d", None, 50), (None, 6.0, 11)], "k string, v double, n int")
    got = panel.reaching(g, F.col("k") == "base", {"v": 0.5, "n": 1})
    assert got.columns == g.columns and {r["k"] for r in got.collect()} == {"a", None}
    assert panel.reaching(g, F.col("k") == "none", {"v": 1.0}).count() == 0
    with pytest.raises(Exception, match="several baselines"):
        panel.reaching(g, F.col("k").isNotNull(), {"v": 1.0}).collect()


def test_unchanged_and_growing(spark):
    rows = [(1, "a", 1, 1.0), (1, "b", 1, 2.0), (2, "a", 1, 2.0), (2, "b", 2, 1.0), (2, "c", 1, 3.0), (3, "a", None, None), (3, "b", 1, 4.0), (4, "a", 1, 1.0)]
    df = spark.createDataFrame(rows, "e int, p string, l int, v double")
    assert tuple(sequence.unchanged_and_growing(df, "e", "p", "l", "v").first()) == (4, 2, 2)
    assert tuple(sequence.unchanged_and_growing(df.limit(0), "e", "p", "l", "v").first()) == (0, 0, 0)


def test_winners_with_ties(spark):
    means = spark.createDataFrame([("x", 1.0, 2.0), ("y", 1.0, 1.0)], "model string, up double, down double")
    assert {tuple(r) for r in study.winners(means, "model", ["up"], ["down"], tie="both").collect()} == {("up", "both"), ("down", "y")}
    assert {tuple(r) for r in study.winners(means, "model", ["up"], ["down"]).collect()} == {("up", "x"), ("down", "y")}


def test_leading_category(spark):
    rows = [(1, "b", 2.0), (1, "a", 2.0), (1, "c", 1.0), (2, "a", None), (2, "b", -5.0), (3, "z", None), (3, "y", None), (None, "q", 0.0)]
    got = panel.leading(spark.createDataFrame(rows, "id long, c string, v double"), ["id"], "c", "v")
    assert {r["id"]: r["c"] for r in got.collect()} == {1: "a", 2: "b", 3: "y", None: "q"}


def test_yearly_agreement_takes_both_sides(spark):
    from weftline.plans import studies

    got = studies.leading_category_agreement(spark, "/root/testdata/sf0.001").collect()
    assert got and all(0 < r["agreement"] < 1 and -1 <= r["ari"] < 1 for r in got)


def test_no_sql_is_without_rows():
    """Queries whose inputs have no row on one side of a condition would show nothing."""
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("needs the driver's tables")
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    assert [n for n, q in catalogue.oracle_sql().items() if con.execute(q).fetchone() is None] == []
