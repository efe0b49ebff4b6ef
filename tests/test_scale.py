"""Operators that must not gather a group: exact quantiles, interval and box joins by cells, greedy matching in rounds, assignment."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline import linked
from weftline.operators import graph, learning, panel, quality, reconcile
from weftline.operators.quantiles import group_medians, group_quantiles
from weftline.shared import cut, tables

PS = [0.0, 0.1, 0.5, 0.77, 1.0]


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(4)
    groups = {"one": [3.5], "two": [1.0, -2.0], "ties": [2.0] * 500 + [9.0], "wide": (rng.standard_normal(3000) * 10.0 ** rng.integers(-9, 9, 3000)).tolist(), "ints": rng.integers(0, 5, 777).astype(float).tolist(), None: [1.0, 5.0, 6.0], "none": [None, None]}
    rows = [(g, v, -v if v is not None else None) for g, vs in groups.items() for v in vs] + [("ties", None, None)]
    got = {r["g"]: r for r in group_quantiles(spark.createDataFrame(rows, "g string, a double, b double").repartition(5), ["g"], {"a": PS, "b": [0.5]}).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        x = [v for v in vs if v is not None]
        assert got[g]["q_a"] == pytest.approx(np.quantile(x, PS).tolist(), rel=1e-12) if x else got[g]["q_a"] == [None] * len(PS)
        assert got[g]["q_b"] == ([pytest.approx(-np.median(x), rel=1e-12)] if x else [None])


def test_quantiles_of_all_rows_and_none(spark):
    df = spark.createDataFrame([(float(i % 7),) for i in range(100)], "v double")
    assert group_medians(df, [], ["v"]).first()["v"] == np.median([i % 7 for i in range(100)])
    assert group_quantiles(df.where("v > 99"), [], {"v": [0.5]}).first()["q_v"] == [None]
    assert group_quantiles(df.where("v > 99").withColumn("g", F.lit(1)), ["g"], {"v": [0.5]}).count() == 0


def test_a_group_of_a_million_values(spark):
    """What lies between the bounds is a thousandth of the rows, so no task sorts or keeps the group."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % n).cast("double").alias("v"))
    got = group_quantiles(df, ["g"], {"v": PS}).first()["q_v"]
    assert got == pytest.approx(np.quantile(np.arange(n), PS).tolist())
    assert panel.floor_percentile(df, "v", 0.95, ("g",)).first()["value"] == 950_000
    low, high = df.agg(F.percentile_approx("v", F.array(F.lit(0.4995), F.lit(0.5005)), F.lit(10_000)).alias("b")).first()["b"]
    assert low <= 499_999 and high >= 500_000 and high - low < 2000


def held(facts, versions, closed):
    return sorted((k, at, name) for k, at in facts for k2, low, high, name in versions if k == k2 and None not in (k, at, low) and low <= at and (high is None or (at <= high if closed else at < high)))


@pytest.mark.parametrize("closed", [False, True])
def test_interval_join_on_random_versions(spark, closed):
    rng = random.Random(6)
    versions = [(rng.choice([1, 2, None]), low, rng.choice([None, low, low + rng.choice([0, 1, 3, 8, 64, 500, -2])]), i) for i in range(150) for low in [rng.randint(-200, 400)]] + [(1, None, 5, 999)]
    facts = [(rng.choice([1, 2, 3, None]), rng.choice([None, rng.randint(-250, 700)])) for _ in range(200)]
    f, v = spark.createDataFrame(facts, "k int, at int"), spark.createDataFrame(versions, "k int, valid_from int, valid_to int, name int")
    got = reconcile.interval_join(f, v, ["k"], "at", closed=closed)
    assert sorted((r["k"], r["at"], r["name"]) for r in got.collect()) == held(facts, versions, closed)
    assert set(got.columns) == {"k", "at", "valid_from", "valid_to", "name"}


def test_interval_join_of_one_key_meets_in_cells(spark):
    n = 10_000
    v = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 10).alias("valid_from"), (F.col("id") * 10 + 10).alias("valid_to"), F.col("id").alias("name"))
    f = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 10 + 3).alias("at"))
    got = reconcile.interval_join(f, v, ["k"], "at")
    assert got.count() == n and got.where("at <> name * 10 + 3").count() == 0
    assert reconcile.interval_join(f.where("at < 0"), v, ["k"], "at").count() == 0
    # versions of length 10 are put into cells of 64: no fact meets more than the versions of one cell
    width = 8 ** int(np.ceil(np.log(10) / np.log(8)))
    cells = v.select(F.explode(F.sequence(F.floor(F.col("valid_from") / width), F.floor(F.col("valid_to") / width))).alias("c")).groupBy("c").count()
    assert cells.agg(F.max("count")).first()[0] <= 9


def test_box_join_on_random_boxes(spark):
    rng = random.Random(9)
    some = lambda n: [(i, x := rng.uniform(-50, 50), x + rng.choice([0, 0.5, 3, 40, -1]), y := rng.uniform(-50, 50), y + rng.choice([0, 1, 2, 60])) for i in range(n)]
    a, b = some(200), [*some(200), (900, None, 1.0, 0.0, 1.0), (901, -1000.0, 1000.0, -1000.0, 1000.0)]
    a.append((902, a[0][1], a[0][1], a[0][3], a[0][3]))
    df = lambda rows: spark.createDataFrame(rows, "id int, x0 double, x1 double, y0 double, y1 double")
    ok = lambda r: None not in r and r[2] >= r[1] and r[4] >= r[3]
    want = sorted((p[0], q[0]) for p in a for q in b if ok(p) and ok(q) and p[1] <= q[2] and q[1] <= p[2] and p[3] <= q[4] and q[3] <= p[4])
    for width in (1.0, 7.5):
        got = reconcile.box_join(df(a), df(b), width)
        assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 300
    assert reconcile.box_join(df(a), df([]), 1.0).count() == 0


def one_by_one(true, found, tolerance):
    edges = sorted({(abs(t - f), t, f, k) for k, t in true for k2, f in found if k == k2 and abs(t - f) <= tolerance})
    left, right, out = set(), set(), []
    for _, t, f, k in edges:
        if (k, t) not in left and (k, f) not in right:
            left.add((k, t))
            right.add((k, f))
            out.append((k, t, f))
    return sorted(out)


def test_matching_in_rounds_equals_one_by_one(spark):
    rng = random.Random(2)
    true = [(rng.randint(0, 30), rng.randint(0, 24)) for _ in range(300)]
    found = [(rng.randint(0, 32), rng.randint(0, 24)) for _ in range(300)] + [(50, i) for i in range(1, 20, 2)]
    true += [(50, i) for i in range(0, 20, 2)]  # a chain in which each waits for the one before
    rows = lambda x: spark.createDataFrame([(k, "a", "b", at) for k, at in x], "entity int, from_label string, to_label string, at int")
    got = learning.match_events(rows(true), rows(found))
    assert sorted((r["entity"], r["at"], r["found_at"]) for r in got.collect()) == one_by_one(true, found, 2)
    assert all(r["shift"] == r["found_at"] - r["at"] for r in got.collect())
    assert learning.match_events(rows([]), rows(found)).count() == 0


def test_shifts_duplicates_and_reversed_directions(spark):
    rows = lambda x: spark.createDataFrame(x, "entity int, from_label int, to_label int, at int")
    true = rows([(1, 1, 2, 10), (2, 1, 2, 10), (3, 1, 2, 10), (4, 1, 2, 10)])
    found = rows([(1, 1, 2, 12), (2, 1, 2, 13), (3, 1, 2, 9), (3, 1, 2, 11), (4, 2, 1, 10), (5, 1, 2, 3)])
    r = learning.event_scores(true, found, spark.createDataFrame([(i,) for i in range(1, 8)], "entity int")).first()
    assert (r["true_events"], r["found_events"], r["matched"], r["false_events"], r["stable_nodes"], r["false_stable"]) == (4, 6, 2, 4, 3, 1)
    assert [(x["entity"], x["found_at"]) for x in learning.match_events(true, found).orderBy("entity").collect()] == [(1, 12), (3, 9)]


def test_assignment_equals_brute_force():
    rng = np.random.default_rng(3)
    for rows, cols in ((1, 1), (2, 5), (4, 4), (5, 7), (7, 7)):
        for _ in range(15):
            gain = rng.integers(0, 9, (rows, cols)).astype(float)
            got = learning.assignment(gain)
            assert len(set(got)) == rows and min(got) >= 0
            assert gain[range(rows), got].sum() == max(gain[range(rows), p].sum() for p in itertools.permutations(range(cols), rows))


def test_two_hundred_labels():
    rng = np.random.default_rng(1)
    names = rng.permutation(200)
    table = {(f"r{names[j]}", j): 50 for j in range(200)} | {(f"r{rng.integers(200)}", int(rng.integers(200))): int(rng.integers(1, 20)) for _ in range(2000)}
    table |= {(f"r{names[j]}", j): 50 for j in range(200)}
    start = time.time()
    assert learning.best_names(table) == {j: f"r{names[j]}" for j in range(200)}
    assert time.time() - start < 20
    assert learning.best_names({("a", 1): 5, ("a", 2): 7, ("a", 3): 1}) == {2: "a"} and learning.best_names({}) == {}


def plain_neighbours(rows, k, metric, other):
    out = {}
    for b in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == b]
        x = np.array([r[2] for r in mine])
        if metric == "cosine":
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            d = 1 - x @ x.T
        else:
            d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
        ids, kind = np.array([r[1] for r in mine]), np.array([r[3] for r in mine])
        for i in range(len(mine)):
            order = np.lexsort((ids, np.round(d[i], 9), kind == kind[i] if other else kind * 0))
            out[b, ids[i]] = ids[order[ids[order] != ids[i]][:k]].tolist()
    return out


@pytest.fixture(scope="module")
def clustered():
    """A block of 3000 points in 60 clusters, with repeated points and null vectors, and a small block."""
    rng = np.random.default_rng(12)
    centres = rng.normal(0, 40, (60, 6))
    x = centres[rng.integers(0, 60, 3000)] + rng.normal(0, 0.5, (3000, 6))
    x[:5], x[5:9] = x[5], 0
    big = [(0, int(i), x[i].tolist(), int(rng.integers(3))) for i in rng.permutation(3000)]
    return big + [(1, i, rng.normal(0, 1, 6).tolist(), i % 2) for i in range(40)] + [(2, 7, [1.0] * 6, 0)]


@pytest.mark.parametrize(("metric", "other"), [("euclidean", None), ("euclidean", "kind"), ("cosine", None)])
def test_neighbours_by_pivots(spark, clustered, metric, other):
    df = spark.createDataFrame(clustered, "label int, id long, x array<double>, kind int").repartition(6)
    got = {}
    for r in quality.neighbours(df, 4, metric=metric, other_first=other, rows=200).orderBy("rank").collect():
        got.setdefault((r["label"], r["id"]), []).append(r["peer"])
    want = plain_neighbours(clustered, 4, metric, other)
    assert got == {key: v for key, v in want.items() if v}


def test_pivots_skip_most_pairs(spark, clustered):
    df = spark.createDataFrame(clustered, "label int, id long, x array<double>, kind int").where("label = 0").withColumn("_g", F.lit("0"))
    pivots = quality._pivots(df, 200, "euclidean")
    placed, shape = quality._with_cells(df, pivots, 200, "euclidean")
    sizes = placed.groupBy("_cell", "_sub").agg(F.count("*").alias("n"))
    inside = sizes.agg(F.sum(F.col("n") * F.col("n"))).first()[0]
    # with the reach of the fourth nearest of clusters this wide
    going = quality._visits(placed.withColumn("reach", F.lit(2.0)), pivots, shape, "euclidean")
    beyond = going.join(sizes.withColumnsRenamed({"_cell": "_to_cell", "_sub": "_to_sub"}), ["_to_cell", "_to_sub"]).agg(F.sum("n")).first()[0] or 0
    assert len(pivots["0"]) > 5 and inside + beyond < 0.1 * 3000 * 3000


@pytest.mark.parametrize("step", [1, 7])
def test_nearest_by_shared_equals_all_pairs(spark, step, monkeypatch):
    """Many ties, one set that all are in, one node in all sets, and several blocks."""
    rng = random.Random(step)
    members = [(step * rng.randrange(40), rng.randrange(60)) for _ in range(500)] + [(step * i, 99) for i in range(40)] + [(step * 3, p) for p in range(60)] + [(5, None), (None, 5)]
    rows = spark.createDataFrame(members, "x long, p int")
    sp = rows.distinct()
    pairs = sp.join(sp.select(F.col("x").alias("y"), "p"), "p").where("x < y").groupBy("x", "y").agg((1.0 / F.count("*")).alias("distance"))
    monkeypatch.setattr(graph, "PAIRS", 900)
    got = cut(graph.nearest_by_shared(rows, 5), "near")
    assert {(r["src"], r["dst"]): r["w"] for r in graph.scaled_layer(got).collect()} == pytest.approx({(r["src"], r["dst"]): r["w"] for r in graph.knn_layer(pairs, 5).collect()})
    assert {r["others"] for r in got.collect()} == {39} and got.count() == 200
    assert graph.nearest_by_shared(rows.where("p is null"), 5).count() == 0


@pytest.mark.parametrize("spread", [3, 40, 1000])
def test_nearest_by_value_equals_all_pairs(spark, spread):
    """From many equal values to none; groups of fewer than k."""
    rng = random.Random(spread)
    rows = [(t, i, rng.choice([1, 1, 1, 2, 3]), rng.randrange(spread) / 4) for t in (0, 1) for i in rng.sample(range(90), 60)] + [(0, 200, 9, 1.0), (0, 201, None, 1.0), (0, 202, 1, None)]
    df = spark.createDataFrame(rows, "t int, x long, g int, v double")
    good = df.dropna()
    pairs = good.join(good.select("t", F.col("x").alias("y"), "g", F.col("v").alias("u")), ["t", "g"]).where("x <> y").select("t", "x", "y", F.abs(F.col("v") - F.col("u")).alias("distance"))
    got = graph.nearest_by_value(df, 4, ("t",))
    assert {(r["t"], r["src"], r["dst"]): r["w"] for r in graph.scaled_layer(got, ("t",)).collect()} == pytest.approx({(r["t"], r["src"], r["dst"]): r["w"] for r in graph.knn_layer(pairs, 4, ("t",)).collect()})


def test_neighbours_in_many_small_parts(spark, monkeypatch):
    """Points on their way to other cells go a few rows at a time, and none is lost."""
    x = np.random.default_rng(8).normal(size=(300, 12))
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "id long, label int, x array<double>").repartition(3)
    monkeypatch.setattr(quality, "CELL", 10)
    monkeypatch.setattr(quality, "VISITS", 7)
    got = {(r["id"], r["rank"]): r["peer"] for r in quality.neighbours(df, 4, rows=60).collect()}
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert got == {(i, k + 1): int(j) for i in range(300) for k, j in enumerate(np.argsort(d[i])[:4])}


def audited(spark, rows, kinds):
    """What panel.pair_audit() says of the pairs written out, and its row by name."""
    got = panel.pair_audit(spark.createDataFrame(rows, kinds).withColumn("layer", F.lit(1)), "layer").drop("layer").collect()
    return [r.asDict() for r in got]


def test_layers_are_audited_as_their_written_pairs(spark):
    rng = random.Random(12)
    members = [(rng.choice([*range(1, 25), None]), rng.choice([*range(30), None])) for _ in range(200)]
    sets = {}
    for x, p in members:
        if None not in (x, p):
            sets.setdefault(x, set()).add(p)
    pairs = [(x, y, 1.0 / len(sets[x] & sets[y])) for x in sets for y in sets if x < y and sets[x] & sets[y]]
    assert [r.asDict() for r in graph.audit_by_shared(spark.createDataFrame(members, "x long, p long")).collect()] == audited(spark, pairs, "x long, y long, distance double")
    assert graph.audit_by_shared(spark.createDataFrame([(1, 1), (2, 2)], "x long, p long")).count() == 0
    usual = [(x, x % 3, round(rng.uniform(-5, 5), 1)) for x in range(40)]
    odd = [(40, 0, None), (41, 0, float("nan")), (42, 1, float("inf")), (42, 1, 2.0), (3, 1, 2.0), (3, 0, usual[3][2]), (None, 0, 1.0), (43, None, 1.0), (44, 9, 1.0), (45, 8, 1.0), (45, 8, 2.0)]
    for values in (usual, usual + odd, [(1, 1, None), (2, 1, None), (3, 1, 5.0)]):
        there = [v for v in values if None not in v[:2]]
        pairs = [(x, y, None if None in (v, w) else abs(v - w)) for x, g, v in there for y, h, w in there if g == h and x != y]
        got = [r.asDict() for r in graph.audit_by_value(spark.createDataFrame(values, "x long, g int, v double")).collect()]
        # NaN equals nothing, itself included
        assert repr([sorted(r.items()) for r in got]) == repr([sorted(r.items()) for r in audited(spark, pairs, "x long, y long, distance double")])


def test_blocks_are_runs_of_ids_of_bounded_weight(spark, monkeypatch):
    """Ids were dealt by remainders, so a list went to a block for nearly each of its nodes."""
    monkeypatch.setattr(graph, "RANGE", 30)
    rng = np.random.default_rng(3)
    ids, w = np.sort(rng.choice(10**12, 500, replace=False)) - 5 * 10**11, rng.integers(1, 60, 500)
    w[77] = 5000
    rows = spark.createDataFrame([(int(i), int(v)) for i, v in zip(ids, w, strict=True)], "x long, w long").repartition(7)
    starts = graph._starts(rows, 400)
    assert starts[0] == ids[0] and (np.diff(starts) > 0).all() and set(starts) <= set(ids)
    block = np.searchsorted(starts, ids, "right") - 1
    sums = np.bincount(block, w)
    assert np.delete(sums, block[77]).max() < 400 + 60 and sums[block[77]] < 5000 + 400
    assert len(starts) <= w.sum() // 400 + 1
    assert len(graph._starts(rows.where("w < 0"), 400)) == 0


def test_smoothing_over_new_weights_moves_the_edges_once(spark):
    """They were moved for the weights, their sums, the far ends and the means."""
    rng = np.random.default_rng(6)
    nodes = spark.createDataFrame([(t, i, *rng.normal(size=2).tolist()) for t in "ab" for i in range(40) if (t, i) != ("b", 3)] + [(t, 40, 1e9, 2.0) for t in "ab"], "period string, node long, u double, v double")
    edges = spark.createDataFrame([(int(a), int(b), 0.0 if a == 7 else float(rng.random())) for a, b in {tuple(p) for p in rng.integers(0, 38, (150, 2)).tolist()}] + [(40, 1, 1.0), (38, 39, -1.0), (2, 99, 1.0)], "src long, dst long, w double")
    nodes, edges = cut(nodes, "nodes"), cut(edges, "edges")
    got = graph.resmoothed(nodes, edges, ["u"], ["u", "v"], 0.3, 0.8, ("period",))
    want = graph.smoothed(nodes, graph.reweighted(edges, nodes, ["u", "v"], 0.8, ("period",)), ["u"], 0.3, ("period",), edges)
    read = lambda df: {(r["period"], r["node"]): r["u"] for r in df.collect()}
    assert read(got) == pytest.approx(read(want)) and len(read(got)) == 81
    assert read(got)["a", 40] == pytest.approx(0.7e9)  # all its weights are 0 now, so its mean is


def test_an_audit_of_a_large_group_writes_no_pairs(spark):
    """The pairs are four hundred million rows."""
    n = 20_000
    got = graph.audit_by_value(spark.range(n).select(F.col("id").alias("x"), F.lit(1).alias("g"), F.col("id").cast("double").alias("v"))).first()
    assert (got["n_rows"], got["pairs"], got["zero"], got["low"], got["high"], got["nodes"]) == (n * (n - 1), n * (n - 1) // 2, 0, 1.0, n - 1.0, n)


def test_silhouettes_of_several_labellings_share_their_distances(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 3))
    x[7] = x[8]
    labels = {"two": np.arange(60) % 2, "alone": np.minimum(np.arange(60), 1), "one": np.zeros(60, int), "some": np.arange(60) // 25}
    rows = [(o, p, i, int(v[i]), x[i].tolist()) for o, v in labels.items() for p in ("a", "b") for i in range(60) if (o, p) != ("some", "b") and (p == "a" or i % 3) and (o != "some" or i > 4)]
    p = spark.createDataFrame(rows, "setting string, period string, id long, label int, x array<double>")
    read = lambda df: {(r["setting"], r["period"]): r["silhouette"] for r in df.collect()}
    want = read(quality.silhouette(p, ("setting", "period")))
    for size in (4000, 17):
        assert read(quality.silhouettes(p, "setting", ("period",), size)) == pytest.approx(want)


@pytest.mark.parametrize("held", [60, 400, 4_000_000])
def test_silhouettes_go_through_long_chunks_in_few_blocks(spark, monkeypatch, held):
    """Points were sent once for each 1500 of their group; now once for each block, of what a task can hold."""
    monkeypatch.setattr(quality, "HELD", held)
    monkeypatch.setattr(quality, "SENT", 7)
    rng = np.random.default_rng(11)
    x, label = rng.normal(size=(90, 3)), rng.integers(0, 4, 90)
    x[5], label[9] = x[6], 7
    d, names = np.sqrt(((x[:, None] - x) ** 2).sum(2)), np.unique(label)
    mean = np.column_stack([d[:, label == k].sum(1) / np.maximum((label == k).sum() - (label == k), 1) for k in names])
    own = label[:, None] == names
    a, b = mean[own], np.where(own, np.inf, mean).min(1)
    want = np.where((label[:, None] == label).sum(1) > 1, (b - a) / np.maximum(a, b), 0).mean()
    rows = [(p, i, int(label[i]), x[i].tolist()) for p in ("a", "b") for i in range(90)]
    got = quality.silhouette(spark.createDataFrame(rows, "period string, id long, label int, x array<double>"), ("period",)).collect()
    assert {r["period"]: pytest.approx(r["silhouette"]) for r in got} == {"a": want, "b": want}


@pytest.mark.parametrize("most", [200_000, 40])
def test_components_of_contracted_links(spark, most):
    """The rounds are few also where names go up along a chain; 40 links in one task, the others contracted before."""
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(100)] + [(rng.randint(2000, 2200),) * 2 for _ in range(9)] + [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(80)]
    root = {x: x for pair in links for x in pair}

    def top(x):
        return x if root[x] == x else top(root[x])

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    want = {x: top(x) for x in root if any(x in p and p[0] != p[1] for p in links)}
    got = linked.components(spark.createDataFrame(links + links[:50], "a long, b long"), most).collect()
    assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want
    assert linked.components(spark.createDataFrame([(1, 1)], "a long, b long"), most).count() == 0


def test_few_links_make_few_stages(spark):
    """A chain of 2000 took a table of stars a round; within the bound it is one task."""
    made = len(tables())
    chain = spark.createDataFrame([(i, i + 1) for i in range(2000)], "a long, b long")
    assert {r["component"] for r in linked.components(chain).collect()} == {0} and len(tables()) - made <= 2
