"""Fitted models against numpy and hand-checked cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import learning


def cloud(spark, seed=3):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(c, s, (60, 2)) for c, s in (((0, 0), 0.3), ((5, 0), 0.5), ((0, 6), 1.0))])
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")


def test_kmeans_and_mixture_find_the_groups(spark):
    x, df = cloud(spark)
    centres, cost = learning.kmeans(df, 3)
    got = {r["id"]: (r["label"], r["margin"]) for r in learning.assigned(df, centres).collect()}
    d = np.sqrt(((x[:, None] - centres) ** 2).sum(2))
    two = np.sort(d, 1)
    assert [got[i][0] for i in range(len(x))] == d.argmin(1).tolist()
    assert [got[i][1] for i in range(len(x))] == pytest.approx(((two[:, 1] - two[:, 0]) / two[:, 1]).tolist())
    assert cost == pytest.approx((two[:, 0] ** 2).sum())
    labels = {r["id"]: r["label"] for r in learning.diagonal_mixture(df, 3, 4).collect()}
    groups = [{labels[i] for i in range(a, a + 60)} for a in (0, 60, 120)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3


def test_alignment_gives_names_back(spark):
    df = spark.createDataFrame(list(zip([1, 1, 2, 2, 3, 3], [8, 8, 5, 5, 9, 9], strict=True)), "a int, b int")
    assert all(r["aligned"] == r["a"] for r in learning.aligned(df, "a", "b").collect())
    more = spark.createDataFrame([(1, 7), (1, 7), (2, 8), (2, 9), (2, 9)], "a int, b int")
    assert {r["b"]: r["aligned"] for r in learning.aligned(more, "a", "b").collect()} == {7: 1, 8: None, 9: 2}


def test_ridge_equals_numpy(spark):
    r = np.random.default_rng(5)
    x = r.normal(3, 2, (90, 3))
    y, fold = x @ [1.0, -2.0, 0.5] + r.normal(0, 0.3, 90), np.arange(90) % 3
    df = spark.createDataFrame([(*a, b, int(f)) for a, b, f in zip(x.tolist(), y.tolist(), fold, strict=True)], "a double, b double, c double, y double, fold int")
    for row in learning.ridge_folds(df, ["a", "b", "c"], "y", "fold", 2.0).collect():
        t, h = fold != row["fold"], fold == row["fold"]
        m, s = x[t].mean(0), x[t].std(0)
        z = (x - m) / s
        w = np.linalg.solve(z[t].T @ z[t] + 2.0 * np.eye(3), z[t].T @ (y[t] - y[t].mean()))
        assert row["mse"] == pytest.approx(((y[h] - y[t].mean() - z[h] @ w) ** 2).mean())
        assert row["mean_mse"] == pytest.approx(((y[h] - y[t].mean()) ** 2).mean())


def events(spark, rows):
    return spark.createDataFrame(rows, "entity long, from_label int, to_label int, at long")


def test_event_matching(spark):
    true = events(spark, [(1, 1, 2, 10)])
    n = lambda rows: learning.match_events(true, events(spark, rows)).count()
    assert n([(1, 1, 2, 12)]) == 1 and n([(1, 1, 2, 13)]) == 0 and n([(1, 2, 1, 10)]) == 0
    who = spark.createDataFrame([(1,), (2,), (3,)], "entity long")
    got = learning.event_scores(true, events(spark, [(1, 1, 2, 10), (1, 1, 2, 11), (2, 1, 2, 5)]), who).first()
    assert (got["matched"], got["false_events"], got["precision"], got["recall"]) == (1, 2, pytest.approx(1 / 3), 1.0)
    assert (got["stable_nodes"], got["false_stable"], got["false_stable_percent"]) == (2, 1, 50.0)
    none = learning.event_scores(true.limit(0), true.limit(0), who.limit(0)).first()
    assert none["precision"] is None and none["recall"] is None and none["false_stable_percent"] is None


def test_draws_keep_entities_and_years_whole(spark):
    df = spark.createDataFrame([(e, f"{y}-{m:02}") for e in range(200) for y in (2023, 2024) for m in (1, 2, 3)], "e long, p string")
    trials = learning.subsample(df, "e", 4).groupBy("trial", "e").agg(F.count("*").alias("n")).collect()
    assert {r["n"] for r in trials} == {6} and len(trials) == 4 * 160
    assert len({r["e"] for r in trials if r["trial"] == 0} ^ {r["e"] for r in trials if r["trial"] == 1}) > 20
    drawn = learning.block_bootstrap(df, "p", 3).groupBy("iteration", F.substring("p", 1, 4).alias("y")).count().collect()
    assert [r["count"] for r in drawn] == [600] * 6


def test_ordered_labels(spark):
    df = spark.createDataFrame([(0, 5.0), (0, 6.0), (1, 1.0), (2, 9.0)], "label int, v double")
    assert {(r["label"], r["v"]) for r in learning.ordered_labels(df, "v").collect()} == {(2, 5.0), (2, 6.0), (1, 1.0), (3, 9.0)}


def test_many_fits_in_the_same_passes(spark):
    x, df = cloud(spark)
    two = df.select("id", "x", F.lit("a").alias("g")).unionByName(df.select("id", F.transform("x", lambda v: v * 10).alias("x"), F.lit("b").alias("g")))
    models = learning.kmeans_many(two, {("a",): 3, ("b",): 2}, ("g",), 5)
    assert len(models[("a",)][0]) == 3 and len(models[("b",)][0]) == 2
    assert models[("a",)][1] == pytest.approx(learning.kmeans(df, 3)[1])
    got = learning.assigned_many(two, models, ("g",)).where("g = 'a'").collect()
    d = np.sqrt(((x[:, None] - models[("a",)][0]) ** 2).sum(2))
    assert all(r["label"] == d[r["id"]].argmin() for r in got)
    one = learning.kmeans_many(df.limit(2), 5, (), 2)[()]
    assert len(one[0]) == 2 and one[1] == 0


def test_density_labels():
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 0.3, (80, 2)), r.normal(5, 0.3, (80, 2)), r.uniform(-20, 25, (12, 2))])
    got = learning.density_labels(x, 20, 5)
    assert {tuple(sorted(set(got[a : a + 80].tolist()) - {-1})) for a in (0, 80)} in ({(0,), (1,)},)
    assert (got[:160] >= 0).mean() > 0.9 and (got[160:] == -1).sum() >= 9
    assert (learning.density_labels(x[:10], 20, 5) == -1).all() and len(learning.density_labels(np.zeros((0, 2)), 5, 2)) == 0
    assert set(learning.density_labels(np.zeros((60, 2)), 20, 5).tolist()) == {-1}


def test_spanning_tree_is_least():
    r = np.random.default_rng(4)
    x = r.normal(size=(30, 3))
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    core = np.sort(d, 1)[:, 3]
    reach = np.maximum(np.maximum(d, core[:, None]), core)
    parent = list(range(30))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    total = 0.0
    for w, a, b in sorted((reach[i, j], i, j) for i in range(30) for j in range(i)):
        if find(a) != find(b):
            parent[find(a)], total = find(b), total + w
    assert learning.core_tree(x, 4)[:, 2].sum() == pytest.approx(total)


def test_one_hot_ridge_equals_numpy(spark):
    r = np.random.default_rng(6)
    n = 120
    x, a, b, fold = r.normal(size=n), r.integers(0, 4, n), r.integers(0, 3, n), np.arange(n) % 4
    y = x + np.array([0, 1, 2, 3.0])[a] + np.array([0, -2.0, 4])[b] + r.normal(0, 0.2, n)
    a[fold == 0] = np.where(a[fold == 0] == 3, 9, a[fold == 0])  # a label that the training rows lack
    df = spark.createDataFrame([(float(x[i]), int(a[i]), int(b[i]), float(y[i]), int(fold[i])) for i in range(n)], "x double, a int, b int, y double, fold int")

    def mse(labels):
        total = 0.0
        for f in range(4):
            t, h = fold != f, fold == f
            z = [(x - x[t].mean()) / x[t].std()]
            for v in labels:
                z += [(v == k).astype(float) for k in sorted(set(v[t].tolist()))]
            z = np.array(z).T
            mean = z[t].mean(0)
            w = np.linalg.solve((z[t] - mean).T @ (z[t] - mean) + np.eye(z.shape[1]), (z[t] - mean).T @ (y[t] - y[t].mean()))
            total += ((y[h] - y[t].mean() - (z[h] - mean) @ w) ** 2).sum()
        return total / n

    got = learning.ridge_gain(df, ["x"], "a", "b", "y", "fold").first()
    assert got["base_mse"] == pytest.approx(mse([a])) and got["mse"] == pytest.approx(mse([a, b]))
    assert got["reduction_percent"] == pytest.approx(100 * (1 - mse([a, b]) / mse([a])))


def test_calibration(spark):
    flat = spark.createDataFrame([(n, n % 3, float(n % 3 * 5 + n % 7 + t % 2), float(n % 3 - n % 5)) for n in range(30) for t in range(4)], "node long, t int, a double, b double")
    mean, effect, noise = learning.calibration(flat, "node", "t", ["a", "b"])
    assert mean.count() == 3 and effect.count() == noise.count() == 4
    # `b` is the same in all of a node's rows, so no noise is left of it
    assert {(r["a"], r["b"]): round(r["cov"], 9) for r in noise.collect()}["b", "b"] == 0


def test_seeds_of_all_points_are_as_good_as_many_starts(spark):
    """A group of 30,000 points in which a cluster of 60 lies far off: no sample of a few thousand is sure to have it in proportion."""
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 8, (7, 4))
    x = np.concatenate([centres[rng.integers(0, 7, 29_940)] + rng.normal(0, 1, (29_940, 4)), rng.normal(0, 1, (60, 4)) + 400])
    _, cost = learning.kmeans_many(spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(6), 8, starts=4)[()]
    best = np.inf
    for _ in range(30):
        c = learning._plus_plus(x, np.ones(len(x)), 8, rng)
        for _ in range(25):
            near = learning._distances_to(x, c).argmin(1)
            c = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(8)])
        best = min(best, learning._distances_to(x, c).min(1).sum())
    assert cost <= 1.01 * best


def test_fewer_points_than_centres(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0])] * 5 + [("b", [float(i), 0.0]) for i in (0, 0, 9, 9)], "g string, x array<double>")
    got = learning.kmeans_many(df, 3, ("g",), starts=2)
    assert len(got["a",][0]) == 1 and got["a",][1] == 0 and sorted(c[0] for c in got["b",][0]) == [0, 9]
    assert learning.kmeans_many(df.where("g = 'c'"), 3, ("g",), starts=2) == {}


def test_drawn_medians_equal_those_of_copied_rows(spark):
    """Nodes that lack months or values, months drawn often or never, and repeated rows."""
    r = random.Random(5)
    rows = [(n, f"{y}-{m:02d}", None if r.random() < 0.1 else r.randint(0, 9) / 3, r.random()) for n in range(6) for y in (2023, 2024) for m in range(1, 13) if r.random() < 0.5 or n == 0]
    rows += rows[:7] + [(9, "2023-05", None, 1.0), (10, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "node int, period string, a double, b double").withColumn("year", F.substring("period", 1, 4)).repartition(5)
    copied = learning.block_bootstrap(df, "period", 20, 3).groupBy("iteration", "node", "year").agg(F.median("a").alias("a"), F.median("b").alias("b"))
    drawn = learning.drawn_medians(df, ["node", "year"], "period", ["a", "b"], learning.block_weights(df, "period", 20, 3))
    key = lambda t: {(x["iteration"], x["node"], x["year"]): (x["a"], x["b"]) for x in t.collect()}
    want, got = key(copied), key(drawn)
    assert got.keys() == want.keys() and len(got) == drawn.count() > 150
    assert all(got[k][i] == pytest.approx(want[k][i]) for k in want for i in (0, 1))
    weights = learning.block_weights(df, "period", 20, 3)
    assert {x[0] for x in weights.groupBy("iteration", F.substring("period", 1, 4)).agg(F.sum("weight").alias("n")).select("n").collect()} == {12}


def test_density_tree_holds_no_matrix():
    """Memory by points, not by pairs: a matrix of these distances has 200 MB. The tree is the least one."""
    import tracemalloc

    x = np.random.default_rng(2).normal(size=(5000, 3))
    tracemalloc.start()
    tree = learning.core_tree(x, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(tree) == 4999 and peak < 100e6
    some = x[:200]
    d = np.sqrt(((some[:, None] - some) ** 2).sum(2))
    core = np.sort(d, 1)[:, 4]
    reach = np.maximum(np.maximum(d, core[:, None]), core)
    inside, total = {0}, 0.0
    while len(inside) < 200:
        out = [i for i in range(200) if i not in inside]
        part = reach[np.ix_(sorted(inside), out)]
        total += part.min()
        inside.add(out[int(part.min(0).argmin())])
    assert learning.core_tree(some, 5)[:, 2].sum() == pytest.approx(total)


def test_rows_of_a_sliced_column():
    import pyarrow as pa

    column = pa.array([[float(i), -float(i)] for i in range(6)])
    assert learning._flat(column.slice(2, 3)).tolist() == [[2, -2], [3, -3], [4, -4]]
    assert learning._flat(column.slice(0, 0)).shape == (0, 1)


def test_points_are_packed_whole_and_by_group(spark):
    """Rounds read a few hundred points a row; before, a row each."""
    rng = np.random.default_rng(3)
    x = {"a": rng.normal(size=(5000, 3)), "b": rng.normal(size=(7, 3)), "c": rng.normal(size=(700, 3))}
    rows = spark.createDataFrame([(g, v.tolist()) for g, vs in x.items() for v in vs], "_g string, x array<double>").repartition(3)
    got = learning.packed(rows).collect()
    assert len(got) < 30 and max(len(r["x"]) for r in got) <= 8 * learning.PACKED
    for g, vs in x.items():
        mine = np.concatenate([np.frombuffer(r["x"]).reshape(-1, 3) for r in got if r["_g"] == g])
        assert sorted(map(tuple, mine)) == sorted(map(tuple, vs))
    wide = spark.createDataFrame([("a", [float(i)] * 3000) for i in range(4)], "_g string, x array<double>")
    assert sum(len(r["x"]) for r in learning.packed(wide).collect()) == 4 * 3000 * 8
    assert learning.packed(rows.where("_g = 'z'")).count() == 0


def test_groups_of_other_lengths_in_one_batch(spark):
    rng = np.random.default_rng(5)
    rows = [(g, (rng.normal(0, 1, p) + 20 * (i % 2)).tolist()) for i in range(40) for g, p in (("a", 3), ("b", 2), ("c", 4))]
    df = spark.createDataFrame(rows, "g string, x array<double>").coalesce(1)
    got = learning.kmeans_many(df, 2, ("g",), starts=2)
    for g, _ in {(g, len(x)) for g, x in rows}:
        x = np.array([v for h, v in rows if h == g])
        want = np.array([x[0::2].mean(0), x[1::2].mean(0)])
        centres = got[g,][0]
        assert np.allclose(centres[centres[:, 0].argsort()], want)


def test_small_groups_are_fitted_alone_as_in_passes(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(g, (rng.normal(0, 1, p) + 3 * rng.integers(0, 4)).tolist()) for g, n, p in (("a", 5000, 3), ("b", 700, 2), ("c", 3, 2)) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, x array<double>").repartition(5).cache()
    jobs, k = [], {("a",): 4, ("b",): 3, ("c",): 5}
    for most in (0, 2000, 10**6):
        monkeypatch.setattr(learning, "ALONE", most)
        spark.sparkContext.setJobGroup(f"alone-{most}", "")
        got = learning.kmeans_many(df, k, ("g",), starts=3, every=True)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"alone-{most}")))
        want = got if most == 0 else want
        assert all(np.allclose(got[g][0], want[g][0], atol=1e-9) and np.allclose(got[g][1], want[g][1]) for g in k)
    assert jobs[2] < 5 < jobs[0]
