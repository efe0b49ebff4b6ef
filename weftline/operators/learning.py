"""Fitted models: k-means, diagonal mixtures, density clusters, ridge with folds, label alignment, draws and event scoring.

What grows with the input is aggregated on the executors. The driver holds parameters only: centres,
variances, a normal matrix of one row per feature, or a contingency table of one row per pair of labels.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import quality
from weftline.operators.quantiles import group_medians
from weftline.shared import cut


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy())


def _flat(column: pa.Array) -> np.ndarray:
    """A matrix of a column of arrays of one length, without a Python object a row."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _plus_plus(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centres of the rows of x, each drawn by its weight times the squared distance to the nearest one before."""
    centres = [x[rng.choice(len(x), p=w / w.sum())]]
    while len(centres) < k:
        d = w * np.min([((x - c) ** 2).sum(1) for c in centres], 0)
        centres.append(x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))])
    return np.array(centres)


def _reduced(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centres of weighted candidates: the cheapest of a few weighted fits."""
    best = None
    for _ in range(5):
        c = _plus_plus(x, w, k, rng)
        for _ in range(10):
            near = ((x[:, None] - c) ** 2).sum(2).argmin(1)
            c = np.array([np.average(x[near == i], 0, w[near == i]) if (near == i).any() else c[i] for i in range(k)])
        cost = (w * ((x[:, None] - c) ** 2).sum(2).min(1)).sum()
        if best is None or cost < best[0]:
            best = cost, c
    return best[1]


def _distances_to(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def _luck(h: np.ndarray, start: int, turn: int) -> np.ndarray:
    """A number from 0 to 1 for each hash, another for each start and round."""
    z = h.astype(np.int64).view(np.uint64) + np.uint64((start * 1009 + turn + 1) * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 + 1e-18


def seeded(rows: DataFrame, k, starts: int, seed: int, turns: int = 3, own_seeds: bool = False) -> tuple[dict, dict]:
    """({group: centres to begin with, of every start}, {group: mean variance}) of rows (_g, x, _h), by k-means|| on all points.

    A round draws about twice as many distinct points as there are centres, for every group and start
    in one pass, by their squared distance to what has been drawn: a point's key is exponential at that rate, so
    the least keys are the draw, and no total is needed before. Each task sends no more than the draw.
    Candidates are weighted by the points next to them and reduced to the centres on the driver.
    """
    drawn: dict = {}
    for turn in range(turns):

        def draw(batches, now={g: [np.array(c, float) for c in cs] for g, cs in drawn.items()}, turn=turn):  # noqa: B006  what this round's tasks work with
            for batch in batches:
                for g, part in batch.groupby("_g"):
                    x, h, most = _stack(part["x"]).astype(float), part["_h"].to_numpy(), 2 * k(g)
                    for i in range(starts):
                        far = _distances_to(x, now[g][i]).min(1) if now else np.ones(len(x))
                        with np.errstate(divide="ignore"):
                            key = np.where(far > 1e-12, -np.log(_luck(h, i, turn)) / far, np.inf)
                        _, at = np.unique(key, return_index=True)  # equal points have equal keys: one of them
                        at = [j for j in at[:most] if np.isfinite(key[j])]
                        if at:
                            yield pd.DataFrame({"_g": g, "start": i, "key": key[at], "x": [x[j].tolist() for j in at]})

        got = rows.mapInPandas(draw, "_g string, start int, key double, x array<double>")
        got = got.groupBy("_g", "start", "key").agg(F.first("x").alias("x")).withColumn("n", F.row_number().over(Window.partitionBy("_g", "start").orderBy("key")))
        for r in got.orderBy("_g", "start", "n").collect():
            if r["n"] <= 2 * k(r["_g"]):
                drawn.setdefault(r["_g"], [[] for _ in range(starts)])[r["start"]].append(r["x"])
    if not drawn:
        return {}, {}

    drawn = {g: [np.array(c, float) for c in cs] for g, cs in drawn.items()}

    def weigh(batches, now=drawn):
        for batch in batches:
            for g, part in batch.groupby("_g"):
                x = _stack(part["x"]).astype(float)
                for i, c in enumerate(now[g]):
                    n = np.bincount(_distances_to(x, c).argmin(1), minlength=len(c))
                    yield pd.DataFrame({"_g": g, "start": i, "at": np.arange(len(n)), "v": n.astype(float)})
                moments = np.concatenate((x.sum(0), (x * x).sum(0)))
                yield pd.DataFrame({"_g": g, "start": -1, "at": np.arange(len(moments)), "v": moments})

    weights: dict = {g: {} for g in drawn}
    for r in rows.mapInPandas(weigh, "_g string, start int, at int, v double").groupBy("_g", "start", "at").agg(F.sum("v").alias("v")).collect():
        weights[r["_g"]].setdefault(r["start"], {})[r["at"]] = r["v"]
    begin, spread = {}, {}
    for g, cs in drawn.items():
        filled = [np.array([weights[g].get(i, {}).get(j, 0.0) for j in range(len(c))]) for i, c in enumerate(cs)]
        size = min(k(g), min(len(c) for c in cs))
        rngs = [np.random.default_rng([seed, i, *([zlib.crc32(g.encode())] if own_seeds else [])]) for i in range(starts)]
        begin[g] = np.stack([_reduced(c, np.maximum(w, 1e-9), size, rng) for c, w, rng in zip(cs, filled, rngs, strict=True)])
        n, p = filled[0].sum(), cs[0].shape[1]
        m = np.array([weights[g][-1][j] for j in range(2 * p)]) / n
        spread[g] = float(np.mean(np.maximum(m[p:] - m[:p] ** 2, 0)))
    return begin, spread


#: Numbers in a row of packed(), about: an Arrow batch is 10,000 rows, so at most 160 MB.
PACKED = 2048


def packed(rows: DataFrame) -> DataFrame:
    """(_g, x) rows of a point each, x an array, as rows of a few hundred points of a group, x their numbers as bytes: what reads the points once a round makes no array of each."""

    def pack(batches):
        held: dict = {}

        def full(g, least):
            x = np.concatenate(held[g])
            many = max(1, PACKED // x.shape[1])
            end = len(x) // many * many if least else len(x)
            held[g] = [x[end:]] if end < len(x) else []
            return pa.RecordBatch.from_pydict({"_g": pa.array([g] * -(-end // many), pa.string()), "x": pa.array([x[at : min(at + many, end)].tobytes() for at in range(0, end, many)], pa.binary())})

        for batch in batches:
            names = batch.column(0).dictionary_encode()
            codes = names.indices.to_numpy()
            for code, g in enumerate(names.dictionary.to_pylist()):
                # points of one group are as long as each other, those of a batch need not be
                held.setdefault(g, []).append(_flat(batch.column(1).filter(pa.array(codes == code))))
                if sum(v.size for v in held[g]) >= PACKED:
                    yield full(g, True)
        for g in [g for g, v in held.items() if sum(map(len, v))]:
            yield full(g, False)

    return rows.mapInArrow(pack, "_g string, x binary")


#: Numbers of a group's points up to which one task fits it; rows that it goes through at a time.
ALONE, STEP = 4_000_000, 2048


def _fit_alone(x: np.ndarray, h: np.ndarray, k: int, starts: int, rounds: int, seeds, tolerance: float, turns: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(centres, cost) of every start, as seeded() and the rounds of kmeans_many() give them, of points held by one task."""
    order = np.argsort(h, kind="stable")
    x, h = x[order], h[order]
    drawn: list = [[] for _ in range(starts)]
    for turn in range(turns):
        for i, own in enumerate(drawn):
            far = _distances_to(x, np.array(own)).min(1) if turn else np.ones(len(x))
            with np.errstate(divide="ignore"):
                key = np.where(far > 1e-12, -np.log(_luck(h, i, turn)) / far, np.inf)
            _, at = np.unique(key, return_index=True)
            own += [x[j] for j in at[: 2 * k] if np.isfinite(key[j])]
    drawn = [np.array(c) for c in drawn]
    size = min(k, min(len(c) for c in drawn))
    filled = [np.bincount(_distances_to(x, c).argmin(1), minlength=len(c)).astype(float) for c in drawn]
    centres = np.stack([_reduced(c, np.maximum(w, 1e-9), size, np.random.default_rng(s)) for c, w, s in zip(drawn, filled, seeds, strict=True)])
    limit = tolerance * float(np.mean(np.maximum((x * x).mean(0) - x.mean(0) ** 2, 0)))
    cost, live = np.zeros(starts), np.arange(starts)
    p, sq = x.shape[1], (x * x).sum(1)
    for turn in range(rounds):
        c = centres[live]
        flat, norm = c.reshape(-1, p).T, (c * c).sum(2).ravel()
        sums, n, near = np.zeros((flat.shape[1], p)), np.zeros(flat.shape[1]), np.zeros(len(live))
        for at in range(0, len(x), STEP):
            part = x[at : at + STEP]
            d = (norm - 2 * part @ flat).reshape(len(part), len(live), size)
            label = d.argmin(2)
            hot = np.zeros((len(part), flat.shape[1]))
            np.put_along_axis(hot.reshape(d.shape), label[:, :, None], 1, 2)
            near += np.maximum(np.take_along_axis(d, label[:, :, None], 2)[:, :, 0] + sq[at : at + STEP, None], 0).sum(0)
            n += hot.sum(0)
            sums += hot.T @ part
        cost[live] = near
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c.reshape(-1, p)).reshape(c.shape)
        moved = ((new - c) ** 2).sum(2).max(1)
        if moved.max() <= limit or turn == rounds - 1:
            break
        centres[live] = new
        # a start that stands still stays as it is
        live = live[moved > 0]
    return centres, cost


def kmeans_many(points: DataFrame, k: int | dict, by: tuple[str, ...] = (), starts: int = 10, rounds: int = 300, seed: int = 42, tolerance: float = 1e-4, column: str = "x", every: bool = False, own_seeds: bool = False) -> dict:
    """{values of by: (centres, cost)}: the cheapest of several starts for each value of `by`, all fitted in the same passes.

    A pass is one aggregate over the points: a task sums the members of every centre of every start,
    so what meets on the driver is starts * k * (p + 2) numbers a group, however many points there
    are. Centres begin by k-means++ on at most `sample` points of a group, taken by a hash. A group
    is done when no centre of it moves by more than `tolerance` of the variance. `k` may differ by
    group, as a dict by the values of `by`. With `every`, the centres of all starts and their costs.
    Groups of the same points begin alike, and so end alike, but with `own_seeds`.
    """
    group = F.to_json(F.struct(*by) if by else F.struct(F.lit(0).alias("g")))
    rows = points.select(*by, F.col(column).alias("x"), group.alias("_g"), F.xxhash64(column, F.lit(seed), *([group] if own_seeds else [])).alias("_h"))
    groups = rows.groupBy("_g", *by).agg(F.sum(F.size("x")).alias("_numbers")).collect()
    values = {r["_g"]: tuple(r[c] for c in by) for r in groups}
    sizes = {g: k[v] if isinstance(k, dict) else k for g, v in values.items()}
    few = {r["_g"] for r in groups if r["_numbers"] <= ALONE}
    done = {}
    if few:
        own = lambda g, i: [seed, i, *([zlib.crc32(g.encode())] if own_seeds else [])]

        def fit(part: pa.Table) -> pa.Table:
            g = part["_g"][0].as_py()
            x, h = _flat(part["x"].combine_chunks()), part["_h"].to_numpy()
            centres, cost = _fit_alone(x, h, sizes[g], starts, rounds, [own(g, i) for i in range(starts)], tolerance)
            return pa.table({"_g": [g], "c": [centres.tobytes()], "cost": [cost.tobytes()], "p": pa.array([x.shape[1]], pa.int32())})

        # more partitions than groups, so that few share one
        small = rows.select("_g", "x", "_h").where(F.col("_g").isin(list(few))) if len(few) < len(groups) else rows.select("_g", "x", "_h")
        small = small.repartition(min(512, 4 * len(few)), "_g")
        for r in small.groupBy("_g").applyInArrow(fit, "_g string, c binary, cost binary, p int").collect():
            centres, cost = np.frombuffer(r["c"]).reshape(starts, -1, r["p"]), np.frombuffer(r["cost"])
            best = int(cost.argmin())
            done[values[r["_g"]]] = (centres, cost) if every else (centres[best], float(cost[best]))
        if len(few) == len(groups):
            return done
        rows = rows.where(~F.col("_g").isin(list(few)))
    begin, spread = seeded(rows.select("_g", "x", "_h"), sizes.__getitem__, starts, seed, own_seeds=own_seeds)
    state = {g: (c, tolerance * spread[g]) for g, c in begin.items()}
    rows = cut(packed(rows.select("_g", "x")), "packed")
    for turn in range(rounds):
        if not state:
            break

        def sums(batches, now={g: c for g, (c, _) in state.items()}):  # noqa: B006  what this round's tasks work with
            total = {}
            for batch in batches:
                parts = {}
                for g, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    parts.setdefault(g, []).append(x)
                for g, held in parts.items():
                    if g not in now:
                        continue
                    c = now[g]
                    n, m, p = c.shape
                    flat, sq, step = c.reshape(n * m, p).T, (c * c).sum(2).ravel(), max(1, 40 * PACKED // p)
                    all_ = np.frombuffer(b"".join(held)).reshape(-1, p)
                    for x in (all_[at : at + step] for at in range(0, len(all_), step)):
                        d = (x * x).sum(1)[:, None] - 2 * x @ flat + sq
                        d = np.maximum(d.reshape(len(x), n, m), 0)
                        hot = (d.argmin(2)[:, :, None] == np.arange(m)).astype(float).reshape(len(x), n * m)
                        out = np.column_stack((hot.sum(0), np.einsum("ij,ij->j", hot, d.reshape(len(x), n * m)), hot.T @ x))
                        total[g] = total.get(g, 0) + out
            for g, v in total.items():
                yield pa.RecordBatch.from_pydict({"_g": [g] * v.size, "at": pa.array(np.arange(v.size), pa.int32()), "v": v.ravel()})

        live = rows if len(state) == len(begin) else rows.where(F.col("_g").isin(list(state)))
        got = live.mapInArrow(sums, "_g string, at int, v double").groupBy("_g", "at").agg(F.sum("v").alias("v"))
        cells: dict = {g: np.zeros(c.shape[0] * c.shape[1] * (c.shape[2] + 2)) for g, (c, _) in state.items()}
        for r in got.toPandas().itertuples(index=False):
            cells[r[0]][r[1]] = r[2]
        for g in list(state):
            centres, limit = state[g]
            n, m, p = centres.shape
            v = cells[g].reshape(n, m, p + 2)
            new = np.where(v[:, :, :1] > 0, v[:, :, 2:] / np.maximum(v[:, :, :1], 1), centres)
            moved = ((new - centres) ** 2).sum(2).max()
            if moved <= limit or turn == rounds - 1:
                cost = v[:, :, 1].sum(1)
                best = int(cost.argmin())
                done[values[g]] = (centres, cost) if every else (centres[best], float(cost[best]))
                del state[g]
            else:
                state[g] = new, limit
    return done


def kmeans(points: DataFrame, k: int, starts: int = 10, column: str = "x", seed: int = 42) -> tuple[np.ndarray, float]:
    """The centres of the cheapest of several starts, and its cost."""
    return kmeans_many(points, k, (), starts, seed=seed, column=column)[()]


def assigned_many(points: DataFrame, models: dict, by: tuple[str, ...] = (), column: str = "x") -> DataFrame:
    """`points` with label (from 0) and margin by the model of their value of `by`: the nearest centre, and (d2 - d1) / d2 for the two nearest."""
    centres = {key: c for key, (c, _) in models.items()}
    own = [c for c in points.columns if c not in ("label", "margin")]

    def near(batches):
        for batch in batches:
            label, margin = np.zeros(len(batch), np.int32), np.full(len(batch), np.nan)
            groups = batch.groupby(list(by)).indices if by else {(): np.arange(len(batch))}
            for key, at in groups.items():
                key = key if isinstance(key, tuple) else (key,)
                if not len(at):
                    continue
                d = np.sqrt(((_stack(batch[column].iloc[at])[:, None] - centres[key]) ** 2).sum(2))
                label[at] = d.argmin(1)
                if d.shape[1] > 1:
                    two = np.sort(d, 1)[:, :2]
                    margin[at] = np.where(two[:, 1] > 0, (two[:, 1] - two[:, 0]) / np.where(two[:, 1] > 0, two[:, 1], 1), 0)
            yield batch.assign(label=label, margin=margin)

    got = points.select(*own).mapInPandas(near, ", ".join(f"`{c}` {t}" for c, t in points.select(*own).dtypes) + ", label int, margin double")
    return got.withColumn("margin", F.when(~F.isnan("margin"), F.col("margin")))


def _sq(x, centre):
    return F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in centre]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def assigned(points: DataFrame, centres: np.ndarray, column: str = "x") -> DataFrame:
    """`points` with `label`, the nearest centre (the lowest number of a tie), and `margin`, (d2 - d1) / d2 for the two nearest."""
    d = F.array_sort(F.array(*[F.struct(F.sqrt(_sq(F.col(column), c)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))
    rows = points.withColumn("_d", d)
    margin = F.try_divide(F.col("_d")[1]["d"] - F.col("_d")[0]["d"], F.col("_d")[1]["d"]) if len(centres) > 1 else F.lit(None).cast("double")
    return rows.withColumn("label", F.col("_d")[0]["i"]).withColumn("margin", margin).drop("_d")


def diagonal_mixture(points: DataFrame, k: int, starts: int = 10, rounds: int = 100, floor: float = 1e-6, tolerance: float = 1e-3, seed: int = 42, column: str = "x") -> DataFrame:
    """`points` with `label`, the likeliest component of a Gaussian mixture with diagonal covariances, the likeliest of several fits.

    The fits begin from the centres of as many starts of k-means and go on together; one ends when its
    mean log likelihood grows by less than `tolerance`. A round is one aggregate over the points: each
    task sums the weights, values and squares of its rows, starts * k * (2 p + 1) numbers, so what
    meets on the driver doesn't grow with the rows.
    """
    means = kmeans_many(points, k, (), starts, seed=seed, column=column, every=True)[()][0]
    n, k, p = means.shape
    state = means, np.ones((n, k, p)), np.full((n, k), 1 / k)

    def scores(x, means, variances, weights):
        """(rows, starts, k) log densities, by products of the points and their squares."""
        with np.errstate(divide="ignore"):
            const = np.log(weights) - 0.5 * (np.log(2 * np.pi * variances).sum(2) + (means**2 / variances).sum(2))
        a, b = (means / variances).reshape(n * k, p).T, (-0.5 / variances).reshape(n * k, p).T
        return const + (x @ a + (x * x) @ b).reshape(len(x), n, k)

    before, live, best = np.full(n, -np.inf), np.ones(n, bool), None
    for _ in range(rounds):

        def sums(batches, now=state):
            out, like_sum = np.zeros((n, k, 2 * p + 1)), np.zeros(n)
            for batch in batches:
                if len(batch):
                    x = _stack(batch[column])
                    s = scores(x, *now)
                    top = s.max(2, keepdims=True)
                    like = top + np.log(np.exp(s - top).sum(2, keepdims=True))
                    r = np.exp(s - like).reshape(len(x), n * k)
                    like_sum += like.sum((0, 2))
                    out[:, :, 0] += r.sum(0).reshape(n, k)
                    out[:, :, 1 : p + 1] += (r.T @ x).reshape(n, k, p)
                    out[:, :, p + 1 :] += (r.T @ (x * x)).reshape(n, k, p)
            v = np.concatenate([out.ravel(), like_sum])
            yield pd.DataFrame({"at": np.arange(len(v), dtype=np.int32), "v": v})

        got = points.select(column).mapInPandas(sums, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
        if not len(got):
            break
        flat = np.zeros(n * k * (2 * p + 1) + n)
        flat[got["at"].to_numpy()] = got["v"].to_numpy()
        v, like = flat[:-n].reshape(n, k, 2 * p + 1), flat[-n:]
        size = np.maximum(v[:, :, :1], 1e-12)
        rows = v[:, :, 0].sum(1)
        best = int(like.argmax())
        live &= (like - before) > tolerance * rows
        if not live.any():
            break
        before = like
        centre = v[:, :, 1 : p + 1] / size
        spread = np.maximum(v[:, :, p + 1 :] / size - centre**2, 0) + floor
        new = centre, spread, v[:, :, 0] / rows[:, None]
        state = tuple(np.where(live.reshape(-1, *[1] * (a.ndim - 1)), a, b) for a, b in zip(new, state, strict=True))
    chosen = best or 0

    def label(batches, now=state):
        for batch in batches:
            x = _stack(batch[column]) if len(batch) else np.zeros((0, p))
            yield batch.assign(label=scores(x, *now)[:, chosen].argmax(1).astype("int32"))

    own = points.drop("label")
    return own.mapInPandas(label, ", ".join(f"`{c}` {t}" for c, t in own.dtypes) + ", label int")


def ordered_labels(rows: DataFrame, level: str, label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """`rows` with labels renumbered from 1 by the median of `level`, smallest first, for each value of `by`."""
    mids = group_medians(rows.withColumn("_old", F.col(label)), [*by, "_old"], [level]).withColumnRenamed(level, "_m")
    order = mids.withColumn("_new", F.row_number().over(Window.partitionBy(*by).orderBy("_m", "_old"))).drop("_m")
    return rows.withColumn("_old", F.col(label)).join(order, [*by, "_old"], "left").withColumn(label, F.col("_new")).select(*rows.columns)


def core_tree(x: np.ndarray, neighbours: int) -> np.ndarray:
    """Edges (a, b, distance) of the minimum spanning tree by mutual reachability: the largest of the distance and both points' distances to their `neighbours`-th nearest, themselves included; shortest first."""
    n, sq, nth = len(x), (x * x).sum(1), min(neighbours, len(x)) - 1

    def far(rows):
        """Distances of a few rows to all; a matrix of all is never held."""
        d = np.sqrt(np.maximum(sq[rows, None] + sq - 2 * x[rows] @ x.T, 0))
        d[np.arange(len(rows)), rows] = 0
        return d

    step = max(1, 2_000_000 // max(1, n))
    core = np.concatenate([np.partition(far(np.arange(i, min(n, i + step))), nth, axis=1)[:, nth].copy() for i in range(0, n, step)])
    best, from_, left = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    at, out = 0, []
    left[0] = False
    for _ in range(n - 1):
        reach = np.maximum(np.maximum(far(np.array([at]))[0], core[at]), core)
        closer = left & (reach < best)
        best[closer], from_[closer] = reach[closer], at
        at = int(np.where(left, best, np.inf).argmin())
        left[at] = False
        out.append((from_[at], at, best[at]))
    edges = np.array(out).reshape(-1, 3)
    return edges[np.argsort(edges[:, 2], kind="stable")]


def density_labels(x: np.ndarray, least: int = 50, neighbours: int = 10) -> np.ndarray:
    """HDBSCAN: labels from 0, -1 for noise.

    The tree is cut from its longest edge down; a part of `least` points or more that splits into two
    such parts ends there, smaller parts fall out of it. A part is worth the sum over its points of
    1 / distance at which they leave it, less that at which it began, and the parts that are worth
    more than those within them are the clusters. The whole is never one.
    """
    n = len(x)
    if n < max(2, least):
        return np.full(n, -1, np.int64)
    tree = core_tree(x, neighbours)
    parent, top = list(range(n)), list(range(n))
    kids, height, size = {}, {}, dict.fromkeys(range(n), 1)

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, (a, b, d) in enumerate(tree):
        ra, rb = find(int(a)), find(int(b))
        node = n + k
        kids[node], height[node], size[node] = (top[ra], top[rb]), d, size[top[ra]] + size[top[rb]]
        parent[rb] = ra
        top[ra] = node

    def leaves(node):
        line, found = [node], []
        while line:
            v = line.pop()
            if v < n:
                found.append(v)
            else:
                line += kids[v]
        return found

    root = 2 * n - 2
    born, worth, within, members = {0: 0.0}, {0: 0.0}, {0: []}, {0: []}
    line = [(root, 0)]
    while line:
        node, part = line.pop()
        if node < n:
            members[part].append(node)
            continue
        level = 1 / height[node] if height[node] > 0 else np.inf
        big = [v for v in kids[node] if size[v] >= least]
        gain = level - born[part] if np.isfinite(level) else 0.0
        if len(big) == 2:
            worth[part] += gain * size[node]
            for v in big:
                new = len(born)
                born[new], worth[new], within[new], members[new] = level, 0.0, [], []
                within[part].append(new)
                line.append((v, new))
            continue
        for v in kids[node]:
            if v in big:
                line.append((v, part))
            else:
                worth[part] += gain * size[v]
                members[part] += leaves(v)
    chosen: dict[int, bool] = {}
    for part in sorted(born, reverse=True):
        inner = sum(worth[c] for c in within[part])
        chosen[part] = part != 0 and worth[part] >= inner
        if not chosen[part]:
            worth[part] = inner
    labels, line, label = np.full(n, -1, np.int64), [0], 0
    while line:
        part = line.pop()
        if chosen[part]:
            down = [part]
            while down:
                q = down.pop()
                labels[members[q]] = label
                down += within[q]
            label += 1
        else:
            line += within[part][::-1]
    return labels


def density_clusters(points: DataFrame, by: str, least: int = 50, neighbours: int = 10) -> DataFrame:
    """(by, id, label) by density_labels() for each value of `by`, whose points meet in one task, which holds a few rows of their distances at a time; -1 is noise."""
    kinds = dict(points.dtypes)

    def label(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        return group[[by, "id"]].assign(label=density_labels(_stack(group["x"]), least, neighbours).astype("int32"))

    return points.select(by, "id", "x").groupBy(by).applyInPandas(label, f"{by} {kinds[by]}, id {kinds['id']}, label int")


def best_names(table: dict) -> dict:
    """{label: reference} one to one for a contingency table {(reference, label): n}, so that most rows agree; labels beyond the reference's number are missing."""
    refs, labels = (sorted({key[at] for key in table if key[at] is not None}) for at in (0, 1))
    if not refs or not labels:
        return {}
    agree = np.array([[table.get((r, c), 0) for r in refs] for c in labels], float)
    turned = len(labels) > len(refs)
    pairs = enumerate(assignment(agree.T if turned else agree))
    return {labels[j if turned else i]: refs[i if turned else j] for i, j in pairs}


def assignment(gain: np.ndarray) -> list[int]:
    """The column of each row, one to one, for which the gains add up to the most; no more rows than columns.

    Rows come in one after the other, each by the cheapest path that frees a column for it, with
    prices on rows and columns that keep all reduced losses at zero or more: rows^2 * columns steps.
    """
    loss = gain.max() - gain
    rows, cols = loss.shape
    row_price, col_price, holder = np.zeros(rows), np.zeros(cols), np.full(cols, -1)
    for new in range(rows):
        reach, before = loss[new] - row_price[new] - col_price, np.full(cols, -1)
        settled, at = [], -1
        open_ = np.ones(cols, bool)
        while True:
            at = int(np.where(open_, reach, np.inf).argmin())
            far = reach[at]
            if holder[at] < 0:
                break
            open_[at] = False
            settled.append(at)
            row = holder[at]
            through = far + loss[row] - row_price[row] - col_price
            better = open_ & (through < reach - 1e-12)
            reach[better], before[better] = through[better], at
        row_price[new] += far
        for c in settled:
            row_price[holder[c]] += far - reach[c]
            col_price[c] -= far - reach[c]
        while before[at] >= 0:
            holder[at] = holder[before[at]]
            at = before[at]
        holder[at] = new
    out = [-1] * rows
    for c, r in enumerate(holder):
        if r >= 0:
            out[r] = c
    return out


def aligned(rows: DataFrame, reference: str, label: str, by: str | None = None) -> DataFrame:
    """`rows` with `aligned`: `label` renamed to reference labels one to one so that most rows agree, for each value of `by`.

    The contingency tables, one row per pair of labels, are all that the driver sees. Labels beyond
    the reference's number get null.
    """
    keys = [by] if by else []
    tables: dict = {}
    for r in rows.groupBy(*keys, reference, label).agg(F.count("*").alias("n")).collect():
        tables.setdefault(r[by] if by else None, {})[r[reference], r[label]] = r["n"]
    kinds = dict(rows.dtypes)
    found = [(*([g] if by else []), old, new) for g, t in tables.items() for old, new in best_names(t).items()]
    schema = ", ".join([*([f"_g {kinds[by]}"] if by else []), f"_old {kinds[label]}", f"aligned {kinds[reference]}"])
    names = rows.sparkSession.createDataFrame(found, schema)
    on = F.col(label) == F.col("_old")
    if by:
        on &= F.col(by) == F.col("_g")
    return rows.join(names, on, "left").drop("_old", "_g")


def one_hot(rows: DataFrame, column: str) -> tuple[DataFrame, list[str]]:
    """`rows` with a 0/1 column for each value of `column`, and their names. The values, a bounded set of labels, come to the driver."""
    values = sorted(r[0] for r in rows.select(column).distinct().collect() if r[0] is not None)
    names = [f"{column}_is_{i}" for i in range(len(values))]
    return rows.select("*", *[F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)).alias(n) for n, v in zip(names, values, strict=True)]), names


def ridge_folds(rows: DataFrame, features: list[str], target: str, fold: str, alpha: float = 1.0, plain: list[str] = ()) -> DataFrame:
    """(fold, n, mse, mean_mse): held-out errors of ridge regression, and of predicting the training mean.

    Features are standardised by the training rows of each fold (constant ones become 0), those in
    `plain` (0/1 columns) taken as they are; a value that a fold's training rows lack has no weight.
    One aggregate per fold gathers the moments; every fit subtracts its fold's from the total.
    """
    features = [*features, *plain]
    terms = ["1", *features, target]
    cells = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    col = lambda t: F.lit(1.0) if t == "1" else F.col(t).cast("double")
    good = rows.dropna(subset=[*features, target, fold])
    sums = good.groupBy(fold).agg(*[F.sum(col(terms[i]) * col(terms[j])).alias(f"c{i}_{j}") for i, j in cells]).orderBy(fold).collect()
    moments = {}
    for r in sums:
        a = np.zeros((len(terms), len(terms)))
        for i, j in cells:
            a[i, j] = a[j, i] = r[f"c{i}_{j}"]
        moments[r[fold]] = a
    whole, out = sum(moments.values()), []
    for name, held in moments.items():
        train, n = whole - held, (whole - held)[0, 0]
        if n < 1:
            continue
        mean = train[0] / n
        cov = train / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 0))[1:-1]
        scale = np.where(sd > 1e-12, 1 / np.where(sd > 1e-12, sd, 1), 0)
        scale[len(features) - len(plain) :] = 1
        x, y = cov[1:-1, 1:-1] * np.outer(scale, scale), cov[1:-1, -1] * scale
        w = np.linalg.solve(n * x + alpha * np.eye(len(features)), n * y) * scale
        v = np.concatenate([[-(mean[-1] - w @ mean[1:-1])], -w, [1]])
        base = np.concatenate([[-mean[-1]], np.zeros(len(features)), [1]])
        out.append((name, int(held[0, 0]), float(v @ held @ v / held[0, 0]), float(base @ held @ base / held[0, 0])))
    kind = dict(rows.dtypes)[fold]
    return rows.sparkSession.createDataFrame(out, f"{fold} {kind}, n long, mse double, mean_mse double")


def ridge_gain(rows: DataFrame, numeric: list[str], base: str, added: str, target: str, fold: str, alpha: float = 1.0) -> DataFrame:
    """(n, base_mse, mse, base_rmse, rmse, reduction_percent): errors over all held-out rows with the labels `base` one-hot, and with the labels `added` as well."""
    rows, first = one_hot(rows.dropna(subset=[*numeric, target, fold, base, added]), base)
    rows, second = one_hot(rows, added)
    plain, more = (ridge_folds(rows, numeric, target, fold, alpha, names).select(fold, "n", F.col("mse").alias(name)) for names, name in ((first, "base"), ([*first, *second], "full")))
    pooled = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    both = plain.join(more.drop("n"), fold).agg(F.sum("n").alias("n"), pooled("base").alias("base_mse"), pooled("full").alias("mse"))
    return both.select("n", "base_mse", "mse", F.sqrt("base_mse").alias("base_rmse"), F.sqrt("mse").alias("rmse"), (100 * (1 - F.try_divide("mse", "base_mse"))).alias("reduction_percent"))


def subsample(rows: DataFrame, entity: str, trials: int, share: float = 0.8, seed: int = 0) -> DataFrame:
    """(trial, ...): for each trial the rows of exactly floor(share * n) of the n entities, those whose hash with the trial is smallest; whole entities, without a driver-side draw."""
    ids = rows.select(F.col(entity).alias("_e")).distinct()
    n = int(ids.count() * share)
    drawn = ids.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("_h", F.xxhash64("_e", "trial", F.lit(seed)))
    # the n-th smallest hash of each trial is found from counts of its leading bits, then among those that share them
    top = drawn.withColumn("_b", F.shiftright("_h", 40))
    upto = top.groupBy("trial", "_b").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(Window.partitionBy("trial").orderBy("_b")))
    edge = upto.where((F.col("upto") >= n) & (F.col("upto") - F.col("c") < n)).select("trial", F.col("_b").alias("_edge"), (n - F.col("upto") + F.col("c")).alias("_room"))
    near = top.join(edge, "trial").where(F.col("_b") <= F.col("_edge"))
    place = F.row_number().over(Window.partitionBy("trial").orderBy("_h", "_e"))
    tied = near.where(F.col("_b") == F.col("_edge")).withColumn("_n", place).where(F.col("_n") <= F.col("_room")).select("trial", "_e")
    chosen = near.where(F.col("_b") < F.col("_edge")).select("trial", "_e").unionByName(tied)
    return chosen.join(rows, F.col("_e") == F.col(entity)).drop("_e")


def _block_draws(rows: DataFrame, period: str, iterations: int, seed: int) -> list[tuple[int, int, str]]:
    """(iteration, draw, period) of periods drawn with replacement within their year (the first 4 characters). The names of the periods, which grow with the calendar and not with the rows, come to the driver."""
    periods = sorted(r[0] for r in rows.select(period).distinct().collect() if r[0] is not None)
    r, draws = np.random.default_rng(seed), []
    for i in range(iterations):
        for _, year in itertools.groupby(periods, key=lambda p: p[:4]):
            year = list(year)
            draws += [(i, d, year[j]) for d, j in enumerate(r.integers(0, len(year), len(year)))]
    return draws


def block_bootstrap(rows: DataFrame, period: str, iterations: int, seed: int = 0) -> DataFrame:
    """(iteration, draw, ...): rows of periods drawn with replacement within their year; a period drawn twice comes twice."""
    table = rows.sparkSession.createDataFrame(_block_draws(rows, period, iterations, seed), "iteration int, draw int, _p string")
    return rows.join(table, F.col(period) == F.col("_p")).drop("_p")


def block_weights(rows: DataFrame, period: str, iterations: int, seed: int = 0) -> DataFrame:
    """(iteration, period, weight): how often each of the same draws has a period, where it has it; a row for each draw and period of the calendar at most."""
    times = Counter((i, p) for i, _, p in _block_draws(rows, period, iterations, seed))
    return rows.sparkSession.createDataFrame([(i, p, n) for (i, p), n in times.items()], f"iteration int, `{period}` string, weight int")


def drawn_medians(rows: DataFrame, by: list[str], period: str, columns: list[str], weights: DataFrame) -> DataFrame:
    """(iteration, by, columns): for each draw of block_weights() the exact median of each column over the rows of a group, each as often as its period is drawn.

    Rows are read and grouped once and never copied for a draw. A group of `by` is held as a sorted
    array, so it should be one of few rows, as those of a node and year are. A draw that has none of a
    group's periods gives it no row; nulls don't count; a column without values is null.
    """
    year = lambda c: F.substring(F.col(c), 1, 4)
    entry = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).cast("double").alias("v"), F.col(period).alias("p")))
    groups = rows.where(F.col(period).isNotNull()).groupBy(*by, year(period).alias("_year")).agg(F.collect_set(period).alias("_periods"), *[F.sort_array(F.collect_list(entry(c))).alias(c) for c in columns])
    maps = weights.groupBy("iteration", year(period).alias("_year")).agg(F.map_from_entries(F.collect_list(F.struct(period, "weight"))).alias("_w"))
    # a row for each draw and year, made from the calendar alone
    both = groups.join(F.broadcast(maps), "_year").where(F.exists("_periods", lambda p: F.map_contains_key("_w", p)))

    def median(c):
        often = F.flatten(F.transform(c, lambda x: F.array_repeat(x["v"], F.coalesce(F.try_element_at(F.col("_w"), x["p"]), F.lit(0)))))
        many = F.col(f"_m_{c}")
        low, high = (F.get(many, end((F.size(many) - 1) / 2).cast("int")) for end in (F.floor, F.ceil))
        return often.alias(f"_m_{c}"), (low + (high - low) * 0.5).alias(c)

    parts = [median(c) for c in columns]
    return both.select("iteration", *by, *[p for p, _ in parts]).select("iteration", *by, *[m for _, m in parts])


def match_events(true: DataFrame, found: DataFrame, tolerance: int = 2, keys: tuple[str, ...] = ("entity", "from_label", "to_label")) -> DataFrame:
    """(keys, at, found_at, shift): true and found events of equal keys matched one to one, nearest first (then earliest), at most `tolerance` apart.

    In rounds over all keys at once: pairs that come first at both their ends are taken, until no
    pair is left. Rounds are as many as the longest chain of events that each wait for the one before.
    Events of equal time are one; null keys match nothing.
    """
    keys = list(keys)
    a = true.select(*keys, F.col("at").cast("long").alias("at"))
    near = a.join(found.select(*keys, F.col("at").cast("long").alias("found_at")), keys).where(F.abs(F.col("at") - F.col("found_at")) <= tolerance)
    edges = near.distinct().select(*keys, "at", "found_at", F.struct(F.abs(F.col("at") - F.col("found_at")).alias("d"), "at", "found_at").alias("e"))
    edges, taken = cut(edges, "events"), None
    while edges.limit(1).count():
        # an edge that comes first at both its ends is what the one-by-one choice takes too; what shares an end with it goes
        best = [edges.groupBy(*keys, end).agg(F.min("e").alias(f"best_{end}")) for end in ("at", "found_at")]
        now = edges.join(best[0], [*keys, "at"]).join(best[1], [*keys, "found_at"]).where((F.col("e") == F.col("best_at")) & (F.col("e") == F.col("best_found_at")))
        now = cut(now.select(*keys, "at", "found_at"), "matched")
        taken = now if taken is None else taken.unionByName(now)
        edges = cut(edges.join(now.select(*keys, "at"), [*keys, "at"], "left_anti").join(now.select(*keys, "found_at"), [*keys, "found_at"], "left_anti"), "events")
    taken = edges.select(*keys, "at", "found_at") if taken is None else taken
    return taken.withColumn("shift", F.col("found_at") - F.col("at"))


def event_scores(true: DataFrame, found: DataFrame, entities: DataFrame, tolerance: int = 2) -> DataFrame:
    """(true_events, found_events, matched, false_events, precision, recall, stable_nodes, false_stable, false_stable_percent); a ratio without events is null.

    A node of `entities` (entity) is stable if it has no true event, and falsely not so if one is found.
    """
    n = lambda df, name: df.agg(F.count("*").alias(name))
    stable = entities.select("entity").distinct().join(true.select("entity").distinct(), "entity", "left_anti")
    wrong = stable.join(found.select("entity").distinct(), "entity", "left_semi")
    parts = [n(true, "true_events"), n(found, "found_events"), n(match_events(true, found, tolerance), "matched"), n(stable, "stable_nodes"), n(wrong, "false_stable")]
    row = parts[0]
    for p in parts[1:]:
        row = row.crossJoin(F.broadcast(p))
    return row.select(
        "true_events", "found_events", "matched", (F.col("found_events") - F.col("matched")).alias("false_events"), F.try_divide("matched", "found_events").alias("precision"), F.try_divide("matched", "true_events").alias("recall"),
        "stable_nodes", "false_stable", (100 * F.try_divide("false_stable", "stable_nodes")).alias("false_stable_percent"),
    )


def calibration(rows: DataFrame, entity: str, label: str, columns: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each label's mean of the columns; the covariances of the entities' mean residuals; and those of what remains. Each as (a, b, cov) but the first."""
    from weftline.operators import panel

    mean = rows.groupBy(label).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    left = rows.join(mean, label).select(entity, *[(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in columns])
    effect = left.groupBy(entity).agg(*[F.avg(c).alias(f"_e_{c}") for c in columns])
    noise = left.join(effect, entity).select(*[(F.col(c) - F.col(f"_e_{c}")).alias(c) for c in columns])
    return mean.select(label, *[F.col(f"_m_{c}").alias(c) for c in columns]), panel.covariances(effect.select(*[F.col(f"_e_{c}").alias(c) for c in columns]), columns), panel.covariances(noise, columns)


def bootstrap_agreement(runs: DataFrame, keys: list[str], reference: str, label: str) -> DataFrame:
    """(keys, agreement): the share of runs in which a row's aligned label is its reference."""
    return quality.agreement(runs, reference, label, tuple(keys))
