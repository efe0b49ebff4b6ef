"""Quality of labels: geometric indices and agreement of partitions. Points are (id, label, x: array<double>)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from weftline.shared import cut


def sq_dist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 1))


def pairwise(points: DataFrame, by: tuple[str, ...], work, schema: str, rows: int = 1500) -> DataFrame:
    """work(left, right) for each pair of blocks of about `rows` points (by, id, x, others) that share `by`.

    Each pair of blocks is a task's work on two small tables, however many points a value of `by` has;
    a point is sent once for each block of its value.
    """
    sizes = points.groupBy(*by).agg(F.ceil(F.count("*") / rows).cast("int").alias("_blocks"))
    dealt = points.join(sizes, list(by)) if by else points.crossJoin(F.broadcast(sizes))
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")).withColumn("_all", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    own = points.columns
    # both sides come of one table, so each names its columns anew
    left, right = (dealt.select(*[F.col(c).alias(c) for c in own], F.col(i).alias("_i"), F.col(j).alias("_j")) for i, j in (("_own", "_all"), ("_all", "_own")))
    keys = [*by, "_i", "_j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(work, schema)


def _distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean"):
    """Rows of exact distances, a few rows of `a` at a time."""
    if metric == "cosine":
        a, b = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) for v in (a, b))
    step = max(1, 4_000_000 // max(1, b.size))
    for at in range(0, len(a), step):
        part = a[at : at + step]
        yield at, 1 - part @ b.T if metric == "cosine" else np.sqrt(((part[:, None] - b) ** 2).sum(2))


#: Pivots of all blocks together, which the driver holds; points of a pivot's cell, in the mean, while there are pivots for it.
PIVOTS, CELL = 4096, 1000


#: Rows of points on their way to other cells that a task holds, about.
VISITS = 4096


def _unit(x: np.ndarray, metric: str) -> np.ndarray:
    """Points among which Euclidean distances order as `metric` does: themselves, or at length one (null vectors stay)."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric == "cosine" else x


def _pivots(points: DataFrame, rows: int, metric: str) -> dict[str, np.ndarray]:
    """{block: pivots} for blocks of more than `rows` points, taken by a hash: a share of PIVOTS by size, so blocks that have any are at most half as many."""
    sizes = points.groupBy("_g").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    share = F.least(F.ceil(F.col("n") / min(CELL, rows)), F.floor(F.lit(float(PIVOTS)) * F.col("n") / max(1, total)))
    sizes = sizes.where(F.col("n") > rows).withColumn("p", share).where("p > 1")
    if not sizes.limit(1).count():
        return {}
    luck = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 31)) / float(1 << 31)
    drawn = points.join(F.broadcast(sizes), "_g").where(luck < 2 * F.col("p") / F.col("n"))
    drawn = drawn.withColumn("_n", F.row_number().over(Window.partitionBy("_g").orderBy(luck, "id"))).where(F.col("_n") <= F.col("p"))
    found: dict[str, list] = {}
    for r in drawn.select("_g", "x").collect():
        found.setdefault(r["_g"], []).append(r["x"])
    return {g: _unit(np.array(x, float), metric) for g, x in found.items()}


def _with_cells(points: DataFrame, pivots: dict, rows: int, metric: str) -> tuple[DataFrame, dict]:
    """`points` with _cell (the nearest pivot), _sub (a part of at most about `rows` points of it) and _subs; and {block: (radius, parts)} of its cells."""

    def cell(batches):
        for batch in batches:
            at, far = np.zeros(len(batch), np.int32), np.full(len(batch), np.inf)
            for g, place in batch.groupby("_g").indices.items():
                if g in pivots and len(place):
                    x = _unit(_stacked(batch["x"].iloc[place]).astype(float), metric)
                    d = np.concatenate([d for _, d in _distances(x, pivots[g])])
                    at[place] = d.argmin(1)
                    # a null vector has no direction, so no radius holds it
                    far[place] = np.where((x != 0).any(1) | (metric != "cosine"), d.min(1), np.inf)
            yield batch.assign(_cell=at, _far=far)

    kinds = ", ".join(f"`{c}` {t}" for c, t in points.dtypes)
    near = cut(points.mapInPandas(cell, f"{kinds}, _cell int, _far double"), "cells")
    facts = near.groupBy("_g", "_cell").agg(F.max("_far").alias("_radius"), F.ceil(F.count("*") / rows).cast("int").alias("_subs"))
    near = near.drop("_far").join(facts.drop("_radius"), ["_g", "_cell"]).withColumn("_sub", F.pmod(F.xxhash64("id"), F.col("_subs")).cast("int"))
    shape = {g: (np.full(len(p), -np.inf), np.zeros(len(p), int)) for g, p in pivots.items()}
    # only blocks with pivots come to the driver, a row for each pivot
    for r in facts.where(F.col("_g").isin(list(pivots))).collect() if pivots else []:
        shape[r["_g"]][0][r["_cell"]], shape[r["_g"]][1][r["_cell"]] = r["_radius"], r["_subs"]
    return near, shape


def _nearest(left: pd.DataFrame, right: pd.DataFrame, k: int, metric: str, other_first: str | None):
    """For each row of `left` the places in `right` of its k nearest with another id, whether they are the same in `other_first`, and their distances."""
    ids, peers = left["id"].to_numpy(), right["id"].to_numpy()
    mine, theirs = (left[other_first].to_numpy(), right[other_first].to_numpy()) if other_first else (None, None)
    for at, d in _distances(_stacked(left["x"]).astype(float), _stacked(right["x"]).astype(float), metric):
        for i, row in enumerate(d, at):
            same = (theirs == mine[i]).astype(int) if other_first else np.zeros(len(row), int)
            order = np.lexsort((peers, np.round(row, 9), same))
            order = order[peers[order] != ids[i]][:k]
            yield i, order, same[order], row[order]


def _visits(found: DataFrame, pivots: dict, shape: dict, metric: str) -> DataFrame:
    """Rows of `found` (_g, _cell, _sub, _subs, x, reach, ...) for each part of another cell, or of their own, that may hold a point within `reach`: with _to_cell, _to_sub."""

    def go(batches):
        for batch in batches:
            # a point goes to many cells, so what is held is a few thousand rows of it at a time
            rows, cells, subs = [], [], []
            for g, place in batch.groupby("_g").indices.items():
                own, part, reach = (batch[c].to_numpy()[place] for c in ("_cell", "_sub", "reach"))
                if g in pivots:
                    radius, n = shape[g]
                    d = np.concatenate([d for _, d in _distances(_unit(_stacked(batch["x"].iloc[place]).astype(float), metric), pivots[g])])
                    # no point of a cell is nearer than its pivot less the radius, nor than the plane halfway between both pivots
                    apart = np.maximum(np.concatenate([v for _, v in _distances(pivots[g], pivots[g])])[own], 1e-300)
                    plane = (d**2 - d[np.arange(len(d)), own][:, None] ** 2) / (2 * apart)
                    least = np.where(np.isinf(radius), -np.inf, np.maximum(d - radius, np.where(apart > 1e-9, plane, 0)))
                    near = (least <= reach[:, None] + 1e-7) & (n > 0)
                else:
                    n = np.array([batch["_subs"].iloc[place].iloc[0]])
                    near = np.ones((len(place), 1), bool)
                for i, c in zip(*np.nonzero(near), strict=True):
                    for t in range(n[c]):
                        if c != own[i] or t != part[i]:
                            rows.append(place[i])
                            cells.append(c)
                            subs.append(t)
                    if len(rows) >= VISITS:
                        yield batch.iloc[rows].assign(_to_cell=np.array(cells, np.int32), _to_sub=np.array(subs, np.int32))
                        rows, cells, subs = [], [], []
            yield batch.iloc[rows].assign(_to_cell=np.array(cells, np.int32), _to_sub=np.array(subs, np.int32))

    return found.mapInPandas(go, ", ".join(f"`{c}` {t}" for c, t in found.dtypes) + ", _to_cell int, _to_sub int")


def neighbours(points: DataFrame, k: int, block: str | tuple[str, ...] = "label", metric: str = "euclidean", other_first: str | None = None, rows: int = 1500) -> DataFrame:
    """(block, id, peer, distance, rank): the k nearest of each point within its block, exactly, ties by id; by Euclidean or cosine distance.

    With `other_first`, a column, points that differ in it come before those that don't (`same` is 0
    or 1). Blocks of more than `rows` points are cut into cells around pivots. A point looks in its
    own cell first; the k-th best there is its reach, and by the triangle inequality only cells whose
    radius and side of the plane between the pivots come that near are looked into. A point that finds fewer than k of the kind it prefers
    reaches everywhere. Cells are parted to about `rows` points, and parts are compared in pairs.
    """
    by = (block,) if isinstance(block, str) else tuple(block)
    extra = [other_first] if other_first else []
    kinds = dict(points.dtypes)
    keyed = points.select(*by, "id", "x", *extra, F.to_json(F.struct(*by) if by else F.struct(F.lit(0).alias("g"))).alias("_g"))
    pivots = _pivots(keyed, rows, metric)
    placed, shape = _with_cells(keyed, pivots, rows, metric)
    own = placed.columns
    peer = f"array<struct<peer: {kinds['id']}, same: int, distance: double>>"

    def inside(part: pd.DataFrame) -> pd.DataFrame:
        reach, found, ids = np.full(len(part), np.inf), [[]] * len(part), part["id"].tolist()
        for i, order, same, d in _nearest(part, part, k, metric, other_first):
            found[i] = [{"peer": ids[j], "same": int(s), "distance": float(v)} for j, s, v in zip(order, same, d, strict=True)]
            if len(order) == k and not same.any():
                # cosine distances are half the squared distances of vectors of length one
                reach[i] = np.sqrt(2 * max(d[-1], 0)) + 1e-9 if metric == "cosine" else d[-1]
        if metric == "cosine":
            reach[[not np.any(x) for x in part["x"]]] = np.inf
        return part.assign(reach=reach, found=found)

    schema = ", ".join(f"`{c}` {t}" for c, t in placed.dtypes)
    first = cut(placed.groupBy("_g", "_cell", "_sub").applyInPandas(inside, f"{schema}, reach double, found {peer}"), "nearest")
    near = first.select(*by, "id", F.explode("found").alias("f")).select(*by, "id", "f.*")
    if pivots or first.where("_subs > 1").limit(1).count():
        going = cut(_visits(first.drop("found"), pivots, shape, metric), "visits")
        pair = ["_g", "_cell", "_sub", "_to_cell", "_to_sub"]
        there = first.select(*[F.col(c).alias({"_cell": "_to_cell", "_sub": "_to_sub"}.get(c, c)) for c in own]).join(going.select(*pair).distinct(), ["_g", "_to_cell", "_to_sub"])

        def between(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(left) and len(right):
                peers = right["id"].to_numpy()
                for i, order, same, d in _nearest(left, right, k, metric, other_first):
                    out.append(pd.DataFrame({**{c: [left[c].iloc[i]] * len(order) for c in by}, "id": left["id"].iloc[i], "peer": peers[order], "same": same, "distance": d}))
            return pd.concat(out) if out else pd.DataFrame(columns=[*by, "id", "peer", "same", "distance"])

        result = "".join(f"{c} {kinds[c]}, " for c in by) + f"id {kinds['id']}, peer {kinds['id']}, same int, distance double"
        # both sides come of one table, so each names its columns anew
        left, right = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (going, there))
        near = near.unionByName(left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInPandas(between, result))
    rank = F.row_number().over(Window.partitionBy(*by, "id").orderBy("same", F.round("distance", 9), "peer"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select(*by, "id", "peer", *(["same"] if other_first else []), "distance", "rank")


def centroids(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, label, n, c, v): size, mean and population variance of each label by coordinate."""
    cell = points.select(*by, "label", F.posexplode("x").alias("at", "v")).groupBy(*by, "label", "at").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    got = F.array_sort(F.collect_list(F.struct("at", "m", "s")))
    cell = cell.groupBy(*by, "label").agg(F.first("n").alias("n"), got.alias("g"))
    return cell.select(*by, "label", "n", F.transform("g", lambda x: x["m"]).alias("c"), F.transform("g", lambda x: x["s"]).alias("v"))


def silhouette(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean exact Euclidean silhouette for each value of `by`; singletons count 0."""
    got = silhouettes(points.select(*by, "id", "label", "x", F.lit(0).alias("_over")), "_over", by).drop("_over")
    return got if by else got.agg(F.max("silhouette").alias("silhouette"))


#: Numbers of a block of points, or of its sums, that a task of silhouettes() holds; points of a row that is sent, about.
HELD, SENT = 4_000_000, 1024


def silhouettes(points: DataFrame, over: str, by: tuple[str, ...] = (), rows: int = 65_536) -> DataFrame:
    """(over, by, silhouette): mean exact silhouettes of the labels that each value of `over` gives the same points, (over, by, id, label, x) with the same x of an id of `by` for all values.

    All points against all, as the index is defined, by matrix products. Distances are made once for
    all labellings. A task has a block of at most `rows` points and a long chunk of the others, which
    it goes through a little at a time, and gives one matrix of sums; so points are sent once for
    each block, of which there are few, and not once for each thousand points. The names of labellings and
    labels come to the driver.
    """
    kinds = dict(points.dtypes)
    counted = points.groupBy(over, "label").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("p")).collect()
    found = sorted((r[over], r["label"]) for r in counted)
    columns = {pair: i for i, pair in enumerate(found)}
    names = sorted({o for o, _ in found})
    of = np.array([names.index(o) for o, _ in found])
    p, total_n = max([r["p"] for r in counted], default=1), max([sum(r["n"] for r in counted if r[over] == o) for o in names], default=0)
    # enough blocks for all cores, of no more than a task can hold
    block = max(1, min(rows, max(SENT, total_n // 48), HELD // max(p, len(found))))
    chunk, sent = max(block, HELD // p), min(SENT, block)
    spark = points.sparkSession
    codes = F.broadcast(spark.createDataFrame([(o, l, int(of[i]), i) for (o, l), i in columns.items()], f"_o {kinds[over]}, _l {kinds['label']}, _of int, _code int"))
    coded = points.join(codes, (F.col(over) == F.col("_o")) & (F.col("label") == F.col("_l")))
    own = lambda k: F.coalesce(F.max(F.when(F.col("_of") == k, F.col("_code"))), F.lit(-1))
    if len(names) > 1:
        held = coded.groupBy(*by, "id").agg(F.first("x").alias("x"), F.array(*[own(k) for k in range(len(names))]).alias("codes"))
    else:
        held = coded.select(*by, "id", "x", F.array("_code").alias("codes"))
    up = lambda n: F.ceil(F.col("_n") / n).cast("int")
    sizes = points.groupBy(*by, over).agg(F.count("*").alias("_n")).groupBy(*by).agg(F.max("_n").alias("_n"))
    sizes = sizes.select(*by, up(sent).alias("_parts"), up(block).alias("_blocks"), up(chunk).alias("_chunks"))
    held = held.join(F.broadcast(sizes), list(by)) if by else held.crossJoin(F.broadcast(sizes))
    packs = held.groupBy(*by, F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int").alias("_part"), "_parts", "_blocks", "_chunks").agg(F.collect_list(F.struct("x", "codes")).alias("h"))
    field = lambda c: F.flatten(F.transform("h", lambda v: v[c])).alias(c)
    # written, as both sides must have a point at the same place
    packs = cut(packs.select(*by, "_part", "_parts", "_blocks", "_chunks", F.size("h").alias("_m"), field("x"), field("codes")), "packs")
    at = lambda n: F.floor(F.col("_part").cast("long") * F.col(n) / F.col("_parts")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    wanted = [*by, "_part", "_m", "x", "codes"]
    # both sides come of one table, so each names its columns anew
    left, right = (packs.select(*[F.col(c).alias(c) for c in wanted], i.alias("_i"), j.alias("_j")) for i, j in ((at("_blocks"), every("_chunks")), (every("_blocks"), at("_chunks"))))
    keys = [*by, "_i", "_j"]

    def points_of(table, r):
        x, code = (table[c].combine_chunks()[r].values.to_numpy(zero_copy_only=False) for c in ("x", "codes"))
        m = table["_m"][r].as_py()
        return x.reshape(m, -1), code.reshape(m, len(names))

    def sums(left, right):
        if not left.num_rows or not right.num_rows:
            return empty
        left = left.sort_by("_part")
        sides = [points_of(left, r) for r in range(left.num_rows)]
        starts = dict(zip(left["_part"].to_pylist(), np.cumsum([0, *[len(x) for x, _ in sides[:-1]]]).tolist(), strict=True))
        a, own = np.concatenate([x for x, _ in sides]), np.concatenate([c for _, c in sides])
        # |x - y|^2 as one product
        a = np.column_stack((-2 * a, (a * a).sum(1), np.ones(len(a))))
        total, n = np.zeros((len(a), len(found))), np.zeros(len(found))
        for r, part in enumerate(right["_part"].to_pylist()):
            x, far = points_of(right, r)
            b = np.vstack((x.T, np.ones(len(x)), (x * x).sum(1)))
            hot = np.zeros((len(x), len(found)))
            for c in far.T:
                hot[np.flatnonzero(c >= 0), c[c >= 0]] = 1
            n += hot.sum(0)
            step, same = max(1, 500_000 // len(x)), starts.get(part)
            for i in range(0, len(a), step):
                d = a[i : i + step] @ b
                np.sqrt(np.maximum(d, 0, out=d), out=d)
                if same is not None:
                    me = np.arange(max(i, same), min(i + step, same + len(x)))
                    d[me - i, me - same] = 0
                total[i : i + step] += d @ hot
        row = [*[left[c][0].as_py() for c in by], left["_i"][0].as_py(), own.astype(np.int32).tobytes(), total.tobytes(), n.tobytes()]
        return pa.table([pa.array([v], t) for v, t in zip(row, empty.schema.types, strict=True)], schema=empty.schema)

    def scores(part: pd.DataFrame) -> pd.DataFrame:
        own = np.frombuffer(part["own"].iloc[0], np.int32).reshape(-1, len(names))
        n = sum(np.frombuffer(v) for v in part["n"])
        total = np.zeros((len(own), len(found)))
        for s in part["s"]:
            total += np.frombuffer(s).reshape(total.shape)
        out = []
        for k, name in enumerate(names):
            at, mine = np.flatnonzero(own[:, k] >= 0), own[own[:, k] >= 0, k]
            mean = np.where((of == k) & (n > 0), total[at] / np.maximum(n, 1), np.inf)
            a = total[at, mine] / np.maximum(n[mine] - 1, 1)
            mean[np.arange(len(at)), mine] = np.inf
            b = mean.min(1)
            most = np.maximum(a, b)
            good = (n[mine] > 1) & np.isfinite(b) & (most > 0)
            one = np.where(good, (np.where(good, b, 0) - a) / np.where(good, most, 1), 0)
            if len(at):
                out.append({**{c: part[c].iloc[0] for c in by}, over: name, "total": one.sum(), "n": len(at)})
        return pd.DataFrame(out, columns=[*by, over, "total", "n"])

    schema = packs.select(*by).schema.add("_i", "integer").add("own", "binary").add("s", "binary").add("n", "binary")
    empty = to_arrow_schema(schema).empty_table()
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(sums, schema)
    keyed = "".join(f"{c} {kinds[c]}, " for c in by)
    one = pairs.groupBy(*by, "_i").applyInPandas(scores, f"{keyed}{over} {kinds[over]}, total double, n long")
    return one.groupBy(over, *by).agg((F.sum("total") / F.sum("n")).alias("silhouette"))


def sampled(points: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """Exactly `size` points (all, if there are fewer): those whose MD5 of id|seed is smallest."""
    return points.withColumn("_h", F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(seed))))).orderBy("_h", "id").limit(size).drop("_h")


def s_dbw(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """S_Dbw for each value of `by`: mean scatter of the labels plus the density between each two of them.

    Variances are the population's; the radius is the root of the summed norms of the labels'
    variances over their number; null where all points are alike.
    """
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    c = centroids(points, by)
    whole = centroids(points.withColumn("label", F.lit(0)), by).select(*by, norm(F.col("v")).alias("all_v"))
    facts = c.groupBy(*by).agg(F.count("*").alias("k"), (F.sqrt(F.sum(norm(F.col("v")))) / F.count("*")).alias("radius"), F.avg(norm(F.col("v"))).alias("mean_v"))
    on = lambda a, b, more=(): a.join(b, [*by, *more]) if by or more else a.crossJoin(F.broadcast(b))
    near = lambda x, y: F.sqrt(sq_dist(x, y)) <= F.col("radius")
    rows = on(on(points.select(*by, "label", "x"), c.select(*by, "label", "c"), ("label",)), facts.select(*by, "radius"))
    own = rows.groupBy(*by, "label").agg(F.count_if(near(F.col("x"), F.col("c"))).alias("density"))
    other = c.select(*by, F.col("label").alias("l2"), F.col("c").alias("c2"))
    middle = F.zip_with("c", "c2", lambda x, y: (x + y) / 2)
    pairs = on(rows, other).where("label <> l2").groupBy(*by, F.least("label", "l2").alias("a"), F.greatest("label", "l2").alias("b")).agg(F.count_if(near(F.col("x"), middle)).alias("between"))
    pairs = pairs.join(own.select(*by, F.col("label").alias("a"), F.col("density").alias("da")), [*by, "a"]).join(own.select(*by, F.col("label").alias("b"), F.col("density").alias("db")), [*by, "b"])
    between = pairs.groupBy(*by).agg(F.sum(F.coalesce(F.try_divide("between", F.greatest("da", "db")), F.lit(0.0))).alias("dens"))
    out = on(facts, whole)
    out = out.join(between, list(by), "left") if by else out.crossJoin(F.broadcast(between))
    return out.select(*by, (F.try_divide("mean_v", "all_v") + F.coalesce(F.try_divide(2 * F.col("dens"), F.col("k") * (F.col("k") - 1)), F.lit(0.0))).alias("s_dbw"))


def least_share(labels: DataFrame, period: str = "period", label: str = "label") -> DataFrame:
    """One row: the least share that any label has in any period, 0 where it has no rows there."""
    n = labels.groupBy(period, label).agg(F.count("*").alias("n"))
    grid = n.select(period).distinct().crossJoin(n.select(label).distinct())
    full = grid.join(n, [period, label], "left").fillna(0, ["n"])
    return full.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(period))).agg(F.min("share").alias("least_share"))


def agreement(pairs: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, agreement): the share of rows with equal labels."""
    return pairs.groupBy(*by).agg(F.avg((F.col(a) == F.col(b)).cast("int")).alias("agreement"))


def centre_indices(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """calinski_harabasz and davies_bouldin, one row for each value of `by`."""
    on = lambda a, b, more=(): a.join(b, [*by, *more]) if by or more else a.crossJoin(F.broadcast(b))
    c = centroids(points, by)
    whole = centroids(points.withColumn("label", F.lit(0)), by).select(*by, F.col("c").alias("g"), F.col("n").alias("n_all"))
    per = on(points.select(*by, "label", "x"), c, ("label",)).select(*by, "label", "n", "c", sq_dist(F.col("x"), F.col("c")).alias("d2"))
    per = per.groupBy(*by, "label").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.sum("d2").alias("within"), F.avg(F.sqrt("d2")).alias("spread"))
    ch = on(per, whole).groupBy(*by).agg(F.sum(F.col("n") * sq_dist(F.col("c"), F.col("g"))).alias("between"), F.sum("within").alias("within"), F.count("*").alias("k"), F.first("n_all").alias("n"))
    ch = ch.select(*by, (F.try_divide("between", F.col("k") - 1) / F.nullif(F.try_divide("within", F.col("n") - F.col("k")), F.lit(0.0))).alias("calinski_harabasz"))
    b = per.select(*by, F.col("label").alias("l2"), F.col("c").alias("cb"), F.col("spread").alias("sb"))
    db = on(per, b).where("label <> l2").groupBy(*by, "label").agg(F.max(F.try_divide(F.col("spread") + F.col("sb"), F.sqrt(sq_dist(F.col("c"), F.col("cb"))))).alias("r")).groupBy(*by).agg(F.avg("r").alias("davies_bouldin"))
    return on(ch, db)


def ari(pairs: DataFrame, a: str = "a", b: str = "b", by: tuple[str, ...] = ()) -> DataFrame:
    """Adjusted Rand index of two labellings for each value of `by`, 1 when both are trivially equal."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    n = pairs.groupBy(*by, a, b).agg(F.count("*").alias("n"))
    rows = n.groupBy(*by, a).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(two("n")).alias("ra"))
    cols = n.groupBy(*by, b).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(two("n")).alias("rb"))
    all_ = n.groupBy(*by).agg(F.sum(two("n")).alias("idx"), F.sum("n").alias("n"))
    j = all_.join(rows, list(by)).join(cols, list(by)) if by else all_.join(F.broadcast(rows)).join(F.broadcast(cols))
    expect = F.try_divide(F.col("ra") * F.col("rb"), two("n"))
    return j.select(*by, F.coalesce(F.try_divide(F.col("idx") - expect, (F.col("ra") + F.col("rb")) / 2 - expect), F.lit(1.0)).alias("ari"))


def adjacent_ari(labels: DataFrame, entity: str, period: str, label: str) -> DataFrame:
    """(period, ari): each period's labels against those of the period before, over entities that have both."""
    w = Window.partitionBy(entity).orderBy(period)
    both = labels.withColumn("_before", F.lag(label).over(w)).where("_before is not null")
    return ari(both, "_before", label, (period,))


def jaccard(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Per label, rows that have it on both sides over rows that have it on either."""
    both = pairs.select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    e = both.select("_a", "_b", F.explode(F.array_distinct(F.array_compact(F.array("_a", "_b")))).alias("label"))
    return e.groupBy("label").agg((F.sum(F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).cast("long")) / F.count("*")).alias("jaccard"))
