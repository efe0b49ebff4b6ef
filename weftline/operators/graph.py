"""Weighted graphs: nearest-neighbour layers, mixing, normalising, smoothing and network indices.

Edges are (src, dst, w), both directions present. Where `by` is given, edges, nodes or labels have
such columns too (a period, say), and each of their values is a graph of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline import linked
from weftline.operators.panel import pair_audit
from weftline.operators.quantiles import group_medians
from weftline.shared import cut


def canonical(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, a, b, distance) with a < b and the least distance; pairs of a node with itself go."""
    p = pairs.where("x <> y").select(*by, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")
    return p.groupBy(*by, "a", "b").agg(F.min("distance").alias("distance"))


def knn_layer(pairs: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Each node's k nearest, weighing exp(-distance / s) with s the median positive distance chosen, made symmetric by the larger weight. Ties: forward pairs first, then the neighbour's id."""
    c = canonical(pairs, by)
    both = c.select(*by, F.col("a").alias("src"), F.col("b").alias("dst"), "distance", F.lit(0).alias("back")).unionByName(c.select(*by, F.col("b").alias("src"), F.col("a").alias("dst"), "distance", F.lit(1).alias("back")))
    near = both.withColumn("rn", F.row_number().over(Window.partitionBy(*by, "src").orderBy("distance", "back", "dst"))).where(F.col("rn") <= k)
    return scaled_layer(near, by)


def scaled_layer(near: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The weights of knn_layer() of neighbours (by, src, dst, distance) already chosen."""
    # the chosen pairs are read for their scale and for their weights
    near = cut(near.select(*by, "src", "dst", "distance"), "near")
    scale = group_medians(near.select(*by, F.when(F.col("distance") > 0, F.col("distance")).alias("s")), list(by), ["s"])
    near = near.join(scale, list(by)) if by else near.join(F.broadcast(scale))
    return symmetric(near.select(*by, "src", "dst", F.exp(-F.col("distance") / F.col("s")).alias("w")), by)


#: Pairs of ids that a block of _by_shared() counts, about.
PAIRS = 4_000_000


#: Nodes in a range that _starts() sums in order, about.
RANGE = 10_000


def _starts(weights: DataFrame, most: int) -> np.ndarray:
    """The first x of each run of x, in order, that weighs about `most`, from (x, w); a run is longer only by its last x. No task orders more than a range of about RANGE nodes."""
    weights = cut(weights, "weights")
    many = -(-weights.count() // RANGE)
    ends = weights.agg(F.percentile_approx("x", [i / many for i in range(1, many)], 10 * RANGE)).first()[0] if many > 1 else []
    weights = weights.withColumn("r", F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < F.col("x"))) if ends else F.lit(0))
    totals = {r["r"]: r["w"] for r in weights.groupBy("r").agg(F.sum("w").alias("w")).collect()}
    before = F.element_at(F.create_map(*[F.lit(int(v)) for r in totals for v in (r, sum(w for i, w in totals.items() if i < r))]), F.col("r")) if totals else F.lit(0)
    upto = F.sum("w").over(Window.partitionBy("r").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    runs = weights.withColumn("run", F.floor((before + upto - F.col("w")) / most)).groupBy("run").agg(F.min("x").alias("x"))
    return np.array(sorted(r["x"] for r in runs.collect()), np.int64)


def _by_shared(members: DataFrame, work, schema: str) -> DataFrame:
    """The rows (`schema`) of the arrays that work(node, peers, shared) gives, from (x: long, p) rows of nodes and their sets: `peers`, in order, share `shared` sets with `node`.

    No pair is written: a set's list goes once to each block of nodes that has one in it, and a
    block's task counts the pairs of its own nodes. Blocks are runs of ids, as those that belong
    together are often near each other, as many as keep a block at about PAIRS, so a task's memory
    stays the same. The first id of each block comes to the driver.
    """
    lists = members.where("x is not null and p is not null").groupBy("p").agg(F.collect_set(F.col("x").cast("long")).alias("xs"))
    lists = cut(lists.where(F.size("xs") > 1).select("xs"), "lists")
    starts = _starts(lists.select(F.explode("xs").alias("x"), F.size("xs").cast("long").alias("n")).groupBy("x").agg(F.sum("n").alias("w")), PAIRS)

    def deal(batches):
        for batch in batches:
            xs = batch.column(0)
            size = np.diff(xs.offsets.to_numpy())
            block = np.searchsorted(starts, xs.flatten().to_numpy(zero_copy_only=False), "right") - 1
            pairs = np.unique(np.repeat(np.arange(len(size)), size) * len(starts) + block)
            # a few lists at a time, as each can go to many blocks
            for at in range(0, len(pairs), 10_000):
                some = pairs[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(some % len(starts)), xs.take(pa.array(some // len(starts)))], names=["b", "xs"])

    dealt = lists.mapInArrow(deal, "b long, xs array<long>")
    names_, types = zip(*[c.strip().split(" ") for c in schema.split(",")], strict=True)
    kinds = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[t] for t in types]

    def count(key, table):
        block = key[0].as_py()
        xs = table["xs"].combine_chunks()
        ids, size = xs.flatten().to_numpy(zero_copy_only=False), np.diff(xs.offsets.to_numpy())
        start, own = np.cumsum(size) - size, np.flatnonzero(np.searchsorted(starts, ids, "right") - 1 == block)
        names, code = np.unique(ids[own], return_inverse=True)
        of = np.repeat(np.arange(len(size)), size)[own]
        order = np.argsort(code, kind="stable")
        code, of = code[order], of[order]
        ends = np.searchsorted(code, np.arange(len(names) + 1))
        out = []
        for i, name in enumerate(names):
            rows = of[ends[i] : ends[i + 1]]
            many = size[rows]
            peers = np.sort(ids[np.repeat(start[rows] - (np.cumsum(many) - many), many) + np.arange(many.sum())])
            at = np.flatnonzero(np.concatenate(([True], peers[1:] != peers[:-1])))
            peers, shared = peers[at], np.diff(np.append(at, len(peers)))
            out.append(work(name, peers[peers != name], shared[peers != name]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names_, columns, kinds, strict=True)})

    return dealt.groupBy("b").applyInArrow(count, schema)


def nearest_by_shared(members: DataFrame, k: int) -> DataFrame:
    """(src, dst, distance, rank, others): the k nodes that share the most sets with each, from (x: long, p) rows of nodes and their sets; distance is 1 / sets shared. Ties: larger ids first, then by id. `others` is how many share any.

    What knn_layer() chooses of all pairs, but no pair is written (see _by_shared()).
    """

    def nearest(name, peers, shared):
        # the place by id breaks ties, so keys differ
        rank = ((shared.max() - shared) * 2 + (peers < name)) * len(peers) + np.arange(len(peers))
        best = np.sort(np.partition(rank, k - 1)[:k] if len(rank) > k else rank) % len(peers)
        return np.full(len(best), name), peers[best], 1.0 / shared[best], np.arange(1, len(best) + 1), np.full(len(best), len(peers))

    return _by_shared(members, nearest, "src long, dst long, distance double, rank int, others long")


def audit_by_shared(members: DataFrame) -> DataFrame:
    """The row of panel.pair_audit() without its layer, none where there is no pair, of (x < y, 1 / sets shared) from (x: long, p) rows of nodes and their sets; the pairs aren't written."""

    def facts(name, peers, shared):
        return np.array([name]), np.array([(peers > name).sum()]), np.array([shared.min()]), np.array([shared.max()])

    per = _by_shared(members, facts, "x long, above long, least long, most long")
    sums = per.agg(F.sum("above").alias("n"), F.max("most").alias("most"), F.min("least").alias("least"), F.count("*").alias("nodes")).where("n > 0")
    n, none = F.col("n"), F.lit(0).cast("long")
    return sums.select(n.alias("n_rows"), none.alias("zero"), (1.0 / F.col("most")).alias("low"), (1.0 / F.col("least")).alias("high"), none.alias("repeated"), n.alias("pairs"), n.alias("directed"), none.alias("conflicts"), "nodes")


def audit_by_value(values: DataFrame) -> DataFrame:
    """The row of panel.pair_audit() without its layer, none where there is no pair, of (x, y, |v_x - v_y|) of all x <> y of a group, in both directions, from (x, g, v); v may be null.

    Counted from the groups' sizes and ordered values; only the pairs of nodes that have more than one
    row, or a value that isn't finite, are written.
    """
    rows = values.where("x is not null and g is not null").select("x", "g", F.col("v").cast("double").alias("v"))
    many = rows.groupBy("x").agg((F.count("*") > 1).alias("odd"))
    finite = F.col("v").isNull() | (F.abs("v") < float("inf"))
    rows = cut(rows.join(many, "x").withColumn("odd", F.col("odd") | ~finite), "values")
    lone = rows.where("not odd")
    level = lone.groupBy("g", "v").agg(F.count("*").alias("m"))
    before = F.lag("v").over(Window.partitionBy("g").orderBy("v"))
    level = level.withColumn("gap", F.when(F.col("v").isNotNull(), F.when(F.col("m") > 1, 0.0).otherwise(F.col("v") - before)))
    same = F.when(F.col("v").isNotNull(), F.col("m") * (F.col("m") - 1)).otherwise(0)
    known = F.sum(F.when(F.col("v").isNotNull(), F.col("m")))
    of = level.groupBy("g").agg(F.sum("m").alias("n"), F.sum(same).alias("zero"), F.min("gap").alias("low"), F.when(known > 1, F.max("v") - F.min("v")).alias("high"))
    n = F.col("n") * (F.col("n") - 1)
    none = F.lit(0).cast("long")
    counted = of.where("n > 1").select(F.lit(1).alias("layer"), n.alias("n_rows"), "zero", "low", "high", none.alias("repeated"), (n / 2).cast("long").alias("pairs"), n.alias("directed"), none.alias("conflicts"))
    far = rows.select(F.col("x").alias("y"), "g", F.col("v").alias("far"), F.col("odd").alias("far_odd"))
    odd = rows.where("odd").join(far, "g").where("x <> y").select("x", "y", F.abs(F.col("v") - F.col("far")).alias("distance"), "far_odd")
    odd = odd.select("x", "y", "distance").unionByName(odd.where("not far_odd").select(F.col("y").alias("x"), F.col("x").alias("y"), "distance"))
    written = pair_audit(odd.withColumn("layer", F.lit(1)), "layer").select(*counted.columns)
    add = [*[F.sum(c).alias(c) for c in ("n_rows", "zero")], F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(c).alias(c) for c in ("repeated", "pairs", "directed", "conflicts")]]
    met = rows.groupBy("g").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo <> hi").select("g")
    nodes = rows.join(met, "g", "left_semi").select("x").distinct().agg(F.count("*").alias("nodes"))
    return counted.unionByName(written).agg(*add).where("n_rows > 0").crossJoin(F.broadcast(nodes))


def nearest_by_value(values: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, src, dst, distance, rank): the k nodes of the same group with the nearest values, from (by, x, g, v), a row a node. Ties: larger ids first, then by id. Null groups and values have no neighbours.

    What knn_layer() chooses of all pairs within a group. A node's nearest have one of the k next values
    above or below, or its own; among those of one value they are the first k by id or the first k
    after the node, so each node meets at most (2k + 1) * 2k others however large its group is.
    """
    at = [*by, "g", "at"]
    rows = values.where("x is not null and g is not null and v is not null").select(*by, "x", "g", "v")
    levels = rows.select(*by, "g", "v").distinct().withColumn("at", F.row_number().over(Window.partitionBy(*by, "g").orderBy("v")))
    placed = cut(rows.join(levels, [*by, "g", "v"]).withColumn("n", F.row_number().over(Window.partitionBy(*at).orderBy("x"))), "placed")
    # how many of a value come up to a node's id
    there = placed.select(*at, "x", F.lit(None).cast("double").alias("own"), F.lit(1).alias("member"))
    asked = placed.select(*by, "g", F.explode(F.sequence(F.greatest(F.col("at") - k, F.lit(1)), F.col("at") + k)).alias("at"), "x", F.col("v").cast("double").alias("own"), F.lit(0).alias("member"))
    upto = F.sum("member").over(Window.partitionBy(*at).orderBy("x")).cast("int")
    asked = there.unionByName(asked).withColumn("upto", upto).where("member = 0")
    places = F.array_distinct(F.concat(F.sequence(F.lit(1), F.lit(k)), F.sequence(F.col("upto") + 1, F.col("upto") + k)))
    asked = asked.select(*at, F.col("x").alias("src"), "own", F.explode(places).alias("n"))
    both = asked.join(placed.select(*at, "n", F.col("x").alias("dst"), F.col("v").cast("double").alias("far")), [*at, "n"]).where("src <> dst")
    both = both.select(*by, "src", "dst", F.abs(F.col("own") - F.col("far")).alias("distance"))
    rank = F.row_number().over(Window.partitionBy(*by, "src").orderBy("distance", F.col("dst") < F.col("src"), "dst"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def symmetric(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The larger weight of both directions, in both."""
    both = edges.select(*by, "src", "dst", "w").unionByName(edges.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy(*by, "src", "dst").agg(F.max("w").alias("w"))


def mixed(a: DataFrame, b: DataFrame, weight: float, by: tuple[str, ...] = ()) -> DataFrame:
    """a + weight * b."""
    both = a.select(*by, "src", "dst", "w").unionByName(b.select(*by, "src", "dst", (F.col("w") * weight).alias("w")))
    return both.groupBy(*by, "src", "dst").agg(F.sum("w").alias("w"))


def normalised(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Weights as shares of their source's; a source without weight keeps zeros."""
    total = F.sum("w").over(Window.partitionBy(*by, "src"))
    return edges.select(*by, "src", "dst", F.when(total > 0, F.col("w") / total).otherwise(0.0).alias("w"))


def reweighted(edges: DataFrame, nodes: DataFrame, columns: list[str], h: float, by: tuple[str, ...] = ()) -> DataFrame:
    """w * exp(-|z_src - z_dst|^2 / 2h^2) over `columns` of `nodes` (by, node, ...); where the edges lack `by`, each of its values gets them all."""
    left = nodes.select(*by, F.col("node").alias("src"), *[F.col(c).alias(f"l_{c}") for c in columns])
    right = nodes.select(*by, F.col("node").alias("dst"), *[F.col(c).alias(f"r_{c}") for c in columns])
    gap = sum((F.pow(F.col(f"l_{c}") - F.col(f"r_{c}"), 2) for c in columns), F.lit(0.0))
    # the sources last, as what reads the weights mostly goes by them
    near = edges.join(right, ["dst", *[c for c in by if c in edges.columns]]).join(left, [*by, "src"])
    return near.select(*by, "src", "dst", (F.col("w") * F.exp(-gap / (2 * h * h))).alias("w"))


def smoothed(nodes: DataFrame, edges: DataFrame, columns: list[str], mix: float, by: tuple[str, ...] = (), connected: DataFrame | None = None) -> DataFrame:
    """(1 - mix) x + mix * the neighbours' weighted mean; nodes without neighbours keep theirs.

    Whether a node has neighbours is decided on `edges`, or on the graph `connected`, with those
    columns of `by` that it has, if given: there, a node whose weights in `edges` have all become 0 has a mean of 0.
    """
    far = nodes.select(*by, F.col("node").alias("dst"), *columns)
    on = [*[c for c in by if c in edges.columns], "dst"]
    own = [c for c in by if c in edges.columns]
    mean = normalised(edges, tuple(own)).join(far, on).groupBy(*by, F.col("src").alias("node")).agg(*[F.sum(F.col("w") * F.col(c)).alias(f"m_{c}") for c in columns], F.sum("w").alias("deg"))
    out = nodes.join(mean, [*by, "node"], "left")
    has = F.coalesce("deg", F.lit(0.0)) > 0
    if connected is not None:
        of = [c for c in by if c in connected.columns]
        out = out.join(connected.groupBy(*of, F.col("src").alias("node")).agg(F.sum("w").alias("linked")), [*of, "node"], "left")
        has = F.coalesce("linked", F.lit(0.0)) > 0
    blend = [F.when(has, (1 - mix) * F.col(c) + mix * F.coalesce(f"m_{c}", F.lit(0.0))).otherwise(F.col(c)).alias(c) for c in columns]
    return out.select(*by, "node", *blend)


def resmoothed(nodes: DataFrame, edges: DataFrame, columns: list[str], economic: list[str], mix: float, h: float, by: tuple[str, ...]) -> DataFrame:
    """smoothed() over reweighted() `edges`, which lack `by`; who has neighbours is decided on `edges`.

    The far end's columns go with an edge to its source, so the edges of all values of `by` are moved once.
    """
    far = nodes.select(*by, F.col("node").alias("dst"), *[F.col(c).alias(f"r_{c}") for c in dict.fromkeys([*columns, *economic])])
    own = nodes.select(*by, F.col("node").alias("src"), *[F.col(c).alias(f"l_{c}") for c in economic])
    gap = sum((F.pow(F.col(f"l_{c}") - F.col(f"r_{c}"), 2) for c in economic), F.lit(0.0))
    near = edges.join(far, "dst").join(own, [*by, "src"]).withColumn("w", F.col("w") * F.exp(-gap / (2 * h * h)))
    mean = near.groupBy(*by, F.col("src").alias("node")).agg(F.sum("w").alias("deg"), *[F.sum(F.col("w") * F.col(f"r_{c}")).alias(f"m_{c}") for c in columns])
    linked = edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("linked"))
    out = nodes.join(mean, [*by, "node"], "left").join(linked, "node", "left")
    m = lambda c: F.when(F.col("deg") > 0, F.col(f"m_{c}") / F.col("deg")).otherwise(0.0)
    return out.select(*by, "node", *[F.when(F.col("linked") > 0, (1 - mix) * F.col(c) + mix * F.coalesce(m(c), F.lit(0.0))).otherwise(F.col(c)).alias(c) for c in columns])


def labelled(edges: DataFrame, labels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Edges with the labels (by, node, label) of both ends; where the edges lack `by`, each of its values gets them all."""
    left, right = (labels.select(*by, F.col("node").alias(end), F.col("label").alias(name)) for end, name in (("src", "ls"), ("dst", "ld")))
    return edges.join(left, ["src", *[c for c in by if c in edges.columns]]).join(right, [*by, "dst"])


def _modularity(per: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """From each label's (by, ls, deg, inside)."""
    all_ = per.groupBy(*by).agg(F.sum("deg").alias("m"), F.sum("inside").alias("inside"), F.sum(F.col("deg") * F.col("deg")).alias("sq"))
    return all_.select(*by, (F.try_divide("inside", "m") - F.try_divide(F.col("sq"), F.col("m") * F.col("m"))).alias("modularity"))


def modularity(edges: DataFrame, labels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Newman's weighted modularity, one row for each value of `by`."""
    e = labelled(edges, labels, by)
    return _modularity(e.groupBy(*by, "ls").agg(F.sum("w").alias("deg"), F.sum(F.when(F.col("ls") == F.col("ld"), F.col("w")).otherwise(0.0)).alias("inside")), by)


def network_indices(edges: DataFrame, labels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """avi (mean isolability), avu (mean unifiability), anui = avi / (1 + avi * avu), mq (sum of isolabilities) and modularity, one row for each value of `by`.

    Internal weight counts twice, as both directions do. The edges are read once, into a table of the
    weight between each two labels, which everything else is made of.
    """
    between = labelled(edges, labels, by).groupBy(*by, "ls", "ld").agg(F.sum("w").alias("w"))
    same = F.col("ls") == F.col("ld")
    per = between.groupBy(*by, "ls").agg(F.sum(F.when(same, F.col("w")).otherwise(0.0)).alias("inner"), F.sum(F.when(~same, F.col("w")).otherwise(0.0)).alias("outer"))
    names = labels.select(*by, F.col("label").alias("ls")).distinct()
    per = names.join(per, [*by, "ls"], "left").fillna(0.0, ["inner", "outer"])
    iso = per.select(*by, F.coalesce(F.try_divide(F.col("inner"), F.col("inner") + F.col("outer")), F.lit(0.0)).alias("iso"))
    iso = iso.groupBy(*by).agg(F.avg("iso").alias("avi"), F.sum("iso").alias("mq"), F.count("*").alias("k"))
    a, b = per.select(*by, "ls", F.col("outer").alias("oa")), per.select(*by, F.col("ls").alias("ld"), F.col("outer").alias("ob"))
    cross = between.where(~same).join(a, [*by, "ls"]).join(b, [*by, "ld"])
    uni = cross.groupBy(*by).agg(F.coalesce(F.sum(F.try_divide(F.col("w"), F.col("oa") + F.col("ob") - F.col("w"))), F.lit(0.0)).alias("u"))
    mod = _modularity(per.select(*by, "ls", (F.col("inner") + F.col("outer")).alias("deg"), F.col("inner").alias("inside")), by)
    joined = iso.join(uni, list(by), "left").join(mod, list(by), "left") if by else iso.join(F.broadcast(uni)).join(F.broadcast(mod))
    avu = F.coalesce("u", F.lit(0.0)) / F.col("k")
    return joined.select(*by, "avi", avu.alias("avu"), (F.col("avi") / (1 + F.col("avi") * avu)).alias("anui"), "mq", "modularity")


def within(edges: DataFrame, ids: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """The edges of which both ends are in `ids` (node)."""
    for end in (a, b):
        edges = edges.join(ids.select(F.col("node").alias(end)).distinct(), end, "left_semi")
    return edges


def two_layers(nodes: DataFrame, first: DataFrame, second: DataFrame, columns: list[str], share: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, node, columns): the neighbours' mean with each layer normalised on its own, (1 - share) of the first and `share` of the second; a node with one layer takes it whole, one with none keeps its own. Layers without a column of `by` hold for all its values."""

    def mean(edges, name):
        far = nodes.select(*by, F.col("node").alias("dst"), *columns)
        total = F.sum("w")
        near = edges.where("w > 0").join(far, [*[c for c in by if c in edges.columns], "dst"])
        return near.groupBy(*by, F.col("src").alias("node")).agg(*[F.try_divide(F.sum(F.col("w") * F.col(c)), total).alias(f"{name}_{c}") for c in columns])

    both = nodes.join(mean(first, "a"), [*by, "node"], "left").join(mean(second, "b"), [*by, "node"], "left")
    return both.select(*by, "node", *[F.coalesce((1 - share) * F.col(f"a_{c}") + share * F.col(f"b_{c}"), f"a_{c}", f"b_{c}", c).alias(c) for c in columns])


def similarity_graph(near: DataFrame, k: int, h: float, by: tuple[str, ...] = ()) -> DataFrame:
    """exp(-d^2 / 2h^2) to each node's k nearest, from ranked neighbours (by, id, peer, distance, rank), made symmetric by the larger weight; weights of 0 go."""
    edges = near.where(F.col("rank") <= k).select(*by, F.col("id").alias("src"), F.col("peer").alias("dst"), F.exp(-F.pow(F.greatest("distance", F.lit(0.0)), 2) / (2 * h * h)).alias("w"))
    both = edges.unionByName(edges.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy(*by, "src", "dst").agg(F.max("w").alias("w")).where("w > 0")


def smoothed_by_similarity(nodes: DataFrame, near: DataFrame, columns: list[str], mix: float, ks: tuple[int, ...], hs: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, k, h, node, columns, edges): smoothed() over similarity_graph() for every k and h, and how many edges leave the node.

    The far ends' columns are moved once: sums are kept by ring, the least k that has the pair, and
    those of a k are the sums of its rings.
    """
    ks = sorted(ks)
    one = near.where(F.col("rank") <= ks[-1]).select(*by, F.col("id").alias("src"), F.col("peer").alias("dst"), "rank", "distance")
    both = one.unionByName(one.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"), "rank", "distance"))
    pairs = both.groupBy(*by, "src", "dst").agg(F.min("rank").alias("rank"), F.min("distance").alias("d"))
    ring = F.coalesce(*[F.when(F.col("rank") <= k, F.lit(k)) for k in ks])
    # times a power of two, so that products of the least weights keep their digits; means don't change
    weights = [(F.exp(-F.pow(F.greatest("d", F.lit(0.0)), 2) / (2 * h * h)) * 2.0**500).alias(f"w{i}") for i, h in enumerate(hs)]
    far = nodes.select(*by, F.col("node").alias("dst"), *[F.col(c).alias(f"r_{c}") for c in columns])
    near = pairs.join(far, [*by, "dst"]).select(*by, F.col("src").alias("node"), ring.alias("ring"), *weights, *[f"r_{c}" for c in columns])
    sums = [s for i in range(len(hs)) for s in (F.count_if(F.col(f"w{i}") > 0).alias(f"n{i}"), F.sum(f"w{i}").alias(f"deg{i}"), *[F.sum(F.col(f"w{i}") * F.col(f"r_{c}")).alias(f"m{i}_{c}") for c in columns])]
    rings = near.groupBy(*by, "node", "ring").agg(*sums)
    names = [c for c in rings.columns if c not in (*by, "node", "ring")]
    rings = rings.withColumn("k", F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: k >= F.col("ring"))))
    total = rings.groupBy(*by, "node", "k").agg(*[F.sum(c).alias(c) for c in names])
    each = F.explode(F.array(*[F.struct(F.lit(float(h)).alias("h"), F.col(f"n{i}").alias("n"), F.col(f"deg{i}").alias("deg"), *[F.col(f"m{i}_{c}").alias(f"m_{c}") for c in columns]) for i, h in enumerate(hs)]))
    total = total.select(*by, "node", "k", each.alias("e")).select(*by, "node", "k", "e.*")
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(h)).alias("h")) for k in ks for h in hs]))
    out = nodes.select(*by, "node", *columns, grid.alias("g")).select(*by, "node", *columns, "g.*").join(total, [*by, "node", "k", "h"], "left")
    blend = [F.when(F.col("deg") > 0, (1 - mix) * F.col(c) + mix * F.col(f"m_{c}") / F.col("deg")).otherwise(F.col(c)).alias(c) for c in columns]
    return out.select(*by, "k", "h", "node", *blend, F.coalesce("n", F.lit(0)).alias("edges"))


def weight_ratio(dynamic: DataFrame, static: DataFrame, by: str) -> DataFrame:
    """(by, ratio): each graph's total weight over the static graph's."""
    total = static.agg(F.sum("w").alias("total"))
    return dynamic.groupBy(by).agg(F.sum("w").alias("w")).join(F.broadcast(total)).select(by, F.try_divide("w", "total").alias("ratio"))


def mean_degree(edges: DataFrame, nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, mean_degree): edges that aren't 0 over nodes (by, node)."""
    n = nodes.groupBy(*by).agg(F.count("*").alias("n"))
    m = edges.where("w <> 0").groupBy(*by).agg(F.count("*").alias("m"))
    both = n.join(m, list(by), "left") if by else n.join(F.broadcast(m))
    return both.select(*by, (F.coalesce("m", F.lit(0)) / F.col("n")).alias("mean_degree"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each of `nodes` (node) can reach, itself where it has no edges.

    Links to what isn't among `nodes` don't count.
    """
    ids = cut(nodes.select("node").distinct(), "nodes")
    links = within(edges.where("w > 0").select("src", "dst"), ids).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return ids.join(linked.components(links), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: components, the size of the largest, and nodes without an edge."""
    sizes = components(edges, nodes).groupBy("component").agg(F.count("*").alias("n"))
    linked = edges.where("w > 0").select(F.col("src").alias("node")).distinct()
    alone = nodes.select("node").distinct().join(linked, "node", "left_anti").agg(F.count("*").alias("isolated"))
    return sizes.agg(F.count("*").alias("components"), F.max("n").alias("largest")).join(F.broadcast(alone))


def ego(edges: DataFrame, weights: DataFrame, centre: int, period: str = "period") -> DataFrame:
    """(dst, w, weights): a node's edges with the ordered list of their weights by period."""
    mine = edges.where(F.col("src") == centre).select("dst", "w")
    held = F.array_sort(F.collect_list(F.struct(period, F.col("w").alias("weight"))))
    by_period = weights.where(F.col("src") == centre).groupBy("dst").agg(F.transform(held, lambda x: x["weight"]).alias("weights"))
    return mine.join(by_period, "dst", "left")
