"""Connected components of a link table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.shared import cut

#: Links that one task joins; what is more is contracted first.
LINKS = 200_000


def _joined(links: DataFrame) -> DataFrame:
    """(node, component) of at most LINKS links, in one task: 16 bytes each, and a tree of their nodes."""

    def join(batches):
        root: dict = {}

        def top(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root.setdefault(a, a)
                root.setdefault(b, b)
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
        if root:
            nodes = list(root)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([top(x) for x in nodes], kind)], names=["node", "component"])

    of = dict(links.dtypes)["a"]
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[of]
    return links.coalesce(1).mapInArrow(join, f"node {of}, component {of}")


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """(node, component): for every node of `links` (a, b) the smallest node it can reach.

    While there are more than `most` links, nodes are contracted: a coin is tossed for each, tails
    with a neighbour that has heads become the smallest of those, and links are made distinct again.
    A fourth of the nodes go in a round, whatever the chains. The rest, which is bounded, is joined in
    one task, and names go back through the rounds. Links of a node to itself and repeated links do
    nothing; no links give an empty table.
    """
    most = LINKS if most is None else most
    once = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, gone = cut(once(links), "links"), []
    while now.count() > most:
        heads = lambda c: F.pmod(F.xxhash64(c, F.lit(len(gone))), F.lit(2)) == 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        into = cut(both.where(~heads("a") & heads("b")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("into")), "contracted")
        gone.append(into)
        for end in ("a", "b"):
            now = now.join(into, F.col(end) == F.col("node"), "left").withColumn(end, F.coalesce("into", end)).select("a", "b")
        now = cut(once(now), "links")
    known = cut(_joined(now), "joined")
    if not gone:
        return known
    for into in reversed(gone):
        named = into.join(known.select(F.col("node").alias("into"), "component"), "into", "left").select("node", F.coalesce("component", "into").alias("component"))
        alone = into.select(F.col("into").alias("node")).distinct().join(known, "node", "left_anti").select("node", F.col("node").alias("component"))
        known = cut(known.unionByName(alone).unionByName(named), "named")
    least = known.groupBy("component").agg(F.min("node").alias("least"))
    return known.join(least, "component").select("node", F.col("least").alias("component"))
