"""N-gram Jaccard join: count vectors in an R-tree, with overlaps bounded by sums of minima.

A text is its set of distinct shingles. Shingles are hashed into groups, and the counts by group are
a point. Two sets overlap in at most the sum, over groups, of the lesser count; a box of points is
bounded in the same way by its greatest counts. Pairs whose bound is too low are never compared;
those that survive are confirmed on the whole sets.

In this many dimensions the boxes of unlike texts overlap, so one tree over all points would be
walked nearly whole for each of them. Its root is therefore a table of slices: hash ranges of the
shingles, one more than the greatest number of shingles by which two linked sets of that size can
differ. Such sets agree entirely in one slice at least, and a slice's shingles are a key: the cells
below it are joined by that key, without loss. Texts of equal sets are one class throughout.

1. In each cell, one class (the one that shares most cells) is compared with all others, a star and
   not all pairs, bounded first and confirmed on the sets. What is linked so is a part.
2. In cells that have several parts yet, trees of the points are joined box by box. Pairs of
   different parts that pass the bound link those parts to a cluster, a forest of them and no more.
3. The sets of an open cluster's classes are joined in the same way, and each pair that passes is
   confirmed at once unless its ends are already linked; so what comes out is a forest as well.

Cells and clusters of any size are dealt into blocks, and pairs of blocks to tasks; two blocks of a
cell's greatest part are never compared. No links are lost between different texts, and only as many
links are written as join them.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.columns import small_batches
from weftline.llm.components import components
from weftline.llm.near_dedup import BROADCAST_ROWS, _mix, _Words, shingle_set, verify
from weftline.shared import cut

#: Groups of hashes, a dimension each; a count is kept up to 255, which only loosens a bound.
GROUPS = 128
#: Sizes in a ratio of up to this share the number of slices.
BAND = 1.3
#: Points of a box, classes of a block, and shingles of a block of sets.
NODE, BLOCK, BLOCK_SHINGLES = 16, 512, 1 << 18


def differing(total, percent: int):
    """The most elements by which two sets of `total` elements together can differ and be linked."""
    return (100 - percent) * total // (100 + percent)


@lru_cache(maxsize=1024)
def slices(band: int, percent: int) -> tuple[int, np.ndarray]:
    """The number of slices for pairs whose smaller set is in the band, and where they begin."""
    small = int(np.ceil(BAND ** (band + 1)))
    most = differing(small + small * 100 // percent, percent) + 1
    return most, np.arange(1, most, dtype=np.uint64) * np.uint64((2**64 - 1) // most)


def bands(n: int, percent: int) -> list[int]:
    """The bands of the smaller sets that a set of n elements can be linked with, as the smaller or the larger."""
    of = lambda x: int(np.floor(np.log(x) / np.log(BAND) + 1e-9))
    least = -(-n * percent // 100)
    return list(range(of(max(1, least)), of(n) + 1))


def cell_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """A key for each slice of each band of a sorted set of hashes; none where only equal sets can be linked."""
    out = []
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(s ^ np.uint64(0x51CE)), dtype=np.uint64)))
    for band in bands(len(s), percent):
        n, starts = slices(band, percent)
        if n == 1:
            continue
        at = np.concatenate(([0], np.searchsorted(s, starts), [len(s)]))
        sums = total[at[1:]] - total[at[:-1]]
        out.append(_mix(_mix(sums + np.arange(n, dtype=np.uint64)) + np.uint64(band * 1_000_003 + 7)))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def counts(s: np.ndarray) -> np.ndarray:
    """The point of a set: how many of its hashes fall into each group."""
    return np.minimum(np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS), 255).astype(np.uint8)


class Tree:
    """A packed two-level R-tree of points: sorted by size and by their leading groups, boxes of NODE points with their least and greatest counts and sizes."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray):
        lead = points[:, :8].astype(np.int64) @ (8 ** np.arange(7, -1, -1))
        self.order = np.lexsort((lead, sizes))
        self.sizes, self.points = sizes[self.order], points[self.order].astype(np.int16)
        starts = np.arange(0, len(sizes), NODE)
        self.boxes = [(a, min(a + NODE, len(sizes))) for a in starts.tolist()]
        self.low, self.high = np.minimum.reduceat(self.points, starts), np.maximum.reduceat(self.points, starts)
        self.least, self.most = self.sizes[starts], self.sizes[[b - 1 for _, b in self.boxes]]

    def join(self, other: Tree, percent: int):
        """(i, j, apart) of all pairs of points that may be linked, `apart` the least number by which their sets differ; box by box."""
        for k, (a, b) in enumerate(self.boxes):
            # counts that two boxes can't have in common are differences of any pair from them
            gap = np.maximum(self.low[k] - other.high, 0).sum(1) + np.maximum(other.low - self.high[k], 0).sum(1)
            near = (100 * self.most[k] >= percent * other.least) & (100 * other.most >= percent * self.least[k])
            for m in np.nonzero(near & (gap <= differing(self.most[k] + other.most, percent)))[0]:
                c, d = other.boxes[m]
                total = self.sizes[a:b, None] + other.sizes[None, c:d]
                apart = np.abs(self.points[a:b, None] - other.points[None, c:d]).sum(2)
                # the sum of the lesser counts is half of what total and apart leave
                apart = np.maximum(apart, np.abs(self.sizes[a:b, None] - other.sizes[None, c:d]))
                i, j = np.nonzero(apart <= differing(total, percent))
                yield self.order[a + i], other.order[c + j], apart[i, j]


def candidates(sizes: list, points: list, sides: np.ndarray, percent: int):
    """Pairs of rows (i, j) of one block (sides all 0) or of two, that may be linked, the nearest first."""
    n, p = np.array(sizes, np.int64), np.frombuffer(b"".join(points), np.uint8).reshape(-1, GROUPS)
    left, right = np.nonzero(sides == 0)[0], np.nonzero(sides == 1)[0]
    one = not len(right)
    a = Tree(n[left], p[left])
    found = list(a.join(a if one else Tree(n[right], p[right]), percent)) if len(left) else []
    if not found:
        return []
    i, j, apart = (np.concatenate([f[k] for f in found]) for k in range(3))
    i, j = left[i], (left if one else right)[j]
    keep = i < j if one else slice(None)
    i, j, apart = i[keep], j[keep], apart[keep]
    order = np.lexsort((j, i, apart))
    return zip(i[order].tolist(), j[order].tolist(), strict=True)


class _Union(dict):
    def find(self, x):
        while (y := self.get(x, x)) != x:
            self[x] = x = self.get(y, y)
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self[max(a, b)] = min(a, b)
        return a != b


def sketch(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(doc, n, k1, k2, cells, point): the set's size, a 128-bit key of the whole set, its cells and its point."""

    def made(batches):
        words = _Words()
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, words, k)
                d = xxhash.xxh3_128_digest(s.tobytes())
                out.append((len(s), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), cell_keys(s, percent) if len(s) else [], counts(s).tobytes()))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            types = [*[pa.int64()] * 3, pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["doc", "n", "k1", "k2", "cells", "point"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(made, "doc long, n long, k1 long, k2 long, cells array<long>, point binary")


def bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose points don't rule a link out."""

    def keep(batches):
        for batch in batches:
            pa_, pb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, GROUPS).astype(np.int16) for c in (2, 3))
            total = batch.column(4).to_numpy()
            yield batch.filter(pa.array(np.abs(pa_ - pb).sum(1) <= differing(total, percent))).select([0, 1])

    of = lambda c: classes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("point").alias(f"p_{c}"))
    rows = pairs.join(of("a"), "a").join(of("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return rows.select("a", "b", "p_a", "p_b", (F.col("n_a") + F.col("n_b")).alias("total")).mapInArrow(keep, "a long, b long")


def in_blocks(rows: DataFrame, key: str, weight, most: int) -> DataFrame:
    """`rows` (key, rep, n, part, ...) with (i, j, side), copied to each pair of blocks of their key that they are in.

    A key's rows are dealt into blocks of `most` of the weight by a hash, those of its greatest part
    into blocks of their own, and every pair of blocks is listed but two of the greatest part's.
    """
    sizes = rows.groupBy(key, "part").agg(F.count("*").alias("c"), F.sum(weight).alias("w"))
    facts = sizes.groupBy(key).agg(F.max(F.struct("c", "part", "w")).alias("main"), F.sum("w").alias("w"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda w: F.ceil(w / most).cast("int")
    facts = facts.select(key, F.col("main.part").alias("main"), F.greatest(F.lit(1), blocks(F.col("main.w"))).alias("n_main"), F.greatest(F.lit(1), blocks(F.col("w") - F.col("main.w"))).alias("n_rest"))
    rows = rows.join(facts, key)
    of_main = F.col("part") == F.col("main")
    block = F.pmod(F.xxhash64("rep"), F.when(of_main, F.col("n_main")).otherwise(F.col("n_rest"))).cast("int") + F.when(of_main, F.col("n_rest")).otherwise(0)
    rows = rows.withColumn("block", block)
    all_blocks = F.sequence(F.lit(0), F.col("n_rest") + F.col("n_main") - 1)
    others = F.filter(all_blocks, lambda x: (x < F.col("n_rest")) | (F.col("block") < F.col("n_rest")))
    rows = rows.withColumn("other", F.explode(others)).withColumn("side", (F.col("block") > F.col("other")).cast("int"))
    return rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("block", "other", "main", "n_main", "n_rest")


def _groups(batches, columns: int):
    """Lists of the rows of each (key, i, j), which follow one another."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(columns)), strict=True):
            if row[:3] != now:
                if rows:
                    yield rows
                now, rows = row[:3], []
            rows.append(row)
    if rows:
        yield rows


def _pairs_of(found):
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def clusters(open_rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): parts that have a pair of classes in a cell whose points don't rule a link out; of each pair of blocks a forest. `open_rows`: (cell, rep, n, part, point)."""

    def joined(batches):
        for rows in _groups(batches, 7):
            parts, known = [r[5] for r in rows], _Union()
            pairs = candidates([r[4] for r in rows], [r[6] for r in rows], np.array([r[3] for r in rows]), percent)
            if found := [(parts[i], parts[j]) for i, j in pairs if known.join(parts[i], parts[j])]:
                yield _pairs_of(found)

    rows = in_blocks(open_rows, "cell", F.lit(1), BLOCK).select("cell", "i", "j", "side", "n", "part", "point")
    return rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(joined, "a long, b long").distinct()


def confirmed(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(a, b): links that join the parts of each cluster as all its links would. `members`: (cluster, rep, n, part)."""

    def joined(batches):
        words = _Words()
        for rows in _groups(batches, 7):
            sets = [shingle_set(r[6], words, k) for r in rows]
            known, found = _Union(), []
            for i, j in candidates([len(s) for s in sets], [counts(s).tobytes() for s in sets], np.array([r[3] for r in rows]), percent):
                # parts are named by classes of theirs, so a part and a class of the same number are the same component
                if known.find(rows[i][5]) == known.find(rows[j][5]):
                    continue
                a, b = sets[i], sets[j]
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    known.join(rows[i][5], rows[j][5])
                    found.append((rows[i][4], rows[j][4]))
            if found:
                yield _pairs_of(found)

    rows = in_blocks(members, "cluster", F.col("n") + 256, BLOCK_SHINGLES).select("cluster", "i", "j", "side", "rep", "part")
    n = rows.count()
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(rows) if n <= BROADCAST_ROWS // 4 else rows, "rep")
    rows = rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").select("cluster", "i", "j", "side", "rep", "part", "text")
    return rows.mapInArrow(joined, "a long, b long").distinct()


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of `docs`: texts with 100 * intersection >= percent * union of their sets of k-word shingles are linked.

    Words are what stands between white space, A-Z lower-cased; a text of fewer than k words is one
    shingle of all of them. Texts are read whole. Texts without words, null ones too, are linked with
    nothing. Rows of one id count as one document, linked with all that any of its texts is linked with. A row of null id
    has no component. An empty table gives an empty result. Other columns aren't read. Ids are cast
    to long.
    """
    with small_batches(docs.sparkSession):
        return _jaccard_groups(docs, id_col, text_col, k, percent)


def _jaccard_groups(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    all_rows = cut(sketch(docs, id_col, text_col, k, percent), "sketches")
    best = F.min_by(F.struct("n", "cells", "point"), F.col("doc"))
    classes = all_rows.where("n > 0 and doc is not null").groupBy("k1", "k2").agg(F.min("doc").alias("rep"), best.alias("s"))
    classes = cut(classes.select("k1", "k2", "rep", "s.n", "s.cells", "s.point"), "classes")
    links = _links(classes, docs, id_col, text_col, k, percent)
    parts = classes.select("k1", "k2", "rep").join(components(links), F.col("rep") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "rep").alias("part"))
    out = all_rows.select("doc", "n", "k1", "k2").join(parts, ["k1", "k2"], "left")
    part = F.when(F.col("doc").isNotNull(), F.when(F.col("n") > 0, F.least("part", "doc")).otherwise(F.col("doc")))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), part.alias("component_id"))


def _links(classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    cells = classes.select("rep", F.explode("cells").alias("cell"))
    shared = cut(cells.groupBy("cell").agg(F.count("*").alias("c"), F.min("rep").alias("a"), F.max("rep").alias("b")).where("c > 1"), "shared_cells")
    twos = shared.where("c = 2").select("a", "b").distinct()
    many = cut(cells.join(shared.where("c > 2").select("cell"), "cell"), "cells")
    wide = many.groupBy("rep").agg(F.count("*").alias("wide"))
    centres = many.join(wide, "rep").groupBy("cell").agg(F.max(F.struct("wide", -F.col("rep"))).alias("m")).select("cell", (-F.col("m.col2")).alias("centre"))
    star = many.join(centres, "cell").where("rep <> centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b"))
    points = classes.select("rep", "n", "point")
    pairs = cut(bounded(twos.unionByName(star).distinct(), points, percent), "pairs")
    links = cut(verify(pairs, docs, id_col, text_col, k, percent), "confirmed")
    parts = _named(many.select("cell", "rep"), components(links))
    open_cells = parts.groupBy("cell").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("cell")
    open_rows = cut(parts.join(open_cells, "cell").join(points, "rep").select("cell", "rep", "n", "part", "point"), "open_cells")
    joined = cut(clusters(open_rows, percent), "clusters")
    if not joined.limit(1).count():
        return links
    of = components(joined).select(F.col("node").alias("part"), F.col("component").alias("cluster"))
    members = _named(classes.select("rep", "n"), components(links)).join(of, "part").select("cluster", "rep", "n", "part")
    more = cut(confirmed(cut(members, "members"), docs, id_col, text_col, k, percent), "confirmed")
    return links.unionByName(more)


def _named(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """`rows` with `part`, the component of the class `rep`, itself where it is linked with nothing."""
    known = parts.select(F.col("node").alias("rep"), F.col("component").alias("known"))
    return rows.join(known, "rep", "left").withColumn("part", F.coalesce("known", "rep")).drop("known")


def op11_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    from weftline.tables import table

    return jaccard_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM d),
c AS (SELECT min(doc_id) AS rep, list_sort(sh) AS sh FROM s WHERE len(sh) > 0 GROUP BY list_sort(sh)),
x AS (SELECT rep, len(sh) AS n, unnest(sh) AS g FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY a.rep, b.rep),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 90 * (na + nb - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rep AS node, rep AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(m.root, s.doc_id) AS component_id
FROM s LEFT JOIN c ON list_sort(s.sh) = c.sh LEFT JOIN m ON m.node = c.rep
"""
