"""MinHash near-dedup by tensored banding, with every candidate confirmed on the whole sets.

Two collections of `m` small keys, each of two min-hashes, are computed per text. Table (i, j) is
keyed by the pair of key i of the first and key j of the second collection, so m * m tables of four
min-hashes cost 4 * m min-hashes and not 4 * m * m. A small key that one text alone has can't form a
shared pair, so the small keys are counted first and only shared ones are combined.

Texts of equal sets are one class. In each table bucket, one class is compared with all others (a star, not all pairs): the one with
the most small keys that others share, which most of a group is like. What the stars leave
unconnected is exact too: in later rounds, classes outside their bucket's main component, the
star's, are compared with the whole bucket, a bounded number of them a round, until every bucket is
either connected or fully compared. Only such outsiders are listed bucket by bucket; what they are
compared with is listed once per small key of the first collection and finds its buckets by the
second collection in the row. Two exact bounds rule pairs out before they are made: the shingles
that a class has alone, and 1024 bits of which each shingle flips one, so that two sets differ in at
least as many shingles as bits.
With m = 10, texts of similarity 0.75 share a table with probability 0.9995, of 0.8 with 0.99993.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.columns import small_batches
from weftline.llm.components import components
from weftline.shared import cut

_P = np.uint64(0x9E3779B97F4A7C15)
_ROW_CHUNK = 8192
#: Rows of (a, b) that may be broadcast: 16 bytes each, 3.2 MB.
BROADCAST_ROWS = 200_000


class _Words(dict):
    """64-bit hashes of words, kept up to a bounded number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, words: _Words, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles: A-Z lower-cased, words between white space; a shorter text is one shingle of all its words, a text without words none."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter((words[x] for x in found), np.uint64, len(found))
    k = min(k, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = h * _P + w[i : i + n]
    h = _mix(h)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def _coefficients(m: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_011)
    return r.integers(0, 2**63, 4 * m, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, 4 * m, np.uint64)


def small_keys(s: np.ndarray, m: int) -> list[int]:
    """2 * m keys of two min-hashes each; the first m are one collection, the others the second."""
    mul, xor = _coefficients(m)
    low = np.full(4 * m, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), _ROW_CHUNK):
        part = s[at : at + _ROW_CHUNK, None]
        low = np.minimum(low, ((part ^ xor) * mul).min(0))
    pair = low.reshape(2 * m, 2)
    return _mix(_mix(pair[:, 0] * _P + pair[:, 1]) + np.arange(2 * m, dtype=np.uint64)).view(np.int64).tolist()


def flips(s: np.ndarray) -> list[int]:
    """16 words of bits, each flipped as often as it is the top ten bits of a hash in the set."""
    odd = np.bincount((s >> np.uint64(54)).astype(np.int64), minlength=1024) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def signatures(docs: DataFrame, id_col: str, text_col: str, m: int, k: int) -> DataFrame:
    """(doc, n, k1, k2, keys, bits): the set's size, a 128-bit key of the whole set, the small keys and the flipped bits."""

    def sign(batches):
        words = _Words()
        for batch in batches:
            n, k1, k2, keys, bits = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, words, k)
                d = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                k1.append(int.from_bytes(d[:8], "little", signed=True))
                k2.append(int.from_bytes(d[8:], "little", signed=True))
                keys.append(small_keys(s, m) if len(s) else [])
                bits.append(flips(s) if len(s) else [])
            longs, lists = [pa.array(v, pa.int64()) for v in (n, k1, k2)], [pa.array(v, pa.list_(pa.int64())) for v in (keys, bits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, *lists], names=["doc", "n", "k1", "k2", "keys", "bits"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(sign, "doc long, n long, k1 long, k2 long, keys array<long>, bits array<long>")


def buckets(classes: DataFrame, m: int) -> DataFrame:
    """(u, v, rep, n, wide): the tables' buckets (u, v) that at least two classes share a small key of each collection for; `wide` is in how many of them a class is."""
    small = classes.select("rep", "n", F.posexplode("keys").alias("at", "small"))
    shared = small.groupBy("small").agg(F.count("*").alias("c")).where("c > 1").select("small")
    side = F.collect_list(F.when(F.col("at") < m, F.col("small"))), F.collect_list(F.when(F.col("at") >= m, F.col("small")))
    sides = small.join(shared, "small", "left_semi").groupBy("rep", "n").agg(side[0].alias("us"), side[1].alias("vs")).where("size(us) > 0 and size(vs) > 0")
    wide = F.size("us") * F.size("vs")
    return sides.select("rep", "n", wide.alias("wide"), F.explode("us").alias("u"), "vs").select("u", F.explode("vs").alias("v"), "rep", "n", "wide")


def _may_link(n1, n2, percent: int):
    return 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)


def verify(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """The (a, b) of `pairs` with 100 * intersection >= percent * union of their whole sets.

    The pairs of one `a` are dealt into blocks of about 256, and its text goes to each block, so a
    centre with any number of pairs is spread over tasks; a block streams and holds two sets.
    """
    count = pairs.groupBy("a").agg(F.count("*").alias("c"))
    dealt = pairs.join(count, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / 256)).alias("block"))
    wanted = dealt.select(F.col("b").alias("id"), "a", "block", F.lit(1).alias("turn"))
    wanted = wanted.unionByName(dealt.select(F.col("a").alias("id"), "a", "block", F.lit(0).alias("turn")).distinct())
    n = pairs.count()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted, "id")
    rows = rows.repartition("a", "block").sortWithinPartitions("a", "block", "turn").select("id", "a", "block", "turn", "text")

    def confirm(batches):
        words, now, sets = _Words(), None, []
        for batch in batches:
            a_out, b_out = [], []
            for b, a, block, turn, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = shingle_set(text, words, k)
                if turn == 0:
                    if now != (a, block):
                        now, sets = (a, block), []
                    sets.append(s)
                    continue
                for c in sets if now == (a, block) else []:
                    both = len(c) + len(s) - len(np.union1d(c, s))
                    if 100 * both >= percent * (len(c) + len(s) - both):
                        a_out.append(a)
                        b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(confirm, "a long, b long").distinct()


def single_counts(reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(rep, single): how many shingles of each of `reps` (rep) no other of them has; where none, no row."""

    def spread(batches):
        words = _Words()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_set(text, words, k).view(np.int64)
                for at in range(0, len(s), 100_000):
                    part = s[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), doc)), pa.array(part)], names=["rep", "shingle"])

    n = reps.count()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    reps = reps.select(F.col("rep").alias("id"))
    rows = texts.join(F.broadcast(reps) if n <= BROADCAST_ROWS else reps, "id", "left_semi").mapInArrow(spread, "rep long, shingle long")
    alone = rows.groupBy("shingle").agg(F.min("rep").alias("rep"), F.max("rep").alias("last")).where("rep = last")
    return alone.groupBy("rep").agg(F.count("*").alias("single"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", m: int = 10, k: int = 5, percent: int = 75, pivots: int = 16) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of `docs`.

    Texts are read whole, whatever their length; a batch of them is held at a time. Texts without
    words are linked with nothing. Texts of equal sets are linked. Rows of one id
    count as one document. A row of null id has no component and stays. An empty table gives an
    empty result. Other columns of `docs` aren't read.
    """
    with small_batches(docs.sparkSession):
        return _near_groups(docs, id_col, text_col, m, k, percent, pivots)


def _near_groups(docs: DataFrame, id_col: str, text_col: str, m: int, k: int, percent: int, pivots: int) -> DataFrame:
    sig = cut(signatures(docs, id_col, text_col, m, k), "signatures")
    best = F.min_by(F.struct("n", "keys", "bits"), F.col("doc"))
    classes = sig.where("n > 0 and doc is not null").groupBy("k1", "k2").agg(F.min("doc").alias("rep"), best.alias("s"))
    classes = cut(classes.select("k1", "k2", "rep", "s.n", "s.keys", "s.bits"), "classes")
    table = cut(buckets(classes, m), "buckets")
    centre = F.max(F.struct("wide", -F.col("rep"), "n"))
    centres = table.groupBy("u", "v").agg(centre.alias("c"), F.count("*").alias("size")).where("size > 1")
    centres = centres.select("u", "v", (-F.col("c.col2")).alias("a"), F.col("c.n").alias("an"))
    star = table.join(centres, ["u", "v"]).where((F.col("rep") != F.col("a")) & _may_link(F.col("n"), F.col("an"), percent))
    checked = cut(star.select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct(), "pairs")
    links = cut(verify(checked, docs, id_col, text_col, k, percent), "confirmed")
    parts = components(links)
    outside = cut(_outside(table, parts), "outside")
    if not outside.limit(1).count():
        return _labelled(sig, classes, parts)
    others = _near_outside(outside, classes, m)
    # `most`: the shingles that a class can share with any other here, which bounds its similarities
    single = single_counts(others, docs, id_col, text_col, k)
    others = others.join(single, "rep", "left").withColumn("most", F.col("n") - F.coalesce("single", F.lit(0)))
    others = cut(others.where(100 * F.col("most") >= percent * F.col("n")).select("rep", "n", "most", "keys", "bits"), "others")
    n_others, by_u, turn, seen = others.count(), None, 0, 0
    while True:
        if by_u is None:
            now = _with_part(others, parts, "rep", "part")
            by_u = cut(now.withColumn("u", F.explode(F.slice("keys", 1, m))).join(outside.select("u").distinct(), "u", "left_semi"), "by_key")
            largest = outside.agg(F.max(F.ceil(F.col("size") / pivots))).first()[0]
        if largest is None or seen >= largest:
            return _labelled(sig, classes, parts)
        until = seen + 8**turn
        mine = F.pmod(F.xxhash64("u", "v", "rep"), F.ceil(F.col("size") / pivots))
        pivot = outside.where((mine >= seen) & (mine < until)).groupBy("u", "rep").agg(F.collect_list("v").alias("vs")).join(by_u, ["u", "rep"])
        pivot = pivot.select("u", "vs", *[F.col(c).alias(f"p_{c}") for c in ("rep", "n", "most", "part", "keys", "bits")])
        both = F.least("most", "p_most")
        near = 100 * both >= percent * (F.col("n") + F.col("p_n") - both)
        near &= _differ(F.col("bits"), F.col("p_bits")) * (100 + percent) <= (100 - percent) * (F.col("n") + F.col("p_n"))
        # a pair is made in its first shared bucket alone, by the one of the two that is outside its main component
        near &= (F.col("u") == _first_shared(1, m)) & F.array_contains("vs", _first_shared(m + 1, m))
        found = by_u.join(pivot, "u").where((F.col("part") != F.col("p_part")) & _may_link(F.col("n"), F.col("p_n"), percent) & near)
        found = found.select(F.least("rep", "p_rep").alias("a"), F.greatest("rep", "p_rep").alias("b")).distinct()
        found = cut(found.join(checked, ["a", "b"], "left_anti"), "pairs")
        if found.limit(1).count():
            checked = checked.unionByName(found)
            more = cut(verify(found, docs, id_col, text_col, k, percent), "confirmed")
            if n_more := more.count():
                known = parts.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
                parts = components(known.unionByName(more))
                # parts that are out of date only make pairs of what is linked already; a few aren't worth new tables
                if 20 * n_more >= n_others:
                    rows = _with_part(_with_part(outside, parts, "rep", "part"), parts, "main", "main_part")
                    outside, by_u = cut(rows.where("part <> main_part").select(*outside.columns), "outside"), None
        turn, seen = turn + 1, until


def _with_part(rows: DataFrame, parts: DataFrame, of: str, name: str) -> DataFrame:
    """`rows` with the component of the class in column `of`, itself where it is linked with nothing."""
    known = parts.select(F.col("node").alias(f"{of}_node"), F.col("component").alias(f"{of}_part"))
    return rows.join(known, F.col(of) == F.col(f"{of}_node"), "left").select(*rows.columns, F.coalesce(f"{of}_part", of).alias(name))


def _outside(table: DataFrame, parts: DataFrame) -> DataFrame:
    """(u, v, size, main, rep): the rows of `table` outside the component of their bucket's centre, which is `main`. In a bucket of two the star has compared all."""
    here = _with_part(table, parts, "rep", "part")
    facts = here.groupBy("u", "v").agg(F.count("*").alias("size"), F.max(F.struct("wide", -F.col("rep"), "part")).alias("c"), F.min("part").alias("lo"), F.max("part").alias("hi"))
    facts = facts.where("lo <> hi and size > 2").select("u", "v", "size", (-F.col("c.col2")).alias("main"), F.col("c.part").alias("main_part"))
    return here.join(facts, ["u", "v"]).where("part <> main_part").select("u", "v", "size", "main", "rep")


def _near_outside(outside: DataFrame, classes: DataFrame, m: int) -> DataFrame:
    """(rep, n, keys, bits): the classes that have a small key of each collection in common with buckets that have outsiders."""
    ids = classes.select("rep", "n", "keys", "bits")
    for at, key in ((1, "u"), (m + 1, "v")):
        has = ids.select("rep", F.explode(F.slice("keys", at, m)).alias(key)).join(outside.select(key).distinct(), key, "left_semi")
        ids = ids.join(has.select("rep").distinct(), "rep", "left_semi")
    return cut(ids, "near_outside")


def _differ(a: Column, b: Column) -> Column:
    """In how many bits two sets of flipped bits differ, at most the size of their symmetric difference."""
    return reduce(add, (F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(16)))


def _first_shared(at: int, m: int) -> Column:
    """The least small key that `keys` and `p_keys` share in the collection that begins at `at`."""
    return F.array_min(F.array_intersect(F.slice("keys", at, m), F.slice("p_keys", at, m)))


def _labelled(sig: DataFrame, classes: DataFrame, parts: DataFrame) -> DataFrame:
    reps = classes.select("k1", "k2", "rep").join(parts, F.col("rep") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "rep").alias("part"))
    out = sig.select("doc", "n", "k1", "k2").join(reps, ["k1", "k2"], "left")
    part = F.when(F.col("n") > 0, F.least(F.col("part"), F.col("doc"))).otherwise(F.col("doc"))
    part = F.when(F.col("doc").isNotNull(), part)
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), part.alias("component_id"), F.col("doc").eqNullSafe(part).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of `docs` of which each near-duplicate group keeps one document, the smallest id."""
    gone = near_groups(docs, id_col, text_col, **how).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs[id_col] == F.col("gone_id"), "left_anti")


def op3_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    from weftline.tables import table

    return near_groups(table(spark, sf_dir, "documents"))
