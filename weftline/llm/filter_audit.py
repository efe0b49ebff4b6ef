"""Filter interaction audit by Walsh-Hadamard sums.

Each document has a mask of the filters that it fails. Per part and label, 32 signed sums are
aggregated, one for each set w of filters: documents count +1 where they fail an even number of w and
-1 where an odd one. The sums meet map-side, so a part is a row per task whatever its documents. The
transform is its own inverse but for the factor 32, so the counts of all 32 masks come back exactly,
in integers. Every order of the filters and every step is then a sum over masks, and a filter's
Shapley count needs no orders: of the filters that a document fails, each is first in the same
number of orders, 120 over the number of its failures.

Texts are read once, into masks and 128-bit digests. Whether a smaller id holds the same text is
looked up by digest: the smallest id per digest is summed on the map side, and digests with more than
a hundred-thousandth of all rows, of which there are at most as many, come from a broadcast table.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.columns import let, whole
from weftline.shared import cut

FILTERS = "ABCDE"
_ALL = 1 << len(FILTERS)
#: What is counted of each part: all documents, those of good quality, toxic ones.
KINDS = ("n", "good", "toxic")
#: A text is hot beyond this share of the rows, so that there are at most 1 / share hot texts.
HOT_SHARE = 1e-5


def failures(text: Column) -> Column:
    """The bits A to D of a text: under 200 words; fewer distinct words than half; over 3 % of A-Z; any of `#$%&*|`."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    few = let(words, lambda w: F.when(F.size(w) < 200, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < 50 * F.size(w), 2).otherwise(0))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return few + F.when(100 * capitals > 3 * F.char_length(text).cast("long"), 4).otherwise(0) + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)


def masks(docs: DataFrame, labels: DataFrame | None, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(part, mask, good, toxic), a row for each row of `docs`."""
    text = whole(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), failures(text).alias("mask"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"))
    rows = cut(rows, "masks")
    facts = rows.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).where("first < last")
    facts = cut(facts.select("h1", "h2", "first", "n"), "copies")
    many = F.col("n") > max(1000, int(rows.count() * HOT_SHARE))
    hot, rest = facts.where(many).drop("n"), facts.where(~many).drop("n")
    if hot.limit(1).count():
        hot = F.broadcast(hot.withColumnRenamed("first", "hot_first"))
        rows = rows.join(hot, ["h1", "h2"], "left")
        # rows of a hot text have found what they look for; a salt keeps them from meeting in the next join
        near = F.col("hot_first").isNull()
        rest = rest.withColumn("salt", F.lit(0).cast("long"))
        rows = rows.withColumn("salt", F.when(near, F.lit(0)).otherwise(F.xxhash64("id"))).join(rest, ["h1", "h2", "salt"], "left")
        first = F.coalesce("first", "hot_first")
    else:
        rows, first = rows.join(rest, ["h1", "h2"], "left"), F.col("first")
    rows = rows.select("id", "part", (F.col("mask") + F.when(F.col("id") > first, 16).otherwise(0)).alias("mask"))
    if labels is None:
        return rows.select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    is_one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    marked = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(is_one("quality"), is_one("toxic")).where("quality = 1 or toxic = 1")
    out = rows.join(marked, "id", "left")
    return out.select("part", "mask", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def parity_sums(rows: DataFrame) -> DataFrame:
    """(part, n, good, toxic): for each kind an array of the 32 signed sums of a part."""
    weight = {"n": "1", "good": "good", "toxic": "toxic"}
    sums = [F.expr(f"sum(cast((1 - 2 * (bit_count(mask & {w}) % 2)) * {weight[k]} AS long)) AS {k}_{w}") for k in KINDS for w in range(_ALL)]
    return rows.groupBy("part").agg(*sums).select("part", *[F.array(*[F.col(f"{k}_{w}") for w in range(_ALL)]).alias(k) for k in KINDS])


def cells(sums: DataFrame) -> DataFrame:
    """(part, n, good, toxic): for each kind an array of the exact counts of the 32 masks."""
    each = F.sequence(F.lit(0), F.lit(_ALL - 1))

    def inverse(kind: str) -> Column:
        at = lambda m: F.aggregate(F.transform(F.col(kind), lambda s, w: s * (1 - 2 * F.pmod(F.bit_count(m.bitwiseAND(w)), F.lit(2)))), F.lit(0).cast("long"), lambda a, b: a + b)
        return F.transform(each, lambda m: F.call_function("div", at(m), F.lit(_ALL).cast("long"))).alias(kind)

    return sums.select("part", *[inverse(k) for k in KINDS])


def evaluate(counts: DataFrame) -> DataFrame:
    """Every order and step of the filters from the counts of the masks."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = [(o, k + 1, _mask(o[k]), _mask(o[: k + 1])) for o in orders for k in range(len(FILTERS))]
    at = lambda i: F.get(F.split(F.lit(",".join(str(s[i]) for s in steps)), ","), F.col("at"))
    rows = counts.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))))
    rows = rows.select("part", *KINDS, at(0).alias("filter_order"), *[at(i).cast("int").alias(c) for i, c in ((1, "step"), (2, "own"), (3, "upto"))])
    rows = rows.withColumn("earlier", F.col("upto").bitwiseXOR(F.col("own")))

    def total(kind: str, keep) -> Column:
        """The sum over the masks for which `keep` holds, times what it says."""
        return F.aggregate(F.transform(F.col(kind), lambda c, m: c * keep(m)), F.lit(0).cast("long"), lambda a, b: a + b)

    one = lambda where: F.when(where, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    gone = lambda m: m.bitwiseAND(F.col("earlier")) != 0
    removed = lambda m: one(fails(m) & ~gone(m))
    share = F.array(*[F.lit(factorial(len(FILTERS)) // max(1, bin(m).count("1"))).cast("long") for m in range(_ALL)])
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: one(m.bitwiseAND(F.col("upto")) == 0)).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: one(fails(m) & gone(m))).alias("redundant"),
        total("n", lambda m: one(m == F.col("own"))).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        total("n", lambda m: one(fails(m)) * F.get(share, m)).alias("shapley"),
    )


def _mask(filters: str) -> int:
    return sum(1 << FILTERS.index(f) for f in filters)


def audit(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part.

    Null text counts as empty, a null part as the empty string; texts are read whole. A row of null
    id never fails E and isn't an earlier copy; repeated rows of one id are rows of their own and no
    copies of one another. A document is good or toxic if any of its rows of `labels` says 1; ids
    without label, null labels and labels of null id count as neither; without `labels` nothing is
    lost of either. An empty table gives an empty result. Other columns aren't read.
    """
    return evaluate(cells(parity_sums(masks(docs, labels, id_col, text_col, part_col))))


def op13_filter_interaction_audit(spark, sf_dir: str) -> DataFrame:
    from weftline.tables import table

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT doc_id, part,
  [len(ws) < 200, 100 * list_unique(ws) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
   regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails FROM w),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS fs FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT fs, x.i AS step, fs[x.i] AS own, fs[1:x.i - 1] AS earlier FROM o, x),
r AS (SELECT g.*, s.*, fails[own] AS failed, len(list_filter(earlier, lambda k: fails[k])) > 0 AS gone, len(list_filter(fails, lambda v: v)) AS failures FROM g, s)
SELECT part, array_to_string(list_transform(fs, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, step,
  CAST(coalesce(sum(n) FILTER (WHERE NOT failed AND NOT gone), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (WHERE failed AND NOT gone), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (WHERE failed AND gone), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (WHERE failed AND failures = 1), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (WHERE failed AND NOT gone), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (WHERE failed AND NOT gone), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * (120 // greatest(failures, 1))) FILTER (WHERE failed), 0) AS BIGINT) AS shapley
FROM r GROUP BY part, fs, step
"""
