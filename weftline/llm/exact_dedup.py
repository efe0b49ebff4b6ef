"""Exact dedup: two-pass Bloom filtering.

One pass over the texts writes each row's digest, without its text. Pass 1 over the digests sets two
bits per row in a Bloom filter that records slots hit twice or more: only slot numbers shuffle,
summed on the map side. Pass 2 looks every row up in that filter, which is broadcast and of a bounded
size; rows with a slot hit once can't have an equal and pass straight through, and only the possibly
repeated ones shuffle, by their digest. False positives of the filter cost a shuffled row and never a
wrong result, since groups are formed on the whole digest. Beyond the rows that one filter has room
for, digests are dealt into slices by their hash, each with a filter of its own. Groups of more than
a hundred-thousandth of a slice's rows, of which there are at most as many, are looked up from a
broadcast table and never meet in a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.columns import free, no_spaces, whole
from weftline.shared import cut

#: Spark's bitmap functions keep 32,768 bits (4 KB) a row.
_BITS = 32_768
#: Bits of the filter for each row.
BITS_PER_ROW = 16
#: A group is hot beyond this share of the rows, so that there are at most 1 / share hot groups.
HOT_SHARE = 1e-5


def filter_bits(n_rows: int, max_bits: int = 1 << 30) -> int:
    """Bits of the filter: a power of two, 16 a row and at most 2^30 (128 MB), the proven bound of what is broadcast."""
    bits = _BITS
    while bits < min(n_rows * BITS_PER_ROW, max_bits):
        bits *= 2
    return bits


def _slots(digest: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(digest, F.lit(seed)), F.lit(bits)) for seed in (1, 2)]


def repeated_slots(digests: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap): the slots that two rows or more hit. At most bits / 32,768 rows of 4 KB."""
    slots = digests.select(F.explode(F.array(*_slots(F.col("digest"), bits))).alias("slot"))
    twice = slots.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")
    return twice.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap"))


def _is_set(bitmap: Column, slot: Column) -> Column:
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1, F.lit(False))


def _grouped(rows: DataFrame, n: int, bits: int, digest: str, best: Column, size: str, keep: str) -> DataFrame:
    """`rows` with the size of each one's group and the struct of its best row."""
    bitmaps = repeated_slots(rows.select(F.col(digest).alias("digest")), bits)
    s1, s2, b1, b2, key, hot = free(rows, "slot_1", "slot_2", "bits_1", "bits_2", "group_digest", "hot")
    slots = _slots(F.col(digest), bits)
    looked = rows.withColumn(s1, slots[0]).withColumn(s2, slots[1])
    for s, b in ((s1, b1), (s2, b2)):
        filt = F.broadcast(bitmaps.select(F.col("bucket").alias(f"{b}_of"), F.col("bitmap").alias(b)))
        looked = looked.join(filt, F.bitmap_bucket_number(s) == F.col(f"{b}_of"), "left").drop(f"{b}_of")
    maybe = _is_set(F.col(b1), F.col(s1)) & _is_set(F.col(b2), F.col(s2))
    looked = looked.withColumn(b1, maybe).drop(s1, s2, b2)
    alone = looked.where(~F.col(b1)).select(*rows.columns, F.lit(1).cast("long").alias(size), best.alias(keep))
    several = looked.where(F.col(b1)).drop(b1)
    # group facts are summed on the map side, so a group with a third of all rows is a few records
    facts = cut(several.groupBy(F.col(digest).alias(key)).agg(F.count("*").alias(size), F.min(best).alias(keep)), "groups")
    many = F.col(size) > max(1000, int(n * HOT_SHARE))
    hot_facts, rest = facts.where(many), facts.where(~many)
    if not hot_facts.limit(1).count():
        return alone.unionByName(several.join(rest, F.col(digest) == F.col(key)).drop(key))
    in_hot = several.join(F.broadcast(hot_facts), F.col(digest) == F.col(key)).drop(key)
    others = several.join(F.broadcast(hot_facts.select(F.col(key).alias(hot))), F.col(digest) == F.col(hot), "left_anti")
    return alone.unionByName(in_hot).unionByName(others.join(rest, F.col(digest) == F.col(key)).drop(key))


ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 1 << 30) -> DataFrame:
    """Every row of `docs`, without its text, with keep_id, group_size, kept and text_sha256 appended.

    Texts are equal when identical without white space. Of equal texts the row with the most code
    points stays, then the smallest id (null ids last). Null text counts as empty, and all empty
    texts are equal. Repeated rows (same id, same text) are members of one group; each of them is
    `kept` if their id is the one that stays, and a group that stays by a null id keeps its rows of
    null id. Texts of any length are read whole. An empty table gives an empty result. Other columns
    pass through; one that clashes with an appended name is replaced.
    """
    own = [c for c in docs.columns if c.lower() not in ADDED and c != text_col]
    digest, chars, size, keep, part = free(docs, "digest", "chars", "size", "keep", "slice")
    n = docs.count()
    slices = max(1, -(-n * BITS_PER_ROW // max_bits))
    sha = F.unhex(F.sha2(no_spaces(whole(F.col(text_col))), 256))
    rows = docs.select(*own, sha.alias(digest), F.char_length(whole(F.col(text_col))).alias(chars))
    rows = rows.withColumn(part, F.pmod(F.xxhash64(digest, F.lit(3)), F.lit(slices)).cast("int"))
    rows = cut(rows, "digests", part if slices > 1 else None)
    best = F.struct((-F.col(chars)).alias("chars"), F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"))
    bits = filter_bits(-(-n // slices), max_bits)
    out = reduce(DataFrame.unionByName, (_grouped(rows.where(F.col(part) == k) if slices > 1 else rows, n // slices, bits, digest, best, size, keep) for k in range(slices)))
    keep_id = F.col(keep)["id"]
    return out.select(*own, keep_id.alias("keep_id"), F.col(size).alias("group_size"), F.col(id_col).eqNullSafe(keep_id).alias("kept"), F.lower(F.hex(digest)).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 1 << 30) -> DataFrame:
    """The rows of `docs` that stay, with the columns of `docs` only. Rows that equal no other aren't shuffled with their texts."""
    key, other, sha = free(docs, "row_id", "row_sha", "sha")
    gone = exact_groups(docs.select(id_col, text_col), id_col, text_col, max_bits).where("not kept").select(F.col(id_col).alias(key), F.col("text_sha256").alias(other)).distinct()
    rows = docs.withColumn(sha, F.sha2(no_spaces(whole(F.col(text_col))), 256))
    return rows.join(gone, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(sha) == F.col(other)), "left_anti").select(*docs.columns)


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from weftline.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
h AS (SELECT doc_id, length(t) AS n, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM d),
g AS (SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id FROM h)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
