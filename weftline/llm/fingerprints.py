"""Document fingerprints: a threshold-scaled sketch of word shingles, in DataFrame functions only.

Every shingle hash below a fixed fraction of the hash range is kept. Sketches of unequal documents
are therefore samples of the same hashes: they merge by union, and likeness and containment are
ratios of counts, however unequal the documents are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.columns import ascii_lower, free, strip, whole

WORDS, FRACTION_BITS = 5, 1  # five-word shingles; hashes below 2^(32 - 1), half of them, are kept
#: Rows of a range of with_next, about, and ranges in a first-level group of them.
RANGE_ROWS, FAN = 4000, 1000


def words_of(text: Column) -> Column:
    """Words between white space, A-Z lower-cased; one empty word for a text without any."""
    return F.split(strip(ascii_lower(text)), "[ \\t\\n\\x0B\\f\\r]+", -1)


def sketch_of(words: Column, k: int = WORDS, bits: int = FRACTION_BITS) -> Column:
    """Sorted distinct 32-bit shingle hashes below 2^(32 - bits), for a column of words.

    A text of fewer than k words is one shingle; one without words has none.
    """
    hashed = lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(words, i + j) for j in range(k)]), 32)
    many = F.transform(F.sequence(F.lit(0), F.size(words) - k), hashed)
    one = F.when(words[0] == "", F.array().cast("array<bigint>")).otherwise(F.array(F.shiftrightunsigned(F.xxhash64(words), 32)))
    all_ = F.when(F.size(words) >= k, many).otherwise(one)
    return F.array_sort(F.array_distinct(F.filter(all_, lambda h: h < (1 << (32 - bits)))))


def to_text(sketch: Column) -> Column:
    """Eight hexadecimal digits a hash, in order."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def from_text(fingerprint: Column) -> Column:
    """The sketch that to_text wrote."""
    return F.transform(F.regexp_extract_all(fingerprint, F.lit("[0-9a-f]{8}"), 0), lambda h: F.conv(h, 16, 10).cast("long"))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Estimated similarity of two shingle sets, from 0 to 1; where neither keeps a hash, whether the texts are the `same`."""
    both = F.size(F.array_intersect(a, b))
    n = F.size(a) + F.size(b) - both
    return F.when(n > 0, both / n).otherwise(same.cast("double")).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; null where a keeps no hash."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).cast("double")


def merge(a: Column, b: Column) -> Column:
    """The sketch of both documents' shingles."""
    return F.array_sort(F.array_union(a, b))


def fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fingerprint", k: int = WORDS, bits: int = FRACTION_BITS) -> DataFrame:
    """`docs` with the text's fingerprint as a string in `out` (a column of that name is replaced).

    Null text is empty; an empty fingerprint is ''. Texts of any length are read whole; equal texts
    have equal fingerprints, in repeated rows too. An empty table gives an empty result.
    """
    own = [c for c in docs.columns if c.lower() != out.lower()]
    (words,) = free(docs, "words")
    rows = docs.withColumn(words, words_of(whole(F.col(text_col))))
    return rows.select(*own, to_text(sketch_of(F.col(words), k, bits)).alias(out))


def range_starts(docs: DataFrame, id_col: str, rows: int = RANGE_ROWS, fan: int = FAN) -> list[list[int]]:
    """The least ids of ranges of about `rows` rows, in order, in groups of about `fan` ranges; [[0]] where no row has an id.

    Quantiles are taken of all ids, and where those make more ranges than a group holds, of each
    group's again, on the executors. What comes to the driver is 8 bytes for every `rows` rows.
    """
    n = docs.count()
    ranges = max(16, n // rows)
    marks = lambda k: [i / k for i in range(k)]
    upper = min(ranges, fan)
    got = docs.agg(F.min(id_col).alias("lo"), F.percentile_approx(id_col, marks(upper), max(10_000, 20 * upper)).alias("q")).first()
    starts = sorted({v for v in [got["lo"], *(got["q"] or [])] if v is not None}) or [0]
    if ranges <= fan:
        width = int(len(starts) ** 0.5) + 1
        return [starts[i : i + width] for i in range(0, len(starts), width)]
    lower = -(-ranges // fan)
    group = _at_most(_literal(starts), F.col(id_col))
    cells = docs.where(F.col(id_col).isNotNull()).groupBy(group.alias("g")).agg(F.min(id_col).alias("lo"), F.percentile_approx(id_col, marks(lower), max(10_000, 20 * lower)).alias("q")).collect()
    return [sorted({r["lo"], *r["q"]}) for r in sorted(cells, key=lambda r: r["g"])]


def _literal(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _at_most(values: Column, v: Column) -> Column:
    """The place of the last of sorted `values` that isn't more than v, the first where none is."""
    return F.greatest(F.size(F.filter(values, lambda x: x <= v)) - 1, F.lit(0))


def with_next(docs: DataFrame, id_col: str, value_cols: dict[str, Column], rows: int = RANGE_ROWS, fan: int = FAN) -> DataFrame:
    """`docs` (id_col and other columns) with the next row's values, in ascending id, the first row's after the last.

    The ids are cut into ranges of about `rows` rows at ids that are there; their bounds, 8 bytes a
    range, are broadcast as one row. Each range's first row is also sent to the range before it, so
    each range finds its successors alone and no task sees the whole order. value_cols are computed
    after rows are dealt, so what they hold isn't shuffled; their columns and next_* replace columns
    of those names, and no other column is touched. Rows of one id come in the order of their hash,
    rows of null id last. An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c.lower() not in {k.lower() for k in value_cols} | {f"next_{c}".lower() for c in [*docs.columns, *value_cols]}]
    docs = docs.select(*names)
    bounds, row, start, bucket, copy, b, extra = free(docs.select("*", *[F.lit(0).alias(c) for k in [*names, *value_cols] for c in (f"next_{k}",)], *[F.lit(0).alias(k) for k in value_cols]), "bounds", "row", "start", "bucket", "copy", "b", "extra")
    starts = range_starts(docs, id_col, rows, fan)
    width = max(map(len, starts))
    last = (len(starts) - 1) * width + len(starts[-1]) - 1
    table = docs.sparkSession.createDataFrame([(starts, [r[0] for r in starts])], f"`{bounds}` array<array<bigint>>, `{row}` array<bigint>")
    dealt = docs.join(F.broadcast(table)).withColumn(row, _at_most(F.col(row), F.col(id_col)))
    dealt = dealt.withColumn(start, F.get(bounds, F.col(row))).withColumn(bucket, F.when(F.col(id_col).isNull(), last).otherwise(F.col(row) * width + _at_most(F.col(start), F.col(id_col))))
    # the range before a group's first one is the last of the group before
    before = F.when(F.col(bucket) == 0, last).when(F.col(bucket) % width > 0, F.col(bucket) - 1).otherwise((F.col(row) - 1) * width + F.size(F.get(bounds, F.col(row) - 1)) - 1)
    here = F.struct(F.col(bucket).alias("b"), F.lit(0).alias("extra"))
    copies = F.when(F.array_contains(start, F.col(id_col)), F.array(here, F.struct(before.alias("b"), F.lit(1).alias("extra"))))
    dealt = dealt.withColumn(copy, F.explode(F.coalesce(copies, F.array(here)))).select(*names, F.col(copy)["b"].alias(b), F.col(copy)["extra"].alias(extra)).repartition(b)
    for name, value in value_cols.items():
        dealt = dealt.withColumn(name, value)
    order = Window.partitionBy(b).orderBy(extra, F.col(id_col).asc_nulls_last(), F.xxhash64(*names))
    whole_range = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    no_ids = starts == [[0]]
    for name in [c for c in dealt.columns if c not in (b, extra, id_col)]:
        following = F.lead(name).over(order)
        # where no row has an id, all are one range without a copy of its first row
        dealt = dealt.withColumn(f"next_{name}", F.coalesce(following, F.first(name).over(whole_range)) if no_ids else following)
    return dealt.where(F.col(extra) == 0).drop(b, extra)


def op7_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and its edited text's, and how alike they and the next document are."""
    from weftline.tables import table

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    pairs = with_next(docs, "doc_id", {"words": words_of(F.col("text")), "sketch": sketch_of(F.col("words"))})
    n = F.char_length("text")
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    pairs = pairs.drop("words", "next_words").withColumn("n_chars", n.cast("long"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring(F.col("next_text"), F.lit(1), cut))
    pairs = pairs.withColumn("edited", edited)
    pairs = pairs.withColumn("edited_words", words_of(F.col("edited")))
    pairs = pairs.withColumn("edited_sketch", sketch_of(F.col("edited_words")))
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return pairs.select(
        "doc_id", "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        to_text(a).alias("fingerprint"), to_text(b).alias("edited_fingerprint"),
        likeness(a, b, F.col("text") == F.col("edited")).alias("near_edited"),
        likeness(a, c, F.col("text") == F.col("next_text")).alias("near_next"),
        containment(a, b).alias("contained_in_edited"), containment(a, c).alias("contained_in_next"),
    )
