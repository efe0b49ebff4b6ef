"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble.

Lines are exploded once, as two 64-bit hashes and the row and position they came from, never as text.
Per hash the smallest and the largest document tell whether two documents hold it, and both are
summed on the map side, so a line that a third of all documents share is a few records per task; for
a higher threshold, the documents of those lines are counted. Lines that make up more than a
hundred-thousandth of all, of which there are at most as many, are looked up from a broadcast table.
Only the positions to drop go back to the documents, which then shuffle once, by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.columns import ascii_lower, free, let, strip, whole
from weftline.shared import cut

#: A line is hot beyond this share of all lines, so that there are at most 1 / share hot lines.
HOT_SHARE = 1e-5


def line_key(line: Column) -> Column:
    """White space stripped at both ends and A-Z lower-cased."""
    return ascii_lower(strip(line))


def lines_of(text: Column) -> Column:
    return F.split(whole(text), "\n", -1)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Every row of `docs` with `text_col` replaced by its kept lines, and n_lines, n_dropped appended.

    A line whose key has at least `min_chars` code points and is found in at least `min_docs`
    documents stays only in the smallest id that holds it, all its occurrences there included.
    Null or empty text is one empty line. Repeated ids are one document. Rows of null id are left
    as they are and don't count as documents. A text that loses all its lines is empty. A text
    takes time in proportion to its lines, however many. An empty table gives an empty result. Other columns pass through; n_lines and n_dropped are replaced.
    """
    if min_docs < 2:
        raise ValueError("a line is repeated when two documents hold it")
    key, row, drop = free(docs, "line_row", "row_hash", "drop_at")
    docs = docs.withColumn(row, F.xxhash64(F.col(id_col), whole(F.col(text_col))))
    hashed = lambda k, i: F.when(F.char_length(k) >= min_chars, F.struct(i.alias("pos"), F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2")))
    hashes = F.array_compact(F.transform(F.transform(lines_of(F.col(text_col)), line_key), hashed))
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(row).alias("row"), F.explode(hashes).alias("line")).select("id", "row", "line.*")
    lines = cut(lines, "lines")
    facts = lines.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
    shared = cut(facts.where((F.col("first") < F.col("last")) & (F.col("n") >= min_docs)).select("h1", "h2", "first", "n"), "shared_lines")
    if min_docs > 2:
        several = lines.join(shared.select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("docs"))
        shared = cut(shared.join(several.where(F.col("docs") >= min_docs).select("h1", "h2"), ["h1", "h2"], "left_semi"), "shared_lines")
    many = F.col("n") > max(1000, int(lines.count() * HOT_SHARE))
    hot, rest = shared.where(many).drop("n"), shared.where(~many).drop("n")
    dropped = lines.join(rest, ["h1", "h2"])
    if hot.limit(1).count():
        others = lines.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti")
        dropped = others.join(rest, ["h1", "h2"]).unionByName(lines.join(F.broadcast(hot), ["h1", "h2"]))
    dropped = dropped.where(F.col("id") != F.col("first"))
    dropped = dropped.groupBy(F.col("id").alias(key), F.col("row").alias(f"{key}_2")).agg(F.collect_set("pos").alias(drop))
    out = docs.join(dropped, (F.col(id_col) == F.col(key)) & (F.col(row) == F.col(f"{key}_2")), "left")
    lines = lines_of(F.col(text_col))
    kept = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop)))
    text = F.when(F.col(drop).isNull(), whole(F.col(text_col))).otherwise(let(lines, lambda ls: F.array_join(F.transform(kept, lambda i: F.get(ls, i)), "\n")))
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped") and c != row]
    return out.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in own],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.col(drop)), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    from weftline.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.doc_id, k.line, k.pos, s.first IS NOT NULL AND s.first <> k.doc_id AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
