"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest.

A chunk ends where the hash of the last 16 bytes has its top five bits clear (fewer where such places
are rare), so cuts depend on the bytes around them alone: an insertion moves the cuts beside it and
no others, and a passage that documents share is cut alike in each, but for its edges. Chunks are 32
bytes on average and keyed by digest. Neighbouring chunks that are repeated join to runs, and only
runs of `min_run` bytes or more count, so that common short phrases don't.

Documents are dealt into blocks of about 8 MB by a hash. A block hands out each of its digests once,
with the smallest and largest id that hold it, and gets those back that another id holds; places
never leave the block. So a passage that a third of all documents share is one row a block, summed
on the map side, and what goes back is looked up where the texts are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.columns import free, whole

_GEAR = np.random.default_rng(1_729).integers(0, 2**16, 256, dtype=np.uint16)
_STEP = 1 << 20
#: Bytes of text in a block, about: what a Python worker holds at once, beyond one text.
BLOCK = 8 << 20


def cuts(data: bytes, bits: tuple[int, ...] = (5, 3, 1), sparse: int = 128, longest: int = 4096) -> np.ndarray:
    """The ends of the chunks of `data`, the last one its length; none within a UTF-8 character.

    The gear hash h = (h << 1) + gear[byte] of 16 bits forgets a byte after 16 steps; it is summed
    for all places at once by doubling. Between two cuts more than `sparse` bytes apart, as in text
    that repeats a phrase without any, the next weaker condition cuts too: a passage longer than
    that is again cut alike wherever it stands. A stretch of `longest` bytes without a cut is cut.
    """
    found, n = [[] for _ in bits], len(data)
    whole_ = np.frombuffer(data, np.uint8)
    for at in range(0, n, _STEP):
        lo = max(0, at - 16)
        h = _GEAR[whole_[lo : at + _STEP]]
        for k in (1, 2, 4, 8):
            h[k:] = h[k:] + (h[:-k] << np.uint16(k))
        ends = np.flatnonzero(h[at - lo :] >> np.uint16(16 - bits[-1]) == 0)
        top = h[at - lo :][ends]
        ends = ends + at + 1
        good = (ends >= 16) & (ends < n)
        ends, top = ends[good], top[good]
        good = whole_[ends] & 0xC0 != 0x80
        for level, b in zip(found, bits, strict=True):
            level.append(ends[good & (top >> np.uint16(16 - b) == 0)])
    levels = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in found]
    ends = np.append(levels[0], n)
    for weaker in levels[1:]:
        gaps = np.diff(ends, prepend=0)
        if gaps.max(initial=0) <= sparse:
            break
        wide = gaps > sparse
        at = np.searchsorted(ends, weaker, "left")
        ends = np.union1d(ends, weaker[wide[at]])
    gaps = np.diff(ends, prepend=0)
    if gaps.max(initial=0) > longest:
        more = []
        for start, end in zip((ends - gaps).tolist(), ends.tolist(), strict=True):
            while end - start > longest:
                start += longest
                while whole_[start] & 0xC0 == 0x80:
                    start -= 1
                more.append(start)
            more.append(end)
        ends = np.array(more)
    return ends


def digests(data: bytes, ends: np.ndarray) -> np.ndarray:
    """64-bit digests of the chunks of `data` that end at `ends`."""
    view, at = memoryview(data), ends.tolist()
    return np.array([xxhash.xxh3_64_intdigest(view[x:y]) for x, y in zip([0, *at[:-1]], at, strict=True)], np.uint64).view(np.int64)


def runs(ends: np.ndarray, held: np.ndarray, min_run: int) -> list[tuple[int, int]]:
    """(start, end) in bytes of neighbouring `held` chunks, where they are `min_run` bytes or more together."""
    edge = np.diff(np.concatenate(([False], held, [False])).astype(np.int8))
    starts, stops = np.concatenate(([0], ends))[np.flatnonzero(edge == 1)], ends[np.flatnonzero(edge == -1) - 1]
    long = stops - starts >= min_run
    return list(zip(starts[long].tolist(), stops[long].tolist(), strict=True))


def _utf8(texts: pa.ChunkedArray):
    """Each text's bytes; null stays null."""
    for x in texts.cast(pa.binary()):
        yield x.as_py()


def held_digests(dealt: DataFrame, id_col: str, text_col: str, of: str) -> DataFrame:
    """(digest, block, first, last): each block's distinct digests and the smallest and largest id there. `of` is the column of blocks."""

    def gather(key, rows):
        found, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, data in zip(rows.column(id_col).cast(pa.int64()).to_numpy(), _utf8(rows.column(text_col)), strict=True):
            if data:
                d = np.unique(digests(data, cuts(data)))
                found.append(d)
                ids.append(np.full(len(d), i, np.int64))
        found, ids = np.concatenate(found), np.concatenate(ids)
        order = np.lexsort((ids, found))
        found, ids = found[order], ids[order]
        new = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))[: len(found)])
        last = np.append(new[1:], len(found))[: len(new)] - 1
        return pa.table({"digest": found[new], "block": np.full(len(new), key[0].as_py(), np.int64), "first": ids[new], "last": ids[last]})

    return dealt.groupBy(of).applyInArrow(gather, "digest long, block long, first long, last long")


def shared_digests(held: DataFrame) -> DataFrame:
    """(block, digest, first): for each block, those of its digests that two ids or more hold anywhere, and the smallest such id."""
    shared = held.groupBy("digest").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first < last").select("digest", "first")
    return held.select("block", "digest").join(shared, "digest").select("block", "digest", "first")


ADDED = "repeated boolean, n_repeated_bytes long, n_dropped_bytes long, n_spans long"


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = 96, block: int = BLOCK) -> DataFrame:
    """Every row of `docs`, its text without runs that a smaller id holds, with repeated, n_repeated_bytes, n_dropped_bytes and n_spans appended.

    `repeated` tells whether the text has any run that another document holds too, the first holder
    included; the n_spans dropped runs are those of chunks that a smaller id holds. Null and empty
    texts have no chunks and stay. Rows of null id stay as they are; rows of one id are one document.
    A very long text is one block by itself. An empty table gives an empty result. Appended names
    replace columns. The texts are dealt by the row, so copies under one id are spread as well.
    """
    added = [c.split()[0] for c in ADDED.split(", ")]
    own = [c for c in docs.columns if c.lower() not in added]
    docs = docs.select(*own)
    (of,) = free(docs, "block")
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    where = F.pmod(F.xxhash64(F.col(id_col).cast("long"), whole(F.col(text_col))), F.lit(total // block + 1))
    dealt = docs.where(F.col(id_col).isNotNull()).withColumn(of, where)
    # where there are no other columns, the texts are shuffled once for both uses
    shared = shared_digests(held_digests(dealt.select(*[c for c in dealt.columns if c in (id_col, text_col, of)]), id_col, text_col, of))

    def mark(key, rows, known):
        known_digest, known_first = known.column("digest").to_numpy(), known.column("first").to_numpy()
        order = np.argsort(known_digest)
        known_digest, known_first = np.append(known_digest[order], 0), known_first[order]
        texts, facts = [], []
        for i, data in zip(rows.column(id_col).cast(pa.int64()).to_numpy(), _utf8(rows.column(text_col)), strict=True):
            shared_runs, later_runs = [], []
            if data and len(known_first):
                ends = cuts(data)
                d = digests(data, ends)
                at = np.searchsorted(known_digest[:-1], d)
                hit = (known_digest[at] == d) & (at < len(known_first))
                shared_runs = runs(ends, hit, min_run)
                if shared_runs:
                    later_runs = runs(ends, hit & (known_first[np.minimum(at, len(known_first) - 1)] != i), min_run)
            size = lambda spans: sum(b - a for a, b in spans)
            facts.append((bool(shared_runs), size(shared_runs), size(later_runs), len(later_runs)))
            bounds = [0, *[x for span in later_runs for x in span], None]
            texts.append(b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)) if later_runs else data)
        out = rows.select(own).set_column(own.index(text_col), text_col, pa.array(texts, pa.binary()).view(pa.string()))
        for name, kind, values in zip(added, (pa.bool_(), *[pa.int64()] * 3), zip(*facts, strict=True) if facts else [[]] * 4, strict=True):
            out = out.append_column(name, pa.array(values, kind))
        return out

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [ADDED])
    marked = dealt.groupBy(of).cogroup(shared.groupBy("block")).applyInArrow(mark, schema)
    rest = docs.where(F.col(id_col).isNull()).select(*own, *[F.lit(v).cast(c.split()[1]).alias(c.split()[0]) for c, v in zip(ADDED.split(", "), (False, 0, 0, 0), strict=True)])
    return marked.unionByName(rest)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, repeated, n_repeated_bytes, n_dropped_bytes, n_spans, kept_sha256."""
    from weftline.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = dedup_substrings(docs)
    return got.select("doc_id", "repeated", "n_repeated_bytes", "n_dropped_bytes", "n_spans", F.sha2(whole(F.col("text")), 256).alias("kept_sha256"))
