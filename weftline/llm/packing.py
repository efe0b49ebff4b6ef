"""Best-fit packing of tokenised documents: patterns by non-negative least squares, then best fit.

The plan is made from the histogram of piece lengths alone, which has at most `size` entries
whatever the corpus. Patterns of up to three pieces that fill a sequence are fitted to it by
non-negative least squares, repeat counts are rounded down, and what remains is packed best fit,
longest first, on counts. Pieces then find their places by their rank among pieces of their length,
which is summed from shards, so that a length that a third of all pieces has isn't one task.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.columns import small_batches
from weftline.shared import cut

SIZE, END = 1024, 2
_DOUBLE = re.compile(r"\s\s")
# before the last of several white-space characters (Unicode's, without Python's \x1c to \x1f) ahead of a word, which begins with it
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN_END = re.compile(f"(?<=[{_WHITE}])(?=[{_WHITE}][^{_WHITE}])")
_LONG = 100_000
_encoders: dict[str, tuple] = {}


def _byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself if printable, else the next free one from 256."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str, added: bool = False):
    """text -> ids of the byte-level BPE in a tokenizers JSON file, adding no special tokens.

    With `added`, added tokens that stand in the text are their ids, as the library reads texts unless
    its encode_special_tokens is set; without, they are read as plain text. The vocabulary of the file
    is run by tiktoken, five times faster than the library that wrote it and with the same ids
    (tests/llm compare the two). The look-ahead of the usual word pattern, which is slow, only matters
    where two white-space characters meet; other texts go without it. It fails on runs of a million
    white-space characters, so long texts are cut where it would end a run instead.
    """
    if path not in _encoders:
        import tiktoken

        letters = _byte_letters()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens") or []):
            raise ValueError(f"{path}: added tokens that depend on their surroundings aren't supported")
        ranks = {bytes(letters[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
        plain, full = (tiktoken.Encoding(f"own{i}", pat_str=words + p, mergeable_ranks=ranks, special_tokens={})._core_bpe for i, p in enumerate((r"|\s+", r"|\s+(?!\S)|\s+")))
        _encoders[path] = plain.encode_ordinary, full.encode_ordinary, special
    plain, full, special = _encoders[path]
    # longest first, as the library prefers the longest of those that begin at the same place
    apart = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")

    def ordinary(text: str) -> list[int]:
        if not _DOUBLE.search(text):
            return plain(text)
        return full(text) if len(text) < _LONG else [i for part in _RUN_END.split(text) for i in plain(part)]

    def encode(text: str) -> list[int]:
        if not any(t in text for t in special):
            return ordinary(text)
        return [i for k, part in enumerate(apart.split(text)) for i in ([special[part]] if k % 2 else ordinary(part))]

    return encode if added else ordinary


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each text's ids and the end id, cut where longer than `size`.

    The first piece is the shorter one. Null text is empty: one piece, the end id. Every row has its
    pieces, repeated rows and rows of null id too. `path` must be readable on the executors.
    """

    def cut_up(batches):
        encode = encoder(path, added=True)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = array("I", encode(text or ""))
                ids.append(END)
                n, at = len(ids), 0
                first = n % size or size
                for k in range(-(-n // size)):
                    part = ids[at : at + (size if k else first)]
                    row = (doc, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), list(part) if keep_ids else None)
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
                    at += len(part)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            m = 6 if keep_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out[:m], kinds, strict=False)], names=names[:m])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut_up, PIECES + ", ids array<int>" * keep_ids)


def _patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """All patterns of one to three of the given lengths that fill `size` exactly; short ones have zeros."""
    has = np.zeros(size + 1, bool)
    has[lengths] = True
    found = [(size, 0, 0)] if has[size] else []
    for a in lengths[lengths < size][::-1]:
        rest = size - a
        if rest <= a and has[rest]:
            found.append((a, rest, 0))
        b = np.arange(-(-rest // 2), min(a, rest - 1) + 1)
        b = b[has[b] & has[rest - b]]
        found += [(a, int(x), int(rest - x)) for x in b]
    return np.array(found, np.int64).reshape(-1, 3)


def _fit(hist: np.ndarray, patterns: np.ndarray, size: int, steps: int = 600) -> np.ndarray:
    """Repeat counts that fit the histogram: non-negative least squares, long lengths weighing more, by accelerated projected gradients."""
    weight = np.arange(size + 1, dtype=float) / size + 0.05
    weight[0] = 0
    at, m = patterns.ravel(), len(patterns)

    def forward(x):
        return weight * np.bincount(at, np.repeat(x, 3), size + 1)

    def back(r):
        return (weight * r)[at].reshape(m, 3).sum(1)

    v = np.ones(m)
    for _ in range(20):
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = z = np.zeros(m)
    t, target = 1.0, weight * hist
    for _ in range(steps):
        new = np.maximum(0, z - back(forward(z) - target) / (1.05 * norm))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, z, t = new, new + (t - 1) / t2 * (new - x), t2
    return x


def best_fit(hist: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and repeat counts that pack a histogram, longest first, each piece where it fits tightest; on counts, so as many steps as there are lengths and not pieces."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}

    def put(pattern, room, n):
        if n:
            group = open_.setdefault(room, {})
            group[pattern] = group.get(pattern, 0) + n

    for length in sorted(hist, reverse=True):
        left = hist[length]
        while left:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                break
            group = open_[room]
            pattern, n = group.popitem()
            if not group:
                del open_[room]
            used = min(n, left)
            put(pattern, room, n - used)
            put((*pattern, length), room - length, used)
            left -= used
        each = size // length
        put((length,) * each, size - each * length, left // each)
        rest = left % each
        put((length,) * rest, size - rest * length, int(rest > 0))
    return [(p, n) for group in open_.values() for p, n in group.items()]


def plan(hist: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with repeat counts; together they hold the histogram's pieces exactly."""
    left = np.zeros(size + 1, np.int64)
    for length, n in hist.items():
        left[length] = n
    out = []
    patterns = _patterns(np.flatnonzero(left), size)
    if len(patterns):
        x = _fit(left.astype(float), patterns, size)
        for k in np.argsort(-x, kind="stable"):
            p = [int(v) for v in patterns[k] if v]
            n = min(int(x[k] + 1e-6), *(int(left[v]) // p.count(v) for v in p))
            if x[k] < 1:
                break
            if n > 0:
                for v in p:
                    left[v] -= n
                out.append((tuple(p), n))
    return out + best_fit({int(v): int(left[v]) for v in np.flatnonzero(left)}, size)


def ranked(rows: DataFrame, shards: int) -> DataFrame:
    """`rows` with their rank from 0 among rows of equal length, each length dealt over `shards` tasks."""
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    within = rows.withColumn("rank", F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    sums = rows.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = sums.select("length", "shard", (F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")).alias("before"))
    return within.join(before, ["length", "shard"]).withColumn("rank", F.col("rank") + F.col("before")).drop("shard", "before")


def place(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """`rows` (doc_id, piece, length, ids_crc32 and any others) with sequence_id and offset.

    Every row is placed once; a sequence is filled without gaps from 0. An empty table gives an
    empty result.
    """
    hist = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    starts: dict[int, int] = {}
    keys, bases, offsets, base = [], [], [], 0
    for pattern, n in plan(hist, size):
        at = 0
        for length in pattern:
            keys.append((length << 44) + starts.get(length, 0))
            bases.append(base)
            offsets.append(at)
            starts[length] = starts.get(length, 0) + n
            at += length
        base += n
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    keys_, bases_, offsets_ = (np.array(v, np.int64)[order] for v in (keys, bases, offsets))

    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key = (length.to_numpy(np.int64) << 44) + rank.to_numpy(np.int64)
        k = np.searchsorted(keys_, key, "right") - 1
        return pd.DataFrame({"sequence_id": bases_[k] + key - keys_[k], "offset": offsets_[k]})

    shards = max(64, sum(hist.values()) // 1_000_000)
    own = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    return ranked(rows, shards).withColumn("slot", slot("length", "rank")).select(*own, "slot.sequence_id", "slot.offset")


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Tokenise, cut and pack all of `docs`: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Null text is empty and one piece of the end id; repeated rows and rows of null id are packed like
    others, each with its own pieces. Texts of any length are read whole. Pieces of equal length are
    interchangeable and placed in the order of id, piece and checksum within their shard. An empty
    table gives an empty result. Other columns aren't read.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with small_batches(docs.sparkSession):
        made = cut(pieces(docs, path, id_col, text_col, size), "pieces")
    return place(made, size)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    from weftline.tables import table

    return pack(table(spark, sf_dir, "documents"))
