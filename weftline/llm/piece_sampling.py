"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

Each text is a lattice of all the ways to cut it into pieces of the model. Forward filtering sums
the weights of all cuts up to each place; backward sampling then draws one cut from its exact
distribution. The random numbers come from the row's key and the place in the text alone, so a rerun
on any number of executors draws the same. No piece crosses the start of a run of spaces, so the
lattice falls into independent stretches, whose forward sums are kept and reused.

The model file has ranks and no probabilities; a piece of rank r weighs (r + 10) ** -temperature,
the usual law of frequencies by rank. Characters without a piece, and the space mark itself where a
text has it, become byte pieces, so that decoding gives back every text.
"""

from __future__ import annotations

import itertools
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.columns import whole

MARK = "▁"
_STRETCH = re.compile(" +[^ ]*|[^ ]+")
_CELLS = 100_000  # characters of stretches summed at once; a longer stretch is summed alone
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits for each counter."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Lattices:
    """The model's pieces, and the forward sums of stretches met so far, up to a bounded number."""

    def __init__(self, path: str, temperature: float, most_edges: int = 8_000_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(self.size)]
        self.byte_ids = np.zeros(256, np.int64)
        pieces: dict[str, int] = {}
        self.as_bytes: list[bytes] = []
        for i, name in enumerate(names):
            if sp.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                self.as_bytes.append(bytes([int(name[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.as_bytes.append(b"")
            else:
                pieces[name.replace(MARK, " ")] = i
                self.as_bytes.append(name.replace(MARK, " ").encode())
        self.byte_data = np.frombuffer(b"".join(self.as_bytes), np.uint8)
        self.byte_size = np.array([len(x) for x in self.as_bytes])
        self.byte_start = np.cumsum(self.byte_size) - self.byte_size
        self.pieces, self.longest = pieces, max(map(len, pieces))
        self.weight = (np.arange(self.size) + 10.0) ** -temperature
        self.byte_weight = float(self.weight[-1])
        self._table(pieces)
        self.most = most_edges
        self.clear()

    def _table(self, pieces: dict[str, int]) -> None:
        """An open-addressing table from hashes to ids, for looking up many at once; beginnings of pieces are -2, empty slots -1."""
        entries = {name[:k]: -2 for name in pieces for k in range(1, len(name))} | pieces
        bits = 18
        while (1 << bits) < 4 * len(entries):
            bits += 1
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.slot_hash, self.slot_id = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int64)
        for name, i in entries.items():
            h = self._hash([ord(c) for c in name])
            at = (h * 0x9E3779B97F4A7C15 & (2**64 - 1)) >> int(self.shift)
            while self.slot_id[at] != -1:
                at = (at + 1) & self.mask
            self.slot_hash[at], self.slot_id[at] = h, i

    def _look_up(self, h: np.ndarray) -> np.ndarray:
        at = ((h * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        found = self.slot_id[at]
        todo = np.flatnonzero((found != -1) & (self.slot_hash[at] != h))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found[todo] = self.slot_id[at[todo]]
            todo = todo[(found[todo] != -1) & (self.slot_hash[at[todo]] != h[todo])]
        return found

    @staticmethod
    def _hash(codes) -> int:
        h = 1469598103934665603
        for c in codes:
            h = (h * 1099511628211 + c + 1) & (2**64 - 1)
        return h

    def clear(self) -> None:
        self.ends: dict[str, int] = {}
        self.n_edges, self.n_nodes = 0, 0
        self.below, self.piece, self.back = np.empty(1 << 16, np.uint32), np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32)
        self.first = np.empty(1 << 16, np.int32)

    def _store(self, n_edges: int, n_nodes: int) -> tuple[slice, slice]:
        """Room for more edges and nodes."""
        edges, nodes = slice(self.n_edges, self.n_edges + n_edges), slice(self.n_nodes, self.n_nodes + n_nodes)
        while edges.stop > len(self.below):
            self.below, self.piece, self.back = (np.concatenate([v, np.empty_like(v)]) for v in (self.below, self.piece, self.back))
        while nodes.stop > len(self.first):
            self.first = np.concatenate([self.first, np.empty_like(self.first)])
        self.n_edges, self.n_nodes = edges.stop, nodes.stop
        return edges, nodes

    def learn(self, stretches: list[str]) -> None:
        """Forward sums of new stretches, those of about equal length together; a stretch's don't depend on the others."""
        line, at = sorted(stretches, key=len), 0
        while at < len(line):
            to = at
            while to < len(line) and (to == at or (to - at + 1) * len(line[to]) <= _CELLS):
                to += 1
            self._forward(line[at:to])
            at = to

    def _forward(self, group: list[str]) -> None:
        n, width = len(group), len(group[-1])
        size = np.fromiter(map(len, group), np.int64, n)
        codes = np.frombuffer("".join([s.ljust(width, "\0") for s in group]).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(n, dtype=np.int32), size)
        col = (np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        h = np.full(len(row), 1469598103934665603, np.uint64)
        rows, ends, lengths, ids, weights = [], [], [], [], []
        for k in range(1, min(self.longest, width) + 1):
            inside = col + k <= size[row]
            row, col, h = row[inside], col[inside], h[inside]
            h = h * _U(1099511628211) + codes[row * width + col + k - 1] + _U(1)
            found = self._look_up(h)
            piece = found >= 0
            if k == 1 and not piece.all():  # a character without a piece: its bytes
                lone = np.flatnonzero(~piece)
                code = codes[row[lone] * width + col[lone]].astype(np.int64)
                n_bytes = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
                rows.append(row[lone])
                ends.append(col[lone] + 1)
                lengths.append(np.ones(len(lone), np.int32))
                ids.append(np.where(code < 128, self.byte_ids[np.minimum(code, 127)], self.size + code))
                weights.append(self.byte_weight**n_bytes)
            hit = found[piece]
            rows.append(row[piece])
            ends.append(col[piece] + k)
            lengths.append(np.full(len(hit), k, np.int32))
            ids.append(hit)
            weights.append(self.weight[hit])
            alive = found != -1
            row, col, h = row[alive], col[alive], h[alive]
        # edges in order of their nodes, the longest first, which mostly are the likeliest; each length's are in order already
        row, end, length, piece, weight = (np.concatenate(v[::-1]) for v in (rows, ends, lengths, ids, weights))
        starts = np.cumsum(size + 1) - size - 1
        node = starts[row] + end
        order = np.argsort(node, kind="stable")
        node, row, end, length, piece, weight = node[order], row[order], end[order], length[order], piece[order], weight[order]
        order = np.argsort(end.astype(np.uint16) if width < 1 << 16 else end, kind="stable")
        row, length, share = row[order], length[order], weight[order]
        bounds = np.searchsorted(end[order], np.arange(1, width + 2))
        total = np.zeros((n, width + 1))
        total[:, 0] = 1.0
        for j in range(1, width + 1):
            part = slice(bounds[j - 1], bounds[j])
            r = row[part]
            w = share[part] * total[r, j - length[part]]
            t = np.bincount(r, w, n)
            share[part] = w / t[r]
            total[:, j] = t
            # totals shrink by the weights of pieces; a common factor keeps those that are still needed in range
            small = (t > 0) & (t < 1e-150)
            if small.any():
                total[small, max(0, j - self.longest) : j + 1] *= 1e150
        # the sum of the shares up to each edge of a node, by itself
        sums, back = np.empty_like(share), np.empty_like(length)
        sums[order], back[order] = share, length
        new = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        nth = np.arange(len(node)) - np.repeat(new, np.diff(np.append(new, len(node))))
        at = np.flatnonzero(nth == 1)
        while len(at):
            sums[at] += sums[at - 1]
            at = at[at + 1 < len(nth)] + 1
            at = at[nth[at] > 0]
        below = np.minimum(np.floor(sums * 2.0**32), 2.0**32 - 1).astype(np.uint32)
        below[np.append(new[1:] - 1, len(node) - 1)] = 2**32 - 1
        edges, nodes = self._store(len(node), int((size + 1).sum()))
        self.below[edges], self.piece[edges], self.back[edges] = below, piece, back
        self.first[nodes] = -1
        self.first[nodes.start + node[new]] = edges.start + new
        self.ends.update(zip(group, (nodes.start + starts + size).tolist(), strict=True))

    def encode(self, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled ids of all texts in one array, and the bounds of each text in it; a text always begins with a space that decoding takes off."""
        if self.n_edges > self.most:
            self.clear()
        cut = []
        for t in texts:
            if MARK in t:
                t = t.replace(MARK, "" + MARK)
            cut.append(_STRETCH.findall(" " + t) if "  " in t or t[:1] == " " or t[-1:] == " " else [" " + w for w in t.split(" ")])
        flat = list(itertools.chain.from_iterable(cut))
        self.learn(sorted(set(flat).difference(self.ends)))
        count = np.array([len(c) for c in cut])
        node = np.fromiter(map(self.ends.__getitem__, flat), np.int64, len(flat))
        row = np.repeat(np.arange(len(texts)), count)
        place = np.arange(len(node)) - np.repeat(np.cumsum(count) - count, count)
        key = _mixed(seeds[row] + place.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        live, steps, taken = np.arange(len(node)), [], np.zeros(len(node), np.int64)
        step = 0
        while len(live):
            u = np.minimum(_mixed(key[live] + _U(step * 0xD1B54A32D192ED03 & (2**64 - 1))) >> _U(32), _U(2**32 - 2)).astype(np.uint32)
            e = self.first[node]
            miss = np.flatnonzero(u >= self.below[e])
            while len(miss):
                e[miss] += 1
                miss = miss[u[miss] >= self.below[e[miss]]]
            steps.append((live, self.piece[e]))
            taken[live] += 1
            node = node - self.back[e]
            more = self.first[node] >= 0
            live, node = live[more], node[more]
            step += 1
        base = np.concatenate(([0], np.cumsum(taken)))
        ids = np.empty(base[-1], np.int64)
        for k, (at, got) in enumerate(steps):
            ids[base[at] + taken[at] - 1 - k] = got
        bounds = base[np.concatenate(([0], np.cumsum(count)))]
        return self._bytes(ids, bounds) if len(ids) and ids.max() >= self.size else (ids, bounds)

    def _bytes(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece written as their byte pieces; a marked space mark loses the sign before it."""
        out, at = [], [0]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            part = ids[a:b]
            if (part >= self.size).any():
                wide: list[int] = []
                skip = False
                for k, i in enumerate(part.tolist()):
                    if i < self.size:
                        wide.append(i)
                        continue
                    code = i - self.size
                    if code == 0xE000 and not skip and k + 1 < len(part) and part[k + 1] == self.size + 0x2581:
                        skip = True  # the sign that encode() put before a space mark of the text
                        continue
                    skip = False
                    wide += self.byte_ids[list(chr(code).encode("utf-8", "replace"))].tolist()
                part = np.array(wide, np.int64)
            out.append(part)
            at.append(at[-1] + len(part))
        return np.concatenate(out), np.array(at)

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts that the ids between neighbouring bounds came from."""
        size = self.byte_size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.byte_start[ids] - ends + size, size)
        at += np.arange(len(at))
        data = self.byte_data[at].tobytes()
        marks = np.concatenate(([0], ends))[bounds].tolist()
        return [data[a:b].decode("utf-8", "replace")[1:] for a, b in zip(marks[:-1], marks[1:], strict=True)]

    def decode(self, ids) -> str:
        """The text that ids came from."""
        return self.decode_all(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0]


_lattices: dict[tuple, Lattices] = {}


def lattices(path: str, temperature: float) -> Lattices:
    key = (path, temperature)
    if key not in _lattices:
        _lattices[key] = Lattices(path, temperature)
    return _lattices[key]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _batches(texts: list[str], most: int = 2_000_000):
    """Runs of texts of about `most` characters, so that memory is bounded by the longest text."""
    at, total = 0, 0
    for k, t in enumerate(texts):
        if total + len(t) > most and k > at:
            yield at, k
            at, total = k, 0
        total += len(t)
    yield at, len(texts)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, temperature: float = 1.0, out: str = "ids") -> DataFrame:
    """`docs` with a sampled encoding of `text_col` in `out`, array<int> (a column of that name is replaced).

    The row's key is its id; equal ids and texts get equal ids in every run. A null id is a key of its
    own. Null and empty texts are one space mark. An empty table gives an empty result.
    """
    path = path or model_path()

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def sampled(key: pd.Series, text: pd.Series) -> pd.Series:
        model, all_ = lattices(path, temperature), text.tolist()
        seeds = np.fromiter((xxhash.xxh64_intdigest(f"{seed}:{k}") for k in key), np.uint64, len(key))
        got = []
        for a, b in _batches(all_):
            ids, bounds = model.encode(all_[a:b], seeds[a:b])
            ids = ids.astype(np.int32)
            got += [ids[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        return pd.Series(got, dtype=object)

    own = [c for c in docs.columns if c.lower() != out.lower()]
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return docs.select(*own, sampled(key, whole(F.col(text_col))).alias(out))


def decode(docs: DataFrame, path: str | None = None, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """`docs` with the text that `ids_col` was encoded from in `out` (a column of that name is replaced). Null and empty ids give an empty text; an empty table gives an empty result."""
    path = path or model_path()

    @F.pandas_udf(T.StringType())
    def decoded(ids: pd.Series) -> pd.Series:
        model, all_ = lattices(path, 1.0), [np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in ids]
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in all_], dtype=np.int64)))
        return pd.Series(model.decode_all(np.concatenate([np.zeros(0, np.int64), *all_]), bounds), dtype=object)

    own = [c for c in docs.columns if c.lower() != out.lower()]
    return docs.select(*own, decoded(F.col(ids_col)).alias(out))


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, temperature: float = 1.0) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_sha256, lossless) of encode() and decode(), without moving ids out of the worker."""
    path = path or model_path()
    import hashlib

    def run(batches):
        model = lattices(path, temperature)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            seeds = np.fromiter((xxhash.xxh64_intdigest(f"{seed}:{'' if k is None else k}") for k in keys), np.uint64, len(keys))
            for a, b in _batches(texts):
                ids, bounds = model.encode(texts[a:b], seeds[a:b])
                raw, marks = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
                back = model.decode_all(ids, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[a:b], pa.int64()), pa.array(np.diff(bounds)), pa.array([zlib.crc32(raw[x:y]) for x, y in zip(marks[:-1], marks[1:], strict=True)], pa.int64()),
                        pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in back]), pa.array([x == y for x, y in zip(back, texts[a:b], strict=True)]),
                    ],
                    names=["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean")


def op5_sentencepiece_sampling(spark, sf_dir: str) -> DataFrame:
    from weftline.tables import table

    return digests(table(spark, sf_dir, "documents"))
