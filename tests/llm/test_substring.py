"""Substring dedup against a version in plain Python, and against all shared passages of 50 words."""

import duckdb
import numpy as np
import pytest

from weftline.llm import substring_dedup as sub

SF = "/root/testdata/sf0.01/documents.parquet"


def plain(docs, min_run=96):
    """{id: (repeated, text)} chunk by chunk."""
    cut, holders = {}, {}
    for i, text in docs:
        data = (text or "").encode()
        ends = sub.cuts(data).tolist() if data else []
        cut[i] = [(data[a:b], a, b) for a, b in zip([0, *ends[:-1]], ends, strict=True)] if data else []
        for c, _, _ in cut[i]:
            holders.setdefault(c, set()).add(i)
    out = {}
    for i, text in docs:
        spans = {}
        for later in (False, True):
            spans[later], run = [], None
            for c, a, b in [*cut[i], (None, -1, -1)]:
                held = c is not None and len(holders[c]) > 1 and (not later or min(holders[c]) != i)
                if held:
                    run = (run[0] if run else a, b)
                elif run:
                    spans[later] += [run] * (run[1] - run[0] >= min_run)
                    run = None
        data = (text or "").encode()
        kept = b"".join(data[a:b] for a, b in zip([0, *[b for _, b in spans[True]]], [*[a for a, _ in spans[True]], len(data)], strict=True))
        out[i] = (bool(spans[False]), None if text is None else kept.decode())
    return out


@pytest.fixture(scope="module")
def table(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}'").fetchall()
    got = sub.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), block=1 << 18).collect()
    return docs, {r["doc_id"]: r for r in got}


def test_equals_plain(table):
    docs, got = table
    assert {i: (r["repeated"], r["text"]) for i, r in got.items()} == plain(docs)
    for i, text in docs:
        assert got[i]["n_dropped_bytes"] == len((text or "").encode()) - len((got[i]["text"] or "").encode())


def test_shared_passages_are_found(table):
    """Every document with 50 words in a row that another document has too is flagged, and hardly any that shares no ten (junk that repeats one word can)."""
    docs, got = table
    words = {i: (t or "").split() for i, t in docs}

    def shared(n):
        seen = {}
        for i, w in words.items():
            for k in range(len(w) - n + 1):
                seen.setdefault(hash(tuple(w[k : k + n])), set()).add(i)
        return {i for ids in seen.values() if len(ids) > 1 for i in ids}

    passages = shared(50)
    assert len(passages) > 100 and sum(got[i]["repeated"] for i in passages) / len(passages) == 1.0
    flagged = {i for i, r in got.items() if r["repeated"]}
    assert len(flagged - shared(10)) <= 0.01 * len(flagged)


def test_blocks_do_not_matter(spark):
    rng = np.random.default_rng(4)
    passage = " ".join(f"p{x}" for x in rng.integers(0, 999, 120))
    docs = [(i, " ".join(f"a{x}" for x in rng.integers(0, 10**6, 80)) + f" {passage} " + " ".join(f"b{x}" for x in rng.integers(0, 10**6, 50))) for i in range(60)]
    df = spark.createDataFrame([*docs, *docs[:5]], "doc_id long, text string")
    one, many = ({(r["doc_id"], r["repeated"], r["text"]) for r in sub.dedup_substrings(df, block=b).collect()} for b in (1 << 30, 500))
    assert one == many and all(repeated for _, repeated, _ in one)
    assert sum(passage[200:-200] in text for _, _, text in one) == 1


def test_forced_cuts():
    """Text without any cut of its own is cut at 4096 bytes, in whole characters."""
    data = ("é" * 10_000).encode()
    ends = sub.cuts(data)
    assert ends[-1] == len(data) and np.diff(ends, prepend=0).max() <= 4096 and all(e % 2 == 0 for e in ends.tolist())
