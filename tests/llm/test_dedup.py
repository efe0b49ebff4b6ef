"""Exact and line dedup against Python: several filters, hot groups, and thresholds above two."""

import hashlib

import numpy as np
import pytest

from weftline.llm import exact_dedup, line_dedup


def table(n=600):
    rng = np.random.default_rng(8)
    docs = [(i, f"text {rng.integers(0, n)}" + " " * int(rng.integers(0, 4))) for i in range(n)]
    return [*docs, *[(n + i, "the  same\ttext") for i in range(n)], (5 * n, None), (5 * n + 1, " \n")]


@pytest.mark.parametrize("max_bits", [1 << 30, 4096, 1024])
@pytest.mark.parametrize("share", [1e-5, 1.0])
def test_groups(spark, monkeypatch, max_bits, share):
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", share)
    monkeypatch.setattr(exact_dedup, "_BITS", 256) if max_bits == 1024 else None
    docs = table()
    groups = {}
    for i, t in docs:
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r"), []).append((-len(t or ""), i))
    want = {i: (min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_groups(df, max_bits=max_bits).collect()}
    assert got == want
    if max_bits == 4096:
        assert sorted(r["doc_id"] for r in exact_dedup.exact_dedup(df, max_bits=max_bits).collect()) == sorted(i for i, w in want.items() if w[2])


def plain(docs, min_docs, min_chars=10):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(i)
    gone = lambda i, x: len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and min(holders[key(x)]) != i
    return {i: ("\n".join(x for x in (t or "").split("\n") if not gone(i, x)), sum(gone(i, x) for x in (t or "").split("\n"))) for i, t in docs}


@pytest.mark.parametrize("min_docs", [2, 3, 5])
def test_lines(spark, min_docs):
    rng = np.random.default_rng(3)
    line = lambda: rng.choice(["A line that everybody has", f"a line of some {rng.integers(0, 60)}", f"rare line {rng.integers(0, 10**6)}", "short", "", "  É padded Line \t", "é padded line"])
    docs = [(i, "\n".join(line() for _ in range(int(rng.integers(1, 30))))) for i in range(300)] + [(900, None), (901, ""), (902, "a line that everybody has\n" * 1200)]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), min_docs=min_docs).collect()}
    assert got == plain(docs, min_docs)


def test_hot_lines(spark):
    """One line in most places, over the limit from which lines are looked up from a broadcast table."""
    docs = [(i, "a very common line of text\nmy own line number %d" % i) for i in range(1500)]
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sum(r["n_dropped"] for r in got) == 1499 and all(r["text"].endswith(f"number {r['doc_id']}") for r in got)
    with pytest.raises(ValueError, match="two documents"):
        line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_docs=1)
