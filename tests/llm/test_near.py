"""Near-dedup against all pairs: whole tables of text, a large group of near copies, and chains."""

import duckdb
import numpy as np
import pytest

from weftline.llm import near_dedup

SF = "/root/testdata/sf0.001/documents.parquet"


def shingles(text, k=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ")
    for c in "\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def by_force(docs):
    """{id: (size, component)} by comparing every pair of distinct sets that share a shingle."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    firsts = {}
    for i, s in sets.items():
        if s:
            firsts.setdefault(s, i)
            root[max(find(i), find(firsts[s]))] = min(find(i), find(firsts[s]))
    for s, i in firsts.items():
        seen = {}
        for x in s:
            for j in holders[x]:
                if j > i and firsts[sets[j]] == j:
                    seen[j] = seen.get(j, 0) + 1
        for j, both in seen.items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def got(spark, docs):
    rows = near_dedup.near_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


def test_whole_table(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}'").fetchall()
    assert got(spark, docs) == by_force(docs)


@pytest.mark.parametrize("edits", [2, 5])
def test_large_near_group(spark, edits):
    """Copies of one text with random edits: many pairs are far apart, and the first copy is one of the farthest."""
    rng = np.random.default_rng(edits)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(300):
        words = list(base)
        for at in rng.integers(0, len(words), 3 * edits if i == 0 else int(rng.integers(0, edits + 1))):
            words[at] = f"x{i}_{at}"
        docs.append((i, " ".join(words)))
    assert got(spark, docs) == by_force(docs)


def test_shared_passage_is_no_link(spark):
    """Many texts with one long passage in common that isn't enough: they meet in buckets and stay apart, but for pairs of copies."""
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, f"{passage} " + " ".join(f"q{i // 2}_{j}" for j in range(30)) + (" end" if i % 2 else "")) for i in range(120)]
    assert got(spark, docs) == by_force(docs)
    assert len({c for _, c in got(spark, docs).values()}) == 60
