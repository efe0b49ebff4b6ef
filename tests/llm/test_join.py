"""N-gram Jaccard join against all pairs: random edits at every distance, blocks of a few rows, nulls and clashing names."""

import numpy as np
import pytest

from tests.llm.test_near import shingles
from weftline.llm import count_trees as ct

NAMES = "doc_id long, text string, cell string, rep string, part string, n string"


def by_force(docs, percent=90, k=3):
    """{id: (size, component)} from all pairs of texts; a null id has no component."""
    sets = [(i, shingles(t, k)) for i, t in docs]
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if None not in (i, j) and a and b and 100 * len(a & b) >= percent * len(a | b):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=repr)


def got(spark, docs, **how):
    rows = spark.createDataFrame([(*d, "x", "x", "x", "x") for d in docs], NAMES).repartition(4)
    return sorted((tuple(r) for r in ct.jaccard_groups(rows, **how).collect()), key=repr)


def edited(rng, words, times):
    words = list(words)
    for at in rng.choice(len(words), times, replace=False):
        words[at] = f"e{rng.integers(1 << 40)}"
    return words


def group(rng, n, length, most):
    base = [f"w{x}" for x in rng.integers(0, 1 << 30, length)]
    return [" ".join(edited(rng, base, int(rng.integers(0, most + 1)))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs():
    """Groups around the threshold, chains, short texts, unlike texts."""
    rng = np.random.default_rng(8)
    texts = [t for n, length, most in ((60, 150, 6), (40, 40, 2), (30, 400, 12), (12, 14, 1), (10, 10, 1), (8, 3000, 40)) for t in group(rng, n, length, most)]
    chain = [f"c{x}" for x in range(200)]
    for k in range(15):
        texts.append(" ".join([f"h{j}" for j in range(4 * k)] + chain[4 * k :]))
    texts += [" ".join(f"r{x}" for x in rng.integers(0, 50, 30)) for _ in range(40)]
    order = rng.permutation(len(texts)).tolist()
    return [(i, texts[k]) for i, k in enumerate(order)]


def test_all_pairs(spark, docs):
    assert got(spark, docs) == by_force(docs)


def test_blocks_of_a_few(spark, docs, monkeypatch):
    monkeypatch.setattr(ct, "BLOCK", 7)
    monkeypatch.setattr(ct, "BLOCK_SHINGLES", 3000)
    assert got(spark, docs) == by_force(docs)


def test_other_thresholds(spark, docs):
    assert got(spark, docs[::2], percent=75, k=2) == by_force(docs[::2], 75, 2)
    assert got(spark, docs[::3], percent=100) == by_force(docs[::3], 100)


def test_edges(spark):
    long = " ".join(f"x{i % 30_000}" for i in range(120_000))
    texts = [None, "", " \t\n\x0b\x0c\r", "One", "one", "one two", "ONE\tTWO", "é É", "é É", "É é", long, long + " end", "a " * 5000, "a a a"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, "One"), (None, "one"), (None, None)]
    assert got(spark, docs) == by_force(docs)
    assert ct.jaccard_groups(spark.createDataFrame([], NAMES)).count() == 0


def test_linked_sets_share_a_cell():
    rng = np.random.default_rng(1)
    for n in (9, 10, 19, 40, 95, 100, 130, 1000, 5000):
        for _ in range(20):
            base = np.sort(rng.integers(0, 2**63, n, np.uint64) * np.uint64(2))
            more = int(n / 0.9) - n
            cuts = int(rng.integers(0, more + 1))
            new = rng.integers(0, 2**63, max(0, int((n - cuts) / 0.9) - n), np.uint64)
            other = np.sort(np.concatenate((rng.permutation(base)[cuts:], new)))
            both = len(np.intersect1d(base, other))
            if 10 * both >= 9 * (len(base) + len(other) - both) and not np.array_equal(base, other):
                assert set(ct.cell_keys(base, 90).tolist()) & set(ct.cell_keys(other, 90).tolist())


def test_tree_finds_all_pairs_within_the_bound():
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 6, (30, ct.GROUPS))
    points = np.clip(centres[rng.integers(0, 30, 500)] + rng.integers(-1, 2, (500, ct.GROUPS)) * (rng.random((500, ct.GROUPS)) < 0.1), 0, 255).astype(np.uint8)
    sizes = points.astype(int).sum(1)
    apart = np.abs(points[:, None].astype(int) - points[None]).sum(2)
    total = sizes[:, None] + sizes[None]
    want = {(i, j) for i, j in zip(*np.nonzero(apart <= ct.differing(total, 90)), strict=True) if i < j and 100 * min(sizes[i], sizes[j]) >= 90 * max(sizes[i], sizes[j])}
    found = ct.candidates(sizes.tolist(), [p.tobytes() for p in points], np.zeros(500, int), 90)
    assert set(found) >= want and len(want) > 500
    # the bound holds: overlaps by sums of minima are never less than what sets of these counts can share
    least = np.minimum(points[:, None].astype(int), points[None]).sum(2)
    assert (2 * least == total - apart).all()
