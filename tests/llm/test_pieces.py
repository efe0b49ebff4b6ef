"""Sampled encodings don't depend on what else was learned, in which order, or on the store being emptied."""

import zlib

import numpy as np
import pytest

from weftline.llm import piece_sampling as ps


def stretches(n=3000):
    rng = np.random.default_rng(9)
    letters = list("etaoinshrdlu  éß日")
    out = ["".join(rng.choice(letters, int(k))) for k in rng.integers(1, 60, n)]
    return [*out, "x" * 500, "ab\ncd\t" * 400, "www.example.com/" + "path" * 40]


@pytest.fixture(scope="module")
def model():
    return ps.Lattices(ps.model_path(), 1.0)


def ids_of(model, texts):
    ids, bounds = model.encode(texts, np.arange(len(texts), dtype=np.uint64) * np.uint64(77))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def kept(model, text):
    """The stored sums of a stretch."""
    end, size = model.ends[text], len(text)
    first = model.first[end - size + 1 : end + 1]
    stop = int(first[-1])
    while model.below[stop] != 2**32 - 1:
        stop += 1
    return model.below[first[0] : stop + 1].tolist(), model.piece[first[0] : stop + 1].tolist(), model.back[first[0] : stop + 1].tolist()


def test_sums_do_not_depend_on_company(model):
    texts = sorted({" " + s.replace(" ", "") for s in stretches()})
    model.clear()
    model.learn(texts)
    together = [kept(model, t) for t in texts]
    for part in (texts[::-1][:500], texts[::7], texts[-40:]):
        model.clear()
        for at in range(0, len(part), 13):
            model.learn(part[at : at + 13])
        for t in part:
            assert kept(model, t) == together[texts.index(t)], t


def test_ids_do_not_depend_on_order_or_store(model):
    texts = stretches()
    model.clear()
    want = ids_of(model, texts)
    assert ids_of(model, texts) == want
    small = ps.Lattices(ps.model_path(), 1.0, most_edges=1000)
    got = []
    for at in range(0, len(texts), 100):
        ids, bounds = small.encode(texts[at : at + 100], np.arange(at, at + len(texts[at : at + 100]), dtype=np.uint64) * np.uint64(77))
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == want
    assert model.decode_all(np.concatenate([np.array(x, np.int64) for x in want]), np.concatenate(([0], np.cumsum([len(x) for x in want])))) == texts


def test_query_equals_operator(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(stretches(200))] + [(None, "a b"), (7, None)], "doc_id long, text string").repartition(3)
    ids = sorted((str(r["doc_id"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in ps.encode(docs).collect())
    assert ids == sorted((str(r["doc_id"]), r["ids_crc32"]) for r in ps.digests(docs).collect())
