"""Language ID on held-out documents, and packing against the tokenizers library and the least number of sequences."""

import math
import zlib

import duckdb
import numpy as np
import pytest

from weftline.llm import language_id, packing

SF = "/root/testdata/sf0.01"


def test_held_out_languages(spark):
    rows = {r["doc_id"]: r for r in language_id.op4_language_id(spark, SF).collect()}
    docs = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'").fetchall()
    assert set(rows) == {i for i, _, _ in docs}
    for i, text, _ in docs:
        r = rows[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    judged = [(rows[i]["lang_pred"], lang) for i, text, lang in docs if rows[i]["held_out"] and lang is not None and any(c.isalpha() for c in text or "")]
    right = [a == b for a, b in judged]
    assert len(right) > 200 and np.mean(right) >= 0.98
    for lang in {b for _, b in judged}:
        assert np.mean([a == b for a, b in judged if b == lang]) >= 0.95


def test_predictions_see_the_text_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out()))
    one = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, model).collect()}
    other = language_id.identify(docs.selectExpr("doc_id", "text", "'xx' as lang", "1 as lang_pred", "'s' as Score").repartition(3), model).collect()
    assert one == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in other}


def plainly(model, text):
    """Family and language by loops over bytes, machine by machine."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    data = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode("utf-8", "replace"))
    data = b" " + b" ".join(data.split()) + b" "
    codes = [((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32) >> 20 for a, b, c in zip(data, data[1:], data[2:])]
    margin = lambda k: sum(float(model.weights[i, k]) for i in codes) / max(1, len(codes)) + model.bias[k]
    sure = lambda v: 1 / (1 + math.exp(-max(-30.0, min(30.0, 2 * v))))
    family, score = model.names[0], 1.0
    if model.n_family == 1:
        family, score = (model.names[0], sure(margin(0))) if margin(0) >= 0 else (model.names[1], sure(-margin(0)))
    elif model.n_family:
        score, family = max((sure(margin(k)), name) for k, name in enumerate(model.names))
    wins = {lang: [] for lang in model.families[family]}
    for k, (of, a, b) in enumerate(model.pairs, model.n_family):
        if of == family:
            wins[a].append(margin(k))
            wins[b].append(-margin(k))
    lang = min(wins, key=lambda v: (-sum(m >= 0 for m in wins[v]), -min([1.0, *map(sure, wins[v])]), v))
    return lang, min([score, *map(sure, wins[lang])])


def test_op4_equals_plain_loops(spark):
    """Every prediction of the query, machine by machine, with the model that it learns."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out()).select("doc_id", "text", "lang"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.op4_language_id(spark, sf).collect()}
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    assert len(got) == len(texts) >= 200 and len({lang for lang, _ in got.values()}) > 3
    for i, text in texts:
        lang, score = plainly(model, text)
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-4), i


def test_machines_are_at_their_optimum():
    """Weights equal the sum of examples by twice their weighted hinge, which only the least squared-hinge loss has."""
    r = np.random.default_rng(2)
    y = np.where(np.arange(90) % 3 == 0, 1.0, -1.0)
    x = r.normal(0, 1, (90, 6)) + 0.8 * y[:, None]
    w = language_id._svm(x, y, c=1.0, epochs=2000)
    side = np.where(y > 0, (y < 0).mean() * 2, (y > 0).mean() * 2)
    force = 2 * side * np.maximum(0, 1 - y * (x @ w[:6] + w[6])) * y
    assert np.allclose(force @ x, w[:6], atol=2e-3) and abs(1e-3 * force.sum() - w[6]) < 1e-4


@pytest.fixture(scope="module")
def pieces(spark):
    return packing.op9_best_fit_packing(spark, SF).collect()


def test_pieces_equal_the_library(pieces):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for i, text in duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall():
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        bounds = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            want.add((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces} == want and len(pieces) == len(want)


def test_sequences_are_full_and_few(pieces):
    rooms: dict = {}
    for r in pieces:
        rooms.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in rooms.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 1024
    least = -(-sum(r["length"] for r in pieces) // 1024)
    assert least <= len(rooms) <= 1.01 * least + 2
