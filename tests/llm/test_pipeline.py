"""The corpus pipeline against a plain version of each stage, and each stage on nulls, repeats and empty tables."""

import importlib.util
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.test_dedup import plain
from tests.llm.test_near import by_force
from weftline.llm import language_id, packing, pii
from weftline.shared import cut

pipeline = pytest.importorskip("corpus_pipeline") if importlib.util.find_spec("corpus_pipeline") else pytest.skip("no pipeline", allow_module_level=True)
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet'").fetchall()
    now = cut(pipeline.identify(spark, docs, SF))
    got = rows_of(now)
    letters = {i: any(c.isalpha() for c in t or "") for i, t, _, _ in source}
    assert now.columns == pipeline.COLUMNS and set(got) == {i for i, good in letters.items() if good}
    known = {i: lang for i, _, lang, _ in source if lang is not None and i in got}
    assert sum(got[i]["lang"] == lang for i, lang in known.items()) >= 0.97 * len(known)

    before, now = got, cut(pipeline.lines(spark, now, SF))
    got = rows_of(now)
    want = plain([(i, r["text"]) for i, r in before.items()], 2)
    assert {i: r["text"] for i, r in got.items()} == {i: t for i, (t, _) in want.items()}
    assert all(r["n_chars"] == len(r["text"]) and r["lang"] == before[i]["lang"] for i, r in got.items())

    before, now = got, cut(pipeline.near(spark, now, SF))
    got = rows_of(now)
    assert set(got) == {i for i, (_, c) in by_force([(i, r["text"]) for i, r in before.items()]).items() if c == i}
    assert all(r == before[i] for i, r in got.items())

    before, now = got, cut(pipeline.private(spark, now, SF))
    got = rows_of(now)
    spans = {r["id"]: r["spans"] for r in pii.find(spark.createDataFrame(list(before.values()), SCHEMA)).collect()}
    for i, r in got.items():
        text, at, out = before[i]["text"], 0, []
        for x in spans[i]:
            if x["start"] >= at:
                out += [text[at : x["start"]], f"<{pii.KINDS[x['kind']].upper()}>"]
            at = max(at, x["end"])
        assert r["text"] == "".join([*out, text[at:]]) and r["n_chars"] == len(r["text"])
    assert set(got) == set(before) and not any(re.search(r"[\w.]+@[\w-]+\.[\w.]+", r["text"]) for r in got.values())

    import public_tokenizers

    pieces = pipeline.packed(spark, now, SF).collect()
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"), added=True)
    lengths: dict = {}
    for r in pieces:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == {i: len(encode(r["text"])) + 1 for i, r in got.items()}
    run = pipeline.run(spark, SF)
    assert sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in run.collect()) == sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in pieces)


def odd(spark):
    rows = [(1, "the men of the town and the women", None, None, None), (1, "the men of the town and the women", None, None, None), (2, None, "en", "a", 0), (3, "", "en", "a", 0), (4, "12 34", None, "b", None),
            (None, "no id but the words are here", "en", None, 1), (5, "write to a.b@c.example.com now or never", "en", "c", 5), (6, "word " * 30_000, "en", "c", 5)]
    rows += [(100 + i, f"the boat number {i} went down the river with all men on board", "en", None, None) for i in range(9)]
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", Row_Hash string")


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stage_on_odd_rows_and_on_none(spark, name):
    stage = dict(pipeline.STAGES)[name]
    docs = odd(spark)
    got = stage(spark, docs, SF)
    ids = [r["doc_id"] for r in got.collect()]
    if name != "packing":
        assert got.columns == pipeline.COLUMNS
    assert (None in ids) and {1, 5, 6} <= set(ids)
    assert (4 in ids) == (name != "language_id") and (2 in ids) == (name != "language_id")
    assert ids.count(1) == 2
    assert stage(spark, docs.where(F.lit(False)), SF).count() == 0


def test_language_needs_no_labels_to_keep(spark):
    """Without labels nothing can be identified, and every document is `und`."""
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert language_id.identify(docs, language_id.fit(docs)).first()["lang_pred"] == "und"
