"""Fingerprints against exact sets, merging, and the query and the ranges of with_next against Python."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import fingerprints as fp

SF = "/root/testdata/sf0.01"


def texts():
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.fixture(scope="module")
def rows(spark):
    return {r["doc_id"]: r for r in fp.op7_document_fingerprints(spark, SF).collect()}


def test_query_equals_python(rows):
    docs, error = texts(), []
    for (i, t), (_, after) in zip(docs, [*docs[1:], docs[0]], strict=True):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        r = rows[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, r["near_edited"]), (after, r["near_next"])):
            a, b = shingles(t), shingles(other)
            error.append(abs(near - (len(a & b) / len(a | b) if a | b else float(t == other))))
            assert 0 <= near <= 1
    assert np.mean(error) < 0.03
    by_text = {}
    for i, t in docs:
        assert by_text.setdefault(t, rows[i]["fingerprint"]) == rows[i]["fingerprint"]
    assert sum(rows[i]["fingerprint"] == "" for i, t in docs if t.split()) <= 0.01 * len(docs)


def test_merge_and_containment(spark):
    a, b = [f"a{i} b{i} c{i}" for i in range(400)], [f"d{i} e{i}" for i in range(4000)]
    df = spark.createDataFrame([(" ".join(a), " ".join(a + b), " ".join(b))], "x string, both string, y string")
    s = lambda c: fp.sketch_of(fp.words_of(F.col(c)))
    r = df.select(fp.containment(s("x"), s("both")).alias("c"), fp.likeness(s("x"), s("both"), F.lit(False)).alias("l"), F.size(F.array_except(s("both"), fp.merge(s("x"), s("y")))).alias("lost"),
                  (fp.from_text(fp.to_text(s("x"))) == s("x")).alias("back")).first()
    assert r["c"] > 0.98 and abs(r["l"] - 1196 / 9196) < 0.03 and r["lost"] <= 4 and r["back"]


@pytest.mark.parametrize(("rows_", "fan"), [(4000, 1000), (7, 1000), (3, 5), (1, 2)])
def test_ranges_of_any_size(spark, rows_, fan):
    rng = np.random.default_rng(1)
    ids = sorted(rng.choice(5000, 200, replace=False).tolist())
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, v string").repartition(5)
    got = {r["id"]: r["next_v"] for r in fp.with_next(df, "id", {}, rows_, fan).collect()}
    assert got == {i: f"t{j}" for i, j in zip(ids, [*ids[1:], ids[0]], strict=True)}


def test_clashing_names_repeats_and_nulls(spark):
    df = spark.createDataFrame([(1, "a", "w", 5), (2, "b", "x", 6), (2, "b", "x", 6), (None, "n", "z", 7)], "id long, text string, words string, b int")
    got = fp.with_next(df, "id", {"n": F.length("text")}).collect()
    assert sorted((str(r["id"]), r["words"], r["b"], r["n"], r["next_words"]) for r in got) == [("1", "w", 5, 1, "x"), ("2", "x", 6, 1, "x"), ("2", "x", 6, 1, "z"), ("None", "z", 7, 1, "w")]
    out = fp.fingerprint(df.withColumnRenamed("words", "__words")).collect()
    assert sorted(r["__words"] for r in out) == ["w", "x", "x", "z"] and set(out[0].asDict()) == {"id", "text", "__words", "b", "fingerprint"}
    nulls = fp.with_next(spark.createDataFrame([(None, "a"), (None, "b")], "id long, v string"), "id", {}).collect()
    assert sorted(r["next_v"] for r in nulls) == ["a", "b"]
    assert fp.with_next(df.limit(0), "id", {}).count() == 0
