"""Language ID by hierarchical discrimination: the family first, then pairs of languages within it.

Texts become relative frequencies of hashed byte trigrams of their lower-cased letters. Linear
support vector machines, one against the rest, choose the family; within it, one machine for each
pair of languages votes. The machines are fitted on the driver from at most `per_lang` labelled
documents a language, whose features are counted on the executors, over their whole texts.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.columns import free, small_batches

# fixed values: language families by ISO 639-1 code; a code that isn't here is a family of its own
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

DIMS = 4096
_CHUNK = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
_ASCII = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str) -> bool:
    """Whether any code point is a letter (Unicode category L)."""
    m = _LETTER.search(text)
    while m and not m.group().isalpha():
        m = _LETTER.search(text, m.end())
    return m is not None


def _codes(data: bytes):
    """Trigram codes of `data`, a chunk at a time so that memory stays bounded for any length."""
    for at in range(0, len(data), _CHUNK):
        b = np.frombuffer(data, np.uint8, count=min(_CHUNK + 2, len(data) - at), offset=at).astype(np.uint32)
        if len(b) > 2:
            yield (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)


def _prepared(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_ASCII).split()) + b" "


def features(text: str) -> np.ndarray:
    """Relative frequencies of the text's trigrams, DIMS of them."""
    total = np.zeros(DIMS)
    for codes in _codes(_prepared(text)):
        total += np.bincount(codes, minlength=DIMS)
    return total / max(1.0, total.sum())


def _svm(x: np.ndarray, y: np.ndarray, c: float = 100.0, epochs: int = 60) -> np.ndarray:
    """Weights of a linear support vector machine with squared hinge loss, by dual coordinate descent; y is 1 or -1, each side weighs the same."""
    gram = x @ x.T + 1e-3
    side = np.where(y > 0, (y < 0).sum(), (y > 0).sum()) / len(y) * 2
    diag = 1.0 / (2 * c * np.maximum(side, 1e-6))
    alpha, f = np.zeros(len(y)), np.zeros(len(y))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(y)):
            step = max(-alpha[i], -(y[i] * f[i] - 1 + diag[i] * alpha[i]) / (gram[i, i] + diag[i]))
            if step:
                alpha[i] += step
                f += step * y[i] * gram[i]
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return np.append((alpha * y) @ x, 1e-3 * (alpha * y).sum())


_SCALE = 30.0


class Model:
    """Families, their machines, and a machine for each pair of languages of a family."""

    def __init__(self, langs: list[str], x: np.ndarray, label: np.ndarray):
        self.families: dict[str, list[str]] = {}
        for lang in sorted(langs):
            self.families.setdefault(_FAMILY.get(lang, lang), []).append(lang)
        names = sorted(self.families)
        self.names, self.pairs, rows = names, [], []
        x, family = x * _SCALE, np.array([_FAMILY.get(v, v) for v in label])
        self.n_family = 0 if len(names) < 2 else 1 if len(names) == 2 else len(names)
        for name in names[: self.n_family]:
            rows.append(_svm(x, np.where(family == name, 1.0, -1.0)))
        for name in names:
            for a, b in itertools.combinations(self.families[name], 2):
                here = (label == a) | (label == b)
                rows.append(_svm(x[here], np.where(label[here] == a, 1.0, -1.0)))
                self.pairs.append((name, a, b))
        w = np.array(rows).reshape(len(rows), DIMS + 1)
        self.weights, self.bias = np.ascontiguousarray(w[:, :DIMS].T * _SCALE, np.float32), w[:, DIMS]

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.weights.shape[1]), 0
        for codes in _codes(_prepared(text)):
            counts = np.bincount(codes, minlength=DIMS)
            total += counts @ self.weights
            n += len(codes)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and how sure it is, from 0 to 1; `und` and 0 for a text without letters or with nothing learned."""
        if text is None or not self.names or not has_letter(text):
            return "und", 0.0
        m = self.margins(text)
        sure = lambda v: 1 / (1 + math.exp(-max(-30.0, min(30.0, 2 * v))))
        score, name = 1.0, self.names[0]
        if self.n_family == 1:
            name, score = (name, sure(m[0])) if m[0] >= 0 else (self.names[1], sure(-m[0]))
        elif self.n_family:
            best = int(np.argmax(m[: self.n_family]))
            name, score = self.names[best], sure(m[best])
        votes = dict.fromkeys(self.families[name], 0)
        least: dict[str, float] = dict.fromkeys(self.families[name], 1.0)
        for (family, a, b), v in zip(self.pairs, m[self.n_family :], strict=True):
            if family == name:
                votes[a if v >= 0 else b] += 1
                least[a], least[b] = min(least[a], sure(v)), min(least[b], sure(-v))
        lang = max(sorted(votes), key=lambda k: (votes[k], least[k]))
        return lang, float(min(score, least[lang]))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 300) -> Model:
    """Fit on the labelled rows of `docs`: at most `per_lang` documents a language, taken by a hash of the id.

    What comes to the driver is bounded: per_lang rows of DIMS floats for each language. Rows of null
    text or language teach nothing; repeated rows are examples each; texts are read whole. An empty
    table, or one without labels, gives a model that knows no language. Other columns aren't read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((0, DIMS)), np.array([], dtype=object))
    span = 1 << 40
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, int(min(1.0, 4 * per_lang / n) * span))])
    rows = rows.withColumn("h", F.xxhash64(F.col("id"), F.lit(11))).where(F.pmod("h", F.lit(span)) < F.try_element_at(share, F.col("lang")))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("rn") <= per_lang)

    def count(batches):
        for pdf in batches:
            yield pd.DataFrame({"lang": pdf["lang"], "x": [features(t).astype(np.float32).tobytes() for t in pdf["text"]]})

    with small_batches(docs.sparkSession):
        got = rows.select("lang", "text").mapInPandas(count, "lang string, x binary").collect()
    order = sorted((r["lang"], bytes(r["x"])) for r in got)
    x = np.array([np.frombuffer(b, np.float32) for _, b in order], np.float64)
    return Model(sorted(counts), x, np.array([k for k, _ in order], dtype=object))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every row of `docs` with lang_pred and score appended (columns of those names are replaced).

    Predictions see the text only. Null text and text without a letter get `und` and 0. Repeated
    rows get equal predictions; an empty table gives an empty result. Ties of votes go to the
    surer language, then to the first by name.
    """

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predicted(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(None if t is None or t is pd.NA or t != t else t) for t in text], columns=["lang", "score"])

    (got,) = free(docs, "predicted")
    own = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    # a filter on the result would otherwise be given a second evaluation, with workers of its own
    predicted = predicted.asNondeterministic()
    return docs.withColumn(got, predicted(F.col(text_col))).select(*own, F.col(got)["lang"].alias("lang_pred"), F.col(got)["score"].alias("score"))


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    from weftline.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
