"""A corpus pipeline: language ID, line dedup, near-dedup, PII, packing, each over all that the one before kept.

Part of the subpackage weftline.llm. Stages are (name, function); each function takes (spark, docs,
sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import language_id, line_dedup, near_dedup, packing, pii
from weftline.shared import cut, release, tables
from weftline.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any language (null, empty or without a letter) go; the others get the predicted language."""
    model = language_id.fit(docs.where(~language_id.held_out()))
    kept = language_id.identify(docs, model).where("lang_pred <> 'und'")
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; documents stay, also those that lose all lines."""
    return _counted(line_dedup.dedup_lines(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return near_dedup.near_dedup(docs).select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays."""
    return _counted(pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as tokens, packed into sequences of 1024."""
    return packing.pack(docs)


STAGES = [("language_id", identify), ("line_dedup", lines), ("near_dedup", near), ("pii", private), ("packing", packed)]

#: SQL can't express language ID, near-dedup of whole sets or packing; tests/llm/test_pipeline.py compares every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder before the next; what a stage read and wrote on the way is deleted then."""
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(STAGES):
        known = set(tables())
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
            release([*before, *[p for p in tables() if p not in known][:-1]])
            before = tables()[-1:]
    return docs
