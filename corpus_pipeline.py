"""Training-corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

quality   drops documents that the classifier rejects.
near      keeps one document of each group of near copies, the one with the smallest doc_id.
repeats   cuts passages (at least 160 bytes and 51 whole words) that repeat across documents out of all their places.
secrets   replaces secrets by a mark.
packing   packs what is left into token sequences (one row per piece).

All stages but the last return the columns of their input, whatever else those hold and however they are named; n_chars
follows the text.

Defined cases: a null text is judged as an empty one and stays null; texts without words are no near copies and stay; of rows
that are equal in doc_id and text one stays; null doc_ids come last when a copy is chosen; an empty table gives empty
results of the same columns; a text that is cut to nothing stays as an empty text, and packs as its end alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.llm import ngram_join, packing, quality, secrets, suffix_dedup
from sitegrain.llm.common import Scratch

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def _with_text(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The columns of docs from rows, which hold a new text and all else of docs."""
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(spark, docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(docs, suffix_dedup.cut(spark, docs))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs)


STAGES = [
    ("quality", drop_low_quality),
    ("near", drop_near_copies),
    ("repeats", cut_repeats),
    ("secrets", hide_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for sf_dir's documents."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = scratch.save(out, name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
