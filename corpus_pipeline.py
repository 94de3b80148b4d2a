"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.

All stages but the last return the columns of ``docs`` as they came, whatever
their names; no column but doc_id, text, lang and source is read.  An empty
table gives an empty one.  Decisions go by doc_id, so repeated rows of a doc_id
go or stay together (one of them stays after near-dedup).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wayscore.llm import minhash, mixing, outliers, packing, quality
from wayscore.llm.common import home_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, null and empty texts among them; rows without a doc_id can't be addressed and stay."""
    scored = quality.quality_scores(docs, _table(spark, sf_dir, "labels"))
    return docs.join(scored.where("predicted = 0 and doc_id is not null").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules (null and empty texts do) or lie far from their language and source go; null languages and sources are values of their own."""
    judged = outliers.quality_rules(docs)
    return docs.join(judged.where("not kept and doc_id is not null").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays; texts without words and rows without a doc_id have no duplicates."""
    return minhash.deduplicated(docs)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay at rates of at most one, so that domains with tokens to spare come down to their target weights.

    Texts without words have the rate one, rows without a doc_id stay.
    """
    return mixing.kept_by_rate(docs, mixing.mix(docs, _table(spark, sf_dir, "labels"), headroom=1.0, most=1.0))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the documents that are left, with their token ids; a null or empty text is the end id alone."""
    return packing.digested(packing.pack(docs), keep_ids=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("minhash_dedup", minhash_dedup),
    ("mixing", mixing_to_targets),
    ("packing", packed),
]
#: The stages use trained models and a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    home = f"{home_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{home}/{i}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{home}/{i}-{name}")
    return docs
