"""From raw documents to a training mix: each stage works on all that the one before kept.

Toxic documents go, one document of each group of near duplicates stays,
documents that hold benchmark items go, secrets are replaced in the texts, and
the last stage says how many words the mix takes of each document that is left.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.decontam import drop_contaminated
from tidemill.llm.mixing import mix_sources
from tidemill.llm.neardup import drop_near_duplicates
from tidemill.llm.secrets import redact_secrets
from tidemill.llm.toxicity import drop_toxic
from tidemill.llm.work import checkpoint_dir


#: Documents are near duplicates from this share of common 5-word shingles on; op4's own query has 85.
NEAR_PERCENT = 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without toxic texts.

    Null and empty texts get the bias and stay; texts of any length are scored
    whole; equal texts, and so repeated rows, share their fate; other columns
    stay, whatever their names. An empty table stays empty.
    """
    return drop_toxic(docs, _table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document, that of the smallest id, of each group of near duplicates.

    Null and empty texts and rows without an id stay; of rows that repeat an id
    the one with the smallest text stays; texts of any length count whole; other
    columns stay, whatever their names. An empty table stays empty.
    """
    return drop_near_duplicates(docs, percent=NEAR_PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a benchmark item.

    Null and empty texts hold none and stay; texts of any length are searched
    whole; repeated rows go or stay together; other columns stay, whatever their
    names. An empty table of documents or items changes nothing.
    """
    return drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with each secret replaced; no row goes, and n_chars follows the text.

    Null texts stay null, with a null n_chars; empty ones stay empty; texts of
    any length are searched whole; repeated rows change alike; other columns
    stay, whatever their names. An empty table stays empty.
    """
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document that is left, one row for each.

    Null and empty texts have no words and nothing taken; texts of any length
    count whole; repeated rows count one by one, and ties go by a seeded hash of
    the id; other columns aren't read. An empty table gives an empty result.
    """
    return mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("mixing", mixed),
]

#: Learned scores, components and a knapsack: no stage's rows follow from SQL alone; the tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what a stage keeps is written to the shared folder and read again by the next."""
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
