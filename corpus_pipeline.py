"""The corpus pipeline: language ID, exact deduplication, near-duplicate removal by an exact
Jaccard join, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep
the columns of ``documents``. A document goes by its id, so ids must be unique; rows
without an id are no one's copies and stay until they are packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridia.llm.common import table, written
from meridia.llm.decontaminate import decontaminated
from meridia.llm.exact_dedup import exact_dedup
from meridia.llm.jaccard_join import jaccard_components
from meridia.llm.language_id import identify
from meridia.llm.packing import digest, pack


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but for the given ids, which are written first: Spark then knows their
    size and sends them to the documents, or shuffles both where they are too many."""
    return docs.join(written(ids.select("doc_id").distinct(), "dropped"), "doc_id", "left_anti").select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; letterless ones go."""
    return _without(docs, identify(docs).filter("not kept"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return _without(docs, exact_dedup(docs).filter("not kept and keep_id is not null"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the one with the smallest id."""
    return _without(docs, jaccard_components(docs).filter("component_id <> doc_id"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return digest(pack(docs))


STAGES = [("language", language), ("exact", exact), ("near", near), ("clean", clean), ("packed", packed)]

#: Tokens and latent projections are no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
