"""A corpus pipeline: language, exact and near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its
result is written as Parquet and read back as the next stage's ``docs``. All but the last
return the columns of ``documents``; the last returns the packed pieces. Further columns, rows
with null ids, repeated rows and empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caseweave.llm import exact, language, leaks, near, packing
from caseweave.llm.common import table
from caseweave.session import materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; the model learns from ``docs`` itself. Null, empty and letterless texts go."""
    return language.keep_identified(docs, language.fit(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the row with the smallest doc_id; null and empty texts are equal."""
    return exact.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest doc_id; a text without words is near only to an equal one."""
    return near.drop_near(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the folder's ``benchmark`` table; without items all stay."""
    return leaks.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def pack_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens of all documents in sequences of 1024, each source at its own share; an empty table gives no pieces."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_mixture),
]

#: Learned languages, sketches, a latent space and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
