"""Exact duplicates by skew-safe combining, in DataFrame functions only.

Texts are equal when identical after each run of white space became one blank; a null
text is the empty text. Three combining steps: rows of one task first (map-side), then
salted groups, then the winners of the salts. Each step groups by digest *and* content,
so a colliding digest never merges different texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import free_name
from caseweave.session import materialise

SALTS = 16


def content(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _rows(docs: DataFrame, digest) -> DataFrame:
    rows = docs.select(F.col("doc_id").alias("doc_id"), content(F.col("text")).alias("content"))
    return rows.withColumn("digest", digest(F.col("content")))


def _winners(rows: DataFrame, salts: int) -> DataFrame:
    """One row per distinct content: the smallest id and the number of rows."""
    salted = rows.withColumn("salt", F.spark_partition_id() % salts)
    merged = salted.groupBy("digest", "salt", "content").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    return merged.groupBy("digest", "content").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_groups(docs: DataFrame, salts: int = SALTS, digest=sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    ``docs`` needs doc_id and text; other columns are ignored, whatever their names.
    Of equal texts the smallest doc_id stays. Nulls: a null text equals the empty one; a
    null doc_id loses against any id and wins only where a group has no id at all. Rows
    repeated with the same doc_id and text count in group_size, and one of them is kept.
    An empty table gives an empty result. ``digest`` may be any function of the content:
    if two contents share a value, their rows are told apart by the contents themselves.
    """
    rows = _rows(docs, digest)
    # a digest's only content is named by the digest, so texts need not travel to the members
    named = materialise(
        _winners(rows, salts).groupBy("digest").agg(
            F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("contents")
        ),
        "exact",
    )
    members = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("copies"))
    alone = members.join(named.where("contents = 1").drop("contents"), "digest")
    if not named.where("contents > 1").isEmpty():
        shared = rows.join(named.where("contents > 1").select("digest"), "digest", "left_semi")
        by_content = _winners(shared, salts)
        apart = shared.groupBy("doc_id", "digest", "content").agg(F.count("*").alias("copies")).join(by_content, ["digest", "content"])
        alone = alone.unionByName(apart.drop("content"))
    copies = alone.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return copies.select(
        "doc_id", "keep_id", F.col("group_size").cast("bigint").alias("group_size"),
        ((F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    Of equal texts the row with the smallest doc_id stays; null and empty texts are equal, a row
    with a null doc_id stays only where its group has no doc_id, and of rows with the same
    doc_id and text one stays. An empty table stays empty.
    """
    kept = exact_groups(docs, salts).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_digest"))
    digest = free_name(docs, "digest")
    marked = docs.withColumn(digest, sha256(content(F.col("text"))))
    match = marked["doc_id"].eqNullSafe(kept["_kept_id"]) & (marked[digest] == kept["_kept_digest"])
    stay = marked.join(kept, match, "left_semi")
    return stay.dropDuplicates(["doc_id", digest]).drop(digest)
