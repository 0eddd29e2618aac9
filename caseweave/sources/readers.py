"""Typed readers. Every reader is given its schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.operators.scale import top_per_group
from caseweave.session import materialise
from caseweave.sources.sinks import CSV_FORMAT


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, columns: list[str] | None = None) -> DataFrame:
    """Header CSV by position under ``schema`` (duplicate header names do no harm).

    Reads what ``write_csv`` wrote: line breaks, quotes, empty texts and NULLs come back as
    they were. A value that is not of its type ends the read instead of turning into NULL.
    """
    df = spark.read.schema(schema).options(enforceSchema=True, multiLine=True, mode="FAILFAST", emptyValue="", **CSV_FORMAT).csv(path)
    return df.select(*columns) if columns else df


def read_json_document(spark: SparkSession, path: str, schema: str | T.StructType, lines: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_jdbc(spark: SparkSession, url: str, query: str, partition_column: str, lower: int, upper: int, partitions: int) -> DataFrame:
    """Joins written in ``query`` run in the database; the scan is split by key range."""
    return (
        spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q")
        .option("partitionColumn", partition_column).option("lowerBound", lower)
        .option("upperBound", upper).option("numPartitions", partitions).load()
    )


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Keeps the first row of each key in an explicit order."""
    return top_per_group(df, key, order, 1, "_first").drop("_first")


# fixed values of the log format
LOG_HEADER = r"^BEGIN LAUNDERING ATTEMPT\s*-\s*(.+)$"
LOG_END = "END LAUNDERING ATTEMPT"
LOG_FIELDS = [
    ("timestamp", "string"), ("from_bank", "string"), ("from_account", "string"), ("to_bank", "string"),
    ("to_account", "string"), ("amount_received", "double"), ("receiving_currency", "string"),
    ("amount_paid", "double"), ("payment_currency", "string"), ("payment_format", "string"), ("is_laundering", "int"),
]


def read_block_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, lines) of a BEGIN/END block log.

    blocks: file, block, pattern_id, typology, descriptor - closed blocks only, numbered
    by their BEGIN line. lines: file, block and the fields of every 11-field line
    before the block's END.

    Lines are read split by split. The running number of BEGIN lines is a window per
    split plus the totals of earlier splits, so neither a file nor a block has to fit
    in one task.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("seq"), F.trim(F.regexp_replace("value", r"\r$", "")).alias("line"),
    )
    lines = materialise(raw.where(F.col("line") != "").withColumn("begins", F.col("line").rlike(LOG_HEADER).cast("int")), "blocklog")
    totals = lines.groupBy("file", "split_start").agg(F.sum("begins").alias("t"))
    earlier = W.partitionBy("file").orderBy("split_start").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("file", "split_start", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("o"))
    inside = W.partitionBy("file", "split_start").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    placed = (
        lines.withColumn("local", F.sum("begins").over(inside)).join(offsets, ["file", "split_start"])
        .select("file", (F.col("local") + F.col("o")).alias("block"), F.struct("split_start", "seq").alias("at"), "line", "begins")
        .where(F.col("block") > 0)
    )
    placed = materialise(placed, "placedlines")
    ends = placed.where(F.startswith("line", F.lit(LOG_END))).groupBy("file", "block").agg(F.min("at").alias("end"))
    header = F.regexp_extract("line", LOG_HEADER, 1)
    blocks = placed.where(F.col("begins") == 1).join(ends, ["file", "block"]).select(
        "file", "block", F.format_string("PAT-%04d", "block").alias("pattern_id"),
        F.trim(F.substring_index(header, ":", 1)).alias("typology"),
        F.trim(F.regexp_extract(header, r"^[^:]*:(.*)$", 1)).alias("descriptor"),
    )
    parts = F.split("line", ",")
    body = placed.where((F.col("begins") == 0) & (F.size(parts) == len(LOG_FIELDS))).join(ends, ["file", "block"]).where(F.col("at") < F.col("end"))
    fields = [parts[i].cast(kind).alias(name) for i, (name, kind) in enumerate(LOG_FIELDS)]
    return blocks, body.select("file", "block", *fields)


def summarise_blocks(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per pattern: transactions, accounts involved, amount paid."""
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("n_transactions"), F.sum("amount_paid").alias("total_paid"))
    accounts = (
        lines.select("file", "block", F.explode(F.array("from_account", "to_account")).alias("account")).distinct()
        .groupBy("file", "block").agg(F.count("*").alias("n_accounts"))
    )
    return (
        blocks.join(counts, ["file", "block"], "left").join(accounts, ["file", "block"], "left")
        .fillna(0, ["n_transactions", "n_accounts"]).fillna(0.0, ["total_paid"])
    )


def patterns_of(summary: DataFrame, typology: str | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(total before the limit, listing) of patterns, typology compared ignoring case."""
    chosen = summary.where(F.upper("typology") == typology.upper()) if typology else summary
    listing = chosen.orderBy("file", "block")
    return chosen.agg(F.count("*").alias("total_patterns")), listing.limit(limit) if limit else listing
