"""Writers."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: How both sides write and read text: everything quoted, quotes doubled, and NULL told from the
#: empty text by a character that no text file holds.
CSV_FORMAT = {
    "header": True, "escape": '"', "nullValue": "\u0000", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV that keeps every text; arrays are joined with '|', and an empty frame still writes its header."""
    flat = [
        F.array_join(F.col(f.name).cast("array<string>"), "|").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*flat).write.mode("errorifexists").options(quoteAll=True, emptyValue='""', **CSV_FORMAT).csv(path)


def write_json_metrics(df: DataFrame, path: str) -> None:
    """Small metric frames (maps and structs allowed) as JSON lines."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def save_model(model: PipelineModel, path: str) -> None:
    """Feature order lives in the assembler stage, so model and metadata stay together."""
    model.write().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
