"""Many patterns searched in many texts at once."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns in one automaton; a larger table of patterns takes several, one after the other.
BLOCK = 50_000


def _automaton(patterns: list[tuple[str, list[str]]]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for low, spelled in patterns:
        found.add_word(low, spelled)
    found.make_automaton()
    return found


def find_all(df: DataFrame, text: str, patterns: DataFrame, pattern: str, out: str, block: int = BLOCK) -> DataFrame:
    """``df`` with ``out``: the distinct patterns that occur in ``text`` ignoring case, in no order; null for a null text.

    The patterns are dealt into automata of at most about ``block`` patterns, so what is shipped to
    a task is bounded at any number of them, and every text is read once for each automaton.
    Blank patterns are never found.
    """
    listed = patterns.select(F.col(pattern).cast("string").alias("p")).where(F.length(F.trim("p")) > 0).distinct().withColumn("low", F.lower("p"))
    blocks = max(1, -(-listed.count() // block))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.StringType()))])
    result = df.withColumn(out, F.when(F.col(text).isNotNull(), F.array().cast("array<string>")))
    for b in range(blocks):
        own: dict[str, list[str]] = {}
        for r in listed.where(F.pmod(F.xxhash64("low"), F.lit(blocks)) == b).collect():
            own.setdefault(r["low"], []).append(r["p"])
        if own:
            result = _searched(result, text, out, sorted(own.items()), schema)
    return result


def _searched(df: DataFrame, text: str, out: str, patterns: list[tuple[str, list[str]]], schema: T.StructType) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(patterns)
    names = df.columns

    def run(batches):
        search = _automaton(shared.value)
        for batch in batches:
            found = []
            for low, known in zip(batch.column("_low").to_pylist(), batch.column(out).to_pylist()):
                if low is None:
                    found.append(None)
                else:
                    hits = {id(spelled): spelled for _, spelled in search.iter(low)}
                    found.append(known + [p for spelled in hits.values() for p in spelled])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())) if n == out else batch.column(n) for n in names], names)

    return df.withColumn("_low", F.lower(F.col(text))).mapInArrow(run, schema)
