"""Repeats between shards of texts, found by exchanging hashes instead of texts.

Texts are dealt in order into shards of bounded size, written once as a table bucketed by
shard, so that later passes meet their messages without moving texts again. A shard sends
each distinct hash once, in slices by the hash's leading bits; whoever holds a slice of all
shards answers with one bit per hash. A hash that a third of all rows share thus costs one
entry per shard.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.session import scratch_path

#: Text of a shard, and text whose hashes share a slice.
SHARD_BYTES, SLICE_BYTES = 16_000_000, 16_000_000
ANSWERS = "shard int, kind string, slice int, bits binary, places binary"


@dataclass
class Shards:
    rows: DataFrame
    slice_bits: int

    def each(self, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
        return self.rows.groupBy("shard").applyInArrow(lambda table: run(in_order(table)), schema)

    def with_answers(self, answers: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        return self.rows.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(lambda table, own: run(in_order(table), own), schema)


def in_order(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table.column("place"))).combine_chunks()


def shard(docs: DataFrame, shard_bytes: int = SHARD_BYTES, slice_bytes: int = SLICE_BYTES) -> Shards:
    """Deals (doc_id, text) into shards ordered by doc_id; rows of one doc_id by text."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // shard_bytes))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("row")]
    dealt = docs.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(count, *order).sortWithinPartitions(*order)
    placed = dealt.select(F.spark_partition_id().alias("shard"), F.monotonically_increasing_id().alias("place"), "doc_id", "text")
    name = f"shards_{uuid.uuid4().hex}"
    # more buckets than shards, so that few shards share one, as far as Spark allows
    buckets = min(4 * count, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    placed.write.option("path", scratch_path(spark, "shards")).option("compression", "zstd").bucketBy(buckets, "shard").saveAsTable(name)
    rows = spark.table(name)
    # the files stay where they are; only the session's catalog forgets the name
    spark.sql(f"DROP TABLE {name}")
    return Shards(rows, max(0, int(total // slice_bytes).bit_length()))


def sliced(keys: np.ndarray, slice_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(slice numbers, borders) of sorted 64-bit keys."""
    owner = (keys >> np.uint64(64 - slice_bits)).astype(np.int64) if slice_bits else np.zeros(len(keys), dtype=np.int64)
    heads = np.flatnonzero(np.diff(owner, prepend=-1))
    return owner[heads], np.append(heads, len(keys))


def answered(own: pa.Table, kind: str, size_of: Callable[[int], tuple[int, int]], total: int) -> np.ndarray:
    """The bits that answer all keys of a shard, put back in their order."""
    out = np.zeros(total, dtype=bool)
    for k, number, bits in zip(*(own.column(c).to_pylist() for c in ("kind", "slice", "bits"))):
        if k == kind:
            low, high = size_of(number)
            out[low:high] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=high - low).astype(bool)
    return out


def slice_borders(keys: np.ndarray, slice_bits: int) -> Callable[[int], tuple[int, int]]:
    numbers, borders = sliced(keys, slice_bits)
    places = {int(n): (int(borders[i]), int(borders[i + 1])) for i, n in enumerate(numbers)}
    return places.__getitem__


def gathered(table: pa.Table, column: str, dtype: str) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(shards in order, owner of each value, values) of the messages of one slice."""
    messages = sorted(zip(table.column("shard").to_pylist(), table.column(column).to_pylist()))
    blobs = [np.frombuffer(b, dtype=dtype) for _, b in messages]
    owner = np.repeat(np.arange(len(blobs)), [len(b) for b in blobs])
    return [s for s, _ in messages], owner, np.concatenate(blobs) if blobs else np.zeros(0, dtype=dtype)


def packed(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


# Anchors: sampled pieces that equal windows share

def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` consecutive values."""
    out, done = values, 1
    while done * 2 <= width:
        out = pick(out[:-done], out[done:]) if len(out) > done else out[:0]
        done *= 2
    rest = width - done
    return pick(out[: len(out) - rest], out[rest:]) if rest and len(out) > rest else (out if not rest else out[:0])


def minima(values: np.ndarray, valid: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(smallest value in each valid window, positions that are the smallest of some window).

    Windows hold ``width`` values and start where ``valid``; others are 0 and own nothing.
    """
    least = sliding(values, width, np.minimum)
    least = np.where(valid[: len(least)], least, np.uint64(0))
    edge = np.zeros(width - 1, dtype=np.uint64)
    most = sliding(np.concatenate([edge, least, edge]), width, np.maximum)[: len(values)]
    return least, np.flatnonzero((values[: len(most)] == most) & (most > 0))


def anchor_keys(values: np.ndarray, slice_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, how often each occurs): the slice bits and 32 more, the rest zero.

    A key that two values share only makes a window a candidate in vain.
    """
    drop = np.uint64(32 - slice_bits)
    return np.unique((values >> drop) << drop, return_counts=True)


def anchor_messages(number: int, keys: np.ndarray, slice_bits: int) -> pa.Table:
    numbers, borders = sliced(keys, slice_bits)
    low = ((keys >> np.uint64(32 - slice_bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")
    return pa.table({
        "slice": pa.array(numbers, pa.int32()), "shard": pa.array([number] * len(numbers), pa.int32()),
        "keys": pa.array([low[a:b].tobytes() for a, b in zip(borders[:-1], borders[1:])], pa.binary()),
    })


def shared_anchors(messages: DataFrame) -> DataFrame:
    """Answers kind ``anchor``: which of a shard's keys another shard sent too."""

    def run(table: pa.Table) -> pa.Table:
        number = table.column("slice")[0].as_py()
        shards, owner, keys = gathered(table, "keys", "<u4")
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        same = ordered[1:] == ordered[:-1]
        twice = np.zeros(len(keys), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        sizes = np.bincount(owner, minlength=len(shards))
        bits = [packed(twice[end - n : end]) for end, n in zip(np.cumsum(sizes), sizes)]
        return answer_table(shards, "anchor", number, bits, [b""] * len(shards))

    return messages.groupBy("slice").applyInArrow(run, ANSWERS)


def answer_table(shards: list[int], kind: str, number: int, bits: list[bytes], places: list[bytes]) -> pa.Table:
    return pa.table({
        "shard": pa.array(shards, pa.int32()), "kind": pa.array([kind] * len(shards), pa.string()), "slice": pa.array([number] * len(shards), pa.int32()),
        "bits": pa.array(bits, pa.binary()), "places": pa.array(places, pa.binary()),
    })
