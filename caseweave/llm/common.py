"""Vectorised text primitives that run inside Arrow tasks.

A batch of texts is handled as one flat byte array with document offsets, so words, lines
and windows of thousands of documents are cut and hashed by a few numpy passes.
Nulls are read as empty texts everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE_BYTES = 2_000_000
MULTIPLIER = 0x9E3779B97F4A7C15


def _separators(keep) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    for code in range(256):
        table[code] = not keep(code)
    return table


SPACES = _separators(lambda c: c != 32 and not 9 <= c <= 13)
NOT_WORD = _separators(lambda c: c >= 128 or chr(c).isalnum())
LINE_ENDS = _separators(lambda c: c != 10)

_seeded = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODES = _seeded.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: np.ndarray = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the odd multiplier modulo 2**64."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 4096), MULTIPLIER, dtype=np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values, another one for each seed."""
    x = x + np.uint64((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    array = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, dtype=np.int64)
    held = array.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8)[offsets[0] : offsets[-1]] if held is not None and len(array) else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text, one row at least."""
    _, offsets = flat(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each run of non-separators, and per document the index of its first run."""
    n = len(data)
    inside = ~separators[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    heads = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64)
    within = place - np.repeat(heads, lengths)
    terms = _BYTE_CODES[data[within + np.repeat(starts, lengths)]] * powers(int(lengths.max()))[within]
    return mix(np.add.reduceat(terms, heads) + lengths.astype(np.uint64) * np.uint64(0xA24BAED4963EE407), seed)


def window_hashes(values: np.ndarray, width: int, multiplier: int = MULTIPLIER) -> np.ndarray:
    """Polynomial hash of each ``width`` consecutive values (document borders are the caller's)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    m, out = np.uint64(multiplier), np.zeros(n, dtype=np.uint64)
    for j in range(width):
        out *= m
        out += values[j : j + n]
    return out


def occurrence(values: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """How often each value occurred before, in its group."""
    order = np.lexsort((values, groups))
    v, g = values[order], groups[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (g[1:] != g[:-1])
    place = np.arange(len(v))
    head = np.maximum.accumulate(np.where(new, place, 0))
    out = np.empty(len(v), dtype=np.int64)
    out[order] = place - head
    return out


def held_out(doc_id: Column) -> Column:
    """True for the rows no classifier learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
