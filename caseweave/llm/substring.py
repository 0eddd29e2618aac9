"""Repeated passages by compacting a de Bruijn graph of word windows.

A window of ``width`` words is an edge from its first to its last ``width - 1`` words. Only
edges that occur again matter, and every such edge shares its smallest inner piece of words
(its anchor) with its other occurrences; so shards first exchange anchors, and then the edges
under repeated anchors. For each edge its source is the earliest occurrence. Within a shard,
consecutive edges whose sources are consecutive too lie on a path without a branch and are
compacted into one; a path ends where the text or its source takes another way. Paths are
joined with the words at their source coordinates, and only paths whose words agree there
are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm import shards as sh
from caseweave.llm.common import SPACES, flat, hash_spans, mix, spans, window_hashes
from caseweave.session import materialise

WIDTH, PIECE = 20, 8
CHUNK_WORDS = 300_000


class Words:
    """The words of a shard, in order: hashes, and the first word of each document."""

    def __init__(self, table: pa.Table):
        self.data, offsets = flat(table.column("text"))
        self.starts, self.ends, self.first = spans(self.data, offsets, SPACES)

    def hashes(self) -> np.ndarray:
        cut = range(0, len(self.starts), CHUNK_WORDS)
        parts = [hash_spans(self.data, self.starts[i : i + CHUNK_WORDS], self.ends[i : i + CHUNK_WORDS]) for i in cut]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)

    def window_starts(self, width: int) -> np.ndarray:
        """True where a window of ``width`` words of one document starts."""
        n = np.diff(self.first)
        last = np.repeat(self.first[1:], n)
        return np.arange(len(last)) + width <= last

    def digests(self, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
        """A strong digest of each range of words, whatever stands between them."""
        lengths = self.ends - self.starts
        borders = np.concatenate([[0], np.cumsum(lengths)])
        solid = self.data[~SPACES[self.data]]
        sizes = lengths.astype("<u4")
        out = []
        for a, b in zip(begin.tolist(), end.tolist()):
            h = hashlib.blake2b(sizes[a:b].tobytes(), digest_size=16)
            h.update(solid[borders[a] : borders[b]].tobytes())
            out.append(h.digest())
        return out


class Edges:
    """The edges of a shard that may occur again: distinct hashes and all their places."""

    def __init__(self, table: pa.Table, width: int, piece: int, slice_bits: int, own: pa.Table | None = None):
        self.words = Words(table)
        hashes = self.words.hashes()
        valid = self.words.window_starts(width)
        pieces = mix(window_hashes(hashes, piece), 1)
        least, places = sh.minima(pieces, valid, width - piece + 1)
        self.keys, counts = sh.anchor_keys(pieces[places], slice_bits)
        if own is None:
            return
        again = (counts > 1) | sh.answered(own, "anchor", sh.slice_borders(self.keys, slice_bits), len(self.keys))
        drop = np.uint64(32 - slice_bits)
        runs = np.flatnonzero(np.diff(least, prepend=np.uint64(0)))
        head = (least[runs] >> drop) << drop
        at = np.minimum(np.searchsorted(self.keys, head), max(0, len(self.keys) - 1))
        take = again[at] & (least[runs] > 0) if len(self.keys) else np.zeros(len(runs), dtype=bool)
        chosen = np.zeros(len(least), dtype=bool)
        if len(runs):
            chosen[runs[0] :] = np.repeat(take, np.diff(np.append(runs, len(least))))
        self.places = np.flatnonzero(chosen & valid[: len(least)])
        edge = mix(window_hashes(hashes, width), 2)[self.places]
        self.edges, first, self.inverse = np.unique(edge, return_index=True, return_inverse=True)
        self.first = self.places[first]


def _edge_messages(number: int, e: Edges, slice_bits: int) -> pa.Table:
    numbers, borders = sh.sliced(e.edges, slice_bits)
    keys, places = e.edges.astype("<u8"), e.first.astype("<u4")
    pairs = list(zip(borders[:-1], borders[1:]))
    return pa.table({
        "slice": pa.array(numbers, pa.int32()), "shard": pa.array([number] * len(numbers), pa.int32()),
        "keys": pa.array([keys[a:b].tobytes() for a, b in pairs], pa.binary()), "places": pa.array([places[a:b].tobytes() for a, b in pairs], pa.binary()),
    })


def _sources(messages: DataFrame) -> DataFrame:
    """Answers kind ``edge``: edges an earlier shard holds, and where the earliest holds them."""

    def run(table: pa.Table) -> pa.Table:
        number = table.column("slice")[0].as_py()
        shards, owner, keys = sh.gathered(table, "keys", "<u8")
        _, _, places = sh.gathered(table, "places", "<u4")
        order = np.lexsort((owner, keys))
        ordered = keys[order]
        new = np.ones(len(ordered), dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        source = order[np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0))] if len(ordered) else order
        later, of = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64)
        later[order] = ~new
        of[order] = source
        names = np.array(shards, dtype="<u4")
        sizes = np.bincount(owner, minlength=len(shards))
        bits, found = [], []
        for end, n in zip(np.cumsum(sizes), sizes):
            own = later[end - n : end]
            at = of[end - n : end][own]
            bits.append(sh.packed(own))
            found.append(np.concatenate([names[owner[at]], places[at]]).astype("<u4").tobytes())
        return sh.answer_table(shards, "edge", number, bits, found)

    return messages.groupBy("slice").applyInArrow(run, sh.ANSWERS)


def _paths(number: int, e: Edges, width: int, slice_bits: int, own: pa.Table) -> pa.Table:
    """Compacted paths of repeated edges, with the place of their source and a digest of their words."""
    borders = sh.slice_borders(e.edges, slice_bits)
    source_shard = np.full(len(e.edges), number, dtype=np.int64)
    source_place = e.first.astype(np.int64)
    for kind, part, bits, places in zip(*(own.column(c).to_pylist() for c in ("kind", "slice", "bits", "places"))):
        if kind == "edge":
            low, high = borders(part)
            later = low + np.flatnonzero(np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=high - low))
            found = np.frombuffer(places, dtype="<u4")
            source_shard[later], source_place[later] = found[: len(later)], found[len(later) :]
    shard_of, place_of = source_shard[e.inverse], source_place[e.inverse]
    repeated = (shard_of != number) | (place_of != e.places)
    at, shard_of, place_of = e.places[repeated], shard_of[repeated], place_of[repeated]
    doc = np.searchsorted(e.words.first, at, side="right")
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (shard_of[1:] != shard_of[:-1]) | (place_of[1:] != place_of[:-1] + 1) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new)
    count = np.diff(np.append(heads, len(at)))
    digests = e.words.digests(at[heads], at[heads] + count + width - 1)
    return pa.table({
        "shard": pa.array([number] * len(heads), pa.int32()), "start": pa.array(at[heads], pa.int64()), "edges": pa.array(count, pa.int64()),
        "source_shard": pa.array(shard_of[heads], pa.int32()), "source_start": pa.array(place_of[heads], pa.int64()), "digest": pa.array(digests, pa.binary()),
    })


def _number(table: pa.Table) -> int:
    return table.column("shard")[0].as_py()


def repeated_paths(held: sh.Shards, width: int = WIDTH, piece: int = PIECE) -> DataFrame:
    """(shard, start, edges, source_shard, source_start, digest): verified paths of repeated windows.

    ``start`` counts the words of a shard; a path covers ``edges + width - 1`` words.
    """
    bits = held.slice_bits
    edge_bits = bits + 1

    def send_anchors(table: pa.Table) -> pa.Table:
        return sh.anchor_messages(_number(table), Edges(table, width, piece, bits).keys, bits)

    def send_edges(table: pa.Table, own: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"slice": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "places": pa.array([], pa.binary())})
        return _edge_messages(_number(table), Edges(table, width, piece, bits, own), edge_bits)

    def compact(table: pa.Table, own: pa.Table) -> pa.Table:
        return _paths(_number(table), Edges(table, width, piece, bits, own), width, edge_bits, own)

    def read_sources(table: pa.Table, own: pa.Table) -> pa.Table:
        start, count = own.column("source_start").to_numpy(), own.column("edges").to_numpy()
        digests = Words(table).digests(start, start + count + width - 1) if len(start) else []
        return pa.table({"source_shard": own.column("shard").cast(pa.int32()), "source_start": own.column("source_start"), "edges": own.column("edges"), "found": pa.array(digests, pa.binary())})

    anchors = materialise(sh.shared_anchors(held.each(send_anchors, "slice int, shard int, keys binary")), "anchors")
    messages = held.with_answers(anchors, send_edges, "slice int, shard int, keys binary, places binary")
    edges = materialise(_sources(messages), "edges")
    path = "shard int, start long, edges long, source_shard int, source_start long, digest binary"
    paths = materialise(held.with_answers(anchors.unionByName(edges), compact, path), "paths")
    asked = paths.select(F.col("source_shard").alias("shard"), "source_start", "edges").distinct()
    read = held.with_answers(asked, read_sources, "source_shard int, source_start long, edges long, found binary")
    return paths.join(read, ["source_shard", "source_start", "edges"]).where("digest = found").drop("found")


def drop_repeats(docs: DataFrame, width: int = WIDTH, piece: int = PIECE, shard_bytes: int = sh.SHARD_BYTES, slice_bytes: int = sh.SLICE_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): every word in a window that starts earlier too is removed.

    Earlier is a smaller doc_id, or the same document and an earlier start; windows are judged
    on the texts as given and never cross documents. Words are what stands between white space;
    kept words are joined by one blank. Null and empty texts have no words. Of rows with one
    doc_id those with the smaller text hash come first, null ids come last; every input row
    gives a row. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    held = sh.shard(rows, shard_bytes, slice_bytes)
    paths = materialise(repeated_paths(held, width, piece).select("shard", "start", "edges"), "verified")

    def remove(table: pa.Table, own: pa.Table) -> pa.Table:
        words = Words(table)
        size = len(words.starts)
        change = np.zeros(size + 1, dtype=np.int64)
        start, count = own.column("start").to_numpy(), own.column("edges").to_numpy()
        np.add.at(change, start, 1)
        np.add.at(change, start + count + width - 1, -1)
        gone = np.cumsum(change[:-1]) > 0
        total = np.diff(words.first)
        owner = np.repeat(np.arange(len(total)), total)
        removed = np.bincount(owner, gone, minlength=len(total)).astype(np.int64)
        texts = []
        for i in range(len(total)):
            keep = words.first[i] + np.flatnonzero(~gone[words.first[i] : words.first[i + 1]])
            texts.append(" ".join(_joined(words, keep)))
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(texts, pa.string())})

    return held.with_answers(paths, remove, "doc_id long, n_words long, n_removed long, kept_text string")


def _joined(words: Words, keep: np.ndarray) -> list[str]:
    if not len(keep):
        return []
    # stretches of neighbouring words are decoded at once
    cut = np.flatnonzero(np.diff(keep, prepend=keep[0] - 2) != 1)
    ends = np.append(cut[1:], len(keep)) - 1
    return [b" ".join(words.data[a:b].tobytes().split()).decode() for a, b in zip(words.starts[keep[cut]], words.ends[keep[ends]])]
