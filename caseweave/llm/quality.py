"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of whole texts are taken by numpy passes over batches and written once. The
trees are grown on a bounded, hash-chosen sample of the labelled rows that are not held out;
each is a complete binary tree laid out in flat arrays, so a batch of documents walks all
levels by array indexing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import LINE_ENDS, SPACES, flat, hash_spans, held_out, pieces, spans
from caseweave.session import materialise

FEATURES = [
    "log_bytes", "log_words", "word_mean", "word_deviation", "word_longest", "upper", "digits", "symbols", "stops", "commas", "beyond_ascii", "lines_per_word",
    "distinct", "repeated_next", "top_word", "repeated_lines", "capitalised", "symbol_ends", "words_per_line",
]
#: Expected number of training rows at most, and the shape of the ensemble.
MAX_ROWS, TREES, DEPTH, BINS, RATE, RIDGE = 20_000, 80, 4, 64, 0.15, 1.0
LIKELY = 0.7

LOWER, UPPER, DIGIT, BLANK, NEWLINE, HIGH, STOP, COMMA, SYMBOL = range(9)


def _class(code: int) -> int:
    c = chr(code)
    if code >= 128:
        return HIGH
    if c.islower():
        return LOWER
    if c.isupper():
        return UPPER
    if c.isdigit():
        return DIGIT
    if c == "\n":
        return NEWLINE
    if c in " \t\r\v\f":
        return BLANK
    if c in ".!?":
        return STOP
    return COMMA if c in ",;:'\"()-" else SYMBOL


CLASSES = np.array([_class(c) for c in range(256)], dtype=np.uint8)


def statistics(column) -> np.ndarray:
    """One row of ``FEATURES`` for each text; an empty text has zeros."""
    data, offsets = flat(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    docs = np.arange(n)
    owner = np.repeat(docs, size)
    kinds = CLASSES[data]
    counts = np.bincount(owner * 9 + kinds, minlength=9 * n).reshape(n, 9).astype(float)
    starts, ends, first = spans(data, offsets, SPACES)
    words = np.diff(first)
    of = np.repeat(docs, words)
    length = (ends - starts).astype(float)
    some = np.maximum(words, 1)
    mean = np.bincount(of, length, minlength=n) / some
    deviation = np.sqrt(np.maximum(np.bincount(of, length**2, minlength=n) / some - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, of, length)
    hashes = hash_spans(data, starts, ends)
    again = np.zeros(len(of), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((hashes, of))
    h, o = hashes[order], of[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    heads = np.flatnonzero(new)
    runs = np.diff(np.append(heads, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, o[heads], runs)
    line_starts, _, line_first = spans(data, offsets, LINE_ENDS)
    lines = np.diff(line_first)
    line_of = np.searchsorted(line_starts, starts, side="right") - 1
    line_hash = np.zeros(len(line_starts), dtype=np.uint64)
    np.add.at(line_hash, line_of, hashes)
    line_words = np.bincount(line_of, minlength=len(line_starts))
    line_doc = np.repeat(docs, lines)
    line_order = np.lexsort((line_hash, line_doc))
    lh, ld = line_hash[line_order], line_doc[line_order]
    seen = np.zeros(len(lh), dtype=bool)
    seen[1:] = (lh[1:] == lh[:-1]) & (ld[1:] == ld[:-1])
    doubled = np.bincount(ld, line_words[line_order] * seen, minlength=n)
    some_bytes = np.maximum(size, 1)
    columns = [
        np.log1p(size), np.log1p(words), mean, deviation, np.log1p(longest), counts[:, UPPER] / some_bytes, counts[:, DIGIT] / some_bytes, counts[:, SYMBOL] / some_bytes,
        counts[:, STOP] / some, counts[:, COMMA] / some, counts[:, HIGH] / some_bytes, counts[:, NEWLINE] / some, np.bincount(o[heads], minlength=n) / some,
        np.bincount(of, again, minlength=n) / some, top / some, doubled / some, np.bincount(of, kinds[starts] == UPPER, minlength=n) / some,
        np.bincount(of, kinds[ends - 1] == SYMBOL, minlength=n) / some, np.log1p(words / np.maximum(lines, 1)),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


@dataclass
class Trees:
    """Complete trees in flat arrays: inner nodes by level, then leaf values."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            raw += leaf[node - inner]
        return 1.0 / (1.0 + np.exp(-raw))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, ridge: float = RIDGE) -> Trees:
    """Boosting on the logistic loss over quantile bins."""
    inner = 2**depth - 1
    out = Trees(0.0, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not len(y) or y.min() == y.max():
        share = 0.5 if not len(y) else np.clip(y.mean(), 0.01, 0.99)
        out.base = float(np.log(share / (1 - share)))
        return out
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    out.base = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(len(y), out.base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        slope, curve = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            base, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            cut = np.full(width, -1)
            for f, e in enumerate(edges):
                place = (node - base) * bins + binned[:, f]
                g = np.bincount(place, slope, minlength=width * bins).reshape(width, bins).cumsum(axis=1)
                h = np.bincount(place, curve, minlength=width * bins).reshape(width, bins).cumsum(axis=1)
                total_g, total_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
                gain[(h < 1) | (total_h - h < 1)] = 0
                gain = gain[:, : len(e)]
                if not gain.size:
                    continue
                at = gain.argmax(axis=1)
                value = gain[np.arange(width), at]
                better = value > best
                best[better], cut[better] = value[better], at[better]
                feature[base : base + width][better] = f
            for k in np.flatnonzero(cut >= 0):
                threshold[base + k] = edges[feature[base + k]][cut[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        g = np.bincount(node - inner, slope, minlength=inner + 1)
        h = np.bincount(node - inner, curve, minlength=inner + 1)
        leaf = rate * g / (h + ridge)
        raw += leaf[node - inner]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(out.base, np.array(features), np.array(thresholds), np.array(leaves))


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every whole text."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                x = statistics(piece.column("text"))
                held = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), held], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<float>")


def fit(described: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Trees:
    """Trees from at most ``max_rows`` (expected) labelled rows that are not held out, chosen by hash."""
    marked = labels.select("doc_id", F.col("quality").cast("double").alias("y")).where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    share = min(1.0, max_rows / max(1, marked.count()))
    chosen = marked.where(F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5 <= share)
    rows = described.join(chosen, "doc_id").orderBy("doc_id", "y", "x").toPandas()
    x = np.stack(rows["x"].to_list()).astype(np.float32) if len(rows) else np.zeros((0, len(FEATURES)), np.float32)
    return grow(x, rows["y"].to_numpy(float))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row of ``docs``.

    ``score`` rises with the likelihood of quality 1; ``predicted`` is 1 from 0.7. Null and
    empty texts have all statistics zero and are scored like any other. Rows repeated in
    ``docs`` are scored alike; rows of ``labels`` with a null id or label teach nothing, and a
    document labelled twice teaches both. Without labels of both kinds the score is their
    share (0.5 without any). An empty table gives an empty result; other columns are ignored.
    """
    described = materialise(describe(docs), "statistics")
    trees = fit(described, labels)
    shared = docs.sparkSession.sparkContext.broadcast((trees.base, trees.feature, trees.threshold, trees.leaf))

    def run(batches):
        own = Trees(*shared.value)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.score(x), pa.float64())], ["doc_id", "score"])

    scored = described.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LIKELY).cast("int").alias("predicted"))
