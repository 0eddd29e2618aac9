"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of documents. A window of ``window_sequences`` sequences is filled
by one round: each queue earns its target share of the window and hands over the whole
tokens it has earned; the fraction left, its deficit, is carried into the next window, so
after any number of windows a queue is within one token of its target. Since documents may
be cut anywhere, the state of the round after ``w`` windows has a closed form (``Phase``):
each document finds its windows from its place in its queue alone, and windows are filled
in all partitions at once. When a queue runs dry before the others, the rest go on in a new
phase with their shares scaled up.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseweave.session import materialise

LENGTH = 1024
WINDOW_SEQUENCES = 64
#: Sources with a queue of their own (largest first); all others share one more queue.
MAX_QUEUES = 1_000
END_ID = 0
_encoders: dict[str, object] = {}


def encoder(name: str):
    """Text -> token ids, as the tokenizer file ``name`` gives them without added tokens.

    The same byte-pair ranks are run by the faster of two libraries; texts that spell a
    special token go to the tokenizer file itself, which reads it as that token.
    """
    if name not in _encoders:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(public_tokenizers.path(name))
        specials = [t.content for t in whole.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        plain = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> list[int]:
            if any(s in text for s in specials):
                return whole.encode(text, add_special_tokens=False).ids
            return plain.encode_ordinary(text)

        _encoders[name] = encode
    return _encoders[name]


@dataclass
class Phase:
    """A stretch of windows with the same queues; ``amounts`` are the tokens each gives."""

    base: int
    amounts: list[int]
    firsts: list[int]
    window: int
    total: int = field(init=False)
    sums: list[int] = field(init=False)

    def __post_init__(self) -> None:
        self.sums = [0]
        for a in self.amounts:
            self.sums.append(self.sums[-1] + a)
        self.total = self.sums[-1]

    def given(self, queue: int, tokens: int) -> int:
        """Whole tokens that the queues up to ``queue`` hand over in the first ``tokens``."""
        return tokens * self.sums[queue + 1] // self.total

    def taken(self, queue: int, windows: int) -> int:
        """Tokens that ``queue`` has handed over after so many windows."""
        tokens = min(windows * self.window, self.total)
        return self.given(queue, tokens) - (self.given(queue - 1, tokens) if queue else 0)

    def window_of(self, queue: int, place: int) -> int:
        w = min(place * self.total // (self.amounts[queue] * self.window), -(-self.total // self.window) - 1)
        while self.taken(queue, w) > place:
            w -= 1
        while self.taken(queue, w + 1) <= place:
            w += 1
        return w

    def start(self, queue: int, window: int) -> int:
        """Where the queue's tokens of a window begin, counted over all sequences."""
        low, high = window * self.window, min((window + 1) * self.window, self.total)
        before = self.given(queue - 1, high) - self.given(queue - 1, low) if queue else 0
        return self.base + low + before


def plan(totals: list[int], targets: list[float] | None, window: int) -> list[Phase]:
    """Phases of the round: all queues at their shares until one is empty, then the rest."""
    left, done, phases, base = list(totals), [0] * len(totals), [], 0
    weights = [Fraction(t).limit_denominator(10**6) for t in targets] if targets else [Fraction(t) for t in totals]
    while sum(left):
        active = [q for q, n in enumerate(left) if n and weights[q] > 0] or [q for q, n in enumerate(left) if n]
        share = {q: weights[q] if weights[q] > 0 else Fraction(1) for q in active}
        rounds = min(Fraction(left[q]) / share[q] for q in active)
        amounts = [min(left[q], int(rounds * share[q])) if q in share else 0 for q in range(len(left))]
        phases.append(Phase(base, amounts, list(done), window))
        base += phases[-1].total
        left = [n - a for n, a in zip(left, amounts)]
        done = [n + a for n, a in zip(done, amounts)]
    return phases


def cut(phases: list[Phase], queue: int, place: int, tokens: int, length: int):
    """(first token, tokens, position) of each piece of a document at ``place`` in its queue."""
    firsts = [p.firsts[queue] for p in phases]
    at, stop = place, place + tokens
    while at < stop:
        phase = phases[max(i for i in range(bisect_right(firsts, at)) if phases[i].amounts[queue] and phases[i].firsts[queue] <= at)]
        own = at - phase.firsts[queue]
        window = phase.window_of(queue, own)
        position = phase.start(queue, window) + own - phase.taken(queue, window)
        end = min(stop, phase.firsts[queue] + phase.taken(queue, window + 1))
        while at < end:
            n = min(end - at, length - position % length)
            yield at - place, n, position
            at, position = at + n, position + n


def encode_queues(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, source, part, place, ids, n): ids as bytes; ``place`` counts the tokens of the same source before it in its part."""
    def run(batches):
        encode = encoder(tokenizer)
        places: dict = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = batch.slice(start, 500)
                ids, sizes, at = [], [], []
                for text, source in zip(rows.column("text").to_pylist(), rows.column("source").to_pylist()):
                    own = encode(text) if text else []
                    ids.append(np.array([*own, END_ID], dtype="<u4").astype("<u2" if max(own, default=0) < 65536 else "<u4").tobytes())
                    sizes.append(len(own) + 1)
                    at.append(places.get(source, 0))
                    places[source] = at[-1] + sizes[-1]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("source"), rows.column("part"), pa.array(at, pa.int64()), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64())],
                    ["doc_id", "source", "part", "place", "ids", "n"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("source").cast("string").alias("source")).withColumn("part", F.spark_partition_id())
    return rows.mapInArrow(run, "doc_id long, source string, part int, place long, ids binary, n long")


def pack(
    docs: DataFrame, targets: dict[str, float] | None = None, length: int = LENGTH, window_sequences: int = WINDOW_SEQUENCES,
    tokenizer: str = "byte_bpe_50k.json", max_queues: int = MAX_QUEUES,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, window_id), one row per piece.

    All tokens of all documents are packed; only the last sequence is not full. ``targets``
    are proportions by source; by default each source's share of all tokens, at which all
    queues end together. Nulls: a null text is one end id, a null source has a queue of its
    own, a null doc_id stays null. Repeated rows are packed each. Order in a queue is that of
    the files read. An empty table gives no pieces. Other columns are ignored.
    """
    held = materialise(encode_queues(docs, tokenizer), "tokens")
    sums = materialise(held.groupBy("part", "source").agg(F.sum("n").alias("n")), "queues")
    top = sums.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.col("source").asc_nulls_first()).limit(max_queues).collect()
    everything = sums.agg(F.sum("n")).first()[0] or 0
    named = sorted((r["source"] for r in top), key=lambda s: (s is not None, s or ""))
    own = {r["source"]: r["n"] for r in top}
    totals = [own[s] for s in named] + [everything - sum(own.values())]
    shares = [float((targets or {}).get(s, 0.0)) for s in named] + [0.0] if targets else None
    phases = plan(totals, shares, length * window_sequences)
    spark = docs.sparkSession
    queues = spark.createDataFrame(list(enumerate(named)), "queue int, source string") if named else spark.createDataFrame([], "queue int, source string")
    small = sums.join(F.broadcast(queues), sums["source"].eqNullSafe(queues["source"]), "left").select(
        sums["part"], sums["source"], "n", F.coalesce("queue", F.lit(len(named))).alias("queue")
    )
    before = W.partitionBy("queue").orderBy("part", F.col("source").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    bases = materialise(
        small.select(F.col("part").alias("b_part"), F.col("source").alias("b_source"), "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases"
    )
    placed = held.join(bases, (F.col("part") == F.col("b_part")) & F.col("source").eqNullSafe(F.col("b_source"))).select(
        "doc_id", "source", "queue", (F.col("base") + F.col("place")).alias("place"), "ids", "n"
    )
    window = length * window_sequences

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(9)]
            for doc_id, source, queue, place, ids, n in zip(*(batch.column(i).to_pylist() for i in range(6))):
                tokens = np.frombuffer(ids, dtype="<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                for first, size, position in cut(phases, queue, place, n, length):
                    values = (doc_id, first, size, zlib.crc32(tokens[first : first + size].tobytes()), n, position // length, position % length, source, position // window)
                    for col, value in zip(cols, values):
                        col.append(value)
            kinds = [pa.int64()] * 7 + [pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "window_id"],
            )

    return placed.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, window_id long")
