"""Phrase collocation mining by vertical partitioning of a truncated suffix tree.

The words of all texts form one string per language, cut at punctuation and line ends; a suffix
is truncated after four words, and before the first word that occurs too rarely for any
candidate. Word prefixes are grouped by a memory budget: the weight of a prefix is the number
of suffixes that start with it, prefixes are dealt into groups whose weights add up to the
budget, and a prefix heavier than the budget is extended by one word, counted, and dealt again.
Each group then builds its subtree independently of all others, as one sorted array of its
suffixes; the total of the leaves below a node is the count of the node's phrase. Counts of
heavy prefixes, the trie above the subtrees, come from the counting that split them.

Equal suffixes are combined where they are read, so a suffix that a third of all words share
costs one entry per chunk. What is shipped to all tasks is a bit table of fixed size (rare words
it lets through only cost entries in vain) and the directory of groups, which has a few entries
per group. Scores, cuts and ranks are DataFrame operations on the phrases found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseweave.llm.common import MULTIPLIER, flat, hash_spans, mix, pieces, spans
from caseweave.session import materialise

LEAST, TOP, WITHIN = 30, 2_000, 80
LONGEST = 4
#: Suffixes in a group (as counted in the corpus, so before equal ones are combined), and words read before equal suffixes are combined.
GROUP_SUFFIXES, CHUNK_WORDS = 4_000_000, 1_000_000
#: Bits of the table of frequent words: 8 MB at any size of the corpus.
TABLE_BITS = 26
#: Directory entries for each group's worth of suffixes.
FINENESS = 8

BREAKS = np.zeros(256, dtype=bool)
BREAKS[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
SEPARATORS = BREAKS.copy()
SEPARATORS[list(b" \t")] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
UNKNOWN = "und"


def language_key(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


@dataclass
class Words:
    """The words of a piece of a batch: their keys (language and spelling), places, and which ones follow their neighbour."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    keys: np.ndarray
    linked: np.ndarray
    langs: np.ndarray


def read(piece: pa.RecordBatch, seed: int) -> Words:
    data, offsets = flat(piece.column("text"))
    data = LOWER[data]
    starts, ends, first = spans(data, offsets, SEPARATORS)
    langs = [v if v is not None else UNKNOWN for v in piece.column("lang").to_pylist()]
    known = {v: language_key(v) for v in set(langs)}
    owner = np.repeat(np.arange(len(langs)), np.diff(first))
    own = np.array([known[v] for v in langs], dtype=np.uint64)[owner] if len(owner) else np.zeros(0, dtype=np.uint64)
    keys = np.maximum(mix(hash_spans(data, starts, ends, seed) + own, seed), np.uint64(1))
    part = np.cumsum(BREAKS[data])[starts] if len(starts) else starts
    linked = np.zeros(len(starts), dtype=bool)
    linked[:-1] = (part[1:] == part[:-1]) & (owner[1:] == owner[:-1])
    return Words(data, starts, ends, keys, linked, owner)


def spelled(words: Words, at: np.ndarray) -> pa.Array:
    """The spelling of the words numbered ``at``."""
    starts, sizes = words.starts[at], words.ends[at] - words.starts[at]
    borders = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    place = np.arange(borders[-1], dtype=np.int64) - np.repeat(borders[:-1], sizes) + np.repeat(starts, sizes)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(borders.tobytes()), pa.py_buffer(words.data[place].tobytes()))


def count_words(docs: DataFrame, seed: int) -> DataFrame:
    """(key, lang, word, n): every word of every language with its occurrences."""
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text", 4_000_000):
                words = read(piece, seed)
                keys, at, n = np.unique(words.keys, return_index=True, return_counts=True)
                langs = piece.column("lang").take(pa.array(words.langs[at]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), langs, spelled(words, at), pa.array(n)], ["key", "lang", "word", "n"])

    found = docs.mapInArrow(run, "key long, lang string, word string, n long")
    return found.groupBy("key", "lang", "word").agg(F.sum("n").alias("n"))


# The table of frequent words

def _mark(table: np.ndarray, keys: np.ndarray) -> None:
    slot = keys >> np.uint64(64 - TABLE_BITS)
    np.bitwise_or.at(table, (slot >> np.uint64(3)).astype(np.int64), (np.uint64(1) << (slot & np.uint64(7))).astype(np.uint8))


def marked(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys >> np.uint64(64 - TABLE_BITS)
    return (table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def bit_table(keys: DataFrame) -> np.ndarray:
    """One bit for each range of keys that holds a key of ``keys``."""
    size, step = 1 << (TABLE_BITS - 3), 1 << 16

    def run(batches):
        own = np.zeros(size, dtype=np.uint8)
        for batch in batches:
            _mark(own, batch.column(0).to_numpy().view(np.uint64))
        held = [b for b in range(0, size, step) if own[b : b + step].any()]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([own[b : b + step].tobytes() for b in held], pa.binary())], ["block", "bits"])

    def join(table: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(b, dtype=np.uint8) for b in table.column("bits").to_pylist()])
        return pa.table({"block": table.column("block").slice(0, 1).cast(pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    out = np.zeros(size, dtype=np.uint8)
    for r in keys.select("key").mapInArrow(run, "block int, bits binary").groupBy("block").applyInArrow(join, "block int, bits binary").collect():
        out[r["block"] : r["block"] + step] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


# Suffixes

def packed_order(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts the rows of ids, which rows then differ from the one before)."""
    bits = max(1, int(size).bit_length())
    columns = ids.astype(np.uint64)
    if bits * LONGEST <= 64:
        key = np.zeros(len(ids), dtype=np.uint64)
        for d in range(LONGEST):
            key = (key << np.uint64(bits)) | columns[:, d]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.ones(len(ids), dtype=bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        return order, fresh
    high, low = (columns[:, 0] << np.uint64(32)) | columns[:, 1], (columns[:, 2] << np.uint64(32)) | columns[:, 3]
    order = np.lexsort((low, high))
    fresh = np.ones(len(ids), dtype=bool)
    fresh[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    return order, fresh


def combined(ids: np.ndarray, size: int, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, with the sums of ``n``."""
    if not len(ids):
        return ids, n
    order, fresh = packed_order(ids, size)
    heads = np.flatnonzero(fresh)
    return ids[order[heads]], np.add.reduceat(n[order], heads)


def suffixes(batches, table: np.ndarray, seed: int, chunk_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys of the words, distinct suffixes as rows of word numbers, occurrences); number 0 is no word."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        keys = np.concatenate([k for k, _ in held])
        linked = np.concatenate([v for _, v in held])
        use = marked(table, keys)
        vocabulary, numbers = np.unique(keys[use], return_inverse=True)
        ids = np.zeros(len(keys) + LONGEST, dtype=np.int64)
        ids[np.flatnonzero(use)] = numbers + 1
        rows = np.zeros((len(keys), LONGEST), dtype=np.uint32)
        rows[:, 0] = ids[: len(keys)]
        goes_on = rows[:, 0] > 0
        follows = np.concatenate([linked, np.zeros(LONGEST, dtype=bool)])
        for d in range(1, LONGEST):
            goes_on = goes_on & follows[d - 1 : d - 1 + len(keys)] & (ids[d : d + len(keys)] > 0)
            rows[goes_on, d] = ids[d : d + len(keys)][goes_on]
        rows = rows[rows[:, 1] > 0]
        return np.concatenate([np.zeros(1, dtype=np.uint64), vocabulary]), *combined(rows, len(vocabulary), np.ones(len(rows), dtype=np.int64))

    for batch in batches:
        for piece in pieces(batch, "text"):
            words = read(piece, seed)
            held.append((words.keys, words.linked))
            size += len(words.keys)
            if size >= chunk_words:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def prefix_keys(words: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The key of each row's first 1, 2, 3 and 4 words."""
    keys = [words[rows[:, 0]]]
    for d in range(1, LONGEST):
        keys.append(mix(keys[-1] * np.uint64(MULTIPLIER) + words[rows[:, d]], d))
    return keys


def among(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


@dataclass
class Level:
    """Prefixes of one length: the heavy ones, and the group of each range of keys of the others."""

    bits: int
    group_of: np.ndarray
    heavy: np.ndarray


@dataclass
class Directory:
    levels: list[Level] = field(default_factory=list)

    def place(self, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group of each row, -1 where it needs none; length of the prefix that chose it)."""
        group = np.full(len(rows), -1, dtype=np.int64)
        depth = np.zeros(len(rows), dtype=np.int64)
        open_rows = np.ones(len(rows), dtype=bool)
        for d, (level, keys) in enumerate(zip(self.levels, prefix_keys(words, rows))):
            heavy = open_rows & among(level.heavy, keys)
            here = np.flatnonzero(open_rows & ~heavy)
            slot = (keys[here] >> np.uint64(64 - level.bits)).astype(np.int64) if level.bits else np.zeros(len(here), dtype=np.int64)
            group[here], depth[here] = level.group_of[slot], d + 1
            open_rows = heavy & (rows[:, min(d + 1, LONGEST - 1)] > 0)
        return group, depth

    @property
    def groups(self) -> int:
        return max((int(level.group_of.max(initial=-1)) for level in self.levels), default=-1) + 1


def next_level(prefixes: DataFrame, budget: int, first_group: int, last: bool) -> Level:
    """Deals the prefixes (key, n) of one length into groups of ``budget`` suffixes; heavier ones are listed, unless they cannot be extended."""
    light = F.lit(True) if last else F.col("n") <= budget
    total = prefixes.where(light).agg(F.sum("n")).first()[0] or 0
    bits = max(0, int(FINENESS * total // budget).bit_length())
    bucket = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("bigint")
    weights = np.zeros(1 << bits, dtype=np.int64)
    for r in prefixes.where(light).groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).collect():
        weights[r["bucket"]] = r["n"]
    group_of = first_group + (np.cumsum(weights) - weights) // budget
    heavy = [] if last else [r["key"] for r in prefixes.where(~light).select("key").collect()]
    return Level(bits, group_of, np.sort(np.array(heavy, dtype=np.int64).view(np.uint64)))


PHRASE = "w1 long, w2 long, w3 long, w4 long, a long"


def _extended(docs: DataFrame, shared, directory: Directory, seed: int, chunk_words: int) -> DataFrame:
    """(key, w1 .. w4, n) of each prefix that extends a heavy one of the last level by one word."""
    depth = len(directory.levels) + 1
    names = [f"w{d}" for d in range(1, LONGEST + 1)]

    def run(batches):
        for words, rows, n in suffixes(batches, shared.value, seed, chunk_words):
            keys = prefix_keys(words, rows)
            take = among(directory.levels[-1].heavy, keys[depth - 2]) & (rows[:, depth - 1] > 0)
            cut = rows[take]
            cut[:, depth:] = 0
            cut, sums = combined(cut, len(words), n[take])
            own = prefix_keys(words, cut)[depth - 1]
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), *(pa.array(words[cut[:, d]].view(np.int64)) for d in range(LONGEST)), pa.array(sums)], ["key", *names, "n"])

    found = docs.mapInArrow(run, f"key long, {PHRASE.replace('a long', 'n long')}")
    return found.groupBy("key", *names).agg(F.sum("n").alias("n"))


def _sent(docs: DataFrame, shared, directory: Directory, seed: int, chunk_words: int) -> DataFrame:
    """(group, depth, words, ids, n): the suffixes of a chunk that belong to a group, in a dictionary of their own."""
    ship = docs.sparkSession.sparkContext.broadcast(directory)

    def run(batches):
        own = ship.value
        for words, rows, n in suffixes(batches, shared.value, seed, chunk_words):
            group, depth = own.place(words, rows)
            order = np.flatnonzero(group >= 0)
            order = order[np.argsort(group[order], kind="stable")]
            heads = np.flatnonzero(np.diff(group[order], prepend=-1))
            cols: list[list] = [[] for _ in range(5)]
            for a, b in zip(heads, np.append(heads[1:], len(order))):
                at = order[a:b]
                used, ids = np.unique(rows[at], return_inverse=True)
                ids = ids.reshape(-1, LONGEST) + (used[0] != 0)
                used = used[used != 0]
                for col, v in zip(cols, (int(group[at[0]]), int(depth[at[0]]), words[used].astype("<u8").tobytes(), ids.T.astype("<u2" if len(used) < 65535 else "<u4").tobytes(), n[at].astype("<u4").tobytes())):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["group", "depth", "words", "ids", "n"])

    return docs.mapInArrow(run, "group long, depth int, words binary, ids binary, n binary")


def subtree(words: list[np.ndarray], ids: list[np.ndarray], n: list[np.ndarray], depth: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the words, occurrences) of each node from ``depth`` down that occurs ``least`` times."""
    vocabulary = np.unique(np.concatenate(words))
    rows = np.concatenate([np.concatenate([[0], np.searchsorted(vocabulary, w) + 1])[i] for w, i in zip(words, ids)]).astype(np.uint32)
    leaves, totals = combined(rows, len(vocabulary), np.concatenate(n).astype(np.int64))
    keys = np.concatenate([np.zeros(1, dtype=np.uint64), vocabulary])
    nodes, counts = [np.zeros((0, LONGEST), dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    fresh = np.zeros(len(leaves), dtype=bool)
    fresh[:1] = True
    for d in range(1, LONGEST + 1):
        fresh[1:] |= leaves[1:, d - 1] != leaves[:-1, d - 1]
        if d < max(2, depth):
            continue
        heads = np.flatnonzero(fresh)
        below = np.add.reduceat(totals, heads) if len(heads) else totals
        take = heads[(below >= least) & (leaves[heads, d - 1] > 0)]
        own = keys[leaves[take]]
        own[:, d:] = 0
        nodes.append(own)
        counts.append(below[(below >= least) & (leaves[heads, d - 1] > 0)])
    return np.concatenate(nodes), np.concatenate(counts)


def count_phrases(docs: DataFrame, frequent: DataFrame, seed: int, least: int = LEAST, budget: int = GROUP_SUFFIXES, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(w1, w2, w3, w4, a): keys of the words of each phrase of two to four words that occurs ``least`` times."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(frequent))
    directory = Directory([next_level(frequent, budget, 0, False)])
    above = None
    while len(directory.levels[-1].heavy) and len(directory.levels) < LONGEST:
        found = materialise(_extended(docs, shared, directory, seed, chunk_words), "prefixes")
        last = len(directory.levels) + 1 == LONGEST
        level = next_level(found.select("key", "n"), budget, directory.groups, last)
        if not last:
            top = found.where(F.col("n") > budget).select("w1", "w2", "w3", "w4", F.col("n").alias("a"))
            above = top if above is None else above.unionByName(top)
        directory.levels.append(level)

    def run(table: pa.Table) -> pa.Table:
        words = [np.frombuffer(b, dtype="<u8") for b in table.column("words").to_pylist()]
        n = [np.frombuffer(b, dtype="<u4") for b in table.column("n").to_pylist()]
        ids = [np.frombuffer(b, dtype="<u2" if len(b) == 2 * LONGEST * len(m) else "<u4").reshape(LONGEST, -1).T for b, m in zip(table.column("ids").to_pylist(), n)]
        nodes, counts = subtree(words, ids, n, table.column("depth")[0].as_py(), least)
        return pa.table({**{f"w{d + 1}": pa.array(nodes[:, d].copy().view(np.int64)) for d in range(LONGEST)}, "a": pa.array(counts)})

    found = _sent(docs, shared, directory, seed, chunk_words).groupBy("group").applyInArrow(run, PHRASE)
    return found if above is None else found.unionByName(above.where(F.col("a") >= least))


# Scores

def _whole(value: Column) -> Column:
    return value.cast("decimal(38,0)")


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, within: int = WITHIN, budget: int = GROUP_SUFFIXES, chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two to four words of each language.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts at its lowest-scoring cut, ``n`` all words
    of the language; the score is floor(2000000 a / (l + r)), compared and divided as whole decimals.
    A phrase that lies inside a longer one with at least ``within`` percent of its occurrences is
    left out. Ties go to the more frequent phrase, then by bytes. A null text is empty, a null
    language is ``und``; repeated rows count each; an empty table gives no phrases; other columns
    (doc_id too) are ignored. Texts are read whole, one at a time where they are long: a task needs
    about 40 bytes for each byte of its longest text.

    Words are told apart by 64-bit keys. All words of the corpus are compared with their keys first;
    should two share one, other keys are taken.
    """
    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))
    seed = 0
    while True:
        words = materialise(count_words(rows, seed), "words")
        if not words.groupBy("key").count().where(F.col("count") > 1).limit(1).count():
            break
        seed += 1
    frequent = materialise(words.where(F.col("n") >= least), "frequent")
    spelling = frequent.select("key", "lang", "word")
    phrases = count_phrases(rows, frequent, seed, least, budget, chunk_words)
    for d in range(1, LONGEST + 1):
        own = spelling.select(F.col("key").alias(f"w{d}"), F.col("word").alias(f"word{d}"), *([F.col("lang")] if d == 1 else []))
        phrases = phrases.join(own, f"w{d}", "inner" if d <= 2 else "left")
    listed = F.array_compact(F.array(*(f"word{d}" for d in range(1, LONGEST + 1))))
    found = materialise(phrases.select("lang", listed.alias("words"), "a").withColumn("phrase", F.array_join("words", " ")), "phrases")
    counts = found.select("lang", "phrase", F.col("a").alias("f")).unionByName(frequent.select("lang", F.col("word").alias("phrase"), F.col("n").alias("f")))

    def part(first, size) -> Column:
        return F.array_join(F.slice("words", first, size), " ")

    cuts = found.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.withColumn("twice", _whole(F.col("a")) * F.lit(2_000_000)).withColumn("both", _whole(F.col("l")) + _whole(F.col("r"))).withColumn("score", F.expr("twice div both"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = found.where(F.size("words") > 2).select("lang", "words", "a", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("m"))
    inner = inner.select("lang", "words", "a", "m", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("m") + 1)).alias("at"))
    longer = inner.select("lang", part(F.col("at"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_whole(F.col("longer")) * 100 < _whole(F.col("a")) * within))

    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
