"""Alignment of two tokenizers by merge-path partitioning.

A text is encoded by tokenizer A and by tokenizer B; both cut the same bytes. Where a token of A
and a token of B end at the same byte, a group closes, and the tokens of a group are linked with
each other. The sorted ends of A and of B are merged to find these places: binary searches along
diagonals of the merge divide it into pieces of equal work, whatever the tokens' lengths; each
piece emits the group ends among its own overlaps, and an end whose two tokens fell to two
neighbouring pieces is stitched at their border.

Texts are worked through in chunks of bounded size. Groups of the same tokens are one type of
group, so everything that links add up to is computed per type and summed per document. A chunk
tells the corpus its distinct pairs of ids with the documents that hold them; Spark adds them up,
finds each A id's highest count, and sends every chunk the counts of its own pairs.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseweave.llm.common import mix, pieces, powers
from caseweave.session import materialise

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
CHUNK_BYTES = 6_000_000
#: Ends that a piece of the merge has to go through.
WORK = 1 << 16
_loaded: dict = {}


@dataclass
class Side:
    """A tokenizer: texts to ids, and the bytes of each id."""

    encode: object
    spelled: list[bytes]
    sizes: np.ndarray


def byte_ranks(path: str) -> Side:
    """Byte-level ranks; the strings of special tokens are plain text. Encodes a space and the text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    spelled = [b""] * (max(ranks.values()) + 1)
    for token, number in ranks.items():
        spelled[number] = token
    return Side(lambda texts: [plain.encode_ordinary(" " + t) for t in texts], spelled, np.array([len(s) for s in spelled]))


def pieces_model(path: str) -> Side:
    """Word pieces with byte fallback. Encodes the text, to which the model adds a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled = [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]
    return Side(lambda texts: model.encode(texts, num_threads=1), spelled, np.array([len(s) for s in spelled]))


def side(name: str) -> Side:
    if name not in _loaded:
        import public_tokenizers

        path = public_tokenizers.path(name)
        _loaded[name] = pieces_model(path) if name.endswith(".model") else byte_ranks(path)
    return _loaded[name]


# The merge

def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of sorted ``a`` and ``b`` (of equals, a's first) stands after 0, work, 2 work, ... steps and at its end."""
    steps = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(0, steps - len(b)), np.minimum(steps, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        before = np.zeros(len(steps), dtype=bool)
        before[open_] = a[middle[open_]] <= b[steps[open_] - 1 - middle[open_]]
        low, high = np.where(before, middle + 1, low), np.where(open_ & ~before, middle, high)
    return low, steps - low


def piece_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of the ends that both hold, found by this piece alone."""
    if not len(a) or not len(b):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    own = np.flatnonzero(b[at] == a)
    return own, at[own]


def group_ends(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """For each group the number of the token of A, and of B, that closes it."""
    i, j = diagonals(a, b, work)
    found_a, found_b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for p in range(len(i) - 1):
        own_a, own_b = piece_ends(a[i[p] : i[p + 1]], b[j[p] : j[p + 1]])
        found_a.append(own_a + i[p])
        found_b.append(own_b + j[p])
        # equal ends with a border between them: A's is the last of this piece, B's the first of the next
        if 0 < i[p + 1] and j[p + 1] < len(b) and i[p + 1] > i[p] and a[i[p + 1] - 1] == b[j[p + 1]]:
            found_a.append(np.array([i[p + 1] - 1]))
            found_b.append(np.array([j[p + 1]]))
    return np.concatenate(found_a), np.concatenate(found_b)


# Groups and their types

@dataclass
class Aligned:
    """Groups of a chunk's texts: which texts have tokens, and each text's groups as numbers of types."""

    n_a: np.ndarray
    n_b: np.ndarray
    first: np.ndarray
    kinds: np.ndarray
    a_size: np.ndarray
    a_ids: np.ndarray
    b_size: np.ndarray
    b_ids: np.ndarray


def _fingerprints(ids: np.ndarray, heads: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    within = np.arange(len(ids)) - np.repeat(heads, sizes)
    return np.add.reduceat(mix(ids.astype(np.uint64), seed) * powers(int(sizes.max()))[within], heads)


def _taken(ids: np.ndarray, heads: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The ids of the groups numbered ``which``, one after the other."""
    own = sizes[which]
    return ids[np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own) + np.repeat(heads[which], own)]


def align_texts(texts: list[str | None], a: Side, b: Side, work: int = WORK) -> Aligned:
    """Encodes and aligns texts. A text that is null or empty, or whose tokens do not spell it, has none."""
    plain = [t or "" for t in texts]
    ids_a, ids_b = a.encode(plain), b.encode(plain)
    n_a, n_b = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    for k, t in enumerate(plain):
        if t:
            whole = b" " + t.encode()
            if b"".join(map(a.spelled.__getitem__, ids_a[k])) == whole and b"".join(map(b.spelled.__getitem__, ids_b[k])) == whole:
                n_a[k], n_b[k] = len(ids_a[k]), len(ids_b[k])
    none = np.zeros(0, dtype=np.int64)
    flat_a = np.concatenate([none, *(np.array(ids_a[k], dtype=np.int64) for k in np.flatnonzero(n_a))])
    flat_b = np.concatenate([none, *(np.array(ids_b[k], dtype=np.int64) for k in np.flatnonzero(n_a))])
    if not len(flat_a):
        return Aligned(n_a, n_b, np.zeros(len(texts) + 1, dtype=np.int64), none, none, none, none, none)
    # texts lie one after the other, so each ends with an end of both
    close_a, close_b = group_ends(np.cumsum(a.sizes[flat_a]), np.cumsum(b.sizes[flat_b]), work)
    size_a, size_b = np.diff(close_a, prepend=-1), np.diff(close_b, prepend=-1)
    head_a, head_b = close_a + 1 - size_a, close_b + 1 - size_b
    first = np.searchsorted(close_a, np.concatenate([[0], np.cumsum(n_a)]) - 1, side="right")
    first[0] = 0
    seed = 0
    while True:
        mark = mix(_fingerprints(flat_a, head_a, size_a, seed) + size_a.astype(np.uint64), seed) + _fingerprints(flat_b, head_b, size_b, seed + 1)
        _, one, kinds = np.unique(mark, return_index=True, return_inverse=True)
        own = one[kinds]
        same = (size_a[own] == size_a).all() and (size_b[own] == size_b).all()
        if same and (_taken(flat_a, head_a, size_a, own) == flat_a).all() and (_taken(flat_b, head_b, size_b, own) == flat_b).all():
            break
        seed += 2
    return Aligned(n_a, n_b, first, kinds, size_a[one], _taken(flat_a, head_a, size_a, one), size_b[one], _taken(flat_b, head_b, size_b, one))


def written(sizes: np.ndarray, ids: np.ndarray) -> list[str]:
    """The ids of each type, joined by commas."""
    text = list(map(str, ids.tolist()))
    ends = np.cumsum(sizes).tolist()
    return [",".join(text[e - n : e]) for e, n in zip(ends, sizes.tolist())]


def group_texts(found: Aligned) -> list[str]:
    """``a1,a2|b1;a3|b2`` for each text, empty without tokens."""
    types = [f"{x}|{y}" for x, y in zip(written(found.a_size, found.a_ids), written(found.b_size, found.b_ids))]
    kinds, borders = found.kinds.tolist(), found.first.tolist()
    return [";".join(map(types.__getitem__, kinds[s:e])) for s, e in zip(borders[:-1], borders[1:])]


def type_links(a_size: np.ndarray, a_ids: np.ndarray, b_size: np.ndarray, b_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(type, pair as a * 2**32 + b, links): the distinct pairs of each type, by type."""
    def distinct(sizes, ids):
        kind = np.repeat(np.arange(len(sizes)), sizes)
        keys, n = np.unique((kind << 32) | ids, return_counts=True)
        return np.bincount(keys >> 32, minlength=len(sizes)), keys & 0xFFFFFFFF, n

    many_a, own_a, times_a = distinct(a_size, a_ids)
    many_b, own_b, times_b = distinct(b_size, b_ids)
    total = many_a * many_b
    kind = np.repeat(np.arange(len(total)), total)
    k = np.arange(len(kind)) - np.repeat(np.cumsum(total) - total, total)
    x = (np.cumsum(many_a) - many_a)[kind] + k // many_b[kind]
    y = (np.cumsum(many_b) - many_b)[kind] + k % many_b[kind]
    return kind, (own_a[x] << 32) | own_b[y], times_a[x] * times_b[y]


def _blob(values: np.ndarray, dtype: str = "<u4") -> bytes:
    return np.ascontiguousarray(values).astype(dtype).tobytes()


CHUNK = (
    "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digest array<string>, kinds_of array<long>, "
    "kinds binary, times binary, a_size binary, a_ids binary, b_size binary, b_ids binary, pairs binary, held binary"
)


def _chunk_row(number: int, piece: pa.RecordBatch, found: Aligned) -> list:
    documents = np.diff(found.first)
    owner = np.repeat(np.arange(len(documents)), documents)
    types = len(found.a_size)
    used, times = np.unique(owner * max(types, 1) + found.kinds, return_counts=True)
    own_doc, own_kind = used // max(types, 1), used % max(types, 1)
    kind, pair, links = type_links(found.a_size, found.a_ids, found.b_size, found.b_ids)
    pairs, at = np.unique(pair, return_inverse=True)
    heads = np.searchsorted(kind, np.arange(types + 1))
    # documents that hold each pair: distinct pairs of each document, a bounded number of documents at a time
    many = np.diff(heads)[own_kind]
    held, low = np.zeros(len(pairs), dtype=np.int64), 0
    border = np.searchsorted(own_doc, np.arange(len(documents) + 1))
    reach = np.concatenate([[0], np.cumsum(many)])[border]
    while low < len(documents):
        high = max(low + 1, int(np.searchsorted(reach, reach[low] + 4_000_000, side="right")) - 1)
        entries = slice(border[low], border[high])
        n = many[entries]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(heads[own_kind[entries]], n)
        distinct = np.unique(np.repeat(own_doc[entries], n) * max(len(pairs), 1) + at[place])
        held += np.bincount(distinct % max(len(pairs), 1), minlength=len(pairs))[: len(pairs)]
        low = high
    n_links = np.bincount(owner, weights=(found.a_size * found.b_size)[found.kinds], minlength=len(documents)).astype(np.int64)
    digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in group_texts(found)]
    return [
        number, piece.column("doc_id").to_pylist(), found.n_a.tolist(), found.n_b.tolist(), documents.tolist(), n_links.tolist(), digests, np.diff(border).tolist(),
        _blob(own_kind), _blob(times), _blob(found.a_size), _blob(found.a_ids), _blob(found.b_size), _blob(found.b_ids), _blob(pairs, "<i8"), _blob(held),
    ]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def align(docs: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B, chunk_bytes: int = CHUNK_BYTES, work: int = WORK) -> DataFrame:
    """(doc_id, n_a, n_b, groups): the alignment of each text itself, as ``a1,a2|b1;a3|b2`` with ids in order."""
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text", chunk_bytes):
                found = align_texts(piece.column("text").to_pylist(), side(a), side(b), work)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(found.n_a), pa.array(found.n_b), pa.array(group_texts(found), pa.string())], ["doc_id", "n_a", "n_b", "groups"])

    return _rows(docs).mapInArrow(run, "doc_id long, n_a long, n_b long, groups string")


def _chunks(docs: DataFrame, a: str, b: str, chunk_bytes: int, work: int) -> DataFrame:
    kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.binary()] * 8]
    names = [c.strip().split(" ")[0] for c in CHUNK.split(", ")]

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in pieces(batch, "text", chunk_bytes):
                row = _chunk_row(number, piece, align_texts(piece.column("text").to_pylist(), side(a), side(b), work))
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    return _rows(docs).mapInArrow(run, CHUNK)


def _pairs(chunks: DataFrame) -> DataFrame:
    """(chunk, pair, held): the distinct pairs of every chunk."""
    def run(batches):
        for batch in batches:
            for number, pairs, held in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = np.frombuffer(pairs, dtype="<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), number)), pa.array(own), pa.array(np.frombuffer(held, dtype="<u4").astype(np.int64))], ["chunk", "pair", "held"])

    return chunks.select("chunk", "pairs", "held").mapInArrow(run, "chunk long, pair long, held long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, a, b, documents, best): documents that hold a link of the two ids, and whether that is the A id's highest count."""
    counts = pairs.groupBy("pair").agg(F.sum("held").alias("documents")).withColumn("a", F.shiftright("pair", 32)).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    return counts.withColumn("best", F.col("documents") == F.max("documents").over(W.partitionBy("a")))


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(chunk: pa.Table, answers: pa.Table) -> pa.Table:
    if not chunk.num_rows:
        return pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())]).empty_table()
    row = chunk.to_pylist()[0]
    own = {n: np.frombuffer(row[n], dtype="<u4").astype(np.int64) for n in ("kinds", "times", "a_size", "a_ids", "b_size", "b_ids")}
    answers = answers.take(pc.sort_indices(answers.column("pair")))
    pairs, documents, best = (answers.column(n).to_numpy() for n in ("pair", "documents", "best"))
    n_best, count_sum = (np.zeros(len(own["a_size"]), dtype=np.int64) for _ in range(2))
    if len(pairs):
        kind, pair, links = type_links(own["a_size"], own["a_ids"], own["b_size"], own["b_ids"])
        at, heads = np.searchsorted(pairs, pair), np.flatnonzero(np.diff(kind, prepend=-1))
        n_best, count_sum = (np.add.reduceat(links * v[at], heads) for v in (best.astype(np.int64), documents))
    ends = np.cumsum(np.array(row["kinds_of"], dtype=np.int64))

    def per_document(values):
        sums = np.concatenate([[0], np.cumsum(values[own["kinds"]] * own["times"])])
        return pa.array(np.diff(sums[np.concatenate([[0], ends])]), pa.int64())

    return pa.table({
        "doc_id": pa.array(row["doc_id"], pa.int64()), **{n: pa.array(row[n], pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")},
        "n_best": per_document(n_best), "count_sum": per_document(count_sum), "groups_sha256": pa.array(row["digest"], pa.string()),
    })


def link_scores(docs: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B, chunk_bytes: int = CHUNK_BYTES, work: int = WORK) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row of ``docs``.

    Every row is a document, repeated rows and null ids too. A null or empty text, or one whose
    tokens of A or B do not spell a space and the text, has no tokens: zeros and an empty digest.
    Of equal counts all are an id's best. An empty table gives no rows; other columns are ignored.
    Texts are worked through whole: a task needs about 200 bytes for each byte of a chunk, or of
    its longest text, and memory for the distinct links of a single group.
    """
    chunks = materialise(_chunks(docs, a, b, chunk_bytes, work), "chunks")
    pairs = _pairs(chunks)
    counts = materialise(pair_counts(pairs).select("pair", "documents", "best"), "pair_counts")
    answers = pairs.select("chunk", "pair").join(counts, "pair").select("chunk", "pair", "documents", "best")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scored, RESULT)
