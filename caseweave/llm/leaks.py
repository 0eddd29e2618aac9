"""Benchmark decontamination by latent semantic retrieval and subsequence checks.

Every text is read as overlapping passages of words, every benchmark item as query passages. A
passage meets a query passage only through the query's own rare words: of the words a query has,
so many must be found that at least ``HITS`` of its rarest ones are among them, whatever the size
of the corpus; an inverted index from these words to the queries finds the pairs. A passage is
a TF-IDF vector over the words of the benchmark; pairs whose cosine in the latent space is too
small are dropped. The latent space comes from a randomised singular value decomposition of all
passages of the corpus that do not overlap, together with the benchmark's own: the products with
the passage matrix are summed by Spark in blocks of terms, and only term x rank matrices meet on
the driver. What is left is checked word by word: the
longest common subsequence must cover most of a part of the item, or enough of it plus its
answer (its last words), which catches paraphrases.

Beside this, any ``RUN`` consecutive words of an item are a leak, and items too short for passages
are compared as whole word sequences: both are looked up by the hash of the words and compared.

The benchmark is the stated query set. It is worked through in blocks of ``block_items``, so
that what is shipped to the tasks is bounded by a block and never by the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import NOT_WORD, flat, hash_spans, pieces, spans, window_hashes
from caseweave.session import materialise

WIDTH, STRIDE, ITEM_STRIDE = 24, 8, 4
#: Items above ``PART`` words are looked for in parts that overlap by half. Items under ``LEAST_WORDS`` words are
#: looked for as they stand; under ``ALONE`` words they leak only into a text that holds nothing else.
PART, ANSWER, LEAST_WORDS, ALONE, RUN = 64, 8, 8, 5, 24
COSINE, WHOLE, PARAPHRASE, ANSWERED = 0.5, 0.8, 0.6, 0.6
#: A candidate holds HITS of the rarest words of a query, when at least FOUND of its words are in the passage.
HITS, FOUND = 3, 0.45
RANK, EXTRA, BLOCK_ITEMS, TERM_BLOCK = 128, 16, 2_000, 256
#: Terms up to which a task sums pairs of terms, and passages it works on at a time.
GRAM, PASSAGES = 4_096, 16_384


def word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-case word, first word of each text)."""
    data, offsets = flat(pc.utf8_lower(column.cast(pa.large_string())))
    starts, ends, first = spans(data, offsets, NOT_WORD)
    return hash_spans(data, starts, ends), first


@dataclass
class Vocabulary:
    """Words of the benchmark block, sorted by hash, found through a small bit table."""

    hashes: np.ndarray

    def __post_init__(self) -> None:
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def terms(self, words: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 for words outside."""
        out = np.full(len(words), -1, dtype=np.int32)
        maybe = np.flatnonzero(self.bits[(words >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, words[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == words[maybe]
        out[maybe[hit]] = at[hit]
        return out


def passages(first: np.ndarray, width: int = WIDTH, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) in words of every passage; the last one ends with the text."""
    n = np.diff(first)
    counts = np.where(n > 0, np.maximum(0, -(-(n - width) // stride)) + 1, 0)
    owner = np.repeat(np.arange(len(n)), counts)
    turn = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = first[:-1][owner] + turn * stride
    return owner, start, np.minimum(start + width, first[1:][owner])


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different values in order, how often each occurs); by sorting, which is faster than ``np.unique`` here."""
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([np.ones(min(len(values), 1), dtype=bool), values[1:] != values[:-1]]))
    return values[first], np.diff(first, append=len(values))


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit rows."""
    places: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b.tolist():
        at = places.get(w)
        if at:
            hit = row & at
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def within_reach(part: np.ndarray, region: np.ndarray) -> bool:
    """False if a region holds too few of a part's words, in whatever order, for ``judge`` to find a leak."""
    held = set(region.tolist())
    return sum(w in held for w in part.tolist()) / len(part) >= PARAPHRASE


def judge(part: np.ndarray, region: np.ndarray) -> tuple[int, float, bool]:
    """(common words, share of the answer found, leaked) for a benchmark part in a region of a text."""
    found = common_words(part, region)
    ratio = found / len(part)
    answer = part[-ANSWER:]
    answered = common_words(answer, region) / len(answer)
    return found, answered, ratio >= WHOLE or (ratio >= PARAPHRASE and answered >= ANSWERED)


def _terms(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(lengths, terms): the terms of all corpus passages that do not overlap, and how many each of them holds; a row for each piece of a batch."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.hashes)
    kind = _kind(len(vocabulary.hashes))

    def run(batches):
        held = Vocabulary(shared.value)
        for batch in batches:
            for piece in pieces(batch, "text"):
                words, first = word_hashes(piece.column("text"))
                terms = held.terms(words)
                _, start, end = passages(first, WIDTH, WIDTH)
                known = np.concatenate([[0], np.cumsum(terms >= 0)])
                lengths = (known[end] - known[start]).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([lengths.tobytes()], pa.binary()), pa.array([terms[terms >= 0].astype(kind).tobytes()], pa.binary())], ["lengths", "terms"])

    return docs.select("text").mapInArrow(run, "lengths binary, terms binary")


def _kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _read(batches, size: int):
    """(terms, passage of each, number of terms of each passage) of every row of ``_terms``."""
    for batch in batches:
        for lengths, terms in zip(batch.column("lengths"), batch.column("terms")):
            n = np.frombuffer(lengths.as_py(), dtype=np.uint8).astype(np.int64)
            yield np.frombuffer(terms.as_py(), dtype=_kind(size)).astype(np.int64), np.repeat(np.arange(len(n)), n), n


def _counts(docs: DataFrame, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """(number of passages, passages that hold each term), over passages that do not overlap; of documents or of the rows of ``_terms``."""
    size = len(vocabulary.hashes)
    rows = docs if "terms" in docs.columns else _terms(docs, vocabulary)

    def run(batches):
        own, total = np.zeros(size, dtype=np.int64), 0
        for terms, passage, n in _read(batches, size):
            own += np.bincount(distinct(passage * size + terms)[0] % size, minlength=size)
            total += len(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, size)), pa.array(np.concatenate([[total], own]))], ["term", "n"])

    counted = np.zeros(size + 1, dtype=np.int64)
    for r in rows.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        counted[r["term"] + 1] = r["n"]
    return int(counted[0]), counted[1:]


def _latent(terms: np.ndarray, start: np.ndarray, end: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit vectors of passages in the latent space."""
    lengths = end - start
    out = np.zeros((len(start), basis.shape[1]), dtype=np.float32)
    for j in range(int(lengths.max(initial=0))):
        rows = np.flatnonzero(lengths > j)
        t = terms[start[rows] + j]
        rows, t = rows[t >= 0], t[t >= 0]
        out[rows] += basis[t]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def _summed(t: np.ndarray, n: np.ndarray, weighted: np.ndarray, weights: np.ndarray, out: np.ndarray) -> None:
    """Adds the terms' sums of A'(A X) to ``out``, for unit passages A of ``n`` terms each, ``t``, one after the other."""
    heads = np.cumsum(n) - n
    y = np.add.reduceat(weighted[t], heads, axis=0) / np.add.reduceat(weights[t] ** 2, heads)[:, None]
    order = np.argsort(t, kind="stable")
    first = np.flatnonzero(np.diff(t[order], prepend=-1))
    out[t[order[first]]] += np.add.reduceat(y[np.repeat(np.arange(len(n)), n)[order]], first, axis=0)


def _shared(t: np.ndarray, n: np.ndarray, weights: np.ndarray, out: np.ndarray) -> None:
    """Adds to ``out`` how much each two terms have in common in unit passages of ``n`` terms each, ``t``, one after the other.
    Every pair is added one way only, so the sums are ``out`` and its transpose together."""
    size = len(weights)
    heads = np.cumsum(n) - n
    scale = np.repeat(1.0 / np.add.reduceat(weights[t] ** 2, heads), n)
    left = np.repeat(heads + n, n) - np.arange(len(t))
    codes, values = [t * (size + 1)], [scale / 2]
    for ahead in range(1, int(n.max())):
        at = np.flatnonzero(left > ahead)
        codes.append(t[at] * size + t[at + ahead])
        values.append(scale[at])
    # added in place: a second table of all pairs would take twice the memory of the first
    np.add.at(out.ravel(), np.concatenate(codes), np.concatenate(values).astype(out.dtype))


def _products(rows: DataFrame, factor: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A'(A X) for all passages A in ``rows`` that hold ``HITS`` terms, summed in blocks of terms and two steps.

    A task sums what its passages' terms have in common and multiplies once; beyond ``GRAM`` terms, passage by passage.
    """
    shared = rows.sparkSession.sparkContext.broadcast((factor, idf))

    def run(batches):
        x, weights = shared.value
        size = len(weights)
        out = np.zeros(x.shape)
        weighted = (x * weights[:, None]).astype(np.float32)
        together = np.zeros((size, size), dtype=np.float32) if size <= GRAM else None
        waiting, held = [], 0

        def add():
            t, n = np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting])
            if together is not None:
                _shared(t, n, weights, together)
            else:
                _summed(t, n, weighted, weights, out)

        for terms, passage, n in _read(batches, size):
            full = n >= HITS
            own, many = terms[full[passage]], n[full]
            for at in range(0, len(many), PASSAGES):
                low, high = int(many[:at].sum()), int(many[: at + PASSAGES].sum())
                waiting.append((own[low:high], many[at : at + PASSAGES]))
                held += len(waiting[-1][1])
                if held >= PASSAGES:
                    add()
                    waiting, held = [], 0
        if waiting:
            add()
        if together is not None:
            out += together @ weighted
            out += together.T @ weighted
        out *= weights[:, None]
        blocks = range(0, len(out), TERM_BLOCK)
        yield pa.RecordBatch.from_arrays(
            [pa.array([b for b in blocks], pa.int32()), pa.array([out[b : b + TERM_BLOCK].astype("<f8").tobytes() for b in blocks], pa.binary())], ["block", "sums"]
        )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s, dtype="<f8") for s in table.column("sums").to_pylist())
        return pa.table({"block": table.column("block").slice(0, 1).cast(pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    partial = rows.mapInArrow(run, "block int, sums binary").withColumn("salt", F.spark_partition_id() % 32)
    salted = partial.groupBy("block", "salt").applyInArrow(lambda t: add(t.select(["block", "sums"])), "block int, sums binary")
    out = np.zeros(factor.shape)
    for r in salted.groupBy("block").applyInArrow(add, "block int, sums binary").collect():
        own = np.frombuffer(r["sums"], dtype="<f8").reshape(-1, factor.shape[1])
        out[r["block"] : r["block"] + len(own)] = own
    return out


def latent_basis(rows: DataFrame, t: np.ndarray, n: np.ndarray, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular vectors of the corpus passages and of the queries (``n`` terms each, ``t``), by two products."""
    def product(factor):
        own = np.zeros(factor.shape)
        _summed(t, n, factor * idf[:, None], idf, own)
        return _products(rows, factor, idf) + own * idf[:, None]

    width = min(rank + EXTRA, len(idf))
    sketch = np.random.Generator(np.random.PCG64(11)).standard_normal((len(idf), width))
    basis, _ = np.linalg.qr(product(sketch))
    values, vectors = np.linalg.eigh(basis.T @ product(basis))
    return (basis @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)


@dataclass
class Queries:
    """Query passages of a block of items, found by their rare words."""

    part: np.ndarray
    least: np.ndarray
    vectors: np.ndarray
    heads: np.ndarray
    of_term: np.ndarray

    def candidates(self, terms: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, start, end) of the passages that hold ``HITS`` rare words of a query; they start at blocks of ``STRIDE`` words."""
        n = np.diff(first)
        blocks = -(-n // STRIDE)
        gap = WIDTH // STRIDE
        base = np.cumsum(blocks + gap) - blocks - gap
        owner = np.repeat(np.arange(len(n)), n)
        at = np.flatnonzero(terms >= 0)
        at = at[self.heads[terms[at] + 1] > self.heads[terms[at]]]
        block = base[owner[at]] + (at - first[:-1][owner[at]]) // STRIDE
        size = len(self.heads) - 1
        seen, _ = distinct(block * size + terms[at])
        block, term = seen // size, seen % size
        many = self.heads[term + 1] - self.heads[term]
        place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.heads[term], many)
        span = int(base[-1] + blocks[-1] + gap) if len(n) else 1
        keys, hits = distinct(self.of_term[place].astype(np.int64) * span + np.repeat(block, many))
        whole = hits.copy()
        # keys are in order and differ, so of the next ones only as many can be this near
        for ahead in range(1, gap):
            near = keys[ahead:] - keys[:-ahead] < gap
            whole[: len(near)][near] += hits[ahead:][near]
        keep = np.flatnonzero(whole >= HITS)
        query, block = keys[keep] // span, keys[keep] % span
        text = np.searchsorted(base, block, side="right") - 1
        start = first[:-1][text] + (block - base[text]) * STRIDE
        return query, start, np.minimum(start + WIDTH, first[1:][text])

    def cosines(self, terms: np.ndarray, query: np.ndarray, start: np.ndarray, end: np.ndarray, space: np.ndarray) -> np.ndarray:
        """Cosine of each query and passage in the latent space; a passage is placed there once for all its queries."""
        close = np.zeros(len(query))
        order = np.argsort(start, kind="stable")
        for at in range(0, len(order), 20_000):
            rows = order[at : at + 20_000]
            fresh = np.diff(start[rows], prepend=-1) > 0
            placed = _latent(terms, start[rows[fresh]], end[rows[fresh]], space)
            close[rows] = np.einsum("ij,ij->i", placed[np.cumsum(fresh) - 1], self.vectors[query[rows]])
        return close


def _parts(items: list[tuple[int, str]]) -> tuple[list[tuple[int, np.ndarray]], list[tuple[int, np.ndarray]], list[tuple[int, np.ndarray]]]:
    """(item, words) of the parts to be judged, of the runs that leak as they stand, and of the items too short for either."""
    parts, runs, short = [], [], []
    words, first = word_hashes(pa.array([t for _, t in items], pa.large_string()))
    for i, (item, _) in enumerate(items):
        own = words[first[i] : first[i + 1]]
        if 0 < len(own) < LEAST_WORDS:
            short.append((item, own))
        elif len(own):
            _, start, end = passages(np.array([0, len(own)]), PART, PART // 2)
            parts += [(item, own[max(0, e - PART) : e]) for _, e in zip(start, end)]
            runs += [(item, own[k : k + RUN]) for k in range(len(own) - RUN + 1)]
    return parts, runs, short


@dataclass
class Sequences:
    """Word sequences of one length, found by their hash and then compared."""

    width: int
    hashes: np.ndarray
    items: list[int]
    words: np.ndarray

    def found(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, first word) of each occurrence."""
        own = window_hashes(words, self.width)
        near = np.flatnonzero(self._bits()[(own >> np.uint64(46)).astype(np.int64)])
        low, high = np.searchsorted(self.hashes, own[near], side="left"), np.searchsorted(self.hashes, own[near], side="right")
        near, low, high = near[high > low], low[high > low], high[high > low]
        text = np.searchsorted(first, near, side="right") - 1
        inside = near + self.width <= first[text + 1]
        if self.width < ALONE:
            inside &= first[text + 1] - first[text] == self.width
        out = []
        for d, at, a, b in zip(text[inside].tolist(), near[inside].tolist(), low[inside].tolist(), high[inside].tolist()):
            out += [(d, self.items[k], at) for k in range(a, b) if (self.words[k] == words[at : at + self.width]).all()]
        return out

    def _bits(self) -> np.ndarray:
        if not hasattr(self, "bits"):
            self.bits = np.zeros(1 << 18, dtype=bool)
            self.bits[(self.hashes >> np.uint64(46)).astype(np.int64)] = True
        return self.bits


def _sequences(given: list[tuple[int, np.ndarray]]) -> list[Sequences]:
    out = []
    for width in sorted({len(w) for _, w in given}):
        own = [(i, w) for i, w in given if len(w) == width]
        hashes = np.array([window_hashes(w, width)[0] for _, w in own])
        order = np.argsort(hashes, kind="stable")
        out.append(Sequences(width, hashes[order], [own[k][0] for k in order], np.array([own[k][1] for k in order])))
    return out


def _queries(parts: list[tuple[int, np.ndarray]], vocabulary: Vocabulary, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of all parts, part, start and end of each query passage, and its rarest terms as pairs of term and query)."""
    line = vocabulary.terms(np.concatenate([w for _, w in parts]))
    borders = np.concatenate([[0], np.cumsum([len(w) for _, w in parts])])
    part, start, end = passages(borders, WIDTH, ITEM_STRIDE)
    rare = []
    for q, (s, e) in enumerate(zip(start, end)):
        own = np.unique(line[s:e])
        rarest = own[np.lexsort((own, counted[own]))][: len(own) - int(np.ceil(FOUND * len(own))) + HITS]
        rare.append(np.stack([rarest, np.full(len(rarest), q)], axis=1))
    return line, part, start, end, np.concatenate(rare)


def regions(text: np.ndarray, part: np.ndarray, start: np.ndarray, end: np.ndarray, cosine: np.ndarray):
    """(text, part, first start, last end, best cosine): passages of one text and part that begin within ``WIDTH`` words of the first are judged as one."""
    order = np.lexsort((start, part, text))
    out: list[list] = []
    for d, p, s, e, c in zip(*(x[order].tolist() for x in (text, part, start, end, cosine))):
        if out and out[-1][0] == d and out[-1][1] == p and s - out[-1][2] <= WIDTH:
            out[-1][3], out[-1][4] = max(out[-1][3], e), max(out[-1][4], c)
        else:
            out.append([d, p, s, e, c])
    return out


def _block(docs: DataFrame, items: list[tuple[int, str]], rank: int) -> DataFrame | None:
    parts, runs, short = _parts(items)
    if not parts and not short:
        return None
    looked_up = _sequences(runs + short)
    context = docs.sparkSession.sparkContext
    known = weighted = queries = None
    if parts:
        vocabulary = Vocabulary(np.unique(np.concatenate([w for _, w in parts])))
        known = vocabulary.hashes
        rows = materialise(_terms(docs, vocabulary), "passages")
        total, counted = _counts(rows, vocabulary)
        idf = np.log((total + 1.0) / (counted + 1.0)) + 0.1
        line, part, start, end, rare = _queries(parts, vocabulary, counted)
        basis = latent_basis(rows, np.concatenate([line[s:e] for s, e in zip(start, end)]), end - start, idf, rank)
        weighted = (basis * idf[:, None]).astype(np.float32)
        order = np.argsort(rare[:, 0], kind="stable")
        heads = np.searchsorted(rare[order, 0], np.arange(len(idf) + 1))
        # a paraphrase of few words fills little of a passage
        least = COSINE * np.sqrt(np.minimum(end - start, WIDTH) / WIDTH)
        queries = Queries(part, least, _latent(line, start, end, weighted), heads, rare[order, 1].astype(np.int32))
    shared = context.broadcast((known, weighted, queries, parts, looked_up))

    def run(batches):
        hashes, space, wanted, own_parts, own_sequences = shared.value
        held = Vocabulary(hashes) if hashes is not None else None
        for batch in batches:
            for piece in pieces(batch, "text"):
                words, first = word_hashes(piece.column("text"))
                ids = piece.column("doc_id").to_pylist()
                best: dict[tuple[int, int], tuple] = {}
                for sequences in own_sequences:
                    for d, item, at in sequences.found(words, first):
                        best.setdefault((d, item), (1.0, sequences.width, sequences.width, 1.0, 1.0, at - int(first[d])))
                if held is not None:
                    terms = held.terms(words)
                    query, start, end = wanted.candidates(terms, first)
                    close = wanted.cosines(terms, query, start, end, space)
                    keep = np.flatnonzero(close >= wanted.least[query])
                    text = np.searchsorted(first, start[keep], side="right") - 1
                    for d, q, s, e, cosine in regions(text, wanted.part[query[keep]], start[keep], end[keep], close[keep]):
                        item, part = own_parts[q]
                        # a part that meets a passage lies within its own length around it
                        margin = len(part) + len(part) // 4
                        region = words[max(int(first[d]), s - margin) : min(int(first[d + 1]), e + margin)]
                        if not within_reach(part, region):
                            continue
                        found, answered, leaked = judge(part, region)
                        value = (found / len(part), found, len(part), answered, cosine, s - int(first[d]))
                        if leaked and value > best.get((d, item), (-1.0,)):
                            best[d, item] = value
                found = [(ids[d], item, *v) for (d, item), v in sorted(best.items(), key=lambda x: (x[0][0], x[0][1] is not None, x[0][1] or 0))]
                cols = list(zip(*found)) if found else [[]] * 8
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "lcs_ratio", "lcs_words", "part_words", "answer_ratio", "cosine", "word_start"])

    return docs.select("doc_id", "text").mapInArrow(run, COLUMNS)


COLUMNS = "doc_id long, item_id long, lcs_ratio double, lcs_words long, part_words long, answer_ratio double, cosine double, word_start long"


def leaked(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, lcs_ratio, lcs_words, part_words, answer_ratio, cosine, word_start) for each leak.

    One row for each document and benchmark item found in it, with its best passage. Items longer
    than 64 words are looked for in parts of 64 that overlap by half, and any 24 consecutive words
    of an item are a leak. Items of five to seven words leak where they stand word by word, shorter
    ones where they are all the words of a text. Null and empty texts hold no
    passages, a null item text is no query, null ids are carried as they are. Repeated rows
    are judged alike and reported once for each id. With no documents or no items the result
    is empty. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    wanted = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where(F.col("text").isNotNull())
    blocks = -(-wanted.count() // block_items)
    out = spark.createDataFrame([], COLUMNS)
    for b in range(blocks):
        items = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        found = _block(rows, [(r["item_id"], r["text"]) for r in items], rank)
        out = out.unionByName(found) if found is not None else out
    best = F.max(F.struct("lcs_ratio", "lcs_words", "part_words", "answer_ratio", "cosine", "word_start")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns, whatever their names.

    All rows with a doc_id that leaks go. Null and empty texts hold nothing and stay, as do all
    rows if there are no items; rows with a null doc_id go if any of them leaks.
    """
    found = materialise(leaked(docs, benchmark).select(F.col("doc_id").alias("_leaked")).distinct(), "leaked")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_leaked"]), "left_anti")
