"""Near duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its five-word shingles (lower case, white space cut), each
labelled with how often it occurred before, so that labels are unique within a text. Each
of ``slots`` sketches draws the ``picks`` smallest labelled shingles under its own order and
keeps them in *text order* as one key: texts that agree in content but not in order get
other keys. Texts that share a key are candidates.

The similarity of two texts is that of their best in-order alignment: with ``m`` aligned
shingles, ``m / (a + b - m)``. It never exceeds the Jaccard similarity of the shingles.
An alignment that reaches the threshold leaves few shingles unmatched, so it lies in a band
of known width around the diagonal; nothing outside the band is looked at.

Candidates are never expanded into pairs within a bucket: every member is compared with the
bucket's leader, the text that shares most keys with others; groups found so far are
contracted, and buckets that still hold several groups go on with another leader while
that links many. What is then left in one bucket without having met is joined exactly: two
texts reach the threshold only if they share one of their rarest shingles (prefix filter),
and shingles that only one group holds are not exchanged at all.
"""

from __future__ import annotations

from bisect import bisect_left
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseweave.llm.common import SPACES, flat, free_name, hash_spans, mix, occurrence, pieces, spans, window_hashes
from caseweave.operators.components import connected_components
from caseweave.session import materialise

SHINGLE, THRESHOLD = 5, 0.8
#: With three picks a pair at the threshold shares a key with chance 0.51; the chance that fewer
#: than two of 24 sketches agree is below one in a million.
SLOTS, PICKS, AGREE = 24, 3, 2
#: Leaders go on while at least one of so many comparisons adds a link.
YIELD = 8
#: Steps of length in the ratio of the threshold, by which texts with a common shingle meet.
STEPS = 4


def shingles(column, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(labelled shingle hashes, offsets per text); a text of fewer words is one shingle."""
    data, offsets = flat(pc.utf8_lower(column.cast(pa.large_string())))
    starts, ends, first = spans(data, offsets, SPACES)
    words = hash_spans(data, starts, ends)
    n = np.diff(first)
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    values = np.zeros(out[-1], dtype=np.uint64)
    whole = window_hashes(words, width)
    owner = np.repeat(np.arange(len(n)), n)[: len(whole)]
    place = np.arange(len(whole))
    valid = place + width <= first[1:][owner]
    values[(out[:-1][owner] + place - first[:-1][owner])[valid]] = whole[valid]
    for d in np.flatnonzero((n > 0) & (n < width)):
        values[out[d]] = window_hashes(words[first[d] : first[d + 1]], int(n[d]))[0] + np.uint64(int(n[d]))
    groups = np.repeat(np.arange(len(counts)), counts)
    return mix(values + occurrence(values, groups).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), out


def sketches(values: np.ndarray, offsets: np.ndarray, slots: int = SLOTS, picks: int = PICKS) -> np.ndarray:
    """One key per text and slot: its ``picks`` smallest shingles, read in text order."""
    n = np.diff(offsets)
    full = np.flatnonzero(n > 0)
    keys = np.zeros((len(n), slots), dtype=np.uint64)
    if not len(full):
        return keys
    groups = np.repeat(np.arange(len(n)), n)
    # few values of a text lie below this line; texts with too few of them are looked at whole
    line = np.full(len(n), 2**64 - 1, dtype=np.uint64)
    long = n > 4 * picks
    line[long] = (2.0**64 * 4 * picks / n[long]).astype(np.uint64)
    limit = np.repeat(line, n)
    draws = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, (slots, 2), dtype=np.uint64)
    for slot in range(slots):
        order = (values ^ draws[slot, 0]) * (draws[slot, 1] * np.uint64(2) + np.uint64(1))
        low = np.flatnonzero(order <= limit)
        short = np.flatnonzero(np.bincount(groups[low], minlength=len(n)) < np.minimum(picks, n))
        if len(short):
            low = np.concatenate([low[~np.isin(groups[low], short)], *[np.arange(offsets[d], offsets[d + 1]) for d in short]])
        low = low[np.lexsort((order[low], groups[low]))]
        g = groups[low]
        head = np.searchsorted(g, g, side="left")
        low = np.sort(low[np.arange(len(g)) - head < picks])
        g = groups[low]
        rank = np.arange(len(g)) - np.searchsorted(g, g, side="left")
        key = np.zeros(len(n), dtype=np.uint64)
        for r in range(picks):
            at = low[rank == r]
            key[groups[at]] = mix(key[groups[at]] + values[at], slot + 1)
        keys[:, slot] = key
    return keys


def alignment(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """In-order similarity of two shingle sequences, or 0.0 where it is below the threshold."""
    total = len(a) + len(b)
    if not len(a) or not len(b):
        return 0.0
    need = ceil(threshold * total / (1 + threshold) - 1e-9)
    if min(len(a), len(b)) < need:
        return 0.0
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = total - 2 * need
    near = np.abs(ia - ib) <= band
    if near.sum() < need:
        return 0.0
    ia, ib = ia[near], ib[near]
    path = ib[np.argsort(ia)]
    if (np.diff(path) > 0).all():
        m = len(path)
    else:
        tails: list[int] = []
        for x in path.tolist():
            at = bisect_left(tails, x)
            tails[at : at + 1] = [x]
        m = len(tails)
    return m / (total - m) if m >= need else 0.0


def _sketched(docs: DataFrame, slots: int, picks: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                values, offsets = shingles(part.column("text"))
                keys = sketches(values, offsets, slots, picks).view(np.int64)
                held = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, slots, dtype=np.int32)), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array(np.diff(offsets)), held], ["doc_id", "digest", "n", "keys"])

    return docs.mapInArrow(run, "doc_id long, digest string, n long, keys array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                rows = batch.slice(start, 200)
                (va, oa), (vb, ob) = shingles(rows.column("ta")), shingles(rows.column("tb"))
                score = [alignment(va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]], threshold) for i in range(rows.num_rows)]
                yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b"), pa.array(score, pa.float64())], ["a", "b", "similarity"])

    return pairs.select("a", "b").hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, similarity double")


def _labels(held: DataFrame) -> DataFrame:
    """(id, component, own, n, token): every labelled shingle of the texts; ``own`` tells the texts of an id apart."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 500_000):
                values, offsets = shingles(part.column("text"))
                n = np.diff(offsets)
                row = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(row) for c in ("id", "component", "own")), pa.array(np.repeat(n, n)), pa.array(values.view(np.int64))], ["id", "component", "own", "n", "token"])

    return held.withColumn("own", F.xxhash64("text")).select("id", "component", "own", "text").mapInArrow(run, "id long, component long, own long, n long, token long")


def _crossing(held: DataFrame, threshold: float) -> DataFrame:
    """(a, b) with a < b: all pairs of texts of different components that can reach the threshold.

    ``held`` is (id, component, text). With the shingles of each text in one global order, the
    first common one of a pair with Jaccard similarity t lies among the first n - t n + 1 of the
    longer text and the first n - 2 t n / (1 + t) + 1 of the shorter one, and leaves both texts
    enough shingles behind it. Shingles of one component only come first in that order and
    meet nobody; then the rare ones. Members of one component are never paired.
    """
    labels = _labels(held)
    spread = labels.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("held")).where("least < most").select("token", "held")
    text = Window.partitionBy("id", "own")
    place = F.col("n") - F.count("*").over(text) + F.row_number().over(text.orderBy("held", "token")) - 1
    placed = labels.hint("merge").join(spread.hint("merge"), "token").withColumn("place", place)
    long = materialise(placed.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9)).drop("held"), "prefixes")
    short = long.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * (2 * threshold / (1 + threshold)) - 1e-9))
    # the longer text's length lies between the shorter one's and what its place allows; texts meet by steps of length
    step = lambda n: F.floor(F.log(n) * F.lit(STEPS / -log(threshold)) + 1e-9)
    behind = F.col("n") - F.col("place")
    most = F.greatest(F.col("n"), F.least(F.col("n") / threshold, behind * ((1 + threshold) / threshold) - F.col("n")))
    one = short.select("token", F.explode(F.sequence(step(F.col("n")), step(most + 1e-6))).alias("step"), F.col("component").alias("x"), F.col("id").alias("i"), F.col("n").alias("ni"), behind.alias("ri"))
    two = long.select("token", step(F.col("n")).alias("step"), F.col("component").alias("y"), F.col("id").alias("j"), F.col("n").alias("nj"), behind.alias("rj"))
    key = ["token", "step"]
    many = two.groupBy(*key, "y").agg(F.min("nj").alias("low"), F.max("nj").alias("high"), F.max("rj").alias("left"))
    share = threshold / (1 + threshold)
    fits = (F.col("x") != F.col("y")) & (F.col("ni") <= F.col("high")) & (F.col("ni") >= F.col("low") * threshold - 1e-9)
    fits &= F.least("ri", "left") >= (F.col("ni") + F.greatest("ni", "low")) * share - 1e-9
    few = one.groupBy(*key, "x").agg(F.min("ni").alias("ni"), F.max("ni").alias("nm"), F.max("ri").alias("ri"))
    meet = few.hint("merge").join(many.hint("merge"), key).where((F.col("x") != F.col("y")) & (F.col("ni") <= F.col("high")) & (F.col("nm") >= F.col("low") * threshold - 1e-9) & (F.least("ri", "left") >= (F.col("ni") + F.greatest("ni", "low")) * share - 1e-9))
    enough = F.least("ri", "rj") >= (F.col("ni") + F.col("nj")) * share - 1e-9
    met = one.hint("merge").join(meet.select(*key, "x", "y", "low", "high", "left"), [*key, "x"]).where(fits).drop("low", "high", "left")
    pairs = met.hint("merge").join(two, [*key, "y"]).where((F.col("ni") <= F.col("nj")) & (F.col("ni") >= F.col("nj") * threshold - 1e-9) & enough)
    return pairs.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).where("a < b").distinct()


def _linked(classes: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
    """The pairs of components (a, b) that scored pairs link."""
    own_a = classes.select(F.col("id").alias("a"), F.col("component").alias("x"))
    own_b = classes.select(F.col("id").alias("b"), F.col("component").alias("y"))
    found = scored.where(F.col("similarity") >= threshold).select("a", "b")
    return materialise(found.join(own_a, "a").join(own_b, "b").where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "bridges")


def _contracted(classes: DataFrame, bridges: DataFrame) -> DataFrame:
    merged = connected_components(bridges.select(F.col("a").alias("id")).unionByName(bridges.select(F.col("b").alias("id"))).distinct(), bridges)
    moved = merged.select(F.col("id").alias("component"), F.col("component").alias("to"))
    return materialise(classes.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "classes")


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, slots: int = SLOTS, picks: int = PICKS) -> DataFrame:
    """(doc_id, class_id, class_size, kept), one row per input row.

    A class is a connected set of documents linked by similarity >= ``threshold``; its id is
    its smallest doc_id, which is the one kept. Equal texts are one node (nulls and empty
    texts are equal), a text without words links to no other text. Rows with the same doc_id
    are one document, linked by any of its texts; of rows with the same doc_id and text one is
    kept. A row with a null doc_id stays alone: class_id is null and it is kept. An empty
    table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = rows.where(F.col("doc_id").isNotNull()).withColumn("digest", F.sha2("text", 256))
    sketched = materialise(_sketched(named, slots, picks), "sketches")
    nodes = materialise(sketched.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys")).drop("digest").where("n > 0"), "nodes")
    copies = sketched.groupBy("digest", "doc_id").agg(F.count("*").alias("copies"))
    twins = copies.join(sketched.groupBy("digest").agg(F.min("doc_id").alias("id")), "digest").select("doc_id", "id", "copies")
    twins = materialise(twins, "twins")

    slotted = nodes.select("id", F.posexplode("keys").alias("slot", "key"))
    shared = slotted.groupBy("slot", "key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = materialise(slotted.join(shared, ["slot", "key"]), "buckets")
    weight = buckets.groupBy("id").agg(F.sum("size").alias("shared"))
    buckets = materialise(buckets.drop("size").join(weight, "id"), "buckets")
    wanted = buckets.select(F.col("id").alias("doc_id")).distinct()
    # merge joins at every size: the plan, and what it moves, grow with the data alone
    texts = materialise(named.join(wanted.hint("merge"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text").distinct(), "texts")

    classes = materialise(wanted.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("component")), "classes")
    tried, turn = None, 0
    while True:
        if turn == 0:
            # the text that shares most keys leads: of an original and its copies, the original
            member = buckets.select("slot", "key", "id", F.struct(F.col("shared").alias("rank"), (-F.col("id")).alias("tie"), F.col("id").alias("id")).alias("one"))
        else:
            rank = F.struct(F.xxhash64("id", F.lit(turn)).alias("rank"), F.lit(0).cast("bigint").alias("tie"), F.col("id").alias("id"))
            member = buckets.join(classes, "id").groupBy("slot", "key", "component").agg(F.max(rank).alias("one")).select("slot", "key", F.col("one.id").alias("id"), "one")
        leader = member.groupBy("slot", "key").agg(F.max("one").alias("first"), F.count("*").alias("size")).where("size > 1")
        pairs = member.join(leader, ["slot", "key"]).select(F.least("id", "first.id").alias("a"), F.greatest("id", "first.id").alias("b")).where("a < b").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        one = nodes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("keys").alias("ka"))
        two = nodes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("keys").alias("kb"))
        agree = F.aggregate(F.zip_with("ka", "kb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        likely = pairs.hint("merge").join(one, "a").hint("merge").join(two, "b").where((F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9) & (agree >= min(AGREE, slots))).select("a", "b").distinct()
        scored = materialise(_verified(likely, texts, threshold), "scored")
        tried = scored.select("a", "b") if tried is None else tried.unionByName(scored.select("a", "b"))
        bridges = _linked(classes, scored, threshold)
        links = bridges.count()
        if links:
            classes = _contracted(classes, bridges)
        if links * YIELD <= scored.count():
            break
        turn += 1

    # a bucket of two is done, a bucket of one group too; the texts of all others are joined exactly
    several = buckets.join(classes, "id").groupBy("slot", "key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("size")).where("least < most and size > 2")
    rest = buckets.join(several, ["slot", "key"], "left_semi").select("id").distinct()
    held = materialise(texts.join(rest, "id", "left_semi").join(classes, "id").select("id", "component", "text"), "rest")
    scored = materialise(_verified(_crossing(held, threshold).join(tried, ["a", "b"], "left_anti"), texts, threshold), "scored")
    bridges = _linked(classes, scored, threshold)
    if not bridges.isEmpty():
        classes = _contracted(classes, bridges)

    placed = twins.join(classes, "id", "left").select("doc_id", "copies", F.coalesce("component", "id").alias("component"))
    # a doc_id with several texts ties their classes together
    ties = placed.groupBy("doc_id").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a != b")
    if not ties.isEmpty():
        of = placed.select("doc_id", F.col("component").alias("b")).distinct().join(ties.select("doc_id", "a"), "doc_id").select("a", "b")
        merged = connected_components(of.select(F.col("a").alias("id")).unionByName(of.select(F.col("b").alias("id"))).distinct(), of)
        moved = merged.select(F.col("id").alias("component"), F.col("component").alias("to"))
        placed = placed.join(moved, "component", "left").select("doc_id", "copies", F.coalesce("to", "component").alias("component"))
    sizes = placed.groupBy("component").agg(F.sum("copies").alias("class_size"))
    whole = placed.join(sizes, "component")
    out = whole.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(
        "doc_id", F.col("component").alias("class_id"), F.col("class_size").cast("bigint").alias("class_size"), ((F.col("copy") == 1) & (F.col("doc_id") == F.col("component"))).alias("kept")
    )
    nameless = rows.where(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast("bigint").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"), F.lit(True).alias("kept"))
    return out.unionByName(nameless)


def drop_near(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each class, with all their columns, whatever their names.

    The document with a class's smallest doc_id stays. A text without words is alike only to an
    equal one (null and empty texts are equal); rows with a null doc_id all stay, of rows with the
    same doc_id and text one stays, and an empty table stays empty.
    """
    gone = near_groups(docs, threshold).where(~F.col("kept") & (F.col("doc_id") != F.col("class_id"))).select(F.col("doc_id").alias("_gone")).distinct()
    mark = free_name(docs, "text_mark")
    stay = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti").withColumn(mark, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    return stay.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", mark]).unionByName(stay.where(F.col("doc_id").isNull())).drop(mark)
