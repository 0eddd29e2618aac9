"""Repeated byte strings by per-shard suffix arrays.

Every window of ``width`` bytes has an anchor, the smallest hash of its short pieces; equal
windows have equal anchors. Consecutive windows under one anchor form a region. Texts are
dealt into shards; shards exchange anchors, then fingerprints of the regions whose anchor
occurs again. A region that occurs twice as a whole is repeated throughout. Of anchors with
different regions, one text of each region goes to the suffix shard of the anchor: there a
suffix array is built by Larsson-Sadakane refinement (groups of equal prefixes are split by
the rank further on, depth doubling, sorted suffixes resting), and common prefixes are carried
from suffix to suffix as Kasai does. Where one anchor's regions are more than a shard holds,
they are spread over several, whose sorted windows are merged by binary search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm import shards as sh
from caseweave.llm.common import MULTIPLIER, flat, mix, powers
from caseweave.session import materialise

WIDTH, PIECE = 200, 128
CHUNK_BYTES, SUFFIX_BYTES = 500_000, 1_000_000
_codes = np.random.Generator(np.random.PCG64(3)).integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _inverse_powers(n: int, multiplier: int = MULTIPLIER) -> np.ndarray:
    steps = np.full(max(n, 1), pow(multiplier, -1, 2**64), dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)[:n]


def _rising(data: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums that hash any stretch of the bytes."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_codes[which][data] * powers(len(data)), out=out[1:])
    return out


def _stretches(sums: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * inverse[start])


def _chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of documents with about ``limit`` bytes."""
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, min(high, len(offsets) - 1)
        low = min(high, len(offsets) - 1)


class Chunk:
    """Anchors of a stretch of documents, and the regions they make."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int, piece: int):
        self.width, self.piece, self.data = width, piece, data
        n = len(data)
        self.least, self.places, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if n < width:
            return
        self.sums, self.inverse = _rising(data, 0), _inverse_powers(n + 1)
        self.values = mix((self.sums[piece:] - self.sums[:-piece]) * self.inverse[: n - piece + 1], 5)
        valid = np.zeros(n, dtype=bool)
        change = np.zeros(n + 1, dtype=np.int32)
        long = np.diff(offsets) >= width
        change[offsets[:-1][long]] += 1
        np.add.at(change, offsets[1:][long] - width + 1, -1)
        valid = np.cumsum(change[:-1]) > 0
        self.least, self.places = sh.minima(self.values, valid, width - piece + 1)

    def regions(self, chosen) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, windows, anchor, fingerprint, second fingerprint, anchor occurs twice inside) of the regions ``chosen`` picks."""
        empty = np.zeros(0, np.int64)
        if not len(self.least):
            return empty, empty, empty.view(np.uint64), empty.view(np.uint64), empty.view(np.uint64), empty.astype(bool)
        heads = np.flatnonzero(np.diff(self.least, prepend=np.uint64(0)))
        heads = heads[self.least[heads] > 0] if len(heads) else heads
        following = np.flatnonzero(np.diff(np.append(self.least, np.uint64(0)))) + 1
        ends = following[np.searchsorted(following, heads, side="right")] if len(heads) else heads
        keep = chosen(self.least[heads])
        start, count = heads[keep], (ends - heads)[keep]
        anchor = self.least[start]
        # how often the anchor stands inside its own region
        names, rank = np.unique(self.values[self.places], return_inverse=True)
        placed = np.sort(rank.astype(np.int64) << 32 | self.places)
        own = np.searchsorted(names, anchor).astype(np.int64) << 32
        inside = np.searchsorted(placed, own | (start + count + self.width - self.piece)) - np.searchsorted(placed, own | start)
        end = start + count + self.width - 1
        second = _rising(self.data, 1)
        return start, count, anchor, _stretches(self.sums, start, end, self.inverse), _stretches(second, start, end, self.inverse), inside > 1


class Text:
    """The bytes of a shard."""

    def __init__(self, table: pa.Table):
        self.data, self.offsets = flat(table.column("text"))

    def chunks(self, width: int, piece: int):
        for low, high in _chunks(self.offsets):
            base = int(self.offsets[low])
            yield base, Chunk(self.data[base : self.offsets[high]], self.offsets[low : high + 1] - base, width, piece)

    def anchors(self, width: int, piece: int, slice_bits: int) -> tuple[np.ndarray, np.ndarray]:
        found = [c.values[c.places] for _, c in self.chunks(width, piece)]
        return sh.anchor_keys(np.concatenate(found) if found else np.zeros(0, np.uint64), slice_bits)


# Suffix arrays of one shard

def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number (zeros beyond the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), dtype=np.uint64)
    for j in range(8):
        out = out << np.uint64(8) | padded[j : j + len(data)]
    return out


def suffix_order(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions by their first ``depth`` bytes, rank of each position); equal prefixes share a rank."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    slots = np.arange(n)

    def heads(changed: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at[np.maximum.accumulate(np.where(changed, np.arange(len(at)), 0))]

    rank = np.full(n + 1, -1, dtype=np.int64)
    ordered = words[order]
    rank[order] = heads(np.append(True, ordered[1:] != ordered[:-1])[:n], slots) if n else slots
    done = 8
    while done < depth and n:
        step = min(done, depth - done)
        at_slot = rank[order]
        alone = np.bincount(at_slot, minlength=n)[at_slot] == 1
        open_slots = slots[~alone]
        if not len(open_slots):
            break
        open_at = order[open_slots]
        own, further = rank[open_at], rank[np.minimum(open_at + step, n)]
        turn = np.lexsort((further, own))
        own, further, open_at = own[turn], further[turn], open_at[turn]
        changed = np.ones(len(turn), dtype=bool)
        changed[1:] = (own[1:] != own[:-1]) | (further[1:] != further[:-1])
        order[open_slots] = open_at
        rank[open_at] = heads(changed, open_slots)
        done += step
    return order, rank[:n]


def common_prefixes(words: np.ndarray, room: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Length of the prefix that each entry of ``order`` shares with the one before, up to ``limit``.

    Where a suffix and its neighbour are both one further than at the position before, and
    shared a letter there, the prefix is one shorter (Kasai); only the first of such a chain
    is compared.
    """
    out = np.zeros(len(order), dtype=np.int64)
    if len(order) < 2:
        return out
    before = np.full(len(words) + 1, -2, dtype=np.int64)
    before[order[1:]] = order[:-1]
    own = np.sort(order[1:])
    chained = np.zeros(len(own), dtype=bool)
    letter = words >> np.uint64(56)
    last = own[:-1]
    chained[1:] = (own[1:] == last + 1) & (before[own[1:]] == before[last] + 1) & (letter[last] == letter[before[last]])
    heads = np.flatnonzero(~chained)
    chain = np.diff(np.append(heads, len(own)))
    a, b = own[heads], before[own[heads]]
    most = np.minimum(np.minimum(room[a], room[b]), limit + chain)
    length = np.zeros(len(heads), dtype=np.int64)
    live = np.arange(len(heads))
    while len(live):
        x, y = words[a[live] + length[live]], words[b[live] + length[live]]
        differ = x ^ y
        same = np.full(len(live), 8, dtype=np.int64)
        for j in range(7, -1, -1):
            same[(differ >> np.uint64(8 * (7 - j))) & np.uint64(255) > 0] = j
        length[live] = np.minimum(length[live] + same, most[live])
        live = live[(same == 8) & (length[live] < most[live])]
    whole = np.repeat(length, chain) - (np.arange(len(own)) - np.repeat(heads, chain))
    shared = np.zeros(len(words), dtype=np.int64)
    shared[own] = np.clip(whole, 0, limit)
    out[1:] = shared[order[1:]]
    return out


def repeated_windows(texts: list[bytes], whole: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, start of each region, sorted window starts, groups) of the windows of some regions.

    Windows of one group are equal; groups number the sorted windows.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    room = np.repeat(begin + sizes, sizes) - np.arange(len(data))
    words = words_at(data)
    order, _ = suffix_order(words, width)
    order = order[room[order] >= width]
    prefix = common_prefixes(words, room, order, width)
    return data, begin, order, np.cumsum(prefix < width) - 1 if len(order) else order


def _empty(schema: pa.Schema) -> pa.Table:
    return schema.empty_table()


REGION = pa.schema([("shard", pa.int32()), ("slice", pa.int32()), ("keys", pa.binary()), ("prints", pa.binary()), ("marks", pa.binary())])
SENT = pa.schema([("anchor", pa.int64()), ("shard", pa.int32()), ("region", pa.int64()), ("whole", pa.bool_()), ("text", pa.binary())])
ANSWER = pa.schema([("shard", pa.int32()), ("kind", pa.string()), ("slice", pa.int32()), ("bits", pa.binary()), ("places", pa.binary())])
FOUND = pa.schema([
    ("shard", pa.int32()), ("kind", pa.string()), ("slice", pa.int32()), ("bits", pa.binary()), ("places", pa.binary()), ("part", pa.int32()), ("range", pa.int32()),
    ("prints", pa.binary()), ("owners", pa.binary()),
])
_SQL = {pa.int32(): "int", pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary", pa.string(): "string"}


def _sql(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {_SQL[f.type]}" for f in schema)


def _regions(table: pa.Table, own: pa.Table, width: int, piece: int, bits: int) -> pa.Table:
    """Messages of a shard's distinct regions, and (slice -1) where all its regions lie."""
    number = table.column("shard")[0].as_py()
    text = Text(table)
    keys, counts = text.anchors(width, piece, bits)
    again = (counts > 1) | sh.answered(own, "anchor", sh.slice_borders(keys, bits), len(keys))
    drop = np.uint64(32 - bits)

    def chosen(anchors: np.ndarray) -> np.ndarray:
        return again[np.searchsorted(keys, (anchors >> drop) << drop)] if len(keys) else np.zeros(len(anchors), bool)

    columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
    for base, chunk in text.chunks(width, piece):
        start, *rest = chunk.regions(chosen)
        for column, values in zip(columns, (start + base, *rest)):
            column.append(values)
    if not sum(map(len, columns[0])):
        return _empty(REGION)
    start, count, anchor, first, second, twice = (np.concatenate(c) for c in columns)
    order = np.lexsort((second, first, count, anchor))
    a, c, f, s = anchor[order], count[order], first[order], second[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (f[1:] != f[:-1]) | (s[1:] != s[:-1])
    region = np.empty(len(order), dtype=np.int64)
    region[order] = np.cumsum(new) - 1
    one = order[new]
    often = np.bincount(region)
    marks = (often > 1).astype(np.uint8) | twice[one].astype(np.uint8) << 1
    heads = anchor[one]
    numbers, borders = sh.sliced(heads, bits)
    prints = np.stack([first[one], second[one] ^ count[one].astype(np.uint64)], axis=1).astype("<u8")
    pairs = list(zip(borders[:-1], borders[1:]))
    lying = np.stack([start, count, region], axis=1).astype("<u4").tobytes()
    return pa.table({
        "shard": pa.array([number] * (len(pairs) + 1), pa.int32()), "slice": pa.array([*numbers, -1], pa.int32()),
        "keys": pa.array([*(heads[i:j].astype("<u8").tobytes() for i, j in pairs), lying], pa.binary()),
        "prints": pa.array([*(prints[i:j].tobytes() for i, j in pairs), b""], pa.binary()),
        "marks": pa.array([*(marks[i:j].tobytes() for i, j in pairs), len(one).to_bytes(8, "little")], pa.binary()),
    }, schema=REGION)


def _judge_regions(table: pa.Table) -> pa.Table:
    """Answers kind ``region``: which regions occur twice as a whole, and (places) whose text is needed."""
    number = table.column("slice")[0].as_py()
    shards, owner, keys = sh.gathered(table, "keys", "<u8")
    _, _, prints = sh.gathered(table, "prints", "<u8")
    _, _, marks = sh.gathered(table, "marks", "u1")
    one, two = prints[::2], prints[1::2]
    order = np.lexsort((owner, two, one, keys))
    k, a, b = keys[order], one[order], two[order]
    new_key = np.ones(len(order), dtype=bool)
    new_key[1:] = k[1:] != k[:-1]
    new = new_key.copy()
    new[1:] |= (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    region = np.cumsum(new) - 1
    whole = (np.bincount(region) > 1)[region] | (marks[order] & 1 > 0)
    anchor = np.cumsum(new_key) - 1
    several = (np.bincount(anchor, new) > 1)[anchor]
    needed = new & (several | ((marks[order] & 2 > 0) & ~whole))
    back_whole, back_needed = np.zeros(len(order), bool), np.zeros(len(order), bool)
    back_whole[order], back_needed[order] = whole, needed
    sizes = np.bincount(owner, minlength=len(shards))
    pairs = [(end - n, end) for end, n in zip(np.cumsum(sizes), sizes)]
    return sh.answer_table(shards, "region", number, [sh.packed(back_whole[i:j]) for i, j in pairs], [sh.packed(back_needed[i:j]) for i, j in pairs])


class Answered:
    """A shard's regions with what is known of them."""

    def __init__(self, own: pa.Table):
        self.start = self.count = self.region = np.zeros(0, np.int64)
        rows = list(zip(*(own.column(c).to_pylist() for c in ("kind", "slice", "bits", "places"))))
        keys: dict[int, np.ndarray] = {}
        size = 0
        for kind, number, bits, places in rows:
            if kind == "lying":
                self.start, self.count, self.region = np.frombuffer(places, "<u4").reshape(-1, 3).T.astype(np.int64)
                size = int.from_bytes(bits, "little")
            elif kind == "keys":
                keys[number] = np.frombuffer(places, "<u8")
        self.whole, self.needed = np.zeros(size, bool), np.zeros(size, bool)
        self.anchors = np.concatenate([keys[s] for s in sorted(keys)]) if keys else np.zeros(0, np.uint64)
        bases = dict(zip(sorted(keys), np.cumsum([0, *(len(keys[s]) for s in sorted(keys))])))
        self.windows: dict[int, list[np.ndarray]] = {}
        for kind, number, bits, places in rows:
            if kind == "region":
                low, n = bases[number], len(keys[number])
                for target, blob in ((self.whole, bits), (self.needed, places)):
                    target[low : low + n] = np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)
            elif kind == "window":
                self.windows.setdefault(number, []).append(np.frombuffer(places, "<u4").astype(np.int64).reshape(-1, 2))


def _lying(regions: DataFrame) -> DataFrame:
    """Where a shard's regions lie, and the anchors of its distinct regions, as answers to itself."""
    where = regions.where("slice = -1").select("shard", F.lit("lying").alias("kind"), "slice", F.col("marks").alias("bits"), F.col("keys").alias("places"))
    keys = regions.where("slice >= 0").select("shard", F.lit("keys").alias("kind"), "slice", F.lit(None).cast("binary").alias("bits"), F.col("keys").alias("places"))
    return where.unionByName(keys)


def _send(table: pa.Table, own: pa.Table, width: int) -> pa.Table:
    known = Answered(own)
    if not len(known.start):
        return _empty(SENT)
    number = table.column("shard")[0].as_py()
    text = Text(table)
    first = np.full(len(known.whole), -1, dtype=np.int64)
    first[known.region[::-1]] = np.arange(len(known.region))[::-1]
    take = np.flatnonzero(known.needed)
    starts, counts = known.start[first[take]], known.count[first[take]]
    return pa.table({
        "anchor": pa.array((known.anchors[take] >> np.uint64(1)).astype(np.int64)), "shard": pa.array([number] * len(take), pa.int32()), "region": pa.array(take, pa.int64()),
        "whole": pa.array(known.whole[take]), "text": pa.array([text.data[a : a + n + width - 1].tobytes() for a, n in zip(starts, counts)], pa.binary()),
    }, schema=SENT)


def _stretched(at: np.ndarray) -> np.ndarray:
    """Sorted places as pairs (first, count) of neighbours."""
    heads = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    return np.stack([at[heads], np.diff(np.append(heads, len(at)))], axis=1)


def _found(rows: list[tuple]) -> pa.Table:
    """Rows of kind ``window``: (shard, region, window starts in the region)."""
    n = len(rows)
    return pa.table({
        "shard": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array(["window"] * n, pa.string()), "slice": pa.array([r[1] for r in rows], pa.int32()),
        "bits": pa.array([b""] * n, pa.binary()), "places": pa.array([_stretched(r[2]).astype("<u4").tobytes() for r in rows], pa.binary()), "part": pa.array([0] * n, pa.int32()),
        "range": pa.array([0] * n, pa.int32()), "prints": pa.array([b""] * n, pa.binary()), "owners": pa.array([b""] * n, pa.binary()),
    }, schema=FOUND)


def _by_region(at: np.ndarray, begin: np.ndarray, shards: np.ndarray, regions: np.ndarray) -> list[tuple]:
    """(shard, region, places in it) of sorted-out places in the joined regions."""
    at = np.sort(at)
    of = np.searchsorted(begin, at, side="right") - 1
    heads = np.flatnonzero(np.diff(of, prepend=-1))
    return [(int(shards[of[i]]), int(regions[of[i]]), at[i:j] - begin[of[i]]) for i, j in zip(heads, np.append(heads[1:], len(at)))]


def _suffixes(table: pa.Table, width: int) -> pa.Table:
    """Repeated windows of one suffix shard; its sorted windows too where the slice has several shards."""
    shards, regions, whole = table.column("shard").to_numpy(), table.column("region").to_numpy(), np.array(table.column("whole").to_pylist(), dtype=bool)
    parts, number, part = table.column("parts")[0].as_py(), table.column("slice")[0].as_py(), table.column("part")[0].as_py()
    data, begin, order, group = repeated_windows(table.column("text").to_pylist(), whole, width)
    if not len(order):
        return _empty(FOUND)
    held = whole[np.searchsorted(begin, order, side="right") - 1]
    size = np.bincount(group)
    again = (size[group] > 1) & ~held
    out = [_found(_by_region(order[again], begin, shards, regions))]
    if parts > 1:
        inverse = _inverse_powers(len(data) + 1)
        heads = np.flatnonzero(np.diff(group, prepend=-1))
        at = order[heads]
        one, two = (_stretches(_rising(data, w), at, at + width, inverse) for w in (0, 1))
        open_ = (size == 1) & ~whole[np.searchsorted(begin, at, side="right") - 1]
        rank = np.lexsort((two >> np.uint64(32), one))
        pick = ((one[rank] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        edges = np.searchsorted(pick, np.arange(parts + 1))
        one, two, owner = one[rank].astype("<u8"), (two[rank] >> np.uint64(32)).astype("<u4"), (at << 1 | open_)[rank].astype("<u4")

        def lying(i: int, j: int) -> bytes:
            """The regions that the open windows of a range lie in."""
            used = np.unique(np.searchsorted(begin, owner[i:j][owner[i:j] & 1 > 0] >> 1, side="right") - 1)
            return np.stack([begin[used], shards[used], regions[used]]).astype("<u4").tobytes()

        rows = [(r, edges[r], edges[r + 1]) for r in range(parts) if edges[r] < edges[r + 1]]
        out.append(pa.table({
            "shard": pa.array([0] * len(rows), pa.int32()), "kind": pa.array(["sorted"] * len(rows), pa.string()), "slice": pa.array([number] * len(rows), pa.int32()),
            "bits": pa.array([two[i:j].tobytes() for _, i, j in rows], pa.binary()), "places": pa.array([lying(i, j) for _, i, j in rows], pa.binary()), "part": pa.array([part] * len(rows), pa.int32()),
            "range": pa.array([r for r, _, _ in rows], pa.int32()), "prints": pa.array([one[i:j].tobytes() for _, i, j in rows], pa.binary()),
            "owners": pa.array([owner[i:j].tobytes() for _, i, j in rows], pa.binary()),
        }, schema=FOUND))
    return pa.concat_tables(out)


def _bound(one: np.ndarray, two: np.ndarray, first: np.ndarray, second: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of (first, second) in a list sorted by (one, two): the place before, or after, its equals."""
    low, high = np.zeros(len(first), dtype=np.int64), np.full(len(first), len(one))
    while (low < high).any():
        middle = np.minimum((low + high) // 2, len(one) - 1)
        level = one[middle] == first
        less = (one[middle] < first) | (level & ((two[middle] <= second) if after else (two[middle] < second)))
        less &= low < high
        low, high = np.where(less, middle + 1, low), np.where(less | (low >= high), high, middle)
    return low


def _merge(table: pa.Table) -> pa.Table:
    """Merges the sorted windows of a slice's shards once and looks each shard's own up in all of them by binary search."""
    one, two, owners = ([np.frombuffer(b, kind) for b in table.column(c).to_pylist()] for c, kind in (("prints", "<u8"), ("bits", "<u4"), ("owners", "<u4")))
    known = [np.frombuffer(b, "<u4").reshape(3, -1).astype(np.int64) for b in table.column("places").to_pylist()]
    first, second = np.concatenate(one), np.concatenate(two)
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    rows: list[tuple] = []
    for i in range(len(one)):
        open_ = owners[i] & 1 > 0
        own = first, second, one[i][open_], two[i][open_]
        # a shard names a window once, so one that stands there twice is in another shard too
        seen = _bound(*own, True) - _bound(*own, False) > 1
        rows += _by_region((owners[i][open_][seen] >> 1).astype(np.int64), *known[i])
    return _found(rows)


def _cut(table: pa.Table, own: pa.Table, width: int) -> pa.Table:
    text, known = Text(table), Answered(own)
    change = np.zeros(len(text.data) + 1, dtype=np.int32)
    whole = known.whole[known.region] if len(known.region) else np.zeros(0, bool)
    np.add.at(change, known.start[whole], 1)
    np.add.at(change, known.start[whole] + known.count[whole] + width - 1, -1)
    for i in np.flatnonzero(~whole):
        for places in known.windows.get(int(known.region[i]), ()):
            np.add.at(change, known.start[i] + places[:, 0], 1)
            np.add.at(change, known.start[i] + places[:, 0] + places[:, 1] + width - 1, -1)
    np.cumsum(change, out=change)
    removed, spans, kept = [], [], []
    for a, b in zip(text.offsets[:-1].tolist(), text.offsets[1:].tolist()):
        gone = change[a:b] > 0
        removed.append(int(gone.sum()))
        spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
        kept.append(text.data[a:b][~gone].tobytes())
    return pa.table({
        "doc_id": table.column("doc_id"), "n_bytes": pa.array(np.diff(text.offsets), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
        "kept_bytes": pa.array(kept, pa.binary()),
    })


def drop_repeats(
    docs: DataFrame, width: int = WIDTH, piece: int = PIECE, shard_bytes: int = sh.SHARD_BYTES, slice_bytes: int = sh.SLICE_BYTES, suffix_bytes: int = SUFFIX_BYTES
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_bytes): without the bytes in strings that start elsewhere too.

    A byte goes if it is covered by ``width`` bytes of its document that also start anywhere
    else, in the same document or another, overlapping or not; strings are judged on the texts
    as given (UTF-8) and never cross documents. Null and empty texts have no bytes; repeated
    rows and rows with one doc_id are documents of their own, so their strings repeat. An empty
    table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    held = sh.shard(rows, shard_bytes, slice_bytes)
    bits = held.slice_bits

    def send_anchors(table: pa.Table) -> pa.Table:
        return sh.anchor_messages(table.column("shard")[0].as_py(), Text(table).anchors(width, piece, bits)[0], bits)

    anchors = materialise(sh.shared_anchors(held.each(send_anchors, "slice int, shard int, keys binary")), "anchors")
    regions = materialise(held.with_answers(anchors, lambda t, own: _regions(t, own, width, piece, bits), _sql(REGION)), "regions")
    judged = materialise(regions.where("slice >= 0").groupBy("slice").applyInArrow(_judge_regions, _sql(ANSWER)), "judged")
    known = _lying(regions).unionByName(judged)
    sent = materialise(held.with_answers(known, lambda t, own: _send(t, own, width), _sql(SENT)), "regions")
    size = sent.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # half of what a suffix shard holds is expected in each; one with a common anchor may have more
    sent = sent.withColumn("slice", F.shiftright("anchor", 63 - min(31, (2 * size // suffix_bytes).bit_length())).cast("int"))
    parts = sent.groupBy("slice").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.octet_length("text")) / F.lit(2 * suffix_bytes))).cast("int").alias("parts"))
    spread = sent.join(parts, "slice").withColumn("part", F.pmod(F.xxhash64("shard", "region"), F.col("parts")).cast("int"))
    # the join leaves all parts of a slice in one task, so they are dealt anew
    spread = spread.repartition("slice", "part")
    sorted_ = materialise(spread.groupBy("slice", "part").applyInArrow(lambda t: _suffixes(t, width), _sql(FOUND)), "suffixes")
    merged = sorted_.where("kind = 'sorted'").groupBy("slice", "range").applyInArrow(_merge, _sql(FOUND))
    windows = sorted_.where("kind = 'window'").unionByName(merged).select("shard", "kind", "slice", "bits", "places")
    return held.with_answers(known.unionByName(windows), lambda t, own: _cut(t, own, width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_bytes binary")
