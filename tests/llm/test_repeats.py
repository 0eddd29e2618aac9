import random
import re

import numpy as np
import pytest

from caseweave.llm import shards, substring, suffix
from caseweave.llm.common import table
from tests.llm.helpers import awkward, docs, prose


def by_words(rows, width):
    seen, out = set(), []
    for i, text in sorted(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for p in range(len(words) - width + 1):
            key = tuple(words[p : p + width])
            if key in seen:
                gone[p : p + width] = [True] * width
            seen.add(key)
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return sorted(out)


def by_bytes(rows, width):
    places = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for n, (_, b) in enumerate(texts):
        for p in range(len(b) - width + 1):
            places.setdefault(b[p : p + width], []).append((n, p))
    gone = [np.zeros(len(b), bool) for _, b in texts]
    for own in places.values():
        if len(own) > 1:
            for n, p in own:
                gone[n][p : p + width] = True
    out = []
    for (i, b), g in zip(texts, gone):
        runs = int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())
        out.append((i, len(b), int(g.sum()), runs, bytes(x for x, k in zip(b, g) if not k)))
    return sorted(out)


def texts(seed, count, alphabet):
    """Texts with shared passages, periodic stretches and copies."""
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(alphabet) for _ in range(rng.randrange(5, 60))) for _ in range(6)]
    rows = []
    for i in range(count):
        parts = [rng.choice(pool) if rng.random() < 0.4 else " ".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 50))) for _ in range(rng.randrange(0, 6))]
        if rng.random() < 0.3:
            parts.append((rng.choice(alphabet) + " ") * rng.randrange(2, 60))
        rows.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    return rows + [(count + k, rows[k][1]) for k in range(0, count, 5)]


FEW, MANY = ["a", "b"], [f"wörd{i}" for i in range(300)]


@pytest.mark.parametrize("seed,alphabet,shard_bytes,slice_bytes", [(1, FEW, 4000, 4000), (2, MANY, 10**9, 10**9), (2, MANY, 8000, 10**9)])
def test_words_by_brute_force(spark, seed, alphabet, shard_bytes, slice_bytes):
    rows = texts(seed, 50, alphabet)
    got = substring.drop_repeats(docs(spark, rows).repartition(3), 20, 8, shard_bytes, slice_bytes).collect()
    assert sorted(map(tuple, got)) == by_words(rows, 20)


@pytest.mark.parametrize("seed,alphabet,sizes", [(3, FEW, (10**9, 10**9, 10**9)), (3, FEW, (5000, 4000, 10**9)), (4, MANY, (8000, 10**9, 600))])
def test_bytes_by_brute_force(spark, seed, alphabet, sizes):
    rows = texts(seed, 40, alphabet)
    got = suffix.drop_repeats(docs(spark, rows).repartition(3), 60, 12, *sizes).collect()
    assert sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got) == by_bytes(rows, 60)


def test_real_documents(spark):
    given = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r["doc_id"], r["text"]) for r in given.collect()]
    got = substring.drop_repeats(given, shard_bytes=60_000, slice_bytes=100_000).collect()
    assert sorted(map(tuple, got)) == by_words(rows, 20)
    got = suffix.drop_repeats(given, shard_bytes=60_000, slice_bytes=100_000, suffix_bytes=10_000).collect()
    assert sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got) == by_bytes(rows, 200)


def test_paths_are_compacted_and_hold_up(spark):
    passage = " ".join(f"p{i}" for i in range(200))
    rows = [(1, "a b c " + passage), (2, passage + " d e"), (3, "f " + passage + " g")]
    held = shards.shard(docs(spark, rows).select("doc_id", "text"), 10**9, 10**9)
    paths = substring.repeated_paths(held).collect()
    assert sorted((r["edges"], r["source_start"]) for r in paths) == [(181, 3), (181, 3)]


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(8)
    for n in (1, 7, 60, 300):
        data = rng.integers(97, 99, n).astype(np.uint8)
        data[n // 2 :] = data[: n - n // 2]
        raw = data.tobytes()
        words = suffix.words_at(data)
        order, rank = suffix.suffix_order(words, 40)
        # zeros stand beyond the end
        keys = [(raw[i : i + 40] + b"\0" * 40)[:40] for i in range(n)]
        inside = [i for i in order.tolist() if n - i >= 40]
        assert inside == sorted(inside, key=lambda i: (keys[i], i))
        assert all((rank[i] == rank[j]) == (keys[i] == keys[j]) for i in inside for j in inside)
        room = n - np.arange(n)
        got = suffix.common_prefixes(words, room, np.array(inside, dtype=np.int64), 40)
        for k in range(1, len(inside)):
            a, b = raw[inside[k] :], raw[inside[k - 1] :]
            same = next((m for m in range(min(len(a), len(b))) if a[m] != b[m]), min(len(a), len(b)))
            assert got[k] == min(same, 40)


def test_awkward_rows(spark):
    rows = awkward()
    got = substring.drop_repeats(docs(spark, rows)).collect()
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], []).append(r)
    assert len(got) == len(rows) and of[1][0]["n_words"] == of[2][0]["n_words"] == of[3][0]["n_words"] == 0
    assert of[7][0]["n_removed"] == 0 and of[8][0]["n_removed"] == 30_000 and of[8][0]["kept_text"] == ""
    assert of[4][0]["n_removed"] == 0 and [r["n_removed"] for r in of[5]] == [60, 60] and of[11][0]["n_removed"] == 60
    # null ids come last, one of them is the first of its text
    assert sorted(r["n_removed"] for r in of[None]) == [0, 40]
    cut = {}
    for r in suffix.drop_repeats(docs(spark, rows)).collect():
        cut.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, cut.values())) == len(rows) and cut[1][0]["n_bytes"] == 0 and cut[8][0]["n_removed"] == cut[8][0]["n_bytes"] == cut[7][0]["n_removed"]
    assert substring.drop_repeats(docs(spark, [])).count() == 0 and suffix.drop_repeats(docs(spark, [])).count() == 0


def test_bounds_of_sorted_pairs():
    rng = np.random.default_rng(5)
    one, two = rng.integers(0, 9, 300).astype(np.uint64), rng.integers(0, 5, 300).astype(np.uint32)
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    pairs = list(zip(one.tolist(), two.tolist()))
    f, s = rng.integers(0, 11, 80).astype(np.uint64), rng.integers(0, 6, 80).astype(np.uint32)
    import bisect

    assert suffix._bound(one, two, f, s, False).tolist() == [bisect.bisect_left(pairs, p) for p in zip(f.tolist(), s.tolist())]
    assert suffix._bound(one, two, f, s, True).tolist() == [bisect.bisect_right(pairs, p) for p in zip(f.tolist(), s.tolist())]


def test_parts_of_a_common_anchor_are_dealt_to_tasks(spark, monkeypatch):
    """One anchor everywhere: its regions lie in several suffix shards, which an exchange by slice and part spreads."""
    plans, plain = [], suffix.materialise

    def noted(df, label="stage"):
        if label == "suffixes":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, label)

    monkeypatch.setattr(suffix, "materialise", noted)
    common = "the same opening of every text, long enough to hold an anchor of its own, over and over. " * 4
    rows = [(i, f"{common} and then {prose(i, 40)}") for i in range(60)]
    given = docs(spark, rows).repartition(3)
    got = {r["doc_id"]: r["n_removed"] for r in suffix.drop_repeats(given, suffix_bytes=2_000).collect()}
    assert all(n >= len(common) for n in got.values()) and len(got) == 60
    assert "part#" in plans[0][plans[0].index("Exchange hashpartitioning(slice") :].split("]")[0]
