import random

import numpy as np
import pyarrow as pa
import pytest

from caseweave.llm import near
from caseweave.llm.common import table
from tests.llm.helpers import awkward, docs, prose


def labelled(text):
    words = (text or "").lower().split()
    grams = [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    seen, out = {}, []
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
        out.append((g, seen[g]))
    return out


def similarity(a, b):
    a, b = labelled(a), labelled(b)
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1] / (len(a) + len(b) - row[-1])


def classes(rows, threshold=0.8):
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, r in enumerate(rows):
        for q in rows[:i]:
            if (r[1] or "") == (q[1] or "") or similarity(r[1], q[1]) >= threshold:
                x, y = root(r[0]), root(q[0])
                parent[max(x, y)] = min(x, y)
    return {r[0]: root(r[0]) for r in rows}


def edited(text, share, seed):
    rng = random.Random(seed)
    words = text.split()
    for _ in range(max(1, int(share * len(words)))):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice([[], ["new"], [words[at], "more"]])
    return " ".join(words)


def test_alignment_is_the_longest_common_order():
    rng = random.Random(5)
    for n in range(60):
        a = prose(n, rng.randrange(1, 60), 9)
        b = edited(a, rng.random() * 0.2, n)
        (va, oa), (vb, ob) = near.shingles(pa.array([a])), near.shingles(pa.array([b]))
        want = similarity(a, b)
        assert near.alignment(va, vb, 0.8) == pytest.approx(want if want >= 0.8 - 1e-12 else 0.0)


def test_order_matters():
    # the same shingles in another order align only in part
    blocks = [prose(i, 30) for i in range(6)]
    a, b = " ".join(blocks), " ".join(blocks[3:] + blocks[:3])
    (va, _), (vb, _) = near.shingles(pa.array([a])), near.shingles(pa.array([b]))
    assert len(np.intersect1d(va, vb)) / len(va) > 0.9 and near.alignment(va, vb, 0.8) == 0.0


def test_classes_by_brute_force(spark):
    rows = []
    for g in range(12):
        base = prose(100 + g, 30 + 12 * g)
        rows += [(10 * g + i, edited(base, 0.012 * i, 7 * g + i) if i else base) for i in range(6)]
    rows += [(500 + i, prose(900 + i, 80)) for i in range(20)]
    passage = prose(77, 25)
    rows += [(600 + i, f"{prose(2000 + i, 40)} {passage} {prose(3000 + i, 40)}") for i in range(20)]
    got = {r["doc_id"]: r["class_id"] for r in near.near_groups(docs(spark, rows).repartition(5)).collect()}
    assert got == classes(rows)


def test_real_documents_by_brute_force(spark):
    given = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r["doc_id"], " ".join(r["text"].split()[:400])) for r in given.collect()]
    small = docs(spark, rows)
    got = {r["doc_id"]: r["class_id"] for r in near.near_groups(small).collect()}
    grams = {i: set(labelled(t)) for i, t in rows}
    for i, t in rows:
        for j, u in rows:
            if i < j and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]) and similarity(t, u) >= 0.8:
                assert got[i] == got[j]
    for i, c in got.items():
        if i != c:
            assert any(j != i and got[j] == c and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]) for j, _ in rows)


def test_awkward_rows(spark):
    rows = awkward()
    got = near.near_groups(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], []).append(r)
    assert all(r["class_id"] is None and r["kept"] for r in of[None])
    assert of[1][0]["class_id"] == of[2][0]["class_id"] == 1 and of[3][0]["class_id"] == 3
    assert {r["class_id"] for i in (4, 5, 11) for r in of[i]} == {4} and of[8][0]["class_id"] == 7
    assert sum(r["kept"] for r in of[5]) == 0 and of[4][0]["kept"]
    assert near.near_groups(docs(spark, [])).count() == 0


def test_one_document_of_each_class_stays(spark):
    rows = [(5, prose(1, 80)), (3, prose(1, 80) + " tail"), (3, prose(1, 80) + " tail"), (9, prose(2, 50)), (None, prose(2, 50)), (7, prose(4, 70)), (7, prose(5, 70)), (8, prose(5, 70))]
    given = docs(spark, rows)
    stay = near.drop_near(given)
    assert stay.columns == given.columns
    assert sorted((r["doc_id"] or -1 for r in stay.collect())) == [-1, 3, 7, 7, 9]


def test_groups_linked_by_one_pair_of_their_members(spark):
    # windows of one long text: 0.8 is reached up to a shift of 26 words, buckets hold dozens of windows
    words = [f"w{i}" for i in range(8240)]
    starts = sorted(random.Random(11).sample(range(8000), 1000))
    rows, want, first = [], {}, 0
    for i, at in enumerate(starts):
        d = at - starts[i - 1] if i else 0
        first = i if (236 - d) / (236 + d) < 0.8 else first
        want[i] = first
        rows.append((i, " ".join(words[at : at + 240])))
    got = {r["doc_id"]: r["class_id"] for r in near.near_groups(docs(spark, rows)).collect()}
    assert got == want
