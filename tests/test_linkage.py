import random

import pytest
from pyspark.sql import functions as F

from caseweave.functions.similarity import candidate_pairs, similar_text_pairs
from caseweave.operators.components import connected_components
from caseweave.operators.linkage import _chains, _links_between, match_names, resolve_components, resolve_greedy


def _names(n, seed):
    rng = random.Random(seed)
    stems = ["ramesh kumar", "suresh kumar", "anita devi", "mohan lal", "a", "ab", "lakshmi narayan", "rajendra prasad singh"]
    out = set()
    while len(out) < n:
        s = list(rng.choice(stems))
        for _ in range(rng.randrange(0, 4)):
            i = rng.randrange(len(s) + 1)
            op = rng.randrange(3)
            if op == 0:
                s.insert(i, rng.choice("aeiourstn "))
            elif op == 1 and s and i < len(s):
                s.pop(i)
            elif i < len(s):
                s[i] = rng.choice("aeiourstn")
        out.add("".join(s))
    return sorted(out)


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("cutoff", [0.82, 0.6, 0.95, 1.0])
def test_similarity_join_is_exact(spark, cutoff):
    left, right = _names(80, 1), _names(80, 2)
    want = {(a, b) for a in left for b in right if a == b or 1 - _edit(a, b) / max(len(a), len(b), 1) >= cutoff}

    def frame(names):
        return spark.createDataFrame([("k", n) for n in names], "block string, text string")

    got = [(r.a, r.b) for r in similar_text_pairs(frame(left), frame(right), cutoff).collect()]
    assert set(got) == want and len(got) == len(want)
    with pytest.raises(ValueError):
        similar_text_pairs(frame(left), frame(right), 0.0)


def test_texts_of_any_script_and_length(spark):
    rng = random.Random(4)
    names = ["", "é", "ßß", "日本語日本語", "日本語日本", "\U0001f600" * 7, "\U0001f600" * 6, "x" * 300, "x" * 290 + "y" * 10] + ["".join(rng.choices("abé日", k=n)) for n in range(1, 40)]
    frame = spark.createDataFrame([("k", n) for n in names] + [("k", None), (None, "x")], "block string, text string")
    want = {(a, b) for a in names for b in names if a == b or 1 - _edit(a, b) / max(len(a), len(b), 1) >= 0.82}
    assert {(r.a, r.b) for r in similar_text_pairs(frame, frame).collect()} == want


def test_candidates_grow_slower_than_the_pairs_of_a_block(spark):
    rng = random.Random(6)
    names = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=rng.randrange(12, 28))) for _ in range(3000)]
    counts = []
    for n in (300, 3000):
        frame = spark.createDataFrame([("k", x) for x in names[:n]], "block string, text string")
        counts.append(candidate_pairs(frame, frame, 0.82).count())
    assert counts[1] < 0.01 * 3000**2, counts


def test_greedy_resolution_matches_first_come_clustering(spark):
    rng = random.Random(5)
    names = _names(60, 9)
    rows = [(i, rng.choice("MF"), rng.choice(names), rng.randrange(1960, 1985), rng.randrange(2015, 2020)) for i in range(300)]
    rows += [(300, None, names[0], 1970, 2020), (301, None, names[0], 1970, 2021)]
    clusters, want, count = {}, {}, 0
    for i, block, name, year, _ in sorted(rows, key=lambda r: (r[4], r[0])):
        norm = " ".join(name.lower().split())
        hit = next((c for c in clusters.setdefault(block, []) if abs(c[1] - year) <= 3 and (
            norm == c[0] or 1 - _edit(norm, c[0]) / max(len(norm), len(c[0]), 1) >= 0.82)), None)
        if hit is None:
            count += 1
            hit = (norm, year, f"ACC-{count:06d}")
            clusters[block].append(hit)
        want[i] = hit[2]
    df = spark.createDataFrame(rows, "appearance_id long, block string, name string, birth_year int, case_year int")
    got = {r.appearance_id: r.entity_id for r in resolve_greedy(df).collect()}
    assert got == want


def test_name_match_exact_needs_one_equal_key(spark):
    left = spark.createDataFrame([(1, "S", "MYSORE"), (2, "S", "BANGALORE"), (3, "S", "NOWHERE"), (4, "T", "MYSORE")], "left_id long, block string, name string")
    right = spark.createDataFrame([(10, "S", "MYSORE"), (11, "S", "BANGALORE"), (12, "S", "BANGALORE"), (13, "S", "BANGALOR")], "right_id long, block string, name string")
    got = {r.left_id: (r.match_type, r.right_id) for r in match_names(left, right).collect()}
    assert got == {1: ("EXACT", 10), 2: ("FUZZY", 11)}


def test_flattened_cases_resolve_no_names(spark, monkeypatch):
    from caseweave.plans import products

    def refuse(*_):
        raise AssertionError("the case table needs no entities")

    monkeypatch.setattr(products, "resolve_components", refuse)
    assert products.flattened_cases(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()


@pytest.mark.parametrize("cutoff", [0.82, 0.6, 1.0])
def test_entity_components_equal_all_pairs(spark, cutoff):
    rng = random.Random(9)
    names = _names(60, 5)
    rows = [(i, rng.choice(["k", "l", None]), rng.choice(names + [None]), rng.choice([*range(1950, 1990, 2), None]), 0) for i in range(160)]
    rows += [(200 + i, "k", f"Supplier#{i * 7919 % 100000:09d}", 1950 + i % 23, 0) for i in range(60)]
    got = {r.appearance_id: r.entity_id for r in resolve_components(spark.createDataFrame(rows, "appearance_id long, block string, name string, birth_year int, case_year int"), cutoff).collect()}
    root = {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    norm = {r[0]: " ".join(r[2].lower().split()) if r[2] is not None else None for r in rows}
    for i, block, _, year, _ in rows:
        for j, other, _, when, _ in rows[: [r[0] for r in rows].index(i)]:
            a, b = norm[i], norm[j]
            known = None not in (block, a, year, other, b, when)
            same = (block, a, year) == (other, b, when)
            if same or (known and block == other and abs(year - when) <= 3 and (a == b or 1 - _edit(a, b) / max(len(a), len(b), 1) >= cutoff)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert got == {r[0]: find(r[0]) for r in rows}


def test_a_block_of_like_names_is_not_compared_as_a_whole(spark):
    units = spark.range(3000).select(F.lit("k").alias("block"), F.format_string("supplier#%09d", "id").alias("norm"), (1950 + F.col("id") % 40).cast("int").alias("birth_year"), F.struct(F.lit(0).alias("case_year"), F.col("id").alias("appearance_id")).alias("first"))
    chains = _chains(units, 0.82, 3)
    assert chains.count() <= 17 * 3000
    joined = units.join(connected_components(units.select(F.col("first").alias("id")), chains), F.col("first") == F.col("id")).drop("id")
    assert joined.select("component").distinct().count() == 1 and _links_between(joined, 0.82, 3).isEmpty()
