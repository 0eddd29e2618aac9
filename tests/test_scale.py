import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseweave.operators import scale
from caseweave.operators.components import connected_components
from caseweave.operators.graph import cooccurrence
from caseweave.operators.history import percentile_rank


@pytest.mark.parametrize("kind", ["spread", "ties", "tiny"])
def test_exact_quantiles(spark, kind):
    rng = random.Random(7)
    draw = {"spread": lambda: rng.gauss(0, 100), "ties": lambda: float(rng.choice([1, 1, 1, 2, 5, 9])), "tiny": lambda: rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300)}[kind]
    values = [draw() for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    got = scale.exact_quantiles(df, "v", [0.0, 0.5, 0.98, 0.99, 1.0])
    assert got == pytest.approx(list(np.quantile(values, [0.0, 0.5, 0.98, 0.99, 1.0])), rel=1e-12)
    assert scale.exact_quantiles(df.limit(0), "v", [0.5]) == [None]


def test_quantiles_of_several_columns_in_the_same_passes(spark):
    rows = [(i, float(-i), [float(i), None, 1000.0 + i]) for i in range(101)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "a long, b double, c array<double>")
    got = scale.quantiles_together(df, {"a": (F.col("a"), [0.0, 0.25, 1.0]), "b": (F.col("b"), [0.1]), "c": (F.col("c"), [0.5]), "none": (F.when(F.col("a") > 1000, F.col("a")), [0.5])})
    assert got == {"a": [0.0, 25.0, 100.0], "b": [-90.0], "c": [550.0], "none": [None]}


def test_order_of_special_values(spark):
    values = [float("-inf"), -1.0, -0.0, 0.0, 5e-324, 1.0, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values[::-1]], "v double")
    got = scale.exact_quantiles(df, "v", [i / 7 for i in range(7)])
    assert got == values[:7] and np.isnan(scale.exact_quantiles(df, "v", [1.0])[0])


def _membership(seed):
    rng = random.Random(seed)
    rows = {(g, rng.randrange(40)) for g in range(60) for _ in range(rng.randrange(1, 5))}
    return rows | {(1000, i) for i in range(30)} | {(1001, i) for i in range(10, 40)} | {(1002, i) for i in range(0, 40, 2)}


def _brute(rows, least):
    groups = {}
    for g, i in rows:
        groups.setdefault(g, set()).add(i)
    counts = Counter(p for items in groups.values() for p in combinations(sorted(items), 2))
    return {(a, b, n) for (a, b), n in counts.items() if n >= least}


@pytest.mark.parametrize("least", [1, 2, 3])
def test_cooccurrence_with_hot_groups(spark, least):
    rows = _membership(least)
    df = spark.createDataFrame(list(rows), "grp long, item long")
    got = {tuple(r) for r in cooccurrence(df, "grp", "item", least, hot=8).collect()}
    assert got == _brute(rows, least)


def test_group_pairs_blocks(spark):
    rows = _membership(3)
    df = spark.createDataFrame(list(rows), "grp long, item long")
    got = [tuple(r) for r in scale.group_pairs(df, "grp", "item", block=4).collect()]
    groups = {}
    for g, i in rows:
        groups.setdefault(g, set()).add(i)
    assert sorted(got) == sorted((g, a, b) for g, items in groups.items() for a, b in combinations(sorted(items), 2))


def test_running_sums_ranks_and_carry(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.choice([None, "x", "y", "z"])) for k in range(3) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, pos long, v string")
    got = {(r.k, r.pos): (r.prev_v, r.n) for r in scale.chunk_running_sum(
        scale.carry_forward(df, ["k"], "pos", ["v"], chunk=7).withColumn("one", F.lit(1)), ["k"], "pos", "one", "n", chunk=7).collect()}
    for k in range(3):
        last = None
        for _, i, v in [r for r in rows if r[0] == k]:
            assert got[(k, i)] == (last, i + 1)
            last = v if v is not None else last
    ranked = scale.global_rank(df.select("k", "pos"), [F.col("pos"), F.col("k")], "r").collect()
    assert all(r.r == r.pos * 3 + r.k + 1 for r in ranked)


def test_percentile_rank_is_share_at_or_below(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2), ("d", 9)], "g string, n long")
    assert {r.g: r.percentile_rank for r in percentile_rank(df, "n").collect()} == {"a": 0.25, "b": 0.75, "c": 0.75, "d": 1.0}


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 101), (101, 102), (200, 100)]
    df = spark.createDataFrame(edges, "a long, b long")
    ids = spark.createDataFrame([(i,) for i in [*range(1, 31), 100, 101, 102, 200, 500]], "id long")
    got = {r.id: r.component for r in connected_components(ids, df).collect()}
    assert all(got[i] == 1 for i in range(1, 31)) and all(got[i] == 100 for i in (100, 101, 102, 200)) and got[500] == 500


def test_tasks_of_cooccurrence_grow_with_the_rows(spark, monkeypatch):
    from caseweave.operators import graph, scale

    rng = random.Random(12)
    rows = [(rng.randrange(200), rng.randrange(40)) for _ in range(900)] + [(1000, i % 40) for i in range(100)]
    links = spark.createDataFrame(rows, "g long, i long")
    want = Counter()
    for g in {g for g, _ in rows}:
        own = sorted({i for h, i in rows if h == g})
        want.update((a, b) for k, a in enumerate(own) for b in own[k + 1 :])
    monkeypatch.setattr(scale, "TASK_ROWS", 100)
    for least, hot in ((1, 2000), (2, 2000), (2, 10), (3, 10)):
        found = graph.cooccurrence(links, "g", "i", least, hot)
        assert {(r.a, r.b): r.weight for r in found.collect()} == {p: n for p, n in want.items() if n >= least}
    pairs = scale.group_pairs(links.distinct(), "g", "i", rows=2000)
    assert pairs.rdd.getNumPartitions() == 20
    edges = graph.cooccurrence(links, "g", "i", 2)
    assert graph.edge_evidence(edges, links, "g", "i").count() == sum(n for n in want.values() if n >= 2)


def test_rows_are_dealt_whatever_the_number_of_shuffle_partitions(spark, monkeypatch):
    monkeypatch.setattr(scale, "TASK_ROWS", 500)
    df = spark.range(20_000).withColumn("k", F.col("id") % 5_000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("2", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            counted = scale.dealt(df, 20_000, "k").groupBy("k").count().withColumn("task", F.spark_partition_id())
            rows = counted.groupBy("task").agg(F.sum("count").alias("n")).collect()
            assert len(rows) >= 30 and max(r["n"] for r in rows) <= 1_000 and sum(r["n"] for r in rows) == 20_000
            assert scale.dealt(df, 400, "k") is df
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_categories_of_communities_are_dealt_by_their_evidence(spark, monkeypatch):
    from caseweave.operators import graph

    rng = random.Random(5)
    links = spark.createDataFrame(sorted({(rng.randrange(60), rng.randrange(30)) for _ in range(400)}), "g long, i long")
    edges = graph.cooccurrence(links, "g", "i", 2).cache()
    labels = graph.node_set(edges).select("id", (F.col("id") % 3).alias("community")).cache()
    evidence = graph.edge_evidence(edges, links, "g", "i").withColumn("kind", F.concat(F.lit("k"), (F.col("g") % 20).cast("string"))).cache()
    want = {}
    for r in evidence.collect():
        if r["a"] % 3 == r["b"] % 3:
            want.setdefault(r["a"] % 3, set()).add(r["kind"])
    monkeypatch.setattr(scale, "TASK_ROWS", 50)
    found = graph.community_categories(edges, labels, evidence, "g", "kind")
    assert {r["community"]: r["categories"] for r in found.collect()} == {c: sorted(own) for c, own in want.items()}
    tasks = -(-evidence.count() // 50)
    assert tasks > 4 and found._jdf.queryExecution().toString().count(f", {tasks}), REPARTITION_BY_NUM") >= 2
