import math
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from caseweave.operators import graph as gr
from caseweave.operators.spatial import density_clusters


def _edges(seed, n=30, m=45):
    rng = random.Random(seed)
    out = set()
    while len(out) < m:
        a, b = sorted(rng.sample(range(n), 2))
        out.add((a, b))
    return sorted(out) + [(100, 101), (101, 102)]


def _neighbours(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def test_betweenness_matches_path_counting(spark):
    edges = _edges(1)
    near = _neighbours(edges)
    n = len(near)
    score = dict.fromkeys(near, 0.0)
    for s in near:
        order, preds, sigma, dist, queue = [], {v: [] for v in near}, dict.fromkeys(near, 0.0), {s: 0}, deque([s])
        sigma[s] = 1.0
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    preds[w].append(v)
        delta = dict.fromkeys(near, 0.0)
        for w in reversed(order):
            for v in preds[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    df = spark.createDataFrame([(a, b, 1) for a, b in edges], "a long, b long, weight long")
    want = {v: x / ((n - 1) * (n - 2)) for v, x in score.items()}
    for state_rows in (gr.STATE_ROWS, 10 * n):
        assert {r.id: r.betweenness for r in gr.betweenness(df, state_rows).collect()} == pytest.approx(want)
    whole = gr.betweenness_sample(df, error=1e-9, first=4).collect()
    assert {r.id: r.betweenness for r in whole} == pytest.approx(want) and all(r.bound == 0 and r.sources == n for r in whole)


def test_sampled_betweenness_stays_within_its_bound(spark):
    # two stars with a bridge: the centres lie between almost all pairs
    edges = [(0, i) for i in range(1, 200)] + [(1000, 1000 + i) for i in range(1, 200)] + [(0, 1000)]
    df = spark.createDataFrame([(a, b, 1) for a, b in edges], "a long, b long, weight long")
    want = {r.id: r.betweenness for r in gr.betweenness(df).collect()}
    rough = gr.betweenness_sample(df, error=0.5, first=32).collect()
    assert rough[0].sources < 400 and all(abs(r.betweenness - want[r.id]) <= r.bound for r in rough)


def test_shortest_paths(spark):
    edges = _edges(2)
    near = _neighbours(edges)
    df = spark.createDataFrame([(a, b, 1) for a, b in edges], "a long, b long, weight long")
    pairs = [(s, t) for s in (0, 3, 100) for t in (5, 9, 102, 999, s) if s in near]
    answers, nodes = gr.shortest_paths(gr.both_ways(df), spark.createDataFrame(pairs, "source long, target long"))
    got = {(r.source, r.target): r for r in answers.collect()}
    found = {(r.source, r.target): [int(x) for x in r.path.split(">")] for r in gr.path_texts(nodes).collect()}
    assert len(got) == len(set(pairs)) == answers.count()
    for s, t in pairs:
        dist, queue = {t: 0}, deque([t] if t in near else [])
        while queue:
            v = queue.popleft()
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
        row = got[(s, t)]
        if t not in near or s not in dist:
            assert not row.found and row.hops is None and (s, t) not in found
            continue
        path = [s]
        while path[-1] != t:
            path.append(min(w for w in near[path[-1]] if dist.get(w) == dist[path[-1]] - 1))
        assert found[s, t] == path and row.hops == len(path) - 1
    hops = {(r.source, r.target, r.hop): (r.from_id, r.to_id) for r in gr.path_hops(nodes).collect()}
    assert hops == {(s, t, i): (p[i], p[i + 1]) for (s, t), p in found.items() for i in range(len(p) - 1)}


def test_long_directed_paths_and_a_limit(spark):
    arcs = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(20, 0), (5, 30), (30, 7)], "id long, other long")
    pairs = spark.createDataFrame([(0, 20), (20, 19), (3, 7), (30, 5), (7, 30)], "source long, target long")
    answers, nodes = gr.shortest_paths(arcs, pairs)
    assert {(r.source, r.target): r.hops for r in answers.collect()} == {(0, 20): 20, (20, 19): 20, (3, 7): 4, (30, 5): 20, (7, 30): 20}
    paths = {(r.source, r.target): r.path for r in gr.path_texts(nodes).collect()}
    assert paths[3, 7] == "3>4>5>6>7" and paths[0, 20] == ">".join(map(str, range(21)))
    near, _ = gr.shortest_paths(arcs, pairs, max_hops=5)
    assert {(r.source, r.target): r.hops for r in near.collect()} == {(0, 20): None, (20, 19): None, (3, 7): 4, (30, 5): None, (7, 30): None}


def test_communities_are_connected(spark):
    rng = random.Random(3)
    edges = sorted({tuple(sorted(rng.sample(range(24), 2))) for _ in range(30)})
    df = spark.createDataFrame([(a, b, rng.randrange(1, 4)) for a, b in edges], "a long, b long, weight long")
    row = gr.partition_check(df, gr.communities(df)).first()
    assert row.in_several == row.in_pieces == 0 and row.sums_agree and row.better_than_single_nodes
    torn = gr.node_set(df).select("id", F.lit(0).cast("long").alias("community"))
    lone = spark.createDataFrame([(200, 201, 1)], df.schema)
    assert gr.partition_check(df.unionByName(lone), torn.unionByName(spark.createDataFrame([(200, 0), (201, 0)], torn.schema))).first().in_pieces == 1


def test_communities_cover_and_beat_singletons(spark):
    edges = [(i, j) for base in (0, 10, 20) for i in range(base, base + 6) for j in range(i + 1, base + 6)] + [(5, 10), (15, 20)]
    df = spark.createDataFrame([(a, b, 1) for a, b in edges], "a long, b long, weight long")
    labels = gr.communities(df).cache()
    assert labels.count() == 18 and labels.select("id").distinct().count() == 18
    assert gr.modularity(df, labels) > 0.5
    summary = {r.community: r for r in gr.community_summary(df, labels, 3).collect()}
    assert sum(r.size for r in summary.values()) == 18 and all(r.core == r.community for r in summary.values())
    with pytest.raises(ValueError):
        gr.ego_nodes(df, labels, 4)


def _km(p, q):
    a, b, c, d = map(math.radians, (*p, *q))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("lat0", [0.0, 12.0, 70.0])
def test_density_clusters_match_pairwise_definition(spark, lat0):
    rng = random.Random(int(lat0) + 3)
    points = [(round(lat0 + rng.gauss(c, 0.12), 3), round(77 + rng.gauss(c, 0.15), 3)) for c in (0, 0.6, 1.5) for _ in range(60)]
    points += [points[0]] * 4 + [(lat0 + 5.0, 70.0), (lat0 - 3.0, 80.0)]
    eps, least = 12.0, 5
    weight = {}
    for p in points:
        weight[p] = weight.get(p, 0) + 1
    spots = sorted(weight)
    near = {p: [q for q in spots if _km(p, q) <= eps] for p in spots}
    core = {p for p in spots if sum(weight[q] for q in near[p]) >= least}
    label = {}
    for p in sorted(core):
        if p in label:
            continue
        stack = [p]
        while stack:
            v = stack.pop()
            if v not in label:
                label[v] = p
                stack += [q for q in near[v] if q in core]
    for p in spots:
        if p not in core:
            label[p] = min((label[q] for q in near[p] if q in core), default=None)
    got = density_clusters(spark.createDataFrame(points, "lat double, lon double"), eps, least).collect()
    assert {(r.lat, r.lon): (tuple(r.cluster) if r.cluster else None, r.is_core) for r in got} == {p: (label[p], p in core) for p in spots}
    assert sum(r.weight for r in got) == len(points)


def test_no_cartesian_products(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a long, b long, weight long")
    links = spark.createDataFrame([(1, 2)], "grp long, item long")
    for frame in (gr.degrees(df), gr.associates(df), gr.cooccurrence(links, "grp", "item", 2), gr.ego_nodes(df, df.select(F.col("a").alias("id")), 2)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
