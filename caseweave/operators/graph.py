"""Graphs as edge tables (a < b, weight): views, neighbourhoods, paths, centrality, communities."""

from __future__ import annotations

from math import ceil, log, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.operators.components import connected_components
from caseweave.operators.scale import dealt, global_rank, group_pairs, top_per_group
from caseweave.session import materialise


def cooccurrence(links: DataFrame, group: str, item: str, min_weight: int = 1, hot: int = 2_000) -> DataFrame:
    """(a, b, weight): item pairs that share at least ``min_weight`` groups.

    For min_weight t > 1 an item's t-1 largest groups are left out of pair building
    when they are hot (over ``hot`` members): two items with t common groups still
    meet in a smaller one. Those groups are added back by membership look-ups for
    the pairs found, so weights stay exact and a hot group is not expanded.
    """
    n = links.count()
    members = materialise(dealt(links.select(group, item), n, group, item).distinct(), "members")

    def sizes(own: DataFrame) -> DataFrame:
        return dealt(own, n, group).groupBy(group).agg(F.count("*").alias("_size"))

    def weighted(own: DataFrame) -> DataFrame:
        held = int(sizes(own).agg(F.sum(F.col("_size") * (F.col("_size") - 1) / 2)).first()[0] or 0)
        return dealt(group_pairs(own, group, item, rows=max(n, held)), held, "a", "b").groupBy("a", "b").agg(F.count("*").alias("weight"))

    if min_weight <= 1:
        return weighted(members)
    big = sizes(members).where(F.col("_size") > hot)
    skipped = top_per_group(members.join(big, group), [item], [F.col("_size").desc(), F.col(group)], min_weight - 1, "_rk").select(group, item)
    skipped = materialise(skipped, "hotmembers")
    pairs = weighted(members.join(skipped, [group, item], "left_anti"))
    if skipped.isEmpty():
        return pairs.where(F.col("weight") >= min_weight)
    pairs = materialise(pairs, "pairs")
    via_a = pairs.join(skipped.withColumnRenamed(item, "a"), "a").join(members.withColumnRenamed(item, "b"), [group, "b"], "left_semi")
    via_b = pairs.join(skipped.withColumnRenamed(item, "b"), "b").join(members.withColumnRenamed(item, "a"), [group, "a"], "left_semi")
    extra = via_a.select("a", "b", group).unionByName(via_b.select("a", "b", group)).distinct().groupBy("a", "b").agg(F.count("*").alias("_x"))
    return (
        pairs.join(extra, ["a", "b"], "left")
        .select("a", "b", (F.col("weight") + F.coalesce("_x", F.lit(0))).alias("weight"))
        .where(F.col("weight") >= min_weight)
    )


def edge_evidence(edges: DataFrame, links: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, group): the shared groups behind each edge, in long form."""
    n = links.count()
    members = materialise(dealt(links.select(group, item), n, group, item).distinct(), "members")
    return (
        edges.select("a", "b").join(dealt(members.withColumnRenamed(item, "a"), n, "a"), "a")
        .join(dealt(members.withColumnRenamed(item, "b"), n, group, "b"), [group, "b"], "left_semi").select("a", "b", group)
    )


def both_ways(edges: DataFrame, *carry: str) -> DataFrame:
    """Each edge seen from both ends: (id, other, carried columns)."""
    ends = F.array(
        F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other"))
    )
    return edges.select(F.explode(ends).alias("e"), *carry).select("e.id", "e.other", *carry)


def node_set(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges, "weight").groupBy("id").agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"))


def vertex_profiles(people: DataFrame, key: str, roles: DataFrame, rollup: DataFrame, edges: DataFrame) -> DataFrame:
    """People with sorted role list, prior count, tier and degree; defaults where absent."""
    role_sets = roles.select(key, "role").distinct().groupBy(key).agg(F.array_sort(F.collect_list("role")).alias("roles"))
    return (
        people.join(role_sets, key, "left")
        .join(rollup.select(key, "n_cases", "risk_tier"), key, "left")
        .join(degrees(edges).select(F.col("id").alias(key), "degree"), key, "left")
        .withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))
        .withColumn("n_cases", F.coalesce("n_cases", F.lit(0)))
        .withColumn("degree", F.coalesce("degree", F.lit(0)))
    )


def graph_view(edges: DataFrame, nodes: DataFrame, key: str, attribute: str, contains: str | None, min_weight: int,
               limit_nodes: int | None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) above a weight, filtered by a node attribute, capped to the top degrees."""
    whole_degree = degrees(edges)
    strong = edges.where(F.col("weight") >= min_weight)
    kept = node_set(strong).join(nodes.withColumnRenamed(key, "id"), "id")
    if contains:
        kept = kept.where(F.contains(F.lower(attribute), F.lit(contains.lower())))
    kept = kept.join(whole_degree.select("id", "degree"), "id")
    if limit_nodes:
        kept = kept.orderBy(F.col("degree").desc(), "id").limit(limit_nodes)
    ids = kept.select("id")
    inner = strong.join(ids.select(F.col("id").alias("a")), "a", "left_semi").join(ids.select(F.col("id").alias("b")), "b", "left_semi")
    return kept, inner.select("a", "b", "weight")


def ego_nodes(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, id, hops): nodes within ``depth`` (1-3) hops of every seed of a seed table."""
    if not 1 <= depth <= 3:
        raise ValueError("depth must be 1, 2 or 3")
    around = both_ways(edges)
    known = node_set(edges)
    reached = seeds.select(F.col("id")).distinct().join(known, "id", "left_semi").select(F.col("id").alias("seed"), "id", F.lit(0).alias("hops"))
    for hop in range(1, depth + 1):
        step = reached.where(F.col("hops") == hop - 1).join(around, "id").select("seed", F.col("other").alias("id"), F.lit(hop).alias("hops"))
        reached = reached.unionByName(step).groupBy("seed", "id").agg(F.min("hops").alias("hops"))
    return reached


def ego_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(seed, a, b, weight): edges with both ends inside each ego network."""
    inside = members.select("seed", "id")
    return (
        inside.withColumnRenamed("id", "a").join(edges, "a")
        .join(inside.withColumnRenamed("id", "b"), ["seed", "b"], "left_semi").select("seed", "a", "b", "weight")
    )


def shortest_paths(arcs: DataFrame, pairs: DataFrame, max_hops: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Unweighted shortest path for each (source, target) of a pairs table.

    ``arcs`` (id, other) are directed; pass ``both_ways(edges)`` for an undirected graph. Returns
    (source, target, hops, found), one row per distinct pair, and (source, target, hop, id), the
    nodes of each path found. Among equal paths the one with the smallest next node at each hop.

    All searches advance together, in turn from the sources and from the targets, until the two
    sides of a pair meet, so no side goes deeper than half the way. A reached node is a row with at
    most a pointer to the next node; searches that share an end share their rows. Paths are
    rebuilt from the places where the sides met: level by level to the nodes that lie between, and
    then by joining pointers to themselves, each time twice as far.
    """
    pairs = materialise(pairs.select("source", "target").distinct(), "pathpairs")
    known = arcs.select("id").unionByName(arcs.select(F.col("other").alias("id"))).distinct()
    waiting = materialise(pairs.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi"), "waiting")
    ahead = [materialise(waiting.select(F.col("source").alias("root"), F.col("source").alias("id")).distinct(), "ahead")]
    behind = [materialise(waiting.select(F.col("target").alias("root"), F.col("target").alias("id")).distinct(), "behind")]
    met: dict[tuple[int, int], DataFrame] = {}
    while True:
        here = waiting.join(ahead[-1].withColumnRenamed("root", "source"), "source").join(behind[-1].select(F.col("root").alias("target"), "id"), ["target", "id"])
        here = materialise(here.select("source", "target", "id"), "met")
        hops = len(ahead) + len(behind) - 2
        if not here.isEmpty():
            met[len(ahead) - 1, len(behind) - 1] = here
            waiting = materialise(waiting.join(here, ["source", "target"], "left_anti"), "waiting")
        if waiting.isEmpty() or (max_hops is not None and hops >= max_hops):
            break
        forward = len(ahead) <= len(behind)
        levels, end = (ahead, "source") if forward else (behind, "target")
        level = levels[-1].join(waiting.select(F.col(end).alias("root")).distinct(), "root", "left_semi")
        step = arcs.select("id", F.col("other").alias("to")) if forward else arcs.select(F.col("other").alias("id"), F.col("id").alias("to"))
        fresh = level.join(step, "id").groupBy("root", F.col("to").alias("id"))
        fresh = fresh.agg(F.lit(0).alias("_")).drop("_") if forward else fresh.agg(F.min("id").alias("onward"))
        for older in levels:
            fresh = fresh.join(older.select("root", "id"), ["root", "id"], "left_anti")
        levels.append(materialise(fresh, "ahead" if forward else "behind"))
        # a search with nothing new has seen all it can reach
        waiting = materialise(waiting.join(levels[-1].select(F.col("root").alias(end)).distinct(), end, "left_semi"), "waiting")
        if waiting.isEmpty():
            break
    key = ["source", "target"]
    hops = None
    for (i, j), here in met.items():
        own = here.select(*key).distinct().withColumn("hops", F.lit(i + j))
        hops = own if hops is None else hops.unionByName(own)
    empty = pairs.limit(0)
    hops = empty.withColumn("hops", F.lit(0)) if hops is None else materialise(hops, "hops")
    answers = pairs.join(hops, key, "left").select(*key, "hops", F.col("hops").isNotNull().alias("found"))
    pointers = _pointers(arcs, ahead, behind, met)
    nodes = hops.select(*key, F.lit(0).alias("hop"), F.col("source").alias("id"))
    jumps, longest = [pointers], max((i + j for i, j in met), default=0)
    while pointers is not None and 2 ** len(jumps) <= longest:
        last = jumps[-1]
        jumps.append(materialise(last.join(last.select(*key, F.col("onward").alias("to"), F.col("id").alias("onward")), [*key, "onward"]).select(*key, "id", F.col("to").alias("onward")), "jumps"))
    for k in reversed(range(len(jumps) if pointers is not None else 0)):
        nodes = materialise(nodes.unionByName(nodes.join(jumps[k], [*key, "id"]).select(*key, (F.col("hop") + 2**k).alias("hop"), F.col("onward").alias("id"))), "pathnodes")
    return answers, nodes


def _pointers(arcs: DataFrame, ahead: list[DataFrame], behind: list[DataFrame], met: dict[tuple[int, int], DataFrame]) -> DataFrame | None:
    """(source, target, id, onward): the smallest next node of every node that shortest paths of a pair may use."""
    out, key = None, ["source", "target"]
    here = None
    for i in range(max((i for i, _ in met), default=0), 0, -1):
        for (reached, _), own in met.items():
            if reached == i:
                here = own if here is None else here.unionByName(own)
        back = here.join(arcs.select(F.col("id").alias("before"), F.col("other").alias("id")), "id").join(ahead[i - 1].select(F.col("root").alias("source"), F.col("id").alias("before")), ["source", "before"])
        step = materialise(back.groupBy(*key, F.col("before").alias("id")).agg(F.min("id").alias("onward")), "pointers")
        out = step if out is None else out.unionByName(step)
        here = step.select(*key, "id")
    here = None
    for j in range(max((j for _, j in met), default=0), 0, -1):
        for (_, reached), own in met.items():
            if reached == j:
                here = own if here is None else here.unionByName(own)
        step = materialise(here.distinct().join(behind[j].select(F.col("root").alias("target"), "id", "onward"), ["target", "id"]).select(*key, "id", "onward"), "pointers")
        out = step if out is None else out.unionByName(step)
        here = step.select(*key, F.col("onward").alias("id"))
    return out


def path_hops(nodes: DataFrame) -> DataFrame:
    """(source, target, hop, from_id, to_id): the single hops of the paths whose nodes are given."""
    key = ["source", "target", "hop"]
    return nodes.withColumnRenamed("id", "from_id").join(nodes.select("source", "target", (F.col("hop") - 1).alias("hop"), F.col("id").alias("to_id")), key).select(*key, "from_id", "to_id")


def path_texts(nodes: DataFrame, separator: str = ">") -> DataFrame:
    """(source, target, path): the nodes of each path in order, as one text; as long as the path."""
    listed = nodes.groupBy("source", "target").agg(F.array_sort(F.collect_list(F.struct("hop", "id"))).alias("nodes"))
    return listed.select("source", "target", F.array_join(F.transform("nodes", lambda n: n["id"].cast("string")), separator).alias("path"))


#: Rows (source and node) that the searches of one batch of sources may hold at a time.
STATE_ROWS = 200_000_000


def betweenness(edges: DataFrame, state_rows: int = STATE_ROWS) -> DataFrame:
    """(id, betweenness): exact unweighted betweenness, normalised by (n-1)(n-2)/2.

    Sources are worked through in batches, so that the rows for each source and node stay within
    ``state_rows`` at any size of the graph; each batch adds its dependencies into one table of
    nodes. All sources of a batch advance level by level: one join and one aggregation per
    level count shortest paths, then the dependencies flow back the same way. A node
    next to level l lies on level l-1, l or l+1, so a new level is only compared
    with the last two. Levels are written to the shared folder.
    """
    nodes, arcs, n = _centre_tables(edges)
    if n < 3:
        return nodes.select("id", F.lit(0.0).alias("betweenness"))
    batches = max(1, -(-n * n // state_rows))
    sums = nodes.select("id", F.lit(0.0).alias("s"))
    for b in range(batches):
        part = _dependencies(nodes.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == b), arcs)
        sums = materialise(sums.unionByName(part.select("id", F.col("delta").alias("s"))).groupBy("id").agg(F.sum("s").alias("s")), "dependency")
    return sums.select("id", (F.col("s") / ((n - 1) * (n - 2))).alias("betweenness"))


def betweenness_sample(edges: DataFrame, error: float = 0.01, failure: float = 0.01, first: int = 64) -> DataFrame:
    """(id, betweenness, bound, sources): betweenness estimated from a growing sample of sources.

    A source's dependency on a node, divided by n - 2, lies between 0 and 1, and its mean over all
    sources is the node's betweenness (but for the factor n / (n - 1)). Sources are drawn in the
    order of a hash, twice as many in all from round to round, until every node's bound is within
    ``error`` or all sources are used. ``bound`` is the empirical Bernstein bound: with a
    probability of 1 - ``failure`` no node in any round is further off. 0 when all are used.
    """
    nodes, arcs, n = _centre_tables(edges)
    if n < 3:
        return nodes.select("id", F.lit(0.0).alias("betweenness"), F.lit(0.0).alias("bound"), F.lit(n).alias("sources"))
    drawn = materialise(global_rank(nodes, [F.xxhash64("id", F.lit(17)), F.col("id")], "place"), "drawn")
    rounds = max(1, ceil(log2(n / first)) + 1) if n > first else 1
    share = log(3.0 * n * rounds / failure)
    sums = nodes.select("id", F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    used, size = 0, min(first, n)
    while True:
        part = _dependencies(drawn.where((F.col("place") > used) & (F.col("place") <= size)).select("id"), arcs)
        sums = materialise(sums.unionByName(part.select("id", F.col("delta").alias("s"), F.col("squares").alias("q"))).groupBy("id").agg(F.sum("s").alias("s"), F.sum("q").alias("q")), "sampled")
        used = size
        mean = F.col("s") / (n - 2) / used
        spread = F.greatest(F.lit(0.0), F.col("q") / (n - 2) ** 2 / used - mean * mean)
        bound = F.lit(0.0) if used == n else (F.sqrt(2 * spread * share / used) + 3 * share / used) * (n / (n - 1))
        found = sums.select("id", (mean * (n / (n - 1))).alias("betweenness"), bound.alias("bound"), F.lit(used).alias("sources"))
        if used == n or found.agg(F.max("bound")).first()[0] <= error:
            return found
        size = min(n, 2 * used)


def _centre_tables(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    nodes = materialise(node_set(edges), "nodes")
    return nodes, materialise(both_ways(edges), "arcs"), nodes.count()


def _dependencies(sources: DataFrame, arcs: DataFrame) -> DataFrame:
    """(id, delta, squares): the sums of the sources' dependencies on each node, and of their squares."""
    level = materialise(sources.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("sigma")), "sigma")
    levels = [level]
    while True:
        step = levels[-1].join(arcs, "id").groupBy("s", F.col("other").alias("id")).agg(F.sum("sigma").alias("sigma"))
        for older in levels[-2:]:
            step = step.join(older.select("s", "id"), ["s", "id"], "left_anti")
        level = materialise(step, "sigma")
        if level.isEmpty():
            break
        levels.append(level)
    # a node of the last level gets no dependency back
    current = levels[-1].withColumn("delta", F.lit(0.0))
    result = levels[0].select("id", F.lit(0.0).alias("delta"), F.lit(0.0).alias("squares"))
    for upper in reversed(levels[:-1]):
        share = current.select("s", F.col("id").alias("below"), ((F.col("delta") + 1) / F.col("sigma")).alias("share"))
        back = (
            share.join(arcs, F.col("below") == F.col("id")).select("s", F.col("other").alias("id"), "share")
            .groupBy("s", "id").agg(F.sum("share").alias("share"))
        )
        current = materialise(
            upper.join(back, ["s", "id"], "left").select("s", "id", "sigma", (F.col("sigma") * F.coalesce("share", F.lit(0.0))).alias("delta")), "delta"
        )
        own = current.where(F.col("s") != F.col("id")).groupBy("id").agg(F.sum("delta").alias("delta"), F.sum(F.col("delta") * F.col("delta")).alias("squares"))
        result = result.unionByName(own)
    return result.groupBy("id").agg(F.sum("delta").alias("delta"), F.sum("squares").alias("squares"))


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Weighted modularity of a partition (id, community); a loop (a = b) counts inside."""
    half = edges.agg(F.sum("weight").cast("double")).scalar()
    strength = both_ways(edges, "weight").join(labels, "id").groupBy("community").agg(F.sum("weight").cast("double").alias("k"))
    squares = strength.agg(F.sum(F.col("k") * F.col("k"))).scalar()
    value = (
        edges.join(labels.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a")
        .join(labels.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
        .agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).alias("inside"))
        .select((F.col("inside") / half - squares / (half * half * 4)).alias("q"))
    )
    return value.first()["q"] or 0.0


#: Differences of modularity that the order of summation alone can make.
NOISE = 1e-9


def communities(edges: DataFrame) -> DataFrame:
    """(id, community): weighted modularity communities, named by their smallest node.

    Louvain's two phases with synchronous moves: in each round a hash-chosen half of
    the nodes moves to the neighbouring community with the highest gain, then
    communities become nodes. A round or level counts only if it raises modularity, and
    the search ends when none does. At last each community is split along its own links:
    parts without a link between them are communities of their own, which never lowers
    modularity and leaves every community in one piece. Everything is joins and
    aggregations; no community or component is ever gathered in one task.
    """
    level_edges = materialise(edges.select("a", "b", F.col("weight").cast("double").alias("weight")), "louvain")
    mapping = materialise(node_set(edges).select("id", F.col("id").alias("community")), "louvainmap")
    two_m = 2.0 * (level_edges.agg(F.sum("weight")).first()[0] or 0.0)
    if two_m == 0:
        return mapping
    best = None
    while True:
        labels, quality = _local_moves(level_edges, two_m)
        if best is not None and quality <= best + NOISE:
            break
        best = quality
        mapping = materialise(
            mapping.join(labels.select(F.col("id").alias("community"), F.col("community").alias("to")), "community").select("id", F.col("to").alias("community")),
            "louvainmap",
        )
        level_edges = materialise(
            level_edges.join(labels.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a")
            .join(labels.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
            .groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("weight").alias("weight")),
            "louvain",
        )
    return _connected_parts(edges, mapping)


def _connected_parts(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, community): each community split into the parts that its own links connect, named by their smallest node."""
    inner = (
        edges.join(labels.select(F.col("id").alias("a"), "community"), "a").join(labels.select(F.col("id").alias("b"), F.col("community").alias("other")), "b")
        .where(F.col("community") == F.col("other")).select("a", "b")
    )
    parts = connected_components(labels.select("id"), inner)
    return materialise(parts.select("id", F.col("component").alias("community")), "parts")


def _local_moves(edges: DataFrame, two_m: float) -> tuple[DataFrame, float]:
    """One Louvain level as (id, community) and its modularity. Loops (a = b) hold the inner
    weight of contracted communities. A round that does not raise modularity is taken back;
    the level ends when neither half can raise it."""
    state = materialise(both_ways(edges, "weight").groupBy("id").agg(F.sum("weight").alias("k")).withColumn("community", F.col("id")), "state")
    around = materialise(both_ways(edges.where(F.col("a") != F.col("b")), "weight"), "around")
    best, round_no, idle = modularity(edges, state.select("id", "community")), 0, 0
    while idle < 2:
        sizes = state.groupBy("community").agg(F.sum("k").alias("tot"))
        mine = state.where(F.pmod(F.xxhash64("id", F.lit(round_no // 2)), F.lit(2)) == round_no % 2)
        # links of the moving half to each community around it; staying is always an option
        links = around.join(mine.select("id"), "id", "left_semi").join(state.select(F.col("id").alias("other"), "community"), "other")
        options = (
            links.select("id", "community", "weight").unionByName(mine.select("id", "community", F.lit(0.0).alias("weight")))
            .groupBy("id", "community").agg(F.sum("weight").alias("w"))
            .join(sizes, "community").join(mine.select("id", F.col("community").alias("home"), "k"), "id")
        )
        at_home = F.col("community") == F.col("home")
        rest = F.col("tot") - F.when(at_home, F.col("k")).otherwise(0.0)
        # staying wins ties, then the smaller community id
        gain = F.col("w") - F.col("k") * rest / two_m + F.when(at_home, 1e-9).otherwise(0.0)
        choice = options.groupBy("id").agg(F.min_by("community", F.struct(-gain, F.col("community"))).alias("to"))
        moved = materialise(state.join(choice, "id", "left").select("id", "k", F.coalesce("to", "community").alias("community")), "state")
        quality = modularity(edges, moved.select("id", "community"))
        if quality > best + NOISE:
            state, best, idle = moved, quality, 0
        else:
            idle += 1
        round_no += 1
    return state.select("id", "community"), best


def community_summary(edges: DataFrame, labels: DataFrame, min_size: int = 3) -> DataFrame:
    """Size, core member (highest weighted degree inside), inner edges and inner weight."""
    inner = (
        edges.join(labels.select(F.col("id").alias("a"), "community"), "a")
        .join(labels.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b").where(F.col("community") == F.col("cb"))
    )
    sizes = labels.groupBy("community").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    weights = inner.groupBy("community").agg(F.count("*").alias("inner_edges"), F.sum("weight").alias("inner_weight"))
    core = (
        both_ways(inner, "weight", "community").groupBy("community", "id").agg(F.sum("weight").alias("w"))
        .groupBy("community").agg(F.min_by("id", F.struct(-F.col("w"), F.col("id"))).alias("core"))
    )
    return sizes.join(weights, "community", "left").join(core, "community", "left").select(
        "community", "size", F.coalesce("core", "community").alias("core"),
        F.coalesce("inner_edges", F.lit(0)).alias("inner_edges"), F.coalesce("inner_weight", F.lit(0)).alias("inner_weight"),
    )


def partition_check(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of what must hold of communities: each node once, all weight inside or between, each community one piece, modularity above that of single nodes."""
    sizes = labels.groupBy("id").agg(F.count("*").alias("k"))
    pieces = connected_components(labels.select("id"), edges.join(labels.select(F.col("id").alias("a"), "community"), "a").join(
        labels.select(F.col("id").alias("b"), F.col("community").alias("other")), "b").where(F.col("community") == F.col("other")).select("a", "b"))
    split = labels.join(pieces, "id").groupBy("community").agg(F.count_distinct("component").alias("k"))
    summary = community_summary(edges, labels, 1).agg(F.sum("size").alias("nodes"), F.sum("inner_weight").alias("inner")).first()
    cut = (
        edges.join(labels.select(F.col("id").alias("a"), "community"), "a").join(labels.select(F.col("id").alias("b"), F.col("community").alias("other")), "b")
        .where(F.col("community") != F.col("other")).agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("v")).first()["v"]
    )
    whole = edges.agg(F.sum("weight").alias("v")).first()["v"]
    better = modularity(edges, labels) > modularity(edges, labels.select("id", F.col("id").alias("community")))
    return sizes.agg(F.count("*").alias("nodes"), F.count_if(F.col("k") > 1).alias("in_several")).select(
        "nodes", F.lit(whole).cast("bigint").alias("weight"), "in_several", split.agg(F.count_if(F.col("k") > 1).alias("v")).scalar().alias("in_pieces"),
        F.lit(better).alias("better_than_single_nodes"), (F.lit(summary["inner"] + cut == whole) & (F.lit(summary["nodes"]) == F.col("nodes"))).alias("sums_agree"),
    )


def hub_listing(edges: DataFrame, centrality: DataFrame, people: DataFrame, key: str, rollup: DataFrame, limit: int) -> DataFrame:
    """The nodes of highest degree, then betweenness, with their name, tier and prior count; ``centrality`` is (id, betweenness, ...)."""
    named = degrees(edges).select("id", "degree").join(centrality, "id").join(people.withColumnRenamed(key, "id"), "id", "left")
    listed = named.join(rollup.select(F.col(key).alias("id"), "n_cases", "risk_tier"), "id", "left").withColumn("n_cases", F.coalesce("n_cases", F.lit(0)))
    return listed.withColumn("risk_tier", F.coalesce("risk_tier", F.lit("LOW"))).orderBy(F.col("degree").desc(), F.col("betweenness").desc(), "id").limit(limit)


def community_categories(edges: DataFrame, labels: DataFrame, evidence: DataFrame, group: str, category: str) -> DataFrame:
    """Distinct categories of the shared groups inside each community (evidence: a, b, group, category)."""
    # an edge has as much evidence as weight
    n = int(edges.agg(F.sum("weight")).first()[0] or 0)
    at_a = dealt(evidence, n, "a").join(labels.select(F.col("id").alias("a"), "community"), "a")
    inner = dealt(at_a, n, "b").join(labels.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b").where(F.col("community") == F.col("cb"))
    return inner.select("community", category).distinct().groupBy("community").agg(F.array_sort(F.collect_list(category)).alias("categories"))


def graph_summary(edges: DataFrame, labels: DataFrame) -> DataFrame:
    sizes = labels.groupBy("community").agg(F.count("*").alias("s")).agg(
        F.count("*").alias("communities"), F.max("s").alias("largest"), F.sum("s").alias("nodes")
    )
    n_edges = edges.agg(F.count("*").alias("n")).scalar()
    return sizes.withColumn("edges", n_edges).withColumn("mean_degree", F.round(F.try_divide(F.col("edges") * 2.0, F.col("nodes")), 2))


def repeat_entities(rollup: DataFrame, key: str, people: DataFrame, edges: DataFrame, min_cases: int = 2, limit: int | None = None) -> DataFrame:
    """Entities with at least ``min_cases``, most cases first, with name and degree."""
    top = rollup.where(F.col("n_cases") >= min_cases)
    top = top.orderBy(F.col("n_cases").desc(), key).limit(limit) if limit else top
    return (
        top.join(people, key).join(degrees(edges).select(F.col("id").alias(key), "degree"), key, "left")
        .withColumn("degree", F.coalesce("degree", F.lit(0)))
    )


def associates(edges: DataFrame, n: int = 10) -> DataFrame:
    """(id, rank, other, weight): the strongest ``n`` neighbours of every node."""
    return top_per_group(both_ways(edges, "weight"), ["id"], [F.col("weight").desc(), F.col("other")], n, "rank")
