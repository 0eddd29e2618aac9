"""Graph and spatial operators on the driver's tables.

The graph: parts ordered together at least twice.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave.operators import graph as gr
from caseweave.operators.aggregates import counts_text, entity_rollup, transaction_edges
from caseweave.operators.linkage import resolve_greedy
from caseweave.operators.scale import dealt
from caseweave.operators.spatial import density_clusters, hotspot_profiles
from caseweave.plans.base import memberships, part_graph, table, transactions
from caseweave.plans.registry import cte, query
from caseweave.plans.strings import HAVERSINE_SQL, customer_points
from caseweave.plans.summaries import part_appearances
from caseweave.session import materialise


def graph_edges(spark, sf):
    return materialise(part_graph(spark, sf), "edges")


@query("gr1_cooccurrence_graph", "SELECT a, b, weight FROM edges", ("edges",))
def _(spark, sf):
    return part_graph(spark, sf)


@query("gr2_degrees", "SELECT id, COUNT(*) AS degree, CAST(SUM(weight) AS BIGINT) AS weighted_degree FROM arcs GROUP BY id", ("arcs",))
def _(spark, sf):
    return gr.degrees(part_graph(spark, sf))


@query("gr3_graph_view", """SELECT n.id, n.degree, e.n_edges FROM (SELECT id, COUNT(*) AS degree FROM arcs GROUP BY id) n JOIN part ON p_partkey = n.id AND contains(lower(p_brand), '#1'),
    (SELECT COUNT(*) AS n_edges FROM edges JOIN part x ON x.p_partkey = a AND contains(lower(x.p_brand), '#1') JOIN part y ON y.p_partkey = b AND contains(lower(y.p_brand), '#1')) e""", ("arcs",))
def _(spark, sf):
    nodes, edges = gr.graph_view(graph_edges(spark, sf), table(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey", "p_brand", "#1", 2, None)
    return nodes.select("id", "degree", edges.agg(F.count("*").alias("n")).scalar().alias("n_edges"))


# seeds: the first part of each brand that has edges; paths: from every 50th part to the last part of its type
cte("brand_ends", "SELECT p_brand, MIN(p_partkey) AS lo, MAX(p_partkey) AS hi FROM part JOIN (SELECT DISTINCT id FROM arcs) ON id = p_partkey GROUP BY p_brand", "arcs")


cte("type_ends", "SELECT p_partkey AS lo, hi FROM part JOIN (SELECT DISTINCT id FROM arcs) ON id = p_partkey JOIN (SELECT p_type, MAX(p_partkey) AS hi FROM part JOIN (SELECT DISTINCT id FROM arcs) ON id = p_partkey GROUP BY p_type) USING (p_type) WHERE p_partkey % 50 = 0", "arcs")


def asked_paths(spark, sf, edges):
    """Every part with a key divisible by 50 to the last part of its type; both have edges."""
    parts = table(spark, sf, "part").join(gr.node_set(edges), F.col("p_partkey") == F.col("id")).select("p_partkey", "p_type")
    last = parts.groupBy("p_type").agg(F.max("p_partkey").alias("target"))
    return parts.where(F.col("p_partkey") % 50 == 0).join(last, "p_type").select(F.col("p_partkey").alias("source"), "target")


def ends_by(spark, sf, edges, kind):
    return table(spark, sf, "part").join(gr.node_set(edges), F.col("p_partkey") == F.col("id")).groupBy(kind).agg(
        F.min("p_partkey").alias("lo"), F.max("p_partkey").alias("hi")
    )


_EGO = """ego(seed, id, hops) AS (SELECT DISTINCT lo, lo, 0 FROM brand_ends UNION SELECT seed, other, hops + 1 FROM ego JOIN arcs USING (id) WHERE hops < 3)"""


@query("gr4_ego_nodes", "SELECT seed, id, MIN(hops) AS hops FROM ego GROUP BY ALL", ("brand_ends",), _EGO)
def _(spark, sf):
    edges = graph_edges(spark, sf)
    return gr.ego_nodes(edges, ends_by(spark, sf, edges, "p_brand").select(F.col("lo").alias("id")), 3)


@query("gr4_ego_edges", "SELECT DISTINCT x.seed, a, b, weight FROM edges JOIN ego x ON x.id = a JOIN ego y ON y.id = b AND y.seed = x.seed", ("brand_ends", "edges"), _EGO)
def _(spark, sf):
    edges = graph_edges(spark, sf)
    members = materialise(gr.ego_nodes(edges, ends_by(spark, sf, edges, "p_brand").select(F.col("lo").alias("id")), 3), "ego")
    return gr.ego_edges(edges, members)


# communities are computed and written once per session and state of the table's files
_COMMUNITIES: dict[tuple, tuple] = {}


def communities_of(spark, sf):
    files = table(spark, sf, "lineitem").select("_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").cast("string").alias("at")).distinct()
    key = (spark.sparkContext.applicationId, sf, files.agg(F.count("*"), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first())
    if key not in _COMMUNITIES:
        edges = graph_edges(spark, sf)
        _COMMUNITIES[key] = edges, materialise(gr.communities(edges), "communities")
    return _COMMUNITIES[key]


@query("gr5_communities")
def _(spark, sf):
    edges, labels = communities_of(spark, sf)
    return gr.community_summary(edges, labels, 3)


@query("gr5_partition", "SELECT (SELECT COUNT(DISTINCT id) FROM arcs) AS nodes, (SELECT CAST(SUM(weight) AS BIGINT) FROM edges) AS weight, CAST(0 AS BIGINT) AS in_several, CAST(0 AS BIGINT) AS in_pieces, TRUE AS better_than_single_nodes, TRUE AS sums_agree", ("arcs", "edges"))
def _(spark, sf):
    # what holds of any good partition: all nodes once, all weight, every community in one piece
    return gr.partition_check(*communities_of(spark, sf))


@query("gr5_community_categories")
def _(spark, sf):
    edges, labels = communities_of(spark, sf)
    groups = table(spark, sf, "orders").select(F.col("o_orderkey").alias("grp"), F.col("o_orderpriority").alias("category"))
    evidence = gr.edge_evidence(edges, memberships(spark, sf), "grp", "item").join(dealt(groups, groups.count(), "grp"), "grp")
    found = gr.community_categories(edges, labels, evidence, "grp", "category")
    return found.select("community", F.array_join("categories", "|").alias("categories"))


@query("ag25_graph_summary")
def _(spark, sf):
    return gr.graph_summary(*communities_of(spark, sf))


# exact betweenness: shortest paths counted level by level from every node, dependencies back the same way
_BRANDES = """sig(s, id, dist, sigma) USING KEY (s, id) AS (SELECT id, id, 0, CAST(1 AS DOUBLE) FROM dots
  UNION SELECT b.s, x.other, b.dist + 1, SUM(b.sigma) FROM sig b JOIN arcs x ON x.id = b.id LEFT JOIN recurring.sig r ON r.s = b.s AND r.id = x.other WHERE r.id IS NULL GROUP BY b.s, x.other, b.dist),
counted AS MATERIALIZED (SELECT * FROM sig),
back(s, id, dist, sigma, delta) AS (SELECT s, id, dist, sigma, CAST(0 AS DOUBLE) FROM counted WHERE dist = (SELECT MAX(dist) FROM counted)
  UNION ALL SELECT u.s, u.id, u.dist, u.sigma, u.sigma * COALESCE(d.share, 0) FROM (SELECT * FROM counted WHERE dist = (SELECT MIN(dist) FROM back) - 1) u
    LEFT JOIN (SELECT b.s, x.other AS id, SUM((1 + b.delta) / b.sigma) AS share FROM back b JOIN arcs x ON x.id = b.id GROUP BY b.s, x.other) d ON d.s = u.s AND d.id = u.id),
between_(id, score) AS (SELECT id, SUM(delta) FILTER (s <> id) / ((SELECT COUNT(*) FROM dots) - 1) / ((SELECT COUNT(*) FROM dots) - 2) FROM back GROUP BY id)"""
cte("dots", "SELECT DISTINCT id FROM arcs", "arcs")
cte("line_rollup", """SELECT l_partkey AS id, COUNT(*) AS n_cases, CASE WHEN COUNT(*) >= 3 OR (COUNT(*) >= 2 AND bool_or(l_quantity > 49)) THEN 'HIGH'
      WHEN COUNT(*) >= 2 OR bool_or(l_quantity > 49) THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier FROM lineitem GROUP BY l_partkey""")


def hubs(spark, sf, edges, centrality):
    rollup = entity_rollup(table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "id"), "id", "l_linestatus", F.col("l_quantity") > 49)
    people = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name")
    return gr.hub_listing(edges, centrality, people, "id", rollup, 20)


@query("gr6_hubs", """SELECT d.id, p_name, risk_tier, n_cases, degree, ROUND(score, 6) AS betweenness FROM (SELECT id, COUNT(*) AS degree FROM arcs GROUP BY id) d JOIN part ON p_partkey = d.id
    JOIN between_ b ON b.id = d.id JOIN line_rollup r ON r.id = d.id ORDER BY degree DESC, score DESC, d.id LIMIT 20""", ("arcs", "dots", "line_rollup"), _BRANDES)
def _(spark, sf):
    edges = graph_edges(spark, sf)
    return hubs(spark, sf, edges, gr.betweenness(edges)).select("id", "p_name", "risk_tier", "n_cases", "degree", F.round("betweenness", 6).alias("betweenness"))


@query("gr6_hubs_sampled")
def _(spark, sf):
    edges = graph_edges(spark, sf)
    return hubs(spark, sf, edges, gr.betweenness_sample(edges, error=0.2))


_BFS = """bfs(target, id, dist) USING KEY (target, id) AS (SELECT DISTINCT hi, hi, 0 FROM type_ends
  UNION SELECT b.target, x.other, MIN(b.dist + 1) FROM bfs b JOIN arcs x ON x.id = b.id LEFT JOIN recurring.bfs r ON r.target = b.target AND r.id = x.other WHERE r.id IS NULL GROUP BY b.target, x.other),
dists AS (SELECT target, id, MIN(dist) AS dist FROM bfs GROUP BY ALL),
step AS (SELECT d.target, d.id, d.dist, MIN(n.id) AS onward FROM dists d JOIN arcs x ON x.id = d.id JOIN dists n ON n.target = d.target AND n.id = x.other AND n.dist = d.dist - 1 GROUP BY ALL),
walk(source, target, pos, path) AS (SELECT lo, hi, lo, CAST(lo AS VARCHAR) FROM type_ends JOIN dists ON target = hi AND id = lo
  UNION ALL SELECT source, w.target, onward, path || '>' || onward FROM walk w JOIN step s ON s.target = w.target AND s.id = w.pos)"""


@query("gr7_shortest_paths", """SELECT lo AS source, hi AS target, dist AS hops, path FROM type_ends LEFT JOIN dists ON dists.target = hi AND id = lo LEFT JOIN (SELECT source, target, path FROM walk WHERE pos = target) w ON w.source = lo AND w.target = hi""",
       ("type_ends",), _BFS)
def _(spark, sf):
    edges = graph_edges(spark, sf)
    answers, nodes = gr.shortest_paths(materialise(gr.both_ways(edges), "arcs"), asked_paths(spark, sf, edges))
    return answers.join(gr.path_texts(nodes), ["source", "target"], "left").select("source", "target", "hops", "path")


@query("gr7_path_hops", """SELECT w.source, w.target, CAST(hop AS INT) AS hop, CAST(p[hop + 1] AS BIGINT) AS from_id, CAST(p[hop + 2] AS BIGINT) AS to_id, weight
    FROM (SELECT source, target, string_split(path, '>') AS p, unnest(range(len(string_split(path, '>')) - 1)) AS hop FROM walk WHERE pos = target) w
    JOIN edges ON a = least(CAST(p[hop + 1] AS BIGINT), CAST(p[hop + 2] AS BIGINT)) AND b = greatest(CAST(p[hop + 1] AS BIGINT), CAST(p[hop + 2] AS BIGINT))""", ("type_ends", "edges"), _BFS)
def _(spark, sf):
    edges = graph_edges(spark, sf)
    hops = gr.path_hops(gr.shortest_paths(materialise(gr.both_ways(edges), "arcs"), asked_paths(spark, sf, edges))[1])
    joined = hops.withColumns({"a": F.least("from_id", "to_id"), "b": F.greatest("from_id", "to_id")}).join(edges, ["a", "b"])
    return joined.select("source", "target", "hop", "from_id", "to_id", "weight")


# directed graph: payments of at least three transactions, supplier to supplier or customer
cte("pay", "SELECT from_id AS id, to_id AS other FROM tx GROUP BY ALL HAVING COUNT(*) >= 3", "tx")
cte("pay_ends", "SELECT (SELECT MIN(id) FROM pay) AS source, other AS target FROM pay GROUP BY other", "pay")


@query("gr8_directed_paths", """SELECT source, target, dist AS hops FROM pay_ends LEFT JOIN (SELECT id, MIN(dist) AS dist FROM fwd GROUP BY id) ON id = target""", ("pay_ends",),
       "fwd(id, dist) AS (SELECT MIN(id), 0 FROM pay UNION SELECT other, dist + 1 FROM fwd JOIN pay USING (id) WHERE dist < 40)")
def _(spark, sf):
    strong = transaction_edges(transactions(spark, sf)).where(F.col("txn_count") >= 3)
    arcs = materialise(strong.select(F.col("from_id").alias("id"), F.col("to_id").alias("other")), "arcs")
    first = arcs.agg(F.min("id").alias("v")).scalar()
    pairs = arcs.select("other").distinct().select(first.alias("source"), F.col("other").alias("target"))
    return gr.shortest_paths(arcs, pairs)[0].select("source", "target", "hops")


@query("gr9_vertex_profiles", """SELECT p_partkey AS id, p_name, COALESCE(roles, '') AS roles, COALESCE(n_cases, 0) AS n_cases, risk_tier, COALESCE(degree, 0) AS degree FROM part
    LEFT JOIN (SELECT l_partkey, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS roles, COUNT(*) AS n_cases, CASE WHEN COUNT(*) >= 3 OR (COUNT(*) >= 2 AND bool_or(l_quantity > 49)) THEN 'HIGH'
      WHEN COUNT(*) >= 2 OR bool_or(l_quantity > 49) THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey
    LEFT JOIN (SELECT id, COUNT(*) AS degree FROM arcs GROUP BY id) d ON d.id = p_partkey""", ("arcs",))
def _(spark, sf):
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "id")
    people = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name")
    rollup = entity_rollup(lines, "id", "l_linestatus", F.col("l_quantity") > 49)
    profiles = gr.vertex_profiles(people, "id", lines.select("id", F.col("l_returnflag").alias("role")), rollup, part_graph(spark, sf))
    return profiles.withColumn("roles", F.array_join("roles", "|"))


# first come, first served: one unit a step, with the founders so far
cte("arrivals", """SELECT p_type || '|' || p_brand AS block, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS norm, p_size AS y, MIN(p_partkey) AS unit FROM part GROUP BY ALL""")
cte("waits", """SELECT v.unit, row_number() OVER (ORDER BY v.unit) AS n, (SELECT list(u.unit) FROM arrivals u WHERE u.block = v.block AND u.unit < v.unit AND abs(u.y - v.y) <= 3
      AND 1 - levenshtein(u.norm, v.norm) / greatest(length(u.norm), length(v.norm)) >= 0.82) AS before FROM arrivals v""", "arrivals")
_GREEDY = """greedy(n, founders, owner) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT)
  UNION ALL SELECT w.n, CASE WHEN list_has_any(founders, COALESCE(before, [])) THEN founders ELSE list_append(founders, unit) END,
    CASE WHEN list_has_any(founders, COALESCE(before, [])) THEN list_min(list_intersect(founders, before)) ELSE unit END FROM greedy g JOIN waits w ON w.n = g.n + 1)"""


@query("jn13_entity_greedy", """SELECT p_partkey AS appearance_id, p_type || '|' || p_brand AS block, p_name AS name, p_size AS birth_year, 'ACC-' || lpad(CAST(place AS VARCHAR), 6, '0') AS entity_id
    FROM part JOIN arrivals a ON a.block = p_type || '|' || p_brand AND a.norm = trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AND a.y = p_size JOIN waits w ON w.unit = a.unit JOIN greedy g ON g.n = w.n
    JOIN (SELECT owner, row_number() OVER (ORDER BY owner) AS place FROM greedy WHERE owner IS NOT NULL GROUP BY owner) f ON f.owner = g.owner""", ("arrivals", "waits"), _GREEDY)
def _(spark, sf):
    return resolve_greedy(part_appearances(spark, sf)).select("appearance_id", "block", "name", "birth_year", "entity_id")


# ---- spatial ---------------------------------------------------------------

EPS_KM, MIN_POINTS = 25.0, 5
cte("pts", "SELECT lat, lon, COUNT(*) AS w FROM located GROUP BY ALL", "located")
_NEAR = HAVERSINE_SQL.format(a="x.lat", b="y.lat", c="x.lon", d="y.lon") + f" <= {EPS_KM}"
cte("near", f"SELECT x.lat AS lat, x.lon AS lon, y.lat AS olat, y.lon AS olon, y.w FROM pts x JOIN pts y ON abs(x.lat - y.lat) < 1 AND abs(x.lon - y.lon) < 1 AND {_NEAR}", "pts")
cte("core", f"SELECT lat, lon FROM near GROUP BY ALL HAVING SUM(w) >= {MIN_POINTS}", "near")
cte("core_near", "SELECT n.lat, n.lon, n.olat, n.olon FROM near n JOIN core c ON c.lat = n.lat AND c.lon = n.lon JOIN core d ON d.lat = n.olat AND d.lon = n.olon", "near", "core")
_CLUSTERS = """grow(lat, lon, rlat, rlon) AS (SELECT lat, lon, lat, lon FROM core UNION SELECT n.olat, n.olon, rlat, rlon FROM grow g JOIN core_near n ON n.lat = g.lat AND n.lon = g.lon),
labels AS (SELECT lat, lon, MIN(ROW(rlat, rlon)) AS cluster FROM grow GROUP BY ALL),
assigned AS (SELECT p.lat, p.lon, p.w, COALESCE(l.cluster, (SELECT MIN(m.cluster) FROM near n JOIN labels m ON m.lat = n.olat AND m.lon = n.olon WHERE n.lat = p.lat AND n.lon = p.lon)) AS cluster, l.lat IS NOT NULL AS is_core
  FROM pts p LEFT JOIN labels l ON l.lat = p.lat AND l.lon = p.lon)"""


@query("sp1_density_clusters", "SELECT lat, lon, w AS weight, is_core, ROUND(cluster[1], 1) AS cluster_lat, ROUND(cluster[2], 1) AS cluster_lon FROM assigned", ("core_near",), _CLUSTERS)
def _(spark, sf):
    labels = density_clusters(customer_points(spark, sf), EPS_KM, MIN_POINTS)
    return labels.select("lat", "lon", "weight", "is_core", F.col("cluster.lat").alias("cluster_lat"), F.col("cluster.lon").alias("cluster_lon"))


@query("sp1_hotspot_profiles", """SELECT cluster[1] AS cluster_lat, cluster[2] AS cluster_lon, COUNT(*) AS point_count, ROUND(AVG(l.lat), 5) AS centroid_lat, ROUND(AVG(l.lon), 5) AS centroid_lon,
    (SELECT string_agg(s || '=' || n, '|' ORDER BY s) FROM (SELECT c_mktsegment AS s, COUNT(*) AS n FROM assigned b JOIN located q ON q.lat = b.lat AND q.lon = b.lon JOIN customer k ON k.c_custkey = q.c_custkey WHERE b.cluster = a.cluster GROUP BY 1)) AS counts
    FROM assigned a JOIN located l ON l.lat = a.lat AND l.lon = a.lon WHERE cluster IS NOT NULL GROUP BY cluster""", ("core_near", "located"), _CLUSTERS)
def _(spark, sf):
    points = customer_points(spark, sf)
    labels = density_clusters(points, EPS_KM, MIN_POINTS)
    profiles, _ = hotspot_profiles(points, labels, "c_nationkey", "c_mktsegment", "c_custkey")
    return profiles.select(
        F.col("cluster.lat").alias("cluster_lat"), F.col("cluster.lon").alias("cluster_lon"), "point_count", "centroid_lat", "centroid_lon",
        counts_text(F.col("counts")).alias("counts"),
    )


@query("sp1_noise", "SELECT CAST(SUM(w) AS BIGINT) AS total_points, CAST(COALESCE(SUM(w) FILTER (cluster IS NULL), 0) AS BIGINT) AS noise_points FROM assigned", ("core_near",), _CLUSTERS)
def _(spark, sf):
    points = customer_points(spark, sf)
    return hotspot_profiles(points, density_clusters(points, EPS_KM, MIN_POINTS), "c_nationkey", "c_mktsegment", "c_custkey")[1]
