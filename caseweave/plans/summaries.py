"""Aggregations, rankings and top-k listings on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave.operators import aggregates as ag
from caseweave.operators import graph as gr
from caseweave.operators.filters import require_allowed
from caseweave.operators.linkage import match_names, match_summary, resolution_summary, resolve_components
from caseweave.operators.learning import bucket_rare, top_categories
from caseweave.operators.risk import apply_rules, rule_thresholds, suspicious_edges
from caseweave.operators.scale import exact_quantiles
from caseweave.plans.base import PROPERTY, UNRESOLVED, VIOLENT, cases, memberships, part_graph, table, transactions, year_span, yearly_series
from caseweave.plans.registry import cte, query
from caseweave.session import materialise


@query("ag1_dataset_summary", """SELECT COUNT(*) AS total_cases, MIN(case_date) AS date_start, MAX(case_date) AS date_end, COUNT(DISTINCT place) AS distinct_places,
    COUNT(DISTINCT category) AS distinct_categories, (SELECT string_agg(category || '=' || n, '|' ORDER BY category) FROM (SELECT category, COUNT(*) AS n FROM cases GROUP BY category)) AS category_counts FROM cases""", ("cases",))
def _(spark, sf):
    df = ag.dataset_summary(cases(spark, sf), "case_date", "place", "category")
    return df.withColumn("category_counts", ag.counts_text(F.col("category_counts")))


@query("ag2_value_counts", """SELECT place, string_agg(category || '=' || n, '|' ORDER BY category) AS counts FROM (SELECT place, category, COUNT(*) AS n FROM cases GROUP BY ALL) GROUP BY place""", ("cases",))
def _(spark, sf):
    return ag.value_counts(cases(spark, sf), ["place"], "category").select("place", ag.counts_text(F.col("counts")).alias("counts"))


cte("profiles", """SELECT super_place, place, COUNT(*) AS total_cases, AVG(CAST(category IN ('1-URGENT','2-HIGH') AS DOUBLE)) AS violent_ratio,
    AVG(CAST(category IN ('2-HIGH','3-MEDIUM') AS DOUBLE)) AS property_ratio, AVG(CAST(status IN ('O','P') AS DOUBLE)) AS unresolved_ratio,
    COALESCE(AVG(amount), 0) AS avg_value FROM cases GROUP BY super_place, place HAVING COUNT(*) >= 10""", "cases")


@query("ag3_group_profile", """SELECT super_place, place, total_cases, ROUND(violent_ratio, 6) AS violent_ratio, ROUND(property_ratio, 6) AS property_ratio,
    ROUND(unresolved_ratio, 6) AS unresolved_ratio, ROUND(avg_value, 2) AS avg_value FROM profiles""", ("profiles",))
def _(spark, sf):
    p = ag.group_profile(cases(spark, sf), ["super_place", "place"], "category", "status", "amount", VIOLENT, PROPERTY, UNRESOLVED, 10)
    return p.select("super_place", "place", "total_cases", *[F.round(c, 6).alias(c) for c in ("violent_ratio", "property_ratio", "unresolved_ratio")],
                    F.round("avg_value", 2).alias("avg_value"))


@query("ag4_entropy", """SELECT entity_id, ROUND(CASE WHEN COUNT(*) <= 1 THEN 0 ELSE -SUM(p * ln(p)) / ln(COUNT(*)) END, 6) AS diversity
    FROM (SELECT entity_id, category, n / SUM(n) OVER (PARTITION BY entity_id) AS p FROM (SELECT entity_id, category, COUNT(*) AS n FROM cases GROUP BY ALL)) GROUP BY entity_id""", ("cases",))
def _(spark, sf):
    return ag.entropy(cases(spark, sf), ["entity_id"], "category").select("entity_id", F.round("diversity", 6).alias("diversity"))


@query("ag5_mode", """SELECT entity_id, category AS top_category FROM (SELECT entity_id, category, COUNT(*) AS n FROM cases GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, category) = 1""", ("cases",))
def _(spark, sf):
    return ag.modal_value(cases(spark, sf), ["entity_id"], "category", "top_category")


@query("ag6_first_ids", """SELECT place, string_agg(case_id, '|' ORDER BY case_id) AS sample_ids FROM (SELECT place, case_id FROM cases
    QUALIFY row_number() OVER (PARTITION BY place ORDER BY case_id) <= 5) GROUP BY place""", ("cases",))
def _(spark, sf):
    return ag.first_ids(cases(spark, sf), ["place"], "case_id").select("place", F.array_join(F.col("sample_ids").cast("array<string>"), "|").alias("sample_ids"))


@query("ag7_boolean_means", "SELECT place, ROUND(AVG(CAST(status = 'F' AS DOUBLE)), 6) AS closed_ratio FROM cases GROUP BY place", ("cases",))
def _(spark, sf):
    return cases(spark, sf).groupBy("place").agg(F.round(F.avg((F.col("status") == "F").cast("double")), 6).alias("closed_ratio"))


@query("ag8_account_features", """SELECT account_id, ROUND(out_amount, 2) AS out_amount, out_count, out_degree, max_out_txn, out_label_count, ROUND(in_amount, 2) AS in_amount,
    in_count, in_degree, max_in_txn, in_label_count, max_single_txn, label_count, is_labelled FROM feats""", ("feats",))
def _(spark, sf):
    f = ag.account_features(transactions(spark, sf)).drop("distinct_currencies")
    return f.withColumn("out_amount", F.round("out_amount", 2)).withColumn("in_amount", F.round("in_amount", 2))


@query("ag9_distinct_currencies", "SELECT account_id, distinct_currencies FROM feats", ("feats",))
def _(spark, sf):
    pairs = ag.transaction_sides(transactions(spark, sf)).select("account_id", "currency").distinct()
    return pairs.groupBy("account_id").agg(F.count("*").alias("distinct_currencies"))


@query("ag10_transaction_edges", """SELECT from_id, to_id, COUNT(*) AS txn_count, ROUND(SUM(amount_paid), 2) AS total_paid, CAST(SUM(label) AS BIGINT) AS label_count FROM tx GROUP BY ALL""", ("tx",))
def _(spark, sf):
    return ag.transaction_edges(transactions(spark, sf)).withColumn("total_paid", F.round("total_paid", 2))


@query("ag11_cooccurrence_evidence", """SELECT a, b, grp FROM edges JOIN members x ON x.item = a JOIN members y ON y.item = b AND y.grp = x.grp""".replace("SELECT a, b, grp", "SELECT a, b, x.grp AS grp"), ("edges",))
def _(spark, sf):
    edges = materialise(part_graph(spark, sf), "edges")
    return gr.edge_evidence(edges, memberships(spark, sf), "grp", "item")


@query("ag12_highest_tier", """SELECT l_orderkey AS case_id, MAX(CASE p_type WHEN 'SMALL' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LARGE' THEN 2 ELSE 0 END) AS risk_points,
    CASE MAX(CASE p_type WHEN 'SMALL' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LARGE' THEN 2 ELSE 0 END) WHEN 2 THEN 'LARGE' WHEN 1 THEN 'MEDIUM' ELSE 'SMALL' END AS highest_tier
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey""")
def _(spark, sf):
    links = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("case_id"), "p_type")
    return ag.highest_tier(links, ["case_id"], "p_type", ("SMALL", "MEDIUM", "LARGE"))


cte("rollup", """SELECT entity_id, COUNT(*) AS n_cases, string_agg(DISTINCT category, '|' ORDER BY category) AS categories, bool_or(amount > 490000) AS any_flag,
    CASE WHEN COUNT(*) >= 3 OR (COUNT(*) >= 2 AND bool_or(amount > 490000)) THEN 'HIGH' WHEN COUNT(*) >= 2 OR bool_or(amount > 490000) THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier
    FROM cases GROUP BY entity_id""", "cases")


@query("ag13_entity_rollup", "SELECT * FROM rollup", ("rollup",))
def _(spark, sf):
    return ag.entity_rollup(cases(spark, sf), "entity_id", "category", F.col("amount") > 490_000).withColumn("categories", F.array_join("categories", "|"))


@query("ag14_exact_percentiles", """SELECT CAST(p AS DOUBLE) AS p, ROUND(quantile_cont(l_extendedprice, 0.5), 4) AS x50, ROUND(quantile_cont(l_extendedprice, 0.98), 4) AS x98,
    ROUND(quantile_cont(l_extendedprice, 0.99), 4) AS x99 FROM lineitem, (SELECT 1 AS p) GROUP BY p""")
def _(spark, sf):
    # a small limit here, so that the bracketing passes run on every scale
    q = exact_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", [0.5, 0.98, 0.99])
    return spark.range(1).select(F.lit(1.0).alias("p"), *[F.round(F.lit(v), 4).alias(n) for v, n in zip(q, ("x50", "x98", "x99"))])


@query("ag15_precision_recall", """SELECT 'size' AS rule, COUNT(*) FILTER (l_quantity >= 40) AS flagged, COUNT(*) FILTER (l_quantity >= 40 AND l_returnflag = 'R') AS tp,
    COUNT(*) FILTER (l_quantity >= 40 AND l_returnflag <> 'R') AS fp, COUNT(*) FILTER (l_quantity < 40 AND l_returnflag = 'R') AS fn,
    ROUND(tp / flagged, 4) AS "precision", ROUND(tp / (tp + fn), 4) AS recall, ROUND(2.0 * (tp / flagged) * (tp / (tp + fn)) / (tp / flagged + tp / (tp + fn)), 4) AS f1 FROM lineitem""")
def _(spark, sf):
    return ag.precision_recall(table(spark, sf, "lineitem"), F.col("l_quantity") >= 40, F.col("l_returnflag") == "R", "size")


@query("ag16_column_mix", """SELECT label, ROUND(v / SUM(v) OVER (), 6) AS weight FROM (SELECT 'URGENT' AS label, SUM(n_0) AS v FROM yearly WHERE t = (SELECT last FROM span)
    UNION ALL SELECT 'HIGH', SUM(n_1) FROM yearly WHERE t = (SELECT last FROM span) UNION ALL SELECT 'MEDIUM', SUM(n_2) FROM yearly WHERE t = (SELECT last FROM span))""", ("span",))
def _(spark, sf):
    mix = ag.column_mix(yearly_series(spark, sf).where(F.col("t") == year_span(spark, sf)[1]), {"n_0": "URGENT", "n_1": "HIGH", "n_2": "MEDIUM"})
    return mix.withColumn("weight", F.round("weight", 6))


@query("ag17_group_weights", "SELECT super_place, place, CAST(SUM(n_total) AS BIGINT) AS total, ROUND(SUM(n_total) / SUM(SUM(n_total)) OVER (), 8) AS weight FROM yearly WHERE t = (SELECT last FROM span) GROUP BY ALL", ("span",))
def _(spark, sf):
    return ag.group_weights(yearly_series(spark, sf).where(F.col("t") == year_span(spark, sf)[1]), ["super_place", "place"], "n_total").withColumn("weight", F.round("weight", 8))


@query("ag18_scaled_mix", """SELECT 'STRANGER' AS label, ROUND(0.25, 4) AS weight UNION ALL SELECT label, ROUND(0.75 * v / SUM(v) OVER (), 4) FROM (SELECT 'NEIGHBOR' AS label, SUM(n_0) AS v FROM yearly
    UNION ALL SELECT 'ACQUAINTANCE', SUM(n_1) FROM yearly UNION ALL SELECT 'RELATIVE', SUM(n_2) FROM yearly)""".replace("ROUND(0.25, 4)", "CAST(0.25 AS DOUBLE)"), ("yearly",))
def _(spark, sf):
    mix = ag.column_mix(yearly_series(spark, sf), {"n_0": "NEIGHBOR", "n_1": "ACQUAINTANCE", "n_2": "RELATIVE"}, scale=0.75, rest="STRANGER")
    return mix.withColumn("weight", F.round("weight", 4))


INDICATORS = ["wealth", "supplier_wealth", "suppliers"]
METRICS = ["cases_per_entity", "violent_ratio", "avg_value"]
cte("places_wide", """SELECT place, super_place, n_entities, wealth, supplier_wealth, suppliers, n_cases / n_entities AS cases_per_entity, violent_ratio, avg_value FROM places
    JOIN (SELECT c_nationkey, COUNT(*) AS n_entities, AVG(c_acctbal) AS wealth FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey
    JOIN (SELECT s_nationkey, COUNT(*) AS suppliers, AVG(s_acctbal) AS supplier_wealth FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey
    JOIN (SELECT place AS p2, COUNT(*) AS n_cases, AVG(CAST(category IN ('1-URGENT','2-HIGH') AS DOUBLE)) AS violent_ratio, AVG(amount) AS avg_value FROM cases GROUP BY 1) o ON p2 = place""", "cases")


def place_indicators(spark, sf):
    from caseweave.plans.base import places

    customer = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_entities"), F.avg("c_acctbal").alias("wealth"))
    supplier = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"), F.avg("s_acctbal").alias("supplier_wealth"))
    volume = cases(spark, sf).groupBy("place").agg(
        F.count("*").alias("n_cases"), F.avg(F.col("category").isin(VIOLENT).cast("double")).alias("violent_ratio"), F.avg("amount").alias("avg_value")
    )
    joined = places(spark, sf).join(customer, "n_nationkey").join(supplier, "n_nationkey").join(volume, "place")
    return joined.withColumn("cases_per_entity", F.col("n_cases") / F.col("n_entities")).select(
        "place", "super_place", "n_entities", *INDICATORS, *METRICS
    )


_GRID = " UNION ALL ".join(
    f"SELECT '{i}' AS indicator, '{m}' AS metric, CASE WHEN stddev_pop({m}) > 0 AND stddev_pop({i}) > 0 THEN ROUND(corr({m}, {i}), 4) END AS r, COUNT(*) AS n FROM places_wide" for i in INDICATORS for m in METRICS
)


@query("ag19_correlation_grid", f"SELECT * FROM ({_GRID}) WHERE n >= 10", ("places_wide",))
def _(spark, sf):
    grid = ag.correlation_grid(place_indicators(spark, sf), INDICATORS, METRICS, INDICATORS, METRICS)
    return grid.select("indicator", "metric", F.round("r", 4).alias("r"), "n")


@query("ag19_correlation_tests")
def _(spark, sf):
    grid = ag.correlation_grid(place_indicators(spark, sf), INDICATORS, METRICS, INDICATORS, METRICS)
    return grid.select("indicator", "metric", F.round("r", 4).alias("r"), F.round("p", 6).alias("p"), "n", "interpretation")


@query("ag20_rank_agreement", """SELECT ROUND(corr(rx, ry), 6) AS spearman, COUNT(*) AS n FROM (SELECT row_number() OVER (ORDER BY x DESC, feature) AS rx, row_number() OVER (ORDER BY y DESC, feature) AS ry
    FROM (SELECT p_brand AS feature, ROUND(SUM(l_quantity), 2) AS x, COUNT(DISTINCT l_orderkey) AS y FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1))""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    f = lines.groupBy(F.col("p_brand").alias("feature")).agg(F.round(F.sum("l_quantity"), 2).alias("x"), F.count_distinct("l_orderkey").alias("y"))
    return ag.rank_agreement(f, F.col("x"), F.col("y")).select(F.round("spearman", 6).alias("spearman"), "n")


@query("ag21_mean_absolute", """SELECT 'c_acctbal' AS feature, ROUND(AVG(ABS(c_acctbal)), 4) AS importance FROM customer UNION ALL SELECT 'c_nationkey', ROUND(AVG(ABS(c_nationkey)), 4) FROM customer""")
def _(spark, sf):
    return ag.mean_absolute(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"]).withColumn("importance", F.round("importance", 4))


cte("name_left", """SELECT p_partkey AS left_id, p_type AS block, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || 's' WHEN 2 THEN p_name || ' ' || p_size ELSE replace(p_name, 'e', 'a') END AS name FROM part""")
cte("name_right", "SELECT p_partkey AS right_id, p_type AS block, p_name AS name FROM part")


def name_sides(spark, sf):
    part = table(spark, sf, "part")
    variant = (
        F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).when(F.col("p_partkey") % 4 == 1, F.concat("p_name", F.lit("s")))
        .when(F.col("p_partkey") % 4 == 2, F.concat_ws(" ", "p_name", "p_size")).otherwise(F.replace(F.col("p_name"), F.lit("e"), F.lit("a")))
    )
    left = part.select(F.col("p_partkey").alias("left_id"), F.col("p_type").alias("block"), variant.alias("name"))
    right = part.select(F.col("p_partkey").alias("right_id"), F.col("p_type").alias("block"), F.col("p_name").alias("name"))
    return left, right


cte("targets", "SELECT block, name, COUNT(*) AS copies, MIN(right_id) AS right_id FROM name_right GROUP BY ALL", "name_right")
cte("matched", """SELECT left_id, l.block, l.name, right_id, t.name AS right_name, 'EXACT' AS match_type, CAST(1.0 AS DOUBLE) AS score FROM name_left l JOIN targets t ON l.block = t.block AND l.name = t.name AND copies = 1
    UNION ALL SELECT * FROM (SELECT left_id, l.block, l.name, right_id, t.name, 'FUZZY', 1 - levenshtein(l.name, t.name) / greatest(length(l.name), length(t.name)) AS score
      FROM name_left l JOIN targets t ON l.block = t.block
      WHERE 1 - levenshtein(l.name, t.name) / greatest(length(l.name), length(t.name)) >= 0.82
        AND NOT EXISTS (SELECT 1 FROM targets e WHERE e.block = l.block AND e.name = l.name AND e.copies = 1)
      QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY score DESC, t.name DESC) = 1)""", "name_left", "targets")


@query("jn12_fuzzy_names_edit", "SELECT left_id, block, name, right_id, right_name, match_type, ROUND(score, 6) AS score FROM matched", ("matched",))
def _(spark, sf):
    return match_names(*name_sides(spark, sf)).withColumn("score", F.round("score", 6))


@query("ag23_match_summary", """SELECT COUNT(*) AS n_left, COUNT(match_type) AS matched, COUNT(*) FILTER (match_type = 'EXACT') AS exact, COUNT(*) FILTER (match_type = 'FUZZY') AS fuzzy,
    COUNT(*) - COUNT(match_type) AS unmatched, ROUND(COUNT(match_type) / COUNT(*), 4) AS match_rate FROM name_left LEFT JOIN matched USING (left_id)""", ("matched",))
def _(spark, sf):
    left, right = name_sides(spark, sf)
    return match_summary(left, match_names(left, right))


def part_appearances(spark, sf):
    """Parts as appearances: block = (type, brand), size as birth year, key as the order of arrival."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("appearance_id"), F.concat_ws("|", "p_type", "p_brand").alias("block"), F.col("p_name").alias("name"),
        F.col("p_size").alias("birth_year"), F.lit(0).alias("case_year"),
    )


cte("links", """SELECT x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y ON x.p_type = y.p_type AND x.p_brand = y.p_brand AND x.p_partkey <> y.p_partkey AND abs(x.p_size - y.p_size) <= 3
    AND 1 - levenshtein(x.p_name, y.p_name) / greatest(length(x.p_name), length(y.p_name)) >= 0.82""")
_REACH = "reach(id, root) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT b, root FROM reach JOIN links ON a = id)"


@query("jn13_entity_components", "SELECT id AS appearance_id, MIN(root) AS entity_id FROM reach GROUP BY id", ("links",), _REACH)
def _(spark, sf):
    return resolve_components(part_appearances(spark, sf)).select("appearance_id", "entity_id")


@query("ag24_resolution_summary", "SELECT COUNT(*) AS appearances, COUNT(DISTINCT e) AS entities, COUNT(*) - COUNT(DISTINCT e) AS relinks FROM (SELECT id, MIN(root) AS e FROM reach GROUP BY id)", ("links",), _REACH)
def _(spark, sf):
    return resolution_summary(resolve_components(part_appearances(spark, sf)))


@query("ag26_first_of_group", "SELECT c_nationkey, arg_min(c_name, c_custkey) AS first_name, COUNT(*) AS n FROM customer GROUP BY c_nationkey")
def _(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.min_by("c_name", "c_custkey").alias("first_name"), F.count("*").alias("n"))


@query("ag27_turn_log", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS position, role, length(text) AS n_chars FROM conversations")
def _(spark, sf):
    # long form: a session stays many rows; its position comes from bounded chunks of turns
    from caseweave.operators.scale import chunk_running_sum

    msgs = table(spark, sf, "conversations").withColumn("one", F.lit(1))
    return chunk_running_sum(msgs, ["conv_id"], "turn", "one", "position").select(
        "conv_id", "turn", "position", "role", F.length("text").cast("long").alias("n_chars")
    )


# ---- sorts, limits, top-k --------------------------------------------------

@query("tk1_allowed_ranking", "SELECT place, super_place, ROUND(wealth, 4) AS wealth FROM places_wide WHERE n_entities >= 5 ORDER BY places_wide.wealth DESC, place LIMIT 20", ("places_wide",))
def _(spark, sf):
    require_allowed(["wealth"], INDICATORS + METRICS)
    df = place_indicators(spark, sf).where(F.col("n_entities") >= 5)
    return df.orderBy(F.col("wealth").desc(), "place").limit(20).select("place", "super_place", F.round("wealth", 4).alias("wealth"))


@query("tk4_repeat_entities", """SELECT entity_id, n_cases, categories, risk_tier, c_name, COALESCE(degree, 0) AS degree FROM (SELECT * FROM rollup WHERE n_cases >= 2 ORDER BY n_cases DESC, entity_id LIMIT 50)
    JOIN customer ON c_custkey = entity_id LEFT JOIN (SELECT id, COUNT(*) AS degree FROM arcs GROUP BY id) ON id = entity_id""", ("rollup", "arcs"))
def _(spark, sf):
    roll = ag.entity_rollup(cases(spark, sf), "entity_id", "category", F.col("amount") > 490_000)
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"), "c_name")
    top = gr.repeat_entities(roll, "entity_id", people, part_graph(spark, sf), limit=50)
    return top.select("entity_id", "n_cases", F.array_join("categories", "|").alias("categories"), "risk_tier", "c_name", "degree")


@query("tk6_top_n_per_group", "SELECT id, rank, other, weight FROM (SELECT id, other, weight, CAST(row_number() OVER (PARTITION BY id ORDER BY weight DESC, other) AS INT) AS rank FROM arcs) WHERE rank <= 10", ("arcs",))
def _(spark, sf):
    return gr.associates(part_graph(spark, sf), 10).select("id", "rank", "other", "weight")


@query("tk7_rare_to_other", """SELECT place, COUNT(*) AS n FROM (SELECT CASE WHEN place IN (SELECT place FROM cases GROUP BY place ORDER BY COUNT(*) DESC, place LIMIT 12) THEN place ELSE 'OTHER' END AS place FROM cases) GROUP BY place""", ("cases",))
def _(spark, sf):
    df = cases(spark, sf)
    return bucket_rare(df, "place", top_categories(df, "place")).groupBy("place").agg(F.count("*").alias("n"))


def scored_accounts(spark, sf):
    features = materialise(ag.account_features(transactions(spark, sf)), "features")
    return apply_rules(features, rule_thresholds(features), 3)


@query("tk3_top_accounts", "SELECT account_id, risk_score, risk_tier FROM scored WHERE risk_tier = 'MEDIUM' ORDER BY risk_score DESC, account_id LIMIT 100", ("scored",))
def _(spark, sf):
    tier = scored_accounts(spark, sf).where(F.col("risk_tier") == "MEDIUM")
    return tier.orderBy(F.col("risk_score").desc(), "account_id").limit(100).select("account_id", "risk_score", "risk_tier")


@query("tk8_capped_edges", """SELECT from_id, to_id, txn_count, ROUND(total_paid, 2) AS total_paid, label_count FROM (SELECT from_id, to_id, COUNT(*) AS txn_count, SUM(amount_paid) AS total_paid, CAST(SUM(label) AS BIGINT) AS label_count FROM tx GROUP BY ALL) e
    WHERE from_id IN (SELECT account_id FROM scored WHERE risk_tier = 'HIGH') OR to_id IN (SELECT account_id FROM scored WHERE risk_tier = 'HIGH') OR label_count > 0
    ORDER BY label_count DESC, e.total_paid DESC, from_id, to_id LIMIT 20000""", ("tx", "scored"))
def _(spark, sf):
    return suspicious_edges(transactions(spark, sf), scored_accounts(spark, sf), limit=20_000).withColumn("total_paid", F.round("total_paid", 2))


@query("tk9_node_cap", "SELECT e.a, e.b, e.weight FROM edges e JOIN top_nodes x ON x.id = a JOIN top_nodes y ON y.id = b", ("edges", "arcs"),
       "top_nodes(id) AS MATERIALIZED (SELECT id FROM arcs GROUP BY id ORDER BY COUNT(*) DESC, id LIMIT 500)")
def _(spark, sf):
    edges = materialise(part_graph(spark, sf), "edges")
    nodes = table(spark, sf, "part").select("p_partkey", "p_brand")
    return gr.graph_view(edges, nodes, "p_partkey", "p_brand", None, 2, 500)[1]


@query("tk10_newest_events", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def _(spark, sf):
    from caseweave.streaming.audit import newest

    return newest(table(spark, sf, "events").select("event_id", "ts", "event_type"), "ts", "event_id", 1_000)


@query("tk11_listing_with_rate", """SELECT left_id, name, match_type, ROUND(COUNT(match_type) OVER () / COUNT(*) OVER (), 4) AS match_rate FROM name_left LEFT JOIN (SELECT left_id, match_type FROM matched) USING (left_id) QUALIFY match_type IS NOT NULL""", ("matched",))
def _(spark, sf):
    left, right = name_sides(spark, sf)
    matches = materialise(match_names(left, right), "matches")
    rate = match_summary(left, matches).select("match_rate").scalar()
    return matches.select("left_id", "name", "match_type", rate.alias("match_rate")).orderBy("left_id")
