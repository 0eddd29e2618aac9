"""Sources, sinks, filters, projections, joins, set operations on the driver's tables."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.operators import filters as flt
from caseweave.operators import joins as jn
from caseweave.operators.aggregates import account_features, transaction_edges, transaction_sides
from caseweave.operators.graph import node_set
from caseweave.operators.risk import apply_rules, rule_thresholds
from caseweave.operators.scale import group_pairs
from caseweave.operators.series import complete_groups
from caseweave.plans.base import (
    PROPERTY, UNRESOLVED, VIOLENT, cases, memberships, part_graph, places, table, transactions, year_span, yearly_series,
)
from caseweave.plans.registry import query
from caseweave.session import materialise, scratch_path
from caseweave.sources import readers, sinks


# ---- sources ---------------------------------------------------------------

@query("src1_typed_csv_scan", """SELECT CAST(o_orderkey AS VARCHAR) AS case_id, CAST(o_custkey AS VARCHAR) AS entity_id,
    CAST(o_orderdate AS DATE) AS case_date, o_totalprice AS amount FROM orders""")
def _(spark, sf):
    path = scratch_path(spark, "orders-csv")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date"), "o_totalprice")
    sinks.write_csv(rows, path)
    return readers.read_csv(spark, path, T.StructType.fromDDL("case_id string, entity_id string, case_date date, amount double"))


@query("src2_positional_csv_scan", "SELECT from_id, to_id, amount_received, amount_paid FROM tx", ("tx",))
def _(spark, sf):
    # the header repeats a name; the schema is applied by position
    path = scratch_path(spark, "tx-csv")
    tx = transactions(spark, sf).select(
        F.col("from_id").alias("Account"), F.col("to_id").alias("Account "), F.col("amount_received").alias("Amount Received"),
        F.col("amount_paid").alias("Amount Paid"),
    )
    sinks.write_csv(tx, path)
    return readers.read_csv(spark, path, T.StructType.fromDDL("from_id string, to_id string, amount_received double, amount_paid double"))


@query("src3_pruned_scan", "SELECT DISTINCT c_mktsegment AS segment FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment")).distinct()


@query("src4_json_document_scan", """SELECT place AS name, COUNT(*) AS total, COUNT(*) FILTER (status = 'O') AS n_open,
    MIN(amount) AS low, MAX(amount) AS high FROM cases GROUP BY place""", ("cases",))
def _(spark, sf):
    path = scratch_path(spark, "metrics-json")
    docs = cases(spark, sf).groupBy(F.col("place").alias("name")).agg(
        F.count("*").alias("total"), F.create_map(F.lit("O"), F.count_if(F.col("status") == "O")).alias("counts"),
        F.struct(F.min("amount").alias("low"), F.max("amount").alias("high")).alias("thresholds"),
    )
    sinks.write_json_metrics(docs, path)
    from caseweave.schemas import METRICS_DOCUMENT

    doc = readers.read_json_document(spark, path, METRICS_DOCUMENT)
    return doc.select("name", "total", F.col("counts")["O"].alias("n_open"), "thresholds.low", "thresholds.high")


@query("src5_sql_table_scan", """SELECT c_custkey, c_name, n_name, COUNT(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def _(spark, sf):
    return spark.sql(
        "SELECT c_custkey, c_name, n_name, COUNT(*) AS n_orders FROM {orders} JOIN {customer} ON o_custkey = c_custkey "
        "JOIN {nation} ON c_nationkey = n_nationkey GROUP BY c_custkey, c_name, n_name",
        orders=table(spark, sf, "orders"), customer=table(spark, sf, "customer"), nation=table(spark, sf, "nation"),
    )


def _log_file(spark, sf) -> str:
    """Lineitems as a block log: one block per order, header, lines, end marker."""
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    body = lines.select(
        F.col("l_orderkey").alias("k"), F.lit(1).alias("part"), F.col("l_linenumber").alias("pos"),
        F.concat_ws(",", F.date_format("l_shipdate", "yyyy/MM/dd HH:mm"), F.lit("1"), F.concat(F.lit("P"), F.col("l_partkey")), F.lit("2"),
                    F.concat(F.lit("S"), F.col("l_suppkey")), "l_extendedprice", F.lit("Y"), "l_extendedprice", F.lit("Y"), F.lit("Wire"), F.lit("1")).alias("value"),
    )
    head = orders.select(F.col("o_orderkey").alias("k"), F.lit(0).alias("part"), F.lit(0).alias("pos"),
                         F.concat(F.lit("BEGIN LAUNDERING ATTEMPT - "), F.col("o_orderpriority"), F.lit(": order "), F.col("o_orderkey")).alias("value"))
    end = orders.select(F.col("o_orderkey").alias("k"), F.lit(2).alias("part"), F.lit(0).alias("pos"), F.lit("END LAUNDERING ATTEMPT").alias("value"))
    path = scratch_path(spark, "block-log")
    body.unionByName(head).unionByName(end).repartitionByRange("k").sortWithinPartitions("k", "part", "pos").select("value").write.text(path)
    return path


@query("src6_block_log_scan", """SELECT o_orderpriority AS typology, 'order ' || o_orderkey AS descriptor, COUNT(l_orderkey) AS n_transactions,
    COUNT(DISTINCT CASE WHEN l_orderkey IS NOT NULL THEN 'P' || l_partkey END) + COUNT(DISTINCT 'S' || l_suppkey) AS n_accounts,
    ROUND(COALESCE(SUM(l_extendedprice), 0), 2) AS total_paid
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority""")
def _(spark, sf):
    summary = readers.summarise_blocks(*readers.read_block_log(spark, _log_file(spark, sf)))
    return summary.select("typology", "descriptor", "n_transactions", "n_accounts", F.round("total_paid", 2).alias("total_paid"))


@query("src7_first_per_key", """SELECT c_nationkey, c_mktsegment, c_custkey, c_name FROM customer
    QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) = 1""")
def _(spark, sf):
    rows = table(spark, sf, "customer").select("c_nationkey", "c_mktsegment", "c_custkey", "c_name")
    return readers.first_per_key(rows, ["c_nationkey", "c_mktsegment"], [F.col("c_custkey")])


# ---- sinks -----------------------------------------------------------------

@query("snk1_csv_sink", """SELECT c_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS categories
    FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def _(spark, sf):
    rows = (
        table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority").distinct()
        .groupBy("c_custkey").agg(F.array_sort(F.collect_list("o_orderpriority")).alias("categories"))
        .join(table(spark, sf, "customer").select("c_custkey"), "c_custkey", "left_semi")
    )
    path = scratch_path(spark, "categories-csv")
    sinks.write_csv(rows, path)
    return readers.read_csv(spark, path, T.StructType.fromDDL("c_custkey long, categories string"))


@query("snk2_json_metrics_sink", "SELECT COUNT(*) AS total, COUNT(*) FILTER (status = 'F') AS n_f, COUNT(*) FILTER (status = 'O') AS n_o FROM cases", ("cases",))
def _(spark, sf):
    from caseweave.operators.aggregates import value_counts

    df = cases(spark, sf).withColumn("all", F.lit("all"))
    doc = value_counts(df, ["all"], "status").withColumn("total", F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda s, x: s + x))
    path = scratch_path(spark, "summary-json")
    sinks.write_json_metrics(doc.drop("all"), path)
    back = readers.read_json_document(spark, path, T.StructType.fromDDL("total long, counts map<string,long>"))
    return back.select("total", F.col("counts")["F"].alias("n_f"), F.col("counts")["O"].alias("n_o"))


@query("snk3_model_round_trip", "SELECT COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS n_different, ROUND(AVG(l_extendedprice), 2) AS mean_prediction FROM lineitem")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice")
    model = Pipeline(stages=[
        VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="features"),
        LinearRegression(featuresCol="features", labelCol="l_extendedprice", solver="normal"),
    ]).fit(rows)
    path = scratch_path(spark, "model")
    sinks.save_model(model, path)
    loaded = sinks.load_model(path)
    both = loaded.transform(model.transform(rows).drop("features").withColumnRenamed("prediction", "before"))
    return both.agg(F.count("*").alias("n_rows"), F.count_if(F.col("prediction") != F.col("before")).alias("n_different"),
                    F.round(F.avg("prediction"), 2).alias("mean_prediction"))


# ---- filters ---------------------------------------------------------------

@query("flt1_case_filter", """SELECT case_id, place, category, case_date FROM cases
    WHERE category = '2-HIGH' AND lower(place) LIKE '%nation_1%' AND case_date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'""", ("cases",))
def _(spark, sf):
    return flt.filter_cases(
        cases(spark, sf), equals={"category": "2-HIGH"}, contains={"place": "Nation_1"}, date="case_date", start="1996-01-01", end="1997-06-30"
    ).select("case_id", "place", "category", "case_date")


NAME_REQUESTS = ["nation_1", "NATION_24", "tion_2", "atlantis", "ION_7"]


@query("flt2_resolve_names", """SELECT request, place AS resolved, super_place FROM (SELECT unnest(['nation_1', 'NATION_24', 'tion_2', 'atlantis', 'ION_7']) AS request) r
    LEFT JOIN places ON contains(lower(place), lower(request))
    QUALIFY row_number() OVER (PARTITION BY request ORDER BY CASE WHEN lower(place) = lower(request) THEN 0 ELSE 1 END, place, super_place) = 1""", ("places",))
def _(spark, sf):
    asked = spark.createDataFrame([(r,) for r in NAME_REQUESTS], "request string")
    found = flt.resolve_names(asked, "request", places(spark, sf).select("place", "super_place"), "place", [F.col("super_place")])
    return found.select("request", "resolved", "super_place")


@query("flt3_point_lookup", "SELECT case_id, entity_id, place, status FROM cases WHERE case_id = 42", ("cases",))
def _(spark, sf):
    return flt.point_lookup(cases(spark, sf), "case_id", 42).select("case_id", "entity_id", "place", "status")


@query("flt4_lookup_status", """SELECT o.o_orderkey + d.shift AS case_id, s.o_orderstatus AS case_status,
    CASE WHEN s.o_orderkey IS NULL THEN 'missing' WHEN s.o_orderstatus IN ('O','P') THEN 'present' ELSE 'out_of_queue' END AS lookup
    FROM orders o CROSS JOIN (SELECT unnest([0, -1000000000]) AS shift) d LEFT JOIN orders s ON s.o_orderkey = o.o_orderkey + d.shift""")
def _(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("status"))
    asked = orders.select(F.explode(F.array(F.col("case_id"), F.col("case_id") - 1_000_000_000)).alias("case_id"))
    return flt.lookup_status(asked, "case_id", orders, orders.where(F.col("status").isin(UNRESOLVED)), "status")


@query("flt5_taxonomy_membership", """SELECT case_id, category IN ('1-URGENT','2-HIGH') AS is_violent, category IN ('2-HIGH','3-MEDIUM') AS is_property,
    status IN ('O','P') AS is_unresolved FROM cases""", ("cases",))
def _(spark, sf):
    return cases(spark, sf).select(
        "case_id", flt.within(F.col("category"), VIOLENT).alias("is_violent"), flt.within(F.col("category"), PROPERTY).alias("is_property"),
        flt.within(F.col("status"), UNRESOLVED).alias("is_unresolved"),
    )


@query("flt6_drop_rollups", "SELECT place, COUNT(*) AS n FROM cases GROUP BY place", ("cases",))
def _(spark, sf):
    counts = cases(spark, sf).groupBy("place", "super_place").agg(F.count("*").alias("n"))
    rolled = counts.groupBy(F.concat(F.col("super_place"), F.lit(" Total")).alias("place")).agg(F.sum("n").alias("n"))
    return flt.drop_rollups(counts.select("place", "n").unionByName(rolled), "place")


@query("flt7_edges_between", """SELECT a, b, weight FROM edges WHERE weight >= 3 AND a IN (SELECT p_partkey FROM part WHERE p_type IN ('SMALL','ECONOMY'))
    AND b IN (SELECT p_partkey FROM part WHERE p_type IN ('SMALL','ECONOMY'))""", ("edges",))
def _(spark, sf):
    kept = table(spark, sf, "part").where(F.col("p_type").isin("SMALL", "ECONOMY"))
    return flt.edges_between(part_graph(spark, sf), 3, kept, "p_partkey").select("a", "b", "weight")


# ---- projections -----------------------------------------------------------

@query("prj1_calendar", """SELECT event_id, CAST(hour(ts) AS INT) AS hour, dayname(ts) AS weekday, strftime(ts, '%Y-%m') AS month_bucket,
    CASE WHEN hour(ts) < 6 THEN 'NIGHT_00_06' WHEN hour(ts) < 12 THEN 'MORNING_06_12' WHEN hour(ts) < 18 THEN 'AFTERNOON_12_18' ELSE 'EVENING_18_24' END AS time_bucket
    FROM events""")
def _(spark, sf):
    return flt.with_calendar(table(spark, sf, "events").select("event_id", "ts"), "ts").drop("ts")


@query("prj2_rates", """SELECT place, ROUND(COUNT(*) FILTER (status = 'F') * 1.0 / NULLIF(COUNT(*), 0), 6) AS closed_rate,
    ROUND(COUNT(*) * 1.0 / NULLIF(COUNT(DISTINCT entity_id), 0), 6) AS per_entity, ROUND(COUNT(*) * 1.0 / NULLIF(COUNT(*) FILTER (status = 'none'), 0), 6) AS empty_rate
    FROM cases GROUP BY place""", ("cases",))
def _(spark, sf):
    g = cases(spark, sf).groupBy("place").agg(
        F.count_if(F.col("status") == "F").alias("closed"), F.count("*").alias("n"), F.count_distinct("entity_id").alias("entities"),
        F.count_if(F.col("status") == "none").alias("nothing"),
    )
    return g.select(
        "place", F.round(flt.share(F.col("closed"), F.col("n")), 6).alias("closed_rate"),
        F.round(flt.share(F.col("n"), F.col("entities")), 6).alias("per_entity"), F.round(flt.share(F.col("n"), F.col("nothing")), 6).alias("empty_rate"),
    )


@query("prj3_tiers", "SELECT case_id, CASE WHEN amount >= 400000 THEN 'HIGH' WHEN amount >= 200000 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM cases", ("cases",))
def _(spark, sf):
    return cases(spark, sf).select("case_id", flt.tier(F.col("amount"), [(400_000, "HIGH"), (200_000, "MEDIUM")]).alias("tier"))


@query("prj4_allowed_projection", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def _(spark, sf):
    return flt.allowed_projection(table(spark, sf, "customer"), ["c_custkey"], ["c_mktsegment", "c_acctbal"], ["c_mktsegment", "c_acctbal", "c_nationkey"])


@query("prj5_role_view", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def _(spark, sf):
    return flt.role_view(table(spark, sf, "customer"), "ANALYST", ["c_name", "c_acctbal"])


@query("prj6_nested_response", """SELECT entity_id, string_agg(category || '=' || n, '|' ORDER BY category) AS counts, ROUND(MIN(lo), 2) AS low, ROUND(MAX(hi), 2) AS high
    FROM (SELECT entity_id, category, COUNT(*) AS n, MIN(amount) AS lo, MAX(amount) AS hi FROM cases GROUP BY ALL) GROUP BY entity_id""", ("cases",))
def _(spark, sf):
    per = cases(spark, sf).groupBy("entity_id", "category").agg(F.count("*").alias("n"), F.min("amount").alias("lo"), F.max("amount").alias("hi"))
    nested = per.groupBy("entity_id").agg(
        F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("counts"),
        F.struct(F.round(F.min("lo"), 2).alias("low"), F.round(F.max("hi"), 2).alias("high")).alias("span"),
    )
    from caseweave.operators.aggregates import counts_text

    return nested.select("entity_id", counts_text(F.col("counts")).alias("counts"), "span.low", "span.high")


# ---- joins -----------------------------------------------------------------

@query("jn1_star_flatten", """SELECT l_orderkey, l_linenumber, place, super_place, o_orderstatus AS status, s_name AS supplier FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = n_nationkey
    LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0""", ("places",))
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    supplier = table(spark, sf, "supplier").where(F.col("s_acctbal") > 0).select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("supplier"))
    flat = cases(spark, sf).select(F.col("case_id").alias("l_orderkey"), "place", "super_place", "status")
    return jn.lookup(lines.join(flat, "l_orderkey"), supplier, "l_suppkey", ["supplier"]).drop("l_suppkey")


@query("jn2_inner_chain", """SELECT l_orderkey, l_linenumber, p_brand, s_name, c_mktsegment FROM lineitem JOIN part ON l_partkey = p_partkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""")
def _(spark, sf):
    part, supplier = table(spark, sf, "part"), table(spark, sf, "supplier")
    owners = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")
    return (
        table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(owners, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "p_brand", "s_name", "c_mktsegment")
    )


@query("jn3_left_lookup", """SELECT doc_id, source, quality FROM documents LEFT JOIN labels USING (doc_id)""")
def _(spark, sf):
    return jn.lookup(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), "doc_id", ["quality"])


@query("jn4_attach_children", """SELECT o_orderkey, COUNT(l_orderkey) AS line_count, arg_min(l_partkey, row(l_linenumber, l_partkey, l_suppkey, l_quantity)) AS line_l_partkey,
    arg_min(l_quantity, row(l_linenumber, l_partkey, l_suppkey, l_quantity)) AS line_l_quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def _(spark, sf):
    children = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return jn.attach_children(
        table(spark, sf, "orders").select("o_orderkey"), children, "o_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], ["l_partkey", "l_quantity"], "line"
    )


@query("jn5_fact_dimension_merge", "SELECT l_orderkey, l_linenumber, p_type, p_size FROM lineitem JOIN part ON p_partkey = l_partkey")
def _(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_size")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part, "l_partkey").drop("l_partkey")


@query("jn6_left_join_default", """SELECT doc_id, COALESCE(CASE WHEN toxic = 1 THEN 'HIGH' WHEN toxic = 0 THEN 'MEDIUM' END, 'LOW') AS risk_tier FROM documents LEFT JOIN labels USING (doc_id)""")
def _(spark, sf):
    tiers = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "HIGH").when(F.col("toxic") == 0, "MEDIUM").alias("risk_tier"))
    return jn.lookup(table(spark, sf, "documents").select("doc_id"), tiers, "doc_id", ["risk_tier"], {"risk_tier": "LOW"})


@query("jn7_two_sided_alignment", """SELECT account_id, ROUND(out_amount, 2) AS out_amount, out_count, ROUND(in_amount, 2) AS in_amount, in_count FROM feats""", ("feats",))
def _(spark, sf):
    f = account_features(transactions(spark, sf))
    return f.select("account_id", F.round("out_amount", 2).alias("out_amount"), "out_count", F.round("in_amount", 2).alias("in_amount"), "in_count")


@query("jn8_group_volume_lookup", "SELECT case_id, COUNT(*) OVER (PARTITION BY place) AS volume FROM cases", ("cases",))
def _(spark, sf):
    rows = cases(spark, sf).select("case_id", "place")
    return rows.join(rows.groupBy("place").agg(F.count("*").alias("volume")), "place").drop("place")


@query("jn9_either_endpoint_semi", """SELECT from_id, to_id, COUNT(*) AS txn_count, CAST(SUM(label) AS BIGINT) AS label_count FROM tx GROUP BY ALL
    HAVING from_id IN (SELECT account_id FROM scored WHERE risk_tier = 'HIGH') OR to_id IN (SELECT account_id FROM scored WHERE risk_tier = 'HIGH') OR SUM(label) > 0""", ("tx", "scored"))
def _(spark, sf):
    tx = transactions(spark, sf)
    features = materialise(account_features(tx), "features")
    risky = apply_rules(features, rule_thresholds(features), 3).where(F.col("risk_tier") == "HIGH")
    return jn.touching(transaction_edges(tx), risky, "account_id", F.col("label_count") > 0).drop("total_paid")


@query("jn10_pairs_in_case", """SELECT x.grp, x.item AS a, y.item AS b FROM members x JOIN members y ON x.grp = y.grp AND x.item < y.item""", ("members",))
def _(spark, sf):
    return group_pairs(memberships(spark, sf).distinct(), "grp", "item")


@query("jn11_other_endpoint", """SELECT id AS part, other AS associate, weight FROM arcs WHERE id IN (SELECT p_partkey FROM part WHERE p_size >= 40)""", ("arcs",))
def _(spark, sf):
    wanted = table(spark, sf, "part").where(F.col("p_size") >= 40).select(F.col("p_partkey").alias("part"))
    return jn.other_endpoint(part_graph(spark, sf), wanted, "part")


@query("jn14_optional_context", """SELECT n_name AS place, s.n IS NOT NULL AS sup_available, s.n AS sup_n FROM nation
    LEFT JOIN (SELECT s_nationkey, COUNT(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON s_nationkey = n_nationkey""")
def _(spark, sf):
    rich = table(spark, sf, "supplier").where(F.col("s_acctbal") > 5000).join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    context = rich.groupBy(F.lower("n_name").alias("label")).agg(F.count("*").alias("n"))
    return jn.available(table(spark, sf, "nation").select(F.col("n_name").alias("place")), context, "place", "label", ["n"], "sup")


@query("jn15_complete_history", """SELECT super_place, place, t, n_total FROM yearly WHERE (super_place, place) IN
    (SELECT (super_place, place) FROM yearly GROUP BY super_place, place HAVING COUNT(DISTINCT t) = (SELECT years FROM span))""", ("span",))
def _(spark, sf):
    first, last = year_span(spark, sf)
    return complete_groups(yearly_series(spark, sf), ["super_place", "place"], "t", last - first + 1).select("super_place", "place", "t", "n_total")


# ---- set operations --------------------------------------------------------

@query("st1_union_roles", """SELECT o_orderkey AS case_id, 'C' || o_custkey AS person_id, 'COMPLAINANT' AS role FROM orders
    UNION ALL SELECT l_orderkey, 'S' || l_suppkey, 'ACCUSED' FROM lineitem UNION ALL SELECT l_orderkey, 'P' || l_partkey, 'VICTIM' FROM lineitem""")
def _(spark, sf):
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return jn.union_roles(
        (orders, "COMPLAINANT", F.col("o_orderkey"), F.concat(F.lit("C"), F.col("o_custkey"))),
        (lines, "ACCUSED", F.col("l_orderkey"), F.concat(F.lit("S"), F.col("l_suppkey"))),
        (lines, "VICTIM", F.col("l_orderkey"), F.concat(F.lit("P"), F.col("l_partkey"))),
    )


@query("st2_first_person_wins", """SELECT person_id, person_name, kind FROM (SELECT c_custkey AS person_id, c_name AS person_name, 0 AS kind FROM customer
    UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier) QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY kind, person_name) = 1""")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("person_name"), F.lit(0).alias("kind"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("person_name"), F.lit(1).alias("kind"))
    return jn.first_seen(c.unionByName(s), "person_id", [F.col("kind"), F.col("person_name")])


@query("st3_stacked_measures", """SELECT side, ROUND(SUM(v), 2) AS total, COUNT(*) AS n FROM (SELECT 'out' AS side, max_out_txn AS v FROM feats UNION ALL SELECT 'in', max_in_txn FROM feats)
    WHERE v > 0 GROUP BY side""", ("feats",))
def _(spark, sf):
    f = account_features(transactions(spark, sf)).select("max_out_txn", "max_in_txn")
    stacked = f.select(F.explode(F.array(F.struct(F.lit("out").alias("side"), F.col("max_out_txn").alias("v")),
                                         F.struct(F.lit("in").alias("side"), F.col("max_in_txn").alias("v")))).alias("e")).select("e.*")
    return stacked.where(F.col("v") > 0).groupBy("side").agg(F.round(F.sum("v"), 2).alias("total"), F.count("*").alias("n"))


@query("st4_role_sets", """SELECT account_id, string_agg(DISTINCT CASE WHEN side = 1 THEN 'PAYER' ELSE 'PAYEE' END, '|' ORDER BY CASE WHEN side = 1 THEN 'PAYER' ELSE 'PAYEE' END) AS roles
    FROM (SELECT from_id AS account_id, 1 AS side FROM tx UNION ALL SELECT to_id, 0 FROM tx) GROUP BY account_id""", ("tx",))
def _(spark, sf):
    roles = transaction_sides(transactions(spark, sf)).select("account_id", F.when(F.col("is_out") == 1, "PAYER").otherwise("PAYEE").alias("role")).distinct()
    return roles.groupBy("account_id").agg(F.array_join(F.array_sort(F.collect_list("role")), "|").alias("roles"))


@query("st5_node_set", "SELECT DISTINCT id FROM arcs", ("arcs",))
def _(spark, sf):
    return node_set(part_graph(spark, sf))
