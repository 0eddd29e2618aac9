"""Views that bind the generic operators to the driver's tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.operators.graph import cooccurrence
from caseweave.plans.registry import cte

VIOLENT = ["1-URGENT", "2-HIGH"]
PROPERTY = ["2-HIGH", "3-MEDIUM"]
UNRESOLVED = ["O", "P"]
MIN_WEIGHT = 2


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def places(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("n_name").alias("place"), F.col("r_name").alias("super_place")
    )


def cases(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(places(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("entity_id"), "place", "super_place",
            F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("status"),
            F.col("o_orderdate").cast("date").alias("case_date"), F.col("o_totalprice").alias("amount"),
            F.col("c_mktsegment").alias("segment"),
        )
    )


def transactions(spark: SparkSession, sf: str) -> DataFrame:
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    buyer = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    seller = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    back = F.col("l_returnflag") == "R"
    currency = F.when(F.col("l_quantity") >= 48, "X").when(F.col("l_quantity") <= 1, "Z").otherwise("Y")
    label = (F.col("l_discount") >= 0.09) & (F.col("l_tax") >= 0.07) & (F.col("l_quantity") >= 40)
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.when(back, seller).otherwise(buyer).alias("from_id"), F.when(back, buyer).otherwise(seller).alias("to_id"),
        F.col("l_extendedprice").alias("amount_paid"), F.col("l_extendedprice").alias("amount_received"),
        currency.alias("payment_currency"), currency.alias("receiving_currency"), label.cast("int").alias("label"),
    )


def memberships(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_partkey").alias("item"))


def part_graph(spark: SparkSession, sf: str) -> DataFrame:
    return cooccurrence(memberships(spark, sf), "grp", "item", MIN_WEIGHT)


def yearly_series(spark: SparkSession, sf: str) -> DataFrame:
    """(place, super_place, t, n, urgent, cheap ... ) wide counts per place and year, over all years."""
    year = F.year("case_date")
    return cases(spark, sf).groupBy("super_place", "place", year.alias("t")).agg(
        F.count("*").alias("n_total"),
        *[F.count_if(F.col("category") == c).alias(f"n_{i}") for i, c in enumerate(["1-URGENT", "2-HIGH", "3-MEDIUM"])],
    )


def year_span(spark: SparkSession, sf: str) -> tuple[int, int]:
    """First and last year of the cases: a back-test holds out the last two, a complete history has all."""
    found = cases(spark, sf).agg(F.min(F.year("case_date")).alias("first"), F.max(F.year("case_date")).alias("last")).first()
    return found["first"], found["last"]


cte("places", "SELECT n_nationkey, n_name AS place, r_name AS super_place FROM nation JOIN region ON n_regionkey = r_regionkey")
cte(
    "cases",
    """SELECT o_orderkey AS case_id, o_custkey AS entity_id, place, super_place, o_orderpriority AS category,
       o_orderstatus AS status, CAST(o_orderdate AS DATE) AS case_date, o_totalprice AS amount, c_mktsegment AS segment
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = n_nationkey""",
    "places",
)
cte(
    "tx",
    """SELECT CASE WHEN l_returnflag = 'R' THEN 'S' || l_suppkey ELSE 'C' || o_custkey END AS from_id,
       CASE WHEN l_returnflag = 'R' THEN 'C' || o_custkey ELSE 'S' || l_suppkey END AS to_id,
       l_extendedprice AS amount_paid, l_extendedprice AS amount_received,
       CASE WHEN l_quantity >= 48 THEN 'X' WHEN l_quantity <= 1 THEN 'Z' ELSE 'Y' END AS currency,
       CASE WHEN l_discount >= 0.09 AND l_tax >= 0.07 AND l_quantity >= 40 THEN 1 ELSE 0 END AS label
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
cte(
    "feats",
    """SELECT account_id, COALESCE(SUM(amount) FILTER (side = 1), 0) AS out_amount, COUNT(*) FILTER (side = 1) AS out_count,
       COUNT(DISTINCT other) FILTER (side = 1) AS out_degree, COALESCE(MAX(amount) FILTER (side = 1), 0) AS max_out_txn,
       CAST(COALESCE(SUM(label) FILTER (side = 1), 0) AS BIGINT) AS out_label_count,
       COALESCE(SUM(amount) FILTER (side = 0), 0) AS in_amount, COUNT(*) FILTER (side = 0) AS in_count,
       COUNT(DISTINCT other) FILTER (side = 0) AS in_degree, COALESCE(MAX(amount) FILTER (side = 0), 0) AS max_in_txn,
       CAST(COALESCE(SUM(label) FILTER (side = 0), 0) AS BIGINT) AS in_label_count,
       COUNT(DISTINCT currency) AS distinct_currencies, MAX(amount) AS max_single_txn, CAST(SUM(label) AS BIGINT) AS label_count,
       SUM(label) > 0 AS is_labelled
       FROM (SELECT from_id AS account_id, to_id AS other, amount_paid AS amount, currency, label, 1 AS side FROM tx
             UNION ALL SELECT to_id, from_id, amount_received, currency, label, 0 FROM tx) GROUP BY account_id""",
    "tx",
)
cte(
    "limits",
    """SELECT (SELECT quantile_cont(out_degree, 0.99) FROM feats WHERE out_degree > 0) AS fan_out,
       (SELECT quantile_cont(in_degree, 0.99) FROM feats WHERE in_degree > 0) AS fan_in,
       (SELECT quantile_cont(v, 0.98) FROM (SELECT max_out_txn AS v FROM feats UNION ALL SELECT max_in_txn FROM feats) WHERE v > 0) AS high_value""",
    "feats",
)
cte(
    "flagged",
    """SELECT feats.*, out_degree >= fan_out AS f1, in_degree >= fan_in AS f2,
       COALESCE(in_count >= 3 AND out_count >= 3 AND out_amount / NULLIF(in_amount, 0) BETWEEN 0.85 AND 1.15, FALSE) AS f3,
       distinct_currencies >= 3 AS f4, max_single_txn >= high_value AS f5 FROM feats, limits""",
    "limits",
)
cte(
    "scored",
    """SELECT *, CASE WHEN risk_score >= 3 THEN 'HIGH' WHEN risk_score = 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier
       FROM (SELECT *, CAST(f1 AS INT) + CAST(f2 AS INT) + CAST(f3 AS INT) + CAST(f4 AS INT) + CAST(f5 AS INT) AS risk_score FROM flagged)""",
    "flagged",
)
cte("members", "SELECT DISTINCT l_orderkey AS grp, l_partkey AS item FROM lineitem")
cte(
    "edges",
    "SELECT x.item AS a, y.item AS b, COUNT(*) AS weight FROM members x JOIN members y ON x.grp = y.grp AND x.item < y.item GROUP BY ALL HAVING COUNT(*) >= 2",
    "members",
)
cte("arcs", "SELECT a AS id, b AS other, weight FROM edges UNION ALL SELECT b, a, weight FROM edges", "edges")
cte(
    "yearly",
    """SELECT super_place, place, CAST(year(case_date) AS INT) AS t, COUNT(*) AS n_total, COUNT(*) FILTER (category = '1-URGENT') AS n_0,
       COUNT(*) FILTER (category = '2-HIGH') AS n_1, COUNT(*) FILTER (category = '3-MEDIUM') AS n_2
       FROM cases GROUP BY ALL""",
    "cases",
)
cte("span", "SELECT MIN(t) AS first, MAX(t) AS last, MAX(t) - MIN(t) + 1 AS years FROM yearly", "yearly")
