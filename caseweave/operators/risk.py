"""Rule scoring calibrated on percentiles, its evaluation, and case priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.operators.aggregates import highest_tier, precision_recall, transaction_edges
from caseweave.operators.filters import share, tier, within
from caseweave.operators.history import with_age
from caseweave.operators.scale import exact_quantiles, quantiles_together, total

# fixed values of the rule engine
FAN_PERCENTILE = 0.99
VALUE_PERCENTILE = 0.98
PASSTHROUGH_MIN_TXNS = 3
PASSTHROUGH_BAND = (0.85, 1.15)
FLAGS = ["flag_high_fan_out", "flag_high_fan_in", "flag_rapid_passthrough", "flag_cross_currency", "flag_high_value_txn"]
HOTSPOT_PERCENTILE = 0.75
PRIORITY_CUTOFFS = [(6, "HIGH"), (4, "MEDIUM")]


def rule_thresholds(features: DataFrame) -> dict[str, float | None]:
    """Percentiles over positive values only, None without any; the value threshold uses both per-account maxima."""
    def positive(column: str) -> Column:
        return F.when(F.col(column) > 0, F.col(column))

    found = quantiles_together(features, {
        "fan_out": (positive("out_degree"), [FAN_PERCENTILE]), "fan_in": (positive("in_degree"), [FAN_PERCENTILE]),
        "high_value": (F.array(positive("max_out_txn"), positive("max_in_txn")), [VALUE_PERCENTILE]),
    })
    return {name: values[0] for name, values in found.items()}


def apply_rules(features: DataFrame, thresholds: dict[str, float | None], min_currencies: int = 2) -> DataFrame:
    """Flags, score and tier of each account; a missing threshold or measure raises no flag."""
    low, high = PASSTHROUGH_BAND
    ratio = share(F.col("out_amount"), F.col("in_amount"))
    busy = (F.col("in_count") >= PASSTHROUGH_MIN_TXNS) & (F.col("out_count") >= PASSTHROUGH_MIN_TXNS)

    def reaches(measure: str, threshold: float | None) -> Column:
        return F.lit(False) if threshold is None else F.coalesce(F.col(measure) >= threshold, F.lit(False))

    flagged = features.withColumns({
        "flag_high_fan_out": reaches("out_degree", thresholds["fan_out"]),
        "flag_high_fan_in": reaches("in_degree", thresholds["fan_in"]),
        "flag_rapid_passthrough": F.coalesce(busy & ratio.between(low, high), F.lit(False)),
        "flag_cross_currency": reaches("distinct_currencies", min_currencies),
        "flag_high_value_txn": reaches("max_single_txn", thresholds["high_value"]),
    })
    score = sum((F.col(f).cast("int") for f in FLAGS), F.lit(0))
    return flagged.withColumn("risk_score", score).withColumn("risk_tier", tier(F.col("risk_score"), [(3, "HIGH"), (2, "MEDIUM")]))


def evaluate_rules(scored: DataFrame) -> DataFrame:
    truth = F.col("is_labelled")
    return precision_recall(scored, F.col("risk_tier") == "HIGH", truth, "high_only").unionByName(
        precision_recall(scored, F.col("risk_tier").isin("HIGH", "MEDIUM"), truth, "medium_or_high")
    )


def suspicious_edges(tx: DataFrame, scored: DataFrame, limit: int | None = None) -> DataFrame:
    """Edges that touch a high-risk account or carry a label; with a limit, the first by label and amount."""
    risky = scored.where(F.col("risk_tier") == "HIGH").select("account_id", F.lit(True).alias("_risky"))
    edges = transaction_edges(tx)
    marked = (
        edges.join(risky.select(F.col("account_id").alias("from_id"), F.col("_risky").alias("_from")), "from_id", "left")
        .join(risky.select(F.col("account_id").alias("to_id"), F.col("_risky").alias("_to")), "to_id", "left")
    )
    kept = marked.where(F.col("_from").isNotNull() | F.col("_to").isNotNull() | (F.col("label_count") > 0))
    kept = kept.drop("_from", "_to")
    return kept.orderBy(F.col("label_count").desc(), F.col("total_paid").desc(), "from_id", "to_id").limit(limit) if limit else kept


def case_priority(cases: DataFrame, links: DataFrame, tiers: DataFrame, case: str, place: str, category: str, status: str, date: str,
                  entity: str, violent: list[str], unresolved: list[str], stale_days: int, entity_tier: str = "risk_tier") -> DataFrame:
    """Score 0-8 for each unresolved case: violent 3, entity risk 0/1/2, hotspot 2, stale 1."""
    volumes = cases.where(F.col(place).isNotNull()).groupBy(place).agg(F.count("*").alias("_volume"))
    p75 = exact_quantiles(volumes, "_volume", [HOTSPOT_PERCENTILE])[0]
    open_cases = with_age(cases.where(within(F.col(status), unresolved)), date, stale_days, total(cases, F.max(date)))
    entity_risk = highest_tier(
        links.select(case, entity).join(tiers.select(entity, F.col(entity_tier).alias("_tier")), entity, "left"), [case], "_tier"
    )
    scored = (
        open_cases.join(volumes, place, "left").join(entity_risk, case, "left")
        .withColumns({
            "violent_points": within(F.col(category), violent).cast("int") * 3,
            # without any known place there is no threshold, and no points for it
            "hotspot_points": (F.coalesce("_volume", F.lit(0)) >= p75).cast("int") * 2 if p75 is not None else F.lit(0),
            "entity_points": F.coalesce("risk_points", F.lit(0)),
            "highest_tier": F.coalesce("highest_tier", F.lit("LOW")),
        })
        .drop("_volume", "risk_points")
    )
    stale = F.coalesce("stale_points", F.lit(0))
    points = F.col("violent_points") + F.col("entity_points") + F.col("hotspot_points") + stale
    return scored.withColumn("priority_score", points).withColumn("priority_tier", tier(F.col("priority_score"), PRIORITY_CUTOFFS))
