"""Group summaries, mixes, entropies, evaluation counts and correlation grids."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.operators.filters import require_allowed, share, within
from caseweave.operators.scale import top_per_group, total
from caseweave.schemas import ALLOWED_INDICATORS, CONTEXT_ONLY, CRIME_METRICS


def dataset_summary(df: DataFrame, date: str, place: str, category: str) -> DataFrame:
    counts = (
        df.where(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("n"))
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(category, "n")))).alias("m")).scalar()
    )
    return df.agg(
        F.count("*").alias("total_cases"), F.min(date).alias("date_start"), F.max(date).alias("date_end"),
        F.count_distinct(place).alias("distinct_places"), F.count_distinct(category).alias("distinct_categories"),
    ).withColumn("category_counts", counts)


def value_counts(df: DataFrame, group: list[str], category: str) -> DataFrame:
    """One map of category counts per group; categories form a small vocabulary, and rows without one are not counted."""
    return (
        df.where(F.col(category).isNotNull()).groupBy(*group, category).agg(F.count("*").alias("n"))
        .groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(category, "n")))).alias("counts"))
    )


def counts_text(counts: Column) -> Column:
    """category=count pairs of a map in key order, joined with '|'."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat_ws("=", e["key"], e["value"])), "|")


def group_profile(df: DataFrame, group: list[str], category: str, status: str, value: str, violent: list[str],
                  prop: list[str], unresolved: list[str], min_cases: int) -> DataFrame:
    def ratio(cond: Column) -> Column:
        return F.avg(cond.cast("double"))

    return (
        df.groupBy(*group).agg(
            F.count("*").alias("total_cases"),
            ratio(within(F.col(category), violent)).alias("violent_ratio"),
            ratio(within(F.col(category), prop)).alias("property_ratio"),
            ratio(within(F.col(status), unresolved)).alias("unresolved_ratio"),
            F.coalesce(F.avg(value), F.lit(0.0)).alias("avg_value"),
        ).where(F.col("total_cases") >= min_cases)
    )


def entropy(df: DataFrame, group: list[str], category: str, out: str = "diversity") -> DataFrame:
    """Shannon entropy of the category mix over its maximum; 0 for one category.

    -sum(p ln p) with p = n/N equals ln N - sum(n ln n)/N, so one more
    aggregation over the counts is enough.
    """
    counts = df.groupBy(*group, category).agg(F.count("*").alias("n"))
    sums = counts.groupBy(*group).agg(
        F.sum("n").alias("_n"), F.sum(F.col("n") * F.ln("n")).alias("_s"), F.count("*").alias("_k")
    )
    value = F.when(F.col("_k") <= 1, F.lit(0.0)).otherwise((F.ln("_n") - F.col("_s") / F.col("_n")) / F.ln("_k"))
    return sums.select(*group, value.alias(out))


def modal_value(df: DataFrame, group: list[str], column: str, out: str) -> DataFrame:
    """Most frequent value per group, smallest on ties."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*group, column).agg(F.count("*").alias("_n"))
    return top_per_group(counts, group, [F.col("_n").desc(), F.col(column)], 1, "_rk").select(*group, F.col(column).alias(out))


def first_ids(df: DataFrame, group: list[str], key: str, n: int = 5) -> DataFrame:
    """First ``n`` ids of each group in key order, as a bounded array."""
    kept = top_per_group(df.select(*group, key), group, [F.col(key)], n, "_rk")
    return kept.groupBy(*group).agg(F.array_sort(F.collect_list(key)).alias("sample_ids"))


def transaction_sides(tx: DataFrame) -> DataFrame:
    """Two rows per transaction, one per account, so that both sides share one shuffle."""
    out = F.struct(
        F.col("from_id").alias("account_id"), F.col("to_id").alias("other_id"), F.col("amount_paid").alias("amount"),
        F.col("payment_currency").alias("currency"), F.lit(1).alias("is_out"), F.col("label"),
    )
    into = F.struct(
        F.col("to_id").alias("account_id"), F.col("from_id").alias("other_id"), F.col("amount_received").alias("amount"),
        F.col("receiving_currency").alias("currency"), F.lit(0).alias("is_out"), F.col("label"),
    )
    return tx.select(F.explode(F.array(out, into)).alias("s")).select("s.*")


def account_features(tx: DataFrame) -> DataFrame:
    """In/out amounts, counts, degrees, maxima, labels and currencies per account.

    Rows are first combined by (account, side, counterparty), so a hot account is
    spread over its counterparties and its degree is a plain count afterwards.
    """
    sides = transaction_sides(tx)
    partners = sides.groupBy("account_id", "is_out", "other_id").agg(
        F.sum("amount").alias("amount"), F.count("*").alias("n"), F.max("amount").alias("top"), F.sum("label").alias("label")
    )
    measures = []
    for side, flag in (("out", 1), ("in", 0)):
        mine = F.col("is_out") == flag
        measures += [
            F.coalesce(F.sum(F.when(mine, F.col("amount"))), F.lit(0.0)).alias(f"{side}_amount"),
            F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0)).alias(f"{side}_count"),
            F.count_if(mine).alias(f"{side}_degree"),
            F.coalesce(F.max(F.when(mine, F.col("top"))), F.lit(0.0)).alias(f"max_{side}_txn"),
            F.coalesce(F.sum(F.when(mine, F.col("label"))), F.lit(0)).alias(f"{side}_label_count"),
        ]
    currencies = sides.select("account_id", "currency").distinct().groupBy("account_id").agg(F.count("*").alias("distinct_currencies"))
    return (
        partners.groupBy("account_id").agg(*measures).join(currencies, "account_id")
        .withColumn("max_single_txn", F.greatest("max_out_txn", "max_in_txn"))
        .withColumn("label_count", F.col("out_label_count") + F.col("in_label_count"))
        .withColumn("is_labelled", F.col("label_count") > 0)
    )


def transaction_edges(tx: DataFrame) -> DataFrame:
    return tx.groupBy("from_id", "to_id").agg(
        F.count("*").alias("txn_count"), F.sum("amount_paid").alias("total_paid"), F.sum("label").cast("long").alias("label_count")
    )


def highest_tier(df: DataFrame, group: list[str], tier: str, order: tuple[str, ...] = ("LOW", "MEDIUM", "HIGH")) -> DataFrame:
    """Highest tier of a group and its points (position in ``order``)."""
    points = F.coalesce(*[F.when(F.col(tier) == name, F.lit(i)) for i, name in enumerate(order)], F.lit(0))
    names = F.array(*[F.lit(n) for n in order])
    return df.groupBy(*group).agg(F.max(points).alias("risk_points")).withColumn("highest_tier", names[F.col("risk_points")])


def entity_rollup(links: DataFrame, entity: str, category: str, flag: Column) -> DataFrame:
    """Row count, category list, any-flag and rule tier per entity."""
    counts = links.groupBy(entity).agg(F.count("*").alias("n_cases"), F.bool_or(flag).alias("any_flag"))
    kinds = (
        links.where(F.col(category).isNotNull()).select(entity, category).distinct()
        .groupBy(entity).agg(F.array_sort(F.collect_list(category)).alias("categories"))
    )
    return (
        counts.join(kinds, entity, "left")
        .withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))
        .withColumn(
            "risk_tier",
            F.when((F.col("n_cases") >= 3) | ((F.col("n_cases") >= 2) & F.col("any_flag")), "HIGH")
            .when((F.col("n_cases") >= 2) | F.col("any_flag"), "MEDIUM").otherwise("LOW"),
        )
    )


def precision_recall(df: DataFrame, flagged: Column, truth: Column, name: str, times: str | None = None) -> DataFrame:
    """Precision, recall and F1 of a flag; ``times``: the column that says for how many rows each row stands."""
    def number(which: Column) -> Column:
        return F.coalesce(F.sum(F.when(which, F.col(times))), F.lit(0).cast("long")) if times else F.count_if(which)

    counts = df.agg(number(flagged & truth).alias("tp"), number(flagged & ~truth).alias("fp"), number(~flagged & truth).alias("fn"))
    p, r = F.coalesce(share(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(share(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    scored = counts.withColumns({"p": p, "r": r}).withColumn("f", F.coalesce(share(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
    return scored.select(
        F.lit(name).alias("rule"), (F.col("tp") + F.col("fp")).alias("flagged"), "tp", "fp", "fn",
        F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round("f", 4).alias("f1"),
    )


def column_mix(df: DataFrame, columns: dict[str, str], scale: float = 1.0, rest: str | None = None) -> DataFrame:
    """Share of each summed column in their total; ``scale`` < 1 leaves 1-scale to ``rest``."""
    sums = df.agg(*[F.sum(c).cast("double").alias(label) for c, label in columns.items()])
    whole = sum((F.col(label) for label in columns.values()), F.lit(0.0))
    entries = [F.struct(F.lit(label).alias("label"), (share(F.col(label), whole) * scale).alias("weight")) for label in columns.values()]
    if rest:
        entries.append(F.struct(F.lit(rest).alias("label"), F.lit(1 - scale).alias("weight")))
    return sums.select(F.explode(F.array(*entries)).alias("e")).select("e.label", "e.weight")


def group_weights(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Group totals as shares of the grand total; empty groups drop out."""
    sums = df.groupBy(*group).agg(F.sum(value).alias("total")).where(F.col("total") > 0)
    return sums.withColumn("weight", F.col("total") / total(df, F.sum(value)))


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d, h = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1), tiny), 0.0
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return front * h


@F.pandas_udf(T.DoubleType())
def pearson_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of r under Student's t with n-2 degrees of freedom."""
    return pd.Series([
        None if pd.isna(x) or k < 3 else _incomplete_beta((k - 2) / 2, 0.5, max(0.0, 1 - x * x)) for x, k in zip(r, n)
    ], dtype="float64")


def correlation(x: str, y: str) -> Column:
    """Pearson r over the rows where both are present; null if either is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(x))) * F.stddev_pop(F.when(both, F.col(y)))
    return F.try_divide(F.covar_pop(x, y), F.nullif(spread, F.lit(0.0)))


def interpret_correlation(r: Column, p: Column) -> Column:
    strength = F.when(F.abs(r) >= 0.5, "strong").when(F.abs(r) >= 0.3, "moderate").otherwise("weak")
    direction = F.when(r > 0, "positive").otherwise("negative")
    text = F.when(p >= 0.05, "not statistically significant (p >= 0.05)").otherwise(
        F.concat(strength, F.lit(" "), direction, F.lit(" correlation (p < 0.05)"))
    )
    return F.when(r.isNotNull() & p.isNotNull(), text)


def correlation_grid(df: DataFrame, indicators: list[str], metrics: list[str], allowed_indicators: list[str] = ALLOWED_INDICATORS,
                     allowed_metrics: list[str] = CRIME_METRICS, min_n: int = 10) -> DataFrame:
    """Pearson r for every allowed (indicator, metric) pair in a single pass."""
    require_allowed(indicators, allowed_indicators, CONTEXT_ONLY)
    require_allowed(metrics, allowed_metrics, CONTEXT_ONLY)
    pairs = [(i, m) for i in indicators for m in metrics]
    cells = df.agg(*[
        F.struct(correlation(i, m).alias("r"), F.regr_count(m, i).alias("n")).alias(f"c{k}") for k, (i, m) in enumerate(pairs)
    ])
    rows = F.array(*[
        F.struct(F.lit(i).alias("indicator"), F.lit(m).alias("metric"), F.col(f"c{k}.r").alias("r"), F.col(f"c{k}.n").alias("n"))
        for k, (i, m) in enumerate(pairs)
    ])
    grid = cells.select(F.explode(rows).alias("e")).select("e.*").where(F.col("n") >= min_n)
    tested = grid.withColumn("p", pearson_p_value("r", "n"))
    return tested.withColumn("interpretation", interpret_correlation(F.col("r"), F.col("p"))).orderBy(F.abs("r").desc(), "indicator", "metric")


def rank_agreement(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """Spearman correlation of two importance columns of a feature-sized table (largest first, name breaks ties)."""
    ranked = df.select(
        F.row_number().over(W.orderBy(x.desc(), "feature")).alias("rx"), F.row_number().over(W.orderBy(y.desc(), "feature")).alias("ry")
    )
    return ranked.agg(correlation("rx", "ry").alias("spearman"), F.count("*").alias("n"))


def mean_absolute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean |x| per column as (feature, importance), in one pass."""
    sums = df.agg(*[F.avg(F.abs(c)).alias(c) for c in columns])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in columns])).alias("e")).select("e.*")
