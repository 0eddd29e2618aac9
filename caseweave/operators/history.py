"""Prior-history features, horizon labels, censoring, staleness, percentile ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseweave.operators.scale import day_running_sums, global_running_sum, join_keys, top_per_group, total


def history_features(df: DataFrame, entity: str, case: str, date: str, category: str, violent: list[str], prop: list[str]) -> DataFrame:
    """Per appearance, what was known of the entity before it (order: date, case).

    Every feature is a running sum. A category counts as newly seen on its first
    row, found by one aggregation per (entity, category), so the number of distinct
    prior categories is a running sum as well. Rows without a category count as
    cases, not as a category.
    """
    firsts = df.where(F.col(category).isNotNull()).groupBy(entity, category).agg(F.min_by(case, F.struct(date, case)).alias("_first"))
    is_first = F.coalesce(F.col(case) == F.col("_first"), F.lit(False)).cast("int")
    marked = join_keys(df, firsts, [entity, category]).withColumn("_new", is_first).drop("_first")
    violent_now = F.coalesce(F.col(category).isin(violent), F.lit(False))
    property_now = F.coalesce(F.col(category).isin(prop), F.lit(False))
    run = day_running_sums(
        marked, [entity], date, [case],
        {
            "prior_case_count": F.lit(1), "distinct_prior_categories": F.col("_new"),
            "prior_violent_count": violent_now.cast("int"), "prior_property_count": property_now.cast("int"),
        },
        first_day="_start",
    )
    return (
        run
        .withColumn("days_since_first_case", F.date_diff(date, "_start"))
        .withColumn("current_is_violent", violent_now.cast("int"))
        .withColumn("current_is_property", property_now.cast("int"))
        .drop("_start", "_new")
    )


def horizon_label(df: DataFrame, entity: str, date: str, horizon: int, out: str = "label") -> DataFrame:
    """1 if the entity has a later event in (date, date + horizon]; same-day events do not count.

    Only the next distinct day matters, so the window runs over one row per entity and day.
    """
    days = df.select(entity, date).distinct()
    ahead = F.lead(date).over(W.partitionBy(entity).orderBy(date))
    labelled = days.withColumn(out, F.coalesce((F.date_diff(ahead, F.col(date)) <= horizon).cast("int"), F.lit(0)))
    return join_keys(df, labelled, [entity, date])


def with_eligibility(df: DataFrame, date: str, horizon: int) -> DataFrame:
    """Eligible rows have a full horizon before the last date of the data."""
    return df.withColumn("eligible", F.col(date) <= F.date_sub(total(df, F.max(date)), horizon))


def latest_per_entity(df: DataFrame, entity: str, date: str, case: str) -> DataFrame:
    return top_per_group(df, [entity], [F.col(date).desc(), F.col(case).desc()], 1, "_rk").drop("_rk")


def with_age(df: DataFrame, date: str, stale_days: int, reference: Column) -> DataFrame:
    """Age against the data's own last date, never the clock."""
    age = F.date_diff(reference, F.col(date))
    return df.withColumn("age_days", age).withColumn("stale_points", (age > stale_days).cast("int"))


def percentile_rank(groups: DataFrame, value: str, out: str = "percentile_rank") -> DataFrame:
    """Share of the valued groups whose value is at most mine; NULL for a group without a value."""
    known = groups.where(F.col(value).isNotNull())
    steps = known.groupBy(value).agg(F.count("*").alias("_n"))
    upto = global_running_sum(steps, [F.col(value)], F.col("_n"), "_upto")
    share = F.col("_upto") / total(known, F.count("*"))
    return join_keys(groups, upto.select(value, share.alias(out)), [value])


def severity_scores(groups: DataFrame, volume: str, ratio: str, out: str = "severity_score") -> DataFrame:
    """0.6 z(log1p volume) + 0.4 z(ratio), sample standard deviations."""
    logged = F.log1p(F.col(volume).cast("double"))

    def z(x: Column) -> Column:
        return F.try_divide(x - total(groups, F.avg(x)), total(groups, F.stddev_samp(x)))

    return groups.withColumn(out, z(logged) * 0.6 + z(F.col(ratio)) * 0.4)


def spike_alerts(df: DataFrame, group: list[str], date: str, recent_days: int, baseline_days: int, min_recent: int,
                 min_change: float = 50.0, limit: int | None = None) -> DataFrame:
    """Groups whose recent count beats the baseline rate; groups without a baseline come first."""
    from caseweave.functions.text import signed_percent_reason

    end = total(df, F.max(date))
    recent_start = F.date_sub(end, recent_days)
    baseline_start = F.date_sub(end, recent_days + baseline_days)
    counts = (
        df.where(F.col(date) > baseline_start).groupBy(*group).agg(
            F.count_if(F.col(date) > recent_start).alias("recent_count"),
            F.count_if(F.col(date) <= recent_start).alias("baseline_count"),
        ).where(F.col("recent_count") >= min_recent)
    )
    expected = F.nullif(F.col("baseline_count") * (recent_days / baseline_days), F.lit(0.0))
    scored = counts.withColumn("pct_change", F.round(F.try_divide((F.col("recent_count") - expected) * 100, expected), 1))
    alerts = scored.where(F.col("pct_change").isNull() | (F.col("pct_change") >= min_change)).withColumn(
        "reason", signed_percent_reason(F.col("pct_change"))
    )
    ordered = alerts.orderBy(F.col("pct_change").desc_nulls_first(), F.col("recent_count").desc(), *group)
    return ordered.limit(limit) if limit else ordered


def trend(df: DataFrame, bucket: str, domain: DataFrame | None = None) -> DataFrame:
    """Counts per bucket; with a fixed domain, empty buckets count 0."""
    counts = df.groupBy(bucket).agg(F.count("*").alias("n"))
    if domain is None:
        return counts
    return domain.join(counts, bucket, "left").select(bucket, F.coalesce("n", F.lit(0)).alias("n"))
