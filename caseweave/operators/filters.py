"""Filters, lookups, projections and attribute guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.functions.patterns import find_all
from caseweave.operators.scale import top_per_group
from caseweave.schemas import ROLE_RANK, TIME_BUCKETS


def within(column: Column, values: list) -> Column:
    """Set membership that is false, not NULL, for a missing value."""
    return F.coalesce(column.isin(values), F.lit(False))


def filter_cases(df: DataFrame, equals: dict[str, str] | None = None, contains: dict[str, str] | None = None,
                 date: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Optional conjunctive filter; absent conditions do not reach the plan."""
    for column, value in (equals or {}).items():
        df = df.where(F.col(column) == value)
    for column, value in (contains or {}).items():
        df = df.where(F.contains(F.lower(column), F.lit(value.lower())))
    if start:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col(date) <= F.lit(end).cast("date"))
    return df


def resolve_names(requests: DataFrame, request: str, names: DataFrame, name: str, key: list[Column], out: str = "resolved") -> DataFrame:
    """Exact match first, else substring match, ignoring case; one winner per request.

    The names are read once for all requests, which are searched in them together; any number of
    requests may be asked. A blank request finds nothing.
    """
    asked = requests.select(F.col(request)).distinct()
    hits = (
        find_all(names, name, asked, request, "_all").withColumn("_req", F.explode("_all")).drop("_all")
        .withColumn("_miss", F.when(F.lower(name) == F.lower("_req"), 0).otherwise(1))
    )
    best = top_per_group(hits, ["_req"], [F.col("_miss"), F.col(name), *key], 1, "_rk").drop("_rk", "_miss")
    return asked.join(best, F.col(request) == F.col("_req"), "left").drop("_req").withColumnRenamed(name, out)


def point_lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """Rows of one key; an empty frame means not found."""
    return df.where(F.col(key) == F.lit(value))


def lookup_status(requests: DataFrame, key: str, all_rows: DataFrame, queue: DataFrame, status: str) -> DataFrame:
    """missing / out_of_queue / present, with the stored status."""
    known = all_rows.select(key, F.col(status).alias("case_status"))
    queued = queue.select(key, F.lit(True).alias("_queued"))
    return (
        requests.select(key).distinct().join(known, key, "left").join(queued, key, "left")
        .withColumn("lookup", F.when(F.col("case_status").isNull(), "missing").when(F.col("_queued"), "present").otherwise("out_of_queue"))
        .drop("_queued")
    )


def drop_rollups(df: DataFrame, column: str, word: str = "total") -> DataFrame:
    return df.where(F.col(column).isNull() | ~F.contains(F.lower(column), F.lit(word)))


def edges_between(edges: DataFrame, min_weight: int, kept: DataFrame, key: str) -> DataFrame:
    """Edges above a weight whose two ends are both kept."""
    ids = kept.select(key).distinct()
    return (
        edges.where(F.col("weight") >= min_weight)
        .join(ids.select(F.col(key).alias("a")), "a", "left_semi")
        .join(ids.select(F.col(key).alias("b")), "b", "left_semi")
    )


def time_bucket(hour: Column) -> Column:
    bucket = F.lit(TIME_BUCKETS[-1][2])
    for start, end, label in reversed(TIME_BUCKETS):
        bucket = F.when((hour >= start) & (hour < end), label).otherwise(bucket)
    return bucket


def with_calendar(df: DataFrame, ts: str) -> DataFrame:
    hour = F.hour(ts)
    return df.withColumns({
        "hour": hour,
        "weekday": F.date_format(ts, "EEEE"),
        "month_bucket": F.date_format(ts, "yyyy-MM"),
        "time_bucket": time_bucket(hour),
    })


def share(part: Column, whole: Column) -> Column:
    """part / whole, null for a zero or missing denominator."""
    return F.try_divide(part.cast("double"), F.nullif(whole.cast("double"), F.lit(0.0)))


def tier(score: Column, cutoffs: list[tuple[float, str]], default: str = "LOW") -> Column:
    """Label of the first cutoff (highest first) that the score reaches."""
    label = F.lit(default)
    for cutoff, name in sorted(cutoffs, key=lambda c: c[0]):
        label = F.when(score >= cutoff, name).otherwise(label)
    return label


def require_allowed(names: list[str], allowed: list[str], forbidden: list[str] | None = None) -> None:
    """Raises before any plan is built if a column is not on the allow-list."""
    for name in names:
        if name not in allowed or name in (forbidden or []):
            raise ValueError(f"{name} may not be used here; allowed: {', '.join(allowed)}")


def allowed_projection(df: DataFrame, always: list[str], chosen: list[str], allowed: list[str]) -> DataFrame:
    require_allowed(chosen, allowed)
    return df.select(*always, *chosen)


def role_view(df: DataFrame, role: str, personal: list[str], minimum: str = "INVESTIGATOR") -> DataFrame:
    """Drops person-identifying columns for roles below ``minimum``."""
    if role not in ROLE_RANK:
        raise ValueError(f"unknown role {role}")
    return df if ROLE_RANK[role] >= ROLE_RANK[minimum] else df.drop(*personal)
