"""Back-tested forecasts for many short series at once.

Input is long: (group..., series, t, value), one row per period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.operators.scale import join_keys

# fixed order, used to break ties in the back-test error
MODELS = ["NAIVE", "MOVING_AVERAGE", "LINEAR_TREND"]


def wide_to_series(df: DataFrame, keys: list[str], series: dict[str, list[str]]) -> DataFrame:
    """Sums of wide columns per named series, in long form."""
    entries = [
        F.struct(F.lit(name).alias("series"), sum((F.coalesce(F.col(c), F.lit(0)) for c in cols), F.lit(0)).cast("double").alias("value"))
        for name, cols in series.items()
    ]
    return df.select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.series", "e.value")


def complete_groups(df: DataFrame, group: list[str], t: str, periods: int) -> DataFrame:
    """Rows of the groups that have exactly ``periods`` distinct periods."""
    full = df.select(*group, t).distinct().groupBy(*group).agg(F.count("*").alias("_k")).where(F.col("_k") == periods)
    return join_keys(df, full, group).where(F.col("_k").isNotNull()).select(*df.columns)


def fit_models(df: DataFrame, keys: list[str], t: str, value: str, last: int, window: int = 3, prefix: str = "") -> DataFrame:
    """Parameters of the three models from the rows with t <= last, in one aggregation.

    ``last`` is the final period of a complete history, so the moving average is a
    conditional mean over the last ``window`` periods.
    """
    rows = df.where(F.col(t) <= last)
    return rows.groupBy(*keys).agg(
        F.max_by(value, t).alias(f"{prefix}naive"),
        F.avg(F.when(F.col(t) > last - window, F.col(value))).alias(f"{prefix}moving"),
        F.regr_slope(value, t).alias(f"{prefix}slope"),
        F.regr_intercept(value, t).alias(f"{prefix}intercept"),
        F.max(t).alias(f"{prefix}last_t"),
    )


def predicted(model: str, t: Column, prefix: str = "") -> Column:
    return {
        "NAIVE": F.col(f"{prefix}naive"),
        "MOVING_AVERAGE": F.col(f"{prefix}moving"),
        "LINEAR_TREND": F.greatest(F.lit(0.0), F.col(f"{prefix}slope") * t + F.col(f"{prefix}intercept")),
    }[model]


def backtest(df: DataFrame, keys: list[str], t: str, value: str, train_end: int, test_end: int) -> DataFrame:
    """Hold-out MAE and MAPE per model, one row per series (columns mae_*, mape_*)."""
    fitted = fit_models(df, keys, t, value, train_end)
    held = join_keys(df.where((F.col(t) > train_end) & (F.col(t) <= test_end)), fitted, keys).where(F.col("last_t").isNotNull())
    measures = []
    for model in MODELS:
        miss = F.abs(F.col(value) - predicted(model, F.col(t)))
        measures.append(F.avg(miss).alias(f"mae_{model.lower()}"))
        measures.append((F.avg(F.try_divide(miss, F.nullif(F.col(value), F.lit(0.0)))) * 100).alias(f"mape_{model.lower()}"))
    return held.groupBy(*keys).agg(*measures)


def select_model(tested: DataFrame) -> DataFrame:
    """Lowest MAE; on ties the earlier model of ``MODELS``.

    Errors are compared at nine decimals, so that equal errors tie whatever the
    order of summation.
    """
    best = F.least(*[F.round(f"mae_{m.lower()}", 9) for m in MODELS])
    chosen, mape = F.lit(None), F.lit(None)
    for model in reversed(MODELS):
        hit = F.round(f"mae_{model.lower()}", 9) == best
        chosen = F.when(hit, F.lit(model)).otherwise(chosen)
        mape = F.when(hit, F.col(f"mape_{model.lower()}")).otherwise(mape)
    return tested.withColumns({"selected_model": chosen, "backtest_mae": best, "backtest_mape": mape})


def forecast(df: DataFrame, keys: list[str], t: str, value: str, train_end: int, test_end: int, horizon: list[int]) -> DataFrame:
    """Select per series on the hold-out, refit on the full history, forecast ``horizon``."""
    chosen = select_model(backtest(df, keys, t, value, train_end, test_end))
    full = fit_models(df, keys, t, value, test_end, prefix="full_")
    both = join_keys(chosen, full, keys)

    def value_at(period: int) -> Column:
        result = F.lit(None)
        for model in MODELS:
            result = F.when(F.col("selected_model") == model, predicted(model, F.lit(float(period)), "full_")).otherwise(result)
        # at nine decimals first, so that halves round alike whatever the order of summation
        return F.round(F.round(result, 9), 1)

    return both.select(
        *keys, "selected_model",
        F.round("backtest_mae", 2).alias("backtest_mae"), "backtest_mape",
        *[F.round(f"mae_{m.lower()}", 2).alias(f"{m.lower()}_mae") for m in MODELS],
        F.col("full_last_t").alias("last_t"), F.col("full_naive").alias("last_value"),
        *[value_at(p).alias(f"forecast_{p}") for p in horizon],
    )


def with_change(forecasts: DataFrame, column: str) -> DataFrame:
    """Percent change against the last observed value; null when that is 0."""
    return forecasts.withColumn(
        "pct_change", F.try_divide((F.col(column) - F.col("last_value")) * 100, F.nullif(F.col("last_value"), F.lit(0.0)))
    )


def backtest_summary(forecasts: DataFrame) -> DataFrame:
    wins = [F.count_if(F.col("selected_model") == m).alias(f"wins_{m.lower()}") for m in MODELS]
    errors = [F.round(F.avg(f"{m.lower()}_mae"), 2).alias(f"mean_mae_{m.lower()}") for m in MODELS]
    beaten = F.count_if(F.col("selected_model") != MODELS[0])
    return forecasts.agg(
        F.count("*").alias("n_series"), *wins, *errors, beaten.alias("naive_beaten"),
        F.coalesce(F.round(F.try_divide(beaten * 100.0, F.count("*")), 1), F.lit(0.0)).alias("naive_beaten_pct"),
    )


def rank_by_change(forecasts: DataFrame, series: str, keys: list[str], ascending: bool = False, limit: int | None = None) -> DataFrame:
    rows = forecasts.where((F.col("series") == series) & F.col("pct_change").isNotNull())
    order = F.col("pct_change").asc() if ascending else F.col("pct_change").desc()
    ordered = rows.orderBy(order, *keys)
    return ordered.limit(limit) if limit else ordered
