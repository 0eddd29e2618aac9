"""Windows, history features, spikes, trends and forecasts on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave.operators import history as hs
from caseweave.operators import series as sr
from caseweave.operators.scale import carry_forward, chunk_running_sum, total
from caseweave.plans.base import PROPERTY, VIOLENT, cases, table, year_span, yearly_series
from caseweave.plans.registry import cte, query
from caseweave.schemas import WEEKDAYS
from caseweave.session import materialise

HORIZON = 90
PLACE = ["super_place", "place"]
KEYS = [*PLACE, "series"]
HORIZON_YEARS = [2002, 2003, 2004]

cte("hist", """SELECT case_id, entity_id, case_date, category, row_number() OVER w - 1 AS prior_case_count,
    COUNT(*) FILTER (category IN ('1-URGENT','2-HIGH')) OVER p AS prior_violent_count, COUNT(*) FILTER (category IN ('2-HIGH','3-MEDIUM')) OVER p AS prior_property_count,
    (SELECT COUNT(DISTINCT c2.category) FROM cases c2 WHERE c2.entity_id = c.entity_id AND (c2.case_date < c.case_date OR (c2.case_date = c.case_date AND c2.case_id < c.case_id))) AS distinct_prior_categories,
    CAST(date_diff('day', MIN(case_date) OVER (PARTITION BY entity_id), case_date) AS INT) AS days_since_first_case
    FROM cases c WINDOW w AS (PARTITION BY entity_id ORDER BY case_date, case_id), p AS (PARTITION BY entity_id ORDER BY case_date, case_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", "cases")
cte("labelled", f"""SELECT case_id, entity_id, case_date, CAST(EXISTS (SELECT 1 FROM cases n WHERE n.entity_id = c.entity_id AND n.case_date > c.case_date
    AND n.case_date <= c.case_date + INTERVAL {HORIZON} DAY) AS INT) AS label FROM cases c""", "cases")


def case_history(spark, sf):
    return hs.history_features(
        cases(spark, sf).select("case_id", "entity_id", "case_date", "category", "place", "segment"),
        "entity_id", "case_id", "case_date", "category", VIOLENT, PROPERTY,
    )


@query("wn1_prior_history", "SELECT case_id, entity_id, prior_case_count, distinct_prior_categories, prior_violent_count, prior_property_count, days_since_first_case FROM hist", ("hist",))
def _(spark, sf):
    return case_history(spark, sf).select(
        "case_id", "entity_id", "prior_case_count", "distinct_prior_categories", "prior_violent_count", "prior_property_count", "days_since_first_case"
    )


@query("wn2_horizon_label", "SELECT case_id, entity_id, case_date, label FROM labelled", ("labelled",))
def _(spark, sf):
    return hs.horizon_label(cases(spark, sf).select("case_id", "entity_id", "case_date"), "entity_id", "case_date", HORIZON)


@query("wn3_censoring", f"SELECT case_id, case_date, case_date <= (SELECT MAX(case_date) FROM cases) - INTERVAL {HORIZON} DAY AS eligible FROM cases", ("cases",))
def _(spark, sf):
    return hs.with_eligibility(cases(spark, sf).select("case_id", "case_date"), "case_date", HORIZON)


@query("wn4_latest_per_entity", """SELECT entity_id, case_id, case_date, category FROM cases QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY case_date DESC, case_id DESC) = 1""", ("cases",))
def _(spark, sf):
    return hs.latest_per_entity(cases(spark, sf).select("entity_id", "case_id", "case_date", "category"), "entity_id", "case_date", "case_id")


@query("wn5_percentile_rank", "SELECT entity_id, n, ROUND(cume_dist() OVER (ORDER BY n), 6) AS percentile_rank FROM (SELECT entity_id, COUNT(*) AS n FROM cases GROUP BY entity_id)", ("cases",))
def _(spark, sf):
    volumes = cases(spark, sf).groupBy("entity_id").agg(F.count("*").alias("n"))
    return hs.percentile_rank(volumes, "n").select("entity_id", "n", F.round("percentile_rank", 6).alias("percentile_rank"))


@query("wn6_staleness", """SELECT case_id, CAST(date_diff('day', case_date, (SELECT MAX(case_date) FROM cases)) AS INT) AS age_days,
    CAST(date_diff('day', case_date, (SELECT MAX(case_date) FROM cases)) > 180 AS INT) AS stale_points FROM cases""", ("cases",))
def _(spark, sf):
    df = cases(spark, sf)
    return hs.with_age(df, "case_date", 180, total(df, F.max("case_date"))).select("case_id", "age_days", "stale_points")


cte("spike", """SELECT *, CASE WHEN baseline_count = 0 THEN NULL ELSE ROUND((recent_count - baseline_count * 0.5) * 100 / (baseline_count * 0.5), 1) END AS pct_change FROM
    (SELECT event_type, user_id, COUNT(*) FILTER (d > e - 7) AS recent_count, COUNT(*) FILTER (d > e - 21 AND d <= e - 7) AS baseline_count
     FROM (SELECT event_type, user_id, CAST(ts AS DATE) AS d, (SELECT MAX(CAST(ts AS DATE)) FROM events) AS e FROM events) GROUP BY ALL) WHERE recent_count >= 5""")


def event_days(spark, sf):
    return table(spark, sf, "events").select("event_type", "user_id", F.col("ts").cast("date").alias("day"))


@query("wn7_spikes", """SELECT event_type, user_id, recent_count, baseline_count, pct_change FROM spike WHERE pct_change IS NULL OR pct_change >= 50
    ORDER BY pct_change DESC NULLS FIRST, recent_count DESC, event_type, user_id LIMIT 30""", ("spike",))
def _(spark, sf):
    return hs.spike_alerts(event_days(spark, sf), ["event_type", "user_id"], "day", 7, 14, 5, limit=30).drop("reason")


@query("wn7_spikes_uncapped", """SELECT event_type, user_id, recent_count, baseline_count, pct_change,
    CASE WHEN pct_change IS NULL THEN 'new pattern: no comparable activity in the baseline period' ELSE printf('%+.0f%% vs. baseline-implied rate', pct_change) END AS reason
    FROM spike WHERE pct_change IS NULL OR pct_change >= 50""", ("spike",))
def _(spark, sf):
    return hs.spike_alerts(event_days(spark, sf), ["event_type", "user_id"], "day", 7, 14, 5, limit=None)


@query("wn8_hourly_trend", """SELECT printf('%02d:00', h) AS bucket, COUNT(event_id) AS n FROM (SELECT unnest(range(24)) AS h) LEFT JOIN events ON hour(ts) = h AND event_type = 'error' GROUP BY h""")
def _(spark, sf):
    hours = spark.range(24).select(F.format_string("%02d:00", "id").alias("bucket"))
    errors = table(spark, sf, "events").where(F.col("event_type") == "error").select(F.format_string("%02d:00", F.hour("ts")).alias("bucket"))
    return hs.trend(errors, "bucket", hours)


@query("wn8_weekday_trend", """SELECT w AS bucket, COUNT(event_id) AS n FROM (SELECT unnest(['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday']) AS w) LEFT JOIN events ON dayname(ts) = w GROUP BY w""")
def _(spark, sf):
    days = spark.createDataFrame([(d,) for d in WEEKDAYS], "bucket string")
    return hs.trend(table(spark, sf, "events").select(F.date_format("ts", "EEEE").alias("bucket")), "bucket", days)


@query("wn8_monthly_trend", "SELECT strftime(case_date, '%Y-%m') AS bucket, COUNT(*) AS n FROM cases GROUP BY 1", ("cases",))
def _(spark, sf):
    return hs.trend(cases(spark, sf).select(F.date_format("case_date", "yyyy-MM").alias("bucket")), "bucket")


@query("wn9_severity_score", """SELECT place, ROUND(0.6 * (ln(1 + total_cases) - AVG(ln(1 + total_cases)) OVER ()) / stddev_samp(ln(1 + total_cases)) OVER ()
    + 0.4 * (violent_ratio - AVG(violent_ratio) OVER ()) / stddev_samp(violent_ratio) OVER (), 6) AS severity_score FROM profiles""", ("profiles",))
def _(spark, sf):
    from caseweave.operators.aggregates import group_profile
    from caseweave.plans.base import UNRESOLVED

    p = materialise(group_profile(cases(spark, sf), PLACE, "category", "status", "amount", VIOLENT, PROPERTY, UNRESOLVED, 10), "profile")
    return hs.severity_scores(p, "total_cases", "violent_ratio").select("place", F.round("severity_score", 6).alias("severity_score"))


cte("long", """SELECT super_place, place, t, 'TOTAL' AS series, CAST(n_total AS DOUBLE) AS value FROM yearly UNION ALL SELECT super_place, place, t, 'VIOLENT', CAST(n_0 + n_1 AS DOUBLE) FROM yearly
    UNION ALL SELECT super_place, place, t, 'PROPERTY', CAST(n_1 + n_2 AS DOUBLE) FROM yearly""", "yearly")
cte("whole", "SELECT * FROM long WHERE (super_place, place) IN (SELECT (super_place, place) FROM yearly GROUP BY super_place, place HAVING COUNT(DISTINCT t) = (SELECT years FROM span))", "long", "span")
cte("trained", """SELECT super_place, place, series, arg_max(value, t) AS naive, AVG(value) FILTER (t > (SELECT last FROM span) - 5) AS moving, regr_slope(value, t) AS slope, regr_intercept(value, t) AS intercept
    FROM whole WHERE t <= (SELECT last FROM span) - 2 GROUP BY ALL""", "whole")
cte("refit", """SELECT super_place, place, series, arg_max(value, t) AS naive, AVG(value) FILTER (t > (SELECT last FROM span) - 3) AS moving, regr_slope(value, t) AS slope, regr_intercept(value, t) AS intercept, MAX(t) AS last_t
    FROM whole GROUP BY ALL""", "whole")
cte("tested", """SELECT super_place, place, series, AVG(ABS(value - naive)) AS mae_naive, AVG(ABS(value - moving)) AS mae_moving, AVG(ABS(value - greatest(0, slope * t + intercept))) AS mae_linear,
    AVG(ABS(value - naive) / NULLIF(value, 0)) * 100 AS mape_naive, AVG(ABS(value - moving) / NULLIF(value, 0)) * 100 AS mape_moving,
    AVG(ABS(value - greatest(0, slope * t + intercept)) / NULLIF(value, 0)) * 100 AS mape_linear FROM whole JOIN trained USING (super_place, place, series) WHERE t > (SELECT last FROM span) - 2 GROUP BY ALL""", "whole", "trained")
cte("picked", """SELECT *, CASE WHEN ROUND(mae_naive, 9) <= ROUND(mae_moving, 9) AND ROUND(mae_naive, 9) <= ROUND(mae_linear, 9) THEN 'NAIVE' WHEN ROUND(mae_moving, 9) <= ROUND(mae_linear, 9) THEN 'MOVING_AVERAGE' ELSE 'LINEAR_TREND' END AS selected_model FROM tested""", "tested")
_AT = "CASE selected_model WHEN 'NAIVE' THEN naive WHEN 'MOVING_AVERAGE' THEN moving ELSE greatest(0, slope * {y} + intercept) END"
cte("fcast", f"""SELECT super_place, place, series, selected_model, ROUND(least(mae_naive, mae_moving, mae_linear), 2) AS backtest_mae,
    CASE selected_model WHEN 'NAIVE' THEN mape_naive WHEN 'MOVING_AVERAGE' THEN mape_moving ELSE mape_linear END AS backtest_mape,
    ROUND(mae_naive, 2) AS naive_mae, ROUND(mae_moving, 2) AS moving_average_mae, ROUND(mae_linear, 2) AS linear_trend_mae, last_t, naive AS last_value,
    {', '.join(f'ROUND(ROUND({_AT.format(y=y)}, 9), 1) AS forecast_{y}' for y in HORIZON_YEARS)} FROM picked JOIN refit USING (super_place, place, series)""", "picked", "refit")


def long_series(spark, sf):
    wide = yearly_series(spark, sf)
    first, last = year_span(spark, sf)
    rows = sr.wide_to_series(wide, [*PLACE, "t"], {"TOTAL": ["n_total"], "VIOLENT": ["n_0", "n_1"], "PROPERTY": ["n_1", "n_2"]})
    return materialise(sr.complete_groups(rows, PLACE, "t", last - first + 1), "series")


def forecasts(spark, sf):
    last = year_span(spark, sf)[1]
    return sr.forecast(long_series(spark, sf), KEYS, "t", "value", last - 2, last, HORIZON_YEARS)


@query("wn10_wide_to_series", "SELECT * FROM long", ("long",))
def _(spark, sf):
    return sr.wide_to_series(yearly_series(spark, sf), [*PLACE, "t"], {"TOTAL": ["n_total"], "VIOLENT": ["n_0", "n_1"], "PROPERTY": ["n_1", "n_2"]})


@query("wn11_fit_models", "SELECT super_place, place, series, naive, ROUND(moving, 6) AS moving, ROUND(greatest(0, slope * ((SELECT last FROM span) - 1) + intercept), 6) AS linear_next FROM trained", ("trained",))
def _(spark, sf):
    last = year_span(spark, sf)[1]
    fitted = sr.fit_models(long_series(spark, sf), KEYS, "t", "value", last - 2)
    return fitted.select(*KEYS, "naive", F.round("moving", 6).alias("moving"), F.round(sr.predicted("LINEAR_TREND", F.lit(last - 1.0)), 6).alias("linear_next"))


@query("wn12_backtest", """SELECT super_place, place, series, ROUND(mae_naive, 4) AS mae_naive, ROUND(mae_moving, 4) AS mae_moving_average, ROUND(mae_linear, 4) AS mae_linear_trend,
    ROUND(mape_naive, 4) AS mape_naive, ROUND(mape_moving, 4) AS mape_moving_average, ROUND(mape_linear, 4) AS mape_linear_trend FROM tested""", ("tested",))
def _(spark, sf):
    last = year_span(spark, sf)[1]
    tested = sr.backtest(long_series(spark, sf), KEYS, "t", "value", last - 2, last)
    return tested.select(*KEYS, *[F.round(c, 4).alias(c) for c in tested.columns if c.startswith("ma")])


@query("wn13_forecast", "SELECT * REPLACE (ROUND(backtest_mape, 4) AS backtest_mape) FROM fcast", ("fcast",))
def _(spark, sf):
    return forecasts(spark, sf).withColumn("backtest_mape", F.round("backtest_mape", 4))


@query("wn14_forecast_change", "SELECT super_place, place, series, ROUND((forecast_2003 - last_value) * 100 / NULLIF(last_value, 0), 4) AS pct_change FROM fcast", ("fcast",))
def _(spark, sf):
    return sr.with_change(forecasts(spark, sf), "forecast_2003").select(*KEYS, F.round("pct_change", 4).alias("pct_change"))


@query("ag22_backtest_summary", """SELECT COUNT(*) AS n_series, COUNT(*) FILTER (selected_model = 'NAIVE') AS wins_naive, COUNT(*) FILTER (selected_model = 'MOVING_AVERAGE') AS wins_moving_average,
    COUNT(*) FILTER (selected_model = 'LINEAR_TREND') AS wins_linear_trend, ROUND(AVG(naive_mae), 2) AS mean_mae_naive, ROUND(AVG(moving_average_mae), 2) AS mean_mae_moving_average,
    ROUND(AVG(linear_trend_mae), 2) AS mean_mae_linear_trend, COUNT(*) FILTER (selected_model <> 'NAIVE') AS naive_beaten, ROUND(COUNT(*) FILTER (selected_model <> 'NAIVE') * 100.0 / COUNT(*), 1) AS naive_beaten_pct FROM fcast""", ("fcast",))
def _(spark, sf):
    return sr.backtest_summary(forecasts(spark, sf))


@query("tk2_rank_by_change", """SELECT place, series, last_value, forecast_2003, ROUND((forecast_2003 - last_value) * 100 / NULLIF(last_value, 0), 2) AS pct_change FROM fcast WHERE series = 'TOTAL' AND last_value <> 0
    ORDER BY (forecast_2003 - last_value) * 100 / last_value DESC, super_place, place LIMIT 20""", ("fcast",))
def _(spark, sf):
    ranked = sr.rank_by_change(sr.with_change(forecasts(spark, sf), "forecast_2003"), "TOTAL", PLACE, limit=20)
    return ranked.select("place", "series", "last_value", "forecast_2003", F.round("pct_change", 2).alias("pct_change"))


@query("wn15_running_block_id", "SELECT conv_id, turn, CAST(SUM(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS block FROM conversations")
def _(spark, sf):
    msgs = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("role") == "user").cast("int").alias("starts"))
    return chunk_running_sum(msgs, ["conv_id"], "turn", "starts", "block").drop("starts")


# A mention is the first capital followed by at least eight plain letters (person) and
# the first number (place): the text is invented, so the rules are parameters.
PERSON_RULE = "[A-Z][a-z]{8,}"
PLACE_RULE = "[0-9]{1,6}"
cte("mention", r"""SELECT conv_id, turn, role, text, NULLIF(regexp_extract(text, '[A-Z][a-z]{8,}', 0), '') AS person, NULLIF(regexp_extract(text, '[0-9]{1,6}', 0), '') AS place FROM conversations""")
cte("carried", """SELECT *, last_value(person IGNORE NULLS) OVER w AS prev_person, last_value(place IGNORE NULLS) OVER w AS prev_place FROM mention
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", "mention")


def mentions(df):
    def found(rule):
        return F.nullif(F.regexp_extract("text", rule, 0), F.lit(""))

    return df.select("conv_id", "turn", "role", "text", found(PERSON_RULE).alias("person"), found(PLACE_RULE).alias("place"))


@query("wn16_carry_context", "SELECT conv_id, turn, person, place, prev_person, prev_place FROM carried", ("carried",))
def _(spark, sf):
    m = mentions(table(spark, sf, "conversations")).drop("role", "text")
    return carry_forward(m, ["conv_id"], "turn", ["person", "place"])
