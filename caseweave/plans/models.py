"""Severity tiers, similarity search, risk models and attributions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave.operators import learning as ml
from caseweave.operators.aggregates import entropy, group_profile, rank_agreement
from caseweave.operators.history import horizon_label, latest_per_entity, with_eligibility
from caseweave.plans.base import PROPERTY, UNRESOLVED, VIOLENT, cases, table
from caseweave.plans.registry import cte, query
from caseweave.plans.timelines import HORIZON, case_history
from caseweave.session import materialise

NUMERIC = [
    "prior_case_count", "distinct_prior_categories", "prior_violent_count", "prior_property_count", "days_since_first_case",
    "current_is_violent", "current_is_property",
]


def severity_groups(spark, sf):
    df = cases(spark, sf)
    place = ["super_place", "place"]
    profile = group_profile(df, place, "category", "status", "amount", VIOLENT, PROPERTY, UNRESOLVED, 10)
    return profile.join(entropy(df, place, "category"), place)


@query("ml1_severity_tiers")
def _(spark, sf):
    features = ["total_cases", "violent_ratio", "property_ratio", "unresolved_ratio", "diversity"]
    tiers = ml.severity_tiers(severity_groups(spark, sf), ["super_place", "place"], "total_cases", "violent_ratio", features, 3)
    rounded = [F.round(c, 4).alias(c) for c in ("violent_ratio", "property_ratio", "unresolved_ratio", "diversity", "severity_score")]
    return tiers.select("super_place", "place", "total_cases", *rounded, F.round("avg_value", 2).alias("avg_value"), "pca_x", "pca_y", "severity_tier")


# requests: the first case of every place
cte("asked", "SELECT place AS rp, MIN(case_id) AS source FROM cases GROUP BY place", "cases")


@query("ml2_similar_cases", """SELECT source, case_id, similarity, CAST(rank AS INT) AS rank FROM (SELECT s.case_id AS source, c.case_id, ROUND(least(1.0, (CAST(c.category = s.category AS INT) + CAST(c.status = s.status AS INT) + CAST(c.segment = s.segment AS INT)) / 3.0
    + CAST(c.place = s.place AS INT) * 0.05 + CAST(c.super_place = s.super_place AS INT) * 0.02), 4) AS similarity, row_number() OVER (PARTITION BY s.case_id ORDER BY ROUND(least(1.0, (CAST(c.category = s.category AS INT) + CAST(c.status = s.status AS INT)
    + CAST(c.segment = s.segment AS INT)) / 3.0 + CAST(c.place = s.place AS INT) * 0.05 + CAST(c.super_place = s.super_place AS INT) * 0.02), 4) DESC, c.case_id) AS rank
    FROM asked JOIN cases s ON s.case_id = source JOIN cases c ON c.case_id <> s.case_id) WHERE rank <= 10""", ("asked", "cases"))
def _(spark, sf):
    df = materialise(cases(spark, sf).select("case_id", "category", "status", "segment", "place", "super_place"), "cases")
    asked = df.groupBy("place").agg(F.min("case_id").alias("case_id"))
    found = ml.similar_cases(df, asked, "case_id", ["category", "status", "segment"], "place", "super_place", 10)
    return found.select("source", "case_id", "similarity", "rank")


@query("ml3_nearest_vectors", """SELECT query, vec_id, ROUND(similarity, 4) AS similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS rank FROM
    (SELECT q.vec_id AS query, v.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS similarity
     FROM embeddings v JOIN (SELECT e.* FROM embeddings e JOIN (SELECT label AS l, MIN(vec_id) AS m FROM embeddings GROUP BY label) ON m = vec_id) q ON q.vec_id <> v.vec_id)) WHERE rank <= 5""")
def _(spark, sf):
    vectors = table(spark, sf, "embeddings")
    queries = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("vec_id"))
    found = ml.nearest_vectors(vectors, queries, "vec_id", "embedding", 5)
    return found.withColumn("similarity", F.round("similarity", 4))


def risk_rows(spark, sf):
    """Appearances with features, label and eligibility; one-hot of the customer's segment and place."""
    key = f"riskrows:{sf}"
    if key not in _CACHE or _CACHE[key][0] != spark.sparkContext.applicationId:
        rows = materialise(horizon_label(case_history(spark, sf), "entity_id", "case_date", HORIZON), "history")
        features = list(NUMERIC)
        for column in ("segment", "place"):
            keep = ml.top_categories(rows, column)
            rows = ml.one_hot(ml.bucket_rare(rows, column, keep), column, [*keep, "OTHER"], column)
            features += [f"{column}_{value}" for value in [*keep, "OTHER"]]
        rows = with_eligibility(rows, "case_date", HORIZON)
        _CACHE[key] = (spark.sparkContext.applicationId, materialise(rows, "riskrows"), features)
    return _CACHE[key][1], _CACHE[key][2]


def risk_models(spark, sf):
    key = f"models:{sf}"
    if key not in _CACHE or _CACHE[key][0] != spark.sparkContext.applicationId:
        rows, features = risk_rows(spark, sf)
        eligible = rows.where("eligible")
        models = ml.train_risk_models(eligible, features, "label", "entity_id")
        evaluation = materialise(ml.evaluate_risk_models(models, eligible, "label", "entity_id", "prior_case_count"), "evaluation")
        _CACHE[key] = (spark.sparkContext.applicationId, models, evaluation)
    return _CACHE[key][1], _CACHE[key][2]


# rows and models are written or fitted once per session and table folder
_CACHE: dict[str, tuple] = {}


def current_rows(spark, sf):
    rows, features = risk_rows(spark, sf)
    return latest_per_entity(rows, "entity_id", "case_date", "case_id"), features


def scored_people(spark, sf):
    models, evaluation = risk_models(spark, sf)
    rows, features = current_rows(spark, sf)
    rows = ml.evenly(materialise(rows.select("entity_id", *features), "currentrows"), ml.EXPLAIN_ROWS)
    scored = ml.score(models[ml.select_model(evaluation)], rows).withColumn("probability", F.round("probability", 4))
    return ml.risk_tiers(materialise(scored, "scored"), "probability")


@query("ml4_entity_split", """SELECT COUNT(DISTINCT entity_id) AS entities, COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS on_both_sides,
    COUNT(DISTINCT entity_id) >= 100 AS fair_share FROM cases""", ("cases",))
def _(spark, sf):
    """Rows of the two sides, joined again per entity; a fair share is 15 to 25 percent of the entities."""
    df = cases(spark, sf)
    held = ml.in_test_split(F.col("entity_id"))
    train, test = (df.where(side).groupBy("entity_id").agg(F.count("*").alias(name)) for side, name in ((~held, "train"), (held, "test")))
    both = train.join(test, "entity_id", "full")
    return both.agg(
        F.count("*").alias("entities"), F.sum(F.coalesce("train", F.lit(0)) + F.coalesce("test", F.lit(0))).alias("n_rows"),
        F.count_if(F.col("train").isNotNull() & F.col("test").isNotNull()).alias("on_both_sides"),
        (F.count("test") / F.count("*")).between(0.15, 0.25).alias("fair_share"),
    )


@query("ml5_model_comparison")
def _(spark, sf):
    return risk_models(spark, sf)[1]


@query("ml5_feature_importances")
def _(spark, sf):
    models, _ = risk_models(spark, sf)
    rows = [(name, feature, value) for name, model in models.items() for feature, value in ml.feature_importances(model)]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


@query("ml6_current_scores")
def _(spark, sf):
    return scored_people(spark, sf).select(
        "entity_id", (F.col("prior_case_count") + 1).alias("prior_case_count"), F.col("distinct_prior_categories").alias("distinct_types"), "probability", "risk_tier"
    )


@query("ml7_what_if")
def _(spark, sf):
    # every current profile, had there been three more violent cases
    models, _ = risk_models(spark, sf)
    rows, _ = current_rows(spark, sf)
    changed = rows.withColumns({c: F.col(c) + 3 for c in ("prior_case_count", "prior_violent_count")})
    now = ml.score(models["RANDOM_FOREST"], rows, "now").select("entity_id", "now")
    then = ml.score(models["RANDOM_FOREST"], changed, "then").select("entity_id", "then")
    return now.join(then, "entity_id").select("entity_id", F.round("now", 4).alias("now"), F.round("then", 4).alias("then"))


def explained_people(spark, sf):
    models, _ = risk_models(spark, sf)
    rows, features = current_rows(spark, sf)
    key = f"explained:{sf}"
    if key not in _CACHE or _CACHE[key][0] != spark.sparkContext.applicationId:
        explained = materialise(ml.attributions(models["RANDOM_FOREST"], rows, "entity_id"), "explained")
        ml.check_reconstruction(explained)
        _CACHE[key] = (spark.sparkContext.applicationId, explained)
    return _CACHE[key][1], features


@query("ml8_attributions", "SELECT DISTINCT entity_id, TRUE AS adds_up, TRUE AS attributed FROM cases", ("cases",))
def _(spark, sf):
    """For each entity, whether base and attributions add up to its probability, and whether it has any."""
    explained, _ = explained_people(spark, sf)
    total = F.aggregate("phi", F.lit(0.0), lambda s, x: s + x)
    largest = F.aggregate("phi", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    return explained.select("entity_id", (F.abs(F.col("base_value") + total - F.col("probability")) <= ml.TOLERANCE).alias("adds_up"), (largest > 0).alias("attributed"))


@query("ml9_top_drivers")
def _(spark, sf):
    explained, features = explained_people(spark, sf)
    top = explained.select("entity_id", "probability", F.posexplode(F.slice(ml.contributions(explained, features), 1, 5)).alias("rank", "d"))
    return top.select("entity_id", F.round("probability", 4).alias("probability"), "rank", "d.feature", "d.value", F.round("d.phi", 6).alias("phi"))


@query("ml9_explanation_sentences")
def _(spark, sf):
    from caseweave.functions.text import sentence_person_explain

    explained, features = explained_people(spark, sf)
    df = explained.select(
        "entity_id", F.concat(F.lit("C"), F.col("entity_id")).alias("person_id"), F.lit(None).cast("string").alias("full_name"), "probability",
        F.lit("HIGH").alias("risk_tier"), ml.contributions(explained, features).alias("drivers"),
    ).join(scored_people(spark, sf).select("entity_id", F.col("risk_tier").alias("tier")), "entity_id").withColumn("risk_tier", F.col("tier"))
    return df.select("entity_id", sentence_person_explain().alias("sentence"))


@query("ml10_global_importance")
def _(spark, sf):
    explained, features = explained_people(spark, sf)
    return ml.global_importance(explained, features).select("feature", F.round("importance", 6).alias("importance"))


@query("ml10_concordance")
def _(spark, sf):
    explained, features = explained_people(spark, sf)
    models, _ = risk_models(spark, sf)
    built_in = spark.createDataFrame(ml.feature_importances(models["RANDOM_FOREST"]), "feature string, built_in double")
    both = ml.global_importance(explained, features).join(built_in, "feature")
    return rank_agreement(both, F.col("importance"), F.col("built_in")).select(F.round("spearman", 4).alias("spearman"), "n")
