import datetime as dt
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseweave.functions import geo
from caseweave.functions import text as tx
from caseweave.operators import aggregates as ag
from caseweave.operators import filters as flt
from caseweave.operators import history as hs
from caseweave.operators import learning as ml
from caseweave.operators import risk, series
from caseweave.plans import models as plan
from caseweave.schemas import CONTEXT_ONLY
from caseweave.sources import readers, sinks


def d(s):
    return dt.date.fromisoformat(s)


def test_history_uses_only_the_past_and_breaks_day_ties_by_case(spark):
    rows = [("p", 1, d("2020-01-01"), "MURDER"), ("p", 2, d("2020-01-01"), "THEFT"), ("p", 3, d("2020-03-01"), "THEFT"), ("q", 4, d("2020-12-31"), "THEFT")]
    df = spark.createDataFrame(rows, "person string, fir long, day date, kind string")
    h = {r.fir: r for r in hs.history_features(df, "person", "fir", "day", "kind", ["MURDER"], ["THEFT"]).collect()}
    assert [h[i].prior_case_count for i in (1, 2, 3)] == [0, 1, 2]
    assert [h[i].distinct_prior_categories for i in (1, 2, 3)] == [0, 1, 2]
    assert [h[i].prior_violent_count for i in (1, 2, 3)] == [0, 1, 1] and h[3].days_since_first_case == 60
    blank = df.unionByName(spark.createDataFrame([("q", 5, d("2021-01-05"), None)], df.schema))
    kept = {r.fir: r for r in hs.history_features(blank, "person", "fir", "day", "kind", ["MURDER"], ["THEFT"]).collect()}
    assert len(kept) == 5 and kept[5].prior_case_count == 1 and kept[5].distinct_prior_categories == 1 and kept[5].current_is_violent == 0
    labels = {r.fir: r.label for r in hs.horizon_label(df, "person", "day", 59).collect()}
    assert labels == {1: 0, 2: 0, 3: 0, 4: 0}
    assert {r.fir: r.label for r in hs.horizon_label(df, "person", "day", 60).collect()} == {1: 1, 2: 1, 3: 0, 4: 0}
    assert {r.fir: r.eligible for r in hs.with_eligibility(df, "day", 365).collect()} == {1: True, 2: True, 3: False, 4: False}


def test_spikes_put_new_patterns_first(spark):
    end = d("2024-01-31")
    rows = [("new", end)] * 5 + [("up", end)] * 9 + [("up", end - dt.timedelta(days=10))] * 6 + [("flat", end)] * 6 + [("flat", end - dt.timedelta(days=10))] * 10
    got = hs.spike_alerts(spark.createDataFrame(rows, "g string, day date"), ["g"], "day", 7, 14, 5).collect()
    assert [(r.g, r.pct_change) for r in got] == [("new", None), ("up", 200.0)]
    assert got[1].reason == "+200% vs. baseline-implied rate"


def test_forecast_selection_and_zero_handling(spark):
    lines = {"flat": [5] * 6, "up": [1, 2, 3, 4, 5, 6], "down": [9, 7, 5, 3, 1, 0], "zero": [3, 2, 1, 1, 0, 0]}
    rows = [(k, "TOTAL", 2000 + i, float(v)) for k, vs in lines.items() for i, v in enumerate(vs)] + [("gap", "TOTAL", 2000, 1.0)]
    df = series.complete_groups(spark.createDataFrame(rows, "place string, series string, t int, value double"), ["place"], "t", 6)
    out = {r.place: r for r in series.with_change(series.forecast(df, ["place", "series"], "t", "value", 2003, 2005, [2006, 2007]), "forecast_2007").collect()}
    assert "gap" not in out and out["flat"].selected_model == "NAIVE" and out["up"].selected_model == "LINEAR_TREND"
    assert out["up"].forecast_2006 == 7.0 and out["down"].forecast_2007 >= 0 and out["zero"].pct_change is None and out["zero"].backtest_mape is None
    for r in out.values():
        assert r.backtest_mae <= min(r.naive_mae, r.moving_average_mae, r.linear_trend_mae) + 1e-9
    ranked = series.rank_by_change(series.with_change(series.forecast(df, ["place", "series"], "t", "value", 2003, 2005, [2006, 2007]), "forecast_2007"), "TOTAL", ["place"])
    assert "zero" not in [r.place for r in ranked.collect()]


def test_one_sided_accounts_and_evaluation(spark):
    tx_rows = [("a", "b", 10.0, "X", 1), ("a", "c", 5.0, "Y", 0), ("d", "a", 15.0, "X", 0)]
    tx_df = spark.createDataFrame(tx_rows, "from_id string, to_id string, amount_paid double, payment_currency string, label int").withColumns(
        {"amount_received": F.col("amount_paid"), "receiving_currency": F.col("payment_currency")}
    )
    f = ag.account_features(tx_df)
    by = {r.account_id: r for r in f.collect()}
    assert (by["a"].out_degree, by["a"].in_degree, by["a"].distinct_currencies) == (2, 1, 2) and by["c"].out_amount == 0 and by["b"].is_labelled
    scored = risk.apply_rules(f, risk.rule_thresholds(f))
    assert all(r.risk_score == sum(int(r[x]) for x in risk.FLAGS) and not r.flag_rapid_passthrough for r in scored.collect())
    high, loose = risk.evaluate_rules(scored).collect()
    assert loose.recall >= high.recall and 0 <= loose.precision <= 1


def test_guards(spark):
    df = spark.createDataFrame([(1, 0.1, 0.2)], "place long, literacy_rate double, hindu_share double")
    for name in CONTEXT_ONLY:
        with pytest.raises(ValueError):
            ag.correlation_grid(df, [name], ["violent_ratio"])
        with pytest.raises(ValueError):
            flt.allowed_projection(df, ["place"], [name], ["literacy_rate"])
    assert "hindu_share" not in flt.role_view(df, "ANALYST", ["hindu_share"]).columns
    assert "hindu_share" in flt.role_view(df, "ADMIN", ["hindu_share"]).columns
    with pytest.raises(ValueError):
        flt.role_view(df, "GUEST", [])


def test_constant_indicator_has_no_correlation(spark):
    df = spark.createDataFrame([(float(i), 1.0, float(i % 7)) for i in range(20)], "literacy_rate double, urbanization_rate double, violent_ratio double")
    grid = {r.indicator: r for r in ag.correlation_grid(df, ["literacy_rate", "urbanization_rate"], ["violent_ratio"]).collect()}
    assert grid["urbanization_rate"].r is None and grid["urbanization_rate"].interpretation is None and grid["literacy_rate"].interpretation


def test_small_expressions(spark):
    one = spark.range(1)
    p = one.select(ag.pearson_p_value(F.lit(0.5), F.lit(20)).alias("p"), ag.pearson_p_value(F.lit(0.2), F.lit(500)).alias("q")).first()
    assert p.p == pytest.approx(0.024769, abs=1e-5) and p.q == pytest.approx(6.57e-6, rel=0.01)
    row = one.select(
        tx.normalise_place(F.lit("Pune (city) Commr. Rural")).alias("a"), tx.normalise_super_place(F.lit("andaman & nicobar islands")).alias("b"),
        geo.haversine_km(F.lit(12.9716), F.lit(77.5946), F.lit(12.2958), F.lit(76.6394)).alias("km"), tx.classify(F.lit("Why is this person high risk?")).alias("i"),
        ml.attribute_similarity([(F.lit("x"), F.lit("x")), (F.lit(None), F.lit(None)), (F.lit("t"), F.lit("u"))], F.lit(True), F.lit(True)).alias("s"),
    ).first()
    assert row.a == "PUNE" and row.b == "A AND N ISLANDS" and 125 < row.km < 130 and row.i == "person_explain" and row.s == pytest.approx(2 / 3 + 0.07)
    mix = {r.g: r.diversity for r in ag.entropy(spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y")], "g string, k string"), ["g"], "k").collect()}
    assert mix["a"] == 0.0 and mix["b"] == pytest.approx(1.0)


def test_block_log(spark, tmp_path):
    line = "2022/09/01 00:06,1,A{0},2,B{0},10.5,USD,10.5,USD,ACH,1"
    text = ["noise", line.format(0), "BEGIN LAUNDERING ATTEMPT - FAN-OUT:  Max 3-degree", line.format(1), line.format(2), "bad,line", "END LAUNDERING ATTEMPT",
            line.format(9), "BEGIN LAUNDERING ATTEMPT - CYCLE", line.format(3), "BEGIN LAUNDERING ATTEMPT - STACK: x", "", "END LAUNDERING ATTEMPT - STACK"]
    (tmp_path / "log.txt").write_text("\r\n".join(text))
    rows = {r.pattern_id: r for r in readers.summarise_blocks(*readers.read_block_log(spark, str(tmp_path))).collect()}
    assert set(rows) == {"PAT-0001", "PAT-0003"}
    first = rows["PAT-0001"]
    assert (first.typology, first.descriptor, first.n_transactions, first.n_accounts, first.total_paid) == ("FAN-OUT", "Max 3-degree", 2, 4, 21.0)
    assert rows["PAT-0003"].n_transactions == 0


def test_ids_stay_text_and_empty_csv_keeps_header(spark, tmp_path):
    df = spark.createDataFrame([("103541451202000002", ["B", "A"])], "fir_id string, kinds array<string>")
    sinks.write_csv(df, str(tmp_path / "a"))
    assert readers.read_csv(spark, str(tmp_path / "a"), "fir_id string, kinds string").first() == ("103541451202000002", "B|A")
    sinks.write_csv(df.limit(0), str(tmp_path / "b"))
    assert any("fir_id" in f.read_text() for f in (tmp_path / "b").glob("*.csv"))


@pytest.fixture(scope="module")
def forest(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, x), int(x[0] + x[1] * x[2] + rng.normal() * 0.3 > 0.9)) for i, x in enumerate(rng.random((400, 4)))]
    df = spark.createDataFrame(rows, "person long, f0 double, f1 double, f2 double, f3 double, label int").cache()
    models = ml.train_risk_models(df, ["f0", "f1", "f2", "f3"], "label", "person", trees=5, depth=4)
    return df, models


def test_attributions_match_subset_definition(spark, forest):
    df, models = forest
    names = ["f0", "f1", "f2", "f3"]
    explained = ml.attributions(models["RANDOM_FOREST"], df.limit(3), "person").cache()
    assert ml.check_reconstruction(explained) < 1e-9
    trees, _ = ml.forest_leaves(models["RANDOM_FOREST"], spark)

    def value(x, known):
        total = 0.0
        for leaves in trees:
            for v, box in leaves:
                for f, (low, high, share) in box.items():
                    v *= (float(low < x[f] <= high) if f in known else share)
                total += v
        return total / len(trees)

    for r in explained.collect():
        for i in range(4):
            others = [j for j in range(4) if j != i]
            phi = sum(
                factorial(len(s)) * factorial(3 - len(s)) / 24 * (value(r.x, {*s, i}) - value(r.x, set(s)))
                for k in range(4) for s in combinations(others, k)
            )
            assert r.phi[i] == pytest.approx(phi, abs=1e-9)
    top = explained.select(ml.contributions(explained, names).alias("c")).first().c
    assert [abs(c.phi) for c in top] == sorted((abs(c.phi) for c in top), reverse=True)


def test_model_split_evaluation_and_tiers(spark, forest):
    df, models = forest
    evaluation = ml.evaluate_risk_models(models, df.withColumn("prior", F.lit(1)), "label", "person", "prior")
    rows = {r.rule: r for r in evaluation.collect()}
    assert rows["BASELINE_PRIOR_CASE_RULE"].recall == 1.0 and ml.select_model(evaluation) in models and rows["RANDOM_FOREST"].roc_auc > 0.7
    tiers = ml.risk_tiers(ml.score(models["RANDOM_FOREST"], df), "probability").groupBy("risk_tier").count().collect()
    assert sum(r["count"] for r in tiers) == 400 and {r.risk_tier for r in tiers} == {"LOW", "MEDIUM", "HIGH"}


def test_severity_tiers_rank_by_score(spark):
    rows = [(f"p{i}", n, v, v / 2) for i, (n, v) in enumerate([(10, 0.1), (12, 0.12), (11, 0.09), (100, 0.4), (110, 0.42), (90, 0.41), (1000, 0.9), (1100, 0.88), (900, 0.91)])]
    df = spark.createDataFrame(rows, "place string, n long, v double, w double")
    out = {r.place: r for r in ml.severity_tiers(df, ["place"], "n", "v", ["n", "v", "w"], 3).collect()}
    assert [out[f"p{i}"].severity_tier for i in range(9)] == ["LOW"] * 3 + ["MEDIUM"] * 3 + ["HIGH"] * 3
    assert ml.severity_tiers(df.limit(2), ["place"], "n", "v", ["n", "v", "w"], 3).count() == 0


def test_attributions_of_deep_paths(spark):
    """Leaves on paths of 16 features add up to the value of the box a row falls in, and agree with all subsets on a short path."""
    rng = np.random.default_rng(8)
    leaves = [(float(rng.random()), {f: (0.3, 1.0, float(rng.uniform(0.2, 0.9))) for f in range(16)}), (0.4, {0: (-np.inf, 0.3, 0.5), 3: (0.1, 0.9, 0.25)})]
    x = rng.random((50, 16))
    phi = ml.attribute_rows(x, [ml.pack_tree(leaves)])

    def value(row, known):
        return sum(v * np.prod([float(lo < row[f] <= hi) if f in known else s for f, (lo, hi, s) in box.items()]) for v, box in leaves)

    for row, p in zip(x, phi):
        assert p.sum() == pytest.approx(value(row, set(range(16))) - value(row, set()))
    both = [(0.4, {0: (-np.inf, 0.3, 0.5), 3: (0.1, 0.9, 0.25)})]
    one = ml.attribute_rows(x[:1], [ml.pack_tree(both)])[0, 0]
    a, b = (float(lo < x[0][f] <= hi) for f, (lo, hi, _) in both[0][1].items())
    assert one == pytest.approx(0.4 * ((a - 0.5) * 0.25 + (a * b - 0.5 * b)) / 2)


def test_training_and_attribution_tasks_hold_few_rows(spark, forest, monkeypatch):
    """However few bytes a row takes, no task gets many more rows than asked for."""
    monkeypatch.setattr(ml, "FIT_ROWS", 300, raising=False)
    monkeypatch.setattr(ml, "EXPLAIN_ROWS", 300, raising=False)
    rows = spark.range(0, 6_000, 1, 1).select(F.col("id").alias("person"), *[(F.col("id") % (i + 2)).cast("double").alias(f"f{i}") for i in range(4)], (F.col("id") % 3 == 0).cast("int").alias("label"))

    def largest(df):
        return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())

    given = []
    with monkeypatch.context() as m:
        m.setattr(ml.Pipeline, "fit", lambda self, df: given.append(df))
        ml.train_risk_models(rows, ["f0", "f1", "f2", "f3"], "label", "person")
    assert len(given) == 2 and all(largest(df) < 600 for df in given)
    explained = ml.attributions(forest[1]["RANDOM_FOREST"], rows, "person")
    assert explained.count() == 6_000 and largest(explained) < 600


def test_rows_a_tree_cannot_tell_apart_are_worked_out_once():
    rng = np.random.default_rng(4)
    leaves = [(float(rng.random()), {f: (0.3, 0.7 + f / 1000, 0.4) for f in range(s, 60, 3)}) for s in range(3)]
    for trees in ([ml.pack_tree(leaves)], [ml.pack_tree([(0.4, {0: (-np.inf, 0.3, 0.5), 3: (0.1, 0.9, 0.25)}), (0.2, {0: (0.3, np.inf, 0.5)})])]):
        x = rng.choice([0.1, 0.3, 0.5, 0.9, 1.0], (200, 60))
        first, same = ml.alike(np.concatenate([x, x + 1e-9 * (x == 0.5)]), *trees[0][:3])
        assert len(first) <= 200 and np.array_equal(same[:200], same[200:])
        assert np.allclose(ml.attribute_rows(x, trees), np.concatenate([ml.attribute_rows(row[None], trees) for row in x]), rtol=0, atol=1e-15)
    assert len(first) <= 12


def test_a_forest_draws_units_of_alike_rows_with_all_their_weight(spark, monkeypatch):
    monkeypatch.setattr(ml, "FOREST_UNITS", 200)
    kinds = spark.range(50).select((F.col("id") % 7).alias("f0"), "id", F.lit(1).alias("label"), F.lit(2.0).alias("class_weight"), F.when(F.col("id") == 0, 5_000).otherwise(F.col("id")).cast("long").alias("_n"))
    total = kinds.agg(F.sum("_n")).first()[0]
    cut = ml.units(kinds, total)
    got = {r["id"]: r for r in cut.groupBy("id").agg(F.sum("class_weight").alias("w"), F.max("class_weight").alias("m"), F.count("*").alias("k")).collect()}
    want = {r["id"]: r["_n"] for r in kinds.collect()}
    assert all(got[i]["w"] == pytest.approx(2.0 * n) for i, n in want.items() if n) and cut.count() <= 250
    assert max(r["m"] for r in got.values()) <= 2.0 * -(-total // 200) and got[0]["k"] > 100 and got[1]["k"] == 1


def test_rows_a_forest_cannot_tell_apart_are_attributed_once(spark, forest, monkeypatch):
    written, materialise = {}, ml.materialise
    monkeypatch.setattr(ml, "materialise", lambda df, label: written.setdefault(label, materialise(df, label)))
    df, models = forest
    model, names = models["RANDOM_FOREST"], models["RANDOM_FOREST"].stages[0].getInputCols()
    many = df.limit(40).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(24)))).withColumn("person", F.concat_ws("-", F.col("person").cast("string"), "copy"))
    explained = ml.attributions(model, many, "person")
    rows = explained.collect()
    assert len(rows) == 1_000 and written["kinds"].count() <= 40
    trees = [ml.pack_tree(leaves) for leaves in ml.forest_leaves(model, spark)[0]]
    assert np.allclose(ml.attribute_rows(np.array([r["x"] for r in rows]), trees), [r["phi"] for r in rows])
    direct = {tuple(float(r[c]) for c in names): r["p"] for r in ml.score(model, df.limit(40), "p").collect()}
    assert all(direct[tuple(r["x"])] == pytest.approx(r["probability"]) for r in rows)


def test_alike_rows_are_evaluated_once_and_count_as_often_as_they_occur(spark, forest, monkeypatch):
    written, materialise = {}, ml.materialise
    monkeypatch.setattr(ml, "materialise", lambda df, label: written.setdefault(label, materialise(df, label)))
    df, models = forest
    models = {"RANDOM_FOREST": models["RANDOM_FOREST"]}
    many = df.withColumn("prior", F.when(F.col("f0") > 0.5, F.col("label"))).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("label") * 5 + 1)))
    got = {r.rule: r for r in ml.evaluate_risk_models(models, many, "label", "person", "prior").collect()}
    different = df.where(ml.in_test_split(F.col("person"))).count()
    assert all(held.count() <= different for held in written.values())
    rows = ml.score(models["RANDOM_FOREST"], many.where(ml.in_test_split(F.col("person")))).select("label", "prior", "probability").collect()
    for rule, flag in (("RANDOM_FOREST", lambda r: r.probability >= 0.5), ("BASELINE_PRIOR_CASE_RULE", lambda r: r.prior is not None and r.prior >= 1)):
        flagged = [r.label for r in rows if flag(r)]
        assert (got[rule].flagged, got[rule].tp) == (len(flagged), sum(flagged))
    assert got["RANDOM_FOREST"].fn == sum(r.label for r in rows if r.probability < 0.5)
    good, bad = ([r.probability for r in rows if r.label == v] for v in (1, 0))
    assert got["RANDOM_FOREST"].roc_auc == pytest.approx(sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / len(good) / len(bad), abs=1e-4)


def test_a_forest_draws_its_bags_row_by_row_at_any_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(ml, "FOREST_UNITS", 50, raising=False)
    rows = spark.range(1_000).select(F.col("id").alias("person"), (F.col("id") % 5).cast("double").alias("f0"), (F.col("id") % 2).cast("int").alias("label"))
    given = []
    with monkeypatch.context() as m:
        m.setattr(ml.Pipeline, "fit", lambda self, df: given.append((type(self.getStages()[-1]), df)))
        ml.train_risk_models(rows, ["f0"], "label", "person")
    drawn = dict(given)[ml.RandomForestClassifier]
    train = rows.where(~ml.in_test_split(F.col("person")))
    count = lambda df: {(r["f0"], r["label"]): r["count"] for r in df.groupBy("f0", "label").count().collect()}
    assert count(drawn) == count(train)
    assert drawn.select("label", "class_weight").distinct().count() == 2


def test_risk_rows_know_the_segment_and_the_place_of_the_customer(spark, tmp_path):
    tables = {
        "region": ("r_regionkey int, r_name string", [(0, "EAST")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "A", 0), (1, "B", 0)]),
        "customer": ("c_custkey long, c_nationkey int, c_mktsegment string", [(1, 0, "BUILDING"), (2, 1, "MACHINERY"), (3, 0, None)]),
        "orders": (
            "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
            [(i, 1 + i % 3, "O", 1.0, dt.datetime(2000, 1 + i, 1), "2-HIGH") for i in range(9)],
        ),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    rows, features = plan.risk_rows(spark, str(tmp_path))
    assert features == [*plan.NUMERIC, "segment_BUILDING", "segment_MACHINERY", "segment_OTHER", "place_A", "place_B", "place_OTHER"]
    got = {r["entity_id"]: tuple(r[f] for f in features[len(plan.NUMERIC):]) for r in rows.collect()}
    assert rows.count() == 9 and got == {1: (1, 0, 0, 1, 0, 0), 2: (0, 1, 0, 0, 1, 0), 3: (0, 0, 1, 1, 0, 0)}
