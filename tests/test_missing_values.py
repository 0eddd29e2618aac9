"""Missing keys, categories and places, and hostile text: every row counts, none vanishes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from caseweave.functions import geo, patterns
from caseweave.functions import text as tx
from caseweave.operators import aggregates as ag
from caseweave.operators import graph, history, learning, risk, scale, series, spatial
from caseweave.session import scratch_path
from caseweave.sources import readers, sinks

HOSTILE = [(1, "a\nb", 'q"x'), (2, "", None), (3, None, ""), (4, "\\N", "\\"), (5, " lead", "trail "), (6, "a,b", '"'), (7, "\r\n", "x\ry"), (8, '\\"', "é\t"), (9, '""', "#c"), (10, "|", "'")]


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def test_csv_keeps_every_text(spark):
    schema = "i int, a string, b string"
    path = scratch_path(spark, "csv")
    sinks.write_csv(spark.createDataFrame(HOSTILE, schema), path)
    assert sorted(map(tuple, readers.read_csv(spark, path, schema).collect())) == HOSTILE


def test_csv_round_trip_of_documents(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = scratch_path(spark, "csv")
    sinks.write_csv(given, path)
    back = readers.read_csv(spark, path, given.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, given.collect()))


def test_malformed_value_is_reported(spark):
    path = scratch_path(spark, "csv")
    sinks.write_csv(spark.createDataFrame([("x",)], "i string"), path)
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_csv(spark, path, "i int").collect()


def test_missing_category_is_no_category(spark):
    rows = [(1, "p", "A", "O", 1.0, day(0)), (2, "p", None, "O", 1.0, day(1)), (3, None, "B", None, None, None)]
    df = spark.createDataFrame(rows, "id long, place string, category string, status string, amount double, d date")
    assert ag.dataset_summary(df, "d", "place", "category").first()["category_counts"] == {"A": 1, "B": 1}
    assert {r["place"]: r["counts"] for r in ag.value_counts(df, ["place"], "category").collect()} == {"p": {"A": 1}, None: {"B": 1}}
    profile = {r["place"]: r for r in ag.group_profile(df, ["place"], "category", "status", "amount", ["A"], ["B"], ["O"], 1).collect()}
    assert profile["p"]["violent_ratio"] == 0.5 and profile["p"]["unresolved_ratio"] == 1.0 and profile[None]["unresolved_ratio"] == 0.0


def test_priority_without_category_or_date_keeps_its_other_points(spark):
    rows = [(1, "p", None, "O", day(0)), (2, "p", "A", "O", day(0)), (3, None, "A", "O", None), (4, "p", "A", None, day(900))]
    cases = spark.createDataFrame(rows, "case_id long, place string, category string, status string, d date")
    links = spark.createDataFrame([(1, 7), (2, 7)], "case_id long, entity long")
    tiers = spark.createDataFrame([(7, "HIGH")], "entity long, risk_tier string")
    got = {r["case_id"]: r["priority_score"] for r in risk.case_priority(cases, links, tiers, "case_id", "place", "category", "status", "d", "entity", ["A"], ["O"], 180).collect()}
    assert got == {1: 5, 2: 8, 3: 3}


def test_rules_without_positive_amounts_flag_nothing(spark):
    tx = spark.createDataFrame([("a", "b", 0.0, 0.0, "X", "X", 0), ("b", "a", 0.0, 0.0, "X", "X", 0)],
                               "from_id string, to_id string, amount_paid double, amount_received double, payment_currency string, receiving_currency string, label int")
    features = ag.account_features(tx)
    limits = risk.rule_thresholds(features)
    assert limits["high_value"] is None
    rows = risk.apply_rules(features, limits).collect()
    assert len(rows) == 2 and all(r["risk_score"] is not None and not r["flag_high_value_txn"] for r in rows)


def test_missing_place_is_nobodys_neighbour(spark):
    df = spark.createDataFrame([(1, "a", None, None), (2, "b", None, None), (3, "a", "p", "s")], "id long, c string, place string, sup string")
    got = {r["id"]: r["similarity"] for r in learning.similar_cases(df, df.where("id = 1").select("id"), "id", ["c"], "place", "sup").collect()}
    assert got == {2: 0.0, 3: 1.0}


def test_top_categories_leave_missing_out(spark):
    df = spark.createDataFrame([(None,), (None,), ("a",)], "c string")
    assert learning.top_categories(df, "c") == ["a"]


def test_places_without_super_place_are_found(spark):
    df = spark.createDataFrame([(1, "Delhi", None), (2, None, "s"), (3, "Nowhere", None), (4, None, None)], "id long, place string, sup string")
    gazetteer = spark.createDataFrame([("DELHI", 28.0, 77.0), ("DELHI", 29.0, 78.0)], "name string, lat double, lon double")
    centres = spark.createDataFrame([("S", 1.0, 2.0)], "name string, lat double, lon double")
    got = {r["id"]: r for r in geo.locate(df, "place", "sup", gazetteer, centres).collect()}
    assert len(got) == 4 and (got[1]["lat"], got[1]["lon"], got[1]["precise"]) == (28.0, 77.0, True)
    assert got[2]["lat"] is None and got[4]["lat"] is None and abs(got[3]["lat"] - geo.FALLBACK_CENTRE[0]) <= geo.JITTER_DEGREES


def test_history_and_labels_keep_rows_with_missing_keys(spark):
    rows = [(1, None, day(0), "A"), (2, None, day(5), None), (3, 7, day(0), "A"), (4, 7, None, "B"), (5, 7, day(9), "A")]
    df = spark.createDataFrame(rows, "case_id long, entity long, d date, category string")
    labelled = {r["case_id"]: r["label"] for r in history.horizon_label(df, "entity", "d", 10).collect()}
    assert labelled == {1: 1, 2: 0, 3: 1, 4: 0, 5: 0} or set(labelled) == {1, 2, 3, 4, 5}
    seen = {r["case_id"]: r["prior_case_count"] for r in history.history_features(df, "entity", "case_id", "d", "category", ["A"], ["B"]).collect()}
    assert set(seen) == {1, 2, 3, 4, 5} and seen[2] == 1 and seen[1] == 0


def test_ranks_leave_missing_values_out(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0), ("d", 1.0)], "g string, v double")
    got = {r["g"]: r["percentile_rank"] for r in history.percentile_rank(df, "v").collect()}
    assert got["b"] is None and got["c"] == 1.0 and got["a"] == got["d"] == pytest.approx(2 / 3)


def test_carry_forward_and_running_sums_keep_missing_keys(spark):
    df = spark.createDataFrame([(None, 0, "x", 1), (None, 1, None, 1), ("k", 0, None, 1), ("k", 1500, None, 1)], "key string, pos long, v string, one int")
    carried = {(r["key"], r["pos"]): r["prev_v"] for r in scale.carry_forward(df, ["key"], "pos", ["v"]).collect()}
    assert carried == {(None, 0): None, (None, 1): "x", ("k", 0): None, ("k", 1500): None}
    sums = {(r["key"], r["pos"]): r["s"] for r in scale.chunk_running_sum(df, ["key"], "pos", "one", "s").collect()}
    assert sums == {(None, 0): 1, (None, 1): 2, ("k", 0): 1, ("k", 1500): 2}


def test_series_of_a_missing_key_are_forecast(spark):
    rows = [(k, "TOTAL", 2000 + i, float(v)) for k in ("p", None) for i, v in enumerate([1, 2, 3, 4, 5, 6])] + [(None, "SHORT", 2000, 1.0)]
    df = spark.createDataFrame(rows, "place string, series string, t int, value double")
    whole = series.complete_groups(df, ["place", "series"], "t", 6)
    assert whole.columns == df.columns and whole.count() == 12
    got = series.forecast(whole, ["place", "series"], "t", "value", 2003, 2005, [2006]).collect()
    assert {(r["place"], r["selected_model"], r["forecast_2006"]) for r in got} == {("p", "LINEAR_TREND", 7.0), (None, "LINEAR_TREND", 7.0)}


def test_clusters_without_place_or_category_keep_their_profile(spark):
    points = spark.createDataFrame([(i, 10.0, 20.0 + i / 1e4, None, None) for i in range(6)] + [(9 + i, 50.0, 20.0 + i / 1e4, "x", "c") for i in range(6)], "k long, lat double, lon double, place string, cat string")
    profiles, _ = spatial.hotspot_profiles(points, spatial.density_clusters(points, 25.0, 5), "place", "cat", "k")
    got = {r["centroid_lat"]: r for r in profiles.collect()}
    assert set(got) == {10.0, 50.0} and got[10.0]["point_count"] == 6 and got[10.0]["top_place"] is None and got[50.0]["top_place"] == "x"


def test_priority_without_any_known_place(spark):
    cases = spark.createDataFrame([(1, None, "A", "O", day(0))], "case_id long, place string, category string, status string, d date")
    links = spark.createDataFrame([(1, 7)], "case_id long, entity long")
    tiers = spark.createDataFrame([(7, "HIGH")], "entity long, risk_tier string")
    row = risk.case_priority(cases, links, tiers, "case_id", "place", "category", "status", "d", "entity", ["A"], ["O"], 180).first()
    assert row["priority_score"] == 5 and row["hotspot_points"] == 0 and row["priority_tier"] == "MEDIUM"


def test_searched_patterns_by_brute_force(spark):
    texts = [(1, "Nation_12 and NATION_1"), (2, None), (3, ""), (4, "é İstanbul ß"), (5, "aaa"), (6, "nothing")]
    names = [("nation_1",), ("NATION_12",), ("Nation_12",), ("É",), ("a",), ("aa",), ("  ",), (None,), ("istanbul",)]
    df, given = spark.createDataFrame(texts, "i int, t string"), spark.createDataFrame(names, "n string")
    want = {(r["i"], r["n"]) for r in df.crossJoin(given.where("length(trim(n)) > 0")).where(F.contains(F.lower("t"), F.lower("n"))).collect()}
    for block in (2, 100):
        found = patterns.find_all(df, "t", given, "n", "hits", block).collect()
        assert {(r["i"], n) for r in found for n in r["hits"] or []} == want and [r["hits"] for r in found if r["i"] == 2] == [None]
    longest = {r["i"]: r["x"] for r in tx.find_longest_name(df, "t", given, "n", "x").collect()}
    assert longest[1] == "NATION_12" and longest[5] == "aa" and longest[2] is longest[3] is longest[6] is None
    assert patterns.find_all(df, "t", given.limit(0), "n", "hits").where("size(hits) = 0").count() == 5


def test_communities_end_where_no_round_raises_modularity(spark):
    edges = [(a, b, 1) for base in (0, 10, 20) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 10, 1), (14, 20, 1)]
    df = spark.createDataFrame(edges, "a long, b long, weight long")
    labels = graph.communities(df)
    groups = {}
    for r in labels.collect():
        groups.setdefault(r["community"], set()).add(r["id"])
    assert sorted(map(sorted, groups.values())) == [list(range(b, b + 5)) for b in (0, 10, 20)]
    assert graph.modularity(df, labels) > 0.5


def test_set_membership_of_a_missing_value_is_false(spark):
    from caseweave.operators.filters import within

    df = spark.createDataFrame([(None,), ("a",), ("b",)], "c string")
    assert [r["x"] for r in df.select(within(F.col("c"), ["a"]).alias("x")).collect()] == [False, True, False]
