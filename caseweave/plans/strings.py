"""Scalar functions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave.functions import geo, similarity
from caseweave.functions import text as tx
from caseweave.operators.filters import share
from caseweave.operators.learning import one_hot
from caseweave.plans.base import cases, places, table
from caseweave.plans.dialogue import parse_messages
from caseweave.plans.registry import cte, query
from caseweave.schemas import NARRATIVE_TEMPLATES, STATUS_CLAUSES

_HEX = "CAST(('0x' || substr(sha256({s}), {at}, 8)) AS BIGINT) / 4294967295.0"
cte("located", f"""SELECT c_custkey, c_name, c_nationkey, ROUND(10 + c_nationkey + ({_HEX.format(s='c_name', at=1)} - 0.5) * 1.2, 1) AS lat,
    ROUND(70 + c_nationkey + ({_HEX.format(s='c_name', at=9)} - 0.5) * 1.2, 1) AS lon FROM customer""")


def customer_points(spark, sf):
    name = F.col("c_name")
    return table(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment",
        F.round(F.lit(10.0) + F.col("c_nationkey") + geo.hash_offset(name, 1), 1).alias("lat"),
        F.round(F.lit(70.0) + F.col("c_nationkey") + geo.hash_offset(name, 9), 1).alias("lon"),
    )


HAVERSINE_SQL = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"


@query("fn1_haversine", f"SELECT c_custkey, ROUND({HAVERSINE_SQL.format(a='lat', b='10.0 + c_nationkey', c='lon', d='70.0 + c_nationkey')}, 6) AS km FROM located", ("located",))
def _(spark, sf):
    p = customer_points(spark, sf)
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(10.0) + F.col("c_nationkey"), F.lit(70.0) + F.col("c_nationkey"))
    return p.select("c_custkey", F.round(km, 6).alias("km"))


@query("fn2_normalise_name", "SELECT doc_id, trim(regexp_replace(lower(left(text, 200)), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS norm FROM documents".replace("left(text, 200)", "text"))
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", tx.normalise_name(F.col("text")).alias("norm"))


@query("fn3_normalise_super_place", """SELECT n_nationkey, CASE s WHEN 'ORISSA' THEN 'ODISHA' WHEN 'NCT OF DELHI' THEN 'DELHI UT' ELSE s END AS norm FROM
    (SELECT n_nationkey, replace(upper(trim(CASE n_nationkey % 4 WHEN 0 THEN ' Orissa ' WHEN 1 THEN 'Nct of Delhi' WHEN 2 THEN n_name || ' & islands' ELSE n_name END)), ' & ', ' AND ') AS s FROM nation)""")
def _(spark, sf):
    n = table(spark, sf, "nation")
    raw = (
        F.when(F.col("n_nationkey") % 4 == 0, " Orissa ").when(F.col("n_nationkey") % 4 == 1, "Nct of Delhi")
        .when(F.col("n_nationkey") % 4 == 2, F.concat("n_name", F.lit(" & islands"))).otherwise(F.col("n_name"))
    )
    return n.select("n_nationkey", tx.normalise_super_place(raw).alias("norm"))


@query("fn4_normalise_place", r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(raw), '\([^)]*\)', '', 'g'), '\b(COMMR\.?|RURAL|URBAN|CITY|TOTAL|DT\.?|GRP\.?|CP)\b', '', 'g'),
    '[^A-Z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' City' WHEN 1 THEN p_name || ' (' || p_type || ') rural' WHEN 2 THEN p_name || ' Commr.' ELSE replace(p_name, ' ', '-') END AS raw FROM part)""")
def _(spark, sf):
    p = table(spark, sf, "part")
    key = F.col("p_partkey") % 4
    raw = (
        F.when(key == 0, F.concat("p_name", F.lit(" City"))).when(key == 1, F.concat(F.col("p_name"), F.lit(" ("), F.col("p_type"), F.lit(") rural")))
        .when(key == 2, F.concat("p_name", F.lit(" Commr."))).otherwise(F.replace(F.col("p_name"), F.lit(" "), F.lit("-")))
    )
    return p.select("p_partkey", tx.normalise_place(raw).alias("norm"))


cte("asked_places", """SELECT c_custkey, place_label, super_place FROM (SELECT c_custkey, super_place, CASE c_custkey % 4 WHEN 0 THEN place WHEN 1 THEN place || ' City' WHEN 2 THEN place || ' north side' ELSE 'Outer ' || place END AS place_label
    FROM customer JOIN places ON c_nationkey = n_nationkey)""", "places")
cte("gaz", "SELECT upper(place) AS name, 10.0 + n_nationkey AS lat, 70.0 + n_nationkey AS lon FROM places WHERE n_nationkey % 2 = 0", "places")
cte("centres", "SELECT r_name AS name, 20.0 + r_regionkey AS lat, 80.0 + r_regionkey AS lon FROM region WHERE r_regionkey < 4")


@query("fn5_locate", f"""SELECT c_custkey, COALESCE(g1.lat, g2.lat, g3.lat, ROUND(COALESCE(c.lat, 22.9734) + ({_HEX.format(s="upper(super_place) || '|' || place_label", at=1)} - 0.5) * 1.2, 5)) AS lat,
    COALESCE(g1.lon, g2.lon, g3.lon, ROUND(COALESCE(c.lon, 78.6569) + ({_HEX.format(s="upper(super_place) || '|' || place_label", at=9)} - 0.5) * 1.2, 5)) AS lon, COALESCE(g1.lat, g2.lat, g3.lat) IS NOT NULL AS precise
    FROM (SELECT *, trim(regexp_replace(trim(regexp_replace(upper(place_label), '\\b(COMMR\\.?|RURAL|URBAN|CITY|TOTAL|DT\\.?|GRP\\.?)\\b', '', 'g')), '\\s+', ' ', 'g')) AS bare FROM asked_places)
    LEFT JOIN gaz g1 ON g1.name = upper(trim(place_label)) LEFT JOIN gaz g2 ON g2.name = bare LEFT JOIN gaz g3 ON g3.name = split_part(bare, ' ', 1) LEFT JOIN centres c ON c.name = upper(trim(super_place))""", ("asked_places", "gaz", "centres"))
def _(spark, sf):
    pl = places(spark, sf)
    key = F.col("c_custkey") % 4
    label = (
        F.when(key == 0, F.col("place")).when(key == 1, F.concat("place", F.lit(" City"))).when(key == 2, F.concat("place", F.lit(" north side")))
        .otherwise(F.concat(F.lit("Outer "), F.col("place")))
    )
    asked = table(spark, sf, "customer").join(pl, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", label.alias("place_label"), "super_place")
    gaz = pl.where(F.col("n_nationkey") % 2 == 0).select(
        F.upper("place").alias("name"), (F.lit(10.0) + F.col("n_nationkey")).alias("lat"), (F.lit(70.0) + F.col("n_nationkey")).alias("lon")
    )
    centres = table(spark, sf, "region").where(F.col("r_regionkey") < 4).select(
        F.col("r_name").alias("name"), (F.lit(20.0) + F.col("r_regionkey")).alias("lat"), (F.lit(80.0) + F.col("r_regionkey")).alias("lon")
    )
    return geo.locate(asked, "place_label", "super_place", gaz, centres).select("c_custkey", "lat", "lon", "precise")


@query("fn6_hash_jitter", f"SELECT c_custkey, ROUND(({_HEX.format(s='c_name', at=1)} - 0.5) * 1.2, 9) AS dx, ROUND(({_HEX.format(s='c_name', at=9)} - 0.5) * 1.2, 9) AS dy FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", F.round(geo.hash_offset(F.col("c_name"), 1), 9).alias("dx"), F.round(geo.hash_offset(F.col("c_name"), 9), 9).alias("dy")
    )


@query("fn7_edit_ratio", """SELECT DISTINCT l.block, l.name AS a, r.name AS b, ROUND(1 - levenshtein(l.name, r.name) / greatest(length(l.name), length(r.name)), 6) AS score
    FROM name_left l JOIN name_right r ON l.block = r.block WHERE 1 - levenshtein(l.name, r.name) / greatest(length(l.name), length(r.name)) >= 0.82""", ("name_left", "name_right"))
def _(spark, sf):
    from caseweave.plans.summaries import name_sides

    left, right = name_sides(spark, sf)
    pairs = similarity.similar_text_pairs(left.select("block", F.col("name").alias("text")), right.select("block", F.col("name").alias("text")), 0.82)
    return pairs.withColumn("score", F.round("score", 6))


SECTION_MAP = {"ECONOMY": "CHEATING", "SMALL": "THEFT", "LARGE": "ROBBERY"}


@query("fn8_section_to_category", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'CHEATING' WHEN 'SMALL' THEN 'THEFT' WHEN 'LARGE' THEN 'ROBBERY' ELSE 'OTHER_IPC_CRIMES' END AS category FROM part")
def _(spark, sf):
    mapping = F.create_map(*[F.lit(x) for kv in SECTION_MAP.items() for x in kv])
    return table(spark, sf, "part").select("p_partkey", F.coalesce(mapping[F.col("p_type")], F.lit("OTHER_IPC_CRIMES")).alias("category"))


@query("fn9_narrative", """SELECT case_id, 'On ' || strftime(case_date, '%Y-%m-%d') || CASE WHEN category = '1-URGENT' THEN ' at approximately 00:00:00, Customer ' || entity_id || ', aged unknown, reported the theft of personal property near ' || place || ', ' || super_place || ' within the jurisdiction of ' || segment
    || '. ' || CASE WHEN status = 'O' THEN 'The identity of the accused is yet to be established.' ELSE 'The complainant has named ' || segment || '.' END || ' The case is registered under ' || category || ' and is '
    ELSE ' at approximately 00:00:00, a complaint was registered at ' || segment || ' by or on behalf of Customer ' || entity_id || ', aged unknown, in connection with an incident near ' || place || ', ' || super_place || '. '
    || CASE WHEN status = 'O' THEN 'The identity of the accused is yet to be established.' ELSE 'The complainant has named ' || segment || '.' END || ' The case is registered under ' || category || ' and is ' END
    || CASE status WHEN 'O' THEN 'currently under investigation' WHEN 'P' THEN 'pending trial before the competent court' ELSE 'closed as untraced/unsubstantiated' END || '.' AS narrative FROM cases""", ("cases",))
def _(spark, sf):
    clause = F.when(F.col("status") == "O", F.lit("The identity of the accused is yet to be established.")).otherwise(
        F.concat(F.lit("The complainant has named "), F.col("segment"), F.lit("."))
    )
    status = (
        F.when(F.col("status") == "O", STATUS_CLAUSES["UNDER_INVESTIGATION"]).when(F.col("status") == "P", STATUS_CLAUSES["TRIAL"])
        .otherwise(STATUS_CLAUSES["CLOSED"])
    )
    values = {
        "date": F.date_format("case_date", "yyyy-MM-dd"), "time": F.lit("00:00:00"), "police_station": F.col("segment"),
        "victim": F.concat(F.lit("Customer "), F.col("entity_id")), "victim_age": F.lit("unknown"),
        "location": F.concat_ws(", ", "place", "super_place"), "accused_clause": clause, "ipc_section": F.col("category"),
        "status_clause": status, "property_value": F.lit("an undisclosed amount"),
    }
    text = F.when(F.col("category") == "1-URGENT", tx.fill_template(NARRATIVE_TEMPLATES["THEFT"], values)).otherwise(
        tx.fill_template(NARRATIVE_TEMPLATES["DEFAULT"], values)
    )
    return cases(spark, sf).select("case_id", text.alias("narrative"))


@query("fn10_person_sentences", """SELECT c_custkey AS id, c_name || ' (C' || c_custkey || ') is ' || CASE WHEN n >= 3 THEN 'HIGH' ELSE 'LOW' END || ' risk: ' || printf('%.0f%%', p * 100) || ' predicted probability of reoffending within 365 days, based on '
    || n || ' prior case(s) across ' || k || ' crime type(s).' AS risk_text,
    c_name || ' (C' || c_custkey || '), age unknown, ' || place || ', ' || super_place || '. ' || CASE WHEN n >= 3 THEN 'HIGH' ELSE 'LOW' END || ' risk tier (' || printf('%.0f%%', p * 100) || ' predicted probability of reoffending within 365 days). Linked to ' || n
    || ' case(s) and ' || k || ' known associate(s).' AS dossier_text FROM customer JOIN places ON c_nationkey = n_nationkey
    JOIN (SELECT entity_id, COUNT(*) AS n, COUNT(DISTINCT category) AS k, COUNT(DISTINCT category) / 8.0 + 0.001 AS p FROM cases GROUP BY 1) ON entity_id = c_custkey""", ("cases",))
def _(spark, sf):
    per = cases(spark, sf).groupBy("entity_id", "place", "super_place").agg(F.count("*").alias("n_cases"), F.count_distinct("category").alias("distinct_types"))
    df = per.join(table(spark, sf, "customer"), F.col("entity_id") == F.col("c_custkey")).select(
        F.col("entity_id").alias("id"), F.concat(F.lit("C"), F.col("entity_id")).alias("person_id"), F.col("c_name").alias("full_name"), F.lit(None).cast("int").alias("age"),
        F.col("place").alias("district"), F.col("super_place").alias("state"), F.when(F.col("n_cases") >= 3, "HIGH").otherwise("LOW").alias("risk_tier"),
        (F.col("distinct_types") / 8.0 + 0.001).alias("probability"), "n_cases", F.col("n_cases").alias("prior_case_count"), "distinct_types", F.col("distinct_types").alias("degree"),
    )
    return df.select("id", tx.sentence_person_risk().alias("risk_text"), tx.sentence_person_dossier().alias("dossier_text"))


@query("fn10_listing_sentences", """SELECT tier AS risk_tier, CASE WHEN n = 0 THEN 'No ' || tier || '-risk suspicious accounts found.' ELSE n || ' ' || tier || '-risk suspicious account(s) found. Top: ' || ids || '.' END AS sentence
    FROM (SELECT t.tier, COUNT(account_id) AS n, string_agg(account_id, ', ' ORDER BY account_id) FILTER (rk <= 5) AS ids FROM (SELECT unnest(['HIGH','MEDIUM','LOW','NONE']) AS tier) t
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY risk_tier ORDER BY account_id) AS rk FROM scored) s ON s.risk_tier = t.tier GROUP BY t.tier)""", ("scored",))
def _(spark, sf):
    from caseweave.operators.aggregates import first_ids
    from caseweave.plans.summaries import scored_accounts
    from caseweave.session import materialise

    scored = materialise(scored_accounts(spark, sf).select("risk_tier", "account_id"), "scored")
    tiers = spark.createDataFrame([(t,) for t in ("HIGH", "MEDIUM", "LOW", "NONE")], "risk_tier string")
    counts = scored.groupBy("risk_tier").agg(F.count("*").alias("n"))
    tops = first_ids(scored, ["risk_tier"], "account_id").withColumnRenamed("sample_ids", "top_ids")
    df = tiers.join(counts, "risk_tier", "left").join(tops, "risk_tier", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return df.select("risk_tier", tx.sentence_accounts().alias("sentence"))


# ---- questions: the customer table turned into a chat log -------------------

_ASK = """CASE c_custkey % 10 WHEN 0 THEN 'Who is ACC-' || lpad(CAST(c_custkey * 2 AS VARCHAR), 6, '0') || '?' WHEN 1 THEN 'Why is he high risk?' WHEN 2 THEN 'what about their network'
    WHEN 3 THEN 'forecast for nation_' || (c_custkey % 27) WHEN 4 THEN 'brief me on that district please, ACC-000004 lives there' WHEN 5 THEN 'show crime hotspots of LOW tier near NATION_' || (c_custkey % 25)
    WHEN 6 THEN 'case 1234567890' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || ' is an urgent case' WHEN 7 THEN 'risk score for acc-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || ' in Nation_1'
    WHEN 8 THEN 'hello again' ELSE 'explain her links in NATION_' || (c_custkey % 25) END"""
cte("questions", f"SELECT c_nationkey AS session, c_custkey AS turn, {_ASK} AS text FROM customer")
cte("parsed", r"""SELECT *, CASE WHEN regexp_matches(lower(text), '\b(why|explain)\b') THEN 'person_explain' WHEN regexp_matches(lower(text), '\b(connect(ed|ions?)?|associat(e|es|ed)|network|linked to|co-accused)\b') THEN 'person_network'
    WHEN regexp_matches(lower(text), '\b(risk (score|tier|profile)|reoffend|recidivis\w*)\b') THEN 'person_risk' WHEN regexp_matches(lower(text), '\b(who is|tell me about|dossier|profile for|background on|show me person)\b') THEN 'person_dossier'
    WHEN regexp_matches(lower(text), '\b(forecast|predicted crime|crime trend|projection)\b') THEN 'district_forecast' WHEN regexp_matches(lower(text), '\b(brief(ing)?|situation in|overview of)\b') THEN 'district_briefing'
    WHEN regexp_matches(lower(text), '\bhotspot') THEN 'hotspots' WHEN regexp_matches(lower(text), '\b(priority case|urgent case|top case|unresolved case)\b') THEN 'case_priority' ELSE 'unknown' END AS intent,
    NULLIF(regexp_extract(upper(text), '\b(?:VIC|CMP|ACC)-\d{6}\b', 0), '') AS person, NULLIF(regexp_extract(text, '\b\d{15,20}\b', 0), '') AS case_id, NULLIF(regexp_extract(upper(text), '\b(HIGH|MEDIUM|LOW)\b', 0), '') AS tier,
    (SELECT arg_max(n_name, length(n_name) * 1000 - n_nationkey) FROM nation WHERE contains(lower(text), lower(n_name))) AS place,
    regexp_matches(lower(text), '\b(him|her|them|he|she|they|his|their|this person|that person|the same person)\b') AS p_pron, regexp_matches(lower(text), '\b(there|that district|this district|the same district|that area)\b') AS l_pron FROM questions""", "questions")


def questions(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_nationkey AS session", "c_custkey AS turn", _ASK.replace("VARCHAR", "STRING") + " AS text")


def parsed_questions(spark, sf):
    return parse_messages(questions(spark, sf), "text", table(spark, sf, "nation"), "n_name")


@query("fn11_entity_patterns", "SELECT turn, person, case_id, tier FROM parsed", ("parsed",))
def _(spark, sf):
    return parsed_questions(spark, sf).select("turn", "person", "case_id", "tier")


@query("fn12_intents", "SELECT turn, intent FROM parsed", ("parsed",))
def _(spark, sf):
    return questions(spark, sf).select("turn", tx.classify(F.col("text")).alias("intent"))


@query("fn13_longest_name", "SELECT turn, place FROM parsed", ("parsed",))
def _(spark, sf):
    return tx.find_longest_name(questions(spark, sf), "text", table(spark, sf, "nation"), "n_name", "place").select("turn", "place")


cte("vocabulary", "SELECT DISTINCT p_name || ' ' || p_brand AS phrase FROM part")


@query("fn13_longest_name_shingles", """SELECT id, arg_max(phrase, length(phrase) * 10000000 - rk) AS found FROM (SELECT p_partkey AS id, 'seen: ' || p_name || ' ' || p_brand || ', ' || p_type AS text FROM part) t
    LEFT JOIN (SELECT phrase, row_number() OVER (ORDER BY phrase) AS rk FROM vocabulary) ON contains(lower(text), lower(phrase)) GROUP BY id""", ("vocabulary",))
def _(spark, sf):
    # a long gazetteer: several automata
    part = table(spark, sf, "part")
    texts = part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("seen: "), F.concat_ws(" ", "p_name", "p_brand"), F.lit(", "), F.col("p_type")).alias("text"))
    names = part.select(F.concat_ws(" ", "p_name", "p_brand").alias("phrase"))
    return tx.find_longest_name(texts, "text", names, "phrase", "found", block=500).select("id", "found")


@query("fn14_clarification", """SELECT turn, CASE WHEN intent IN ('help','unknown') THEN intent WHEN intent IN ('person_dossier','person_risk','person_explain','person_network') AND person IS NULL THEN 'clarify_person'
    WHEN intent IN ('district_briefing','district_forecast') AND place IS NULL THEN 'clarify_place' ELSE intent END AS route FROM parsed""", ("parsed",))
def _(spark, sf):
    p = parsed_questions(spark, sf)
    return p.select("turn", tx.clarification(F.col("intent"), F.col("person"), F.col("place")).alias("route"))


@query("fn15_one_hot", """SELECT c_custkey, CAST(c_mktsegment = 'AUTOMOBILE' AS INT) AS seg_AUTOMOBILE, CAST(c_mktsegment = 'BUILDING' AS INT) AS seg_BUILDING, CAST(c_mktsegment = 'HOUSEHOLD' AS INT) AS seg_HOUSEHOLD FROM customer""")
def _(spark, sf):
    return one_hot(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["AUTOMOBILE", "BUILDING", "HOUSEHOLD"], "seg").drop("c_mktsegment")


@query("fn16_pipe_lists", "SELECT p_partkey, replace(p_name, ' ', '|') AS joined, len(string_split(p_name, ' ')) AS n_words FROM part")
def _(spark, sf):
    words = F.split("p_name", " ")
    joined = F.array_join(words, "|")
    return table(spark, sf, "part").select("p_partkey", joined.alias("joined"), F.size(F.split(joined, r"\|")).cast("long").alias("n_words"))


@query("fn17_iso_split", "SELECT event_id, CAST(ts AS DATE) AS day, CAST(year(ts) AS INT) AS year, strftime(ts, '%H:%M:%S') AS time FROM events")
def _(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    parts = F.split(iso, " ")
    return table(spark, sf, "events").select(
        "event_id", F.to_date(parts[0]).alias("day"), F.substring(iso, 1, 4).cast("int").alias("year"), parts[1].alias("time")
    )


@query("fn18_matching_features", """SELECT case_id, NULLIF(concat_ws('; ', CASE WHEN category = '2-HIGH' THEN 'same crime type' END, CASE WHEN status = 'O' THEN 'same status' END,
    CASE WHEN place = 'NATION_3' THEN 'same district' WHEN super_place = 'ASIA' THEN 'same state' END), '') AS matching FROM cases""", ("cases",))
def _(spark, sf):
    here = F.col("place") == "NATION_3"
    features = tx.matching_features(
        (F.col("category") == "2-HIGH", "same crime type"), (F.col("status") == "O", "same status"), (here, "same district"),
        (~here & (F.col("super_place") == "ASIA"), "same state"),
    )
    return cases(spark, sf).select("case_id", F.nullif(F.array_join(features, "; "), F.lit("")).alias("matching"))


@query("fn19_signed_percent", "SELECT entity_id, CASE WHEN n < 3 THEN 'new pattern: no comparable activity in the baseline period' ELSE printf('%+.0f%% vs. baseline-implied rate', n * 10.0 - 93) END AS reason FROM (SELECT entity_id, COUNT(*) AS n FROM cases GROUP BY 1)", ("cases",))
def _(spark, sf):
    per = cases(spark, sf).groupBy("entity_id").agg(F.count("*").alias("n"))
    return per.select("entity_id", tx.signed_percent_reason(F.when(F.col("n") >= 3, F.col("n") * 10.0 - 93)).alias("reason"))


@query("fn20_numeric", "SELECT c_custkey, ROUND(ln(1 + abs(c_acctbal)), 6) AS logged, greatest(0, c_acctbal) AS clipped, ROUND(c_acctbal, 1) AS rounded, ROUND(abs(c_acctbal) / 7, 4) AS scaled FROM customer")
def _(spark, sf):
    v = F.col("c_acctbal")
    return table(spark, sf, "customer").select(
        "c_custkey", F.round(F.log1p(F.abs(v)), 6).alias("logged"), F.greatest(F.lit(0.0), v).alias("clipped"),
        F.round(v, 1).alias("rounded"), F.round(share(F.abs(v), F.lit(7.0)), 4).alias("scaled"),
    )
