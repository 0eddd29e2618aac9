"""String expressions: normalisers, entity patterns, intents, sentences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.functions.patterns import BLOCK, find_all

# ---- fixed values ---------------------------------------------------------
SUPER_PLACE_ALIASES = {
    "ORISSA": "ODISHA",
    "PONDICHERRY": "PUDUCHERRY",
    "NCT OF DELHI": "DELHI UT",
    "ANDAMAN AND NICOBAR ISLANDS": "A AND N ISLANDS",
    "DADRA AND NAGAR HAVELI": "D AND N HAVELI",
}
PLACE_SUFFIX_PATTERN = r"\b(COMMR\.?|RURAL|URBAN|CITY|TOTAL|DT\.?|GRP\.?|CP)\b"
PERSON_ID_PATTERN = r"(?i)\b(?:VIC|CMP|ACC)-\d{6}\b"
CASE_ID_PATTERN = r"\b\d{15,20}\b"
TIER_PATTERN = r"(?i)\b(HIGH|MEDIUM|LOW)\b"
PERSON_PRONOUN_PATTERN = r"(?i)\b(him|her|them|he|she|they|his|their|this person|that person|the same person)\b"
PLACE_PRONOUN_PATTERN = r"(?i)\b(there|that district|this district|the same district|that area)\b"
INTENT_PATTERNS = [
    ("help", r"(?i)\b(help|what can you do|capabilities|commands|examples?)\b"),
    ("person_explain", r"(?i)\b(why|explain)\b"),
    ("person_network", r"(?i)\b(connect(ed|ions?)?|associat(e|es|ed)|network|linked to|co-accused)\b"),
    ("person_risk", r"(?i)\b(risk (score|tier|profile)|reoffend|recidivis\w*)\b"),
    ("person_dossier", r"(?i)\b(who is|tell me about|dossier|profile for|background on|show me person)\b"),
    ("district_forecast", r"(?i)\b(forecast|predicted crime|crime trend|projection)\b"),
    ("district_briefing", r"(?i)\b(brief(ing)?|what'?s happening in|situation in|overview of|going on in)\b"),
    ("hotspots", r"(?i)\bhotspot"),
    ("suspicious_accounts", r"(?i)\b(suspicious account|financial fraud|money laundering|\baml\b)\b"),
    ("case_priority", r"(?i)\b(priority case|urgent case|top case|unresolved case)\b"),
    ("repeat_offenders", r"(?i)\brepeat offender"),
]
PERSON_INTENTS = ["person_dossier", "person_risk", "person_explain", "person_network"]
PLACE_INTENTS = ["district_briefing", "district_forecast"]
# ---------------------------------------------------------------------------


def normalise_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def normalise_super_place(name: Column, aliases: dict[str, str] = SUPER_PLACE_ALIASES) -> Column:
    plain = F.replace(F.trim(F.upper(name)), F.lit(" & "), F.lit(" AND "))
    result = plain
    for old, new in aliases.items():
        result = F.when(plain == old, new).otherwise(result)
    return result


def normalise_place(name: Column, suffix_pattern: str = PLACE_SUFFIX_PATTERN) -> Column:
    bare = F.regexp_replace(F.upper(name), r"\([^)]*\)", "")
    bare = F.regexp_replace(bare, suffix_pattern, "")
    bare = F.regexp_replace(bare, r"[^A-Z0-9\s]", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def first_match(text: Column, pattern: str) -> Column:
    """First regex match, upper-cased, or null."""
    return F.nullif(F.upper(F.regexp_extract(text, pattern, 0)), F.lit(""))


def classify(text: Column, rules: list[tuple[str, str]] = INTENT_PATTERNS, default: str = "unknown") -> Column:
    """Label of the first rule whose pattern occurs in the text."""
    branches = [F.when(text.rlike(pattern), F.lit(label)) for label, pattern in rules]
    return F.coalesce(*branches, F.lit(default))


def clarification(intent: Column, person: Column, place: Column, person_intents: list[str] = PERSON_INTENTS, place_intents: list[str] = PLACE_INTENTS) -> Column:
    """Route of a question: its intent, or which entity must be asked for first."""
    return (
        F.when(intent.isin("help", "unknown"), intent)
        .when(intent.isin(person_intents) & person.isNull(), F.lit("clarify_person"))
        .when(intent.isin(place_intents) & place.isNull(), F.lit("clarify_place"))
        .otherwise(intent)
    )


def find_longest_name(df: DataFrame, text: str, names: DataFrame, name: str, out: str, block: int = BLOCK) -> DataFrame:
    """Longest gazetteer name that occurs in the text, ignoring case; of equally long ones the first."""
    found = find_all(df, text, names, name, "_names", block)
    ordered = F.array_sort(F.transform("_names", lambda n: F.struct((-F.length(n)).alias("k"), n.alias("n"))))
    return found.withColumn(out, F.try_element_at(ordered, F.lit(1))["n"]).select(*df.columns, out)


def matching_features(*pairs: tuple[Column, str]) -> Column:
    """Labels of the conditions that hold, in the given order."""
    return F.filter(F.array(*[F.when(cond, F.lit(label)) for cond, label in pairs]), lambda x: x.isNotNull())


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """A ``{name}`` template as one concatenation; null values read as empty text."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[
        F.coalesce(values[part].cast("string"), F.lit("")) if i % 2 else F.lit(part) for i, part in enumerate(parts) if part
    ])


def percent(value: Column, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f%%", value * 100)


def signed_percent_reason(pct: Column) -> Column:
    return F.when(pct.isNull(), F.lit("new pattern: no comparable activity in the baseline period")).otherwise(
        F.concat(F.format_string("%+.0f%%", pct), F.lit(" vs. baseline-implied rate"))
    )


# ---- sentences, one per intent; each takes a frame with the named columns --

def sentence_person_dossier() -> Column:
    risk = F.when(
        F.col("risk_tier").isNotNull(),
        F.concat(F.col("risk_tier"), F.lit(" risk tier ("), percent(F.col("probability")),
                 F.lit(" predicted probability of reoffending within 365 days)")),
    ).otherwise(F.lit("no offender-risk profile on file"))
    return F.concat(
        F.coalesce("full_name", "person_id"), F.lit(" ("), F.col("person_id"), F.lit("), age "),
        F.coalesce(F.col("age").cast("string"), F.lit("unknown")), F.lit(", "),
        F.coalesce("district", F.lit("unknown district")), F.lit(", "), F.coalesce("state", F.lit("unknown state")), F.lit(". "),
        risk, F.lit(". Linked to "), F.col("n_cases").cast("string"), F.lit(" case(s) and "),
        F.col("degree").cast("string"), F.lit(" known associate(s)."),
    )


def sentence_person_risk() -> Column:
    return F.concat(
        F.coalesce("full_name", "person_id"), F.lit(" ("), F.col("person_id"), F.lit(") is "), F.col("risk_tier"), F.lit(" risk: "),
        percent(F.col("probability")), F.lit(" predicted probability of reoffending within 365 days, based on "),
        F.col("prior_case_count").cast("string"), F.lit(" prior case(s) across "),
        F.col("distinct_types").cast("string"), F.lit(" crime type(s)."),
    )


def sentence_person_explain() -> Column:
    """``drivers`` is an array<struct<feature, phi>> sorted by magnitude."""
    parts = F.transform(
        F.slice("drivers", 1, 3), lambda d: F.concat(d["feature"], F.lit(" ("), F.format_string("%+.3f", d["phi"]), F.lit(")"))
    )
    return F.concat(
        F.coalesce("full_name", "person_id"), F.lit(" ("), F.col("person_id"), F.lit(") is "), F.col("risk_tier"), F.lit(" risk ("),
        percent(F.col("probability")), F.lit("). Top drivers: "),
        F.coalesce(F.nullif(F.array_join(parts, "; "), F.lit("")), F.lit("none")), F.lit("."),
    )


def sentence_person_network(depth: int) -> Column:
    return F.concat(
        F.coalesce("full_name", "person_id"), F.lit(" ("), F.col("person_id"), F.lit(f")'s network out to depth {depth}: "),
        F.col("n_associates").cast("string"), F.lit(" associate(s), "), F.col("n_links").cast("string"), F.lit(" shared-case link(s)."),
    )


def sentence_place_briefing() -> Column:
    social = F.when(
        F.col("literacy_rate").isNotNull(),
        F.concat(F.lit(", literacy rate "), percent(F.col("literacy_rate"), 1), F.lit(", urbanization "), percent(F.col("urbanization_rate"), 1)),
    ).otherwise(F.lit(""))
    return F.concat(
        F.col("district"), F.lit(", "), F.col("state"), F.lit(": "), F.col("total_cases").cast("string"), F.lit(" total case(s), "),
        F.col("unresolved_cases").cast("string"), F.lit(" unresolved, "),
        F.when(F.col("is_hotspot"), F.lit("a known hotspot")).otherwise(F.lit("not a hotspot")),
        F.lit(" (case-volume percentile "), percent(F.col("percentile_rank")), F.lit(")"), social, F.lit("."),
    )


def sentence_place_forecast() -> Column:
    pct = F.try_divide((F.col("forecast") - F.col("last_value")) * 100, F.col("last_value"))
    trend = F.when(pct > 0, F.lit("up")).when(pct < 0, F.lit("down")).otherwise(F.lit("flat"))
    change = F.coalesce(F.concat(F.format_string("%.1f%% ", F.abs(pct)), trend), F.lit("no comparable trend"))
    return F.concat(
        F.col("district"), F.lit(", "), F.col("state"), F.lit(": forecast total crime for "), F.col("district"), F.lit(" is "),
        F.format_string("%.0f", F.col("forecast")), F.lit(" (from "), F.format_string("%.0f", F.col("last_value")), F.lit(" in "),
        F.col("last_year").cast("string"), F.lit(") - "), change, F.lit(", selected model: "), F.col("selected_model"), F.lit("."),
    )


def sentence_hotspots() -> Column:
    """``top`` is an array<struct<place, n>> of the three largest clusters."""
    listed = F.transform("top", lambda c: F.concat(c["place"], F.lit(" ("), c["n"].cast("string"), F.lit(" incidents)")))
    none = F.concat(
        F.lit("No hotspot clusters found with the current filters (eps="), F.col("eps_km").cast("string"),
        F.lit("km, min_points="), F.col("min_points").cast("string"), F.lit(")."),
    )
    some = F.concat(F.col("n_clusters").cast("string"), F.lit(" hotspot cluster(s) found. Largest: "), F.array_join(listed, "; "), F.lit("."))
    return F.when(F.col("n_clusters") == 0, none).otherwise(some)


def sentence_accounts() -> Column:
    """``top_ids`` holds the five best ids of the tier."""
    none = F.concat(F.lit("No "), F.col("risk_tier"), F.lit("-risk suspicious accounts found."))
    some = F.concat(
        F.col("n").cast("string"), F.lit(" "), F.col("risk_tier"), F.lit("-risk suspicious account(s) found. Top: "),
        F.array_join("top_ids", ", "), F.lit("."),
    )
    return F.when(F.col("n") == 0, none).otherwise(some)


def sentence_case_priority() -> Column:
    at_tier = F.coalesce(F.concat(F.lit(" at tier "), F.col("tier_filter")), F.lit(""))
    some = F.concat(
        F.col("n").cast("string"), F.lit(" unresolved case(s)"), at_tier, F.lit(". Highest priority: FIR "), F.col("top_case"),
        F.lit(" in "), F.col("top_place"), F.lit(" (score "), F.col("top_score").cast("string"), F.lit(", "), F.col("top_tier"), F.lit(")."),
    )
    return F.when(F.col("n") == 0, F.concat(F.lit("No unresolved cases found"), at_tier, F.lit("."))).otherwise(some)


def sentence_repeat_entities() -> Column:
    some = F.concat(
        F.col("n").cast("string"), F.lit(" repeat offender(s) found. Highest case count: "), F.col("top_name"), F.lit(" ("),
        F.col("top_id"), F.lit(") with "), F.col("top_count").cast("string"), F.lit(" prior case(s), "), F.col("top_tier"), F.lit(" risk."),
    )
    return F.when(F.col("n") == 0, F.lit("No repeat offenders found with the current filters.")).otherwise(some)
