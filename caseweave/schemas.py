"""Explicit schemas and fixed vocabularies."""

from __future__ import annotations

# Column lists are DDL strings, which every Spark reader takes as its schema.
PERSON = (
    "person_id string, full_name string, gender string, age int, address_district string, address_state string, "
    "occupation string, income_bracket string"
)
CASE = (
    "fir_id string, state string, district string, police_station string, lat double, lon double, geo_precise boolean, "
    "date_reported date, time_reported string, date_occurred date, time_occurred string, crime_type_code string, "
    "ipc_section string, crime_description string, narrative string, weapon_used string, property_value_inr double, status string"
)
CASE_PERSON_LINK = ("fir_id string, person_id string, role string, relationship_to_victim string")
NETWORK_EDGE = ("person_id_a string, person_id_b string, edge_type string, shared_fir_count long, fir_ids string")
TRANSACTION = (
    "timestamp string, from_bank int, from_id string, to_bank int, to_id string, amount_received double, "
    "receiving_currency string, amount_paid double, payment_currency string, payment_format string, is_laundering int"
)
METRICS_DOCUMENT = ("name string, total long, counts map<string,long>, thresholds struct<low:double,high:double>")

# ---- fixed values ---------------------------------------------------------
VIOLENT = [
    "MURDER", "ATTEMPT_TO_MURDER", "CULPABLE_HOMICIDE", "RAPE", "DACOITY", "ROBBERY", "RIOTS",
    "HURT_GRIEVOUS_HURT", "DOWRY_DEATH", "ASSAULT_ON_WOMEN_MODESTY",
]
PROPERTY = ["THEFT", "AUTO_THEFT", "OTHER_THEFT", "BURGLARY", "ROBBERY", "DACOITY", "CRIMINAL_BREACH_OF_TRUST"]
UNRESOLVED = ["UNDER_INVESTIGATION", "TRIAL"]
ALLOWED_INDICATORS = [
    "literacy_rate", "urbanization_rate", "workforce_participation_rate", "higher_education_rate", "amenity_index",
]
CRIME_METRICS = [
    "crime_rate_per_100k", "violent_crime_rate_per_100k", "property_crime_rate_per_100k", "violent_ratio", "property_ratio",
]
CONTEXT_ONLY = ["sc_st_share", "hindu_share", "muslim_share", "christian_share", "sikh_share"]
ROLE_RANK = {"ANALYST": 0, "INVESTIGATOR": 1, "ADMIN": 2}
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
TIME_BUCKETS = [(0, 6, "NIGHT_00_06"), (6, 12, "MORNING_06_12"), (12, 18, "AFTERNOON_12_18"), (18, 24, "EVENING_18_24")]
STATUS_CLAUSES = {
    "UNDER_INVESTIGATION": "currently under investigation",
    "CHARGESHEETED": "at the chargesheet stage",
    "TRIAL": "pending trial before the competent court",
    "CONVICTED": "concluded with a conviction",
    "ACQUITTED": "concluded with an acquittal",
    "CLOSED": "closed as untraced/unsubstantiated",
}
NARRATIVE_TEMPLATES = {
    "MURDER": (
        "On {date} at approximately {time}, a complaint was lodged at {police_station} regarding the death "
        "of {victim}, aged {victim_age}, whose body was discovered near {location}. Preliminary investigation "
        "indicates injuries consistent with assault. {accused_clause} The matter is registered under {ipc_section} "
        "and is {status_clause}."
    ),
    "THEFT": (
        "On {date} at approximately {time}, {victim}, aged {victim_age}, reported the theft of personal property "
        "near {location} within the jurisdiction of {police_station}. {accused_clause} The case is registered "
        "under {ipc_section} and is {status_clause}."
    ),
    "CHEATING": (
        "On {date}, {victim}, aged {victim_age}, filed a complaint at {police_station} alleging financial fraud "
        "amounting to approximately Rs. {property_value} near {location}. {accused_clause} Registered under "
        "{ipc_section}, the matter is {status_clause}."
    ),
    "DEFAULT": (
        "On {date} at approximately {time}, a complaint was registered at {police_station} by or on behalf of "
        "{victim}, aged {victim_age}, in connection with an incident near {location}. {accused_clause} "
        "The case is registered under {ipc_section} and is {status_clause}."
    ),
}
# ---------------------------------------------------------------------------
