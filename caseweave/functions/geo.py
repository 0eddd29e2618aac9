"""Coordinates: great-circle distance, hash jitter, place lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088
# fixed values: suffix words dropped before a gazetteer lookup, fallback centre, jitter span
GAZETTEER_SUFFIX_PATTERN = r"\b(COMMR\.?|RURAL|URBAN|CITY|TOTAL|DT\.?|GRP\.?)\b"
FALLBACK_CENTRE = (22.9734, 78.6569)
JITTER_DEGREES = 0.6


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return F.asin(F.sqrt(F.least(chord, F.lit(1.0)))) * (2 * EARTH_RADIUS_KM)


def hash_offset(seed: Column, start: int, span: float = JITTER_DEGREES) -> Column:
    """Deterministic offset in [-span, span] from eight hex digits of SHA-256."""
    word = F.conv(F.substring(F.sha2(seed, 256), start, 8), 16, 10).cast("double")
    return (word / F.lit(float(0xFFFFFFFF)) - 0.5) * (2 * span)


def strip_place_suffix(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.upper(name), GAZETTEER_SUFFIX_PATTERN, "")), r"\s+", " "))


def locate(df: DataFrame, place: str, super_place: str, gazetteer: DataFrame, centres: DataFrame) -> DataFrame:
    """Adds lat, lon, precise: exact name, else suffix-stripped name, else first word,
    else the super-place centre shifted by the hash of the place name.

    ``gazetteer`` (name, lat, lon) and ``centres`` (name, lat, lon) hold upper-case names; of a
    repeated name the smallest coordinates count. A missing super-place falls back to the
    centre of all.
    """
    gazetteer, centres = (t.groupBy("name").agg(F.min(F.struct("lat", "lon")).alias("at")).select("name", "at.*") for t in (gazetteer, centres))
    keys = {
        "exact": F.upper(F.trim(F.col(place))),
        "stripped": strip_place_suffix(F.col(place)),
        "word": F.split(strip_place_suffix(F.col(place)), " ")[0],
    }
    # a row without a place name gets no coordinates
    places = df.select(place, super_place).where(F.col(place).isNotNull()).distinct()
    for tag, key in keys.items():
        hit = gazetteer.select(F.col("name").alias(f"_{tag}"), F.struct("lat", "lon").alias(f"_g_{tag}"))
        places = places.withColumn(f"_{tag}", key).join(hit, f"_{tag}", "left")
    centre = centres.select(F.col("name").alias("_centre"), F.struct("lat", "lon").alias("_c"))
    places = places.withColumn("_centre", F.upper(F.trim(F.col(super_place)))).join(centre, "_centre", "left")
    hit = F.coalesce("_g_exact", "_g_stripped", "_g_word")
    seed = F.concat(F.coalesce("_centre", F.lit("")), F.lit("|"), F.col(place))
    placed = places.select(
        place, super_place,
        F.coalesce(hit["lat"], F.round(F.coalesce(F.col("_c.lat"), F.lit(FALLBACK_CENTRE[0])) + hash_offset(seed, 1), 5)).alias("lat"),
        F.coalesce(hit["lon"], F.round(F.coalesce(F.col("_c.lon"), F.lit(FALLBACK_CENTRE[1])) + hash_offset(seed, 9), 5)).alias("lon"),
        hit.isNotNull().alias("precise"),
    )
    placed = placed.withColumnsRenamed({place: "_place", super_place: "_super"})
    same = F.col(place).eqNullSafe(F.col("_place")) & F.col(super_place).eqNullSafe(F.col("_super"))
    return df.join(placed, same, "left").drop("_place", "_super")
