"""Fuzzy joins and entity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseweave.functions.similarity import edit_ratio, masked_keys, segment_keys, similar_text_pairs, substring_keys
from caseweave.functions.text import normalise_name
from caseweave.operators.components import connected_components
from caseweave.operators.scale import global_rank, top_per_group
from caseweave.session import materialise

MATCH_CUTOFF = 0.82  # fixed values
BIRTH_YEAR_BAND = 3


def match_names(left: DataFrame, right: DataFrame, cutoff: float = MATCH_CUTOFF) -> DataFrame:
    """Matches (block, name) rows of ``left`` to ``right``: EXACT when exactly one equal
    name exists in the block, else the best similar name of the block at or above the cutoff.

    ``right`` may repeat a name; the lowest ``right_id`` stands for it.
    """
    targets = right.groupBy("block", "name").agg(F.count("*").alias("copies"), F.min("right_id").alias("right_id"))
    exact = left.join(targets.where(F.col("copies") == 1).select("block", "name", "right_id"), ["block", "name"], "left")
    found = exact.where(F.col("right_id").isNotNull()).select(
        "left_id", "block", "name", "right_id", F.col("name").alias("right_name"), F.lit("EXACT").alias("match_type"), F.lit(1.0).alias("score")
    )
    open_rows = exact.where(F.col("right_id").isNull()).drop("right_id")
    pairs = similar_text_pairs(
        targets.select("block", F.col("name").alias("text")), open_rows.select("block", F.col("name").alias("text")), cutoff
    )
    best = top_per_group(pairs, ["block", "b"], [F.col("score").desc(), F.col("a").desc()], 1, "_rk")
    fuzzy = (
        open_rows.join(best.select("block", F.col("b").alias("name"), F.col("a").alias("right_name"), "score"), ["block", "name"])
        .join(targets.select("block", F.col("name").alias("right_name"), "right_id"), ["block", "right_name"])
        .select("left_id", "block", "name", "right_id", "right_name", F.lit("FUZZY").alias("match_type"), "score")
    )
    return found.unionByName(fuzzy)


def match_summary(left: DataFrame, matches: DataFrame) -> DataFrame:
    """Match counts and rate over all left rows."""
    typed = left.select("left_id").join(matches.select("left_id", "match_type"), "left_id", "left")
    counts = typed.agg(
        F.count("*").alias("n_left"), F.count("match_type").alias("matched"),
        F.count_if(F.col("match_type") == "EXACT").alias("exact"), F.count_if(F.col("match_type") == "FUZZY").alias("fuzzy"),
    )
    return counts.withColumn("unmatched", F.col("n_left") - F.col("matched")).withColumn(
        "match_rate", F.round(F.coalesce(F.try_divide("matched", "n_left"), F.lit(0.0)), 4)
    )


def _units(appearances: DataFrame) -> DataFrame:
    """Appearances of one (block, normalised name, birth year) always end up together,
    so only the first of them takes part in matching."""
    return appearances.withColumn("norm", normalise_name(F.col("name"))).groupBy("block", "norm", "birth_year").agg(
        F.min(F.struct("case_year", "appearance_id")).alias("first")
    )


def _back_to_rows(appearances: DataFrame, named: DataFrame) -> DataFrame:
    """Appearances with the columns found for their unit; missing keys equal missing keys."""
    unit = ["block", "norm", "birth_year"]
    keyed = named.select(*[F.col(c).alias(f"_{c}") for c in unit], *[c for c in named.columns if c not in unit])
    rows = appearances.withColumn("norm", normalise_name(F.col("name")))
    same = F.col("block").eqNullSafe(F.col("_block")) & F.col("norm").eqNullSafe(F.col("_norm")) & F.col("birth_year").eqNullSafe(F.col("_birth_year"))
    return rows.join(keyed, same).drop("norm", *[f"_{c}" for c in unit])


def _links(units: DataFrame, cutoff: float, band: int) -> DataFrame:
    """(earlier, later) unit pairs of a block with similar names and close birth years; names are compared once per block."""
    names = units.select("block", F.col("norm").alias("text")).distinct()
    pairs = materialise(similar_text_pairs(names, names, cutoff), "namepairs").select("block", "a", "b")
    later = units.select("block", F.col("norm").alias("a"), F.col("birth_year").alias("ly"), F.col("first").alias("later"))
    earlier = units.select("block", F.col("norm").alias("b"), F.col("birth_year").alias("ey"), F.col("first").alias("earlier"))
    # a birth-year bucket of the band's width joins to itself and both neighbours
    width = band + 1
    near = later.withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda s: F.floor(F.col("ly") / width) + s)))
    earlier = earlier.withColumn("bucket", F.floor(F.col("ey") / width))
    return (
        pairs.join(near, ["block", "a"]).join(earlier, ["block", "b", "bucket"])
        .where((F.abs(F.col("ly") - F.col("ey")) <= band) & (F.col("earlier") < F.col("later")))
        .select("earlier", "later").distinct()
    )


def resolve_greedy(appearances: DataFrame, prefix: str = "ACC", cutoff: float = MATCH_CUTOFF, band: int = BIRTH_YEAR_BAND) -> DataFrame:
    """Entity ids of a first-come greedy clustering, computed in parallel rounds.

    Rows come in (case_year, appearance_id) order; a row joins the oldest cluster of
    its block whose founder has a similar name and a birth year within the band,
    else it founds one. A unit without an undecided earlier neighbour founds a
    cluster, its later neighbours then cannot, and so on until all are decided. Only units
    that still wait for an earlier one are carried from round to round.

    ``appearances``: appearance_id, block, name, birth_year, case_year.
    """
    units = materialise(_units(appearances), "units")
    links = materialise(_links(units, cutoff, band), "links")
    open_links = links
    fresh = materialise(units.select(F.col("first").alias("unit")).join(links.select(F.col("later").alias("unit")), "unit", "left_anti"), "founders")
    rounds = [fresh]
    while not open_links.isEmpty():
        # per waiting unit: whether a founder of this round claims it, and which earlier ones it still waits for
        marked = open_links.join(fresh.select(F.col("unit").alias("earlier"), F.lit(True).alias("_founds")), "earlier", "left")
        claimed = materialise(marked.where("_founds").select(F.col("later").alias("unit")).distinct(), "claimed")
        left = open_links.join(claimed.select(F.col("unit").alias("later")), "later", "left_anti")
        gone = fresh.unionByName(claimed).select(F.col("unit").alias("earlier"))
        next_links = materialise(left.join(gone, "earlier", "left_anti"), "openlinks")
        free = left.select(F.col("later").alias("unit")).distinct().join(next_links.select(F.col("later").alias("unit")), "unit", "left_anti")
        fresh = materialise(free, "founders")
        rounds.append(fresh)
        open_links = next_links
    founders = rounds[0]
    for found in rounds[1:]:
        founders = founders.unionByName(found)
    founders = materialise(founders, "founders")
    joined = links.join(founders.select(F.col("unit").alias("earlier")), "earlier", "left_semi").groupBy("later").agg(F.min("earlier").alias("owner"))
    owner = units.join(joined, F.col("first") == F.col("later"), "left").join(
        founders.select(F.col("unit").alias("first"), F.lit(True).alias("_founds")), "first", "left"
    ).select("block", "norm", "birth_year", F.when(F.col("_founds"), F.col("first")).otherwise(F.col("owner")).alias("owner"))
    numbered = global_rank(
        founders.select("unit", F.col("unit.case_year").alias("y"), F.col("unit.appearance_id").alias("i")), [F.col("y"), F.col("i")], "n"
    ).select(F.col("unit").alias("owner"), F.format_string(f"{prefix}-%06d", "n").alias("entity_id"))
    return _back_to_rows(appearances, owner.join(numbered, "owner").drop("owner"))


def resolve_components(appearances: DataFrame, cutoff: float = MATCH_CUTOFF, band: int = BIRTH_YEAR_BAND) -> DataFrame:
    """Order-free variant: entities are connected components of the similarity links.

    The entity is named by the smallest first appearance (year, id) of the component.
    Not all similar pairs are needed for that: names that agree but for one window of as many
    characters as they may differ by are linked in the order of their years first, and only
    names of different components are compared after that.
    """
    units = materialise(_units(appearances), "units")
    chained = connected_components(units.select(F.col("first").alias("id")), _chains(units, cutoff, band))
    joined = materialise(units.join(chained, F.col("first") == F.col("id")).drop("id"), "joined")
    links = materialise(_links_between(joined, cutoff, band), "links")
    labels = connected_components(joined.select(F.col("component").alias("id")).distinct(), links).withColumnRenamed("component", "entity")
    named = joined.join(labels, F.col("component") == F.col("id")).select("block", "norm", "birth_year", F.col("entity.appearance_id").alias("entity_id"))
    return _back_to_rows(appearances, named)


def _chains(units: DataFrame, cutoff: float, band: int) -> DataFrame:
    """(a, b): links that connect all units of a block with names alike but for one window and birth years in reach.

    Names that share a masked key are all similar to each other, so in the order of the years
    each unit needs a link to the one before it only.
    """
    known = units.where(F.col("block").isNotNull() & F.col("norm").isNotNull() & F.col("birth_year").isNotNull())
    each = known.select("block", "birth_year", "first", F.explode(masked_keys(F.col("norm"), cutoff)).alias("mask"))
    before = W.partitionBy("block", "mask").orderBy("birth_year", "first")
    linked = each.select(F.lag("first").over(before).alias("a"), F.col("first").alias("b"), (F.col("birth_year") - F.lag("birth_year").over(before)).alias("years"))
    return linked.where(F.col("years") <= band).select("a", "b").distinct()


def _links_between(units: DataFrame, cutoff: float, band: int) -> DataFrame:
    """(a, b): components of units (block, norm, birth_year, component) that similar names and close birth years link.

    Names meet on segments as in the similarity join, but only where a segment is held by more
    than one component, and only with names of another one.
    """
    width = band + 1
    placed = units.select("block", F.col("norm").alias("text"), "component", F.floor(F.col("birth_year") / width).alias("bucket")).distinct()
    # a birth-year bucket of the band's width meets itself and both neighbours
    near = placed.withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda s: F.col("bucket") + s)))

    def mixed(rows: DataFrame, key: list[str]) -> DataFrame:
        return rows.groupBy(*key).agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select(*key)

    open_cells = mixed(near, ["block", "bucket"])
    placed = materialise(placed.join(open_cells, ["block", "bucket"], "left_semi"), "placed")
    near = materialise(near.join(open_cells, ["block", "bucket"], "left_semi"), "near")
    key = ["block", "bucket", "n", "edits", "number", "segment"]
    short = segment_keys(near.select("block", "text").distinct(), cutoff).join(near, ["block", "text"])
    long = substring_keys(placed.select("block", "text").distinct(), cutoff).join(placed, ["block", "text"])
    shared = materialise(mixed(short.select(*key, "component").unionByName(long.select(*key, "component")), key), "sharedkeys")
    short = short.join(shared, key, "left_semi").select(*key, F.col("text").alias("a"), F.col("component").alias("ca"))
    long = long.join(shared, key, "left_semi").select(*key, F.col("text").alias("b"), F.col("component").alias("cb"))
    met = short.join(long, key).where(F.col("ca") != F.col("cb")).select("block", "a", "b").distinct()
    # equal texts of two components have years too far apart
    alike = met.where(edit_ratio(F.col("a"), F.col("b")) >= cutoff)
    left = units.select("block", F.col("norm").alias("a"), F.col("birth_year").alias("ly"), F.col("component").alias("ca"))
    right = units.select("block", F.col("norm").alias("b"), F.col("birth_year").alias("ey"), F.col("component").alias("cb"))
    left = left.withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda s: F.floor(F.col("ly") / width) + s)))
    return (
        alike.join(left, ["block", "a"]).join(right.withColumn("bucket", F.floor(F.col("ey") / width)), ["block", "b", "bucket"])
        .where((F.abs(F.col("ly") - F.col("ey")) <= band) & (F.col("ca") != F.col("cb")))
        .select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    )


def resolution_summary(resolved: DataFrame) -> DataFrame:
    return resolved.agg(F.count("*").alias("appearances"), F.count_distinct("entity_id").alias("entities")).withColumn(
        "relinks", F.col("appearances") - F.col("entities")
    )
