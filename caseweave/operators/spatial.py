"""Density clustering of coordinates on a grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.functions.geo import EARTH_RADIUS_KM, haversine_km
from caseweave.operators.aggregates import first_ids, modal_value, value_counts
from caseweave.operators.components import connected_components
from caseweave.session import materialise

KM_PER_DEGREE = math.pi * EARTH_RADIUS_KM / 180
SUB = 8


def _cell_width(row: Column, height: float) -> Column:
    """Degrees of longitude per cell in a row of cells, from the row's edge nearest the equator."""
    near = F.least(F.abs(row * height), F.abs((row + 1) * height))
    near = F.when((row < 0) & (row + 1 > 0), F.lit(0.0)).otherwise(near)
    return F.lit(height) / F.greatest(F.cos(F.radians(near)), F.lit(1e-6))


def _reach(lat: Column, row: Column, height: float, eps_km: float) -> Column:
    """Longitude difference beyond which no point of ``row`` can lie within eps of ``lat``."""
    far = F.least(F.greatest(F.abs(lat), F.abs(row * height), F.abs((row + 1) * height)), F.lit(89.9))
    return F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(eps_km / 2 / EARTH_RADIUS_KM)) / F.cos(F.radians(far))))) * 2.0000001


def _neighbour_cells(points: DataFrame, eps_km: float, height: float) -> DataFrame:
    """Every point with each grid cell (nrow, ncol) that can hold a point within eps of it."""
    rows = points.withColumn("nrow", F.explode(F.sequence(F.col("row") - 2, F.col("row") + 2)))
    width, reach = _cell_width(F.col("nrow"), height), _reach(F.col("lat"), F.col("nrow"), height, eps_km)
    first = F.floor((F.col("lon") - reach) / width)
    last = F.floor((F.col("lon") + reach) / width)
    return rows.withColumn("ncol", F.explode(F.sequence(first, last)))


def density_clusters(points: DataFrame, eps_km: float = 15.0, min_points: int = 5) -> DataFrame:
    """(lat, lon, weight, is_core, cluster) per distinct coordinate; cluster null = noise.

    ``points`` has lat, lon, one row per event. Density-based clustering with
    great-circle distance; a point counts itself. The cluster id is the smallest core
    coordinate of the cluster, and a border point goes to the smallest cluster id
    around it.

    Equal coordinates are collapsed to weights. Cells have a diagonal below eps, so
    all points of one cell are mutually near: a cell with enough weight is core as a
    whole and never compared with itself. Only points of sparse cells (fewer than
    ``min_points`` each) look up their neighbours one by one. Two core cells are
    linked by the boxes of their sub-cells; point pairs are compared only for
    sub-cell pairs that the boxes leave open. Longitudes are not wrapped at 180.
    """
    height = eps_km / KM_PER_DEGREE / math.sqrt(2) * 0.999
    coords = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).groupBy("lat", "lon").agg(F.count("*").alias("weight"))
    placed = coords.withColumn("row", F.floor(F.col("lat") / height)).withColumn("col", F.floor(F.col("lon") / _cell_width(F.col("row"), height)))
    cells = placed.groupBy("row", "col").agg(F.sum("weight").alias("cell_weight"))
    grid = materialise(placed.join(cells, ["row", "col"]), "grid")

    dense = grid.where(F.col("cell_weight") >= min_points)
    sparse = grid.where(F.col("cell_weight") < min_points)
    others = grid.select(F.col("row").alias("nrow"), F.col("col").alias("ncol"), F.col("lat").alias("olat"), F.col("lon").alias("olon"), F.col("weight").alias("oweight"))
    near = haversine_km(F.col("lat"), F.col("lon"), F.col("olat"), F.col("olon")) <= eps_km
    around = materialise(
        _neighbour_cells(sparse, eps_km, height).join(others, ["nrow", "ncol"]).where(near)
        .select("lat", "lon", "row", "col", "weight", "olat", "olon", "oweight"),
        "around",
    )
    sparse_core = around.groupBy("lat", "lon", "row", "col", "weight").agg(F.sum("oweight").alias("n")).where(F.col("n") >= min_points)
    cores = materialise(
        dense.select("lat", "lon", "row", "col", "weight", F.lit(True).alias("whole_cell"))
        .unionByName(sparse_core.select("lat", "lon", "row", "col", "weight", F.lit(False).alias("whole_cell"))),
        "cores",
    )
    # core points of one cell are always together, so a cell is one node
    cell = F.struct("row", "col")
    core_ids = cores.select(cell.alias("id")).distinct()
    core_labels = connected_components(core_ids, _cell_links(cores, eps_km, height))
    named = cores.select("lat", "lon", "weight", cell.alias("id")).join(core_labels, "id")
    names = named.groupBy("component").agg(F.min(F.struct("lat", "lon")).alias("cluster"))
    core_points = materialise(named.join(names, "component").select("lat", "lon", "weight", F.lit(True).alias("is_core"), "cluster"), "corepoints")
    border = (
        around.join(core_points.select(F.col("lat").alias("olat"), F.col("lon").alias("olon"), "cluster"), ["olat", "olon"])
        .groupBy("lat", "lon").agg(F.min("cluster").alias("cluster"))
    )
    loose = sparse.select("lat", "lon", "weight").join(core_points.select("lat", "lon"), ["lat", "lon"], "left_anti")
    rest = loose.join(border, ["lat", "lon"], "left").select("lat", "lon", "weight", F.lit(False).alias("is_core"), "cluster")
    return core_points.unionByName(rest)


def _cell_links(cores: DataFrame, eps_km: float, height: float) -> DataFrame:
    """(a, b) core-cell pairs with two core points within eps of each other."""
    width = _cell_width(F.col("row"), height)
    sub = cores.withColumn("srow", F.floor((F.col("lat") / height - F.col("row")) * SUB)).withColumn("scol", F.floor((F.col("lon") / width - F.col("col")) * SUB))
    boxes = materialise(
        sub.groupBy("row", "col", "srow", "scol").agg(
            F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"), F.count("*").alias("k")
        ),
        "boxes",
    )
    # a box looks into every cell that its own corners can reach
    corner = boxes.withColumn("lat", F.when(F.abs("n") > F.abs("s"), F.col("n")).otherwise(F.col("s")))
    rows = corner.withColumn("nrow", F.explode(F.sequence(F.col("row") - 2, F.col("row") + 2)))
    nwidth, reach = _cell_width(F.col("nrow"), height), _reach(F.col("lat"), F.col("nrow"), height, eps_km)
    looking = rows.withColumn(
        "ncol", F.explode(F.sequence(F.floor((F.col("w") - reach) / nwidth), F.floor((F.col("e") + reach) / nwidth)))
    ).drop("lat")
    other = boxes.select(*[F.col(c).alias(("n" if c in ("row", "col") else "o") + c) for c in ("row", "col", "srow", "scol", "s", "n", "w", "e", "k")])
    pairs = looking.join(other, ["nrow", "ncol"]).where(F.struct("row", "col") < F.struct("nrow", "ncol"))
    lat_gap = F.greatest(F.lit(0.0), F.col("os") - F.col("n"), F.col("s") - F.col("on"))
    lon_gap = F.greatest(F.lit(0.0), F.col("ow") - F.col("e"), F.col("w") - F.col("oe"))
    farthest = F.least(F.greatest(F.abs("s"), F.abs("n"), F.abs("os"), F.abs("on")), F.lit(90.0))
    nearest_lat = F.when(F.least("s", "os") * F.greatest("n", "on") <= 0, F.lit(0.0)).otherwise(F.least(F.abs("s"), F.abs("n"), F.abs("os"), F.abs("on")))
    # lower bound: smallest gaps at the latitude with the shortest degrees; upper bound: largest spans at the widest
    half = F.pow(F.sin(F.radians(lat_gap) / 2), 2) + F.pow(F.cos(F.radians(farthest)) * F.sin(F.radians(lon_gap) / 2), 2)
    low = F.asin(F.sqrt(F.least(half, F.lit(1.0)))) * (2 * EARTH_RADIUS_KM)
    lat_span = F.greatest("n", "on") - F.least("s", "os")
    lon_span = F.greatest("e", "oe") - F.least("w", "ow")
    half_up = F.pow(F.sin(F.radians(lat_span) / 2), 2) + F.pow(F.cos(F.radians(nearest_lat)) * F.sin(F.radians(lon_span) / 2), 2)
    high = F.asin(F.sqrt(F.least(half_up, F.lit(1.0)))) * (2 * EARTH_RADIUS_KM)
    bounded = materialise(
        pairs.withColumn("low", low).withColumn("high", high).where(F.col("low") <= eps_km * (1 + 1e-9))
        .select("row", "col", "srow", "scol", "nrow", "ncol", "osrow", "oscol", (F.col("high") <= eps_km * (1 - 1e-9)).alias("sure")),
        "boxpairs",
    )
    sure = bounded.where("sure").select("row", "col", "nrow", "ncol").distinct()
    unsure = bounded.where(~F.col("sure")).join(sure, ["row", "col", "nrow", "ncol"], "left_anti")
    left = sub.select("row", "col", "srow", "scol", "lat", "lon")
    right = sub.select(
        F.col("row").alias("nrow"), F.col("col").alias("ncol"), F.col("srow").alias("osrow"), F.col("scol").alias("oscol"),
        F.col("lat").alias("olat"), F.col("lon").alias("olon"),
    )
    tested = (
        unsure.join(left, ["row", "col", "srow", "scol"]).join(right, ["nrow", "ncol", "osrow", "oscol"])
        .where(haversine_km(F.col("lat"), F.col("lon"), F.col("olat"), F.col("olon")) <= eps_km)
        .select("row", "col", "nrow", "ncol").distinct()
    )
    return sure.unionByName(tested).select(F.struct("row", "col").alias("a"), F.struct(F.col("nrow").alias("row"), F.col("ncol").alias("col")).alias("b"))


def hotspot_profiles(events: DataFrame, labels: DataFrame, place: str, category: str, key: str, precise: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(clusters, noise): one profile per cluster, and the number of noise events.

    Cluster ids are ranks by size (largest first, then coordinate).
    """
    tagged = events.join(labels.select("lat", "lon", "cluster"), ["lat", "lon"])
    inside = tagged.where(F.col("cluster").isNotNull())
    centre = inside.groupBy("cluster").agg(
        F.count("*").alias("point_count"), F.avg("lat").alias("clat"), F.avg("lon").alias("clon"),
        F.avg(F.col(precise).cast("double") if precise else F.lit(None).cast("double")).alias("precise_fraction"),
    )
    radius = (
        labels.where(F.col("cluster").isNotNull()).join(centre, "cluster")
        .groupBy("cluster").agg(F.max(haversine_km(F.col("clat"), F.col("clon"), F.col("lat"), F.col("lon"))).alias("radius_km"))
    )
    profiles = (
        centre.join(radius, "cluster")
        .join(modal_value(inside, ["cluster"], place, "top_place"), "cluster", "left")
        .join(value_counts(inside, ["cluster"], category), "cluster", "left")
        .join(first_ids(inside, ["cluster"], key), "cluster")
        .select(
            "cluster", "point_count", F.round("clat", 5).alias("centroid_lat"), F.round("clon", 5).alias("centroid_lon"),
            F.round("radius_km", 2).alias("radius_km"), "top_place", "counts", "sample_ids", F.round("precise_fraction", 3).alias("precise_fraction"),
        )
    )
    noise = tagged.agg(F.count("*").alias("total_points"), F.count_if(F.col("cluster").isNull()).alias("noise_points"))
    return profiles, noise
