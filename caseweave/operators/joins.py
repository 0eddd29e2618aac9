"""Case flattening, child attachment, dossier joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.operators.graph import associates, degrees
from caseweave.operators.scale import top_per_group


def lookup(df: DataFrame, dim: DataFrame, on: str, columns: list[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Left lookup of dimension columns, with defaults where the key is absent."""
    out = df.join(dim.select(on, *columns), on, "left")
    for column, value in (defaults or {}).items():
        out = out.withColumn(column, F.coalesce(F.col(column), F.lit(value)))
    return out


def attach_children(parents: DataFrame, children: DataFrame, key: str, order: list[str], columns: list[str], prefix: str) -> DataFrame:
    """Each parent with its number of children and the columns of the first child."""
    first = F.struct(*order)
    rolled = children.groupBy(key).agg(
        F.count("*").alias(f"{prefix}_count"), *[F.min_by(c, first).alias(f"{prefix}_{c}") for c in columns]
    )
    return parents.join(rolled, key, "left").withColumn(f"{prefix}_count", F.coalesce(f"{prefix}_count", F.lit(0)))


def available(df: DataFrame, context: DataFrame, left: str, right: str, columns: list[str], prefix: str) -> DataFrame:
    """Optional context by name, ignoring case, with an availability flag."""
    side = context.select(F.lower(right).alias("_key"), *[F.col(c).alias(f"{prefix}_{c}") for c in columns], F.lit(True).alias(f"{prefix}_available"))
    return (
        df.withColumn("_key", F.lower(left)).join(side, "_key", "left").drop("_key")
        .withColumn(f"{prefix}_available", F.coalesce(f"{prefix}_available", F.lit(False)))
    )


def union_roles(*parts: tuple[DataFrame, str, Column, Column]) -> DataFrame:
    """(case_id, person_id, role) from one frame per role."""
    frames = [df.select(case.alias("case_id"), person.alias("person_id"), F.lit(role).alias("role")) for df, role, case, person in parts]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def dossiers(people: DataFrame, key: str, risk: DataFrame, edges: DataFrame, names: DataFrame, links: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(heads, associates, cases) for all people at once.

    heads: person, risk columns, degree, number of cases. associates: at most ``n``
    strongest neighbours with their names. cases: every link in long form, so a
    person with very many cases stays many rows.
    """
    counts = links.groupBy(key).agg(F.count("*").alias("n_links"))
    heads = (
        people.join(risk, key, "left").join(degrees(edges).select(F.col("id").alias(key), "degree"), key, "left").join(counts, key, "left")
        .withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    )
    close = associates(edges, n).withColumnRenamed("id", key).join(people.select(key), key, "left_semi")
    close = close.join(names.select(F.col(key).alias("other"), F.col("name").alias("other_name")), "other", "left")
    return heads, close, links.join(people.select(key), key, "left_semi")


def other_endpoint(edges: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, associate, weight) for edges that touch a wanted id at either end."""
    ends = F.array(
        F.struct(F.col("a").alias("id"), F.col("b").alias("associate")), F.struct(F.col("b").alias("id"), F.col("a").alias("associate"))
    )
    return edges.select(F.explode(ends).alias("e"), "weight").select(F.col("e.id").alias(key), "e.associate", "weight").join(
        wanted.select(key).distinct(), key, "left_semi"
    )


def touching(edges: DataFrame, ids: DataFrame, key: str, label: Column) -> DataFrame:
    """Edges with either endpoint in the id set, or with the label."""
    flag = ids.select(F.col(key).alias("_id"), F.lit(True).alias("_hit")).distinct()
    left = edges.join(flag.withColumnsRenamed({"_id": "from_id", "_hit": "_from"}), "from_id", "left")
    both = left.join(flag.withColumnsRenamed({"_id": "to_id", "_hit": "_to"}), "to_id", "left")
    return both.where(F.col("_from").isNotNull() | F.col("_to").isNotNull() | label).drop("_from", "_to")


def first_seen(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return top_per_group(df, [key], order, 1, "_rk").drop("_rk")
