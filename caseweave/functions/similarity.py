"""Edit similarity and an exact similarity join that meets on segments of the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def _edits(longer: Column, cutoff: float) -> Column:
    """Edits that two texts may differ by, the longer one having so many characters."""
    return F.floor(longer * (1 - cutoff) + 1e-9).cast("int")


def _borders(length: Column, edits: Column, number: Column) -> tuple[Column, Column]:
    """(characters before, length) of segment ``number`` (from 0) of a text cut into ``edits`` + 1 nearly equal ones."""
    size, longer = F.floor(length / (edits + 1)).cast("int"), F.pmod(length, edits + 1)
    short = edits + 1 - longer
    return number * size + F.greatest(F.lit(0), number - short), size + (number >= short).cast("int")


def segment_keys(names: DataFrame, cutoff: float) -> DataFrame:
    """(block, text, n, edits, number, segment): the segments of each text, for every number of edits it may be asked for."""
    n = F.length("text")
    wide = names.withColumn("n", n).withColumn(
        "edits", F.explode(F.filter(F.sequence(_edits(n, cutoff), _edits(F.floor(n / cutoff + 1e-9), cutoff)), lambda e: e > 0))
    )
    each = wide.withColumn("number", F.explode(F.sequence(F.lit(0), F.col("edits"))))
    before, size = _borders(F.col("n"), F.col("edits"), F.col("number"))
    return each.withColumn("segment", F.substring(F.col("text"), before + 1, size))


def substring_keys(names: DataFrame, cutoff: float, strictly: bool = False) -> DataFrame:
    """(block, text, n, edits, number, segment): what a partner of ``n`` characters, not longer than the text, may have as segments.

    Of a partner within ``edits`` edits one segment is unchanged, and of the edits at most its
    number lie before it and the rest behind it, so it stands at most that far from its place.
    """
    own = F.length("text")
    wide = names.withColumn("edits", _edits(own, cutoff)).where("edits > 0")
    least, most = F.ceil(own * cutoff - 1e-9).cast("int"), own - (1 if strictly else 0)
    each = wide.where(least <= most).withColumn("n", F.explode(F.sequence(least, most))).withColumn("number", F.explode(F.sequence(F.lit(0), F.col("edits"))))
    before, size = _borders(F.col("n"), F.col("edits"), F.col("number"))
    left, right = F.col("number"), F.col("edits") - F.col("number")
    longer = own - F.col("n")
    low = F.greatest(F.lit(0), before - left, before + longer - right)
    high = F.least(own - size, before + left, before + longer + right)
    placed = each.withColumns({"low": low, "high": high, "size": size}).where("low <= high").withColumn("at", F.explode(F.sequence("low", "high")))
    return placed.withColumn("segment", F.substring(F.col("text"), F.col("at") + 1, F.col("size"))).select("block", "text", "n", "edits", "number", "segment").distinct()


def masked_keys(text: Column, cutoff: float, most: int = 16) -> Column:
    """Array of (n, at, before, behind): the text without a window of as many characters as an equally long match may
    differ by, at up to about ``most`` places. Texts that share an entry have an edit ratio >= cutoff."""
    n = F.length(text)
    edits = _edits(n, cutoff)
    edits = F.when((edits > 0) & (1 - edits / n < cutoff), edits - 1).otherwise(edits)
    step = F.greatest(F.lit(1), F.ceil((n - edits) / most).cast("int"))
    return F.transform(F.sequence(n - edits, F.lit(0), -step), lambda at: F.struct(
        n.alias("n"), at.alias("at"), F.substring(text, F.lit(1), at).alias("before"), F.substring(text, at + edits + 1, n).alias("behind")))


def candidate_pairs(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """(block, a, b): pairs of different texts of a block that hold a common segment where a match may have one."""
    key = ["block", "n", "edits", "number", "segment"]
    short_left = segment_keys(left, cutoff).withColumnRenamed("text", "a").join(substring_keys(right, cutoff, False).withColumnRenamed("text", "b"), key)
    short_right = substring_keys(left, cutoff, True).withColumnRenamed("text", "a").join(segment_keys(right, cutoff).withColumnRenamed("text", "b"), key)
    return short_left.select("block", "a", "b").unionByName(short_right.select("block", "a", "b")).where("a != b").distinct()


def similar_text_pairs(left: DataFrame, right: DataFrame, cutoff: float = 0.82) -> DataFrame:
    """(block, a, b, score) for texts of the same block with an edit ratio >= cutoff, equal ones included.

    ``left`` and ``right`` carry (block, text); rows with a null block or text meet nobody. A match
    differs by at most (1 - cutoff) of the longer length in edits, so of one edit more segments of
    the shorter text one stands unchanged in the longer one, near its place: block, length, number
    of the segment and the segment are keys of an equi join, and no block is compared as a whole.
    """
    if not 0 < cutoff <= 1:
        raise ValueError("cutoff must be above 0 and at most 1")
    left = left.select("block", "text").where(F.col("text").isNotNull()).distinct()
    right = right.select("block", "text").where(F.col("text").isNotNull()).distinct()
    near = candidate_pairs(left, right, cutoff).withColumn("score", edit_ratio(F.col("a"), F.col("b"))).where(F.col("score") >= cutoff)
    same = left.join(right, ["block", "text"]).select("block", F.col("text").alias("a"), F.col("text").alias("b"), F.lit(1.0).alias("score"))
    return near.unionByName(same)
