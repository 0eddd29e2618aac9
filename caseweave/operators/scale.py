"""Building blocks that keep hot keys and global orderings out of a single task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseweave.session import materialise

HOT_GROUP = 2_000
#: Rows that one task should get of a shuffle.
TASK_ROWS = 1_000_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of about ``rows`` rows dealt by ``keys`` to as many tasks as keep each at ``TASK_ROWS``, so that a task's
    memory does not grow with the input; left as it is where one task could hold them.

    The number of tasks is always stated: partitions of Spark's own number are put together again by their bytes,
    and many millions of keys fit into the bytes of one.
    """
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism), *keys) if tasks > 1 else df


def join_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys of which any may be NULL; NULL meets NULL."""
    named = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    condition = match[0]
    for part in match[1:]:
        condition = condition & part
    return left.join(named, condition, "left").drop(*[f"_k_{k}" for k in keys])


def total(df: DataFrame, aggregate: Column) -> Column:
    """One aggregate over all of ``df`` as a scalar subquery (no join)."""
    return df.agg(aggregate.alias("v")).scalar()


def _sort_keys(values: DataFrame) -> DataFrame:
    """(name, key) of (name, v): 64-bit integers in the order of the doubles; NaN is the largest, both zeros are one."""
    def run(batches):
        for batch in batches:
            v = batch.column("v").to_numpy(zero_copy_only=False) + 0.0
            v[np.isnan(v)] = np.nan
            bits = v.view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(bits ^ ((bits >> 63) & np.int64(2**63 - 1)))], ["name", "key"])

    return values.mapInArrow(run, "name string, key long")


def _value(key: int) -> float:
    bits = np.int64(key)
    return float((bits ^ ((bits >> np.int64(63)) & np.int64(2**63 - 1))).view(np.float64))


def _radix_select(keys: DataFrame, ranks: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """Order statistics of (name, key) rows, all together, 16 bits in a pass."""
    # (name, rank) -> (leading bits known so far, rank among the keys that have them)
    at = {(name, r): (None, r) for name, own in ranks.items() for r in own}
    for shift in (48, 32, 16, 0):
        rows = keys
        if shift < 48:
            wanted = sorted({(name, lead) for (name, _), (lead, _) in at.items()})
            asked = F.lit(False)
            for name in sorted(ranks):
                leads = [lead for n, lead in wanted if n == name]
                if leads:
                    asked = asked | ((F.col("name") == name) & F.shiftright("key", shift + 16).isin(leads))
            rows = keys.where(asked)
        held: dict[tuple[str, int | None], list[tuple[int, int]]] = {}
        for r in rows.groupBy("name", F.shiftright("key", shift).alias("lead")).agg(F.count("*").alias("n")).collect():
            held.setdefault((r["name"], r["lead"] >> 16 if shift < 48 else None), []).append((r["lead"], r["n"]))
        for steps in held.values():
            steps.sort()
        for (name, rank), (lead, left) in at.items():
            for step, n in held[name, lead]:
                if left < n:
                    break
                left -= n
            at[name, rank] = (step, left)
    return {key: _value(lead) for key, (lead, _) in at.items()}


def quantiles_together(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]]) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles of several columns or array columns: name -> (column, probabilities).

    Null values are left out. The values are written once as order-preserving integers; then every
    order statistic of every column is found together, by histograms of 16 bits in a pass: four
    passes and at most 65,536 counts for each open statistic, whatever the size of the data.
    """
    def listed(name: str, column: Column) -> Column:
        multiple = dict(df.select(column.alias("c")).dtypes)["c"].startswith("array")
        return F.transform(column if multiple else F.array(column), lambda v: F.struct(F.lit(name).alias("name"), v.cast("double").alias("v")))

    entries = [listed(name, column) for name, (column, _) in wanted.items()]
    values = df.select(F.explode(F.concat(*entries)).alias("e")).select("e.name", "e.v").where(F.col("v").isNotNull())
    keys = materialise(_sort_keys(values), "values")
    sizes = {r["name"]: r["n"] for r in keys.groupBy("name").agg(F.count("*").alias("n")).collect()}
    places = {name: [p * (sizes[name] - 1) for p in probs] for name, (_, probs) in wanted.items() if name in sizes}
    ranks = {name: sorted({r for x in own for r in (int(x), min(int(x) + 1, sizes[name] - 1))}) for name, own in places.items()}
    at = _radix_select(keys, ranks) if ranks else {}

    def between(name: str, x: float) -> float:
        low, high = at[name, int(x)], at[name, min(int(x) + 1, sizes[name] - 1)]
        return low if low == high or x == int(x) else low + (high - low) * (x - int(x))

    return {name: [between(name, x) for x in places[name]] if name in places else [None] * len(probs) for name, (_, probs) in wanted.items()}


def exact_quantiles(df: DataFrame, column: str | Column, probs: list[float]) -> list[float | None]:
    """Exact linearly interpolated quantiles of the non-null values of one column."""
    return quantiles_together(df, {"v": (F.col(column) if isinstance(column, str) else column, probs)})["v"]


def day_running_sums(df: DataFrame, key: list[str], day: str, order: list[str], sums: dict[str, Column], first_day: str | None = None) -> DataFrame:
    """Running sums over the rows strictly before each row of its key; optionally the key's first day.

    Rows are ordered by (day, *order). The window over a whole key only sees one
    row per day, and the row-level window only sees one day of one key, so a key
    that owns a third of the table is still spread over many tasks.
    """
    tagged = df.select("*", *[expr.cast("long").alias(f"_v_{name}") for name, expr in sums.items()])
    daily = tagged.groupBy(*key, day).agg(*[F.sum(f"_v_{name}").alias(f"_d_{name}") for name in sums])
    before = W.partitionBy(*key).orderBy(day).rowsBetween(W.unboundedPreceding, -1)
    extra = [F.min(day).over(W.partitionBy(*key)).alias(first_day)] if first_day else []
    offsets = daily.select(
        *key, day, *extra, *[F.coalesce(F.sum(f"_d_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in sums]
    )
    inside = W.partitionBy(*key, day).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = tagged.select(
        "*", *[F.coalesce(F.sum(f"_v_{name}").over(inside), F.lit(0)).alias(f"_l_{name}") for name in sums]
    )
    joined = join_keys(local, offsets, [*key, day])
    return joined.select(
        *df.columns, *([first_day] if first_day else []), *[(F.col(f"_l_{name}") + F.col(f"_o_{name}")).alias(name) for name in sums]
    )


def carry_forward(df: DataFrame, key: list[str], order: str, columns: list[str], chunk: int = 1_000) -> DataFrame:
    """Last non-null value of each column strictly before the row, per key.

    ``order`` is a non-negative integer position, cut in chunks so that a long
    key becomes many bounded windows.
    """
    tagged = df.withColumn("_chunk", F.floor(F.col(order) / chunk).cast("long"))
    ends = tagged.groupBy(*key, "_chunk").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_e_{c}") for c in columns]
    )
    earlier = W.partitionBy(*key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    seeds = ends.select(*key, "_chunk", *[F.last(f"_e_{c}", ignorenulls=True).over(earlier).alias(f"_s_{c}") for c in columns])
    inside = W.partitionBy(*key, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    local = tagged.select("*", *[F.last(c, ignorenulls=True).over(inside).alias(f"_l_{c}") for c in columns])
    return join_keys(local, seeds, [*key, "_chunk"]).select(
        *df.columns, *[F.coalesce(f"_l_{c}", f"_s_{c}").alias(f"prev_{c}") for c in columns]
    )


def chunk_running_sum(df: DataFrame, key: list[str], order: str, value: str, out: str, chunk: int = 1_000) -> DataFrame:
    """Inclusive running sum over an integer position, in bounded chunks per key."""
    tagged = df.withColumn("_chunk", F.floor(F.col(order) / chunk).cast("long"))
    totals = tagged.groupBy(*key, "_chunk").agg(F.sum(value).alias("_t"))
    earlier = W.partitionBy(*key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    seeds = totals.select(*key, "_chunk", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_s"))
    inside = W.partitionBy(*key, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return (
        join_keys(tagged.withColumn("_l", F.sum(value).over(inside)), seeds, [*key, "_chunk"])
        .select(*df.columns, (F.col("_l") + F.col("_s")).alias(out))
    )


def global_running_sum(df: DataFrame, order: list[Column], value: Column, out: str) -> DataFrame:
    """Inclusive running sum in a total order without a one-task window.

    The rows are range partitioned and written, each range is summed, and the
    sum of all earlier ranges is added. ``order`` must be unique for a
    deterministic result.
    """
    ranged = materialise(
        df.withColumn("_v", value.cast("long")).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()),
        "ranges",
    )
    ends = ranged.groupBy("_range").agg(F.sum("_v").alias("_t"))
    offsets = ends.select(
        "_range",
        F.coalesce(F.sum("_t").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"),
    )
    local = F.sum("_v").over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return ranged.withColumn("_l", local).join(offsets, "_range").select(*df.columns, (F.col("_l") + F.col("_o")).alias(out))


def global_rank(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """1-based position of each row in a unique total order."""
    return global_running_sum(df, order, F.lit(1), out)


def group_pairs(members: DataFrame, group: str, item: str, carry: list[str] | None = None, block: int = HOT_GROUP, rows: int = 0) -> DataFrame:
    """Unordered item pairs (a < b) that share a group, one row per (group, a, b).

    A group larger than ``block`` is cut into hashed blocks, and each pair of
    blocks becomes its own join key, so no task sees more than two blocks. ``rows``: about
    how many rows of pairs there will be, if known; the join is dealt to tasks by that.
    """
    carry = carry or []
    members = dealt(members, rows, group)
    sizes = members.groupBy(group).agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("_blocks"))
    placed = members.join(sizes, group).withColumn("_at", F.pmod(F.xxhash64(item), F.col("_blocks")))
    spread = placed.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).select(
        group, item, *carry, "_at",
        F.least("_at", "_other").alias("_lo"), F.greatest("_at", "_other").alias("_hi"),
    )
    spread = dealt(spread, rows, group, "_lo", "_hi")
    left, right = spread.alias("l"), spread.alias("r")
    same_cell = (F.col(f"l.{group}") == F.col(f"r.{group}")) & (F.col("l._lo") == F.col("r._lo")) & (F.col("l._hi") == F.col("r._hi"))
    own_cell = (F.least("l._at", "r._at") == F.col("l._lo")) & (F.greatest("l._at", "r._at") == F.col("l._hi"))
    return left.join(right, same_cell & own_cell & (F.col(f"l.{item}") < F.col(f"r.{item}"))).select(
        F.col(f"l.{group}").alias(group), F.col(f"l.{item}").alias("a"), F.col(f"r.{item}").alias("b"),
        *[F.col(f"l.{c}").alias(f"{c}_a") for c in carry], *[F.col(f"r.{c}").alias(f"{c}_b") for c in carry],
    )


def top_per_group(df: DataFrame, key: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key; Spark trims each map task to ``n`` rows per key before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col(rank) <= n)
