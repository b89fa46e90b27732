"""Batch numbers, summaries, cluster means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

QUANTILES = (0.5, 0.75, 0.9, 0.95, 0.99)


def batch_numbers(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """df with `batch`: 1 for the first `size` rows in the given order, then 2 and so on.

    The rows are range-partitioned, sorted and numbered within their ranges, and written once; the ranges' counts, one row each,
    give the offsets. So no task holds all rows, as one window over the whole table would."""
    if size < 1:
        raise ValueError("size must be at least 1")
    ids = df.repartitionByRange(*(F.asc_nulls_first(c) for c in order)).sortWithinPartitions(*(F.asc_nulls_first(c) for c in order)).withColumn("__id", F.monotonically_increasing_id())
    kept = materialize(ids, "batches").withColumn("__part", F.shiftright("__id", 33))
    counts = kept.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    nth = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(F.broadcast(before), "__part").withColumn("batch", (F.floor(nth / size) + 1).cast("int")).drop("__id", "__part", "__before")


def latency_summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """avg, min, max and exact quantiles (linear interpolation) of a column; nulls don't count.

    The values are range-partitioned and sorted, equal ones being spread by a hash; a value's rank follows from its place in its range and
    the counts of groups in the ranges before, one row a group and range. Only the values next to a quantile are gathered: no task
    holds a group's values. Groups without values have no row; without groups an empty table has one row of nulls."""
    by = by or []
    keyed = df.select(*(F.col(c).alias(f"__by{i}") for i, c in enumerate(by)), F.col(value).cast("double").alias("__x")).where("__x is not null")
    keys = [f"__by{i}" for i in range(len(by))]
    order = [*(F.asc_nulls_first(c) for c in keys), F.asc("__x")]
    ranges = keyed.withColumn("__salt", F.xxhash64("__x", F.monotonically_increasing_id())).repartitionByRange(*order, F.col("__salt")).sortWithinPartitions(*order)
    kept = materialize(ranges.drop("__salt").withColumn("__id", F.monotonically_increasing_id()), "ranks")
    part = kept.withColumn("__part", F.shiftright("__id", 33))
    counts = part.groupBy(*keys, "__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"), F.sum("__x").alias("__sum"), F.min("__x").alias("__min"), F.max("__x").alias("__max"))
    sized = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part")) - F.col("__n")).withColumn("__all", F.sum("__n").over(Window.partitionBy(*keys)))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*keys, "__part"]]
    condition = same[0]
    for each in same[1:]:
        condition = condition & each
    place = F.col("__id") - F.col("__first") + F.col("__before")
    ranked = part.alias("p").join(sized.alias("c"), condition).select(*(F.col(f"p.{c}").alias(c) for c in keys), "p.__x", "__all", place.alias("__place"))
    wanted = [(F.col("__all") - 1) * F.lit(q) for q in QUANTILES]
    near = ranked.where(F.array_contains(F.array(*(f(w) for w in wanted for f in (F.floor, F.ceil))), F.col("__place")))
    # a value counts for a quantile by how near its rank is; the two around it sum up to one
    shares = [F.sum(F.greatest(F.lit(0.0), 1 - F.abs(F.col("__place") - w)) * F.col("__x")).alias(f"p{round(q * 100)}") for q, w in zip(QUANTILES, wanted, strict=True)]
    at = near.groupBy(*keys).agg(*shares)
    whole = counts.groupBy(*keys).agg((F.sum("__sum") / F.sum("__n")).alias("avg_value"), F.min("__min").alias("min_value"), F.max("__max").alias("max_value"))
    if not keys:
        found = whole.crossJoin(at)  # one row each
    else:
        same = [F.col(f"w.{c}").eqNullSafe(F.col(f"a.{c}")) for c in keys]
        condition = same[0]
        for each in same[1:]:
            condition = condition & each
        found = whole.alias("w").join(at.alias("a"), condition).select("w.*", *(f"a.p{round(q * 100)}" for q in QUANTILES))
    return found.select(*(F.col(k).alias(c) for k, c in zip(keys, by, strict=True)), "avg_value", "min_value", "max_value", *(f"p{round(q * 100)}" for q in QUANTILES))


def cluster_mean(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(cluster, dim, mean): the mean of each element over a cluster's vectors; partial sums before the shuffle."""
    return df.select(F.col(cluster).alias("cluster"), F.posexplode(vector).alias("dim", "x")).groupBy("cluster", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))
