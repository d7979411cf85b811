"""Running sums in the order of a whole table, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermarc.cluster import stored


def running(rows: DataFrame, group: list[str], order: list[Column], **sums: Column) -> DataFrame:
    """Adds, for each of `sums`, the sum over the rows of the group that come before a row.

    Rows are dealt by ranges of (group, order) and stored with the number of their range, so that a lost
    executor changes no range; they are summed up within it, and each range is given the sums of those before.
    A hot group is many ranges; only rows equal in all of the order share one. The table of sums has a row for
    each group and range. Rows equal in the order take turns in any way. An empty table gives an empty result.
    """
    dealt = rows.withColumns({f"_{k}": v for k, v in sums.items()}).repartitionByRange(*[F.col(c) for c in group], *order)
    dealt = stored(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*group, "_range").agg(*[F.sum(f"_{k}").alias(f"_{k}_sum") for k in sums])
    offsets = offsets.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_range").alias("_at"), *[F.coalesce(F.sum(f"_{k}_sum").over(before), F.lit(0)).alias(f"_{k}_before") for k in sums])
    same = F.col("_range") == F.col("_at")
    for i, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    within = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumns({k: F.coalesce(F.sum(f"_{k}").over(within), F.lit(0)) for k in sums}).join(offsets, same)
    return summed.withColumns({k: F.col(k) + F.col(f"_{k}_before") for k in sums}).select(*rows.columns, *sums)
