"""Exact quantiles of groups of any size, from counts by value and prefix sums over ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.session import cut


def quantiles(counts: DataFrame, by: Sequence[str], value: str, weight: str, probabilities: Sequence[float], unique: bool = False) -> DataFrame:
    """(`by`, n, q): the interpolated quantiles of `value`, each counted `weight` times, as an array of doubles; groups may be null.

    Values are range-partitioned by group and value; each range sums its weights up and the ranges' totals, few
    rows, are summed up over the ranges, so that no task holds a group. `unique` says that a value comes once a group, so that the counts need not be summed first. Null values and weights below one are left out; a group without values has no row.
    """
    rows = counts.where(F.col(value).isNotNull() & (F.col(weight) > 0)).select(*by, F.col(value).cast("double").alias("_v"), F.col(weight).cast("long").alias("_c"))
    summed = rows if unique else rows.groupBy(*by, "_v").agg(F.sum("_c").alias("_c"))
    ordered = cut(summed.repartitionByRange(*by, "_v").sortWithinPartitions(*by, "_v")).withColumn("_p", F.spark_partition_id())
    ranges = ordered.groupBy(*by, "_p").agg(F.sum("_c").alias("_s"))
    cell = Window.partitionBy(*by)
    starts = ranges.select(*by, "_p", (F.sum("_s").over(cell.orderBy("_p")) - F.col("_s")).alias("_b"), F.sum("_s").over(cell).alias("n"))
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]
    on = F.col("o._p") == F.col("s._p")
    for c in same:
        on = on & c
    inside = Window.partitionBy("_p", *by).orderBy("_v")
    running = ordered.withColumn("_t", F.sum("_c").over(inside))
    placed = running.alias("o").join(starts.alias("s"), on).select(*(F.col(f"o.{c}").alias(c) for c in by), "o._v", "s.n", (F.col("s._b") + F.col("o._t")).alias("_to"))
    at = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    first = lambda i: F.min(F.when(F.col("_to") > i, F.col("_v")))
    found = placed.groupBy(*by, "n").agg(*(x for i, p in enumerate(probabilities) for x in (first(F.floor(at(p))).alias(f"_l{i}"), first(F.ceil(at(p))).alias(f"_h{i}"))))
    between = lambda i, p: F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (at(p) - F.floor(at(p)))
    return found.select(*by, "n", F.array(*(between(i, p) for i, p in enumerate(probabilities))).alias("q"))


def medians(rows: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(`by`, `values`): the median of each of `values` by group, by one call of `quantiles` for all; rows count as often as they come."""
    long = rows.select(*by, F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(v).cast("double").alias("v")) for i, v in enumerate(values)))).alias("_x")).select(*by, F.col("_x.i").alias("_i"), F.col("_x.v").alias("_v"), F.lit(1).alias("_c"))
    found = quantiles(long, [*by, "_i"], "_v", "_c", [0.5])
    pick = lambda i: F.max(F.when(F.col("_i") == i, F.col("q")[0]))
    return found.groupBy(*by).agg(*(pick(i).alias(v) for i, v in enumerate(values)))

