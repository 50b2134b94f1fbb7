"""Closures that need rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import cut


def removable(links: DataFrame, left: str, right: str, left_free: DataFrame, right_free: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The largest sets of lefts and rights, out of those free to go, of which none is linked to one that stays.

    What stays takes its neighbours with it: each round follows the links of what the round before found to stay,
    on both sides at a time, and writes only that to the shared folder. What has no link may go.
    """
    pairs = cut(links.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(F.col(left).alias("l"), F.col(right).alias("r")).distinct())
    a, b = cut(left_free.select(F.col(left).alias("l")).distinct()), cut(right_free.select(F.col(right).alias("r")).distinct())
    stay_l = new_l = cut(pairs.select("l").distinct().join(a, "l", "left_anti"))
    stay_r = new_r = cut(pairs.select("r").distinct().join(b, "r", "left_anti"))
    while True:
        next_l = cut(pairs.join(new_r, "r", "left_semi").select("l").distinct().join(stay_l, "l", "left_anti"))
        next_r = cut(pairs.join(new_l, "l", "left_semi").select("r").distinct().join(stay_r, "r", "left_anti"))
        if next_l.isEmpty() and next_r.isEmpty():
            return a.join(stay_l, "l", "left_anti").withColumnRenamed("l", left), b.join(stay_r, "r", "left_anti").withColumnRenamed("r", right)
        stay_l, stay_r, new_l, new_r = stay_l.union(next_l), stay_r.union(next_r), next_l, next_r
