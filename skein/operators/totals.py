"""Grouped totals: one leader a group, grouping sets, medians."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.quantiles import quantiles
from skein.session import cut


def with_leaders(rows: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """`rows` with leads: the first of its group in `order`; a row without a group leads itself.

    Null groups are salted by nothing but kept out of the window, so they are no hot group.
    """
    grouped = rows.where(F.col(group).isNotNull()).withColumn("leads", F.row_number().over(Window.partitionBy(group).orderBy(*order)) == 1)
    return grouped.unionByName(rows.where(F.col(group).isNull()).withColumn("leads", F.lit(True)))


def area_totals(rows: DataFrame, areas: Sequence[str], kind: str, band: str, price: str, least: int) -> DataFrame:
    """Totals of leaders by area level, kind and band, each also over all areas and all bands.

    `rows` has leads. A cell of fewer than `least` leaders is not given; a row without a
    band is in the all-bands cells only, one without an area in no cell of that level. Both
    levels of detail come from one grouping-sets aggregation to counts by price; the quartiles
    interpolate and are found from these counts, so no cell is ever in one task.
    """
    sets = [s for area in [None, *areas] for s in ([c for c in (area, kind) if c], [c for c in (area, kind, band) if c])]
    view = rows.select(*areas, kind, band, F.col(price).alias("_price"), "leads")
    flags = [f"_g_{c}" for c in (*areas, band)]
    cell = [*areas, kind, band, *flags]
    counts = cut(
        view.groupingSets([[F.col(c) for c in (*s, "_price")] for s in sets], *(F.col(c) for c in (*areas, kind, band, "_price"))).agg(*(F.grouping(c).alias(f"_g_{c}") for c in (*areas, band)), F.count_if("leads").alias("_l"), F.count("*").alias("_n"))
    )
    sizes = counts.groupBy(*cell).agg(F.sum("_l").alias("listings"), F.sum("_n").alias("posts"))
    found = quantiles(counts, cell, "_price", "_l", [0.25, 0.5, 0.75], unique=True)
    on = F.lit(True)
    for c in cell:
        on = on & F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}"))
    cells = sizes.alias("s").join(found.alias("f"), on, "left").select("s.*", F.col("f.q").alias("_q"))
    level = F.coalesce(*(F.when(F.col(f"_g_{a}") == 0, F.lit(a)) for a in areas), F.lit("all"))
    area = F.coalesce(*(F.when(F.col(f"_g_{a}") == 0, F.col(a).cast("string")) for a in areas))
    no_area = F.lit(False)
    for a in areas:
        no_area = no_area | ((F.col(f"_g_{a}") == 0) & F.col(a).isNull())
    kept = cells.where((F.col("listings") >= least) & ((F.col(f"_g_{band}") == 1) | F.col(band).isNotNull()) & ~no_area)
    return kept.select(
        level.alias("area_level"), F.coalesce(area, F.lit("")).alias("area"), kind, F.when(F.col(f"_g_{band}") == 1, F.lit("all")).otherwise(F.col(band).cast("string")).alias("band"), "listings", "posts",
        *(F.round(F.get("_q", F.lit(i)), 4).alias(n) for i, n in enumerate(("price_p25", "price_median", "price_p75"))),
    )


def most_common(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(`key`, `value`, n): each key's most frequent value, ties to the smallest; nulls don't count."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b")).select(key, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))


def units(rows: DataFrame, group: str, where: Column, by: Sequence[str]) -> DataFrame:
    """(`by`, units): rows without a group plus distinct groups, of those that pass `where`."""
    ok = F.coalesce(where, F.lit(False))
    return rows.groupBy(*by).agg((F.count_if(ok & F.col(group).isNull()) + F.count_distinct(F.when(ok, F.col(group)))).alias("units"))
