"""Distances, bands and polygons as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.quantiles import medians

METRES = 111_195.0
# Metres that are walked in five minute steps.
BANDS = [(325, 5), (625, 10), (1000, 15), (1325, 20)]


def metres(lat1: Column, lng1: Column, lat2: Column, lng2: Column, mean: bool = True) -> Column:
    """Metres between two places on a flat map, by the cosine of the mean latitude or of the first."""
    at = (lat1 + lat2) / 2 if mean else lat1
    return F.sqrt(F.pow((lat2 - lat1) * METRES, F.lit(2)) + F.pow((lng2 - lng1) * METRES * F.cos(F.radians(at)), F.lit(2)))


def band(distance: Column) -> Column:
    """Minutes on foot of a distance, null beyond the last band."""
    return F.coalesce(*(F.when(distance <= m, F.lit(t)) for m, t in BANDS))


def nearest(rows: DataFrame, key: str, lat: str, lng: str, stations: DataFrame, code: str, s_lat: str, s_lng: str, reach: float) -> DataFrame:
    """(`key`, `code`, metres to 50, minutes, n_in_reach): the nearest station in reach, ties by code; null if none.

    Stations are cut into cells of the reach's size and met by equal cells, so the join does
    not compare every row with every station.
    """
    step = reach / METRES
    cell = lambda c, k: F.floor(c / (step * k)).cast("long")
    here = rows.select(F.col(key).alias("_k"), F.col(lat).alias("_a"), F.col(lng).alias("_o"))
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("_n")
    spots = stations.select(F.col(code).alias("_c"), F.col(s_lat).alias("_sa"), F.col(s_lng).alias("_so"), around).select("_c", "_sa", "_so", (cell(F.col("_sa"), 1.0) + F.col("_n.i")).alias("_x"), (cell(F.col("_so"), 2.0) + F.col("_n.j")).alias("_y"))
    met = here.where("_a is not null and _o is not null").withColumn("_x", cell(F.col("_a"), 1.0)).withColumn("_y", cell(F.col("_o"), 2.0)).join(spots, ["_x", "_y"])
    near = met.withColumn("_d", metres(F.col("_a"), F.col("_o"), F.col("_sa"), F.col("_so"))).where(F.col("_d") <= reach)
    best = near.groupBy("_k").agg(F.min(F.struct("_d", "_c")).alias("_b"), F.count("*").alias("n_in_reach"))
    found = best.select("_k", F.col("_b._c").alias(code), (F.round(F.col("_b._d") / 50) * 50).cast("long").alias("metres"), band(F.col("_b._d")).alias("minutes"), "n_in_reach")
    return here.select("_k").join(found, "_k", "left").select(F.col("_k").alias(key), code, "metres", "minutes", F.coalesce("n_in_reach", F.lit(0)).alias("n_in_reach"))


def inside(lat: Column, lng: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Whether a point lies in a ring of (lat, lng) corners, by the even-odd rule; null for a null point."""
    odd = F.lit(False)
    for (a1, o1), (a2, o2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if a1 != a2:
            cross = ((F.lit(a1) > lat) != (F.lit(a2) > lat)) & (lng < (lat - a1) * (o2 - o1) / (a2 - a1) + o1)
            odd = odd != cross
    low, high = min(a for a, _ in ring), max(a for a, _ in ring)
    left, right = min(o for _, o in ring), max(o for _, o in ring)
    return lat.between(low, high) & lng.between(left, right) & odd


def median_place(rows: DataFrame, key: str, lat: str, lng: str) -> DataFrame:
    """(`key`, lat, lng, n_places): the median over the distinct places of a key; rows without a key or place are ignored."""
    places = rows.where(F.col(lat).isNotNull() & F.col(lng).isNotNull() & F.col(key).isNotNull()).select(key, lat, lng).distinct()
    return medians(places, [key], [lat, lng]).join(places.groupBy(key).agg(F.count("*").alias("n_places")), key)
