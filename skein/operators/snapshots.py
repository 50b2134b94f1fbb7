"""Typed changes between consecutive full snapshots.

Method: snapshots are range-partitioned and sorted by key, and each range is merged in
one pass with two cursors, the row of the earlier and the row of the later snapshot of
the same key. Rows delivered again are reduced to one per key and snapshot before the
range shuffle (with map-side combine), so that no redelivery makes a range hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_WHITE = "[\\s\\p{Z}\\x{200B}\\x{FEFF}]+"


def plain(text: Column) -> Column:
    """Text for comparison: white space and letter case don't count, null is empty."""
    return F.coalesce(F.lower(F.regexp_replace(text, _WHITE, "")), F.lit(""))


def snapshot_order(runs: DataFrame, board: str, snapshot: str, counts: str) -> DataFrame:
    """Each counting snapshot of a board with its place in the board's sequence and the snapshot after it.

    A run counts where `counts` is true; null is false. Several counting runs of one
    snapshot are one.
    """
    seen = runs.where(F.col(counts) & F.col(snapshot).isNotNull()).select(board, snapshot).distinct()
    w = Window.partitionBy(board).orderBy(snapshot)
    return seen.select(board, snapshot, F.row_number().over(w).alias("_at"), F.lead(snapshot).over(w).alias("_next"))


def snapshot_changes(
    rows: DataFrame,
    order: DataFrame,
    board: str,
    snapshot: str,
    key: str,
    version: str,
    text_fields: Sequence[str],
    other_fields: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """One row a change: `board`, `snapshot` (the later of the two), `key`, change_kind, changed_fields.

    `order` comes from `snapshot_order`; rows of other snapshots are ignored. Of several
    rows of a key in one snapshot the one with the latest `version` counts (null is
    earliest; ties go to the greatest field values, so the result never depends on the
    order of rows). Rows with a null board, snapshot or key are no records and are left
    out. The first counting snapshot has none before it and yields nothing; a counting
    snapshot without rows removes every key. Further columns are ignored, whatever their
    names. Empty input gives an empty result.
    """
    fields = [*text_fields, *other_fields]
    compared = [*(plain(F.col(c)).alias(f"_f{i}") for i, c in enumerate(text_fields)), *(F.col(c).alias(f"_f{i + len(text_fields)}") for i, c in enumerate(other_fields))]
    slim = rows.where(F.col(key).isNotNull()).select(F.col(board).alias("_b"), F.col(snapshot).alias("_s"), F.col(key).alias("_k"), F.struct(F.col(version).alias("_v"), *compared).alias("_row"))
    placed = order.select(F.col(board).alias("_b"), F.col(snapshot).alias("_s"), "_at", "_next")
    one = slim.join(placed, ["_b", "_s"]).groupBy("_b", "_k", "_at", "_s", "_next").agg(F.max("_row").alias("_row"))
    keyed = (one.repartitionByRange(ranges, "_b", "_k") if ranges else one.repartitionByRange("_b", "_k")).sortWithinPartitions("_b", "_k", "_at")

    cursor = Window.partitionBy("_b", "_k").orderBy("_at")
    here = F.struct("_at", "_row")
    merged = keyed.select("*", F.lag(here).over(cursor).alias("_before"), F.lead("_at").over(cursor).alias("_later"))
    follows = F.col("_before._at") == F.col("_at") - 1
    differing = F.array_compact(F.array(*(F.when(~F.col(f"_before._row._f{i}").eqNullSafe(F.col(f"_row._f{i}")), F.lit(c)) for i, c in enumerate(fields))))
    none = F.array().cast("array<string>")
    arrival = F.when(F.col("_at") == 1, None).when(F.coalesce(follows, F.lit(False)), F.when(F.size(differing) > 0, F.struct(F.col("_s").alias("s"), F.lit("changed").alias("kind"), differing.alias("fields")))).otherwise(
        F.struct(F.col("_s").alias("s"), F.lit("added").alias("kind"), none.alias("fields"))
    )
    leave = F.when(F.col("_next").isNotNull() & ~F.coalesce(F.col("_later") == F.col("_at") + 1, F.lit(False)), F.struct(F.col("_next").alias("s"), F.lit("removed").alias("kind"), none.alias("fields")))
    return merged.select("_b", "_k", F.explode(F.array_compact(F.array(arrival, leave))).alias("_e")).select(
        F.col("_b").alias(board), F.col("_e.s").alias(snapshot), F.col("_k").alias(key), F.col("_e.kind").alias("change_kind"), F.col("_e.fields").alias("changed_fields")
    )
