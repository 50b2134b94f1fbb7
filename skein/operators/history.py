"""State over time: observations, versions, spells, transitions, streaks, lookups as of a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accepted(observations: DataFrame, key: str, arrival: Sequence[str], seen: str, content: Sequence[str]) -> DataFrame:
    """Observations in order of arrival with their outcome: new, changed, unchanged or stale.

    An observation older than the latest one already taken of its key is stale and changes
    nothing; of the others one is changed if `content` differs from the last one taken.
    Equal times are not stale. The first of a key is new. Ties in `arrival` must not occur.
    """
    order = Window.partitionBy(key).orderBy(*arrival)
    newest = F.max(seen).over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = observations.withColumn("_stale", F.coalesce(F.col(seen) < newest, F.lit(False)))
    taken = F.when(~F.col("_stale"), F.struct(*content))
    before = F.last(taken, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    same = F.lit(True)
    for c in content:
        same = same & F.col(c).eqNullSafe(F.col(f"_before.{c}"))
    outcome = F.when(F.col("_stale"), "stale").when(F.col("_before").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return placed.withColumn("_before", before).withColumn("outcome", outcome).drop("_before", "_stale")


def versions(observations: DataFrame, key: str, at: Sequence[str], content: Sequence[str]) -> DataFrame:
    """(`key`, content, valid_from, valid_to): one row for each run of equal content of a key, the last open (null)."""
    order = Window.partitionBy(key).orderBy(*at)
    differs = F.lit(False)
    for c in content:
        differs = differs | ~F.col(c).eqNullSafe(F.lag(c).over(order))
    starts = observations.withColumn("_first", F.row_number().over(order) == 1).withColumn("_new", F.col("_first") | differs).where("_new")
    return starts.select(key, *content, F.col(at[0]).alias("valid_from"), F.lead(at[0]).over(order).alias("valid_to"))


def transitions(observations: DataFrame, key: str, at: Sequence[str], state: str) -> DataFrame:
    """(`key`, at, from_state, to_state) wherever a key's state becomes another; null is a state; the first comes from null."""
    order = Window.partitionBy(key).orderBy(*at)
    moved = observations.select(key, *at, F.lag(state).over(order).alias("from_state"), F.col(state).alias("to_state"), (F.row_number().over(order) == 1).alias("_first"))
    return moved.where(F.col("_first") | ~F.col("from_state").eqNullSafe(F.col("to_state"))).drop("_first")


def spells(sightings: DataFrame, key: str, day: str, gap_days: int) -> DataFrame:
    """(`key`, first_day, last_day, n_days): runs of days on which a key was seen, at most `gap_days` apart."""
    days = sightings.select(key, F.col(day).alias("_d")).distinct()
    order = Window.partitionBy(key).orderBy("_d")
    new = F.when(F.date_diff("_d", F.lag("_d").over(order)) <= gap_days, 0).otherwise(1)
    return days.withColumn("_new", new).withColumn("_spell", F.sum("_new").over(order)).groupBy(key, "_spell").agg(F.min("_d").alias("first_day"), F.max("_d").alias("last_day"), F.count("*").alias("n_days")).drop("_spell")


def missing_streaks(seen: DataFrame, runs: DataFrame, board: str, key: str, run: str, threshold: int, cap_least: int, cap_share: float) -> DataFrame:
    """(`board`, `key`, streak, closes): how many counting runs in a row ended without a key, and whether that closes it.

    `runs` holds the runs that count; `seen` the keys met in each. A key missing in
    `threshold` runs or more closes, unless its board would close more than
    max(cap_least, cap_share of its keys): then none of them does.
    """
    order = Window.partitionBy(board).orderBy(run)
    numbered = runs.select(board, run).distinct().withColumn("_no", F.row_number().over(order))
    last = numbered.groupBy(board).agg(F.max("_no").alias("_runs"))
    met = seen.select(board, key, run).distinct().join(numbered, [board, run]).groupBy(board, key).agg(F.max("_no").alias("_met"))
    streaks = met.join(last, board).select(board, key, (F.col("_runs") - F.col("_met")).cast("int").alias("streak"))
    load = streaks.groupBy(board).agg(F.count_if(F.col("streak") >= threshold).alias("_close"), F.count("*").alias("_all"))
    held = F.col("_close") > F.greatest(F.lit(cap_least), F.floor(F.col("_all") * cap_share))
    return streaks.join(load, board).select(board, key, "streak", ((F.col("streak") >= threshold) & ~held).alias("closes"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, valid: str, tie: str, keep: Sequence[str]) -> DataFrame:
    """`left` with the columns `keep` of the last row of `right` of the same key with `valid` <= `at`; null if none.

    One sort of both sides' union, no join that pairs all rows of a key: rows of `right` come
    before rows of `left` of the same instant, ties within `right` by `tie`. A hot key is
    still one window; its rows are streamed, not held.
    """
    a = left.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*keep)).schema[0].dataType).alias("_r"))
    b = right.select(F.col(key).alias("_k"), F.col(valid).alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), F.struct(*keep).alias("_r"))
    order = Window.partitionBy("_k").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return a.unionByName(b).withColumn("_r", F.last("_r", ignorenulls=True).over(order)).where("_side = 1").select("_l.*", *(F.col(f"_r.{c}").alias(c) for c in keep))


def any_member(members: DataFrame, group: str, tests: dict[str, Column], aggregates: dict[str, Column]) -> DataFrame:
    """One row a group of which for each of `tests` some member passes, not always the same one; with `aggregates`.

    One aggregation in place of a correlated subquery for each test.
    """
    out = members.groupBy(group).agg(*(F.coalesce(F.bool_or(t), F.lit(False)).alias(f"_t_{n}") for n, t in tests.items()), *(a.alias(n) for n, a in aggregates.items()))
    for n in tests:
        out = out.where(F.col(f"_t_{n}"))
    return out.select(group, *aggregates)
