"""Repeatable steps over kept tables, trust in places, and scores by words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.geo import metres
from skein.operators.quantiles import medians


def version_step(open_versions: DataFrame, live: DataFrame, key: str, content: Sequence[str], now: Column) -> tuple[DataFrame, DataFrame]:
    """(closed, opened) of one step of kept versions, by one full outer join on the key.

    Closed: open versions whose content is no longer the live one or whose key is gone, with
    valid_to = `now`. Opened: live keys without an open version or with other content, with
    valid_from = `now`. A second step over the result with the same live rows closes and opens nothing.
    """
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    a = open_versions.select(F.col(key).alias("_k"), digest.alias("_a"), F.struct(*open_versions.columns).alias("_old"))
    b = live.select(F.col(key).alias("_j"), digest.alias("_b"), F.struct(key, *content).alias("_new"))
    both = a.join(b, F.col("_k") == F.col("_j"), "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    closed = both.where("_k is not null").select("_old.*", now.alias("valid_to"))
    opened = both.where("_j is not null").select("_new.*", now.alias("valid_from"))
    return closed, opened


def steps_between(states: DataFrame, no: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(before, after) of all steps from one delivery to the next: every state but the last delivery's, every state but the first's.

    `key` becomes the struct (`no`, `key`) with the later delivery's number; `no` itself goes. Deliveries
    follow each other by number, with gaps or without; of them only the few numbers are sorted in one task.
    """
    order = Window.orderBy(no)
    nos = states.select(no).distinct().select(F.col(no).alias("_no"), F.lag(no).over(order).alias("_before"))
    steps = nos.where("_before is not null")

    def side(at: str) -> DataFrame:
        at_step = states.join(steps, F.col(no) == F.col(at))
        return at_step.withColumn(key, F.struct(F.col("_no").alias(no), F.col(key).alias(key))).drop(no, "_no", "_before")

    return side("_before"), side("_no")


def drift(snapshot: DataFrame, now: DataFrame, key: str, digest: str, by: str | None = None) -> DataFrame:
    """One row: how many keys of a snapshot are gone, how many changed, how many are new, and the share that moved; with `by`, a field of a struct `key`, one row for each of its values."""
    a = snapshot.select(F.col(key).alias("_k"), F.col(digest).alias("_a"))
    b = now.select(F.col(key).alias("_j"), F.col(digest).alias("_b"))
    both = a.join(b, F.col("_k") == F.col("_j"), "full_outer")
    gone, new = F.col("_j").isNull(), F.col("_k").isNull()
    sides = both.groupBy(F.coalesce("_k", "_j")[by].alias(by)) if by else both.groupBy()
    out = sides.agg(F.count_if(gone).alias("gone"), F.count_if(new).alias("new"), F.count_if(~gone & ~new & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"), F.count("_k").alias("n"))
    return out.select(*([by] if by else []), "gone", "new", "changed", F.when(F.col("n") > 0, F.round((F.col("gone") + F.col("changed")) / F.col("n"), 6)).otherwise(0.0).alias("share"))


def trusted_pins(rows: DataFrame, key: str, lat: str, lng: str, city: str, street: str, most_streets: int = 2, reach: float = 30_000.0, near: float = 600.0) -> DataFrame:
    """(`key`, is_candidate, is_trusted): whether a row's place can be believed.

    A candidate's position is shared by at most `most_streets` streets of its city and lies
    within `reach` metres of the city's median position; it is trusted if it lies within
    `near` metres of its street's median over distinct candidate positions, of which there must be two.
    Medians are joined back by city and street, never compared row by row.
    """
    base = rows.select(F.col(key).alias("k"), F.col(lat).cast("double").alias("a"), F.col(lng).cast("double").alias("o"), F.col(city).alias("c"), F.col(street).alias("s"))
    spots = base.where("a is not null and o is not null")
    crowded = spots.groupBy("c", "a", "o").agg((F.count_distinct("s") <= most_streets).alias("alone"))
    middle = medians(spots.where("c is not null").select("c", F.col("a").alias("ca"), F.col("o").alias("co")).distinct(), ["c"], ["ca", "co"])
    judged = spots.join(crowded, ["c", "a", "o"]).join(middle, "c").withColumn("cand", F.col("alone") & (metres(F.col("ca"), F.col("co"), F.col("a"), F.col("o"), mean=False) <= reach))
    pins = judged.where("cand and s is not null").select("c", "s", F.col("a").alias("sa"), F.col("o").alias("so")).distinct()
    streets = medians(pins, ["c", "s"], ["sa", "so"]).join(pins.groupBy("c", "s").agg(F.count("*").alias("n")), ["c", "s"])
    trusted = F.coalesce(F.col("cand") & (F.col("n") >= 2) & (metres(F.col("sa"), F.col("so"), F.col("a"), F.col("o")) <= near), F.lit(False))
    done = judged.join(streets, ["c", "s"], "left").select("k", F.col("cand").alias("is_candidate"), trusted.alias("is_trusted"))
    return base.select("k").join(done, "k", "left").select(F.col("k").alias(key), F.coalesce("is_candidate", F.lit(False)).alias("is_candidate"), F.coalesce("is_trusted", F.lit(False)).alias("is_trusted"))


def word_score(found: Column, components: dict[str, tuple[float, Sequence[str], int]]) -> Column:
    """Weighted share of the wanted words among a row's words, over the components that want any.

    A component is (weight, words, enough): it counts min(hits, enough) / enough. Without any
    component the score is 0.
    """
    total, score = 0.0, F.lit(0.0)
    for weight, words, enough in components.values():
        if words:
            total += weight
            hits = F.coalesce(F.size(F.array_intersect(found, F.array(*map(F.lit, words)))), F.lit(0))
            score = score + F.lit(weight) * F.least(hits, F.lit(enough)) / F.lit(enough)
    return F.coalesce(score / F.lit(total), F.lit(0.0)) if total else F.lit(0.0)
