"""Faceted filters with three outcomes: a row passes, fails, or doesn't state the fact.

A filter is two columns, whether the row states the fact and whether it passes. One
projection gives every row its number of failures and, where it is one, which; all counts
"as if this filter were removed" then come from one scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filter:
    """`known` says whether a row states the fact, `test` whether it passes; `keep` lets rows that don't state it pass."""

    name: str
    known: Column
    test: Column
    keep: bool = False


def evaluated(rows: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """`rows` with n_fail, n_unknown (failures by not stating), fail_key (if one failure), unstated (kept without stating).

    Nulls in `known` or `test` count as false.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    known = [yes(f.known) for f in filters]
    fails = [F.when(k, ~yes(f.test)).otherwise(F.lit(not f.keep)) for f, k in zip(filters, known, strict=True)]
    failed = F.array_compact(F.array(*(F.when(x, F.lit(f.name)) for f, x in zip(filters, fails, strict=True)))) if filters else F.array().cast("array<string>")
    unknown = F.array_compact(F.array(*(F.when(x & ~k, F.lit(f.name)) for f, k, x in zip(filters, known, fails, strict=True)))) if filters else F.array().cast("array<string>")
    kept = F.lit(False)
    for f, k in zip(filters, known, strict=True):
        if f.keep:
            kept = kept | ~k
    return rows.select("*", failed.alias("_failed"), unknown.alias("_unknown")).select(
        "*", F.size("_failed").alias("n_fail"), F.size("_unknown").alias("n_unknown"), F.when(F.size("_failed") == 1, F.col("_failed")[0]).alias("fail_key"), kept.alias("unstated")
    ).drop("_failed", "_unknown")


def summary(rows: DataFrame) -> DataFrame:
    """One row: matches, matches kept without stating, rows whose every failure is not stating, all rows. Of `evaluated` rows."""
    return rows.agg(
        F.count_if(F.expr("n_fail = 0")).alias("matches"), F.count_if(F.expr("n_fail = 0 and unstated")).alias("unstated"), F.count_if(F.expr("n_fail > 0 and n_fail = n_unknown")).alias("lenient"), F.count("*").alias("in_scope")
    )


def option_counts(rows: DataFrame, facets: dict[str, Column]) -> DataFrame:
    """(facet, option, n, in_scope): for each facet's values the rows that would match without the facet's own filter.

    A facet is an array column of values under its filter's name (or one no filter has). Every
    value of the scope is listed, those without matches with 0.
    """
    values = F.explode(F.array(*(F.struct(F.lit(name).alias("facet"), F.array_distinct(v).alias("values")) for name, v in facets.items()))).alias("_f")
    long = rows.select("n_fail", "fail_key", values).select("n_fail", "fail_key", "_f.facet", F.explode("_f.values").alias("option"))
    counted = F.count_if((F.col("n_fail") == 0) | ((F.col("n_fail") == 1) & (F.col("fail_key") == F.col("facet"))))
    return long.where("option is not null").groupBy("facet", "option").agg(counted.alias("n"), F.count("*").alias("in_scope"))


def ranked_options(rows: DataFrame, facets: dict[str, Column], chosen: dict[str, list[str]]) -> DataFrame:
    """`option_counts` with place, from 1 in each facet: the most frequent in scope first, ties by name; values `chosen` that no row has come last with 0."""
    found = option_counts(rows, facets)
    asked = rows.sparkSession.createDataFrame([(f, v) for f, values in chosen.items() for v in values], "facet string, option string")
    missing = asked.join(found, ["facet", "option"], "left_anti").select("facet", "option", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("in_scope"))
    return found.unionByName(missing).withColumn("place", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("in_scope"), "option")))


def presets(rows: DataFrame, key: str, tests: dict[str, Column]) -> DataFrame:
    """(preset, n): how many rows would match if the filter `key` were each of `tests`; one scan of `evaluated` rows."""
    base = (F.col("n_fail") == 0) | ((F.col("n_fail") == 1) & (F.col("fail_key") == key))
    counts = rows.agg(*(F.count_if(base & F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("preset"), F.col(n).alias("n")) for n in tests))).alias("x")).select("x.*")


def kind_counts(rows: DataFrame, kind: str, filters: Sequence[Filter], applies: dict[str, Sequence[str]]) -> DataFrame:
    """(`kind`, n): matches of each kind in `applies` under those of the filters that apply to it; one scan for all kinds."""
    yes = lambda f: F.coalesce(f.known & F.coalesce(f.test, F.lit(False)), F.lit(False)) | (F.lit(f.keep) & ~F.coalesce(f.known, F.lit(False)))
    fits = F.lit(False)
    for name, keys in applies.items():
        passes = F.lit(True)
        for f in filters:
            if f.name in keys:
                passes = passes & yes(f)
        fits = fits | ((F.col(kind) == name) & passes)
    return rows.where(F.col(kind).isin(list(applies))).groupBy(kind).agg(F.count_if(fits).alias("n"))


def suggested(rows: DataFrame, key: str, value: Column, kind: str, most: int) -> DataFrame:
    """(value, n, top_kind): the `most` values by matches as if the filter `key` were removed, each with its most frequent kind."""
    base = rows.where((F.col("n_fail") == 0) | ((F.col("n_fail") == 1) & (F.col("fail_key") == key))).select(value.alias("value"), F.col(kind).alias("_k")).where("value is not null")
    by = base.groupBy("value", "_k").agg(F.count("*").alias("c"))
    best = by.groupBy("value").agg(F.sum("c").alias("n"), F.min(F.struct((-F.col("c")).alias("m"), "_k")).alias("b"))
    return best.select("value", "n", F.col("b._k").alias("top_kind")).orderBy(F.desc("n"), "value").limit(most)


def overlapping(low: Column, high: Column, least: float | None, most: float | None) -> Column:
    """Whether a stated range meets the one asked; an open end of either is no bound."""
    low, high = F.coalesce(low, high), F.coalesce(high, low)
    return (F.lit(least is None) | (high >= F.lit(least))) & (F.lit(most is None) | (low <= F.lit(most)))


def closing(at: Column, now: Column, days: int) -> Column:
    """Whether a deadline lies from now to so many days on."""
    return (at >= now) & (at <= now + F.expr(f"interval {days} days"))


def bucket(value: Column, edges: Sequence[tuple[str, float, float]]) -> Column:
    """The name of the first bucket, both ends in, that holds a value; null between buckets."""
    return F.coalesce(*(F.when(value.between(low, high), F.lit(name)) for name, low, high in edges))


def canonical_form(form: dict[str, object], applicable: Sequence[str]) -> dict[str, object]:
    """A form's filters that apply, in the order of `applicable`, lists sorted and without repeats, empty ones left out: equal searches have equal forms."""
    tidy = lambda v: sorted(set(v)) if isinstance(v, (list, tuple, set)) else v
    return {k: tidy(form[k]) for k in applicable if k in form and form[k] not in (None, [], (), "")}


def drops(rows: DataFrame, most: int = 4) -> DataFrame:
    """(fail_key, n): the filters that alone shut out the most rows, ties by name."""
    return rows.where("n_fail = 1").groupBy("fail_key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "fail_key").limit(most)


def never_stated(rows: DataFrame, filters: Sequence[Filter], by: str) -> DataFrame:
    """(fail_key, `by`): the facts that no row of a value of `by` ever states."""
    told = rows.groupBy(by).agg(*(F.count_if(F.coalesce(f.known, F.lit(False))).alias(f.name) for f in filters))
    return told.select(by, F.explode(F.array(*(F.struct(F.lit(f.name).alias("fail_key"), F.col(f.name).alias("n")) for f in filters))).alias("x")).where("x.n = 0").select("x.fail_key", by)


def left_out(rows: DataFrame, by: str) -> DataFrame:
    """(fail_key, `by`, n): rows shut out by one filter only because they don't state its fact."""
    return rows.where("n_fail = 1 and n_unknown = 1").groupBy("fail_key", by).agg(F.count("*").alias("n"))


def log_histogram(rows: DataFrame, value: str, bins: int = 30, low: float = 0.02, high: float = 0.98, least: int = 8) -> DataFrame:
    """(bin, n): positive values in bins of equal width of the logarithm, from the low to the high quantile, both clamped.

    A quantile is the value at place floor(q * (n - 1)) of the sorted values; it is found from
    counts by value, not from a sort in one task. Nothing if there are fewer than `least`
    positive values or the bounds are equal.
    """
    positive = rows.where(F.col(value) > 0).select(F.col(value).cast("double").alias("v"))
    counts = positive.groupBy("v").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n")).where(F.col("n") >= least)
    ordered = counts.repartitionByRange("v").sortWithinPartitions("v").withColumn("_p", F.spark_partition_id())
    parts = ordered.groupBy("_p").agg(F.sum("c").alias("s"))
    before = parts.select("_p", (F.sum("s").over(Window.orderBy("_p")) - F.col("s")).alias("b"))
    upto = ordered.join(F.broadcast(before), "_p").withColumn("to", F.col("b") + F.sum("c").over(Window.partitionBy("_p").orderBy("v")))
    at = lambda p: F.min(F.when(F.col("to") > F.floor((F.col("n") - 1) * F.lit(p)), F.col("v")))
    bounds = upto.crossJoin(F.broadcast(total)).agg(at(low).alias("lo"), at(high).alias("hi")).where("lo < hi")
    b = F.floor((F.ln("v") - F.ln("lo")) / (F.ln("hi") - F.ln("lo")) * bins)
    placed = positive.crossJoin(F.broadcast(bounds))
    return placed.groupBy(F.greatest(F.lit(0), F.least(F.lit(bins - 1), b)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
