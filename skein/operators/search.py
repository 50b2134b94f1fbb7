"""Searches given as data: a dictionary of filters becomes one predicate; pages, counts and facets over it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import searched
from skein.operators.facets import Filter
from skein.operators.quantiles import quantiles

#: A page holds this many rows unless asked otherwise, and never more than the second.
PAGE, LARGEST_PAGE = 100, 500


class Fields:
    """Which filters there are: each name with its kind and column.

    Kinds: equals; one_of (a list; an empty one is no filter); at_least and at_most
    (inclusive); counts (a list of numbers of which the last of `top` means "or more"); all_of and any_of
    (on an array column); within (pairs of parallel arrays: a code of the list whose value is
    at most the number); rank (an ordered list of words, at least the one asked); words (a
    search in text: every word's beginning); flag (true or false); absent (a fact that must not be true; an unknown one passes); floors (of the floor and the
    floors of its house: the words not_first, not_last, middle, or the least and most floor); groups (names that stand for several
    values); places (pairs of a level and a reference, any of which holds; a level is a column or an array of codes); chosen (of several
    columns the one that the first of three asked names, between the other two); guarded (another kind, that only rows pass which have
    been read); on_show (after the moment asked: the end expected, or the last sighting where it is later or no end is); might (rows without a place whose wider area has the one asked).
    """

    def __init__(self, **kinds: tuple):
        self.kinds = kinds

    def predicate(self, filters: Mapping[str, Any]) -> Column:
        """The conjunction of the filters; an unknown name is an error, a null value no filter, and a null fact fails."""
        out = F.lit(True)
        for name, asked in filters.items():
            if name not in self.kinds:
                raise KeyError(name)
            if asked is not None and asked != []:
                out = out & F.coalesce(self._one(*self.kinds[name], asked), F.lit(False))
        return out

    def _one(self, kind: str, column: Any, *rest: Any) -> Column:
        *more, asked = rest
        c = F.col(column) if isinstance(column, str) else column if isinstance(column, Column) else None
        if kind == "equals" or kind == "flag":
            return c == F.lit(asked)
        if kind == "one_of":
            return c.isin(list(asked))
        if kind == "at_least":
            return c >= F.lit(asked)
        if kind == "at_most":
            return c <= F.lit(asked)
        if kind == "counts":
            top = more[0]
            return c.isin([a for a in asked if a < top]) | (F.lit(top in asked) & (c >= top))
        if kind == "all_of":
            return F.size(F.array_except(F.array(*map(F.lit, asked)), c)) == 0
        if kind == "any_of":
            return F.arrays_overlap(c, F.array(*map(F.lit, asked)))
        if kind == "within":
            codes, most = asked
            return F.exists(F.arrays_zip(c.alias("a"), F.col(more[0]).alias("b")), lambda z: F.lit(not codes) | z["a"].isin(list(codes or [None])) & (z["b"] <= most) if codes else z["b"] <= most)
        if kind == "rank":
            order = list(more[0])
            return F.array_position(F.array(*map(F.lit, order)), c) >= order.index(asked) + 1
        if kind == "words":
            return searched(c, [[w] for w in asked.lower().split()])
        if kind == "absent":
            return F.lit(not asked) | ~F.coalesce(c, F.lit(False))
        if kind == "floors":
            floors = F.col(more[0])
            named = {"not_first": c > 1, "not_last": c < floors, "middle": (c > 1) & (c < floors)}
            if isinstance(asked, str):
                return named[asked]
            return (F.lit(asked[0] is None) | (c >= F.lit(asked[0]))) & (F.lit(asked[1] is None) | (c <= F.lit(asked[1])))
        if kind == "groups":
            return c.isin([v for a in ([asked] if isinstance(asked, str) else asked) for v in more[0][a]])
        if kind == "chosen":
            choice, low, high = asked
            value = F.col(column[choice])
            return value.isNotNull() & (F.lit(low is None) | (value >= F.lit(low))) & (F.lit(high is None) | (value <= F.lit(high)))
        if kind == "guarded":
            return F.col(column).isNotNull() & self._one(*more[0], asked)
        if kind == "on_show":
            return F.greatest(F.coalesce(c, F.col(more[0])), F.col(more[0])) > F.lit(asked)
        if kind == "places":
            return self._places(column, asked)
        if kind == "might":
            return c.isNull() & F.coalesce(F.col(more[0]) == F.lit(asked), F.lit(False))
        raise ValueError(kind)

    @staticmethod
    def _places(levels: Mapping[str, tuple[str, bool]], asked: Sequence[tuple[str, Any]]) -> Column:
        """Whether a row lies in any of the places; references of one level are tested together."""
        out = F.lit(False)
        for level, (name, several) in levels.items():
            refs = [r for at, r in asked if at == level]
            if refs:
                hit = F.arrays_overlap(F.col(name), F.array(*map(F.lit, refs))) if several else F.col(name).isin(refs)
                out = out | F.coalesce(hit, F.lit(False))
        return out

    def filters(self, filters: Mapping[str, Any]) -> list[Filter]:
        """The filters as facets have them: each tells which rows it alone shuts out."""
        return [Filter(name, F.lit(True), self.predicate({name: asked})) for name, asked in filters.items() if asked is not None and asked != []]


def page(rows: DataFrame, where: Column, order: Sequence[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page in a total order; a limit outside 1 to LARGEST_PAGE is brought inside. The order must end in a unique key."""
    size = PAGE if limit is None else max(1, min(LARGEST_PAGE, limit))
    return rows.where(where).orderBy(*order).offset(max(0, offset)).limit(size)


def grouped_page(rows: DataFrame, where: Column, group: str, order: Sequence[Column], limit: int | None = None) -> DataFrame:
    """A page of one leader a group (the first in the order), with alike: how many rows of its group pass; a row without a group is its own."""
    kept = rows.where(where).withColumn("_g", F.coalesce(F.col(group).cast("string"), F.concat(F.lit("#"), F.monotonically_increasing_id())))
    by = Window.partitionBy("_g")
    led = kept.withColumn("_r", F.row_number().over(by.orderBy(*order))).withColumn("alike", F.count("*").over(by)).where("_r = 1")
    return led.orderBy(*order).limit(PAGE if limit is None else max(1, min(LARGEST_PAGE, limit))).drop("_g", "_r")


def capped_count(rows: DataFrame, where: Column, cap: int = 10_000) -> DataFrame:
    """(n, more): the count up to `cap`, and whether there are more; tasks stop early."""
    return rows.where(where).select(F.lit(1)).limit(cap + 1).agg(F.least(F.count("*"), F.lit(cap)).alias("n"), (F.count("*") > cap).alias("more"))


def unknown_estimate(rows: DataFrame, area: str, fact: str, test: Column) -> DataFrame:
    """(told, matching, unknown, likely): how many rows that don't state `fact` would likely pass `test`, by their area's share of those that do.

    The shares are summed over the areas and rounded once; an area without a stated fact adds none.
    """
    known = F.col(fact).isNotNull()
    by = rows.groupBy(area).agg(F.count_if(known).alias("told"), F.count_if(known & F.coalesce(test, F.lit(False))).alias("matching"), F.count_if(~known).alias("unknown"))
    likely = F.round(F.coalesce(F.sum(F.when(F.col("told") > 0, F.col("unknown") * F.col("matching") / F.col("told"))), F.lit(0.0))).cast("long")
    return by.agg(F.sum("told").alias("told"), F.sum("matching").alias("matching"), F.sum("unknown").alias("unknown"), likely.alias("likely"))


def shares(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(`key`, n, shares): for each key how its rows spread over the values, as a map of counts in the order of the values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    return counts.groupBy(key).agg(F.sum("c").alias("n"), F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(value).cast("string"), "c"))))).alias("shares"))


def kinds_and_bands(rows: DataFrame, by: str, value: str, low: float = 0.02, high: float = 0.98, bins: int = 36, least: int = 5) -> DataFrame:
    """(`by`, bin, n): a histogram of the logarithm between interpolated quantiles, for each value of `by` with `least` rows."""
    good = rows.where(F.col(value) > 0).select(by, F.col(value).cast("double").alias("v"))
    bounds = quantiles(good.groupBy(by, "v").agg(F.count("*").alias("c")), [by], "v", "c", [low, high], unique=True).where(F.col("n") >= least).select(by, F.col("q").alias("_q"))
    placed = good.join(bounds, by).where(F.col("_q")[0] < F.col("_q")[1])
    b = F.floor((F.ln("v") - F.ln(F.col("_q")[0])) / (F.ln(F.col("_q")[1]) - F.ln(F.col("_q")[0])) * bins)
    return placed.groupBy(by, F.greatest(F.lit(0), F.least(F.lit(bins - 1), b)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
