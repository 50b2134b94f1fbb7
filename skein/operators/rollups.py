"""Totals of two levels, coverage, baselines and guards of runs, freshness, vocabularies, JSON facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def busiest(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """(`outer`, `inner`, n, outer_n, place): rows by both levels with the outer level's sum, busiest outer and then inner first; nulls are left out."""
    by = rows.where(F.col(outer).isNotNull() & F.col(inner).isNotNull()).groupBy(outer, inner).agg(F.count("*").alias("n"))
    summed = by.withColumn("outer_n", F.sum("n").over(Window.partitionBy(outer)))
    return summed.withColumn("place", F.row_number().over(Window.partitionBy(outer).orderBy(F.desc("n"), inner)))


def coverage(rows: DataFrame, by: Sequence[str], facts: Mapping[str, Column]) -> DataFrame:
    """(`by`, total, facts): how many rows state each fact, of how many."""
    return rows.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(F.coalesce(f, F.lit(False))).alias(n) for n, f in facts.items()))


def level_counts(rows: DataFrame, levels: Sequence[str], spot: Sequence[str]) -> DataFrame:
    """(level, area, n, n_spots): rows and distinct spots by each level and over all, from one grouping-sets aggregation; null areas are left out."""
    cells = rows.groupingSets([[], *([F.col(c)] for c in levels)], *(F.col(c) for c in levels)).agg(*(F.grouping(c).alias(f"_g{i}") for i, c in enumerate(levels)), F.count("*").alias("n"), F.count_distinct(*(F.col(c) for c in spot)).alias("n_spots"))
    at = lambda x: F.coalesce(*(F.when(F.col(f"_g{i}") == 0, x(c)) for i, c in enumerate(levels)))
    out = cells.select(F.coalesce(at(F.lit), F.lit("all")).alias("level"), at(lambda c: F.col(c).cast("string")).alias("area"), "n", "n_spots")
    return out.where("level = 'all' or area is not null")


def daily_units(rows: DataFrame, day: Column, by: str, key: str, group: str, counts: Column) -> DataFrame:
    """(day, `by`, rows, units): a day's rows and, of those that count, the distinct groups, a row without a group being its own."""
    unit = F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.concat(F.lit("k"), F.col(key).cast("string")))
    return rows.groupBy(day.alias("day"), by).agg(F.count("*").alias("n_rows"), F.count_distinct(F.when(F.coalesce(counts, F.lit(False)), unit)).alias("units"))


def run_guards(runs: DataFrame, counts: DataFrame, board: str, run: str, complete: Column, floor: int = 100, share: float = 0.5, surge: float = 2.0, baseline: int = 100) -> DataFrame:
    """(`board`, `run`, n, before, flag) of complete runs: collapse if below `floor` or `share` of the complete run before it, surge if over `surge` times one of at least `baseline`, else ok.

    `counts` has n by board and run; a run without a count has none.
    """
    told = runs.where(complete).select(board, run).distinct().join(counts, [board, run], "left").select(board, run, F.coalesce("n", F.lit(0)).alias("n"))
    before = told.withColumn("before", F.lag("n").over(Window.partitionBy(board).orderBy(run)))
    flag = F.when((F.col("n") < floor) | (F.col("n") < share * F.col("before")), "collapse").when((F.col("before") >= baseline) & (F.col("n") > surge * F.col("before")), "surge").otherwise("ok")
    return before.withColumn("flag", flag)


def latest_runs(runs: DataFrame, board: str, at: str, tie: str, complete: Column, keep: Sequence[str]) -> DataFrame:
    """(`board`, latest_*, complete_*): of each board the columns `keep` of its latest run and of its latest complete one."""
    order = F.struct(at, tie)
    told = F.struct(*keep)
    best = runs.groupBy(board).agg(F.max_by(told, order).alias("_l"), F.max_by(F.when(complete, told), F.when(complete, order)).alias("_c"))
    return best.select(board, *(F.col(f"_l.{c}").alias(f"latest_{c}") for c in keep), *(F.col(f"_c.{c}").alias(f"complete_{c}") for c in keep))


def freshness(rows: DataFrame, board: str, seen: str) -> DataFrame:
    """(`board`, newest_us, behind_us): each board's watermark and how far it lies behind that of all."""
    by = rows.groupBy(board).agg(F.max(F.unix_micros(seen)).alias("newest_us"))
    return by.crossJoin(F.broadcast(by.agg(F.max("newest_us").alias("_all")))).select(board, "newest_us", (F.col("_all") - F.col("newest_us")).alias("behind_us"))


def short_phrases(rows: DataFrame, words: Column, most: int, least: int) -> DataFrame:
    """(phrase, n): texts of at most `most` words that are said at least `least` times."""
    return rows.select(words.alias("w")).where((F.size("w") > 0) & (F.size("w") <= most)).groupBy(F.array_join("w", " ").alias("phrase")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def translated(words: Column, dictionary: Mapping[str, str]) -> tuple[Column, Column]:
    """(text, share known) of words by a dictionary; unknown words stay as they are; no words have share 0."""
    known = F.create_map(*(F.lit(x) for pair in dictionary.items() for x in pair))
    out = F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w)), " ")
    hits = F.size(F.filter(words, lambda w: F.try_element_at(known, w).isNotNull()))
    return out, F.when(F.size(words) > 0, hits / F.size(words)).otherwise(0.0)


def json_facts(c: Column, paths: Mapping[str, str]) -> Column:
    """The values at paths of a JSON text as a JSON text of their own, those that are missing left out."""
    return F.to_json(F.struct(*(F.get_json_object(c, p).alias(n) for n, p in paths.items())))


def initial_forms(key: Column) -> Column:
    """A name's forms with its first word cut to one and to two letters; none for one word or a first word under three letters."""
    first, rest = F.substring_index(key, " ", 1), F.substring(key, F.instr(key, " "), F.length(key))
    fits = key.contains(" ") & first.rlike(r"^\p{L}{3,}$")
    return F.when(fits, F.array(F.concat(F.substring(first, 1, 1), rest), F.concat(F.substring(first, 1, 2), rest))).otherwise(F.array().cast("array<string>"))


def short_lines(rows: DataFrame, key: str, text: str, longest: int, most: int) -> DataFrame:
    """(`key`, line, line_no): the first `most` distinct lines of a text of at most `longest` letters that hold no address or number of a contact; the text's own lines are all that is held."""
    lines = F.transform(F.split(F.col(text), r"\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    fit = F.filter(lines, lambda x: (x != "") & (F.length(x) <= longest) & ~x.rlike(r"@|https?://|\d{6,}"))
    return rows.where(F.col(text).isNotNull()).select(key, F.posexplode(F.slice(F.array_distinct(fit), 1, most)).alias("line_no", "line"))
