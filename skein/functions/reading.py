"""Facts read out of text: contacts, house numbers, street names, dates without a year, snippets, spelling, segmentation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that say what kind of street it is, not which.
STREET_KINDS = ["street", "st", "avenue", "ave", "lane", "road", "rd", "square", "ქუჩა", "ქ", "გამზირი", "გამზ", "შესახვევი", "ჩიხი", "მოედანი", "ხეივანი"]


def emails(c: Column) -> Column:
    """The distinct e-mail addresses of a text, lower case, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}"), 0), F.lower))


def phones(c: Column, country: str = "995") -> Column:
    """The distinct phone numbers of a text as +country and nine digits: mobile and city numbers, with or without the country's code.

    Digits followed by a unit of money or area, or masked by x or *, are no number.
    """
    found = F.regexp_extract_all(c, F.lit(r"(?i)(?<![\d.,/])(?:\+?995[\s-]?|0)?(?:5\d{2}|3\d{2})(?:[\s-]?\d{2,3}){2,3}(?![\d*x]|\s?(?:gel|usd|eur|m2|lari|ლარი|₾|\$|%))"), 0)
    digits = F.transform(found, lambda p: F.regexp_replace(F.regexp_replace(p, "[^0-9]", ""), f"^(?:{country}|0)(?=[0-9]{{9}}$)", ""))
    return F.array_distinct(F.transform(F.filter(digits, lambda d: F.length(d) == 9), lambda d: F.concat(F.lit(f"+{country}"), d)))


def house_number(c: Column) -> Column:
    """A house number with its letter, of a range the first; null for none and for 0."""
    got = F.regexp_extract(F.lower(F.trim(c)), r"^(?:№|#|n\.?\s?)?\s*(\d{1,4})\s*([a-zა-ჰ])?(?:\s*[-–/]\s*\d{1,4})?\.?$", 0)
    number = F.regexp_extract(got, r"(\d{1,4})", 1)
    letter = F.regexp_extract(got, r"\d\s*([a-zა-ჰ])", 1)
    return F.when((got != "") & (number.try_cast("int") > 0), F.concat(number.try_cast("int").cast("string"), letter))


def street_key(c: Column) -> Column:
    """A street's name without brackets, initials, dashes and the word for street; null if nothing is left."""
    bare = F.regexp_replace(F.lower(c), r"\([^)]*\)", " ")
    bare = F.regexp_replace(bare, r"(?<=^|\s)\p{L}\.\s*", " ")
    words = F.filter(F.split(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "), " "), lambda w: (w != "") & ~w.isin(STREET_KINDS))
    return F.when(F.size(words) > 0, F.array_join(words, " "))


def _candidates(day: Column, month: Column, at: Column) -> Column:
    """The dates a day and month may be: of the year before, of and after `at`; dates that don't exist are left out."""
    return F.array_compact(F.array(*(F.try_to_date(F.format_string("%04d-%02d-%02d", F.year(at) + k, month, day), "yyyy-MM-dd") for k in (-1, 0, 1))))


def nearest_date(day: Column, month: Column, at: Column) -> Column:
    """The date of a day and month that lies nearest to `at`; ties go to the earlier."""
    return F.array_min(F.transform(_candidates(day, month, at), lambda d: F.struct(F.abs(F.date_diff(d, at)).alias("gap"), d.alias("date"))))["date"]


def published_date(day: Column, month: Column, at: Column) -> Column:
    """The latest date of a day and month not more than a day after `at`."""
    return F.array_max(F.filter(_candidates(day, month, at), lambda d: d <= F.date_add(at, 1)))


def deadline_date(day: Column, month: Column, published: Column) -> Column:
    """The earliest date of a day and month not before `published`."""
    return F.array_min(F.filter(_candidates(day, month, published), lambda d: d >= published))


def snippet(c: Column, start: Column, length: Column, around: int = 48) -> Column:
    """The text around a find (start from 1), cut at words, with ellipses where something is left out."""
    low, high = F.greatest(start - around, F.lit(1)), start + length + around
    piece = F.substring(c, low, high - low)
    head = F.when(low > 1, F.concat(F.lit("…"), F.regexp_replace(piece, r"^\S*\s", ""))).otherwise(piece)
    return F.when(high <= F.length(c), F.concat(F.regexp_replace(head, r"\s\S*$", ""), F.lit("…"))).otherwise(head)


def edit_distance(a: str, b: str, most: int) -> int:
    """Letters to change, with a swap of neighbours as one, or most + 1 if it takes more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
        if min(row) > most and (not before or min(before) > most):
            return most + 1
    return min(row[-1], most + 1)


def suggestions(words: DataFrame, word: str, count: str, asked: Sequence[str]) -> DataFrame:
    """(asked, suggestion, distance): for each asked word its nearest known ones, the most frequent first.

    One step is allowed for four to six letters, two for seven and more; shorter words and
    known ones have none. The words are read where they are, the few asked go to each task.
    """
    budget = {w: 1 if len(w) < 7 else 2 for w in asked if len(w) >= 4}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(a, w, n, d) for w, n in zip(pdf["w"], pdf["n"], strict=True) for a, most in budget.items() if (d := edit_distance(a, w, most)) <= most]
            yield pd.DataFrame(rows, columns=["asked", "suggestion", "n", "distance"])

    near = words.select(F.col(word).alias("w"), F.col(count).cast("long").alias("n")).where("w is not null").mapInPandas(run, "asked string, suggestion string, n long, distance int")
    best = near.groupBy("asked").agg(F.min(F.struct("distance", (-F.col("n")).alias("m"), "suggestion")).alias("b"))
    return best.select("asked", F.col("b.suggestion").alias("suggestion"), F.col("b.distance").alias("distance")).where("distance > 0")


def segmenter(pieces: dict[str, float], unknown: float):
    """A function from a text to its most probable pieces (Viterbi); a letter no piece covers costs `unknown`."""
    longest = max(map(len, pieces), default=1)

    def split(text: str) -> list[str]:
        text = "▁" + text.strip().replace(" ", "▁")
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            found = [(best[a][0] + pieces[text[a:end]], -a) for a in range(max(0, end - longest), end) if text[a:end] in pieces]
            found.append((best[end - 1][0] + unknown, -(end - 1)))
            score, a = max(found)
            best.append((score, -a))
        out, end = [], len(text)
        while end:
            out.append(text[best[end][1] : end])
            end = best[end][1]
        return out[::-1]

    return split


def segmented(c: Column, pieces: dict[str, float]) -> Column:
    """The pieces of a text by `segmenter`; unknown letters cost ten more than the rarest piece."""
    split = segmenter(pieces, min(pieces.values(), default=0.0) - 10)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(split, na_action="ignore")

    return run(c)


def named_places(texts: DataFrame, key: str, text: str, places: DataFrame, ref: str, name: str, most: int = 3) -> DataFrame:
    """(`key`, `ref`): the places a text names by one or two words, longest first; texts that name more than `most` name none.

    The words are numbered and met with the places' words by an equi-join, so neither side is
    sent anywhere whole. A place inside a longer named one doesn't count.
    """
    words = F.transform(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: F.regexp_replace(w, "(?<=[ა-ჰ]{3})(?:ში|ს|თან|დან|ზე)$", ""))
    numbered = texts.select(F.col(key).alias("_k"), F.filter(words, lambda w: w != "").alias("_w"))
    one = numbered.select("_k", F.posexplode("_w").alias("at", "said")).withColumn("size", F.lit(1))
    two = numbered.where(F.size("_w") > 1).select("_k", F.posexplode(F.zip_with(F.slice("_w", 1, F.size("_w") - 1), F.slice("_w", 2, F.size("_w") - 1), lambda a, b: F.concat_ws(" ", a, b))).alias("at", "said")).withColumn("size", F.lit(2))
    known = places.select(F.col(ref).alias("_ref"), F.lower(F.col(name)).alias("said")).where("said is not null").dropDuplicates(["said"])
    hits = one.unionByName(two).join(known, "said")
    inner = hits.where("size = 2").select("_k", F.explode(F.array("at", F.col("at") + 1)).alias("at")).distinct()
    kept = hits.where("size = 2").select("_k", "_ref").unionByName(hits.where("size = 1").join(inner, ["_k", "at"], "left_anti").select("_k", "_ref")).distinct()
    few = kept.groupBy("_k").agg(F.count("*").alias("n")).where(F.col("n") <= most)
    return kept.join(few, "_k", "left_semi").select(F.col("_k").alias(key), F.col("_ref").alias(ref))
