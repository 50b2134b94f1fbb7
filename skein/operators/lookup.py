"""Places found by typed names: keys without script, endings and kinds, exact and partial hits by rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Georgian letters that are one Latin letter, those that are two, spellings read alike, case endings (longest first), words for kinds of places.
_ONE = ("აბგდევზთიკლმნოპრსტუფქყჯხჰ", "abgdevztiklmnoprstupkkjxh")
_TWO = [("ჟ", "zh"), ("ღ", "g"), ("შ", "sh"), ("ჩ", "c"), ("ც", "c"), ("ძ", "z"), ("წ", "c"), ("ჭ", "c")]
_ALIKE = [("tch", "c"), ("kh", "x"), ("gh", "g"), ("ts", "c"), ("ch", "c"), ("dz", "z"), ("ph", "p"), ("zh", "j"), ("f", "p"), ("q", "k"), ("w", "v"), ("y", "i")]
PLACE_ENDINGS = ["ებისთვის", "ისთვის", "ებიდან", "იდან", "თან", "დან", "ში", "ზე", "ის", "ს"]
KINDS = ["city", "town", "village", "district", "street", "avenue", "of", "ქალაქი", "ქალაქ", "ქ", "სოფელი", "სოფ", "დაბა", "უბანი", "რაიონი", "ქუჩა", "გამზირი"]


def loose_word(word: Column) -> Column:
    """One word's key: without its case ending, in Latin letters that are read alike, doubled letters once, without a last vowel."""
    bare = F.when(word.rlike("[ა-ჰ]"), F.regexp_replace(word, "^(.{3,}?)(?:" + "|".join(PLACE_ENDINGS) + ")$", "$1")).otherwise(F.regexp_replace(word, "^(.{3,}[^s])s$", "$1"))
    out = F.translate(bare, *_ONE)
    for a, b in [*_TWO, *_ALIKE]:
        out = F.replace(out, F.lit(a), F.lit(b))
    once = F.regexp_replace(out, r"(\p{L})\1+", "$1")
    return F.regexp_replace(once, "^(.{3,})[aeiou]$", "$1")


def place_words(c: Column) -> Column:
    """The keys of a text's words, in order, without words that only say the kind of a place."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(KINDS))
    return F.transform(words, loose_word)


def lookup(asked: DataFrame, text: str, places: DataFrame, ref: str, level: str, names: Sequence[str], aliases: str, levels: Sequence[str], most: int) -> DataFrame:
    """(`text`, `ref`, tier, place): the places a typed text may mean, exact names before those that have all its words; ranked by tier, level, number.

    Distinct texts meet the places' names by equal keys, and by their words for partial hits: a place hits if
    it has all words of the text. No row for a text without words. Equi-joins on keys, so neither side is sent anywhere whole.
    """
    said = asked.select(F.col(text).alias("_t")).where("_t is not null").distinct().withColumn("_w", F.array_distinct(place_words(F.col("_t")))).where(F.size("_w") > 0).withColumn("_q", F.array_join(place_words(F.col("_t")), " "))
    every = F.array_compact(F.concat(F.array(*names), F.coalesce(aliases, F.array().cast("array<string>"))))
    keyed = places.select(F.col(ref).alias("_r"), F.col(level).alias("_l"), F.explode(every).alias("_n")).withColumn("_k", F.array_join(place_words(F.col("_n")), " ")).where("_k <> ''").select("_r", "_l", "_k").distinct()
    exact = said.join(keyed, F.col("_q") == F.col("_k")).select("_t", "_r", "_l", F.lit(0).alias("tier"))
    word = keyed.select("_r", "_l", "_k", F.explode(F.array_distinct(F.split("_k", " "))).alias("_x"))
    hits = said.select("_t", F.size("_w").alias("_n"), F.explode("_w").alias("_x")).join(word, "_x").groupBy("_t", "_r", "_l", "_k", "_n").agg(F.count("*").alias("_c")).where("_c = _n")
    both = exact.unionByName(hits.select("_t", "_r", "_l", F.lit(1).alias("tier"))).groupBy("_t", "_r", "_l").agg(F.min("tier").alias("tier"))
    order = F.array_position(F.array(*map(F.lit, levels)), F.col("_l"))
    ranked = both.withColumn("place", F.row_number().over(Window.partitionBy("_t").orderBy("tier", order, "_r"))).where(F.col("place") <= most)
    return ranked.select(F.col("_t").alias(text), F.col("_r").alias(ref), "tier", "place")
