"""Queries by typed words: expanded searches, places by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.expansion import says_all
from skein.operators.lookup import lookup, place_words
from skein.sources.tables import table

# A dictionary of stems as a caller would give it.
_DICTIONARY = {"contract": ["ხელშეკრულებ"], "schedule": ["გრაფიკ"]}
LEVELS = ["city", "district", "subdistrict", "settlement", "village", "street"]


def lookup_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that say "contracts" by dictionary, "sasoplo" in Latin or Georgian letters, or both."""
    rows = table(spark, sf_dir, "documents").select("doc_id", says_all(F.col("text"), "contracts", _DICTIONARY).alias("by_dictionary"), says_all(F.col("text"), "khelshekruleba", {}).alias("by_script"), says_all(F.col("text"), "contracts schedule", _DICTIONARY).alias("both"))
    return rows.where("by_dictionary or by_script or both")


def lookup_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "index_rows").select(F.explode("read_cities").alias("said"))
    return lookup(asked, "said", table(spark, sf_dir, "curated_places"), "place_ref", "place_level", ["name_ka", "name_en"], "aliases", LEVELS, 6)


def lookup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places' Georgian names by key."""
    keys = table(spark, sf_dir, "curated_places").select("place_ref", F.array_join(place_words(F.col("name_ka")), " ").alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n_places"), F.min("place_ref").alias("first_ref"))


QUERIES = {f.__name__: f for f in (lookup_expanded, lookup_places, lookup_keys)}


def _word(w: str) -> str:
    """A word's key in SQL, step by step."""
    out = f"case when regexp_matches({w}, '[ა-ჰ]') then regexp_replace({w}, '^(.{{3,}}?)(?:ებისთვის|ისთვის|ებიდან|იდან|თან|დან|ში|ზე|ის|ს)$', '\\1') else regexp_replace({w}, '^(.{{3,}}[^s])s$', '\\1') end"
    out = f"translate({out}, 'აბგდევზთიკლმნოპრსტუფქყჯხჰ', 'abgdevztiklmnoprstupkkjxh')"
    for a, b in [("ჟ", "zh"), ("ღ", "g"), ("შ", "sh"), ("ჩ", "c"), ("ც", "c"), ("ძ", "z"), ("წ", "c"), ("ჭ", "c"), ("tch", "c"), ("kh", "x"), ("gh", "g"), ("ts", "c"), ("ch", "c"), ("dz", "z"), ("ph", "p"), ("zh", "j"), ("f", "p"), ("q", "k"), ("w", "v"), ("y", "i")]:
        out = f"replace({out}, '{a}', '{b}')"
    once = out
    for c in "abcdefghijklmnopqrstuvwxyz":
        once = f"regexp_replace({once}, '{c}+', '{c}', 'g')"
    return f"regexp_replace({once}, '^(.{{3,}})[aeiou]$', '\\1')"


def _words(c: str) -> str:
    return f"list_transform(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' and w not in ('city', 'town', 'village', 'district', 'street', 'avenue', 'of', 'ქალაქი', 'ქალაქ', 'ქ', 'სოფელი', 'სოფ', 'დაბა', 'უბანი', 'რაიონი', 'ქუჩა', 'გამზირი')), lambda w: {_word('w')})"


SQL = {
    "lookup_expanded": """with d as (select doc_id, regexp_matches(lower(text), 'contract|ხელშეკრულებ') as by_dictionary, regexp_matches(lower(text), 'khelshekruleba|ხელშე[კქ]რულებ') as by_script, regexp_matches(lower(text), 'contract|ხელშეკრულებ') and regexp_matches(lower(text), 'schedule|გრაფიკ') as both_ from documents)
        select doc_id, by_dictionary, by_script, both_ as both from d where by_dictionary or by_script or both_""",
    "lookup_keys": f"select array_to_string({_words('name_ka')}, ' ') as key, count(*) as n_places, min(place_ref) as first_ref from curated_places group by 1",
    "lookup_places": f"""with a as (select distinct unnest(read_cities) as said from index_rows), s as (select said, {_words('said')} as w from a where said is not null), q as (select said, list_distinct(w) as w, array_to_string(w, ' ') as q from s where len(w) > 0),
        n as (select place_ref as r, place_level as l, unnest(list_filter([name_ka, name_en] || coalesce(aliases, []), lambda x: x is not null)) as n from curated_places), k as (select distinct r, l, array_to_string({_words('n')}, ' ') as k from n),
        h as (select said, r, l, case when q = k then 0 else 1 end as tier from q join k on k <> '' and (q = k or len(list_filter(w, lambda x: not list_contains(string_split(k, ' '), x))) = 0)),
        b as (select said, r, l, min(tier) as tier from h group by 1, 2, 3)
        select said, r as place_ref, tier, row_number() over (partition by said order by tier, list_position(['city', 'district', 'subdistrict', 'settlement', 'village', 'street'], l) nulls first, r) as place from b qualify place <= 6""",
}
