"""Text functions as column expressions; only Unicode compatibility folding needs Python."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Quotes that are dropped, legal forms, tracking parameters, case endings (longest first).
QUOTES = "[\"'`„“”«»‘’]"
PUNCTUATION = "[\\p{Punct}\\p{P}\\p{S}]+"
LEGAL_FORMS = ["შპს", "სს", "ააიპ", "სსიპ", "ი/მ", "ინდმეწარმე", "llc", "ltd", "ltda", "limited", "jsc", "inc", "co", "corp", "corporation", "gmbh", "llp", "plc"]
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid", "mc_cid", "mc_eid", "ref", "referrer", "source"]
ENDINGS = [
    "ებისთვის", "ებისგან", "ისთვის", "ისგან", "ისკენ", "ებთან", "ებიდან", "ებამდე", "ებში", "ებზე", "ებმა", "ებით", "ებად", "ების", "ებს", "ები", "თვის", "იდან", "ამდე", "თან", "დან", "გან", "ში", "ზე", "მა", "ის", "ით", "ად", "ს", "ი", "ო", "მ", "თ", "დ",
]


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(c: Column) -> Column:
    """Compatibility folding; only texts that hold a character it could change reach Python."""
    changes = c.rlike("[\\x{00A0}\\x{00A8}\\x{00AA}\\x{00AF}\\x{00B2}-\\x{00BE}\\x{0132}-\\x{0140}\\x{0300}-\\x{036F}\\x{1C90}-\\x{1CBF}\\x{2000}-\\x{2FFF}\\x{3000}-\\x{30FF}\\x{F900}-\\x{FFEF}]")
    return F.coalesce(_nfkc(F.when(changes, c)), c)


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[\\s\\p{Z}]+", " "))


def title_key(c: Column, fold: bool = True) -> Column:
    """A title without quotes, punctuation, case and spacing; null if nothing is left."""
    base = nfkc(c) if fold else c
    key = squeezed(F.lower(F.regexp_replace(F.regexp_replace(base, QUOTES, ""), PUNCTUATION, " ")))
    return F.when(key != "", key)


def organization_key(c: Column, fold: bool = True) -> Column:
    """An organisation's name as a title key without legal forms; null if nothing is left, and null never matches."""
    words = F.filter(F.split(title_key(c, fold), " "), lambda w: ~w.isin(LEGAL_FORMS))
    key = F.array_join(words, " ")
    return F.when(key != "", key)


def trigrams(c: Column) -> Column:
    """The set of three-letter windows of the whole text, padded by two spaces before and one after."""
    padded = F.concat(F.lit("  "), c, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all of two sets; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def containment(a: Column, b: Column) -> Column:
    """Shared over the smaller of two sets; 0 if either is empty."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small <= 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / small)


def url_key(c: Column) -> Column:
    """A link without tracking parameters, fragment and trailing slash; scheme and host in lower case."""
    bare = F.regexp_replace(F.trim(c), "#.*$", "")
    query = F.array_join(F.filter(F.split(F.regexp_extract(bare, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike("^(?i)(" + "|".join(TRACKING) + ")=")), "&")
    head = F.regexp_replace(F.regexp_replace(bare, "\\?.*$", ""), "/+$", "")
    host = F.regexp_extract(head, "^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    path = F.substring(head, F.length(host) + 1, F.length(head))
    return F.when(c.isNotNull(), F.concat(F.lower(host), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def stem(word: Column) -> Column:
    """A word without its case ending, the longest that leaves three letters; other words of four letters or more lose a plural s, but not of ss."""
    ending = "^(.{3,}?)(?:" + "|".join(ENDINGS) + ")$"
    plural = F.when(word.rlike("^.{2,}[^s]s$"), F.regexp_replace(word, "s$", "")).otherwise(word)
    return F.when(word.rlike("[ა-ჰ]"), F.regexp_replace(word, ending, "$1")).otherwise(plural)


def lexemes(c: Column) -> Column:
    """The distinct search words of a text: lower case, no long digit runs, none of sixty letters or more."""
    words = F.split(F.regexp_replace(F.lower(c), "[0-9]{7,}", " "), "[^0-9a-zა-ჿ]+")
    return F.array_distinct(F.filter(words, lambda w: (w != "") & (F.length(w) < 60)))


def lexemes_in_order(c: Column) -> Column:
    """The words of a text in their order, repeats and all."""
    return F.filter(F.split(F.lower(c), "[^0-9a-zა-ჿ]+"), lambda w: w != "")


def has_prefixes(found: Column, query: list[list[str]]) -> Column:
    """Whether every group of spellings has a word that starts with one of them."""
    out = F.lit(True)
    for spellings in query:
        out = out & F.exists(found, _starts(spellings))
    return out


def searched(c: Column, query: list[list[str]]) -> Column:
    """`has_prefixes` of a text's lexemes. What cannot hold a word of every group is ruled out by one pattern a group, so that only the rest is split into words."""
    low, out = F.lower(c), F.lit(True)
    for spellings in query:
        out = out & low.rlike("(?:^|[^0-9a-zა-ჿ]|[0-9]{7})(?:" + "|".join(re.escape(s) for s in spellings) + ")")
    return out & has_prefixes(lexemes(c), query)


def _starts(spellings: list[str]):
    def test(w: Column) -> Column:
        out = F.lit(False)
        for s in spellings:
            out = out | w.startswith(s)
        return out

    return test


def says_phrase(found: Column, phrase: list[str]) -> Column:
    """Whether the stems of a phrase stand next to each other among the stems of a text."""
    return F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" ")).contains(" " + " ".join(phrase) + " ")


def fingerprint(*cols: str) -> Column:
    """A digest of named fields with white space collapsed; null and missing differ from empty."""
    return F.sha2(F.to_json(F.struct(*(squeezed(F.col(c).cast("string")).alias(c) for c in sorted(cols))), {"ignoreNullFields": "false"}), 256)
