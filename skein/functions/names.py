"""Names of buyers, subjects of tenders, reference codes and scripts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import nfkc, organization_key, title_key

# Names of one buyer, the first of each group standing for all.
BUYER_NAMES = [
    ["undp", "გაეროს განვითარების პროგრამა", "united nations development programme"],
    ["unicef", "გაეროს ბავშვთა ფონდი", "იუნისეფი", "united nations children s fund"],
    ["un women", "გაეროს ქალთა ორგანიზაცია", "გაერო ქალები"],
    ["world vision", "world vision georgia", "ვორლდ ვიჟენი", "ვორლდ ვიჟენ საქართველო"],
    ["sos ბავშვთა სოფელი", "sos children s villages", "sos children s villages georgia"],
    ["giz", "გერმანიის საერთაშორისო თანამშრომლობის საზოგადოება"],
    ["nalag", "საქართველოს ადგილობრივ თვითმმართველობათა ეროვნული ასოციაცია"],
    ["ავერსის კლინიკა", "aversi clinic"],
    ["ავერსი ფარმა", "aversi pharma"],
]
# Words that say nothing of which buyer it is.
GENERIC_WORDS = ["კომპანია", "company", "საქართველოს", "საქართველო", "georgia", "ჯგუფი", "group", "გაეროს", "un"]
# Words that every tender's title carries.
TENDER_WORDS = ["ტენდერი", "ტენ", "tender", "rfq", "rfp", "itb", "eoi", "თაობაზე", "შესახებ", "დაკავშირებით", "შესყიდვა", "შესყიდვის", "შესყიდვაზე", "შესყიდვასთან", "შეძენა", "შეძენის", "შეძენაზე", "procurement", "for", "the", "of"]
_DOTTED = r"(?<!\p{L})(?:შ\.\s?პ\.\s?ს|ს\.\s?ს\.\s?ი\.\s?პ|ა\.?\s?\(?ა\)?\.?\s?ი\.?\s?პ|ს\.\s?ს)\.?(?!\p{L})"


def buyer_key(c: Column, fold: bool = True) -> Column:
    """A buyer's name without legal forms, dotted ones too, by the name that stands for its group; null if nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(c, "[‐‑‒–—―]", " "), _DOTTED, " ")
    key = organization_key(plain, fold)
    known = F.create_map(*(F.lit(x) for names in BUYER_NAMES for n in names[1:] for x in (n, names[0])))
    return F.coalesce(F.try_element_at(known, key), key)


def head_word(key: Column) -> Column:
    """The first word of a buyer's key; null if it is generic."""
    first = F.split(key, " ")[0]
    return F.when(~first.isin(GENERIC_WORDS), first)


def buyers_match(a: Column, b: Column) -> Column:
    """Whether two buyers' keys are equal or one begins with all words of the other, which aren't all generic; false for a null."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    told = F.exists(F.split(short, " "), lambda w: ~w.isin(GENERIC_WORDS))
    return F.coalesce((a == b) | (F.concat(long, F.lit(" ")).startswith(F.concat(short, F.lit(" "))) & told), F.lit(False))


def tender_subject(c: Column, fold: bool = True) -> Column:
    """What a tender is about: its title's key without the announcement and the words all tenders carry; null if nothing is left."""
    bare = F.regexp_replace(nfkc(c) if fold else c, r"^.*?აცხადებს ტენდერს\s*", "")
    left = F.array_join(F.filter(F.split(title_key(bare, False), " "), lambda w: ~w.isin(TENDER_WORDS)), " ")
    return F.when(left != "", left)


def reference_codes(c: Column) -> Column:
    """The distinct reference codes of a text, without spaces, lower case: numbers after №, letters with digits, long numbers."""
    found = F.regexp_extract_all(c, F.lit(r"№\s*[\p{L}\p{N}/-]+|(?<![\p{L}\p{N}])[A-Za-z]{1,5}\d{3,}(?:[/-]\d+)*|(?<![\p{L}\p{N}/])\d{5,}(?![\p{L}\p{N}])"), 0)
    return F.array_distinct(F.transform(found, lambda x: F.lower(F.regexp_replace(x, r"\s+", ""))))


def dominant_script(c: Column) -> Column:
    """georgian or latin, by which letters are more, ties georgian; null without letters of either."""
    georgian, latin = F.length(F.regexp_replace(c, "[^Ⴀ-ჿᲐ-Ჿ]", "")), F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    return F.when(georgian + latin > 0, F.when(georgian >= latin, "georgian").otherwise("latin"))
