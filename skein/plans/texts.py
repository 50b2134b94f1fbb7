"""Text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.sources.tables import table


def text_title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "index_rows").groupBy(X.title_key(F.col("title")).alias("title_key")).agg(F.count("*").alias("n_rows"), F.countDistinct("source_slug").alias("n_boards"))


def text_organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many written forms each organisation has."""
    rows = table(spark, sf_dir, "listing_views").select(X.organization_key(F.col("organization")).alias("organization_key"), "organization").where("organization_key is not null")
    return rows.groupBy("organization_key").agg(F.countDistinct("organization").alias("n_forms"), F.count("*").alias("n_rows"))


def text_url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = F.concat(F.upper(F.substring("url", 1, 12)), F.substring("url", 13, F.length("url")), F.lit("/?utm_source=x&id="), F.col("source_listing_id").cast("string"), F.lit("&fbclid=1#top"))
    return table(spark, sf_dir, "index_rows").where("url is not null").select("row_id", X.url_key(tagged).alias("url_key"))


def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a word on contracts and one on Wednesday, in either language, by word beginnings."""
    query = [["contract", "ხელშეკრულებ"], ["wednesday", "ოთხშაბათ"]]
    found = table(spark, sf_dir, "documents").where(X.searched(F.col("text"), query))
    return found.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_chars").alias("n_chars"))


def text_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that say "delivery schedules" or "supplier contracts" in any form of the words."""
    stems = F.transform(X.lexemes_in_order(F.col("text")), X.stem)
    rows = table(spark, sf_dir, "documents").select("doc_id", stems.alias("stems"))
    return rows.select("doc_id", X.says_phrase(F.col("stems"), ["delivery", "schedule"]).alias("on_delivery"), X.says_phrase(F.col("stems"), ["supplier", "contract"]).alias("on_contracts")).where("on_delivery or on_contracts")


def text_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference codes (number/number) that documents name, with how many name them."""
    codes = F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9]{2,6}/[0-9]{2,6})"), 1))
    return table(spark, sf_dir, "documents").select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n_documents"))


def text_trigram_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of one organisation on different boards by trigram similarity; organisations of 2 to 200 listings."""
    from skein.operators.resolution import block_pairs

    rows = table(spark, sf_dir, "index_rows").dropDuplicates(["source_listing_id"]).select("source_listing_id", "source_slug", X.organization_key(F.col("organization")).alias("block"), X.title_key(F.col("title")).alias("t"))
    pairs = block_pairs(rows.where("t is not null"), "source_listing_id", "block", ["source_slug", "t"], 2, 200).where("l_source_slug <> r_source_slug")
    grams = lambda c: X.trigrams(F.col(c))
    return pairs.select("l_source_listing_id", "r_source_listing_id", F.round(X.jaccard(grams("l_t"), grams("r_t")), 6).alias("similarity"), F.round(X.containment(grams("l_t"), grams("r_t")), 6).alias("containment"))


def text_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings whose content is the same as another's, letter for letter but for white space."""
    rows = table(spark, sf_dir, "listing_snapshots").select("source_listing_id", X.fingerprint("title", "organization", "to_status").alias("digest"))
    return rows.groupBy("source_listing_id").agg(F.countDistinct("digest").alias("n_contents"), F.count("*").alias("n_rows"))


_KEY = """nullif(trim(regexp_replace(lower(regexp_replace(regexp_replace(nfc_normalize({c}), '["''`„“”«»‘’]', '', 'g'), '[\\p{{P}}\\p{{S}}]+', ' ', 'g')), '[\\s\\p{{Z}}]+', ' ', 'g')), '')"""
_ORG = "nullif(array_to_string(list_filter(string_split(" + _KEY + ", ' '), lambda w: not list_contains(['" + "', '".join(X.LEGAL_FORMS) + "'], w)), ' '), '')"
_GRAMS = "list_distinct([substr('  ' || {c} || ' ', i, 3) for i in range(1, length({c}) + 2)])"

QUERIES = {f.__name__: f for f in (text_title_keys, text_organizations, text_url_keys, text_search, text_phrases, text_codes, text_trigram_pairs, text_fingerprints)}
SQL = {
    "text_title_keys": f"select {_KEY.format(c='title')} as title_key, count(*) as n_rows, count(distinct source_slug) as n_boards from index_rows group by 1",
    "text_organizations": f"select organization_key, count(distinct organization) as n_forms, count(*) as n_rows from (select {_ORG.format(c='organization')} as organization_key, organization from listing_views) where organization_key is not null group by 1",
    "text_url_keys": "select row_id, lower(substr(url, 1, 8)) || lower(regexp_extract(substr(url, 9), '^[^/]*')) || regexp_replace(regexp_extract(substr(url, 9), '/.*$'), '/+$', '') || '?id=' || source_listing_id as url_key from index_rows where url is not null",
    "text_search": "with w as (select doc_id, source, n_chars, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[0-9]{7,}', ' ', 'g'), '[^0-9a-zა-ჿ]+'), lambda x: x <> '' and length(x) < 60) as l from documents) select source, count(*) as n_documents, sum(n_chars) as n_chars from w where len(list_filter(l, lambda x: starts_with(x, 'contract') or starts_with(x, 'ხელშეკრულებ'))) > 0 and len(list_filter(l, lambda x: starts_with(x, 'wednesday') or starts_with(x, 'ოთხშაბათ'))) > 0 group by 1",
    "text_phrases": "with t as (select doc_id, ' ' || regexp_replace(array_to_string(list_filter(regexp_split_to_array(lower(text), '[^0-9a-zა-ჿ]+'), lambda x: x <> ''), ' '), '\\b([a-z]{3,}[^s ])s\\b', '\\1', 'g') || ' ' as s from documents) select doc_id, contains(s, ' delivery schedule ') as on_delivery, contains(s, ' supplier contract ') as on_contracts from t where contains(s, ' delivery schedule ') or contains(s, ' supplier contract ')",
    "text_codes": "select code, count(*) as n_documents from (select doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9]{2,6}/[0-9]{2,6}'))) as code from documents) group by 1",
    "text_trigram_pairs": f"""with one as (select source_listing_id, any_value(source_slug) as s, min({_ORG.format(c='organization')}) as b, min({_KEY.format(c='title')}) as t from index_rows group by 1),
        r as (select *, {_GRAMS.format(c='t')} as g from (select *, count(*) over (partition by b) as n from one where t is not null and b is not null) where n between 2 and 200)
        select x.source_listing_id as l_source_listing_id, y.source_listing_id as r_source_listing_id, round(len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))), 6) as similarity,
        round(len(list_intersect(x.g, y.g)) / least(len(x.g), len(y.g)), 6) as containment from r x join r y on x.b = y.b and x.source_listing_id < y.source_listing_id and x.s <> y.s""",
    "text_fingerprints": "select source_listing_id, count(distinct (trim(regexp_replace(title, '[\\s\\p{Z}]+', ' ', 'g')), coalesce(trim(regexp_replace(organization, '[\\s\\p{Z}]+', ' ', 'g')), '<null>'), coalesce(trim(to_status), '<null>'))) as n_contents, count(*) as n_rows from listing_snapshots group by 1",
}
