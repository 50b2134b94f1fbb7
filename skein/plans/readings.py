"""Queries that read facts out of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import reading as R
from skein.functions import text as X
from skein.sources.tables import table


def read_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines given by day and month only, from the day a listing was stated."""
    rows = table(spark, sf_dir, "index_rows").where("stated_on is not null")
    day, month = (F.col("row_id") % 31 + 1).cast("int"), (F.col("row_id") % 12 + 1).cast("int")
    return rows.select("row_id", R.nearest_date(day, month, F.col("stated_on")).alias("nearest"), R.published_date(day, month, F.col("stated_on")).alias("published"), R.deadline_date(day, month, F.col("stated_on")).alias("deadline"))


def read_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the curated places they name, up to three."""
    named = R.named_places(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "curated_places"), "place_ref", "name_en")
    return named.groupBy("place_ref").agg(F.count("*").alias("n_documents"))


def read_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was meant by misspelt words, by the words of titles."""
    words = table(spark, sf_dir, "index_rows").select(F.explode(X.lexemes(F.col("title"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return R.suggestions(words, "w", "n", ["desinger", "acountant", "ekspordi", "pharmasist", "საწყობს", "nurse", "hotle"])


def read_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.locate("contract", F.lower(F.col("text")))
    found = table(spark, sf_dir, "documents").where(at > 0)
    return found.select("doc_id", R.snippet(F.regexp_replace("text", r"\s+", " "), F.locate("contract", F.lower(F.regexp_replace("text", r"\s+", " "))), F.lit(8)).alias("snippet")).select("doc_id", F.length("snippet").alias("n_letters"), F.contains("snippet", F.lit("ontract")).alias("holds"))


def read_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts written into a text made of a row's ids, read back."""
    rows = table(spark, sf_dir, "index_rows")
    said = F.concat(F.lit("Write to HR."), F.col("row_id"), F.lit("@Mail.Example or call 5"), F.lpad((F.col("row_id") % 100).cast("string"), 2, "0"), F.lit(" 12-34-5"), (F.col("row_id") % 10).cast("string"), F.lit(", pay 599 100 200 GEL"))
    return rows.select("row_id", R.emails(said)[0].alias("email"), F.array_join(R.phones(said), "|").alias("phones"))


_D = "select row_id, stated_on, list_filter([try_cast(strftime(stated_on + to_years(k), '%Y') || '-' || lpad((row_id % 12 + 1)::varchar, 2, '0') || '-' || lpad((row_id % 31 + 1)::varchar, 2, '0') as date) for k in [-1, 0, 1]], lambda d: d is not null) as c from index_rows where stated_on is not null"
QUERIES = {f.__name__: f for f in (read_dates, read_places, read_suggestions, read_snippets, read_contacts)}
SQL = {
    "read_dates": f"select row_id, list_min(list_transform(c, lambda d: {{'gap': abs(date_diff('day', d, stated_on)), 'date': d}})).date as nearest, list_max(list_filter(c, lambda d: d <= stated_on + 1)) as published, list_min(list_filter(c, lambda d: d >= stated_on)) as deadline from ({_D})",
    "read_places": """with w as (select doc_id, list_filter([regexp_replace(x, '([ა-ჰ]{3})(?:ში|ს|თან|დან|ზე)$', '\\1') for x in regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')], lambda x: x <> '') as w from documents),
        o as (select doc_id, w[i] as said, i as pos, 1 as size from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from w)), t as (select doc_id, w[i] || ' ' || w[i + 1] as said, i as pos, 2 as size from (select doc_id, w, unnest(range(1, len(w))) as i from w)),
        p as (select min(place_ref) as place_ref, lower(name_en) as said from curated_places group by 2), h as (select doc_id, place_ref, pos, size from (select * from o union all select * from t) join p using (said)),
        k as (select distinct doc_id, place_ref from h x where size = 2 or not exists (select 1 from h y where y.doc_id = x.doc_id and y.size = 2 and x.pos in (y.pos, y.pos + 1))),
        n as (select doc_id from k group by 1 having count(*) <= 3) select place_ref, count(*) as n_documents from k where doc_id in (select doc_id from n) group by 1""",
    "read_contacts": "select row_id, 'hr.' || row_id || '@mail.example' as email, '+9955' || lpad((row_id % 100)::varchar, 2, '0') || '12345' || (row_id % 10) as phones from index_rows",
}
