"""Streams over the events, run to their end, and records inside other formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources import records as R
from skein.sources.tables import table
from skein.streaming import observations as S


def stream_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = S.run_to_end(S.accepted_stream(S.file_stream(spark, f"{sf_dir}/events.parquet"), "user_id", "event_id", "ts", "event_type"))
    return told.groupBy("user_id", "outcome").agg(F.count("*").alias("n"))


def stream_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.run_to_end(S.windowed(S.file_stream(spark, f"{sf_dir}/events.parquet"), "ts", "1 day", "400 days", ["event_type"], "value"), "complete")
    return out.withColumn("total", F.round("total", 4))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run_to_end(S.sessions(S.file_stream(spark, f"{sf_dir}/events.parquet"), "ts", "12 hours", "400 days", "user_id"), "complete")


def source_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose properties are read from a page's embedded JSON."""
    pages = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("<html><script id='state' type='x'>"), "props", F.lit("</script></html>")).alias("html"))
    return R.embedded_json(pages, "html", "state", "k int", "state").select("event_id", F.col("state.k").alias("k"))


def source_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table_digest(table(spark, sf_dir, "nation")).select("n_rows", F.length("digest").alias("n_letters"))


def source_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of whole tables, letter by letter."""
    parts = [R.table_digest(table(spark, sf_dir, name).select(*cols)).select(F.lit(name).alias("table_name"), "n_rows", "digest") for name, cols in _DIGESTED.items()]
    return parts[0].union(parts[1]).union(parts[2])


#: Tables whose columns both engines write alike in JSON.
_DIGESTED = {"nation": ["n_nationkey", "n_name", "n_regionkey"], "listing_pairs": ["pair_id", "left_listing_id", "right_listing_id", "decision"], "orders": ["o_orderkey", "o_custkey", "o_orderpriority"]}


def source_sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links read back from sitemap texts, one a board and day, of those changed since a day."""
    links = table(spark, sf_dir, "index_rows").where("url is not null").select("source_slug", F.to_date("first_seen_at").alias("day"), F.concat(F.lit("<url><loc>"), F.replace(F.concat("url", F.lit("?a=1&b=2")), F.lit("&"), F.lit("&amp;")), F.lit("</loc><lastmod>"), F.date_format("first_seen_at", "yyyy-MM-dd"), F.lit("T00:00:00Z</lastmod></url>")).alias("e"))
    pages = links.groupBy("source_slug", "day").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list("e"), ""), F.lit("</urlset>")).alias("xml"))
    return R.sitemap(pages, "xml", "2026-03-01").groupBy("loc", "lastmod").agg(F.count("*").alias("n"))


def source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates read back from a JSON text a day, unusable entries counted apart."""
    fx = table(spark, sf_dir, "fx_rates").where("valid_from is not null and currency is not null")
    entry = F.concat(F.lit('{"code":"'), F.when(F.col("currency") == "TRY", F.lit("?")).otherwise(F.lower("currency")), F.lit('","quantity":'), F.col("quantity").cast("string"), F.lit(',"rate":"'), F.col("rate").cast("string"), F.lit('","date":null}'))
    texts = fx.groupBy("valid_from").agg(F.concat(F.lit('[{"date":"'), F.date_format("valid_from", "yyyy-MM-dd"), F.lit('T00:00:00","currencies":['), F.array_join(F.collect_list(entry), ","), F.lit("]}]")).alias("t"))
    good, bad = R.rate_days(texts, "t")
    return good.select("currency", "valid_from", "quantity", "rate", F.lit(True).alias("usable")).unionByName(bad.select("currency", "valid_from", "quantity", "rate", F.lit(False).alias("usable"))).groupBy("currency", "usable").agg(F.count("*").alias("n"), F.sum("rate").cast("double").alias("total"))


QUERIES = {f.__name__: f for f in (stream_outcomes, stream_days, stream_sessions, source_json, source_digest, source_digests, source_sitemap, source_rates)}
SQL = {
    "stream_outcomes": """with s as (select *, coalesce(ts < max(ts) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), false) as stale from events),
        l as (select *, last_value(case when not stale then event_type end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as before from s)
        select user_id, case when stale then 'stale' when before is null then 'new' when before = event_type then 'unchanged' else 'changed' end as outcome, count(*) as n from l group by 1, 2""",
    "stream_days": "select epoch_us(date_trunc('day', cast(ts as timestamp))) as start_us, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "stream_sessions": """with s as (select *, sum(case when ts < p + interval 12 hours then 0 else 1 end) over (partition by user_id order by ts, event_id) as g from (select *, lag(ts) over (partition by user_id order by ts, event_id) as p from events))
        select user_id, epoch_us(min(ts)) as start_us, count(*) as n from s group by user_id, g""",
    "source_json": "select event_id, cast(json_extract(props, '$.k') as int) as k from events",
    "source_digests": """
        with j as (select 'nation' as table_name, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' as r from nation
          union all select 'listing_pairs', '{"decision":' || coalesce('"' || decision || '"', 'null') || ',"left_listing_id":' || coalesce(left_listing_id::varchar, 'null') || ',"pair_id":' || pair_id || ',"right_listing_id":' || coalesce(right_listing_id::varchar, 'null') || '}' from listing_pairs
          union all select 'orders', '{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}' from orders)
        select table_name, count(*) as n_rows, sha256(count(*) || '|' || sum(cast('0x' || substr(md5(r), 1, 15) as ubigint)) || '|' || sum(cast('0x' || substr(md5(r), 17, 15) as ubigint))) as digest from j group by 1""",
    "source_sitemap": "select url || '?a=1&b=2' as loc, cast(first_seen_at as date) as lastmod, count(*) as n from index_rows where url is not null and cast(first_seen_at as date) >= date '2026-03-01' group by 1, 2",
    "source_rates": "select case when currency = 'TRY' then '?' else currency end as currency, currency <> 'TRY' and quantity > 0 and rate > 0 as usable, count(*) as n, cast(sum(rate) as double) as total from fx_rates where valid_from is not null and currency is not null group by 1, 2",
    "source_digest": "select count(*) as n_rows, 64 as n_letters from nation",
}
