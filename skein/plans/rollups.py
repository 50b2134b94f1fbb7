"""Rollups, run guards and small readings as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import rollups as R
from skein.sources.tables import table

_ENGLISH = {"უფროსი": "senior", "უმცროსი": "junior", "სასტუმრო": "hotel", "ტურიზმი": "tourism"}


def roll_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return R.busiest(rows, "r_name", "n_name")


def roll_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return R.coverage(table(spark, sf_dir, "index_rows"), ["source_slug"], {"pay": c("salary_raw").isNotNull(), "value": c("value_amount") > 0, "deadline": c("deadline_at").isNotNull(), "cities": F.size("read_cities") > 0})


def roll_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "index_rows").withColumn("month", F.date_format("stated_on", "yyyy-MM"))
    return R.level_counts(rows, ["source_slug", "opp_type", "month"], ["organization", "status"])


def roll_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "index_rows")
    return R.daily_units(rows, F.to_date(F.col("first_seen_at") + F.expr("interval 4 hours")), "source_slug", "row_id", "opportunity_id", F.col("status") == "active").withColumn("day", F.unix_date("day"))


def roll_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "listing_snapshots").groupBy("source_slug", "snapshot_no").agg(F.count_distinct("source_listing_id").alias("n"))
    return R.run_guards(table(spark, sf_dir, "crawl_runs"), counts, "source_slug", "snapshot_no", F.col("full_coverage"), floor=5)


def roll_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_runs(table(spark, sf_dir, "crawl_runs"), "source_slug", "started_at", "run_id", F.col("run_status") == "completed", ["run_id", "run_status", "snapshot_no"])


def roll_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.freshness(table(spark, sf_dir, "listing_snapshots"), "source_slug", "last_seen_at")


def roll_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.short_phrases(table(spark, sf_dir, "index_rows"), F.split(X.title_key(F.col("title")), " "), 3, 3)


def roll_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, share = R.translated(F.split(X.title_key(F.col("title")), " "), _ENGLISH)
    return table(spark, sf_dir, "index_rows").select("row_id", text.alias("english"), F.round(share, 6).alias("known"))


def roll_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", R.json_facts(F.col("props"), {"k": "$.k", "gone": "$.gone", "deep": "$.a.b"}).alias("facts"), F.array_join(F.json_object_keys("props"), ",").alias("keys"))


def roll_initials(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "listing_views").select(X.organization_key(F.col("organization")).alias("key")).distinct()
    return rows.select("key", F.explode(R.initial_forms(F.col("key"))).alias("form")).groupBy("form").agg(F.count("*").alias("n_names"))


def roll_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.short_lines(table(spark, sf_dir, "documents"), "doc_id", "text", 60, 60)


def roll_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows all of whose places begin with one of a few letters, rows that have all types of an opportunity's boards, by board."""
    rows = table(spark, sf_dir, "index_rows").where("read_cities is not null")
    letters = F.transform("read_cities", lambda x: F.substring(x, 1, 1))
    asked = F.array(*map(F.lit, "ქჭლვ"))
    return rows.groupBy("source_slug").agg(F.count_if(F.size(F.array_except(letters, asked)) == 0).alias("subset"), F.count_if(F.size(F.array_except(F.array(F.lit("ქ")), letters)) == 0).alias("superset"), F.count_if(F.arrays_overlap(letters, asked)).alias("overlap"))


QUERIES = {f.__name__: f for f in (roll_places, roll_coverage, roll_levels, roll_daily, roll_guards, roll_runs, roll_freshness, roll_vocabulary, roll_english, roll_json, roll_initials, roll_lines, roll_sets)}
_KEY = """nullif(trim(regexp_replace(lower(regexp_replace(regexp_replace(nfc_normalize({c}), '["''`„“”«»‘’]', '', 'g'), '[\\p{{P}}\\p{{S}}]+', ' ', 'g')), '[\\s\\p{{Z}}]+', ' ', 'g')), '')"""
_T = _KEY.format(c="title")
_O = "nullif(array_to_string(list_filter(string_split(" + _KEY.format(c="organization") + ", ' '), lambda w: w not in ('შპს', 'სს', 'ააიპ', 'სსიპ', 'ი/მ', 'ინდმეწარმე', 'llc', 'ltd', 'ltda', 'limited', 'jsc', 'inc', 'co', 'corp', 'corporation', 'gmbh', 'llp', 'plc')), ' '), '')"
_MAP = "map(['უფროსი', 'უმცროსი', 'სასტუმრო', 'ტურიზმი'], ['senior', 'junior', 'hotel', 'tourism'])"
SQL = {
    "roll_places": """with b as (select r_name, n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2)
        select *, cast(sum(n) over (partition by r_name) as bigint) as outer_n, row_number() over (partition by r_name order by n desc, n_name) as place from b""",
    "roll_coverage": "select source_slug, count(*) as total, count(salary_raw) as pay, count(*) filter (value_amount > 0) as value, count(deadline_at) as deadline, count(*) filter (len(read_cities) > 0) as cities from index_rows group by 1",
    "roll_levels": """with r as (select *, strftime(stated_on, '%Y-%m') as month from index_rows), s as (select 'all' as level, null as area, organization, status from r union all select 'source_slug', source_slug, organization, status from r union all select 'opp_type', opp_type, organization, status from r union all select 'month', month, organization, status from r)
        select level, area, count(*) as n, count(distinct case when organization is not null and status is not null then organization || '|' || status end) as n_spots from s where level = 'all' or area is not null group by 1, 2""",
    "roll_daily": "select cast(cast(first_seen_at + interval 4 hours as date) - date '1970-01-01' as int) as day, source_slug, count(*) as n_rows, count(distinct coalesce('g' || opportunity_id, 'k' || row_id)) filter (status = 'active') as units from index_rows group by 1, 2",
    "roll_guards": """with n as (select source_slug, snapshot_no, count(distinct source_listing_id) as n from listing_snapshots group by 1, 2), t as (select distinct r.source_slug, r.snapshot_no, coalesce(n, 0) as n from crawl_runs r left join n using (source_slug, snapshot_no) where full_coverage),
        b as (select *, lag(n) over (partition by source_slug order by snapshot_no) as before from t)
        select *, case when n < 5 or n < 0.5 * before then 'collapse' when before >= 100 and n > 2 * before then 'surge' else 'ok' end as flag from b""",
    "roll_runs": """with l as (select * from crawl_runs qualify row_number() over (partition by source_slug order by started_at desc, run_id desc) = 1), c as (select * from crawl_runs where run_status = 'completed' qualify row_number() over (partition by source_slug order by started_at desc, run_id desc) = 1)
        select l.source_slug, l.run_id as latest_run_id, l.run_status as latest_run_status, l.snapshot_no as latest_snapshot_no, c.run_id as complete_run_id, c.run_status as complete_run_status, c.snapshot_no as complete_snapshot_no from l left join c using (source_slug)""",
    "roll_freshness": "with b as (select source_slug, max(epoch_us(last_seen_at)) as newest_us from listing_snapshots group by 1) select *, max(newest_us) over () - newest_us as behind_us from b",
    "roll_vocabulary": f"select t as phrase, count(*) as n from (select {_T} as t from index_rows) where len(string_split(t, ' ')) <= 3 group by 1 having count(*) >= 3",
    "roll_english": f"with w as (select row_id, string_split({_T}, ' ') as w from index_rows) select row_id, array_to_string(list_transform(w, lambda x: coalesce({_MAP}[x], x)), ' ') as english, round(len(list_filter(w, lambda x: {_MAP}[x] is not null)) / len(w), 6) as known from w",
    "roll_json": "select event_id, case when json_extract_string(props, '$.k') is null then '{}' else '{\"k\":\"' || json_extract_string(props, '$.k') || '\"}' end as facts, array_to_string(json_keys(props), ',') as keys from events",
    "roll_initials": f"with k as (select distinct {_O} as key from listing_views), f as (select split_part(key, ' ', 1) as a, substr(key, instr(key, ' ')) as b from k where contains(key, ' ') and regexp_full_match(split_part(key, ' ', 1), '\\p{{L}}{{3,}}')), u as (select substr(a, 1, 1) || b as form from f union all select substr(a, 1, 2) || b from f) select form, count(*) as n_names from u group by 1",
    "roll_lines": """with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents), c as (select doc_id, trim(regexp_replace(line, '\\s+', ' ', 'g')) as line, min(i) as i from l group by 1, 2),
        n as (select doc_id, line, row_number() over (partition by doc_id order by i) - 1 as line_no from c where line <> '' and length(line) <= 60 and not regexp_matches(line, '@|https?://|\\d{6,}')) select * from n where line_no < 60""",
    "roll_sets": """with l as (select source_slug, list_transform(read_cities, lambda x: substr(x, 1, 1)) as l from index_rows where read_cities is not null)
        select source_slug, count(*) filter (len(list_filter(l, lambda x: x is null or x not in ('ქ', 'ჭ', 'ლ', 'ვ'))) = 0) as subset, count(*) filter (list_contains(l, 'ქ')) as superset, count(*) filter (list_has_any(l, ['ქ', 'ჭ', 'ლ', 'ვ'])) as overlap from l group by 1""",
}
