"""Queries over repeatable steps, places and word scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import lexemes
from skein.operators import steps as S
from skein.sources.tables import table


def _state(spark: SparkSession, sf_dir: str, no: int) -> DataFrame:
    rows = table(spark, sf_dir, "listing_snapshots").where(F.col("snapshot_no") == no)
    return rows.groupBy("source_listing_id").agg(F.max("to_status").alias("to_status"), F.max("deadline_at").alias("deadline_at"))


def step_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a nightly step from the third to the fourth delivery closes and opens."""
    closed, opened = S.version_step(_state(spark, sf_dir, 3), _state(spark, sf_dir, 4), "source_listing_id", ["to_status", "deadline_at"], F.lit(4))
    return closed.select("source_listing_id", F.lit("closed").alias("what"), "to_status").unionByName(opened.select("source_listing_id", F.lit("opened").alias("what"), "to_status"))


def step_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drift(_state(spark, sf_dir, 3), _state(spark, sf_dir, 9), "source_listing_id", "to_status")


def _steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    states = table(spark, sf_dir, "listing_snapshots").groupBy("snapshot_no", "source_listing_id").agg(F.max("to_status").alias("to_status"), F.max("deadline_at").alias("deadline_at"))
    return S.steps_between(states, "snapshot_no", "source_listing_id")


def step_versions_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the step to each delivery from the one before closes and opens."""
    closed, opened = S.version_step(*_steps(spark, sf_dir), "source_listing_id", ["to_status", "deadline_at"], F.lit(None))
    both = closed.select("source_listing_id", F.lit("closed").alias("what"), "to_status").unionByName(opened.select("source_listing_id", F.lit("opened").alias("what"), "to_status"))
    return both.select("source_listing_id.*", "what", "to_status")


def step_drift_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drift from each delivery to the next."""
    return S.drift(*_steps(spark, sf_dir), "source_listing_id", "to_status", by="snapshot_no")


def step_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as places of nations (cities) and segments (streets), some of them astray."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 13 != 0, 41.0 + F.col("c_nationkey") / 10 + (k % 8) / 1000.0 + F.when(k % 17 == 0, 2.0).otherwise(0.0)).alias("lat"), (44.0 + (k % 6) / 1000.0).alias("lng"), "c_nationkey", F.when(k % 19 != 0, F.concat("c_mktsegment", (k % 8).cast("string"))).alias("street"))
    return S.trusted_pins(rows, "c_custkey", "lat", "lng", "c_nationkey", "street", 4)


def step_word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings by how well their titles fit a profile: role words, field words, skills."""
    wants = {"role": (0.5, ["engineer", "ინჟინერი", "analyst", "ანალიტიკოსი"], 1), "field": (0.3, ["export", "ექსპორტი", "hotel", "სასტუმრო"], 1), "skill": (0.2, ["senior", "უფროსი", "data", "მონაცემთა"], 2), "other": (0.4, [], 1)}
    rows = table(spark, sf_dir, "index_rows").select("row_id", F.round(S.word_score(lexemes(F.col("title")), wants), 6).alias("score"))
    return rows.where("score > 0")


_S = "(select source_listing_id, max(to_status) as to_status, max(deadline_at) as deadline_at from listing_snapshots where snapshot_no = {no} group by 1)"
_PAIRS = """n as (select snapshot_no as no, lag(snapshot_no) over (order by snapshot_no) as before from (select distinct snapshot_no from listing_snapshots)),
        v as (select snapshot_no, source_listing_id, max(to_status) as to_status, max(deadline_at) as deadline_at from listing_snapshots group by 1, 2),
        b as (select coalesce(a.no, b.no) as no, a.source_listing_id as x, b.source_listing_id as y, a.to_status as s, b.to_status as t, a.deadline_at as p, b.deadline_at as q
          from (select n.no, v.* from v join n on v.snapshot_no = n.before) a full outer join (select n.no, v.* from v join n on v.snapshot_no = n.no where n.before is not null) b on a.no = b.no and a.source_listing_id = b.source_listing_id)"""
QUERIES = {f.__name__: f for f in (step_versions, step_versions_all, step_drift, step_drift_all, step_pins, step_word_scores)}
SQL = {
    "step_versions": f"""with b as (select a.source_listing_id as x, b.source_listing_id as y, a.to_status as s, b.to_status as t from {_S.format(no=3)} a full outer join {_S.format(no=4)} b on a.source_listing_id = b.source_listing_id
          where a.source_listing_id is null or b.source_listing_id is null or a.to_status is distinct from b.to_status or a.deadline_at is distinct from b.deadline_at)
        select x as source_listing_id, 'closed' as what, s as to_status from b where x is not null union all select y, 'opened', t from b where y is not null""",
    "step_versions_all": f"""with {_PAIRS}, m as (select * from b where x is null or y is null or s is distinct from t or p is distinct from q)
        select no as snapshot_no, x as source_listing_id, 'closed' as what, s as to_status from m where x is not null union all select no, y, 'opened', t from m where y is not null""",
    "step_drift_all": f"""with {_PAIRS}, c as (select no, count(*) filter (y is null) as gone, count(*) filter (x is null) as new, count(*) filter (x is not null and y is not null and s is distinct from t) as changed, count(x) as n from b group by 1)
        select no as snapshot_no, gone, new, changed, case when n > 0 then round((gone + changed)::double / n, 6) else 0 end as share from c""",
    "step_drift": f"""with b as (select a.source_listing_id as x, b.source_listing_id as y, a.to_status as s, b.to_status as t from {_S.format(no=3)} a full outer join {_S.format(no=9)} b on a.source_listing_id = b.source_listing_id),
        c as (select count(*) filter (y is null) as gone, count(*) filter (x is null) as new, count(*) filter (x is not null and y is not null and s is distinct from t) as changed, count(x) as n from b)
        select gone, new, changed, round((gone + changed)::double / n, 6) as share from c""",
    "step_pins": """with r as (select c_custkey as k, case when c_custkey % 13 <> 0 then 41.0::double + c_nationkey / 10::double + (c_custkey % 8) / 1000.0::double + case when c_custkey % 17 = 0 then 2.0::double else 0 end end as a,
          44.0::double + (c_custkey % 6) / 1000.0::double as o, c_nationkey as c, case when c_custkey % 19 <> 0 then c_mktsegment || (c_custkey % 8) end as s from customer),
        w as (select c, a, o, count(distinct s) <= 4 as alone from r where a is not null group by 1, 2, 3), m as (select c, quantile_cont(a, 0.5) as ca, quantile_cont(o, 0.5) as co from w group by 1),
        j as (select r.*, alone and sqrt(pow((r.a - ca) * 111195.0::double, 2) + pow((r.o - co) * 111195.0::double * cos(radians(ca)), 2)) <= 30000 as cand from r join w on r.c = w.c and r.a = w.a and r.o = w.o join m on r.c = m.c),
        t as (select c, s, quantile_cont(a, 0.5) as sa, quantile_cont(o, 0.5) as so, count(*) as n from (select distinct c, s, a, o from j where cand and s is not null) group by 1, 2),
        d as (select k, cand, coalesce(cand and n >= 2 and sqrt(pow((j.a - sa) * 111195.0::double, 2) + pow((j.o - so) * 111195.0::double * cos(radians((sa + j.a) / 2)), 2)) <= 600, false) as ok from j left join t on j.c = t.c and j.s = t.s)
        select r.k as c_custkey, coalesce(cand, false) as is_candidate, coalesce(ok, false) as is_trusted from r left join d using (k)""",
    "step_word_scores": """with w as (select row_id, list_distinct(regexp_split_to_array(lower(title), '[^0-9a-zა-ჿ]+')) as l from index_rows),
        s as (select row_id, round((0.5::double * least(len(list_intersect(l, ['engineer', 'ინჟინერი', 'analyst', 'ანალიტიკოსი'])), 1) + 0.3::double * least(len(list_intersect(l, ['export', 'ექსპორტი', 'hotel', 'სასტუმრო'])), 1)
          + 0.2::double * least(len(list_intersect(l, ['senior', 'უფროსი', 'data', 'მონაცემთა'])), 2) / 2) / 1.0::double, 6) as score from w) select * from s where score > 0""",
}
