"""Queries over links, differences of tables, trees and top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import linking as L
from skein.operators.steps import steps_between
from skein.operators.units import daily_rates
from skein.sources.tables import table


def link_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of one opportunity joined along confirmed pairs, strongest first, never two of one board."""
    rows = table(spark, sf_dir, "index_rows").where("opportunity_id is not null").groupBy("source_listing_id").agg(F.min("opportunity_id").alias("opp"), F.min("source_slug").alias("board"))
    pairs = table(spark, sf_dir, "listing_pairs").where("decision = 'confirmed_same' and superseded_at is null")
    sides = rows.select(F.col("source_listing_id").alias("left_listing_id"), F.col("opp"))
    return L.linked_once_a_source(pairs.join(sides, "left_listing_id"), rows, "opp", "left_listing_id", "right_listing_id", "source_listing_id", "board", "confidence")


def _snapshot(spark: SparkSession, sf_dir: str, no: int) -> DataFrame:
    rows = table(spark, sf_dir, "listing_snapshots").where(F.col("snapshot_no") == no)
    return rows.groupBy("source_listing_id").agg(F.max(F.struct("delivered_at", "to_status", "title", "deadline_at", "last_seen_at")).alias("r")).select("source_listing_id", "r.*", (F.col("r.to_status") == "active").alias("is_open"))


def link_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second delivery does to the first, by outcome."""
    done = L.outcomes(_snapshot(spark, sf_dir, 1), _snapshot(spark, sf_dir, 2), "source_listing_id", ["to_status", "title"], "last_seen_at", "is_open", ["deadline_at"])
    return done.groupBy("outcome").agg(F.count("*").alias("n"), F.count_if("price_changed").alias("n_moved"))


def link_refetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.when(F.col("source_listing_id") % 9 != 0, F.md5(F.coalesce("title", F.lit(""))))
    known, seen = _snapshot(spark, sf_dir, 1).withColumn("digest", digest), _snapshot(spark, sf_dir, 2).withColumn("digest", F.md5(F.coalesce("title", F.lit(""))))
    return L.refetch(known, seen, "source_listing_id", "digest").groupBy("action").agg(F.count("*").alias("n"))


def _steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "listing_snapshots").groupBy("snapshot_no", "source_listing_id").agg(F.max(F.struct("delivered_at", "to_status", "title", "deadline_at", "last_seen_at")).alias("r"))
    return steps_between(rows.select("snapshot_no", "source_listing_id", "r.*", (F.col("r.to_status") == "active").alias("is_open")), "snapshot_no", "source_listing_id")


def link_outcomes_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each delivery does to the one before, by outcome."""
    done = L.outcomes(*_steps(spark, sf_dir), "source_listing_id", ["to_status", "title"], "last_seen_at", "is_open", ["deadline_at"])
    return done.groupBy(F.col("source_listing_id.snapshot_no").alias("snapshot_no"), "outcome").agg(F.count("*").alias("n"), F.count_if("price_changed").alias("n_moved"))


def link_refetch_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each delivery has to fetch, by the one before."""
    known, seen = (side.withColumn("digest", F.md5(F.coalesce("title", F.lit("")))) for side in _steps(spark, sf_dir))
    known = known.withColumn("digest", F.when(F.col("source_listing_id.source_listing_id") % 9 != 0, F.col("digest")))
    return L.refetch(known, seen, "source_listing_id", "digest").groupBy(F.col("source_listing_id.snapshot_no").alias("snapshot_no"), "action").agg(F.count("*").alias("n"))


def link_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.flattened(table(spark, sf_dir, "curated_places"), "place_ref", "parent_ref", "name_en")


def link_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest orders of each priority."""
    return L.ordered_top(table(spark, sf_dir, "orders"), ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_orderpriority", "o_orderkey", "place")


def link_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = daily_rates(table(spark, sf_dir, "fx_rates"), "currency", "valid_from", "quantity", "rate")
    return L.latest_complete(rates, "day", "currency", ["USD", "EUR"], "2026-03-01").select("currency", "day", F.round(F.col("per_unit").cast("double"), 9).alias("per_unit"))


_ONE = "(select * from (select source_listing_id, to_status, title, deadline_at, last_seen_at, row_number() over (partition by source_listing_id order by delivered_at desc nulls last, to_status desc nulls last, title desc nulls last, deadline_at desc nulls last, last_seen_at desc nulls last) as r from listing_snapshots where snapshot_no = {no}) where r = 1)"
_PAIRS = """with n as (select snapshot_no as no, lag(snapshot_no) over (order by snapshot_no) as before from (select distinct snapshot_no from listing_snapshots)),
        v as (select * from (select snapshot_no, source_listing_id, to_status, title, deadline_at, last_seen_at, row_number() over (partition by snapshot_no, source_listing_id order by delivered_at desc nulls last, to_status desc nulls last, title desc nulls last, deadline_at desc nulls last, last_seen_at desc nulls last) as r from listing_snapshots) where r = 1),
        a as (select n.no, v.* from v join n on v.snapshot_no = n.before), b as (select n.no, v.* from v join n on v.snapshot_no = n.no where n.before is not null)"""
QUERIES = {f.__name__: f for f in (link_clusters, link_outcomes, link_outcomes_all, link_refetch, link_refetch_all, link_tree, link_top, link_rates)}
SQL = {
    "link_outcomes": f"""select outcome, count(*) as n, count(*) filter (moved) as n_moved from (
        select case when a.source_listing_id is null then 'new' when b.source_listing_id is null then case when a.to_status = 'active' then 'missing' else 'gone' end
            when a.to_status is distinct from 'active' then 'reopened' when a.to_status is distinct from b.to_status or a.title is distinct from b.title then 'changed' when b.last_seen_at > a.last_seen_at then 'bumped' else 'unchanged' end as outcome,
          a.source_listing_id is not null and b.source_listing_id is not null and a.deadline_at is distinct from b.deadline_at as moved
        from {_ONE.format(no=1)} a full outer join {_ONE.format(no=2)} b on a.source_listing_id = b.source_listing_id) group by 1""",
    "link_outcomes_all": f"""{_PAIRS} select no as snapshot_no, outcome, count(*) as n, count(*) filter (moved) as n_moved from (
        select coalesce(a.no, b.no) as no, case when a.source_listing_id is null then 'new' when b.source_listing_id is null then case when a.to_status = 'active' then 'missing' else 'gone' end
            when a.to_status is distinct from 'active' then 'reopened' when a.to_status is distinct from b.to_status or a.title is distinct from b.title then 'changed' when b.last_seen_at > a.last_seen_at then 'bumped' else 'unchanged' end as outcome,
          a.source_listing_id is not null and b.source_listing_id is not null and a.deadline_at is distinct from b.deadline_at as moved
        from a full outer join b on a.no = b.no and a.source_listing_id = b.source_listing_id) group by 1, 2""",
    "link_refetch_all": f"""{_PAIRS} select no as snapshot_no, action, count(*) as n from (select coalesce(a.no, b.no) as no, case when b.source_listing_id is null then 'drop' when a.source_listing_id is null then 'fetch' when a.source_listing_id % 9 = 0 then 'adopt' when md5(coalesce(a.title, '')) = md5(coalesce(b.title, '')) then 'skip' else 'fetch' end as action
        from a full outer join b on a.no = b.no and a.source_listing_id = b.source_listing_id) group by 1, 2""",
    "link_refetch": f"""select action, count(*) as n from (select case when b.source_listing_id is null then 'drop' when a.source_listing_id is null then 'fetch' when a.source_listing_id % 9 = 0 then 'adopt' when md5(coalesce(a.title, '')) = md5(coalesce(b.title, '')) then 'skip' else 'fetch' end as action
        from {_ONE.format(no=1)} a full outer join {_ONE.format(no=2)} b on a.source_listing_id = b.source_listing_id) group by 1""",
    "link_tree": "with recursive t as (select place_ref, name_en as path, 0 as level from curated_places where parent_ref is null union all select c.place_ref, t.path || ' / ' || c.name_en, t.level + 1 from curated_places c join t on c.parent_ref = t.place_ref) select * from t",
    "link_top": "select o_orderpriority, o_orderkey, place from (select *, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as place from orders) where place <= 3",
    "link_rates": """with r as (select currency, valid_from, max(rate::double / quantity) as x from fx_rates group by 1, 2), s as (select *, lead(valid_from) over (partition by currency order by valid_from) as nx from r),
        d as (select currency, cast(unnest(generate_series(cast(valid_from as timestamp), cast(coalesce(nx - interval 1 day, valid_from) as timestamp), interval 1 day)) as date) as day, x from s),
        f as (select max(day) as day from (select day from d where currency in ('USD', 'EUR') and day <= date '2026-03-01' group by 1 having count(distinct currency) = 2))
        select currency, day, round(x, 9) as per_unit from d join f using (day) where currency in ('USD', 'EUR')""",
}
