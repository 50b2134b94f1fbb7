"""Queries over states in time and over groups of members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import history as H
from skein.operators import resolution as R
from skein.sources.tables import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))


def state_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of events that arrive in the order of their ids, not of their times."""
    seen = H.accepted(_events(spark, sf_dir), "user_id", ["event_id"], "ts", ["event_type"])
    return seen.groupBy("user_id", "outcome").agg(F.count("*").alias("n"))


def state_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.versions(_events(spark, sf_dir), "user_id", ["ts", "event_id"], ["event_type"]).select("user_id", "event_type", F.unix_micros("valid_from").alias("from_us"), F.unix_micros("valid_to").alias("to_us"))


def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = H.transitions(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type")
    return moved.groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


def state_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on show in UTC+4, up to two days apart."""
    days = _events(spark, sf_dir).withColumn("day", F.to_date(F.col("ts") + F.expr("interval 4 hours")))
    return H.spells(days, "user_id", "day", 2)


def state_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "crawl_runs").where("full_coverage")
    return H.missing_streaks(table(spark, sf_dir, "listing_snapshots"), runs, "source_slug", "source_listing_id", "snapshot_no", 3, 25, 0.1)


def state_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sign-up-like event with the last purchase-like event of the user before it."""
    events = _events(spark, sf_dir)
    kinds = [r[0] for r in events.select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    asks = events.where(F.col("event_type") == kinds[0]).select("event_id", "user_id", "ts")
    facts = events.where(F.col("event_type") == kinds[1]).select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("fact_id"), F.col("value").alias("fact_value"))
    return H.as_of(asks, facts, "user_id", "ts", "since", "fact_id", ["fact_id", "fact_value"]).drop("ts")


def group_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opportunities that some listing calls senior and some listing puts on a hotel or in export; on how many boards."""
    title = X.title_key(F.col("title"), fold=False)
    tests = {"senior": title.rlike("senior|უფროსი"), "field": title.rlike("hotel|სასტუმრო|export|ექსპორტი")}
    facts = {"n_members": F.count("*"), "n_boards": F.count_distinct("source_slug"), "first_seen_us": F.unix_micros(F.min("first_seen_at")), "last_deadline_us": F.unix_micros(F.max("deadline_at"))}
    return H.any_member(table(spark, sf_dir, "index_rows").where("opportunity_id is not null"), "opportunity_id", tests, facts)


def group_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an opportunity: the first stated values by listing, the boards' places joined."""
    rows = table(spark, sf_dir, "index_rows").where("opportunity_id is not null")
    return R.first_stated(rows, "opportunity_id", "row_id", ["title", "organization", "value_currency"], ["locations"]).withColumn("locations", F.array_join("locations", "|"))


def group_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undecided pairs, most alike first in `place`, with both sides' group sizes."""
    pairs = table(spark, sf_dir, "listing_pairs").where("decision = 'needs_review' and superseded_at is null")
    rows = table(spark, sf_dir, "index_rows").groupBy("source_listing_id").agg(F.min("opportunity_id").alias("opportunity_id"))
    sizes = rows.where("opportunity_id is not null").groupBy("opportunity_id").agg(F.count("*").alias("size"))
    sized = rows.join(sizes, "opportunity_id", "left").select("source_listing_id", F.coalesce("size", F.lit(0)).alias("size"))
    side = lambda s: sized.select(F.col("source_listing_id").alias(f"{s}_listing_id"), F.col("size").alias(f"{s}_size"))
    return pairs.join(side("left"), "left_listing_id", "left").join(side("right"), "right_listing_id", "left").select("pair_id", "confidence", "left_size", "right_size")


def group_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each board's runs and rows: last run, last full one, listings by status, listings in no opportunity."""
    runs = table(spark, sf_dir, "crawl_runs").groupBy("source_slug").agg(F.max_by("run_status", F.struct("started_at", "run_id")).alias("last_status"), F.max(F.when(F.col("full_coverage"), F.col("snapshot_no"))).alias("last_full"), F.count_if(F.col("finished_at").isNull()).alias("unfinished"))
    rows = table(spark, sf_dir, "index_rows").groupBy("source_slug").agg(F.count_if(F.col("status") == "active").alias("n_active"), F.count_if(F.col("status") == "closed").alias("n_closed"), F.count_if(F.col("opportunity_id").isNull()).alias("unlinked"), F.unix_micros(F.max("first_seen_at")).alias("newest_us"))
    return table(spark, sf_dir, "sources").select("source_slug").join(runs, "source_slug", "left").join(rows, "source_slug", "left")


def group_unlinked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with views that are in no opportunity (anti join) or were discovered more than once (semi join)."""
    found = table(spark, sf_dir, "discovered_listings").groupBy("source_listing_id").agg(F.count("*").alias("n")).where("n > 1")
    rows = table(spark, sf_dir, "index_rows").select("source_listing_id", "source_slug").distinct()
    linked = table(spark, sf_dir, "index_rows").where("opportunity_id is not null").select("source_listing_id").distinct()
    return rows.join(linked, "source_listing_id", "left_anti").withColumn("why", F.lit("unlinked")).unionByName(rows.join(found, "source_listing_id", "left_semi").withColumn("why", F.lit("found again")))


def group_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-alike lines of one part: the first by price leads those within 3 % of its price and 5 units."""
    return R.leader_clusters(table(spark, sf_dir, "lineitem").withColumn("line_id", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "line_id", ["l_partkey"], ["l_extendedprice"], {"l_quantity": ("absolute", 5.0), "l_extendedprice": ("relative", 0.03)})


def group_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed pairs of which a side has several partners on the other's board."""
    boards = table(spark, sf_dir, "index_rows").groupBy("source_listing_id").agg(F.min("source_slug").alias("board"))
    side = lambda s: boards.select(F.col("source_listing_id").alias(f"{s}_listing_id"), F.col("board").alias(f"{s}_board"))
    pairs = table(spark, sf_dir, "listing_pairs").where("decision = 'confirmed_same' and superseded_at is null and left_listing_id <> right_listing_id")
    one = pairs.select(F.least("left_listing_id", "right_listing_id").alias("left_listing_id"), F.greatest("left_listing_id", "right_listing_id").alias("right_listing_id")).distinct()
    return R.ambiguous(one.join(side("left"), "left_listing_id").join(side("right"), "right_listing_id"), "left_listing_id", "right_listing_id", "left_board", "right_board").select("left_listing_id", "right_listing_id", "is_ambiguous")


def group_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders grouped by customer, formerly by clerk-like key: which former key each group keeps."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 500).alias("new_key"), (F.col("o_custkey") % 499 * 3 + F.col("o_orderkey") % 3).alias("old_key"))
    return R.carried_keys(orders, "o_orderkey", "new_key", "old_key")


_T = "trim(regexp_replace(lower(regexp_replace(regexp_replace(title, '[\"''`„“”«»‘’]', '', 'g'), '[\\p{P}\\p{S}]+', ' ', 'g')), '[\\s\\p{Z}]+', ' ', 'g'))"
QUERIES = {
    f.__name__: f
    for f in (state_outcomes, state_versions, state_transitions, state_spells, state_streaks, state_as_of, group_search, group_fold, group_queue, group_health, group_unlinked, group_leaders, group_ambiguous, group_carried)
}
SQL = {
    "state_outcomes": """with s as (select *, coalesce(ts < max(ts) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), false) as stale from events),
        l as (select *, last_value(case when not stale then event_type end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as before from s)
        select user_id, case when stale then 'stale' when before is null then 'new' when before = event_type then 'unchanged' else 'changed' end as outcome, count(*) as n from l group by 1, 2""",
    "state_versions": """with s as (select *, lag(event_type) over w as p, row_number() over w as r from events window w as (partition by user_id order by ts, event_id))
        select user_id, event_type, epoch_us(ts) as from_us, epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) as to_us from s where r = 1 or p is distinct from event_type""",
    "state_transitions": """with s as (select *, lag(event_type) over w as p, row_number() over w as r from events window w as (partition by user_id order by ts, event_id))
        select p as from_state, event_type as to_state, count(*) as n from s where r = 1 or p is distinct from event_type group by 1, 2""",
    "state_spells": """with d as (select distinct user_id, cast(cast(ts as timestamp) + interval 4 hours as date) as d from events),
        s as (select *, sum(case when date_diff('day', p, d) <= 2 then 0 else 1 end) over (partition by user_id order by d) as g from (select *, lag(d) over (partition by user_id order by d) as p from d))
        select user_id, min(d) as first_day, max(d) as last_day, count(*) as n_days from s group by user_id, g""",
    "state_streaks": """with r as (select source_slug, snapshot_no, row_number() over (partition by source_slug order by snapshot_no) as no from (select distinct source_slug, snapshot_no from crawl_runs where full_coverage)),
        m as (select s.source_slug, source_listing_id, (select max(no) from r x where x.source_slug = s.source_slug) - max(no) as streak from listing_snapshots s join r on s.source_slug = r.source_slug and s.snapshot_no = r.snapshot_no group by 1, 2),
        c as (select *, count(*) filter (streak >= 3) over (partition by source_slug) as n, count(*) over (partition by source_slug) as a from m)
        select source_slug, source_listing_id, streak::int as streak, streak >= 3 and not n > greatest(25, floor(a * 0.1)) as closes from c""",
    "state_as_of": """with k as (select min(event_type) as a, (select min(event_type) from events where event_type > (select min(event_type) from events)) as b from events),
        f as (select user_id, ts, event_id, value from events, k where event_type = b)
        select e.event_id, e.user_id, x.event_id as fact_id, x.value as fact_value from events e cross join k
        left join lateral (select event_id, value from f where f.user_id = e.user_id and f.ts <= e.ts order by f.ts desc, f.event_id desc limit 1) x on true where e.event_type = k.a""",
    "group_search": f"""select opportunity_id, count(*) as n_members, count(distinct source_slug) as n_boards, epoch_us(min(first_seen_at)) as first_seen_us, epoch_us(max(deadline_at)) as last_deadline_us from index_rows where opportunity_id is not null group by 1
        having bool_or(regexp_matches({_T}, 'senior|უფროსი')) and bool_or(regexp_matches({_T}, 'hotel|სასტუმრო|export|ექსპორტი'))""",
    "group_fold": """select opportunity_id, min_by(title, row_id) filter (title is not null) as title, min_by(organization, row_id) filter (organization is not null) as organization, min_by(value_currency, row_id) filter (value_currency is not null) as value_currency,
        coalesce((select array_to_string(list(p order by first), '|') from (select p, min(pos) as first from (select unnest(flatten(g.ls)) as p, generate_subscripts(flatten(g.ls), 1) as pos) group by p)), '') as locations
        from (select opportunity_id as o, list(locations order by row_id) filter (locations is not null) as ls from index_rows where opportunity_id is not null group by 1) g join index_rows on opportunity_id = o group by opportunity_id, g.ls""",
    "group_queue": """with r as (select source_listing_id, min(opportunity_id) as o from index_rows group by 1), s as (select o, count(*) as n from r where o is not null group by 1), z as (select source_listing_id, coalesce(n, 0) as n from r left join s using (o))
        select pair_id, confidence, a.n as left_size, b.n as right_size from listing_pairs p left join z a on a.source_listing_id = left_listing_id left join z b on b.source_listing_id = right_listing_id where decision = 'needs_review' and superseded_at is null""",
    "group_health": """select s.source_slug, last_status, last_full, unfinished, n_active, n_closed, unlinked, newest_us from sources s
        left join (select source_slug, arg_max(run_status, (started_at, run_id)) as last_status, max(snapshot_no) filter (full_coverage) as last_full, count(*) filter (finished_at is null) as unfinished from crawl_runs group by 1) r using (source_slug)
        left join (select source_slug, count(*) filter (status = 'active') as n_active, count(*) filter (status = 'closed') as n_closed, count(*) filter (opportunity_id is null) as unlinked, epoch_us(max(first_seen_at)) as newest_us from index_rows group by 1) i using (source_slug)""",
    "group_unlinked": """with r as (select distinct source_listing_id, source_slug from index_rows)
        select *, 'unlinked' as why from r where not exists (select 1 from index_rows i where i.source_listing_id = r.source_listing_id and opportunity_id is not null)
        union all select *, 'found again' from r where source_listing_id in (select source_listing_id from discovered_listings group by 1 having count(*) > 1)""",
    "group_ambiguous": """with b as (select source_listing_id, min(source_slug) as s from index_rows group by 1),
        p as (select distinct least(left_listing_id, right_listing_id) as l, greatest(left_listing_id, right_listing_id) as r from listing_pairs where decision = 'confirmed_same' and superseded_at is null and left_listing_id <> right_listing_id)
        select l as left_listing_id, r as right_listing_id, count(*) over (partition by l, y.s) > 1 or count(*) over (partition by r, x.s) > 1 as is_ambiguous from p join b x on x.source_listing_id = l join b y on y.source_listing_id = r""",
    "group_carried": """with g as (select o_custkey % 500 as new_key, o_custkey % 499 * 3 + o_orderkey % 3 as old_key from orders), h as (select new_key, old_key, count(*) as n from g group by 1, 2),
        c as (select * from h qualify row_number() over (partition by new_key order by n desc, old_key) = 1), w as (select * from c qualify row_number() over (partition by old_key order by n desc, new_key) = 1)
        select new_key, old_key as carried from (select distinct new_key from g) left join w using (new_key)""",
}
