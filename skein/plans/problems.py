"""The core pN_ queries: snapshot changes, amounts, instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.instants import parse_instants
from skein.operators.snapshots import snapshot_changes, snapshot_order
from skein.operators.units import daily_rates, stated_amounts
from skein.sources.tables import table


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = snapshot_order(table(spark, sf_dir, "crawl_runs"), "source_slug", "snapshot_no", "full_coverage")
    rows = table(spark, sf_dir, "listing_snapshots")
    return snapshot_changes(rows, order, "source_slug", "snapshot_no", "source_listing_id", "delivered_at", ["from_status", "to_status", "title", "organization"], ["deadline_at"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select(F.col("snapshot_no").cast("int"), "source_listing_id", "change_kind")


def p1_by_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many listings of each board were added, removed and changed by snapshot, and which fields changed."""
    kinds = _changes(spark, sf_dir).groupBy("source_slug", F.col("snapshot_no").cast("int").alias("snapshot_no"))
    count = lambda k: F.count_if(F.col("change_kind") == k)
    return kinds.agg(
        count("added").alias("n_added"), count("removed").alias("n_removed"), count("changed").alias("n_changed"), F.count_if(F.array_contains("changed_fields", "to_status")).alias("n_status"), F.count_if(F.array_contains("changed_fields", "deadline_at")).alias("n_deadline")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = daily_rates(table(spark, sf_dir, "fx_rates"), "currency", "valid_from", "quantity", "rate")
    return stated_amounts(table(spark, sf_dir, "index_rows"), "row_id", "salary_raw", "value_amount", "value_currency", "stated_on", rates, table(spark, sf_dir, "pay_periods"))


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated values alone, which SQL can say too."""
    return p2_found(spark, sf_dir).where("field_name = 'value'").select("row_id", "gel")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "discovered_listings").select(F.lit("discovered_listings").alias("table_name"), F.col("discovery_id").alias("row_key"), F.lit("publish_date").alias("field_name"), F.col("publish_date").alias("said"), "source_slug")
    views = table(spark, sf_dir, "listing_views")
    dates = F.explode(F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).alias("said")) for c in ("published_at", "deadline_at")))).alias("x")
    seen = views.select(F.lit("listing_views").alias("table_name"), F.col("source_listing_id").alias("row_key"), "source_slug", dates).select("table_name", "row_key", "x.field_name", "x.said", "source_slug")
    boards = table(spark, sf_dir, "sources").select("source_slug", "zone_name", "date_order")
    texts = found.unionByName(seen).where(F.col("said").isNotNull()).join(boards, "source_slug", "left")
    return parse_instants(texts, "said", "zone_name", "date_order", "utc_us").where(F.col("utc_us").isNotNull()).select("table_name", "row_key", "field_name", "utc_us")


# The same result by other means: full outer join of consecutive snapshots.
_P1 = """
with runs as (select source_slug, snapshot_no, row_number() over (partition by source_slug order by snapshot_no) as k
              from (select distinct source_slug, snapshot_no from crawl_runs where full_coverage)),
clean as (select s.source_slug, s.source_listing_id, r.k, s.delivered_at,
            coalesce(lower(regexp_replace(from_status, '[\\s\\p{Z}\\x{200B}\\x{FEFF}]+', '', 'g')), '') as a, coalesce(lower(regexp_replace(to_status, '[\\s\\p{Z}\\x{200B}\\x{FEFF}]+', '', 'g')), '') as b,
            coalesce(lower(regexp_replace(title, '[\\s\\p{Z}\\x{200B}\\x{FEFF}]+', '', 'g')), '') as c, coalesce(lower(regexp_replace(organization, '[\\s\\p{Z}\\x{200B}\\x{FEFF}]+', '', 'g')), '') as d, deadline_at as e
          from listing_snapshots s join runs r on s.source_slug = r.source_slug and s.snapshot_no = r.snapshot_no where source_listing_id is not null),
one as (select * from clean qualify row_number() over (partition by source_slug, source_listing_id, k order by delivered_at desc nulls last, a desc, b desc, c desc, d desc, e desc nulls last) = 1),
late as (select o.* from one o where o.k > 1),
early as (select o.source_slug, o.source_listing_id, o.k + 1 as k, o.a, o.b, o.c, o.d, o.e from one o join runs r on r.source_slug = o.source_slug and r.k = o.k + 1),
diff as (select coalesce(l.source_slug, p.source_slug) as source_slug, coalesce(l.source_listing_id, p.source_listing_id) as source_listing_id, coalesce(l.k, p.k) as k,
           case when p.k is null then 'added' when l.k is null then 'removed' else 'changed' end as change_kind, p.b as b0, l.b as b1, p.e as e0, l.e as e1
         from late l full outer join early p on l.source_slug = p.source_slug and l.source_listing_id = p.source_listing_id and l.k = p.k
         where p.k is null or l.k is null or l.a <> p.a or l.b <> p.b or l.c <> p.c or l.d <> p.d or l.e is distinct from p.e)
"""

QUERIES = {"p1_found": p1_found, "p1_by_board": p1_by_board, "p2_found": p2_found, "p2_values": p2_values, "p4_found": p4_found}
SQL = {
    "p1_found": _P1 + "select r.snapshot_no, d.source_listing_id, d.change_kind from diff d join runs r on r.source_slug = d.source_slug and r.k = d.k",
    "p1_by_board": _P1
    + """select d.source_slug, r.snapshot_no, count(*) filter (change_kind = 'added') as n_added, count(*) filter (change_kind = 'removed') as n_removed,
         count(*) filter (change_kind = 'changed') as n_changed, count(*) filter (change_kind = 'changed' and b0 <> b1) as n_status,
         count(*) filter (change_kind = 'changed' and e0 is distinct from e1) as n_deadline
         from diff d join runs r on r.source_slug = d.source_slug and r.k = d.k group by 1, 2""",
    # Unit texts as an explicit list; rates by an as-of join.
    "p2_values": """
with units(said, code, factor) as (values ('gel', 'GEL', 1.0), ('ლარი დ.ღ.გ-ს ჩათვლით', 'GEL', 1), ('ლარში', 'GEL', 1), ('₾', 'GEL', 1), ('lari', 'GEL', 1), ('ლარი', 'GEL', 1), ('ათ. ლარი', 'GEL', 1e3), ('gel thousand', 'GEL', 1e3), ('kgel', 'GEL', 1e3), ('1000 gel', 'GEL', 1e3), ('ათასი ლარი', 'GEL', 1e3),
  ('მლნ ლარი', 'GEL', 1e6), ('მილიონი ლარი', 'GEL', 1e6), ('mln gel', 'GEL', 1e6), ('million gel', 'GEL', 1e6), ('თეთრი', 'GEL', 0.01), ('tetri', 'GEL', 0.01), ('usd', 'USD', 1), ('დოლარი', 'USD', 1), ('$', 'USD', 1), ('დოლარში', 'USD', 1), ('us$', 'USD', 1), ('usd thousand', 'USD', 1e3), ('ათასი დოლარი', 'USD', 1e3), ('k usd', 'USD', 1e3),
  ('ევრო', 'EUR', 1), ('eur', 'EUR', 1), ('euro', 'EUR', 1), ('€', 'EUR', 1), ('euro cent', 'EUR', 0.01), ('eur cents', 'EUR', 0.01), ('֏', 'AMD', 1), ('amd', 'AMD', 1), ('gbp', 'GBP', 1), ('£', 'GBP', 1), ('rub', 'RUB', 1), ('₽', 'RUB', 1), ('try', 'TRY', 1), ('₺', 'TRY', 1)),
rates as (select currency, valid_from, max(rate / quantity) as per_unit from fx_rates where quantity > 0 group by 1, 2),
v as (select row_id, value_amount, code, factor, stated_on from index_rows join units on lower(trim(value_currency)) = said where value_amount > 0),
told as (select row_id, value_amount, factor, 1.0 as per_unit from v where code = 'GEL'
  union all select row_id, value_amount, factor, per_unit from v asof join rates r on v.code = r.currency and v.stated_on >= r.valid_from where code <> 'GEL')
select row_id, cast(floor(value_amount * factor * per_unit + 0.5 + 1e-7) as bigint) as gel from told""",
}
