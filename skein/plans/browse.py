"""Faceted and grouped queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import facets as X
from skein.operators import totals as T
from skein.sources.tables import table


def _filters() -> list[X.Filter]:
    c = F.col
    return [
        X.Filter("type", F.lit(True), c("opp_type").isin("job", "internship", "tender")),
        X.Filter("status", F.lit(True), c("status").isin("active", "discovered")),
        X.Filter("place", c("read_cities").isNotNull() & (F.size("read_cities") > 0), F.exists("read_cities", lambda x: F.lower(x).startswith("ლ") | F.lower(x).startswith("l"))),
        X.Filter("deadline", c("deadline_at").isNotNull(), c("deadline_at") >= F.lit("2026-03-01").cast("timestamp"), keep=True),
        X.Filter("value", c("value_amount").isNotNull(), c("value_amount") >= 1000),
    ]


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.evaluated(table(spark, sf_dir, "index_rows"), _filters()[:4])


def facet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.summary(_evaluated(spark, sf_dir))


def facet_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.option_counts(_evaluated(spark, sf_dir), {"type": F.array("opp_type"), "status": F.array("status"), "board": F.array("source_slug"), "place": F.col("read_cities")})


def facet_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.drops(X.evaluated(table(spark, sf_dir, "index_rows"), _filters()))


def facet_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.left_out(_evaluated(spark, sf_dir), "source_slug")


_BUCKETS = [("small", 0.0, 999.0), ("middle", 1000.0, 9999.0), ("large", 20000.0, 1e12)]
_NOW = "2026-04-01"


def facet_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches as if the deadline's filter were each of these: closing within days, any range of values, a bucket of values."""
    now = F.lit(_NOW).cast("timestamp")
    tests = {f"within_{d}": X.closing(F.col("deadline_at"), now, d) for d in (7, 30, 90)} | {"overlap": X.overlapping(F.when(F.col("row_id") % 3 == 0, F.col("value_amount")), F.when(F.col("row_id") % 2 == 0, F.col("value_amount") * 2), 1000.0, 5000.0)}
    tests |= {name: X.bucket(F.col("value_amount"), _BUCKETS) == name for name, _, _ in _BUCKETS}
    return X.presets(_evaluated(spark, sf_dir), "deadline", tests)


def facet_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.ranked_options(_evaluated(spark, sf_dir), {"type": F.array("opp_type"), "status": F.array("status"), "board": F.array("source_slug")}, {"type": ["job", "prize"], "board": ["gone-board"]})


def facet_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by type, where the filter on values only applies to tenders and that on deadlines not to events."""
    applies = {"job": ["status", "place", "deadline"], "tender": ["status", "place", "deadline", "value"], "event": ["status", "place"], "grant": ["status", "value"]}
    return X.kind_counts(table(spark, sf_dir, "index_rows"), "opp_type", _filters(), applies)


def facet_suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.suggested(_evaluated(spark, sf_dir), "place", F.col("organization"), "opp_type", 15)


def facet_never(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "index_rows").withColumn("month", F.date_format("first_seen_at", "yyyy-MM")).withColumn("board_day", F.concat_ws("/", "source_slug", F.to_date("first_seen_at")))
    return X.never_stated(rows, _filters(), "board_day")


def facet_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.log_histogram(table(spark, sf_dir, "orders"), "o_totalprice")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)


def _leading(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _places(spark, sf_dir).select(
        "o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority", F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.when(F.col("o_orderkey") % 11 != 0, F.col("c_mktsegment")).alias("band"),
        F.when(F.col("o_orderkey") % 7 != 0, F.concat_ws("-", "o_custkey", "o_orderpriority")).alias("grp"),
    )
    return T.with_leaders(rows, "grp", [F.desc("o_orderdate"), F.col("o_orderkey")])


def totals_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.area_totals(_leading(spark, sf_dir), ["region", "nation"], "o_orderpriority", "band", "o_totalprice", 5)


def totals_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.units(_leading(spark, sf_dir), "grp", F.col("o_totalprice") > 100_000, ["nation"])


def totals_most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.most_common(_leading(spark, sf_dir), "nation", "band")


_EV = """with f as (select *, not coalesce(opp_type in ('job', 'internship', 'tender'), false) as x1, not coalesce(status in ('active', 'discovered'), false) as x2,
  read_cities is not null and len(read_cities) > 0 as k3, len(list_filter(read_cities, lambda x: starts_with(lower(x), 'ლ') or starts_with(lower(x), 'l'))) > 0 as t3,
  deadline_at is not null as k4, deadline_at >= timestamptz '2026-03-01 00:00:00+00' as t4, value_amount is not null as k5, value_amount >= 1000 as t5 from index_rows),
g as (select *, not (k3 and coalesce(t3, false)) as x3, k4 and not coalesce(t4, false) as x4, not (k5 and coalesce(t5, false)) as x5 from f),
e as (select *, x1::int + x2::int + x3::int + x4::int as n_fail, (x3 and not k3)::int as n_unknown, not k4 as unstated,
  case when x1::int + x2::int + x3::int + x4::int = 1 then case when x1 then 'type' when x2 then 'status' when x3 then 'place' else 'deadline' end end as fail_key from g)
"""
_LEAD = """with p as (select o_orderkey, o_totalprice, o_orderdate, o_orderpriority, r_name as region, n_name as nation, case when o_orderkey % 11 <> 0 then c_mktsegment end as band,
  case when o_orderkey % 7 <> 0 then o_custkey || '-' || o_orderpriority end as grp
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
l as (select *, grp is null or row_number() over (partition by grp order by o_orderdate desc, o_orderkey) = 1 as leads from p)
"""
QUERIES = {f.__name__: f for f in (facet_summary, facet_options, facet_drops, facet_left_out, facet_histogram, facet_presets, facet_ranked, facet_kinds, facet_suggested, facet_never, totals_by_area, totals_units, totals_most_common)}
SQL = {
    "facet_summary": _EV + "select count(*) filter (n_fail = 0) as matches, count(*) filter (n_fail = 0 and unstated) as unstated, count(*) filter (n_fail > 0 and n_fail = n_unknown) as lenient, count(*) as in_scope from e",
    "facet_options": _EV
    + """, o as (select 'type' as facet, opp_type as option, n_fail, fail_key from e union all select 'status', status, n_fail, fail_key from e union all select 'board', source_slug, n_fail, fail_key from e
         union all select 'place', unnest(list_distinct(read_cities)), n_fail, fail_key from e)
         select facet, option, count(*) filter (n_fail = 0 or (n_fail = 1 and fail_key = facet)) as n, count(*) as in_scope from o where option is not null group by 1, 2""",
    "facet_drops": _EV
    + """select k as fail_key, count(*) as n from (select case when x1 then 'type' when x2 then 'status' when x3 then 'place' when x4 then 'deadline' else 'value' end as k
         from e where x1::int + x2::int + x3::int + x4::int + x5::int = 1) group by 1 order by 2 desc, 1 limit 4""",
    "facet_left_out": _EV + "select fail_key, source_slug, count(*) as n from e where n_fail = 1 and n_unknown = 1 group by 1, 2",
    "facet_histogram": """with v as (select cast(o_totalprice as double) as v, row_number() over (order by o_totalprice) - 1 as r, count(*) over () as n from orders where o_totalprice > 0),
        b as (select min(v) filter (r >= floor((n - 1) * 0.02::double)) as lo, min(v) filter (r >= floor((n - 1) * 0.98::double)) as hi from v)
        select greatest(0, least(29, floor((ln(v) - ln(lo)) / (ln(hi) - ln(lo)) * 30)))::int as bin, count(*) as n from v, b group by 1""",
    "facet_presets": _EV
    + """, b as (select *, coalesce(case when row_id % 3 = 0 then value_amount end, case when row_id % 2 = 0 then value_amount * 2 end) as lo, coalesce(case when row_id % 2 = 0 then value_amount * 2 end, case when row_id % 3 = 0 then value_amount end) as hi
           from e where n_fail = 0 or (n_fail = 1 and fail_key = 'deadline')),
         c as (select count(*) filter (deadline_at between timestamptz '2026-04-01 00:00:00+00' and timestamptz '2026-04-08 00:00:00+00') as within_7, count(*) filter (deadline_at between timestamptz '2026-04-01 00:00:00+00' and timestamptz '2026-05-01 00:00:00+00') as within_30,
           count(*) filter (deadline_at between timestamptz '2026-04-01 00:00:00+00' and timestamptz '2026-06-30 00:00:00+00') as within_90, count(*) filter (hi >= 1000 and lo <= 5000) as overlap, count(*) filter (value_amount between 0 and 999) as small, count(*) filter (value_amount between 1000 and 9999) as middle, count(*) filter (value_amount between 20000 and 1e12) as large from b)
         unpivot c on columns(*) into name preset value n""",
    "facet_ranked": _EV
    + """, o as (select 'type' as facet, opp_type as option, n_fail, fail_key from e union all select 'status', status, n_fail, fail_key from e union all select 'board', source_slug, n_fail, fail_key from e),
         told as (select facet, option, count(*) filter (n_fail = 0 or (n_fail = 1 and fail_key = facet)) as n, count(*) as in_scope from o where option is not null group by 1, 2),
         a as (select * from told union all select facet, option, 0, 0 from (values ('type', 'job'), ('type', 'prize'), ('board', 'gone-board')) v(facet, option) where (facet, option) not in (select (facet, option) from told))
         select *, row_number() over (partition by facet order by in_scope desc, option) as place from a""",
    "facet_kinds": _EV
    + """select opp_type, count(*) filter (case opp_type when 'job' then not x2 and not x3 and not x4 when 'tender' then not x2 and not x3 and not x4 and not x5 when 'event' then not x2 and not x3 else not x2 and not x5 end) as n
         from e where opp_type in ('job', 'tender', 'event', 'grant') group by 1""",
    "facet_suggested": _EV
    + """, b as (select organization as value, opp_type, count(*) as c from e where organization is not null and (n_fail = 0 or (n_fail = 1 and fail_key = 'place')) group by 1, 2)
         select value, cast(sum(c) as bigint) as n, arg_min(opp_type, (-c, opp_type)) as top_kind from b group by 1 order by 2 desc, 1 limit 15""",
    "facet_never": _EV
    + """, t as (select source_slug || '/' || strftime(cast(first_seen_at as date), '%Y-%m-%d') as board_day, count(*) filter (k3) as place, count(*) filter (k4) as deadline, count(*) filter (k5) as value from e group by 1)
         select fail_key, board_day from (unpivot t on place, deadline, value into name fail_key value n) where n = 0""",
    "totals_by_area": _LEAD
    + """, c as (select region, nation, o_orderpriority, band, grouping(region) as gr, grouping(nation) as gn, grouping(band) as gb, count(*) filter (leads) as listings, count(*) as posts,
           quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) filter (leads) as q
         from l group by grouping sets ((o_orderpriority), (o_orderpriority, band), (region, o_orderpriority), (region, o_orderpriority, band), (nation, o_orderpriority), (nation, o_orderpriority, band)))
         select case when gr = 0 then 'region' when gn = 0 then 'nation' else 'all' end as area_level, coalesce(case when gr = 0 then region when gn = 0 then nation end, '') as area, o_orderpriority,
           case when gb = 1 then 'all' else band end as band, listings, posts, round(q[1], 4) as price_p25, round(q[2], 4) as price_median, round(q[3], 4) as price_p75
         from c where listings >= 5 and (gb = 1 or band is not null)""",
    "totals_units": _LEAD + "select nation, count(*) filter (grp is null and o_totalprice > 100000) + count(distinct grp) filter (o_totalprice > 100000) as units from l group by 1",
    "totals_most_common": _LEAD + "select nation, band, n from (select nation, band, count(*) as n from l where band is not null group by 1, 2) qualify row_number() over (partition by nation order by n desc, band) = 1",
}
