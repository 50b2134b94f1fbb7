"""Searches over lines of orders seen as listings: price, area, rooms, tags, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import facets as X
from skein.operators import search as S
from skein.sources.tables import table

PRECISION = ["none", "city", "street", "house", "pin"]
FIELDS = S.Fields(
    brand=("equals", "p_brand"), kinds=("one_of", "p_type"), price_from=("at_least", "price"), price_to=("at_most", "price"), area_from=("at_least", "area"), rooms=("counts", "rooms", 5), tags=("all_of", "tags"), some_tags=("any_of", "tags"),
    near=("within", "stations", "minutes"), precision=("rank", "precision", PRECISION), text=("words", "title"), exclusive=("flag", "exclusive"),
)


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, p, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    k = F.col("l_orderkey")
    return l.join(p, l.l_partkey == p.p_partkey).join(o.select("o_orderkey", "o_orderdate", "o_orderpriority"), l.l_orderkey == o.o_orderkey).select(
        (k * 10 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("area"), F.when(k % 7 != 0, F.col("l_linenumber")).alias("rooms"), "p_brand", "p_type", F.col("p_name").alias("title"),
        F.array(F.col("l_returnflag"), F.col("l_linestatus")).alias("tags"), F.array((k % 25).cast("int"), (k % 9).cast("int")).alias("stations"), F.array((k % 20).cast("int"), (k % 11).cast("int")).alias("minutes"),
        F.element_at(F.array(*map(F.lit, PRECISION)), (k % 5 + 1).cast("int")).alias("precision"), (F.col("l_discount") > 0.05).alias("exclusive"), F.when(k % 3 != 0, F.concat_ws("-", "l_partkey", "l_suppkey")).alias("grp"), F.col("o_orderpriority").alias("region"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at_us"),
    )


SEARCH = {"price_from": 2000.0, "price_to": 60000.0, "area_from": 5.0, "rooms": [1, 2, 5], "some_tags": ["A", "R"], "near": ([1, 2, 3, 4, 5, 6, 7], 10), "precision": "street", "exclusive": True, "kinds": [], "brand": None}


def search_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _listings(spark, sf_dir).where(FIELDS.predicate(SEARCH))
    return rows.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price"))


def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.page(_listings(spark, sf_dir), FIELDS.predicate(SEARCH), [F.desc("at_us"), F.col("id")], 20, 20).select("id", "price", "at_us")


def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By word beginnings of the most common first word of part names."""
    first = table(spark, sf_dir, "part").select(F.lower(F.substring_index("p_name", " ", 1)).alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").first()
    return _listings(spark, sf_dir).where(FIELDS.predicate({"text": first["w"][:4] if first else "x"})).groupBy("title").agg(F.count("*").alias("n"))


def search_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.grouped_page(_listings(spark, sf_dir), FIELDS.predicate({"price_from": 1000.0, "exclusive": True}), "grp", [F.col("price"), F.col("id")], 500).select("id", "price", "alike")


def search_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.capped_count(_listings(spark, sf_dir), FIELDS.predicate({"price_from": 1000.0}), 1000)


def search_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines without a room count would have two rooms or fewer, by priority and brand."""
    rows = _listings(spark, sf_dir).withColumn("area_key", F.concat_ws("/", "region", "p_brand"))
    return S.unknown_estimate(rows, "area_key", "rooms", F.col("rooms") <= 2)


def search_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.shares(_listings(spark, sf_dir), "p_brand", "rooms")


def search_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.kinds_and_bands(_listings(spark, sf_dir), "region", "price")


_EACH = S.Fields(
    brand=("equals", "p_brand"), kinds=("one_of", "p_type"), all_tags=("all_of", "tags"), station=("within", "stations", "minutes"), text=("words", "title"), certain=("absent", "exclusive"), exclusive=("flag", "exclusive"),
    floor=("floors", "rooms", "area"), poster=("groups", "region", {"business": ["1-URGENT", "2-HIGH"], "other": ["3-MEDIUM", "5-LOW"]}), place=("places", {"brand": ("p_brand", False), "station": ("stations", True)}),
    price=("chosen", {"total": "price", "per_area": "unit_price"}), detail=("guarded", "rooms", ("at_least", "area")), shown=("on_show", "rooms", "area"), unplaced=("might", "rooms", "region"),
)
_ASKED = [
    ("equals", {"brand": "Brand#11"}), ("one_of", {"kinds": ["TYPE1", "TYPE2", "PROMO", "ECONOMY", "STANDARD"]}), ("contains_all", {"all_tags": ["A", "F"]}), ("stations_any_band", {"station": ([3, 4], 99)}), ("stations_none", {"station": ([], 5)}), ("certain", {"certain": True}), ("flag_false", {"exclusive": False}),
    ("not_first", {"floor": "not_first"}), ("not_last", {"floor": "not_last"}), ("middle", {"floor": "middle"}), ("floors", {"floor": (2, 4)}), ("floor_up_to", {"floor": (None, 3)}), ("poster", {"poster": "business"}), ("posters", {"poster": ["business", "other"]}),
    ("places", {"place": [("brand", "Brand#11"), ("station", 5)]}), ("price_total", {"price": ("total", 3000.0, 9000.0)}), ("price_per_area", {"price": ("per_area", None, 1200.0)}), ("detail", {"detail": 20.0}), ("shown", {"shown": 30.0}), ("unplaced", {"unplaced": "1-URGENT"}), ("nothing", {"kinds": [], "brand": None}),
]


def search_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines each kind of filter lets pass, from one scan."""
    rows = _listings(spark, sf_dir).withColumn("unit_price", F.col("price") / F.col("area"))
    counts = rows.agg(*(F.count_if(_EACH.predicate(asked)).alias(name) for name, asked in _ASKED))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("filter"), F.col(n).alias("n")) for n, _ in _ASKED))).alias("x")).select("x.*")


def search_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of brands, rooms (5 for more), tags and kinds, each counted as if its own filter were removed."""
    asked = {"brand": "Brand#11", "rooms": [1, 2], "price_to": 60000.0, "exclusive": True}
    rows = X.evaluated(_listings(spark, sf_dir), FIELDS.filters(asked))
    return X.option_counts(rows, {"brand": F.array("p_brand"), "rooms": F.array(F.when(F.col("rooms").isNotNull(), F.least("rooms", F.lit(5)).cast("string"))), "tags": F.col("tags"), "kinds": F.array("p_type")})


_L = """with l as (select l_orderkey * 10 + l_linenumber as id, l_orderkey as k, l_extendedprice as price, l_quantity as area, case when l_orderkey % 7 <> 0 then l_linenumber end as rooms, p_brand, p_type, p_name as title,
  [l_returnflag, l_linestatus] as tags, l_discount > 0.05::double as exclusive, case when l_orderkey % 3 <> 0 then l_partkey || '-' || l_suppkey end as grp, o_orderpriority as region, epoch_us(o_orderdate) as at_us
  from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey),
f as (select * from l where price between 2000 and 60000 and area >= 5 and (rooms in (1, 2) or rooms >= 5) and list_has_any(tags, ['A', 'R']) and exclusive and k % 5 >= 2
  and ((k % 25 between 1 and 7 and k % 20 <= 10) or (k % 9 between 1 and 7 and k % 11 <= 10)))
"""
QUERIES = {f.__name__: f for f in (search_count, search_page, search_text, search_grouped, search_capped, search_unknown, search_shares, search_histogram, search_each, search_facets)}
SQL = {
    "search_count": _L + "select p_brand, count(*) as n, round(sum(price), 2) as price from f group by 1",
    "search_page": _L + "select id, price, at_us from f order by at_us desc, id limit 20 offset 20",
    "search_text": _L + ", w as (select lower(string_split(p_name, ' ')[1]) as w from part group by 1 order by count(*) desc, 1 limit 1) select title, count(*) as n from l, w where len(list_filter(regexp_split_to_array(lower(title), '[^0-9a-zა-ჿ]+'), lambda x: starts_with(x, substr(w, 1, 4)))) > 0 group by 1",
    "search_grouped": _L
    + """, u as (select *, coalesce(grp, '#' || row_number() over ()) as g from l where price >= 1000 and exclusive),
         g as (select *, row_number() over (partition by g order by price, id) as r, count(*) over (partition by g) as alike from u)
         select id, price, alike from g where r = 1 order by price, id limit 500""",
    "search_capped": _L + "select least(count(*), 1000) as n, count(*) > 1000 as more from l where price >= 1000",
    "search_unknown": _L
    + """, a as (select region, p_brand, count(rooms) as told, count(*) filter (rooms <= 2) as matching, count(*) filter (rooms is null) as unknown from l group by 1, 2)
         select sum(told) as told, sum(matching) as matching, sum(unknown) as unknown, round(sum(case when told > 0 then unknown * matching::double / told end))::bigint as likely from a""",
    "search_shares": _L + "select p_brand, sum(c) as n, '{' || string_agg('\"' || rooms || '\":' || c, ',' order by rooms::varchar) || '}' as shares from (select p_brand, rooms, count(*) as c from l where rooms is not null group by 1, 2) group by 1",
    "search_histogram": _L
    + """, b as (select region, quantile_cont(price, 0.02::double) as lo, quantile_cont(price, 0.98::double) as hi from l where price > 0 group by 1 having count(*) >= 5)
         select region, greatest(0, least(35, floor((ln(price) - ln(lo)) / (ln(hi) - ln(lo)) * 36)))::int as bin, count(*) as n from l join b using (region) where price > 0 group by 1, 2""",
    "search_each": _L
    + """, c as (select count(*) filter (p_brand = 'Brand#11') as equals, count(*) filter (p_type in ('TYPE1', 'TYPE2', 'PROMO', 'ECONOMY', 'STANDARD')) as one_of, count(*) filter (tags = ['A', 'F']) as contains_all, count(*) filter (k % 25 in (3, 4) or k % 9 in (3, 4)) as stations_any_band,
           count(*) filter (k % 20 <= 5 or k % 11 <= 5) as stations_none, count(*) filter (not exclusive) as certain, count(*) filter (not exclusive) as flag_false, count(*) filter (rooms > 1) as not_first, count(*) filter (rooms < area) as not_last, count(*) filter (rooms > 1 and rooms < area) as middle,
           count(*) filter (rooms between 2 and 4) as floors, count(*) filter (rooms <= 3) as floor_up_to, count(*) filter (region in ('1-URGENT', '2-HIGH')) as poster, count(*) filter (region in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')) as posters, count(*) filter (p_brand = 'Brand#11' or k % 25 = 5 or k % 9 = 5) as places,
           count(*) filter (price between 3000 and 9000) as price_total, count(*) filter (price / area <= 1200) as price_per_area, count(*) filter (rooms is not null and area >= 20) as detail, count(*) filter (greatest(coalesce(rooms, area), area) > 30) as shown, count(*) filter (rooms is null and region = '1-URGENT') as unplaced, count(*) as nothing from l)
         unpivot c on columns(*) into name filter value n""",
    "search_facets": _L
    + """, e as (select *, (p_brand <> 'Brand#11')::int as f1, (not coalesce(rooms in (1, 2), false))::int as f2, (price > 60000)::int + (not exclusive)::int as f3 from l),
         o as (select 'brand' as facet, p_brand as option, f2 + f3 = 0 as ok from e union all select 'rooms', least(rooms, 5)::varchar, f1 + f3 = 0 from e where rooms is not null union all select 'kinds', p_type, f1 + f2 + f3 = 0 from e union all select 'tags', t, ok from (select unnest(list_distinct(tags)) as t, f1 + f2 + f3 = 0 as ok from e))
         select facet, option, count(*) filter (ok) as n, count(*) as in_scope from o group by 1, 2""",
}
