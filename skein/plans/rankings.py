"""Queries over vectors, rankings, places, rates and closures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import geo as G
from skein.functions import text as X
from skein.operators import fixpoint as P
from skein.operators import ranking as K
from skein.operators.units import daily_rates
from skein.sources.tables import table


def rank_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector whose id is divisible by 100 against all: the ten nearest of at least 0.8 of the best."""
    rows = table(spark, sf_dir, "embeddings").withColumn("query_id", F.col("vec_id"))
    found = K.similar(rows.where("vec_id % 100 = 0"), rows, "query_id", "vec_id", "embedding", 0.8, 10)
    return found.withColumn("score", F.round("score", 5))


def rank_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "embeddings").select("vec_id", K.quantised(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.round("q.scale", 9).alias("scale"), F.aggregate("q.codes", F.lit(0), lambda s, x: s + x.cast("int")).alias("code_sum"), F.round(K.dot(F.col("q.codes"), F.col("q.codes")) * F.col("q.scale") * F.col("q.scale"), 5).alias("squared"))


def _lists(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    rank = lambda c: F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc(c), "o_custkey"))
    by = o.groupBy("o_orderpriority", "o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("d"))
    return [by.select("o_orderpriority", "o_custkey", rank("n").alias("rank")).where("rank <= 100"), by.select("o_orderpriority", "o_custkey", rank("d").alias("rank")).where("rank <= 100")]


def rank_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers fused from the hundred with most orders and the hundred with the latest, by priority."""
    many, late = _lists(spark, sf_dir)
    return K.fused([(many, 1.0), (late, 0.25)], "o_orderpriority", "o_custkey").withColumn("score", F.round("score", 9))


def rank_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    many, _ = _lists(spark, sf_dir)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.floor((F.col("c_acctbal") + 1000) / 3000).cast("int").alias("grade"))
    grades = table(spark, sf_dir, "orders").select("o_orderpriority", "o_custkey").distinct().join(c, "o_custkey")
    return K.ranking_quality(many, grades, "o_orderpriority", "o_custkey", "grade", 20)


def rank_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board each distinct title looks like, guessed from its words by a model of all titles."""
    rows = table(spark, sf_dir, "index_rows").select(F.col("row_id").alias("example"), F.col("source_slug").alias("label"), F.explode(X.lexemes(F.col("title"))).alias("feature")).withColumn("w", F.lit(3.0))
    priors, likely = K.bayes_model(rows, "label", "feature", "w")
    return K.bayes_classify(rows, priors, likely, "label", "feature", "w")


def geo_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers set out on a grid, with the nearest of 25 stations within 1325 m."""
    at = table(spark, sf_dir, "customer").select("c_custkey", (41.7 + (F.col("c_custkey") % 97) / 1000.0).alias("lat"), (44.75 + (F.col("c_custkey") % 89) / 1000.0).alias("lng"))
    stations = table(spark, sf_dir, "nation").select("n_nationkey", (41.7 + F.col("n_nationkey") * 4 / 1000.0).alias("s_lat"), (44.75 + (F.col("n_nationkey") * 7 % 25) * 3.5 / 1000.0).alias("s_lng"))
    return G.nearest(at, "c_custkey", "lat", "lng", stations, "n_nationkey", "s_lat", "s_lng", 1325.0)


def geo_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = [(41.71, 44.76), (41.75, 44.75), (41.79, 44.80), (41.74, 44.78), (41.72, 44.83)]
    at = table(spark, sf_dir, "customer").select("c_nationkey", (41.7 + (F.col("c_custkey") % 97) / 1000.0).alias("lat"), (44.75 + (F.col("c_custkey") % 89) / 1000.0).alias("lng"))
    return at.groupBy("c_nationkey").agg(F.count_if(G.inside(F.col("lat"), F.col("lng"), ring)).alias("n_inside"), F.count("*").alias("n"))


def geo_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = table(spark, sf_dir, "customer").select("c_nationkey", ((F.col("c_custkey") % 97) / 8).alias("lat"), ((F.col("c_custkey") % 89) / 8).alias("lng"))
    return G.median_place(at, "c_nationkey", "lat", "lng")


def rates_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate for every day from the first to the last of each currency, gaps filled with the one in force."""
    return daily_rates(table(spark, sf_dir, "fx_rates"), "currency", "valid_from", "quantity", "rate").select("currency", "day", F.round(F.col("per_unit").cast("double"), 9).alias("per_unit"))


def closure_removable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expired listings and their opportunities that may go because everything they are linked to may."""
    rows = table(spark, sf_dir, "index_rows").select("opportunity_id", "source_listing_id", "status")
    old = rows.groupBy("source_listing_id").agg(F.every(F.col("status").isin("expired", "closed", "quarantined")).alias("old")).where("old")
    free = rows.where("opportunity_id is not null").groupBy("opportunity_id").agg(F.every(F.col("status").isin("expired", "closed", "quarantined")).alias("old")).where("old")
    listings, groups = P.removable(rows, "source_listing_id", "opportunity_id", old, free)
    return listings.select(F.lit("listing").alias("kind"), F.col("source_listing_id").alias("id")).unionByName(groups.select(F.lit("opportunity").alias("kind"), F.col("opportunity_id").alias("id")))


_LISTS = """with b as (select o_orderpriority, o_custkey, count(*) as n, max(o_orderdate) as d from orders group by 1, 2),
  m as (select o_orderpriority, o_custkey, row_number() over (partition by o_orderpriority order by n desc, o_custkey) as rank from b qualify rank <= 100),
  l as (select o_orderpriority, o_custkey, row_number() over (partition by o_orderpriority order by d desc, o_custkey) as rank from b qualify rank <= 100)
"""
_AT = "select c_custkey, c_nationkey, 41.7::double + (c_custkey % 97) / 1000.0::double as lat, 44.75::double + (c_custkey % 89) / 1000.0::double as lng from customer"
QUERIES = {f.__name__: f for f in (rank_vectors, rank_quantised, rank_fused, rank_quality, rank_fields, geo_nearest, geo_inside, geo_median, rates_daily, closure_removable)}
SQL = {
    "rank_vectors": """with v as (select vec_id, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings),
        s as (select q.vec_id as query_id, v.vec_id, round(list_dot_product(q.e, v.e) / (q.n * v.n), 9) as score from v q join v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank, max(score) over (partition by query_id) as best from s)
        select query_id, vec_id, round(score, 5) as score, rank from r where rank <= 10 and score >= 0.8::double * best""",
    "rank_quantised": """with v as (select vec_id, embedding::double[] as e from embeddings), s as (select vec_id, e, list_max(list_transform(e, lambda x: abs(x))) / 127 as scale from v),
        c as (select vec_id, scale, list_transform(e, lambda x: round(x / scale)::int) as codes from s)
        select vec_id, round(scale, 9) as scale, list_sum(codes)::int as code_sum, round(list_dot_product(codes::double[], codes::double[]) * scale * scale, 5) as squared from c""",
    "rank_fused": _LISTS + "select o_orderpriority, o_custkey, round(sum(s), 9) as score from (select o_orderpriority, o_custkey, 1.0::double / (60 + rank) as s from m union all select o_orderpriority, o_custkey, 0.25::double / (60 + rank) from l) group by 1, 2",
    "rank_quality": _LISTS
    + """, g as (select distinct o_orderpriority, o_custkey, floor((c_acctbal + 1000) / 3000)::int as grade from orders join customer on o_custkey = c_custkey),
        x as (select o_orderpriority, sum((pow(2, grade) - 1) / log2(rank + 1)) as dcg, count(*) filter (grade >= 1) as hits from m join g using (o_orderpriority, o_custkey) where rank <= 20 group by 1),
        i as (select o_orderpriority, sum(case when r <= 20 then (pow(2, grade) - 1) / log2(r + 1) end) as idcg, count(*) as rel from (select *, row_number() over (partition by o_orderpriority order by grade desc, o_custkey) as r from g where grade >= 1) group by 1)
        select o_orderpriority, round(dcg / idcg, 6) as ndcg, round(hits / rel, 6) as recall from x join i using (o_orderpriority)""",
    "rank_fields": """with t as (select distinct row_id as example, source_slug as label, unnest(list_filter(regexp_split_to_array(lower(title), '[^0-9a-zა-ჿ]+'), lambda x: x <> '')) as feature from index_rows),
        s as (select label, feature, count(*) * 3.0::double as w from t group by 1, 2), v as (select count(distinct feature) * 0.1::double as v from t),
        a as (select label, sum(w) + any_value(v) as a from s, v group by 1), p as (select label, ln((count(distinct example) + 0.5::double) / (select sum(c) from (select count(distinct example) + 0.5::double as c from t group by label))) as p from t group by 1),
        e as (select example, feature from t), k as (select e.example, a.label, any_value(p.p) + sum(3.0::double * ln((coalesce(s.w, 0) + 0.1::double) / a.a)) as score
          from e cross join a join p on p.label = a.label left join s on s.label = a.label and s.feature = e.feature group by 1, 2),
        m as (select *, max(score) over (partition by example) as m, row_number() over (partition by example order by round(score, 6) desc, label) as r from k)
        select example, max(label) filter (r = 1) as label, round(max(exp(score - m)) / sum(exp(score - m)), 6) as probability from m group by 1""",
    "geo_nearest": f"""with c as ({_AT}), s as (select n_nationkey, 41.7::double + n_nationkey * 4 / 1000.0::double as sa, 44.75::double + (n_nationkey * 7 % 25) * 3.5::double / 1000.0::double as so from nation),
        d as (select c_custkey, n_nationkey, sqrt(pow((sa - lat) * 111195.0::double, 2) + pow((so - lng) * 111195.0::double * cos(radians((lat + sa) / 2)), 2)) as d from c, s),
        b as (select c_custkey, n_nationkey, d, count(*) over (partition by c_custkey) as n_in_reach, row_number() over (partition by c_custkey order by d, n_nationkey) as r from d where d <= 1325)
        select c.c_custkey, n_nationkey, (round(d / 50) * 50)::bigint as metres, case when d <= 325 then 5 when d <= 625 then 10 when d <= 1000 then 15 when d <= 1325 then 20 end as minutes, coalesce(n_in_reach, 0) as n_in_reach
        from c left join b on b.c_custkey = c.c_custkey and r = 1""",
    "geo_inside": f"""with c as ({_AT}), r as (select * from (values (41.71::double, 44.76::double, 41.75::double, 44.75::double), (41.75, 44.75, 41.79, 44.80), (41.79, 44.80, 41.74, 44.78), (41.74, 44.78, 41.72, 44.83), (41.72, 44.83, 41.71, 44.76)) t(a1, o1, a2, o2)),
        h as (select c_custkey, c_nationkey, count(*) filter ((a1 > lat) <> (a2 > lat) and lng < (lat - a1) * (o2 - o1) / (a2 - a1) + o1) % 2 = 1 as x from c, r group by 1, 2)
        select c_nationkey, count(*) filter (x) as n_inside, count(*) as n from h group by 1""",
    "geo_median": "select c_nationkey, quantile_cont(lat, 0.5) as lat, quantile_cont(lng, 0.5) as lng, count(*) as n_places from (select distinct c_nationkey, (c_custkey % 97) / 8.0::double as lat, (c_custkey % 89) / 8.0::double as lng from customer) group by 1",
    "rates_daily": """with r as (select currency, valid_from, max(rate::double / quantity) as x from fx_rates group by 1, 2), s as (select *, lead(valid_from) over (partition by currency order by valid_from) as nx from r)
        select currency, cast(unnest(generate_series(cast(valid_from as timestamp), cast(coalesce(nx - interval 1 day, valid_from) as timestamp), interval 1 day)) as date) as day, round(x, 9) as per_unit from s""",
}
