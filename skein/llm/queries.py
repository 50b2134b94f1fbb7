"""The pN_ queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.groups import groups_of
from skein.llm.leaks import leaks
from skein.llm.linkage import linked
from skein.llm.mixing import mix
from skein.llm.places import map_places
from skein.llm.residue import residue
from skein.llm.survivors import MAX_RANKS, status_stated, steep, text_stated, time_stated, truth
from skein.operators.instants import parse_instants
from skein.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "listing_pairs").where("decision = 'confirmed_same' and superseded_at is null")
    return groups_of(pairs, "left_listing_id", "right_listing_id", table(spark, sf_dir, "index_rows"), "source_listing_id", "opportunity_id")


def _stated_values() -> dict:
    """Titles without case and spacing, statuses, deadlines by the minute; null where the field isn't stated."""
    return {
        "canonical_title": F.when(text_stated("canonical_title"), F.lower(F.trim(F.regexp_replace("canonical_title", "[\\s\\p{Z}]+", " ")))),
        "canonical_status": F.when(status_stated("canonical_status"), F.lower(F.trim("canonical_status"))),
        "deadline_at": F.when(time_stated("deadline_at"), F.date_format("deadline_at", "yyyy-MM-dd HH:mm")),
    }


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that truth discovery takes each field from; boards vote by rank of trust, those without one last."""
    boards = table(spark, sf_dir, "sources").where("trust_rank is not null").groupBy("source_slug").agg(F.min("trust_rank").alias("trust"))
    ranks = [r["trust"] for r in boards.select("trust").distinct().limit(MAX_RANKS + 1).collect()]
    details = table(spark, sf_dir, "opportunity_details")
    many = details.groupBy("opportunity_id").agg(F.min("record_id").alias("a"), F.max("record_id").alias("b")).where("a <> b").select("opportunity_id")
    last = max(ranks, default=0) + 1
    records = details.join(many, "opportunity_id", "left_semi").join(boards, "source_slug", "left").withColumn("trust", F.coalesce("trust", F.lit(last)))
    found = truth(records, "opportunity_id", "trust", _stated_values(), record="record_id", latest=[-F.unix_micros("updated_at")], prior=steep({r: r for r in [*ranks, last]}))
    return found.select("opportunity_id", "field_name", "record_id")


def p5_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What truth discovery would let survive if nothing were known of the boards."""
    return truth(table(spark, sf_dir, "opportunity_details"), "opportunity_id", "source_slug", _stated_values())


def _vacancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    boards = table(spark, sf_dir, "sources").select("source_slug", "zone_name", "date_order")
    views = table(spark, sf_dir, "listing_views").join(boards, "source_slug", "left")
    timed = parse_instants(views, "deadline_at", "zone_name", "date_order", "closes_us")
    return linked(timed, "source_listing_id", "source_slug", "title", "organization", "closes_us", "first_seen_at")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vacancies(spark, sf_dir).where("confidence >= 0.5").select(F.col("left").alias("left_listing_id"), F.col("right").alias("right_listing_id"))


def p6_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by confidence, in tenths."""
    return _vacancies(spark, sf_dir).groupBy(F.floor(F.col("confidence") * 10).alias("tenth")).agg(F.count("*").alias("n_pairs"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_places(table(spark, sf_dir, "index_rows"), "row_id", "read_cities", table(spark, sf_dir, "curated_places"), "place_ref", ["name_ka", "name_en"], "aliases")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where("run_share >= 0.5").select("doc_id", "item_id")


def p8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage near an item's that hold much of it in its order, with its numbers, but not in long runs: reworded copies."""
    return _leaks(spark, sf_dir).where("run_share < 0.5 and cosine >= 0.5 and lcs_share >= 0.6 and answer_share >= 0.8").select("doc_id", "item_id", F.round("lcs_share", 3).alias("lcs_share"), F.round("answer_share", 3).alias("answer_share"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    import public_tokenizers as tokenizers

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return mix(table(spark, sf_dir, "documents"), "doc_id", "source", "text", table(spark, sf_dir, "mix_targets"), "target_share", "max_repeats", path, tokenizers.PATTERN)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id")


QUERIES = {"p3_found": p3_found, "p5_found": p5_found, "p5_truth": p5_truth, "p6_found": p6_found, "p6_confidence": p6_confidence, "p7_found": p7_found, "p8_found": p8_found, "p8_near": p8_near, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found}
SQL = {
    # Transitive closure of labels over pairs and shared opportunities.
    "p3_found": """
with recursive links as (
  select left_listing_id as a, right_listing_id as b from listing_pairs where decision = 'confirmed_same' and superseded_at is null and left_listing_id <> right_listing_id
  union select i.source_listing_id, j.m from index_rows i join (select opportunity_id, min(source_listing_id) as m from index_rows group by 1) j using (opportunity_id) where i.source_listing_id <> j.m),
ways as (select a, b from links union select b, a from links),
reach(v, w) as (select a, a from ways union select r.v, e.b from reach r join ways e on e.a = r.w)
select v as source_listing_id, min(w) as group_id from reach group by v having count(*) > 1""",
    "p5_found": """
with r as (select d.*, s.trust_rank from opportunity_details d left join (select source_slug, min(trust_rank) as trust_rank from sources group by 1) s using (source_slug) where opportunity_id is not null),
many as (select opportunity_id from r group by 1 having count(distinct record_id) > 1),
said as (
  select opportunity_id, record_id, trust_rank, updated_at, 'canonical_title' as field_name from r
  where trim(regexp_replace(canonical_title, '[\\s\\p{Z}]+', ' ', 'g')) <> '' and not regexp_matches(canonical_title, '(\\.\\.+|…)\\s*$')
    and lower(trim(canonical_title)) not in ('unknown', 'n/a', '-', 'null', 'tbd', '???', '0', 'უცნობია', 'none', '?', '--')
  union all select opportunity_id, record_id, trust_rank, updated_at, 'canonical_status' from r where lower(trim(canonical_status)) in ('discovered', 'active', 'missing_suspected', 'closed', 'expired', 'quarantined')
  union all select opportunity_id, record_id, trust_rank, updated_at, 'deadline_at' from r where deadline_at is not null and cast(deadline_at as date) not in (date '1970-01-01', date '2099-12-31'))
select opportunity_id, field_name, record_id from said where opportunity_id in (select opportunity_id from many)
qualify row_number() over (partition by opportunity_id, field_name order by trust_rank nulls last, updated_at desc nulls last, record_id) = 1""",
}
