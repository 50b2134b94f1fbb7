"""Queries over pairs of listings: candidates, decisions, what stands for a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import names as N
from skein.functions import text as X
from skein.operators import matching as M
from skein.session import cut
from skein.sources.tables import table

_STATUSES = ["active", "missing_suspected", "discovered", "expired", "closed", "quarantined"]


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings once each, with keys; the application value is made up of the id, as no table states one."""
    one = table(spark, sf_dir, "index_rows").groupBy("source_listing_id").agg(*(F.min(c).alias(c) for c in ("source_slug", "title", "organization", "deadline_at", "first_seen_at", "opp_type")))
    value = F.when(F.col("source_listing_id") % 5 != 0, F.concat(F.lit("https://apply.example/v?ref=a&id="), F.floor(F.col("source_listing_id") / 3).cast("string")))
    return one.select("*", X.title_key(F.col("title")).alias("t"), X.organization_key(F.col("organization")).alias("o"), X.url_key(value).alias("v")).withColumn("g", X.trigrams(F.col("t")))


def _alike(rows: DataFrame, share: float) -> DataFrame:
    """(l, r, similarity): structs of all pairs of rows of one organisation with trigram similarity from `share`; each title of an organisation is compared once."""
    own = rows.where("source_listing_id is not null and t is not null and o is not null").drop("g")
    titles = cut(own.groupBy("o", "t").agg(F.min("source_listing_id").alias("i")))
    near = M.similar_pairs(titles.withColumn("g", X.trigrams(F.col("t"))), "i", "o", "g", share).unionByName(titles.select(F.col("i").alias("l"), F.col("i").alias("r"), F.lit(1.0).alias("similarity")))
    return M.of_members(near, own.join(titles.hint("merge"), ["o", "t"]).drop("o", "t"), "i", "source_listing_id")


def match_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of one organisation with trigram similarity from 0.45, whatever the organisation's size."""
    near = _alike(_listings(spark, sf_dir).select("source_listing_id", "o", "t"), M.WEAK)
    return near.groupBy(F.floor(F.col("similarity") * 20).alias("twentieth")).agg(F.count("*").alias("n_pairs"), F.sum("l.source_listing_id").alias("lefts"), F.sum("r.source_listing_id").alias("rights"))


def _jobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Decisions but the distinct ones, on pairs of one value that few carry, and on the other pairs of one organisation.

    A pair of one organisation without a value of its own is distinct below STRONG, so no weaker ones are looked for.
    """
    rows = _listings(spark, sf_dir).where("source_listing_id is not null and t is not null").drop("g", "title", "organization", "opp_type")
    carried = rows.where("v is not null").groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") <= M.VACANCY_LEVEL)
    told = rows.join(carried.hint("merge"), "v", "left").withColumn("v", F.when(F.col("n").isNotNull(), F.col("v")))
    near = lambda c: F.coalesce(F.abs(F.unix_micros(f"l.{c}") - F.unix_micros(f"r.{c}")) <= M.WINDOW_DAYS * 86_400_000_000, F.lit(False))

    def decided(pairs: DataFrame, similarity: Column, same_organization: Column) -> DataFrame:
        d = M.job_decision(F.col("l.source_slug") == F.col("r.source_slug"), similarity, F.col("l.v") == F.col("r.v"), F.col("l.n"), same_organization, near("deadline_at") | near("first_seen_at"))
        ends = [F.col(f"{p}.source_listing_id").alias(p) for p in "lr"] + [F.col(f"{p}.source_slug").alias(f"{p}_source_slug") for p in "lr"]
        return pairs.withColumn("d", d).select(*ends, "d.decision", "d.confidence").where("decision <> 'distinct'")

    own = told.where("v is not null")
    by_value = own.alias("l").join(own.alias("r").hint("merge"), F.expr("l.v = r.v and l.source_listing_id < r.source_listing_id and l.source_slug <> r.source_slug"))
    others = _alike(told, M.STRONG).where("l.source_slug <> r.source_slug and not coalesce(l.v = r.v, false)")
    return decided(by_value, X.jaccard(X.trigrams(F.col("l.t")), X.trigrams(F.col("r.t"))), F.col("l.o") == F.col("r.o")), decided(others, F.col("similarity"), F.lit(True))


def match_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on vacancies but the distinct ones, of all pairs that share an organisation or a value."""
    by_value, others = _jobs(spark, sf_dir)
    return by_value.unionByName(others).select("l", "r", "decision", "confidence")


def match_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vacancies' decisions after confirmed pairs that compete on a board are held; only pairs by value are confirmed, so the others stay as they are."""
    by_value, others = _jobs(spark, sf_dir)
    return M.held(by_value, "l", "r", "l_source_slug", "r_source_slug").unionByName(others).groupBy("decision", "confidence").agg(F.count("*").alias("n_pairs"), F.sum("l").alias("lefts"), F.sum("r").alias("rights"))


def _tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _listings(spark, sf_dir).where("opp_type = 'tender'")
    day = lambda c: F.to_date(F.col(c) + F.expr("interval 4 hours"))
    subject = N.tender_subject(F.col("title"))
    told = rows.select("source_listing_id", "source_slug", N.buyer_key(F.col("organization")).alias("b"), subject.alias("s"), N.reference_codes(F.col("title")).alias("c"), F.unix_date(day("deadline_at")).alias("dd"), F.unix_date(day("first_seen_at")).alias("pd"))
    return told.withColumn("g", X.trigrams(F.col("s"))).withColumn("k", N.dominant_script(F.col("s"))).withColumn("w", F.coalesce(N.head_word(F.col("b")), F.col("b")))


def match_tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on tenders but the distinct ones; pairs meet by the buyer's head word and a span of days, as any other is distinct."""
    rows = _tenders(spark, sf_dir).where("w is not null")
    slim = rows.select("source_listing_id", "source_slug", "w", "dd", "pd")
    meet = lambda c, days: (a := M.in_spans(slim, c, days)).alias("l").join(a.alias("r"), F.expr(f"l.w = r.w and l.span = r.span and l.source_listing_id < r.source_listing_id and l.source_slug <> r.source_slug and abs(l.{c} - r.{c}) <= {days}")).select(F.col("l.source_listing_id").alias("x"), F.col("r.source_listing_id").alias("y"))
    ids = meet("dd", M.REVIEW_DAYS).union(meet("pd", M.REVIEW_DAYS)).distinct()
    l, r = rows.alias("l"), rows.alias("r")
    both = ids.join(l, F.col("x") == F.col("l.source_listing_id")).join(r, F.col("y") == F.col("r.source_listing_id"))
    two = lambda c: (F.col(f"l.{c}"), F.col(f"r.{c}"))
    gap = lambda c: F.abs(F.col(f"l.{c}") - F.col(f"r.{c}"))
    d = M.tender_decision(F.lit(False), N.buyers_match(*two("b")), two("s"), two("g"), two("k"), two("c"), gap("dd"), gap("pd"))
    return both.select("x", "y", d.alias("d")).select(F.col("x").alias("l"), F.col("y").alias("r"), "d.decision", "d.confidence").where("decision <> 'distinct'")


def match_buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buyers by key, with how many names each has and whether its first word tells it from others."""
    rows = table(spark, sf_dir, "index_rows").select(N.buyer_key(F.col("organization")).alias("buyer"), "organization").where("buyer is not null")
    return rows.groupBy("buyer", N.head_word(F.col("buyer")).alias("head")).agg(F.count_distinct("organization").alias("n_names"), F.count("*").alias("n_rows"))


def match_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "index_rows").select(N.tender_subject(F.concat(F.lit("Procurement of "), "title")).alias("subject"))
    return rows.groupBy("subject", N.dominant_script(F.col("subject")).alias("script")).agg(F.count("*").alias("n_rows"))


def match_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "listing_pairs")
    return M.standing(pairs, "left_listing_id", "right_listing_id", "decision", F.col("decided_by") == "human", "decided_at", "pair_id", F.col("superseded_at").isNotNull())


def match_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standing confirmations whose titles disagree by now."""
    rows = _listings(spark, sf_dir)
    sure = match_standing(spark, sf_dir).where("decision = 'confirmed_same'")
    side = lambda p: rows.select(F.col("source_listing_id").alias(p), F.col("t").alias(f"t_{p}")).hint("merge")
    both = sure.join(side("left"), "left").join(side("right"), "right").where("t_left is not null and t_right is not null")
    return both.select("left", "right", F.round(X.jaccard(X.trigrams(F.col("t_left")), X.trigrams(F.col("t_right"))), 6).alias("similarity")).where(F.col("similarity") < M.WEAK)


def match_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings in no standing confirmation: each is a group of its own."""
    sure = match_standing(spark, sf_dir).where("decision = 'confirmed_same'")
    linked = sure.select(F.explode(F.array("left", "right")).alias("source_listing_id"))
    rows = table(spark, sf_dir, "index_rows").select("source_listing_id").distinct()
    return rows.join(linked, "source_listing_id", "left_anti").select("source_listing_id", F.col("source_listing_id").alias("group_id"))


def match_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "index_rows").dropDuplicates(["opportunity_id", "source_listing_id"])
    scalars = {"title": F.col("title"), "organization": F.col("organization"), "deadline_us": F.unix_micros("deadline_at")}
    return M.canonical(rows, "opportunity_id", "source_listing_id", "status", _STATUSES, scalars)


QUERIES = {f.__name__: f for f in (match_titles, match_jobs, match_held, match_tenders, match_buyers, match_subjects, match_standing, match_recheck, match_singletons, match_canonical)}

# Written out for the oracle alone.
_FORMS = "'შპს', 'სს', 'ააიპ', 'სსიპ', 'ი/მ', 'ინდმეწარმე', 'llc', 'ltd', 'ltda', 'limited', 'jsc', 'inc', 'co', 'corp', 'corporation', 'gmbh', 'llp', 'plc'"
_KEY = """nullif(trim(regexp_replace(lower(regexp_replace(regexp_replace(nfc_normalize({c}), '["''`„“”«»‘’]', '', 'g'), '[\\p{{P}}\\p{{S}}]+', ' ', 'g')), '[\\s\\p{{Z}}]+', ' ', 'g')), '')"""
_ORG = "nullif(array_to_string(list_filter(string_split(" + _KEY + ", ' '), lambda w: w not in (" + _FORMS + ")), ' '), '')"
_GRAMS = "list_distinct([substr('  ' || {c} || ' ', i, 3) for i in range(1, length({c}) + 2)])"
_ROWS = f"""one as (select source_listing_id as id, min(source_slug) as s, min(title) as title, min(organization) as organization, min(deadline_at) as d, min(first_seen_at) as p, min(opp_type) as opp_type from index_rows group by 1),
r as (select *, {_GRAMS.format(c="t")} as g from (select *, {_KEY.format(c="title")} as t, {_ORG.format(c="organization")} as o, case when id % 5 <> 0 then 'https://apply.example/v?id=' || (id // 3) end as v from one))"""
_SIM = "len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g)))"
_JOBS = f"""{_ROWS},
many as (select v, count(*) as n from r where v is not null and t is not null group by 1),
p as (select x.id as l, y.id as r, x.s as ls, y.s as rs, {_SIM} as sim, coalesce(x.v = y.v and n <= 2, false) as own, coalesce(x.o = y.o, false) as org,
  coalesce(abs(epoch_us(x.d) - epoch_us(y.d)) <= 21 * 86400000000, false) or coalesce(abs(epoch_us(x.p) - epoch_us(y.p)) <= 21 * 86400000000, false) as near
  from r x join r y on x.id < y.id and x.s <> y.s and (x.o = y.o or x.v = y.v) left join many on x.v = many.v where x.t is not null and y.t is not null),
j as (select l, r, ls, rs, case when sim < 0.45 and own then 'needs_review' when sim < 0.45 then 'distinct' when own and sim >= 0.82 then 'confirmed_same' when own then 'probable_same' when org and sim >= 0.82 then 'needs_review' else 'distinct' end as decision,
  case when sim < 0.45 and own then 0.5 when own and sim >= 0.82 then 0.97 when own then 0.75 when near then 0.65 else 0.55 end as confidence from p)"""
_STANDING = "select least(left_listing_id, right_listing_id) as \"left\", greatest(left_listing_id, right_listing_id) as \"right\", decision from listing_pairs where superseded_at is null and left_listing_id <> right_listing_id qualify row_number() over (partition by 1, 2 order by (coalesce(decided_by = 'human', false))::int desc, decided_at desc nulls last, pair_id desc) = 1"
_STANDING = _STANDING.replace("partition by 1, 2", "partition by least(left_listing_id, right_listing_id), greatest(left_listing_id, right_listing_id)")
_BUYER = "coalesce(case {k} when 'გაეროს განვითარების პროგრამა' then 'undp' when 'united nations development programme' then 'undp' end, {k})"
_GENERIC = "('კომპანია', 'company', 'საქართველოს', 'საქართველო', 'georgia', 'ჯგუფი', 'group', 'გაეროს', 'un')"
_SUBJECT = "nullif(array_to_string(list_filter(string_split(" + _KEY + ", ' '), lambda w: w not in ('ტენდერი', 'ტენ', 'tender', 'rfq', 'rfp', 'itb', 'eoi', 'თაობაზე', 'შესახებ', 'დაკავშირებით', 'შესყიდვა', 'შესყიდვის', 'შესყიდვაზე', 'შესყიდვასთან', 'შეძენა', 'შეძენის', 'შეძენაზე', 'procurement', 'for', 'the', 'of')), ' '), '')"
_SCRIPT = "case when length(regexp_replace({c}, '[^ა-ჿ]', '', 'g')) + length(regexp_replace({c}, '[^A-Za-z]', '', 'g')) > 0 then case when length(regexp_replace({c}, '[^ა-ჿ]', '', 'g')) >= length(regexp_replace({c}, '[^A-Za-z]', '', 'g')) then 'georgian' else 'latin' end end"
SQL = {
    "match_titles": f"with {_ROWS}, p as (select x.id as l, y.id as r, {_SIM} as sim from r x join r y on x.o = y.o and x.id < y.id where x.t is not null and y.t is not null) select cast(floor(sim * 20) as bigint) as twentieth, count(*) as n_pairs, cast(sum(l) as bigint) as lefts, cast(sum(r) as bigint) as rights from p where sim >= 0.45 group by 1",
    "match_jobs": f"with {_JOBS} select l, r, decision, cast(confidence as double) as confidence from j where decision <> 'distinct'",
    "match_held": f"""with {_JOBS}, c as (select l as k, rs as o from j where decision = 'confirmed_same' union all select r, ls from j where decision = 'confirmed_same'), m as (select k, o from c group by 1, 2 having count(*) > 1),
        h as (select j.*, decision = 'confirmed_same' and ((l, rs) in (select (k, o) from m) or (r, ls) in (select (k, o) from m)) as hold from j where decision <> 'distinct')
        select case when hold then 'needs_review' else decision end as decision, cast(case when hold then 0.6 else confidence end as double) as confidence, count(*) as n_pairs, cast(sum(l) as bigint) as lefts, cast(sum(r) as bigint) as rights from h group by 1, 2""",
    "match_tenders": f"""with {_ROWS}, u as (select id, s as src, {_BUYER.format(k="o")} as b, title, {_SUBJECT.format(c="title")} as s, cast(d + interval 4 hours as date) as dd, cast(p + interval 4 hours as date) as pd from r where opp_type = 'tender'),
        t as (select * replace (case when s is null then [] else {_GRAMS.format(c="s")} end as g) from (select *, {_SCRIPT.format(c="s")} as k, [] as g, list_distinct(list_transform(regexp_extract_all(title, '№\\s*[\\p{{L}}\\p{{N}}/-]+|\\b[A-Za-z]{{1,5}}\\d{{3,}}(?:[/-]\\d+)*|\\b\\d{{5,}}\\b'), lambda z: lower(regexp_replace(z, '\\s+', '', 'g')))) as c from u)),
        p as (select x.id as l, y.id as r, coalesce({_SIM}, 0) as sim, len(list_intersect(x.g, y.g)) / least(len(x.g), len(y.g)) as con, least(len(string_split(x.s, ' ')), len(string_split(y.s, ' '))) as w, coalesce(x.k <> y.k, false) as crossed, len(x.c) > 0 and len(y.c) > 0 as coded, len(list_intersect(x.c, y.c)) > 0 as same, abs(x.dd - y.dd) as dg, abs(x.pd - y.pd) as pg
          from t x join t y on x.id < y.id and x.src <> y.src and (x.b = y.b or ((x.b || ' ' like y.b || ' %' or y.b || ' ' like x.b || ' %') and split_part(x.b, ' ', 1) not in {_GENERIC}))),
        q as (select *, case when w >= 2 then greatest(sim, con) else sim end as a from p where not (coded and not same)),
        z as (select l, r, case when dg = 0 and pg <= 7 and (same or (not crossed and a >= 0.5)) then 'confirmed_same' when (coalesce(dg <= 3, false) or coalesce(pg <= 3, false)) and (a >= 0.3 or crossed or same) then 'needs_review' else 'distinct' end as decision, coalesce(dg = 0, false) as one from q)
        select l, r, decision, cast(case when decision = 'confirmed_same' then 0.95 when one then 0.65 else 0.55 end as double) as confidence from z where decision <> 'distinct'""",
    "match_buyers": f"with k as (select {_BUYER.format(k=_ORG.format(c='organization'))} as buyer, organization from index_rows) select buyer, case when split_part(buyer, ' ', 1) not in {_GENERIC} then split_part(buyer, ' ', 1) end as head, count(distinct organization) as n_names, count(*) as n_rows from k where buyer is not null group by 1, 2",
    "match_subjects": f"with k as (select {_SUBJECT.format(c='title')} as subject from index_rows) select subject, {_SCRIPT.format(c='subject')} as script, count(*) as n_rows from k group by 1, 2",
    "match_standing": _STANDING,
    "match_recheck": f"with {_ROWS}, s as ({_STANDING}) select s.left, s.right, round({_SIM}, 6) as similarity from s join r x on s.left = x.id join r y on s.right = y.id where decision = 'confirmed_same' and x.t is not null and y.t is not null and round({_SIM}, 6) < 0.45",
    "match_singletons": f"with s as ({_STANDING}), l as (select \"left\" as i from s where decision = 'confirmed_same' union select \"right\" from s where decision = 'confirmed_same') select distinct source_listing_id, source_listing_id as group_id from index_rows where source_listing_id not in (select i from l)",
    "match_canonical": """with m as (select distinct on (opportunity_id, source_listing_id) * from index_rows where opportunity_id is not null),
        c as (select opportunity_id, min(case status when 'active' then 0 when 'missing_suspected' then 1 when 'discovered' then 2 when 'expired' then 3 when 'closed' then 4 when 'quarantined' then 5 end) as k, arg_min(title, source_listing_id) filter (title is not null) as title, arg_min(organization, source_listing_id) filter (organization is not null) as organization, arg_min(epoch_us(deadline_at), source_listing_id) filter (deadline_at is not null) as deadline_us,
          concat_ws(',', case when count(distinct title) > 1 then 'title' end, case when count(distinct organization) > 1 then 'organization' end, case when count(distinct deadline_at) > 1 then 'deadline_us' end) as conflicts, count(*) as n_members from m group by 1),
        s as (select *, coalesce(['active', 'missing_suspected', 'discovered', 'expired', 'closed', 'quarantined'][k + 1], 'closed') as status from c)
        select opportunity_id, status, title, organization, deadline_us, conflicts, n_members, sha256(status || '|' || coalesce(title, '<none>') || '|' || coalesce(organization, '<none>') || '|' || coalesce(cast(deadline_us as varchar), '<none>')) as digest from s""",
}
