"""Decisions on pairs of records: candidates by prefix filter, rules for jobs and tenders, held and standing decisions, what stands for a group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import containment, jaccard
from skein.session import cut

#: Listings that a value may be carried by and still be one vacancy's; similarities of titles that agree and that disagree; days of a bounded window.
VACANCY_LEVEL, STRONG, WEAK, WINDOW_DAYS = 2, 0.82, 0.45, 21
#: Agreement of subjects for a decision and for a review; days between publications and between dates for either.
SUBJECT_STRONG, SUBJECT_WEAK, PUBLISHED_DAYS, REVIEW_DAYS = 0.5, 0.3, 7, 3


def similar_pairs(rows: DataFrame, key: str, block: str, grams: str, share: float) -> DataFrame:
    """(l, r, similarity): all pairs l < r of a block whose sets `grams` have at least `share` of their union in common.

    Prefix filter: with the members of each set in one order, rarest first, two such sets
    share one of their first n - ceil(share * n) + 1. Rows meet by block and rare member, never as a
    whole block, so an employer of any size loses no pair and needs no cap. Null blocks and empty sets pair with nothing.
    Catalyst takes sets for far smaller than they are, so all joins are told to sort and merge: none is sent to the driver.
    """
    base = rows.where(F.col(block).isNotNull()).select(F.col(key).alias("_k"), F.col(block).alias("_b"), F.explode(F.array_distinct(grams)).alias("_t"))
    often = cut(base.groupBy("_t").agg(F.count("*").alias("_n")).withColumn("_i", F.monotonically_increasing_id()))
    ranked = base.join(often.hint("merge"), base["_t"].eqNullSafe(often["_t"])).groupBy("_k", "_b").agg(F.sort_array(F.collect_list(F.struct("_n", "_i")))["_i"].alias("_s"))
    n = F.size("_s")
    first = ranked.select("_k", "_b", n.alias("_z"), F.posexplode(F.slice("_s", 1, n - F.ceil(n * F.lit(share) - 1e-9).cast("int") + 1)).alias("_p", "_i"))
    reach = f"least(l._z - l._p, r._z - r._p) >= {share} / (1 + {share}) * (l._z + r._z) - 1e-9"
    met = first.alias("l").join(first.alias("r").hint("merge"), F.expr(f"l._b = r._b and l._i = r._i and l._k < r._k and least(l._z, r._z) >= {share} * greatest(l._z, r._z) - 1e-9 and {reach}"))
    ids = met.select(F.col("l._k").alias("l"), F.col("r._k").alias("r")).distinct()
    side = lambda p: ranked.select(F.col("_k").alias(p), F.col("_s").alias(f"_g{p}")).hint("merge")
    similarity = F.transform(F.array(F.size(F.array_intersect("_gl", "_gr"))), lambda x: x / (F.size("_gl") + F.size("_gr") - x))[0]
    return ids.join(side("l"), "l").join(side("r"), "r").select("l", "r", similarity.alias("similarity")).where(F.col("similarity") >= share)


def of_members(pairs: DataFrame, members: DataFrame, group: str, key: str) -> DataFrame:
    """(l, r, similarity): `pairs` (l, r, similarity) of groups as pairs of structs `l` and `r` of their `members`, the smaller `key` left.

    `group` names a member's group. A group paired with itself gives each pair of its members once.
    """
    side = lambda p: members.select(F.col(group).alias(f"_{p}"), F.struct(*(c for c in members.columns if c != group)).alias(f"_m{p}")).hint("merge")
    met = pairs.join(side("l"), F.col("l") == F.col("_l")).join(side("r"), F.col("r") == F.col("_r")).where(F.expr(f"_l <> _r or _ml.{key} < _mr.{key}"))
    first = F.expr(f"_ml.{key} < _mr.{key}")
    return met.select(F.when(first, F.col("_ml")).otherwise(F.col("_mr")).alias("l"), F.when(first, F.col("_mr")).otherwise(F.col("_ml")).alias("r"), "similarity")


def job_decision(same_source: Column, similarity: Column, shared: Column, carried_by: Column, same_organization: Column, dates_near: Column) -> Column:
    """(decision, confidence) of two vacancies; null facts count as false.

    One source's listings are distinct. A value carried by few listings is a vacancy's own:
    with agreeing titles it confirms, with partly agreeing ones it makes the pair probable, with disagreeing ones
    it contradicts and wants a review. An equal organisation and agreeing titles want one too, the more so with near dates.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    own = yes(shared) & (F.coalesce(carried_by, F.lit(VACANCY_LEVEL + 1)) <= VACANCY_LEVEL)
    out = lambda d, c: F.struct(F.lit(d).alias("decision"), (c if isinstance(c, Column) else F.lit(float(c))).alias("confidence"))
    weak, strong = similarity < WEAK, similarity >= STRONG
    return (
        F.when(yes(same_source), out("distinct", 0)).when(weak & own, out("needs_review", 0.5)).when(weak, out("distinct", 0)).when(own & strong, out("confirmed_same", 0.97)).when(own, out("probable_same", 0.75))
        .when(yes(same_organization) & strong, out("needs_review", F.when(yes(dates_near), 0.65).otherwise(0.55))).otherwise(out("distinct", 0))
    )


def tender_decision(same_source: Column, same_buyer: Column, subjects: tuple[Column, Column], grams: tuple[Column, Column], scripts: tuple[Column, Column], codes: tuple[Column, Column], deadline_gap: Column, published_gap: Column) -> Column:
    """(decision, confidence) of two tenders of one buyer, by their subjects, reference codes and days apart.

    Containment counts from two words up. Both codes known and none shared: distinct. On one
    deadline day, published within a week, an equal code or agreeing subjects of one script confirm; dates within
    three days and plausible subjects want a review.
    """
    (sa, sb), (ga, gb), (ta, tb), (ca, cb) = subjects, grams, scripts, codes
    told = sa.isNotNull() & sb.isNotNull()
    similar = F.when(told, jaccard(ga, gb)).otherwise(0.0)
    two = F.least(F.size(F.split(sa, " ")), F.size(F.split(sb, " "))) >= 2
    agreement = F.when(told & two, F.greatest(similar, containment(ga, gb))).otherwise(similar)
    crossed = F.coalesce(ta != tb, F.lit(False))
    both_coded = (F.size(ca) > 0) & (F.size(cb) > 0)
    equal_code = both_coded & F.arrays_overlap(ca, cb)
    yes = lambda c: F.coalesce(c, F.lit(False))
    out = lambda d, c: F.struct(F.lit(d).alias("decision"), (c if isinstance(c, Column) else F.lit(float(c))).alias("confidence"))
    one_day = yes(deadline_gap == 0)
    sure = one_day & yes(published_gap <= PUBLISHED_DAYS) & (equal_code | (~crossed & (agreement >= SUBJECT_STRONG)))
    near = yes(deadline_gap <= REVIEW_DAYS) | yes(published_gap <= REVIEW_DAYS)
    plausible = (agreement >= SUBJECT_WEAK) | crossed | equal_code
    apart = yes(same_source) | ~yes(same_buyer) | (both_coded & ~equal_code)
    return F.when(apart, out("distinct", 0)).when(sure, out("confirmed_same", 0.95)).when(near & plausible, out("needs_review", F.when(one_day, 0.65).otherwise(0.55))).otherwise(out("distinct", 0))


def held(pairs: DataFrame, left: str, right: str, left_source: str, right_source: str) -> DataFrame:
    """`pairs` of which a confirmed one with a side that has other confirmed partners on the other's source is held for review (0.6)."""
    sure = pairs.where("decision = 'confirmed_same'")
    ends = sure.select(F.col(left).alias("_k"), F.col(right_source).alias("_o")).unionByName(sure.select(F.col(right).alias("_k"), F.col(left_source).alias("_o")))
    many = ends.groupBy("_k", "_o").agg(F.count("*").alias("_n")).where("_n > 1").select("_k", "_o")
    side = lambda k, o, n: many.select(F.col("_k").alias(k), F.col("_o").alias(o), F.lit(True).alias(n)).hint("merge")
    told = pairs.join(side(left, right_source, "_l"), [left, right_source], "left").join(side(right, left_source, "_r"), [right, left_source], "left")
    hold = (F.col("decision") == "confirmed_same") & (F.col("_l").isNotNull() | F.col("_r").isNotNull())
    return told.withColumn("confidence", F.when(hold, 0.6).otherwise(F.col("confidence"))).withColumn("decision", F.when(hold, "needs_review").otherwise(F.col("decision"))).select(*pairs.columns)


def standing(pairs: DataFrame, left: str, right: str, decision: str, by_human: Column, at: str, tie: str, gone: Column) -> DataFrame:
    """(left, right, decision): the one decision that stands for each unordered pair of different records.

    A human one before any other, then the latest, then the largest `tie`; decisions that are `gone` don't count.
    One combining aggregation: repeated and reversed pairs are no hot key.
    """
    ends = pairs.where((F.col(left) != F.col(right)) & ~F.coalesce(gone, F.lit(False))).select(F.least(left, right).alias("left"), F.greatest(left, right).alias("right"), F.struct(F.coalesce(by_human, F.lit(False)).alias("h"), F.col(at).alias("a"), F.col(tie).alias("t"), F.col(decision).alias("d")).alias("x"))
    return ends.groupBy("left", "right").agg(F.max("x").alias("x")).select("left", "right", F.col("x.d").alias("decision"))


def canonical(members: DataFrame, group: str, key: str, status: str, precedence: Sequence[str], scalars: Mapping[str, Column]) -> DataFrame:
    """(`group`, status, `scalars`, conflicts, n_members, digest): what stands for a group of members.

    The status is the first of `precedence` that a member has, else closed; a scalar is that of the smallest key that states it; conflicts names the
    scalars of which members state different values. The digest is of what stands, so that an unchanged record makes no new revision.
    One combining aggregation; a hot group is no hot task.
    """
    rank = F.coalesce(*(F.when(F.col(status) == s, F.lit(i)) for i, s in enumerate(precedence)))
    base = members.where(F.col(group).isNotNull()).select(F.col(group).alias("_g"), F.col(key).alias("_k"), rank.alias("_r"), *(c.alias(f"_v{i}") for i, c in enumerate(scalars.values())))
    told = [x for i in range(len(scalars)) for x in (F.min(F.when(F.col(f"_v{i}").isNotNull(), F.struct("_k", f"_v{i}"))).alias(f"_f{i}"), F.min(f"_v{i}").alias(f"_a{i}"), F.max(f"_v{i}").alias(f"_z{i}"))]
    best = base.groupBy("_g").agg(F.min("_r").alias("_r"), F.count("*").alias("n_members"), *told)
    state = F.coalesce(F.get(F.array(*map(F.lit, precedence)), F.col("_r")), F.lit("closed"))
    values = [F.col(f"_f{i}._v{i}") for i in range(len(scalars))]
    differ = F.array_compact(F.array(*(F.when(F.col(f"_a{i}") < F.col(f"_z{i}"), F.lit(n)) for i, n in enumerate(scalars))))
    digest = F.sha2(F.concat_ws("|", state, *(F.coalesce(v.cast("string"), F.lit("<none>")) for v in values)), 256)
    return best.select(F.col("_g").alias(group), state.alias("status"), *(v.alias(n) for v, n in zip(values, scalars, strict=True)), F.array_join(differ, ",").alias("conflicts"), "n_members", digest.alias("digest"))


def in_spans(rows: DataFrame, at: str, days: int) -> DataFrame:
    """`rows` with span, once for each of the two spans of `days` in which rows near in `at` meet; null times in none."""
    first = F.floor(F.col(at) / days)
    return rows.where(F.col(at).isNotNull()).withColumn("span", F.explode(F.array(first, first + 1)))


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """`rows` with place, from 1 within `by`; Spark's group limit cuts hot groups in each task where places are filtered."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
