"""Entity resolution by blocks: candidate pairs, ambiguity, order-dependent clustering, carried keys, folding."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_pairs(rows: DataFrame, key: str, block: str, keep: Sequence[str], least: int = 2, most: int | None = None) -> DataFrame:
    """Pairs (smaller key first) of rows with an equal block, for blocks of at least `least` and, if given, at most `most` rows.

    With `most` a larger block identifies nothing and is left out before the join; without it no pair is lost, and blocks must be small by
    nature: for large ones `matching.similar_pairs` meets rows by rare members instead. Null blocks pair with nothing. Columns come as l_ and r_.
    """
    known = rows.where(F.col(block).isNotNull())
    fits = F.col("_n") >= least if most is None else F.col("_n").between(least, most)
    sizes = known.groupBy(block).agg(F.count("*").alias("_n")).where(fits).select(block)
    fit = known.join(sizes, block, "left_semi").select(block, key, *keep)
    side = lambda p: fit.select(F.col(block).alias(f"{p}b"), *(F.col(c).alias(f"{p}_{c}") for c in (key, *keep)))
    return side("l").join(side("r"), (F.col("lb") == F.col("rb")) & (F.col(f"l_{key}") < F.col(f"r_{key}"))).drop("lb", "rb")


def ambiguous(pairs: DataFrame, left: str, right: str, left_source: str, right_source: str) -> DataFrame:
    """`pairs` with is_ambiguous: a side has more than one partner on the other's source."""
    a = Window.partitionBy(left, right_source)
    b = Window.partitionBy(right, left_source)
    return pairs.withColumn("is_ambiguous", (F.count("*").over(a) > 1) | (F.count("*").over(b) > 1))


def leader_clusters(rows: DataFrame, key: str, block: Sequence[str], order: Sequence[str], near: dict[str, tuple[str, float]]) -> DataFrame:
    """(`key`, leader): rows of a block in order join the first group whose leader is near, else lead a new one.

    `near` gives for a column ("absolute" or "relative", most): its distance to the leader's
    value. A null is near nothing. Within a block rows are taken by `order`, ties by key. A
    block is streamed batch by batch, never held as one; where the first of `order` has a distance, leaders that
    lie further back than it reaches are dropped, as no later row can join them, so the state is what lies within reach.
    """
    cols = list(near)
    kind = rows.schema[key].dataType.simpleString()
    tests = [(i, how == "absolute", most) for i, (how, most) in enumerate(near.values())]
    front = cols.index(order[0]) if order and order[0] in cols else None
    reach = lambda i, theirs: tests[i][2] if tests[i][1] else tests[i][2] * abs(theirs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, leaders = None, deque()
        for pdf in batches:
            out, keys = [], pdf["k"].tolist()
            for block, who, own in zip(pdf["_b"].tolist(), keys, zip(*(pdf[c].tolist() for c in cols), strict=True), strict=True):
                if block != at:
                    at, leaders = block, deque()
                found = who
                if all(x == x for x in own):
                    while front is not None and leaders and own[front] - leaders[0][1][front] > reach(front, leaders[0][1][front]):
                        leaders.popleft()
                    for leader, theirs in leaders:
                        if all(abs(own[i] - theirs[i]) <= (most if absolute else most * abs(theirs[i])) for i, absolute, most in tests):
                            found = leader
                            break
                    else:
                        leaders.append((who, own))
                out.append(found)
            yield pd.DataFrame({"k": pdf["k"], "leader": pd.Series(out, dtype=pdf["k"].dtype)})

    blocked = rows.withColumn("_b", F.xxhash64(*block)).repartition("_b").sortWithinPartitions("_b", *(F.col(c).asc_nulls_last() for c in order), key)
    return blocked.select("_b", F.col(key).alias("k"), *(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in cols)).mapInPandas(run, f"k {kind}, leader {kind}").withColumnRenamed("k", key)


def carried_keys(groups: DataFrame, member: str, new: str, old: str) -> DataFrame:
    """(`new`, carried): the previous key each new group keeps.

    A group claims the previous key most of its members held, ties to the smaller key; a
    key goes to the claimant with most such members, ties to the smaller group. Groups
    without a claim, or outbid, have null and take a new key.
    """
    held = groups.where(F.col(old).isNotNull()).groupBy(new, old).agg(F.count(member).alias("n"))
    claim = held.groupBy(new).agg(F.max_by(F.struct(old, "n"), F.struct("n", (-F.col(old)).alias("o"))).alias("c")).select(new, F.col(f"c.{old}").alias("_k"), F.col("c.n").alias("_n"))
    won = claim.groupBy("_k").agg(F.max_by(new, F.struct("_n", -F.col(new))).alias("_w"))
    winners = won.select(F.col("_w").alias(new), F.col("_k").alias("carried"))
    return groups.select(new).distinct().join(winners, new, "left")


def first_stated(rows: DataFrame, group: str, order: str, scalars: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """One row a group: of each scalar the first value in `order` that isn't null, of each list column the ordered union.

    The lists' union keeps first occurrences in the order of rows and elements.
    """
    firsts: list[Column] = [F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in scalars]
    unions = [F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))), lambda s: s["v"]))).alias(c) for c in lists]
    return rows.groupBy(group).agg(*firsts, *unions)
