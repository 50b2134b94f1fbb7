"""Linking under a constraint, differences of whole tables, and helpers of runs."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def linked_once_a_source(edges: DataFrame, members: DataFrame, component: str, left: str, right: str, key: str, source: str, strength: str) -> DataFrame:
    """(`key`, cluster): greedy union of a component's members along its edges, strongest first, never two of one source.

    `members` and `edges` carry their `component`. Only components in which a source comes
    twice depend on the order; the others are one cluster by one aggregation. An edge between
    clusters that share a source is left out. Ties in `strength` go to the smaller left, then right
    key; a cluster is named after its smallest member.
    """
    per = members.groupBy(component, source).agg(F.count("*").alias("n")).groupBy(component).agg((F.max("n") > 1).alias("_hard"))
    plain = members.join(per.where("not _hard"), component, "left_semi")
    names = plain.groupBy(component).agg(F.min(key).alias("cluster"))
    easy = plain.join(names, component).select(key, "cluster")
    hard = per.where("_hard").select(component)
    kind, skind = members.schema[key].dataType.simpleString(), members.schema[source].dataType.simpleString()

    def solve(nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        root = {k: k for k in nodes["k"]}
        held = {k: {s} for k, s in zip(nodes["k"], nodes["s"], strict=True)}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in links.sort_values(["w", "l", "r"], ascending=[False, True, True])[["l", "r"]].itertuples(index=False):
            if a in root and b in root:
                a, b = find(a), find(b)
                if a != b and not held[a] & held[b]:
                    low, high = min(a, b), max(a, b)
                    root[high] = low
                    held[low] |= held.pop(high)
        return pd.DataFrame({"k": list(root), "cluster": [find(k) for k in root]})

    n = members.join(hard, component, "left_semi").select(F.col(component).alias("c"), F.col(key).alias("k"), F.col(source).cast(skind).alias("s"))
    e = edges.join(hard, component, "left_semi").select(F.col(component).alias("c"), F.least(left, right).alias("l"), F.greatest(left, right).alias("r"), F.col(strength).cast("double").alias("w"))
    solved = n.groupBy("c").cogroup(e.groupBy("c")).applyInPandas(solve, f"k {kind}, cluster {kind}")
    return easy.unionByName(solved.withColumnRenamed("k", key))


def outcomes(current: DataFrame, incoming: DataFrame, key: str, content: Sequence[str], touched: str, open_: str, prices: Sequence[str] = ()) -> DataFrame:
    """(`key`, outcome, price_changed) of an incoming set against the current one, by one full outer join.

    new: not there before; reopened: there but not open; changed: other `content`; bumped:
    same content, later `touched`; unchanged; missing: only there before and open; gone: only
    there and not open. Nulls are values. Keys must be unique on both sides.
    """
    fields = [*dict.fromkeys([*content, *prices])]
    a = current.select(F.col(key).alias("_k"), F.col(open_).alias("_open"), F.col(touched).alias("_ta"), F.struct(*fields).alias("_a"))
    b = incoming.select(F.col(key).alias("_j"), F.col(touched).alias("_tb"), F.struct(*fields).alias("_b"))
    both = a.join(b, F.col("_k") == F.col("_j"), "full_outer")
    same = lambda cols: F.forall(F.array(*(F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")) for c in cols)), lambda x: x) if cols else F.lit(True)
    was_open = F.coalesce(F.col("_open"), F.lit(False))
    outcome = (
        F.when(F.col("_k").isNull(), "new").when(F.col("_j").isNull(), F.when(was_open, "missing").otherwise("gone")).when(~was_open, "reopened").when(~same(content), "changed").when(F.col("_tb") > F.col("_ta"), "bumped").otherwise("unchanged")
    )
    moved = F.col("_k").isNotNull() & F.col("_j").isNotNull() & ~same(prices)
    return both.select(F.coalesce("_k", "_j").alias(key), outcome.alias("outcome"), F.coalesce(moved, F.lit(False)).alias("price_changed"))


def sampled(rows: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """A repeatable sample of about `share` of the keys: a row is in or out by a digest of its key and the seed."""
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000))
    return rows.where(draw < int(share * 1_000_000))


def packed(sizes: dict[str, int], capacity: int) -> list[list[str]]:
    """Names packed into bins of at most `capacity`, largest first into the first bin with room; one that is too large stands alone."""
    bins: list[tuple[int, list[str]]] = []
    for name, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        for i, (used, held) in enumerate(bins):
            if used + n <= capacity:
                bins[i] = (used + n, [*held, name])
                break
        else:
            bins.append((n, [name]))
    return [held for _, held in bins]


def flattened(tree: DataFrame, node: str, parent: str, label: str, depth: int = 12) -> DataFrame:
    """(`node`, path, level): each node's labels from its root, for trees of up to `depth` levels; nodes on a cycle or under a missing parent have no row.

    One self join a level over the few nodes of a tree; stops as soon as a level is empty.
    """
    nodes = tree.select(F.col(node).alias("_n"), F.col(parent).alias("_p"), F.col(label).cast("string").alias("_l"))
    level = nodes.where("_p is null").select("_n", F.array("_l").alias("path"), F.lit(0).alias("level"))
    out = level
    for i in range(1, depth):
        up = level.select(F.col("_n").alias("_p"), "path")
        level = nodes.join(up, "_p").select("_n", F.concat("path", F.array("_l")).alias("path"), F.lit(i).alias("level"))
        out = out.unionByName(level)
        if level.isEmpty():
            break
    return out.select(F.col("_n").alias(node), F.array_join("path", " / ").alias("path"), "level")


def refetch(known: DataFrame, seen: DataFrame, key: str, digest: str) -> DataFrame:
    """(`key`, action): fetch what is new or has another digest, adopt what had none, skip the rest; drop what isn't seen."""
    a = known.select(F.col(key).alias("_k"), F.col(digest).alias("_a"))
    b = seen.select(F.col(key).alias("_j"), F.col(digest).alias("_b"))
    action = F.when(F.col("_j").isNull(), "drop").when(F.col("_k").isNull(), "fetch").when(F.col("_a").isNull(), "adopt").when(F.col("_a") == F.col("_b"), "skip").otherwise("fetch")
    return a.join(b, F.col("_k") == F.col("_j"), "full_outer").select(F.coalesce("_k", "_j").alias(key), action.alias("action"))


def latest_complete(rates: DataFrame, day: str, currency: str, wanted: Sequence[str], today: str) -> DataFrame:
    """The rates of the latest day up to `today` that has every wanted currency."""
    full = rates.where(F.col(currency).isin(list(wanted)) & (F.col(day) <= F.lit(today).cast("date"))).groupBy(day).agg(F.count_distinct(currency).alias("n")).where(F.col("n") == len(wanted)).agg(F.max(day).alias("_d"))
    return rates.join(F.broadcast(full), F.col(day) == F.col("_d")).where(F.col(currency).isin(list(wanted))).drop("_d")


def ordered_top(rows: DataFrame, by: Sequence[str], order: Sequence, most: int) -> DataFrame:
    """The first `most` rows of each group in a total order, with their place; Spark's group limit cuts a hot group down in each task before it is exchanged."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= most)
