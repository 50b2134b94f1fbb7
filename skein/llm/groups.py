"""Groups of records linked by pairwise matches, directly or indirectly.

Method: a two-dimensional grid. Vertices are hashed into blocks, each block-pair's edges
are solved by a local union-find, and every vertex then exchanges the representatives it
got in its row's and column's partitions: it takes the smallest, and its other
representatives are linked to that one in the next round. Rounds go on until no vertex
has two representatives. The grid follows the measured number of edges; a local
union-find takes its partition in chunks, so that a vertex with a third of all edges
never has to fit in one task (solving a partition in chunks only leaves more to exchange).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import cut

#: Edges of a block pair that a task should hold, and the most it takes in one piece.
EDGES_PER_BLOCK = 500_000
CHUNK = 2_000_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _inverse(m: np.uint64) -> np.uint64:
    return np.uint64(pow(int(m), -1, 2**64))


def scramble(ids: np.ndarray) -> np.ndarray:
    """A fixed one-to-one mapping of 64-bit numbers, so that the order of labels says nothing about the graph."""
    x = ids.astype(np.int64).view(np.uint64).copy()
    for shift, m in ((30, _M1), (27, _M2)):
        x ^= x >> np.uint64(shift)
        x *= m
    x ^= x >> np.uint64(31)
    return x.view(np.int64)


def unscramble(ids: np.ndarray) -> np.ndarray:
    """The inverse of `scramble`."""
    x = ids.astype(np.int64).view(np.uint64).copy()

    def unshift(v: np.ndarray, s: int) -> np.ndarray:
        out, k = v.copy(), s
        while k < 64:
            out = v ^ (out >> np.uint64(s))
            k += s
        return out

    x = unshift(x, 31)
    for shift, m in ((27, _M2), (30, _M1)):
        x *= _inverse(m)
        x = unshift(x, shift)
    return x.view(np.int64)


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over the edges (a, b): each vertex and the smallest vertex of its part."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    parent = np.arange(len(ids))
    while len(u):
        low, high = np.minimum(parent[u], parent[v]), np.maximum(parent[u], parent[v])
        np.minimum.at(parent, high, low)
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        open_ = parent[u] != parent[v]
        u, v = u[open_], v[open_]
    return ids, ids[parent]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def flush() -> pa.RecordBatch:
        v, r = local_roots(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        return pa.RecordBatch.from_arrays([pa.array(v), pa.array(r)], names=["v", "r"])

    for batch in batches:
        held.append((batch.column("a").to_numpy(zero_copy_only=False), batch.column("b").to_numpy(zero_copy_only=False)))
        n += batch.num_rows
        if n >= CHUNK:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()


def _mapped(f, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [pa.array(f(batch.column(c).to_numpy(zero_copy_only=False))) if c in names else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return run


def connected(edges: DataFrame, left: str, right: str, edges_per_block: int = EDGES_PER_BLOCK) -> DataFrame:
    """(v, label): every vertex of an edge with one label for all it is linked to, directly or indirectly.

    `left` and `right` are BIGINT vertex ids. Null ends, self pairs, repeated and reversed
    pairs change nothing; a vertex without a link to another has no row; no edges give no rows. The label
    is an arbitrary member's id, the same for equal edges in any order. Other columns are
    ignored. Needs the shared checkpoint folder: every round is written there, so a lost
    executor repeats a round at most.
    """
    ends = edges.select(F.col(left).cast("long").alias("x"), F.col(right).cast("long").alias("y")).where("x <> y")
    pairs = ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    todo = cut(pairs.mapInArrow(_mapped(scramble, ["a", "b"]), "a long, b long"))
    steps: list[DataFrame] = []
    while (n := todo.count()) > 0:
        side = max(1 if steps else 2, math.ceil(math.sqrt(2 * n / edges_per_block)))
        block = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(side))
        grid = todo.select("a", "b", F.least(block("a"), block("b")).alias("row"), F.greatest(block("a"), block("b")).alias("col"))
        parts = grid.repartition(side * (side + 1) // 2, "row", "col").select("a", "b").mapInArrow(_solve, "v long, r long")
        best = parts.groupBy("v").agg(F.min("r").alias("p"), F.collect_set("r").alias("rs"))
        solved = cut(best)
        steps.append(solved.select("v", "p"))
        todo = cut(solved.where(F.size("rs") > 1).select(F.col("p").alias("a"), F.explode("rs").alias("b")).where("a <> b").distinct())
    if not steps:
        return edges.sparkSession.createDataFrame([], "v long, label long")
    labels = steps.pop().withColumnRenamed("p", "label")
    while steps:
        step = steps.pop()
        up = labels.select(F.col("v").alias("_v"), F.col("label").alias("_l"))
        labels = step.join(up, step["p"] == up["_v"], "left").select("v", F.coalesce("_l", "p").alias("label"))
    return labels.mapInArrow(_mapped(unscramble, ["v", "label"]), "v long, label long")


def groups_of(pairs: DataFrame, left: str, right: str, rows: DataFrame, member: str, shared: str) -> DataFrame:
    """(`member`, group_id): members linked by a pair or by an equal non-null `shared` value of `rows`.

    One row for each member of a group of two or more; group_id is the group's smallest
    member. A shared value is a vertex of its own, so its holders are never paired with
    each other. Ids must lie within 2**62, else the query fails. Rows with a null member
    are ignored.
    """
    even = lambda c: F.col(c).cast("long") * 2
    links = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(even(left).alias("x"), even(right).alias("y"))
    holds = rows.where(F.col(member).isNotNull() & F.col(shared).isNotNull()).select(even(member).alias("x"), (even(shared) + 1).alias("y"))
    named = connected(links.unionByName(holds), "x", "y").where("v % 2 = 0").select(F.shiftright("v", 1).alias(member), "label")
    named = cut(named)
    sizes = named.groupBy("label").agg(F.min(member).alias("group_id"), F.count("*").alias("_n")).where("_n > 1")
    return named.join(sizes, "label").select(member, "group_id")
