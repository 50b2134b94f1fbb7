from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from skein.llm.groups import connected, groups_of, local_roots, scramble, unscramble


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in parent}


@given(st.lists(st.integers(-(2**63), 2**63 - 1)))
def test_scramble_is_one_to_one(ids):
    x = np.array(ids, np.int64)
    assert (unscramble(scramble(x)) == x).all()


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1))
def test_local_union_find(edges):
    v, r = local_roots(np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    want = brute([*edges])
    assert all(want.get(int(a), int(a)) == int(b) for a, b in zip(v, r, strict=True))


@pytest.mark.parametrize("edges_per_block", [3, 40, 500_000])
def test_connected(spark, edges_per_block):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    edges = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in edges] + [(7, 7), (None, 3), (1, 2), (1, 2), (999, 999)]
    rng.shuffle(edges)
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in edges], "l long, r long, a string, v int")
    got = {r["v"]: r["label"] for r in connected(df, "l", "r", edges_per_block).collect()}
    want = brute(edges)
    assert set(got) == set(want)
    labels = {}
    for x, root in want.items():
        labels.setdefault(root, set()).add(got[x])
    assert all(len(s) == 1 for s in labels.values()) and len({next(iter(s)) for s in labels.values()}) == len(labels)


def test_groups_of(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (9, 9), (None, 4), (20, 21)], "a long, b long")
    rows = spark.createDataFrame([(3, 7), (5, 7), (6, None), (None, 7), (8, 3), (11, 5), (11, 5)], "m long, o long")
    got = sorted(map(tuple, groups_of(pairs, "a", "b", rows, "m", "o").collect()))
    assert got == [(1, 1), (2, 1), (3, 1), (5, 1), (20, 20), (21, 20)]


def test_empty(spark):
    pairs, rows = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "m long, o long")
    assert connected(pairs, "a", "b").count() == 0
    assert groups_of(pairs, "a", "b", rows, "m", "o").count() == 0


def test_groups_of_keeps_large_ids(spark):
    big = 2**53 + 1, 2**60 + 3, 2**62 - 1, -(2**61) - 1
    pairs = spark.createDataFrame([(big[0], big[1]), (big[2], big[3])], "a long, b long")
    rows = spark.createDataFrame([(big[0], 5), (2**53 + 3, 5)], "m long, o long")
    got = sorted(map(tuple, groups_of(pairs, "a", "b", rows, "m", "o").collect()))
    assert got == sorted([(big[0], big[0]), (big[1], big[0]), (2**53 + 3, big[0]), (big[2], big[3]), (big[3], big[3])])
