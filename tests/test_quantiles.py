"""Quantiles from counts against numpy: hot groups, null groups, repeats, empty tables."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators.fixpoint import removable
from skein.operators.quantiles import medians, quantiles
from skein.operators.ranking import similar

P = [0.0, 0.02, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("n", [1, 2, 7, 900])
def test_quantiles(spark, n):
    rng = random.Random(n)
    data = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([1.5, 2.0, 7.25, float(rng.randrange(50)), None]), rng.randrange(0, 4), "x") for _ in range(n)]
    df = spark.createDataFrame(data, "g string, v double, c int, _v string").repartition(5)
    got = {r["g"]: (r["n"], r["q"]) for r in quantiles(df, ["g"], "v", "c", P).collect()}
    want = {}
    for g in {x[0] for x in data}:
        values = [v for h, v, c, _ in data if h == g and v is not None for _ in range(c)]
        if values:
            want[g] = (len(values), np.quantile(values, P).tolist())
    assert set(got) == set(want)
    for g in want:
        assert got[g][0] == want[g][0] and got[g][1] == pytest.approx(want[g][1])
    assert quantiles(df.limit(0), ["g"], "v", "c", P).count() == 0


def test_medians(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (1, 3.0, None), (1, 8.0, 6.0), (2, None, None)], "k int, a double, b double")
    assert sorted(map(tuple, medians(df, ["k"], ["a", "b"]).collect())) == [(1, 3.0, 5.5)]


@pytest.mark.parametrize("seed", range(3))
def test_removable_against_brute_force(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)] + [(i, i) for i in range(50, 60)] + [(i + 1, i) for i in range(50, 60)]
    a, b = {x for x in range(70) if rng.random() < 0.9 and x != 60}, {x for x in range(70) if rng.random() < 0.9}
    one = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} int")
    left, right = removable(spark.createDataFrame(links, "l int, r int"), "l", "r", one(a, "l"), one(b, "r"))
    got = {r[0] for r in left.collect()}, {r[0] for r in right.collect()}
    while True:
        x = {v for v in a if all(r in b for l, r in links if l == v)}
        y = {v for v in b if all(l in x for l, r in links if r == v)}
        if (x, y) == (a, b):
            break
        a, b = x, y
    assert got == (a, b)


@pytest.mark.parametrize("block", [1, 7, 2_000])
def test_similar_against_brute_force(spark, block):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (80, 4)).astype(float)  # many ties, some zeros
    rows = spark.createDataFrame([(i, v[i].tolist(), "x") for i in range(80)] + [(900, None, "x")], "k long, v array<double>, _k string").repartition(6)
    asked = rows.where(F.col("k") % 5 == 0)
    got = sorted((r["q"], r["rank"], r["k"]) for r in similar(asked.withColumnRenamed("k", "q"), rows, "q", "k", "v", 0.5, 6, block).collect())
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    u = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
    want = []
    for q in range(0, 80, 5):
        ranked = sorted((-round(float(u[q] @ u[k]), 9) + 0.0, k) for k in range(80) if k != q)[:6]
        want += [(q, i + 1, k) for i, (s, k) in enumerate(ranked) if -s >= 0.5 * -ranked[0][0]]
    assert got == sorted(want)
    assert similar(asked.limit(0).withColumnRenamed("k", "q"), rows, "q", "k", "v", 0.5, 6).count() == 0
