"""Truth discovery with steep priors gives what the order of trust gives, and says whether it converged."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skein.llm.survivors import MAX_RANKS, steep, survivors, truth


def random_records(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        g = None if i % 97 == 0 else 0 if rng.random() < 0.33 else rng.randrange(1, 120)  # one group holds a third
        rows.append((g, i // 2 if i % 50 == 0 else i, rng.choice([1, 2, 2, 3, 4, None]), rng.choice([None, *range(6)]), rng.choice([None, "a", "b", "c"]), rng.choice([None, "x" * 50_000, "y"]), "clash"))
    return rows + rows[:20]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_order_of_trust(spark, seed):
    df = spark.createDataFrame(random_records(seed), "g long, id long, rank int, at int, f string, h string, _s string")
    known = df.withColumn("rank", F.coalesce("rank", F.lit(9)))
    fields = {"f": F.col("f"), "h": F.col("h")}
    many = df.groupBy("g").agg(F.count_distinct("id").alias("n")).where("n > 1").select("g")
    got = truth(known.join(many, "g", "left_semi"), "g", "rank", fields, record="id", latest=[-F.col("at")], prior=steep({r: r for r in (1, 2, 3, 4, 9)}))
    assert {r["converged"] for r in got.collect()} == {True}
    want = survivors(df, "g", "id", {n: c.isNotNull() for n, c in fields.items()}, [F.col("rank"), -F.col("at")])
    key = lambda d: sorted(map(tuple, d.select("g", "field_name", "id").collect()))
    assert key(got) == key(want)


def test_steep():
    assert steep({"a": 10, "b": 7, "c": 7}) == {"a": 0.25, "b": 1.0, "c": 1.0} and steep({}) == {}
    with pytest.raises(ValueError):
        steep({i: i for i in range(MAX_RANKS + 1)})


def test_one_round_is_not_convergence(spark):
    rows = [(g, s, v) for g in range(8) for s, v in (("good", f"v{g}"), ("also", f"v{g}"), ("bad", f"w{g}"))]
    df = spark.createDataFrame(rows, "g long, s string, v string")
    assert {r["converged"] for r in truth(df, "g", "s", {"f": F.col("v")}, rounds=1).collect()} == {False}
    assert {r["converged"] for r in truth(df, "g", "s", {"f": F.col("v")}).collect()} == {True}
