"""Ranking and classification: vectors, fused ranks, quality of rankings, weighted naive Bayes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import cut

#: Queries that are met with all rows at a time.
QUERY_BLOCK = 2_000


def quantised(vector: Column) -> Column:
    """(scale, codes): a vector in 8-bit steps of its largest part / 127; all zeros have scale 0."""
    top = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    scale = top / 127
    return F.struct(scale.alias("scale"), F.transform(vector, lambda x: F.when(scale > 0, F.round(x.cast("double") / scale)).otherwise(0.0).cast("tinyint")).alias("codes"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """A vector of length one; zeros stay."""
    norm = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def similar(queries: DataFrame, rows: DataFrame, query: str, key: str, vector: str, floor: float, most: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(`query`, `key`, score, rank): the `most` rows nearest each query by cosine that reach `floor` of its best.

    Queries are a stated set. They are numbered along their order and met with all rows in blocks of `block`: a
    block goes to every task, which multiplies its rows with it, batch by batch, and keeps the best `most` rows a query;
    only these are exchanged. A query does not find its own key. Ties go to the smaller key. Null vectors and keys are left
    out; vectors of zeros have score 0. No queries or no rows give none.
    """
    spark = rows.sparkSession
    told = cut(queries.where(F.col(query).isNotNull() & F.col(vector).isNotNull()).select(F.col(query).alias("_q"), F.col(vector).cast("array<double>").alias("_v")))
    blocks = max(1, -(-told.count() // block))
    qkind, kind = told.schema["_q"].dataType.simpleString(), rows.schema[key].dataType.simpleString()
    slim = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("_v"))
    best = spark.createDataFrame([], f"_q {qkind}, _k {kind}, score double")
    for i in range(blocks):
        part = told.where(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == i).toPandas()
        if len(part):
            shared = spark.sparkContext.broadcast((part["_q"].to_numpy(), _units(part["_v"])))
            best = best.unionByName(slim.mapInPandas(_top(shared, most), f"_q {qkind}, _k {kind}, score double"))
    order = Window.partitionBy("_q").orderBy(F.desc("score"), "_k")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).withColumn("_best", F.max("score").over(Window.partitionBy("_q")))
    return ranked.where(F.col("score") >= floor * F.col("_best")).select(F.col("_q").alias(query), F.col("_k").alias(key), "score", "rank")


def _units(vectors: pd.Series) -> np.ndarray:
    v = np.stack(vectors.to_numpy()).astype(np.float64)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _top(shared, most: int):
    """The best `most` rows of a task for each query of a block; a batch's rows are only sorted where they reach the worst kept so far."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, matrix = shared.value
        kept: list[list[tuple]] = [[] for _ in asked]
        worst = np.full(len(asked), -np.inf)
        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf["_k"].to_numpy()
            scores = np.round(_units(pdf["_v"]) @ matrix.T, 9) + 0.0
            scores[keys[:, None] == asked[None, :]] = -np.inf
            enough = np.maximum(worst, np.partition(scores, len(keys) - most, axis=0)[len(keys) - most] if len(keys) > most else -np.inf)
            for r, q in np.argwhere((scores >= enough) & (scores > -np.inf)).tolist():
                kept[q].append((-scores[r, q], keys[r]))
            for q, found in enumerate(kept):
                if len(found) > most:
                    kept[q] = sorted(found)[:most]
                    worst[q] = -kept[q][-1][0]
        out = [(asked[q], k, -s) for q, found in enumerate(kept) for s, k in found]
        yield pd.DataFrame(out, columns=["_q", "_k", "score"])

    return run


def fused(lists: Sequence[tuple[DataFrame, float]], query: str, key: str, damping: int = 60) -> DataFrame:
    """(`query`, `key`, score): reciprocal-rank fusion of ranked lists (`query`, `key`, rank) with weights."""
    parts = [df.select(query, key, (F.lit(weight) / (damping + F.col("rank"))).alias("_s")) for df, weight in lists]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(query, key).agg(F.sum("_s").alias("score"))


def ranking_quality(ranked: DataFrame, grades: DataFrame, query: str, key: str, grade: str, k: int) -> DataFrame:
    """(`query`, ndcg, recall): of the first k of each ranked list; 1 for a query without a relevant key.

    Gain is 2^grade - 1, discount log2(rank + 1); a key is relevant from grade 1.
    """
    gain = F.pow(F.lit(2.0), F.col(grade)) - 1
    got = ranked.where(F.col("rank") <= k).join(grades, [query, key]).groupBy(query).agg(F.sum(gain / F.log2(F.col("rank") + 1)).alias("_dcg"), F.count_if(F.col(grade) >= 1).alias("_hits"))
    best = grades.where(F.col(grade) >= 1).withColumn("_r", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(grade), key)))
    ideal = best.groupBy(query).agg(F.sum(F.when(F.col("_r") <= k, gain / F.log2(F.col("_r") + 1))).alias("_idcg"), F.count("*").alias("_rel"))
    asked = ranked.select(query).union(grades.select(query)).distinct()
    share = lambda a, b: F.when(F.coalesce(F.col(b), F.lit(0)) == 0, 1.0).otherwise(F.coalesce(F.col(a), F.lit(0)) / F.col(b))
    return asked.join(got, query, "left").join(ideal, query, "left").select(query, F.round(share("_dcg", "_idcg"), 6).alias("ndcg"), F.round(share("_hits", "_rel"), 6).alias("recall"))


def bayes_model(features: DataFrame, label: str, feature: str, weight: str, smoothing: float = 0.1, prior: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Weighted naive Bayes over presence features: (label, log_prior) and (label, feature, log_likelihood, log_unseen).

    `features` has a row for each distinct feature of an example (column example). The
    likelihood is the label's weight of the feature plus `smoothing`, over all of its weight
    plus `smoothing` a feature known; the prior counts examples plus `prior`.
    """
    seen = features.groupBy(label, feature).agg(F.sum(weight).alias("w"))
    n = features.select(feature).distinct().agg((F.count("*") * smoothing).alias("_v"))
    totals = seen.groupBy(label).agg(F.sum("w").alias("_t")).crossJoin(F.broadcast(n)).withColumn("_all", F.col("_t") + F.col("_v"))
    likely = seen.join(totals, label).select(label, feature, F.ln((F.col("w") + smoothing) / F.col("_all")).alias("log_likelihood"), F.ln(F.lit(smoothing) / F.col("_all")).alias("log_unseen"))
    counts = features.select("example", label).distinct().groupBy(label).agg((F.count("*") + prior).alias("c"))
    whole = counts.agg(F.sum("c").alias("_c"))
    priors = counts.crossJoin(F.broadcast(whole)).join(totals.select(label, F.ln(F.lit(smoothing) / F.col("_all")).alias("log_unseen")), label).select(label, F.ln(F.col("c") / F.col("_c")).alias("log_prior"), "log_unseen")
    return priors, likely


def bayes_classify(features: DataFrame, priors: DataFrame, likely: DataFrame, label: str, feature: str, weight: str) -> DataFrame:
    """(example, `label`, probability): the likeliest label of each example, ties by name; features never seen are ignored.

    The labels are few: a sum over all of them is the log of the unseen features' share plus
    what each label's seen features add, so no example meets every label for every feature.
    """
    known = likely.select(feature).distinct()
    rows = features.select("example", feature, weight).join(known, feature, "left_semi")
    weights = rows.groupBy("example").agg(F.sum(weight).alias("_w"))
    adds = rows.join(likely, feature).groupBy("example", label).agg(F.sum(F.col(weight) * (F.col("log_likelihood") - F.col("log_unseen"))).alias("_add"))
    scored = weights.crossJoin(priors).join(adds, ["example", label], "left").select("example", label, (F.col("log_prior") + F.col("_w") * F.col("log_unseen") + F.coalesce("_add", F.lit(0.0))).alias("_s"))
    top = scored.groupBy("example").agg(F.max("_s").alias("_m"))
    share = scored.join(top, "example").withColumn("_e", F.exp(F.col("_s") - F.col("_m")))
    return share.groupBy("example").agg(F.min(F.struct((-F.round("_s", 6)).alias("s"), F.col(label).alias("l"))).alias("_b"), F.sum("_e").alias("_sum"), F.max("_e").alias("_top")).select("example", F.col("_b.l").alias(label), F.round(F.col("_top") / F.col("_sum"), 6).alias("probability"))
