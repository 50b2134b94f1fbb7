"""Sources mixed to target shares of the total tokens.

Method: systematic sampling. Every document of a source has the same expected number of
copies; along the source's documents, ordered by size, these are summed up, one random
offset is added, and a copy is emitted for each whole number the sum passes. Ordered by
size, the copies spread evenly over small and large documents, so the tokens come out
near their share. The prefix sums are distributed: the order is a range partitioning,
each range counts its rows by source, and only these counts are summed up on the driver.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import cut

#: Target rows above which they no longer count as few.
MAX_TARGETS = 100_000

_encoding: dict = {}


def tokenizer(path: str, pattern: str):
    """A byte-pair tokenizer from a file of base64 ranks; built once a process."""
    if path not in _encoding:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoding[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoding[path]


def token_counts(docs: DataFrame, key: str, source: str, text: str, path: str, pattern: str) -> DataFrame:
    """(`key`, `source`, n_tokens): whole texts, special tokens' strings as plain text; a null text has none."""
    kind, skind = docs.schema[key].dataType.simpleString(), docs.schema[source].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path, pattern).encode_ordinary
        for batch in batches:
            n = pa.array([len(encode(t)) if t else 0 for t in batch.column("t").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("s"), n], names=["k", "s", "n"])

    rows = docs.select(F.col(key).alias("k"), F.col(source).alias("s"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"k {kind}, s {skind}, n long").select(F.col("k").alias(key), F.col("s").alias(source), F.col("n").alias("n_tokens"))


def plan(available: dict[str, tuple[int, int]], targets: dict[str, tuple[float, int]], total: int | None) -> dict[str, float]:
    """Expected copies of a document by source.

    `available` has a source's documents and tokens, `targets` its share and most repeats.
    Shares are of the sources that have tokens. Without `total` the mix is the largest in
    which every such source reaches its share; with it, a source that cannot reach its share
    of `total` gives all it may.
    """
    live = {s: t for s, t in targets.items() if available.get(s, (0, 0))[1] > 0 and t[0] > 0 and t[1] > 0}
    weight = sum(share for share, _ in live.values())
    if not live:
        return {}
    size = total if total is not None else min(cap * available[s][1] * weight / share for s, (share, cap) in live.items())
    return {s: min(float(cap), size * share / weight / available[s][1]) for s, (share, cap) in live.items()}


def mix(docs: DataFrame, key: str, source: str, text: str, targets: DataFrame, share: str, repeats: str, path: str, pattern: str, total: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The mix (`key`, `source`, n_tokens, copy_no from 1) and its shares, one row a source.

    No document comes more than its source's `repeats` times. Documents without a target,
    a source or tokens are left out, targets without documents have no copies; both are
    in the report. Of repeated target rows of a source the largest share counts. Rows with
    equal keys are separate documents. The same input and `seed` give the same mix. The
    targets and one count by range and source come to the driver, nothing else.
    """
    spark = docs.sparkSession
    if targets.limit(MAX_TARGETS + 1).count() > MAX_TARGETS:
        raise ValueError("there are too many targets to plan on the driver")
    wanted = {r[0]: (float(r[1]), int(r[2])) for r in targets.where(F.col(source).isNotNull()).groupBy(source).agg(F.max(share), F.max(repeats)).collect() if r[1] is not None and r[2] is not None}
    names = spark.createDataFrame([(s,) for s in wanted], f"{source} string")
    sized = token_counts(docs.join(F.broadcast(names), source, "left_semi"), key, source, text, path, pattern)
    sized = cut(sized.where("n_tokens > 0"))
    ordered = cut(sized.repartitionByRange(source, "n_tokens", key).sortWithinPartitions(source, "n_tokens", key))
    placed = ordered.select("*", F.spark_partition_id().alias("_p"), (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("_i"))
    ranges = sorted(placed.groupBy(source, "_p").agg(F.count("*").alias("n"), F.min("_i").alias("first"), F.sum("n_tokens").alias("t")).collect(), key=lambda r: r["_p"])
    have: dict[str, tuple[int, int]] = {}
    starts = []
    for r in ranges:
        n, t = have.get(r[source], (0, 0))
        starts.append((r[source], r["_p"], n - r["first"]))
        have[r[source]] = (n + r["n"], t + r["t"])
    copies = plan(have, wanted, total)
    offset = dict(zip(sorted(copies), np.random.default_rng(seed).random(len(copies)).tolist(), strict=True))
    rates = spark.createDataFrame([(s, p, b, copies[s], offset[s]) for s, p, b in starts if s in copies], f"{source} string, _p int, _b long, _c double, _u double")
    rank = F.col("_i") + F.col("_b")
    passed = lambda n: F.floor(n * F.col("_c") + F.col("_u"))
    drawn = placed.join(F.broadcast(rates), [source, "_p"]).select(key, source, "n_tokens", (passed(rank + 1) - passed(rank)).cast("int").alias("_n")).where("_n > 0")
    mixed = drawn.select(key, source, "n_tokens", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy_no"))
    taken = drawn.groupBy(source).agg(F.sum(F.col("_n").cast("long")).alias("copies"), F.sum(F.col("_n") * F.col("n_tokens")).alias("tokens"), F.max("_n").alias("most_repeats"))
    known = spark.createDataFrame([(s, w[0], w[1], *have.get(s, (0, 0)), copies.get(s, 0.0)) for s, w in wanted.items()], f"{source} string, target_share double, max_repeats int, n_documents long, tokens_available long, expected_copies double")
    rest = docs.where(F.col(source).isNotNull()).join(F.broadcast(names), source, "left_anti").groupBy(source).agg(F.count("*").alias("n_documents"))
    report = known.join(taken, source, "left").unionByName(rest, allowMissingColumns=True)
    whole = taken.agg(F.sum("tokens").alias("_all"))
    shares = report.join(F.broadcast(whole)).select(
        source, "target_share", "max_repeats", "n_documents", "tokens_available", F.round("expected_copies", 6).alias("expected_copies"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.round(F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)), 6).alias("actual_share")
    )
    return mixed, shares
