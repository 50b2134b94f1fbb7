"""Observations, windows and sessions as streams, with the batch operators' meaning."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.session import shared_dir


def file_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A parquet path as a stream, `files` a batch; its schema is read once from what is there.

    The path is given as a pattern, so that a single file serves as well as a folder.
    """
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives until its source has no more, from a table in the shared folder; exactly once across restarts."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/{'all' if mode == 'complete' else f'batch={no}'}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("basePath", f"{at}/out").option("recursiveFileLookup", "true").parquet(f"{at}/out")


def accepted_stream(stream: DataFrame, key: str, arrival: str, seen: str, content: str) -> DataFrame:
    """(`key`, `arrival`, outcome) of each observation: new, changed, unchanged or stale, as `accepted` says of a batch.

    The state of a key is the latest time taken and its content, so it doesn't grow with the
    stream; an observation older than it is stale however late it comes. Within a batch the
    order is that of `arrival`. Rows of a key are read in pieces, after a sort of the pieces'
    small columns.
    """
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, arrival)}

    def step(k: tuple[Any], pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest, had = state.get if state.exists else (None, None)
        rows = pd.concat(list(pieces), ignore_index=True).sort_values("a", kind="stable")
        out = []
        for a, us, c in zip(rows["a"], rows["us"], rows["c"], strict=True):
            if latest is not None and us < latest:
                out.append((k[0], a, "stale"))
                continue
            out.append((k[0], a, "new" if latest is None else "unchanged" if c == had else "changed"))
            latest, had = int(us), c
        state.update((latest, had))
        yield pd.DataFrame(out, columns=["k", "a", "outcome"])

    slim = stream.select(F.col(key).alias("k"), F.col(arrival).alias("a"), F.unix_micros(F.col(seen).cast("timestamp")).alias("us"), F.col(content).cast("string").alias("c"))
    told = slim.groupBy("k").applyInPandasWithState(step, f"k {kinds[key]}, a {kinds[arrival]}, outcome string", "latest long, had string", "append", GroupStateTimeout.NoTimeout)
    return told.select(F.col("k").alias(key), F.col("a").alias(arrival), "outcome")


def windowed(stream: DataFrame, at: str, length: str, late: str, by: Sequence[str], value: str) -> DataFrame:
    """Counts and sums by tumbling window; rows later than `late` behind the newest are dropped, which bounds the state."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    out = timed.groupBy(F.window(at, length), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.unix_micros("window.start").alias("start_us"), *by, "n", "total")


def sessions(stream: DataFrame, at: str, gap: str, late: str, key: str) -> DataFrame:
    """(`key`, start_us, n): runs of a key's rows less than `gap` apart."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.session_window(at, gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, F.unix_micros("s.start").alias("start_us"), "n")
