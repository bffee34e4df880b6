"""Structured Streaming forms of the time-driven operators.

Each takes a streaming DataFrame with an event time `ts` and a key, bounds its state by a watermark, and gives on a finished
stream the rows of its batch form.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def first_by_key(events: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """One row of each key within the watermark: coalesces requests that are in flight together."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def bursts(events: DataFrame, key: str, quiet: str, delay: str) -> DataFrame:
    """(key, first, last, events): runs of a key's events with less than `quiet` between neighbours; a debounced job runs once for each."""
    window = events.withWatermark("ts", delay).groupBy(F.session_window("ts", quiet).alias("w"), key)
    return window.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("events")).drop("w")


def ttl_hits(events: DataFrame, key: str, ttl: int) -> DataFrame:
    """(key, id, t, hit) as in the batch form, with one time of state for each key; the rows of a batch are taken in time order."""

    def step(k: tuple, frames, state: GroupState):
        until = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["t", "id"])
        hits = []
        for t in rows["t"]:
            hit = until is not None and until > t
            until = until if hit else int(t) + ttl
            hits.append(hit)
        state.update((until,))
        yield pd.DataFrame({"key": k[0], "id": rows["id"], "t": rows["t"], "hit": hits})

    return events.groupBy(key).applyInPandasWithState(step, "key long, id long, t long, hit boolean", "until long", "append", GroupStateTimeout.NoTimeout)


def drain(spark: SparkSession, stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that its source has now and return what came out, from files in `folder`.

    Each micro-batch overwrites a folder of its own number, so a batch that is run again leaves no second copy. In complete
    mode the last batch holds the whole result.
    """
    out = f"{folder}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    # The folder itself says which batches there are, those of earlier runs included.
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], stream.schema)
    found = spark.read.schema(StructType(list(stream.schema.fields)).add("batch", "long")).parquet(out)
    if mode == "complete":
        found = found.filter(F.col("batch") == found.agg(F.max("batch")).first()[0])
    return found.drop("batch")


def upsert(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str) -> Callable[[], None]:
    """Start an idempotent sink: each micro-batch writes the last row of each key under its batch number, so a retry rewrites the same files."""

    def write(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), order).alias("r")).select(*keys, "r.*")
        latest.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return query.awaitTermination
