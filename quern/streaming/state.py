"""Ordered, time-driven operators in batch form: rows carry a key and a time t in microseconds.

Keys are independent, so state lives within a key: windows where a closed form exists, a fold over
the key's rows in time order where each step depends on the last one's outcome.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rate_limited(arrivals: DataFrame, interval: int, key: str = "key") -> DataFrame:
    """Add `start`: each key's requests begin in order, at least `interval` apart and not before they arrive.

    start_i = i * interval + the largest arrival_j - j * interval so far, so it is a running maximum.
    """
    order = Window.partitionBy(key).orderBy("t", "id")
    i = F.row_number().over(order) - 1
    lead = F.max(F.col("t") - F.col("_i") * interval).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return arrivals.withColumn("_i", i.cast("long")).withColumn("start", F.col("_i") * interval + lead).drop("_i")


def ttl_hits(arrivals: DataFrame, ttl: int, key: str = "key") -> DataFrame:
    """(id, key, t, hit): whether a value put at an earlier miss of the key is still alive; reads do not renew it.

    A fold in time order for each key. Within a key, rows come sorted in batches from the shuffle, and the state is one time.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        held, until = None, 0
        for batch in batches:
            hits = []
            for k, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != held:
                    held, until = k, None
                hit = until is not None and until > t
                if not hit:
                    until = t + ttl
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(hits, bool))], ["id", "key", "t", "hit"])

    rows = arrivals.select("id", F.col(key).cast("long").alias("key"), "t").repartition(F.col("key")).sortWithinPartitions("key", "t", "id")
    return rows.mapInArrow(run, "id long, key long, t long, hit boolean")


def debounced(arrivals: DataFrame, quiet: int, key: str = "key") -> DataFrame:
    """The rows that no other row of their key follows within `quiet`, with the time at which they fire."""
    order = Window.partitionBy(key).orderBy("t", "id")
    return arrivals.withColumn("_n", F.lead("t").over(order)).filter(F.col("_n").isNull() | (F.col("_n") - F.col("t") >= quiet)).withColumn("fires", F.col("t") + quiet).drop("_n")


def recomputed(arrivals: DataFrame, value: str, key: str = "key") -> DataFrame:
    """Add `rebuilt`: whether the value differs from that of the row before, so that a cached result can't be used again."""
    order = Window.partitionBy(key).orderBy("t", "id")
    return arrivals.withColumn("rebuilt", ~F.lag(value).over(order).eqNullSafe(F.col(value)))


def evicted(files: DataFrame, most: int, keep: float = 0.9, group: str = "disk") -> DataFrame:
    """Add `kept`: when a disk holds more than `most` bytes, its oldest files go until at most a share `keep` of it is in use."""
    newest = Window.partitionBy(group).orderBy(F.desc("written"), F.desc("id"))
    total = F.sum("bytes").over(Window.partitionBy(group))
    return files.withColumns({"_t": total, "_r": F.sum("bytes").over(newest)}).withColumn("kept", (F.col("_t") <= most) | (F.col("_r") <= F.lit(most * keep))).drop("_t", "_r")


def last_writes(log: DataFrame, fields: list[str], key: str = "key") -> DataFrame:
    """The state after a log of partial updates: for each key and field the last value that is not null."""
    return log.groupBy(key).agg(*[F.max(F.when(F.col(f).isNotNull(), F.struct("t", "id", f)))[f].alias(f) for f in fields], F.count("*").alias("updates"))
