"""Queries of the time-driven operators on the arrivals lens: pacing, validity, change and retention of events."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.lenses import ARRIVALS, arrivals, table
from quern.plans.registry import ORACLES, query
from quern.streaming import state as st
from quern.streaming import streams

_HOUR = 3_600_000_000


@query("rate_limiter", f"WITH {ARRIVALS}, n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY t, id) - 1 AS i FROM arrivals) SELECT id, kind, t, i * 60000000 + max(t - i * 60000000) OVER (PARTITION BY kind ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS start FROM n")
def rate_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each kind spaced out to at most one a minute, in order."""
    return st.rate_limited(arrivals(spark, sf_dir), 60_000_000, "kind").select("id", "kind", "t", "start")


@query(
    "ttl_cache",
    f"""WITH RECURSIVE {ARRIVALS}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, id) AS i FROM arrivals),
f AS (SELECT id, key, t, i, false AS hit, t + {6 * _HOUR} AS until FROM n WHERE i = 1
  UNION ALL SELECT n.id, n.key, n.t, n.i, f.until > n.t, CASE WHEN f.until > n.t THEN f.until ELSE n.t + {6 * _HOUR} END FROM f JOIN n ON n.key = f.key AND n.i = f.i + 1)
SELECT id, key, t, hit FROM f""",
)
def ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.ttl_hits(arrivals(spark, sf_dir), 6 * _HOUR)


@query("debounce", f"WITH {ARRIVALS}, n AS (SELECT *, lead(t) OVER (PARTITION BY key ORDER BY t, id) AS nxt FROM arrivals) SELECT id, key, t, t + {_HOUR} AS fires FROM n WHERE nxt IS NULL OR nxt - t >= {_HOUR}")
def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.debounced(arrivals(spark, sf_dir), _HOUR).select("id", "key", "t", "fires")


@query("geometry_cache_reuse", f"WITH {ARRIVALS} SELECT id, key, kind, lag(kind) OVER (PARTITION BY key ORDER BY t, id) IS DISTINCT FROM kind AS rebuilt FROM arrivals")
def geometry_cache_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.recomputed(arrivals(spark, sf_dir), "kind").select("id", "key", "kind", "rebuilt")


@query(
    "disk_cache_eviction",
    """WITH f AS (SELECT doc_id AS id, source AS disk, n_chars AS bytes, doc_id * 7919 % 100003 AS written FROM documents)
SELECT id, disk, bytes, sum(bytes) OVER (PARTITION BY disk) <= 100000 OR sum(bytes) OVER (PARTITION BY disk ORDER BY written DESC, id DESC ROWS UNBOUNDED PRECEDING) <= 90000 AS kept FROM f""",
)
def disk_cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("disk"), F.col("n_chars").alias("bytes"), (F.col("doc_id") * 7919 % 100003).alias("written"))
    return st.evicted(files, 100_000).select("id", "disk", "bytes", "kept")


@query(
    "project_reducer",
    "WITH l AS (SELECT event_id AS id, user_id AS key, epoch_us(ts) AS t, CASE WHEN event_id % 3 = 0 THEN event_type END AS style, CASE WHEN event_id % 4 = 0 THEN value END AS size FROM events) SELECT key, arg_max(style, {'t': t, 'id': id}) FILTER (WHERE style IS NOT NULL) AS style, arg_max(size, {'t': t, 'id': id}) FILTER (WHERE size IS NOT NULL) AS size, count(*) AS updates FROM l GROUP BY key",
)
def project_reducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each user's project after a log of partial updates."""
    e = table(spark, sf_dir, "events")
    log = e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("style"),
        F.when(F.col("event_id") % 4 == 0, F.col("value")).alias("size"),
    )
    return st.last_writes(log, ["style", "size"])


@query(
    "sheet_layout",
    """WITH l AS (SELECT vec_id AS id, label AS class, max(x) - min(x) AS width FROM (SELECT vec_id, label, floor(unnest(embedding)::DOUBLE * 64000 + 0.5)::BIGINT AS x FROM embeddings) GROUP BY ALL)
SELECT id, class, width, coalesce(sum(width + 6000) OVER (PARTITION BY class ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 2000 AS x FROM l""",
)
def sheet_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces side by side on a sheet, with a gap of 6 mm and a margin of 2 mm."""
    from pyspark.sql import Window

    um = F.transform("embedding", lambda v: F.floor(v.cast("double") * 64000 + 0.5))
    pieces = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("class"), (F.array_max(um) - F.array_min(um)).alias("width"))
    before = Window.partitionBy("class").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("x", F.coalesce(F.sum(F.col("width") + 6000).over(before), F.lit(0)) + 2000)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = f"{sf_dir}/events.parquet"
    # As a pattern, as a stream's plain path has to be a folder and the table may be one file.
    read = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{sf_dir}/events.parque[t]")
    ts = F.col("ts").cast("timestamp")
    return read.select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("event_type").alias("kind"), F.unix_micros(ts).alias("t"), ts.alias("ts"))


def _folder(spark: SparkSession, name: str) -> str:
    """A folder for a stream's checkpoint and output: in spark.checkpoint.dir, or on this machine if that is all of the cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


@query("stream_ttl", ORACLES["ttl_cache"])
def stream_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache's hits from a stream of the events."""
    hits = streams.ttl_hits(_stream(spark, sf_dir).select("key", "id", "t"), "key", 6 * _HOUR)
    return streams.drain(spark, hits, _folder(spark, "ttl")).select("id", "key", "t", "hit")


@query("stream_dedupe", "SELECT DISTINCT user_id AS key, event_type AS kind FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of one user and kind, coalesced within a watermark longer than the events' span."""
    first = streams.first_by_key(_stream(spark, sf_dir), ["key", "kind"], "400 days")
    return streams.drain(spark, first, _folder(spark, "dedupe")).select("key", "kind")


@query(
    "stream_debounce",
    f"WITH {ARRIVALS}, n AS (SELECT *, CASE WHEN t - lag(t) OVER o >= {_HOUR} OR lag(t) OVER o IS NULL THEN 1 ELSE 0 END AS new FROM arrivals WINDOW o AS (PARTITION BY key ORDER BY t, id)), s AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY t, id) AS run FROM n) SELECT key, min(t) AS first, max(t) AS last, count(*) AS events FROM s GROUP BY key, run",
)
def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of each user's events from a stream, by session windows a microsecond short of an hour."""
    runs = streams.bursts(_stream(spark, sf_dir), "key", f"{_HOUR - 1} microseconds", "1 day")
    out = streams.drain(spark, runs, _folder(spark, "bursts"), "complete")
    return out.select("key", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "events")
