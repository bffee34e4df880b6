"""Streams give the rows of their batch forms."""

from pyspark.sql import functions as F

from quern.streaming import state, streams


def events(spark, tmp_path):
    rows = [(i, i * 7 % 5, 1_700_000_000_000_000 + (i * i * 37 % 4000) * 1_000_000) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, key long, t long")
    df.coalesce(1).orderBy("t").write.parquet(f"{tmp_path}/in")
    schema = "id long, key long, t long"
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("ts", F.timestamp_micros("t"))
    return df, read


def test_ttl(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    got = streams.drain(spark, streams.ttl_hits(stream.select("key", "id", "t"), "key", 60_000_000), f"{tmp_path}/c1")
    want = state.ttl_hits(batch, 60_000_000)
    key = lambda df: sorted((r["id"], r["key"], r["t"], r["hit"]) for r in df.collect())
    assert key(got) == key(want)


def test_first_by_key(spark, tmp_path):
    _, stream = events(spark, tmp_path)
    got = streams.drain(spark, streams.first_by_key(stream, ["key"], "10 hours"), f"{tmp_path}/c2")
    assert got.count() == 5


def test_drain_reads_the_batches_of_earlier_runs(spark, tmp_path):
    _, stream = events(spark, tmp_path)
    first = streams.drain(spark, streams.first_by_key(stream, ["key"], "10 hours"), f"{tmp_path}/c5").count()
    assert first == 5
    # Nothing new has come, and what was written before the restart is still the result.
    assert streams.drain(spark, streams.first_by_key(stream, ["key"], "10 hours"), f"{tmp_path}/c5").count() == 5


def test_bursts_equal_debounce(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    got = streams.drain(spark, streams.bursts(stream, "key", "19999999 microseconds", "1 hour"), f"{tmp_path}/c3", "complete")
    want = state.debounced(batch, 20_000_000)
    assert sorted((r["key"], r["t"]) for r in want.collect()) == sorted((r["key"], r["t"]) for r in got.selectExpr("key", "unix_micros(last) as t").collect())


def test_upsert_is_idempotent(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    streams.upsert(stream, f"{tmp_path}/out", ["key"], "t", f"{tmp_path}/c4")()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_rate_limiter(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 0, 100), (4, 1, 5)], "id long, key long, t long")
    assert {r["id"]: r["start"] for r in state.rate_limited(df, 10).collect()} == {1: 0, 2: 10, 3: 100, 4: 5}
