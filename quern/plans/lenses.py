"""Lenses: fixed projections of the driver's tables into the relations of a map.

Each lens has a DataFrame form and the same rows as DuckDB SQL. Coordinates come from integers and
divisions by powers of two, and polylines are whole micrometres, so both engines get the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, lng, lat, class, rank, name) from events."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("id"),
        ((e * 7919 % 23040).cast("double") / F.lit(64.0) - 180).alias("lng"),
        ((e * 104729 % 10880).cast("double") / F.lit(64.0) - 85).alias("lat"),
        F.col("event_type").alias("class"),
        F.col("user_id").alias("rank"),
        F.concat(F.lit("p"), (e % 97).cast("string")).alias("name"),
    )


POINTS = """points AS (
  SELECT event_id AS id, (event_id * 7919 % 23040)::DOUBLE / 64::DOUBLE - 180 AS lng, (event_id * 104729 % 10880)::DOUBLE / 64::DOUBLE - 85 AS lat,
    event_type AS class, user_id AS rank, 'p' || (event_id % 97) AS name FROM events)"""


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, class, line): lines of (x, y) in whole micrometres from embeddings, two components a point."""
    um = lambda v: F.floor(v.cast("double") * 64000 + 0.5)
    e = F.col("embedding")
    line = F.transform(F.sequence(F.lit(0), F.floor(F.size(e) / 2).cast("int") - 1), lambda i: F.struct(um(F.get(e, 2 * i)).alias("x"), um(F.get(e, 2 * i + 1)).alias("y")))
    return table(spark, sf_dir, "embeddings").filter(F.size(e) >= 4).select(F.col("vec_id").alias("id"), F.col("label").alias("class"), line.alias("line"))


POLYLINES = """polylines AS (
  SELECT vec_id AS id, label AS class, list_transform(range(1, len(embedding) // 2 + 1), lambda i: {'x': floor(embedding[2 * i - 1]::DOUBLE * 64000 + 0.5)::BIGINT,
    'y': floor(embedding[2 * i]::DOUBLE * 64000 + 0.5)::BIGINT}) AS line FROM embeddings WHERE len(embedding) >= 4)"""

VERTICES = """vertices AS (
  SELECT id, class, i, line[i].x AS x, line[i].y AS y, line[i + 1].x AS x2, line[i + 1].y AS y2, len(line) AS n FROM (SELECT *, unnest(range(1, len(line) + 1)) AS i FROM polylines))"""

RINGS = """rings AS (SELECT id, class, list_append(line, line[1]) AS ring FROM polylines),
edges AS (
  SELECT id, class, i, ring[i].x AS x, ring[i].y AS y, ring[i + 1].x AS x2, ring[i + 1].y AS y2 FROM (SELECT *, unnest(range(1, len(ring))) AS i FROM rings))"""


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, class, ring): the polylines, closed."""
    lines = polylines(spark, sf_dir)
    return lines.select("id", "class", F.concat("line", F.slice("line", 1, 1)).alias("ring"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(board, r, c, v): elevation samples in whole cents from lineitem, boards of 64 x 64 cells; an absent cell is water.

    A board takes a span of 2,048 orders, so the boards grow in number with the table and keep their share of absent cells.
    """
    return table(spark, sf_dir, "lineitem").groupBy(
        F.floor(F.col("l_orderkey") / 2048).alias("board"), (F.col("l_orderkey") % SIDE).alias("r"), (F.col("l_partkey") % SIDE).alias("c")
    ).agg(F.max(F.floor(F.col("l_extendedprice") * 100 + 0.5)).alias("v"))


GRID = """grid AS (
  SELECT l_orderkey // 2048 AS board, l_orderkey % 64 AS r, l_partkey % 64 AS c, max(floor(l_extendedprice * 100 + 0.5)::BIGINT) AS v FROM lineitem GROUP BY ALL)"""


def depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(body, source, unit, depth) from part."""
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("body"), F.col("p_type").alias("source"), F.when(F.col("p_partkey") % 3 == 0, "m").when(F.col("p_partkey") % 3 == 1, "ft").otherwise("Feet").alias("unit"), F.col("p_size").cast("double").alias("depth")
    )


DEPTHS = """depths AS (
  SELECT p_brand AS body, p_type AS source, CASE p_partkey % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'ft' ELSE 'Feet' END AS unit, p_size::DOUBLE AS depth FROM part)"""


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, key, kind, t): requests in microseconds from events."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("event_type").alias("kind"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))


ARRIVALS = """arrivals AS (SELECT event_id AS id, user_id AS key, event_type AS kind, epoch_us(ts) AS t FROM events)"""
