"""Queries of polygon kernels, rasterising, readers and writers on the ring lens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import geometry as geo
from quern.operators import polygons as poly
from quern.plans.lenses import DEPTHS, POLYLINES, RINGS, depths, polylines, rings
from quern.plans.registry import query
from quern.sources import geo as readers
from quern.sources import svg

_CELL = 1000


@query(
    "rasterize_rings",
    f"""WITH {POLYLINES}, {RINGS}, k AS (SELECT id, generate_series AS r FROM (SELECT id, min(y) AS lo, max(y) AS hi FROM edges GROUP BY id), generate_series(lo // 1000 - 2, hi // 1000 + 2)),
c AS (SELECT k.id, k.r, (x2 - x)::DOUBLE * ((k.r * 1000 + 500) - y)::DOUBLE / (y2 - y)::DOUBLE + x::DOUBLE AS cx FROM k JOIN edges e ON e.id = k.id AND (e.y > k.r * 1000 + 500) <> (e.y2 > k.r * 1000 + 500)),
p AS (SELECT *, row_number() OVER o AS n, lead(cx) OVER o AS nx FROM c WINDOW o AS (PARTITION BY id, r ORDER BY cx)),
s AS (SELECT id, r, ceil((cx - 500) / 1000)::BIGINT AS a, ceil((nx - 500) / 1000)::BIGINT - 1 AS b FROM p WHERE n % 2 = 1)
SELECT id, r, sum(greatest(0, b - a + 1))::BIGINT AS cells FROM s GROUP BY id, r""",
)
def rasterize_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of 1 mm with their centre inside each ring, by row: scanline crossings in order, taken in pairs."""
    from pyspark.sql import Window

    e = rings(spark, sf_dir).select("id", F.explode(geo.segments(F.col("ring"))).alias("s")).select("id", "s.*").filter("y <> y2")
    half = _CELL // 2
    rows = F.sequence(F.floor((F.least("y", "y2") - half) / _CELL), F.floor((F.greatest("y", "y2") - half) / _CELL) + 1)
    hit = e.withColumn("r", F.explode(rows)).withColumn("at", F.col("r") * _CELL + half).filter((F.col("y") > F.col("at")) != (F.col("y2") > F.col("at")))
    d = lambda c: c.cast("double")
    crossed = hit.select("id", "r", (d(F.col("x2") - F.col("x")) * d(F.col("at") - F.col("y")) / d(F.col("y2") - F.col("y")) + d(F.col("x"))).alias("cx"))
    order = Window.partitionBy("id", "r").orderBy("cx")
    spans = crossed.withColumns({"n": F.row_number().over(order), "nx": F.lead("cx").over(order)}).filter("n % 2 = 1")
    first, last = F.ceil((F.col("cx") - half) / _CELL), F.ceil((F.col("nx") - half) / _CELL) - 1
    return spans.groupBy("id", "r").agg(F.sum(F.greatest(F.lit(0), last - first + 1)).alias("cells"))


def _pairs_of_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rings(spark, sf_dir)
    a = r.filter("id % 2 = 0").select("id", F.array("ring").alias("a"))
    return a.join(r.filter("id % 2 = 1").select((F.col("id") - 1).alias("id"), F.array("ring").alias("b")), "id")


@query("polygon_boolean")
def polygon_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of the four Booleans of neighbouring rings."""
    # The rows are few bytes but much work, so they are dealt to a set number of tasks.
    pairs = _pairs_of_rings(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism, "id")
    return poly.boolean_areas(pairs, "a", "b").select("id", *poly.OPERATIONS)


@query("offset_buffer")
def offset_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of every ring grown and shrunk by half a millimetre."""
    # As in polygon_boolean, the rows are dealt to a set number of tasks.
    r = rings(spark, sf_dir).select("id", F.array("ring").alias("rings")).repartition(4 * spark.sparkContext.defaultParallelism, "id")
    both = poly.buffered_both_ways(r, "rings", 500.0, ("grown", "wide"), ("shrunk", "narrow"))
    return both.select("id", "grown", "shrunk", F.size("wide").alias("outlines"), F.size("narrow").alias("inlines"))


@query(
    "geojson_import",
    f"WITH {DEPTHS} SELECT body, floor(CASE unit WHEN 'm' THEN depth ELSE depth * 0.3048::DOUBLE END * 1e6 + 0.5)::BIGINT AS micrometres, count(*) AS regions, count(*) AS polygons FROM depths GROUP BY ALL",
)
def geojson_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth regions written as GeoJSON features, one for each part, and read back by body and depth."""
    d = F.col("depth")
    ring = F.array(*[F.array(*[F.array(a, b) for a, b in ((d, d), (d + 1, d), (d, d + 1), (d, d))])])
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(d.alias("depth"), F.col("unit").alias("unit")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry")))
    read = readers.depth_regions(depths(spark, sf_dir).select("body", feature.alias("json")))
    merged = read.withColumn("micrometres", F.floor(F.col("depth_m") * 1e6 + 0.5)).groupBy("body", "micrometres")
    return merged.agg(F.sum("regions").alias("regions"), F.sum(F.size("polygons")).alias("polygons"))


@query(
    "gpx_import",
    f"WITH {POLYLINES} SELECT id, 'track' AS source, 0 AS segment, len(line) AS points, list_sum(list_transform(line, lambda p: p.x))::BIGINT AS sum_lng, list_sum(list_transform(line, lambda p: p.y))::BIGINT AS sum_lat FROM polylines",
)
def gpx_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as GPX tracks of a thousandth of a degree a micrometre, and read back."""
    milli = lambda v: F.format_string("%.3f", v.cast("double") / 1000)
    point = lambda p: F.concat(F.lit('<trkpt lat="'), milli(p["y"]), F.lit('" lon="'), milli(p["x"]), F.lit('"/>'))
    xml = F.concat(F.lit("<gpx><trk><trkseg>"), F.array_join(F.transform("line", point), ""), F.lit("</trkseg></trk></gpx>"))
    read = readers.gpx_segments(polylines(spark, sf_dir).select("id", xml.alias("xml")))
    total = lambda k: F.aggregate("points", F.lit(0).cast("long"), lambda a, p: a + F.floor(p[k] * 1000 + 0.5))
    return read.select("id", "source", "segment", F.size("points").cast("long").alias("points"), total("lng").alias("sum_lng"), total("lat").alias("sum_lat"))


_MM = "CASE WHEN {v} < 0 THEN '-' ELSE '' END || (abs({v}) // 1000) || CASE WHEN abs({v}) % 1000 = 0 THEN '' ELSE '.' || rtrim(lpad((abs({v}) % 1000)::VARCHAR, 3, '0'), '0') END"


@query(
    "svg_export",
    f"""WITH {POLYLINES}, p AS (SELECT id, class, 'M' || array_to_string(list_transform(line, lambda p: {_MM.format(v='p.x')} || ' ' || {_MM.format(v='p.y')}), 'L') || 'Z' AS d FROM polylines),
g AS (SELECT class AS board, CASE WHEN id % 2 = 0 THEN 'cut' ELSE 'engrave' END AS grp, string_agg('<path d="' || d || '"/>', '' ORDER BY id) AS body FROM p GROUP BY ALL),
b AS (SELECT DISTINCT board FROM g)
SELECT board, md5('<svg xmlns="http://www.w3.org/2000/svg" width="120mm" height="90mm" viewBox="0 0 120 90"><metadata><board>' || board || '</board></metadata>' ||
  '<g id="cut">' || coalesce((SELECT body FROM g WHERE g.board = b.board AND grp = 'cut'), '') || '</g><g id="engrave">' || coalesce((SELECT body FROM g WHERE g.board = b.board AND grp = 'engrave'), '') || '</g><g id="score"></g></svg>') AS svg FROM b""",
)
def svg_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = rings(spark, sf_dir).select(
        F.col("class").alias("board"), F.when(F.col("id") % 2 == 0, "cut").otherwise("engrave").alias("group"), F.col("id").alias("ix"), svg.path(F.array(F.array("ring"))).alias("d"),
        F.lit(120000).alias("w"), F.lit(90000).alias("h"),
    )
    out = svg.documents(shapes, ["cut", "engrave", "score"], "w", "h", svg.metadata_xml({"board": F.col("board")}))
    return out.select("board", F.md5("svg").alias("svg"))
