"""Queries of shaped rings, polygon components, levels within each other and depth regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.geometry import double_area
from quern.operators import bands as bd
from quern.operators import surveys as sv
from quern.operators.graph import checkpointed
from quern.plans.lenses import POLYLINES, SIDE, grid, polylines
from quern.plans.registry import query
from quern.plans.shapes import _BOXES, _box, _boxes


def _heights(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The boards' samples, and four even heights (board, threshold) of each board."""
    v = grid(spark, sf_dir)
    low, high = F.min("v"), F.max("v")
    heights = v.groupBy("board").agg(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.floor(low + k * (high - low) / 5)).alias("t"))
    return v, heights.select("board", F.explode("t").alias("threshold"))


@query("shaped_bands")
def shaped_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contour rings of every level, simplified and smoothed as far as none crosses another, with the outline that each hole lies in, and what is left of each outline in the level below."""
    shaped = bd.shaped_levels(*_heights(spark, sf_dir), SIDE, 150.0, True, 500)
    size = double_area(F.col("ring"))
    return shaped.select("board", "threshold", "id", "kind", "crosses", F.size("ring").cast("long").alias("vertices"), size.alias("double_area"), "parent", "filled", "pieces", "area")


@query("contour_hole_parents")
def contour_hole_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outline directly around each hole of the contours."""
    return bd.level_hole_parents(*_heights(spark, sf_dir), SIDE)


def _within(inset: int, reverse: bool = False) -> Column:
    """The box of a row, less `inset` on every side."""
    ring = _box(F.col("x") + inset, F.col("y") + inset, F.col("x") + F.col("w") - inset, F.col("y") + F.col("h") - inset)
    return F.reverse(ring) if reverse else ring


@query(
    "polygon_components",
    f"""WITH {POLYLINES}, {_BOXES}, p AS (SELECT id, unnest([0, 2]) AS piece, w, h FROM b)
SELECT id, piece, CASE piece WHEN 0 THEN w * h - CASE WHEN (w - 600) * (h - 600) >= 3000000 THEN (w - 600) * (h - 600) ELSE 0 END ELSE (w - 1200) * (h - 1200) END AS area,
  CASE WHEN piece = 0 AND (w - 600) * (h - 600) >= 3000000 THEN 2 ELSE 1 END AS rings FROM p WHERE CASE piece WHEN 0 THEN w * h - CASE WHEN (w - 600) * (h - 600) >= 3000000 THEN (w - 600) * (h - 600) ELSE 0 END ELSE (w - 1200) * (h - 1200) END >= 2500000""",
)
def polygon_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with a hole and an island in it, as connected pieces; small holes are closed and small pieces go."""
    sets = _boxes(spark, sf_dir).select("id", F.array(_within(0), _within(300, True), _within(600)).alias("rings"))
    each = sets.select(F.col("id").alias("group"), F.posexplode("rings").alias("id", "ring"))
    found = bd.polygons_of(each, 4000, least_hole=3_000_000).filter("area >= 2500000")
    return found.select(F.col("group").alias("id"), F.col("id").cast("long").alias("piece"), F.round("area").cast("long").alias("area"), F.size("rings").alias("rings"))


@query(
    "enforced_levels",
    f"""WITH {POLYLINES}, {_BOXES}, p AS (SELECT id, w, h, id % 4 * 5 AS poke FROM b), q AS (SELECT *, greatest(0, poke - 3) * (h - 200) AS outside FROM p)
SELECT id AS board, 1 AS level, 'passes' AS verdict, 0 AS outside, w * h AS area FROM q
UNION ALL SELECT id, 2, CASE WHEN outside <= 1000 THEN 'passes' WHEN outside <= 10000 THEN 'trimmed' ELSE 'breach' END, outside,
  (w - 100 + CASE WHEN outside > 1000 AND outside <= 10000 THEN 0 ELSE poke END) * (h - 200) FROM q""",
)
def enforced_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels of boxes, the second of which reaches out of the first by up to 15 micrometres."""
    b = _boxes(spark, sf_dir).withColumn("poke", F.col("id") % 4 * 5)
    deep = _box(F.col("x") + 100, F.col("y") + 100, F.col("x") + F.col("w") + F.col("poke"), F.col("y") + F.col("h") - 100)
    levels = b.select(F.col("id").alias("board"), F.explode(F.array(F.struct(F.lit(1).alias("level"), "rings"), F.struct(F.lit(2).alias("level"), F.array(deep).alias("rings")))).alias("l")).select("board", "l.*")
    out = bd.enforced(levels, b.select(F.col("id").alias("board"), "rings"))
    return out.select("board", "level", "verdict", F.round("outside").cast("long").alias("outside"), F.round("area").cast("long").alias("area"))


@query(
    "contour_regions",
    f"""WITH {POLYLINES}, {_BOXES}, r AS (SELECT DISTINCT board, (id % 8) // 3 AS depth, x, y, x + w AS x2, y + h AS y2 FROM b),
xs AS (SELECT board, v, lead(v) OVER (PARTITION BY board ORDER BY v) AS v2 FROM (SELECT board, x AS v FROM r UNION SELECT board, x2 FROM r)),
ys AS (SELECT board, v, lead(v) OVER (PARTITION BY board ORDER BY v) AS v2 FROM (SELECT board, y AS v FROM r UNION SELECT board, y2 FROM r)),
c AS (SELECT xs.board, xs.v AS x, xs.v2 AS x2, ys.v AS y, ys.v2 AS y2 FROM xs JOIN ys USING (board) WHERE xs.v2 IS NOT NULL AND ys.v2 IS NOT NULL),
d AS (SELECT DISTINCT board, depth FROM r),
o AS (SELECT c.board, r.depth, c.x, c.y, (c.x2 - c.x) * (c.y2 - c.y) AS area FROM c JOIN r ON r.board = c.board AND r.x <= c.x AND r.x2 >= c.x2 AND r.y <= c.y AND r.y2 >= c.y2
  GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT board, depth, sum(area)::BIGINT AS area FROM (SELECT DISTINCT d.board, d.depth, o.x, o.y, o.area FROM d JOIN o ON o.board = d.board AND o.depth >= d.depth) GROUP BY board, depth""",
)
def contour_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region at least as deep as each depth, of boards of eight rings at three depths."""
    rings = _boxes(spark, sf_dir).select("board", F.floor(F.col("id") % 8 / 3).alias("depth"), F.get("rings", 0).alias("ring"))
    return bd.contour_regions(rings, "board").select("board", "depth", F.round("area").cast("long").alias("area"))


_APART = 12000
_SURVEYS = f"""{POLYLINES}, {_BOXES}, water AS (SELECT id AS body, board * {_APART} + x AS x, y, board * {_APART} + x + w AS x2, y + h AS y2 FROM b),
survey AS (SELECT body AS key, x + 700 + body % 5 * 300 AS x, y - 400 + body % 3 * 500 AS y, x2 - 500 + body % 7 * 200 AS x2, y2 + body % 4 * 100 AS y2 FROM water),
pairs AS (SELECT key, body, greatest(0, least(w.x2, s.x2) - greatest(w.x, s.x)) * greatest(0, least(w.y2, s.y2) - greatest(w.y, s.y)) AS shared, least((w.x2 - w.x) * (w.y2 - w.y), (s.x2 - s.x) * (s.y2 - s.y)) AS smaller,
  key % 3 = 0 AND s.x + 10 BETWEEN w.x AND w.x2 - 1 AND s.y + 10 BETWEEN w.y AND w.y2 - 1 AS point FROM water w JOIN survey s ON true),
found AS (SELECT key, body, CASE WHEN point THEN 'point' ELSE 'overlap' END AS how, CASE WHEN NOT point THEN shared END AS shared FROM pairs WHERE point OR shared > 0 AND shared >= 0.5 * smaller)"""


def _surveys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Deep points, contours and waters: boxes of all boards side by side, each with a survey that is a little off, and three depths."""
    b = _boxes(spark, sf_dir).withColumn("x", F.col("x") + F.col("board") * _APART)
    i, x, y = F.col("id"), F.col("x"), F.col("y")
    waters = b.select(i.alias("body"), F.array(_within(0)).alias("rings"))
    s = b.select(i.alias("key"), (x + 700 + i % 5 * 300).alias("x"), (y - 400 + i % 3 * 500).alias("y"), (x + F.col("w") - 500 + i % 7 * 200).alias("x2"), (y + F.col("h") + i % 4 * 100).alias("y2"))
    inset = lambda d: _box(F.col("x") + d, F.col("y") + d, F.col("x2") - d, F.col("y2") - d)
    depths = F.array(*(F.struct(F.lit(d).cast("long").alias("depth"), inset(d * 20).alias("ring")) for d in (0, 5, 10)))
    contours = s.select("key", F.explode(depths).alias("c")).select("key", "c.*")
    return s.filter("key % 3 = 0").select("key", (F.col("x") + 10).alias("x"), (F.col("y") + 10).alias("y")), contours, waters


@query("survey_matches", f"WITH {_SURVEYS} SELECT key, body, how, shared FROM found")
def survey_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surveys of each body of water, by deep point or by overlap."""
    points, contours, waters = _surveys(spark, sf_dir)
    found = sv.matches(points, contours.select("key", "ring"), waters, 4000)
    return found.select("key", "body", "how", F.round("shared").cast("long").alias("shared"))


@query(
    "measured_depths",
    f"""WITH {_SURVEYS}, r AS (SELECT DISTINCT body, depth, x + depth * 20 AS x, y + depth * 20 AS y, x2 - depth * 20 AS x2, y2 - depth * 20 AS y2 FROM found JOIN survey USING (key) JOIN (VALUES (5), (10)) t(depth) ON true),
xs AS (SELECT body, v, lead(v) OVER (PARTITION BY body ORDER BY v) AS v2 FROM (SELECT body, x AS v FROM r UNION SELECT body, x2 FROM r)),
ys AS (SELECT body, v, lead(v) OVER (PARTITION BY body ORDER BY v) AS v2 FROM (SELECT body, y AS v FROM r UNION SELECT body, y2 FROM r)),
c AS (SELECT xs.body, xs.v AS x, xs.v2 AS x2, ys.v AS y, ys.v2 AS y2 FROM xs JOIN ys USING (body) WHERE xs.v2 IS NOT NULL AND ys.v2 IS NOT NULL),
o AS (SELECT c.body, r.depth, c.x, c.y, (c.x2 - c.x) * (c.y2 - c.y) AS area FROM c JOIN r ON r.body = c.body AND r.x <= c.x AND r.x2 >= c.x2 AND r.y <= c.y AND r.y2 >= c.y2 GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT body, depth::BIGINT AS depth, sum(area)::BIGINT AS area FROM (SELECT DISTINCT d.body, d.depth, o.x, o.y, o.area FROM (SELECT DISTINCT body, depth FROM r) d JOIN o ON o.body = d.body AND o.depth >= d.depth) GROUP BY body, depth""",
)
def measured_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth regions of each body from all the surveys that were matched to it."""
    points, contours, waters = _surveys(spark, sf_dir)
    found = checkpointed(sv.matches(points, contours.select("key", "ring"), waters, 4000))
    return sv.measured_depths(found, contours).select("body", "depth", F.round("area").cast("long").alias("area"))
