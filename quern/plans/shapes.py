"""Queries of polygon results as rings, and of what is measured on pieces and rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import geometry as geo
from quern.functions import scalars as sc
from quern.operators import features as op
from quern.operators import layers
from quern.operators import lines as ln
from quern.operators import polygons as poly
from quern.operators import spatial as sp
from quern.plans.features import _roads
from quern.plans.lenses import POLYLINES, RINGS, SIDE, VERTICES, grid, polylines, rings
from quern.plans.lines import _DISK, _MEET, _hashed, _runs
from quern.plans.registry import query

_WIDTH, _HEIGHT = "4000 + id % 7 * 500", "2000 + id % 5 * 400"
_BOXES = f"""b AS (SELECT id, id // 8 AS board, id * 37 % 50 * 100 AS x, id * 91 % 40 * 100 AS y, {_WIDTH} AS w, {_HEIGHT} AS h FROM polylines)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, board, x, y, w, h, rings): boxes on boards of eight, each as a set of one ring."""
    i = F.col("id")
    b = polylines(spark, sf_dir).select("id", F.floor(i / 8).alias("board"), (i * 37 % 50 * 100).alias("x"), (i * 91 % 40 * 100).alias("y"), (4000 + i % 7 * 500).alias("w"), (2000 + i % 5 * 400).alias("h"))
    return b.withColumn("rings", F.array(_box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))))


def _box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(*(F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))))


def _dealt(spark: SparkSession, df: DataFrame, key: str = "id") -> DataFrame:
    """The rows are few bytes but much work, so they are dealt to a set number of tasks."""
    return df.repartition(4 * spark.sparkContext.defaultParallelism, key)


def _ring_areas(rings: Column) -> Column:
    """The area of rings that are turned outwards and inwards."""
    return F.aggregate(rings, F.lit(0).cast("long"), lambda a, r: a + geo.double_area(r)) / 2


@query(
    "box_booleans",
    f"""WITH {POLYLINES}, {_BOXES}, p AS (SELECT a.id, a.w * a.h AS own, b.w * b.h AS other, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS shared FROM b a JOIN b ON b.id = a.id + 1)
SELECT id, shared AS intersection, own + other - shared AS "union", own - shared AS difference, CASE WHEN shared > 0 THEN 5 ELSE 0 END::BIGINT AS corners FROM p""",
)
def box_booleans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Booleans of boxes, chained: the union is joined from the difference and the other box, and areas come from the results' rings."""
    b = _boxes(spark, sf_dir).select("id", "rings")
    pairs = _dealt(spark, b.join(b.select((F.col("id") - 1).alias("id"), F.col("rings").alias("other")), "id"))
    both = poly.boolean(pairs, "rings", "other", "intersection", "inner")
    less = poly.boolean(both, "rings", "other", "difference", "rest")
    joined = poly.boolean(less, "rest", "other", "union", "whole")
    whole = lambda c: F.round(_ring_areas(F.col(c))).cast("long")
    corners = F.aggregate("inner", F.lit(0).cast("long"), lambda a, r: a + F.size(r))
    return joined.select("id", whole("inner").alias("intersection"), whole("whole").alias("union"), whole("rest").alias("difference"), corners.alias("corners"))


@query(
    "box_unions",
    f"""WITH {POLYLINES}, {_BOXES}, xs AS (SELECT board, x AS c FROM b UNION SELECT board, x + w FROM b), ys AS (SELECT board, y AS c FROM b UNION SELECT board, y + h FROM b),
sx AS (SELECT board, c, lead(c) OVER (PARTITION BY board ORDER BY c) AS n FROM xs), sy AS (SELECT board, c, lead(c) OVER (PARTITION BY board ORDER BY c) AS n FROM ys)
SELECT board, sum((sx.n - sx.c) * (sy.n - sy.c))::BIGINT AS area, (SELECT count(*) FROM b WHERE b.board = sx.board) AS boxes FROM sx JOIN sy USING (board)
WHERE sx.n IS NOT NULL AND sy.n IS NOT NULL AND EXISTS (SELECT 1 FROM b WHERE b.board = sx.board AND b.x <= sx.c AND b.x + b.w >= sx.n AND b.y <= sy.c AND b.y + b.h >= sy.n) GROUP BY board""",
)
def box_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of each board's boxes, by the area of its rings."""
    b = _boxes(spark, sf_dir)
    joined = poly.union_all(b, "rings", ["board"], "whole")
    return joined.join(b.groupBy("board").agg(F.count("*").alias("boxes")), "board").select("board", F.round(_ring_areas(F.col("whole"))).cast("long").alias("area"), "boxes")


@query(
    "box_offsets",
    f"WITH {POLYLINES}, {_BOXES} SELECT id, round(w * h + 2 * (w + h) * 500 + 3 * 500 * 500)::BIGINT // 1000 AS grown, ((w - 2400) * greatest(0, h - 2400))::BIGINT // 1000 AS shrunk, CASE WHEN h > 2400 THEN 1 ELSE 0 END::BIGINT AS pieces FROM b",
)
def box_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes grown by half a millimetre, with caps of twelve corners, and shrunk by 1.2 mm."""
    b = _dealt(spark, _boxes(spark, sf_dir).select("id", "rings"))
    grown = poly.buffered(b, "rings", 500.0, result="wide").select("id", "rings", F.col("area").alias("grown"))
    shrunk = poly.buffered(grown, "rings", -1200.0, result="narrow")
    thousands = lambda c: F.floor(F.round(F.col(c)) / 1000).cast("long")
    return shrunk.select("id", thousands("grown").alias("grown"), thousands("area").alias("shrunk"), F.size("narrow").cast("long").alias("pieces"))


_PIECES = f"""{RINGS}, p AS (SELECT id // 4 AS body, id % 4 AS piece, id, abs(sum(x * y2 - x2 * y))::DOUBLE / 2 AS area, sum(x)::DOUBLE / count(*) AS cx, sum(y)::DOUBLE / count(*) AS cy, max(x) - min(x) AS w, max(y) - min(y) AS h, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1,
  sum((x + x2)::DOUBLE * (x * y2 - x2 * y)) / (3 * sum(x * y2 - x2 * y)::DOUBLE) AS gx FROM edges GROUP BY id),
m AS (SELECT body, arg_max(piece, {{'a': area, 'p': -piece}}) AS main FROM p GROUP BY body)"""


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(body, piece, ring, area): rings as the pieces of bodies of four."""
    r = rings(spark, sf_dir)
    return r.select(F.floor(F.col("id") / 4).alias("body"), (F.col("id") % 4).alias("piece"), "ring", (F.abs(geo.double_area(F.col("ring"))) / 2).alias("area"))


@query(
    "island_policy",
    f"""WITH {POLYLINES}, {_PIECES} SELECT body, piece, area, floor(cx * 1000 + 0.26)::BIGINT AS centre_x, floor(cy * 1000 + 0.26)::BIGINT AS centre_y, greatest(w, h) AS extent, piece = main AS is_main, piece = main OR area >= 60000000 AS keeps,
  sum(CASE WHEN piece = main THEN 0 ELSE area END) OVER (PARTITION BY body) AS islands_area FROM p JOIN m USING (body)""",
)
def island_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of land: the largest is the main one, the others are islands, of which those under 60 mm2 go."""
    p = _pieces(spark, sf_dir)
    main = p.groupBy("body").agg(F.max(F.struct("area", (-F.col("piece")).alias("p")))["p"].alias("m"), F.sum("area").alias("all"), F.max("area").alias("top"))
    far = lambda c: F.floor(c * 1000 + 0.26)
    mean = geo.vertex_mean(F.col("ring"))
    is_main = F.col("piece") == -F.col("m")
    return p.join(main, "body").select(
        "body", "piece", "area", far(mean["x"]).alias("centre_x"), far(mean["y"]).alias("centre_y"), geo.extent(F.col("ring")).alias("extent"), is_main.alias("is_main"),
        (is_main | (F.col("area") >= 60_000_000)).alias("keeps"), (F.col("all") - F.col("top")).alias("islands_area"),
    )


@query(
    "water_measures",
    f"""WITH {POLYLINES}, {_PIECES} SELECT body, sum(area) AS area, floor(sum(area) / 9e8::DOUBLE * 1e9 + 0.26)::BIGINT AS share, floor((max(x1) - min(x0))::DOUBLE * (max(y1) - min(y0)) / 9e8::DOUBLE * 1e9 + 0.26)::BIGINT AS box_share,
  floor(arg_max(gx, {{'a': area, 'p': -piece}}) * 100 + 0.26)::BIGINT AS largest_x, count(*) AS pieces FROM p GROUP BY body""",
)
def water_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of water: their area, their shares of a product and of it by their box, and the centre of the largest piece."""
    p = _pieces(spark, sf_dir).withColumn("b", geo.bounds(F.col("ring")))
    box = (F.max("b.max_x") - F.min("b.min_x")).cast("double") * (F.max("b.max_y") - F.min("b.min_y")) / 9e8
    largest = F.max_by(geo.area_centre(F.col("ring"))["x"], F.struct("area", -F.col("piece")))
    nano = lambda c: F.floor(c * 1e9 + 0.26)
    return p.groupBy("body").agg(F.sum("area").alias("area"), nano(F.sum("area") / 9e8).alias("share"), nano(box).alias("box_share"), F.floor(largest * 100 + 0.26).alias("largest_x"), F.count("*").alias("pieces"))


@query(
    "self_crossings",
    f"""WITH {POLYLINES}, {RINGS}, n AS (SELECT id, count(*) AS n FROM edges GROUP BY id), c AS (SELECT a.id, a.i, b.i AS j, a.x + b.x AS sx, a.y + b.y AS sy FROM edges a JOIN edges b ON a.id = b.id AND b.i > a.i + 1 JOIN n ON n.id = a.id WHERE NOT (a.i = 1 AND b.i = n) AND ({_MEET}))
SELECT id, count(*) AS crossings, arg_min(sx, {{'i': i, 'j': j}})::DOUBLE / 2 AS x, arg_min(sy, {{'i': i, 'j': j}})::DOUBLE / 2 AS y FROM c GROUP BY id""",
)
def self_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings that cross themselves: how often, and the middle between the starts of the first two edges that meet."""
    return ln.self_crossings(rings(spark, sf_dir), 6000).select("id", "crossings", "x", "y")


_CHORD = """SELECT id, i, n, CASE WHEN y <= 1500 THEN 0 ELSE least(1, greatest(0, (1500 - y) / (y2 - y))) END AS t0,
  CASE WHEN y2 <= 1500 THEN 1 ELSE least(1, greatest(0, (1500 - y) / (y2 - y))) END AS t1 FROM s WHERE y <= 1500 OR y2 <= 1500"""


@query(
    "clip_window",
    _runs(f"SELECT d.id, d.i, d.n, greatest(d.t0, c.t0) AS t0, least(d.t1, c.t1) AS t1 FROM ({_DISK.format(cx='500::DOUBLE', cy='-300::DOUBLE', r='9000::DOUBLE')}) d JOIN ({_CHORD}) c ON c.id = d.id AND c.i = d.i WHERE d.t1 >= d.t0"),
)
def clip_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines clipped to a map's window: a disk below a chord."""

    def inside(s: Column) -> Column:
        disk, chord = geo.disk_interval(s, 500.0, -300.0, 9000.0), geo.chord_interval(s, 1500.0)
        both = F.struct(F.greatest(disk["t0"], chord["t0"]).alias("t0"), F.least(disk["t1"], chord["t1"]).alias("t1"))
        return F.when(disk.isNotNull() & chord.isNotNull() & (both["t1"] >= both["t0"]), both)

    return _hashed(ln.clip(polylines(spark, sf_dir), inside))


@query(
    "sampled_rings",
    f"WITH {POLYLINES}, {VERTICES} SELECT id, count(*) AS kept, sum(x)::BIGINT AS sum_x FROM vertices WHERE (i - 1) % greatest(1, ceil(n / 10::DOUBLE)::BIGINT) = 0 GROUP BY id",
)
def sampled_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most ten vertices of each ring, at even strides."""
    s = rings(spark, sf_dir).select("id", geo.sampled(F.col("ring"), 10).alias("s"))
    return s.select("id", F.size("s").cast("long").alias("kept"), F.aggregate("s", F.lit(0).cast("long"), lambda a, p: a + p["x"]).alias("sum_x"))


@query(
    "water_semi_join",
    f"""WITH {POLYLINES}, {RINGS}, p AS (SELECT id AS pid, line[2].x AS x, line[2].y AS y FROM polylines),
h AS (SELECT pid, e.id, count(*) FILTER (WHERE (e.y > p.y) <> (e.y2 > p.y) AND p.x::DOUBLE < (e.x2 - e.x)::DOUBLE * (p.y - e.y)::DOUBLE / nullif((e.y2 - e.y)::DOUBLE, 0) + e.x::DOUBLE) % 2 = 1 AS inside FROM p JOIN edges e ON true GROUP BY ALL)
SELECT o.pid, o.id AS body FROM h o WHERE o.inside AND o.id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM h i WHERE i.pid = o.pid AND i.id = o.id + 1 AND i.inside)""",
)
def water_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in bodies whose even rings are shores and odd ones holes: inside the shore and in no hole."""
    at = polylines(spark, sf_dir).select(F.col("id").alias("pid"), F.get("line", 1)["x"].alias("x"), F.get("line", 1)["y"].alias("y"))
    odd = F.col("id") % 2
    bodies = rings(spark, sf_dir).select("id", (F.col("id") - odd).alias("body"), (odd == 1).alias("hole"), "ring")
    return sp.points_in_areas(at, bodies, 8000)


@query("road_engraving")
def road_engraving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads of four lines a board, stroked by class and joined to one engraved area."""
    roads = _roads(spark, sf_dir).select(
        F.floor(F.col("id") / 4).alias("board"), "line", sc.round_half_up(op.road_width(F.col("road_class"), F.lit(228.6), F.lit(1.0)) * 1000).cast("long").alias("width")
    )
    return layers.road_engraving(roads).select("board", "widths", F.size("rings").alias("outlines"), "area")


@query("nested_levels")
def nested_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four nested bands of each board's elevations, at even heights."""
    v = grid(spark, sf_dir)
    low, high = F.min("v"), F.max("v")
    heights = v.groupBy("board").agg(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.floor(low + k * (high - low) / 5)).alias("t")).select("board", F.explode("t").alias("threshold"))
    return layers.nested_bands(v, heights, SIDE).select("board", "level", "threshold", "area", "outside", F.size("rings").alias("outlines"))
