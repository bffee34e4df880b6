"""Surveys matched to bodies of water by place: a deep point in the water, or an outline that covers it or lies in it for the most part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.geometry import bounds, double_area
from quern.operators import polygons as poly
from quern.operators.areas import _cells, _ray_hits, _segments
from quern.operators.bands import contour_regions
from quern.operators.graph import checkpointed

#: Fixed value: the share of the smaller of two areas that has to be common.
LEAST_SHARE = 0.5


def box_pairs(left: DataFrame, right: DataFrame, cell: int, group: list[str] | None = None) -> DataFrame:
    """(l, r): pairs of rows (id, rings) of two tables whose boxes overlap in more than an edge, of the same `group` columns if there are any.

    An equi-join on cells; a pair is taken in the first cell that both cover.
    """
    group = group or []

    def celled(df: DataFrame) -> DataFrame:
        boxed = df.select("id", *group, bounds(F.flatten("rings")).alias("b")).select("id", *group, "b.*")
        return boxed.withColumn("cx", F.explode(_cells(F.col("min_x"), F.col("max_x"), cell))).withColumn("cy", F.explode(_cells(F.col("min_y"), F.col("max_y"), cell)))

    a, b = celled(left).alias("a"), celled(right).alias("b")
    c = lambda side, k: F.col(f"{side}.{k}")
    meet = (c("a", "min_x") < c("b", "max_x")) & (c("b", "min_x") < c("a", "max_x")) & (c("a", "min_y") < c("b", "max_y")) & (c("b", "min_y") < c("a", "max_y"))
    first = (c("a", "cx") == F.floor(F.greatest(c("a", "min_x"), c("b", "min_x")) / cell)) & (c("a", "cy") == F.floor(F.greatest(c("a", "min_y"), c("b", "min_y")) / cell))
    return a.join(b, [c("a", k) == c("b", k) for k in ("cx", "cy", *group)] + [meet, first]).select(c("a", "id").alias("l"), c("b", "id").alias("r"))


def _area(rings: Column) -> Column:
    """The area of an outline and its holes, whichever way they turn."""
    sizes = F.transform(rings, lambda r: F.abs(double_area(r)))
    return (F.get(sizes, 0) * 2 - F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)) / 2


def matches(points: DataFrame, outlines: DataFrame, waters: DataFrame, cell: int, share: float = LEAST_SHARE) -> DataFrame:
    """(key, body, how, shared): the surveys of each body of water.

    `points` (key, x, y) has surveys' deep points, `outlines` (key, ring) their contours, of which the largest is a survey's outline, and `waters` (body, rings) an
    outline with holes each. A survey with a point in a body is matched by `point`; any other by `overlap`, if at least `share` of the smaller of both areas is common.
    """
    edges = _segments(waters.select("body", F.explode("rings").alias("ring")), "ring", F.col("body").alias("ring_group"))
    # A point is only held against the waters whose box covers its cell.
    celled = lambda df: df.withColumn("cx", F.explode(_cells(F.col("b.min_x"), F.col("b.max_x"), cell))).withColumn("cy", F.explode(_cells(F.col("b.min_y"), F.col("b.max_y"), cell)))
    boxes = celled(waters.select("body", bounds(F.flatten("rings")).alias("b")))
    at = points.select("key", F.monotonically_increasing_id().alias("n"), F.col("x").alias("px"), F.col("y").alias("py"), F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    at = at.join(boxes, ["cx", "cy"]).select(F.col("body").alias("group"), "key", "n", "px", "py", "cy")
    by_point = _ray_hits(at, edges, cell).groupBy("key", "n", "group").agg(F.count("*").alias("hits")).filter("hits % 2 = 1").select("key", F.col("group").alias("body")).distinct()
    by_point = checkpointed(by_point)
    largest = outlines.groupBy("key").agg(F.min(F.struct((-F.abs(double_area(F.col("ring")))).alias("minus"), "ring"))["ring"].alias("outer"))
    left = largest.select(F.col("key").alias("id"), F.array("outer").alias("rings"))
    right = waters.select(F.col("body").alias("id"), "rings")
    near = box_pairs(left, right, cell).select(F.col("l").alias("key"), F.col("r").alias("body")).join(by_point, ["key", "body"], "left_anti")
    both = near.join(left.withColumnsRenamed({"id": "key", "rings": "own"}), "key").join(right.withColumnsRenamed({"id": "body", "rings": "water"}), "body")
    # Pairs are few bytes but much work, so they are dealt to a set number of tasks.
    dealt = both.repartition(4 * waters.sparkSession.sparkContext.defaultParallelism, "key", "body")
    common = poly.boolean(dealt, "own", "water", "intersection")
    enough = common.filter((F.col("area") > 0) & (F.col("area") >= F.least(_area(F.col("own")), _area(F.col("water"))) * share))
    by_overlap = enough.select("key", "body", F.lit("overlap").alias("how"), F.col("area").alias("shared"))
    return by_point.select("key", "body", F.lit("point").alias("how"), F.lit(None).cast("double").alias("shared")).union(by_overlap)


def measured_depths(found: DataFrame, contours: DataFrame, least_area: float = 0.0) -> DataFrame:
    """(body, depth, area, rings): the depth regions of each body from the contours (key, depth, ring) of all its surveys, for depths below the shore."""
    usable = contours.filter((F.col("depth") > 0) & (F.abs(double_area(F.col("ring"))) / 2 >= least_area))
    return contour_regions(found.select("key", "body").join(usable, "key").select("body", "depth", "ring"), "body")
