"""The least width of material around lines: stations along each line and the edge nearest to any of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.areas import _segments

#: The distance between stations, and what is left out at either end: a share of the line, and that much at most (micrometres).
STEP, END_SHARE, END_MOST = 250, 0.1, 2000.0


def stations(lines: DataFrame, step: int = STEP, group: str = "board") -> DataFrame:
    """(group, id, px, py): places every `step` along each segment of lines (group, id, line), without those near the line's ends."""
    s = _segments(lines, "line", F.col(group), F.col("id"))
    dx, dy = (F.col("x2") - F.col("x")).cast("double"), (F.col("y2") - F.col("y")).cast("double")
    whole = Window.partitionBy(group, "id")
    s = s.withColumn("size", F.sqrt(dx * dx + dy * dy))
    s = s.withColumns({"walked": F.coalesce(F.sum("size").over(whole.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "length": F.sum("size").over(whole)})
    s = s.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / step) - 1))).withColumn("d", F.col("k") * step)
    at, margin = F.col("walked") + F.col("d"), F.least(F.col("length") * END_SHARE, F.lit(END_MOST))
    t = F.col("d") / F.col("size")
    return s.filter((at >= margin) & (at <= F.col("length") - margin)).select(group, "id", (F.col("x") + dx * t).alias("px"), (F.col("y") + dy * t).alias("py"))


def _distance() -> Column:
    """From (px, py) to the edge (x, y, x2, y2)."""
    dx, dy = (F.col("x2") - F.col("x")).cast("double"), (F.col("y2") - F.col("y")).cast("double")
    rx, ry = F.col("px") - F.col("x"), F.col("py") - F.col("y")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (rx * dx + ry * dy) / (dx * dx + dy * dy)))
    ex, ey = F.col("px") - (F.col("x") + t * dx), F.col("py") - (F.col("y") + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def least_widths(lines: DataFrame, rings: DataFrame, reach: int, step: int = STEP, group: str = "board") -> DataFrame:
    """(group, id, width): twice the least distance of a line's stations from the edges of its group's rings (group, ring); 0 without stations or edges.

    A group's lines and rings are bounded by the capture limits, so its stations meet its edges in one equi-join, and an edge is one row however large its box is.
    Edges are many more than Spark takes from the size of the table, so the join is told to shuffle and not to broadcast them. `reach` changes no result: it is where
    a search by rounds of cells would begin.
    """
    edges = _segments(rings, "ring", F.col(group).alias("g")).select("g", "x", "y", "x2", "y2").distinct()
    near = stations(lines, step, group).join(edges.hint("shuffle_hash"), F.col(group) == F.col("g"))
    best = near.groupBy(group, "id").agg(F.min(_distance()).alias("distance"))
    return lines.select(group, "id").join(best, [group, "id"], "left").select(group, "id", F.coalesce(F.col("distance") * 2, F.lit(0.0)).alias("width"))
