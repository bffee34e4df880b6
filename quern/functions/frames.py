"""Column functions between the globe, a map's window, a board in millimetres and its grids.

Points are structs (x, y) or pairs of columns; a frame is given by plain columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.functions.scalars import lat_of, lng_of, mercator_x, mercator_y

#: Steps of Newton's method and the width of its differences.
STEPS, NUDGE = 12, 1e-6
#: Samples along a board's long side at a perimeter, their least number, the most samples of a grid, and cells around a shoreline.
LONG_SIDE, PERIMETER, LEAST_SIDE, MOST_SAMPLES, PADDING = 900, 914.4, 32, 2_000_000, 1
#: Fixed value: from the edge of a product to a symbol in its corner.
CORNER_MARGIN = 8.0


def pair(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def crop(nw: Column, ne: Column, se: Column, sw: Column) -> Column:
    """A crop of four (lng, lat) corners, with its box."""
    every = (nw, ne, se, sw)
    least, most = (lambda k: F.least(*(c[k] for c in every))), (lambda k: F.greatest(*(c[k] for c in every)))
    return F.struct(nw.alias("nw"), ne.alias("ne"), se.alias("se"), sw.alias("sw"), least("lng").alias("west"), least("lat").alias("south"), most("lng").alias("east"), most("lat").alias("north"))


def _corner(c: Column) -> Column:
    return pair(mercator_x(c["lng"]), mercator_y(c["lat"]))


def corners(box: Column) -> Column:
    """A crop's corners on the Mercator square."""
    return F.array(*(_corner(box[k]) for k in ("nw", "ne", "se", "sw")))


def _bilinear(at: Column, u: Column, v: Column, k: str) -> Column:
    a, b, c, d = (F.get(at, i)[k] for i in range(4))
    return (1 - u) * (1 - v) * a + u * (1 - v) * b + u * v * c + (1 - u) * v * d


def crop_project(df: DataFrame, at: str, lng: str, lat: str, width: float, height: float, result: str = "mm") -> DataFrame:
    """Append millimetres of points in crops with corners `at`: the inverse of the bilinear map, by Newton's method with differences, a batch of rows at a time."""
    names = [c for c in df.columns if c != result]
    corner = [F.get(F.col(at), i)[k].alias(f"_{k}{i}") for k in "xy" for i in range(4)]
    given = df.select(*names, *corner, mercator_x(F.col(lng)).alias("_qx"), mercator_y(F.col(lat)).alias("_qy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda k: batch.column(k).to_numpy(zero_copy_only=False).astype(float)
            uv = _newton([[column(f"_{k}{i}") for i in range(4)] for k in "xy"], column("_qx"), column("_qy"))
            known = pc.and_(*(pc.is_valid(batch.column(k)) for k in ("_qx", "_qy")))
            for k in range(8):
                known = pc.and_(known, pc.is_valid(batch.column(len(names) + k)))
            mm = pa.StructArray.from_arrays([pa.array(v * side, mask=~known.to_numpy(zero_copy_only=False)) for v, side in zip(uv, (width, height), strict=True)], ["x", "y"])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), mm], [*names, result])

    return given.mapInArrow(run, StructType(df.select(*names).schema.fields).add(result, StructType().add("x", "double").add("y", "double")))


def _newton(at: list[list[np.ndarray]], qx: np.ndarray, qy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) of places on the Mercator square between corners."""

    def bilinear(u: np.ndarray, v: np.ndarray, corner: list[np.ndarray]) -> np.ndarray:
        a, b, c, d = corner
        return (1 - u) * (1 - v) * a + u * (1 - v) * b + u * v * c + (1 - u) * v * d

    u, v = np.full(len(qx), 0.5), np.full(len(qx), 0.5)
    for _ in range(STEPS):
        zx, zy = (bilinear(u, v, k) for k in at)
        ux, uy = ((bilinear(u + NUDGE, v, k) - z) / NUDGE for k, z in zip(at, (zx, zy), strict=True))
        vx, vy = ((bilinear(u, v + NUDGE, k) - z) / NUDGE for k, z in zip(at, (zx, zy), strict=True))
        dx, dy = qx - zx, qy - zy
        det = ux * vy - uy * vx
        moves, det = det != 0, np.where(det != 0, det, 1)
        u, v = np.where(moves, u + (dx * vy - dy * vx) / det, u), np.where(moves, v + (ux * dy - uy * dx) / det, v)
    return u, v


def crop_unproject(at: Column, x: Column, y: Column, width: float, height: float) -> Column:
    """(lng, lat) of millimetres in a crop."""
    u, v = x / width, y / height
    return F.struct(lng_of(_bilinear(at, u, v, "x")).alias("lng"), lat_of(_bilinear(at, u, v, "y")).alias("lat"))


def map_scale(diameter_mm: Column, diameter_px: Column) -> Column:
    """Millimetres of a pixel; null unless both sizes are finite and above zero."""
    good = lambda c: (c > 0) & (c < float("inf")) & ~F.isnan(c)
    return F.when(good(diameter_mm) & good(diameter_px), diameter_mm / diameter_px)


def map_project(lng: Column, lat: Column, centre_lng: Column, centre_lat: Column, zoom: Column, tile: int, mm_per_px: Column) -> Column:
    """Millimetres of a point from the middle of a map; NaN for a point that isn't finite."""
    scale = tile * F.pow(F.lit(2.0), zoom) * mm_per_px
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    x = (mercator_x(lng) - mercator_x(centre_lng)) * scale
    y = (mercator_y(lat) - mercator_y(centre_lat)) * scale
    good = finite(lng) & finite(lat)
    return pair(F.when(good, x).otherwise(float("nan")), F.when(good, y).otherwise(float("nan")))


def board_project(lng: Column, lat: Column, centre_lng: Column, centre_lat: Column, zoom: Column, tile: int, width_mm: Column, height_mm: Column, frame_px: Column) -> Column:
    """As `map_project`, from a board's upper left corner."""
    p = map_project(lng, lat, centre_lng, centre_lat, zoom, tile, width_mm / frame_px)
    return pair(p["x"] + width_mm / 2, p["y"] + height_mm / 2)


def project_line(line: Column, project) -> Column:
    """A line of (lng, lat) through a projection of two columns."""
    return F.transform(line, lambda p: project(p["lng"], p["lat"]))


def project_rings(rings: Column, project) -> Column:
    return F.transform(rings, lambda r: project_line(r, project))


def viewport_corners(width_px: Column, height_px: Column, mm_per_px: Column) -> Column:
    w, h = width_px * mm_per_px / 2, height_px * mm_per_px / 2
    return F.struct(pair(-w, -h).alias("nw"), pair(w, -h).alias("ne"), pair(w, h).alias("se"), pair(-w, h).alias("sw"))


def working_grid(width: Column, height: Column) -> Column:
    """A board's grid (columns, rows, cell, x, y): null for a size that isn't above zero. The cell grows until the samples are few enough."""
    long = F.greatest(F.lit(float(LEAST_SIDE)), F.floor(LONG_SIDE * F.sqrt(2 * (width + height) / PERIMETER) + 0.5))
    count = lambda side, cell: F.ceil(side / cell - 1e-9) + 2
    samples = lambda cell: (count(width, cell) * count(height, cell)).cast("double")
    grow = lambda cell, _: F.when(samples(cell) > MOST_SAMPLES, cell * F.greatest(F.lit(1.001), F.sqrt(samples(cell) / MOST_SAMPLES))).otherwise(cell)
    cell = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.greatest(width, height) / long, grow)
    spec = lambda c: F.struct(
        count(width, c).alias("columns"), count(height, c).alias("rows"), c.alias("cell"), ((width - count(width, c) * c) / 2).alias("x"), ((height - count(height, c) * c) / 2).alias("y")
    )
    return F.when((width > 0) & (height > 0), F.transform(F.array(cell), spec)[0])


def terrain_grid(box: Column, cell_mm: float, least_cells: int, most_cells: int) -> Column:
    """A shoreline's grid (columns, rows, cell, x, y) with padding; null for a box without extent."""
    width, height = box["max_x"] - box["min_x"], box["max_y"] - box["min_y"]
    long = F.greatest(width, height)
    cell = F.least(F.greatest(F.lit(float(cell_mm)), long / most_cells), long / least_cells)
    spec = lambda c: F.struct(
        (F.ceil(width / c) + 2 * PADDING).alias("columns"), (F.ceil(height / c) + 2 * PADDING).alias("rows"), c.alias("cell"), (box["min_x"] - PADDING * c).alias("x"), (box["min_y"] - PADDING * c).alias("y")
    )
    return F.when(long > 0, F.transform(F.array(cell), spec)[0])


def cell_centre(spec: Column, column: Column, row: Column) -> Column:
    """The middle of a cell; column and row may be fractions, as a traced contour's are."""
    return pair(spec["x"] + (column + 0.5) * spec["cell"], spec["y"] + (row + 0.5) * spec["cell"])


def translate(rings: Column, dx: Column, dy: Column) -> Column:
    return F.transform(rings, lambda r: F.transform(r, lambda p: pair(p["x"] + dx, p["y"] + dy)))


def map_px_to_mm(x: Column, y: Column, width_px: Column, height_px: Column, px_per_mm: Column) -> Column:
    """Millimetres from the middle of a map element; NaN without a scale."""
    back = lambda p, size: F.when(px_per_mm > 0, (p - size / 2) / px_per_mm).otherwise(float("nan"))
    return pair(back(x, width_px), back(y, height_px))


def mm_to_map_px(x: Column, y: Column, width_px: Column, height_px: Column, px_per_mm: Column) -> Column:
    return pair(width_px / 2 + x * px_per_mm, height_px / 2 + y * px_per_mm)


def mm_to_container_px(x: Column, y: Column, min_x: Column, min_y: Column, offset_x: Column, offset_y: Column, scale: Column) -> Column:
    return pair(offset_x + (x - min_x) * scale, offset_y + (y - min_y) * scale)


def query_box(frame: Column, canvas: Column) -> Column:
    """The part of a frame (left, top, right, bottom) on a canvas (left, top, width, height), from the canvas's corner; null if there is none."""
    inside = lambda v, k, size: F.greatest(F.lit(0.0), F.least(canvas[size], frame[v] - canvas[k]))
    box = F.struct(inside("left", "left", "width").alias("left"), inside("top", "top", "height").alias("top"), inside("right", "left", "width").alias("right"), inside("bottom", "top", "height").alias("bottom"))
    return F.transform(F.array(box), lambda b: F.when((b["right"] > b["left"]) & (b["bottom"] > b["top"]), b))[0]


def corner_position(corner: Column, width: Column, height: Column, size: Column) -> Column:
    """The middle of a symbol in a named corner; null for another name."""
    near, right, bottom = CORNER_MARGIN + size / 2, width - CORNER_MARGIN - size / 2, height - CORNER_MARGIN - size / 2
    x = F.when(corner.isin("top-left", "bottom-left"), near).when(corner.isin("top-right", "bottom-right"), right)
    y = F.when(corner.isin("top-left", "top-right"), near).when(corner.isin("bottom-left", "bottom-right"), bottom)
    return pair(x, y)
