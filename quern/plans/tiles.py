"""Elevation tiles as PNG files, read back as one raster."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.lenses import GRID, SIDE, grid
from quern.plans.registry import query
from quern.sources import png

_ZERO, _SPAN, _ACROSS = 8388608, 200000, 8


def encoded(rows: np.ndarray) -> bytes:
    """A PNG of height x width x 3 colours whose rows take turns with the format's row filters."""
    height, width, _ = rows.shape
    raw, above = b"", np.zeros(width * 3, np.int64)
    for y, line in enumerate(rows.reshape(height, -1).astype(np.int64)):
        left, corner = np.append(np.zeros(3, np.int64), line[:-3]), np.append(np.zeros(3, np.int64), above[:-3])
        p = left + above - corner
        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
        guess = (0, left, above, (left + above) >> 1, paeth)[y % 5]
        raw += bytes([y % 5]) + ((line - guess) & 255).astype(np.uint8).tobytes()
        above = line
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(z, x, y, content): a tile of each board's elevations, with 0 metres where it has none."""

    def draw(table: pa.Table) -> pa.Table:
        code = np.full((SIDE, SIDE), _ZERO, np.int64)
        code[table.column("r").to_numpy(), table.column("c").to_numpy()] += table.column("v").to_numpy() % _SPAN
        colours = np.stack([code >> 16, code >> 8 & 255, code & 255], axis=2)
        return pa.table([pa.array([7], pa.int32()), table.column("board").slice(0, 1).combine_chunks().cast(pa.int32()), pa.array([3], pa.int32()), pa.array([encoded(colours)])], ["z", "x", "y", "content"])

    return grid(spark, sf_dir).groupBy("board").applyInArrow(draw, "z int, x int, y int, content binary")


@query(
    "tile_mosaic",
    f"""WITH {GRID}, b AS (SELECT DISTINCT board FROM grid), a AS (SELECT board, r, c FROM b, range({SIDE}) y(r), range({SIDE}) x(c))
SELECT board // {_ACROSS} * {SIDE} + r AS r, board % {_ACROSS} * {SIDE} + c AS c, ({_ZERO} + coalesce(v, 0) % {_SPAN})::DOUBLE / 256 - 32768 AS elevation FROM a LEFT JOIN grid USING (board, r, c)""",
)
def tile_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PNG tiles of all boards, decoded and laid side by side."""
    tiles = _tiles(spark, sf_dir)
    plan = grid(spark, sf_dir).select("board").distinct()
    plan = plan.select(F.lit(7).alias("z"), F.col("board").cast("int").alias("x"), F.lit(3).alias("y"), F.floor(F.col("board") / _ACROSS).alias("row"), (F.col("board") % _ACROSS).alias("column"))
    return png.mosaic(plan, tiles, SIDE)
