"""PNG images as relations of pixels, and elevation tiles as relations of samples."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.scalars import clamp, elevation

SIGNATURE = b"\x89PNG\r\n\x1a\n"
# Fixed values of the format: channels by colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def pixels(content: bytes) -> np.ndarray:
    """The pixels of an 8-bit PNG that is not interlaced, height x width x 3 (red, green, blue)."""
    if content[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, palette, head = 8, b"", None, None
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
        elif kind == b"IEND":
            break
    else:
        raise ValueError("a PNG that is cut short")
    if head is None:
        raise ValueError("a PNG without a header")
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or interlaced or colour not in CHANNELS:
        raise ValueError("a PNG of 8 bits without interlacing is needed")
    step = CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width * step + 1)
    out = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.int64)
    for y in range(height):
        line = _unfilter(int(raw[y, 0]), raw[y, 1:].astype(np.int64), above, step)
        out[y] = line
        above = line
    image = out.reshape(height, width, step)
    if colour == 3:
        return palette[image[:, :, 0]]
    return image[:, :, :3] if step >= 3 else np.repeat(image[:, :, :1], 3, axis=2)


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return (line + above) & 255
    if kind == 1:
        # Running sums along each channel.
        return (np.cumsum(line.reshape(-1, step), axis=0) & 255).reshape(-1)
    out = np.zeros_like(line)
    for i in range(len(line)):
        left, corner = (out[i - step], above[i - step]) if i >= step else (0, 0)
        if kind == 3:
            guess = (left + above[i]) >> 1
        else:
            p = left + above[i] - corner
            near = (abs(p - left), abs(p - above[i]), abs(p - corner))
            guess = (left, above[i], corner)[near.index(min(near))]
        out[i] = (line[i] + guess) & 255
    return out


def samples(tiles: DataFrame) -> DataFrame:
    """(z, x, y, r, c, elevation, clamped) for tiles (z, x, y, content) whose colours code metres; one row per pixel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, content in enumerate(batch.column("content").to_pylist()):
                image = pixels(content).astype(np.int64)
                h, w, _ = image.shape
                key = [pa.array(np.full(h * w, batch.column(k)[i].as_py(), np.int32)) for k in ("z", "x", "y")]
                place = [pa.array(np.repeat(np.arange(h, dtype=np.int32), w)), pa.array(np.tile(np.arange(w, dtype=np.int32), h))]
                colour = [pa.array(image[:, :, k].reshape(-1)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*key, *place, *colour], ["z", "x", "y", "r", "c", "red", "green", "blue"])

    coded = tiles.select("z", "x", "y", "content").mapInArrow(run, "z int, x int, y int, r int, c int, red long, green long, blue long")
    metres = elevation(F.col("red"), F.col("green"), F.col("blue"))
    return coded.select("z", "x", "y", "r", "c", clamp(metres, -11500.0, 9000.0).alias("elevation"), (~metres.between(-11500.0, 9000.0)).alias("clamped"))


def mosaic(plan: DataFrame, tiles: DataFrame, size: int = 256) -> DataFrame:
    """(r, c, elevation): the samples of a plan (z, x, y, row, column) as one raster; a tile that is missing raises an error, never leaves a hole."""
    planned = plan.join(tiles, ["z", "x", "y"], "left")
    checked = planned.withColumn("content", F.coalesce("content", F.raise_error(F.format_string("tile %d/%d/%d is missing", "z", "x", "y")).cast("binary")))
    placed = samples(checked.dropDuplicates(["z", "x", "y"])).join(plan, ["z", "x", "y"])
    return placed.select((F.col("row") * size + F.col("r")).alias("r"), (F.col("column") * size + F.col("c")).alias("c"), "elevation")


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """(z, x, y, content) from files z/x/y.png."""
    part = lambda k: F.regexp_extract("path", r"/(\d+)/(\d+)/(\d+)\.png$", k).cast("int")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(path).select(part(1).alias("z"), part(2).alias("x"), part(3).alias("y"), "content")
