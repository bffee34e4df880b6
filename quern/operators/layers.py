"""Layers made from polygon kernels: engraved roads and nested bands of elevation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.functions.settings import SAGITTA
from quern.operators import contours as ct
from quern.operators import polygons as poly
from quern.operators import rings as rg
from quern.operators.bands import level_rings


def road_engraving(roads: DataFrame, least_area: float = 62_500.0) -> DataFrame:
    """(board, area, rings, widths): each board's roads as one engraved area, in micrometres.

    `roads` has board, line and width. Roads are stroked with caps as fine as their width asks for, and the
    strokes of all widths are joined. Holes and specks under `least_area` go. A board's roads are bounded by the capture limits, and meet in one group.
    """
    schema = StructType([roads.schema["board"]]).add("area", "double").add("rings", poly._RINGS).add("widths", "long")

    def engrave(table: pa.Table) -> pa.Table:
        lines = [r[0] for chunk in table.column("_set").chunks for r in poly.ring_sets(chunk)]
        # In one order, whichever way the rows came.
        each = sorted(zip(table.column("width").to_pylist(), lines, strict=True), key=lambda road: (road[0], road[1].tolist()))
        shapes = [s for width, line in each for s in poly.stroke_shapes([line], width / 2, min(20.0, max(0.1, width / 2 * SAGITTA)))]
        _, found = rg.united(rg.packed([np.floor(s * 1000 + 0.5).astype(np.int64) for s in shapes]), 1000)
        areas = [poly.signed_area(r) for r in found]
        kept = [k for k, area in enumerate(areas) if abs(area) >= least_area]
        columns = [table.column("board").slice(0, 1).combine_chunks(), pa.array([float(sum(areas[k] for k in kept))]), poly._lists([[found[k] for k in kept]]), pa.array([len({width for width, _ in each})])]
        return pa.table(columns, names=schema.names)

    # Rows are few bytes but much work, so boards are dealt to a set number of tasks.
    spark = roads.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return roads.select("board", "width", F.array("line").alias("_set")).repartition(tasks, "board").groupBy("board").applyInArrow(engrave, schema)


def nested_bands(grid: DataFrame, thresholds: DataFrame, side: int, cell: int = 1000) -> DataFrame:
    """(board, level, threshold, area, outside, rings): the region at or above each threshold, clipped to the level below it.

    `thresholds` has board and threshold; levels count from 1 by rising threshold. `outside` is what the clipping took off, which should be next to nothing.
    Cells are `cell` micrometres wide. Levels are traced and clipped in a board's group, so samples are shuffled and rings never are.
    """
    schema = StructType.fromDDL("board long, level int, threshold long, area double, outside double").add("rings", poly._RINGS)

    def made(board: int, lines: dict[int, list]) -> dict[str, object]:
        rows, rings, below = [], [], None
        for threshold, found in lines.items():
            if found:
                own, _, _ = level_rings(found, cell)
                area, outside, inside, _ = rg.clipped(own, own if below is None else below, cell)
                rows.append((board, len(rows) + 1, threshold, area, outside))
                rings.append(inside)
                below = own
        return dict(zip(schema.names, [list(c) for c in zip(*rows, strict=True)] or [[]] * 5, strict=False)) | {"rings": poly._lists(rings)}

    return ct.in_boards(grid, thresholds, made, schema, side)
