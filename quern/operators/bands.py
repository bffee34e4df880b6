"""Rings shaped for cutting: simplified and smoothed as far as no two of a level cross, holes in their outlines, and levels within each other.

Rings have whole coordinates and repeat their first vertex at the end. Outlines turn one way (a positive area) and holes the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from quern.functions.geometry import double_area
from quern.operators import contours as ct
from quern.operators import polygons as poly
from quern.operators import rings as rg
from quern.operators.areas import rings_around
from quern.operators.graph import checkpointed

_RINGS = ArrayType(ArrayType(StructType().add("x", LongType()).add("y", LongType())))
#: Simplification is tried at the tolerance and at half of it, a quarter and so on.
RETRIES = 4


def kept_vertices(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices of an open line stay: the ends, and of each stretch the farthest one from its chord while it is farther than the tolerance."""
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    stack = [(0, len(p) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d, q = p[b] - p[a], p[a + 1 : b] - p[a]
        t = np.clip((q @ d) / (d @ d), 0, 1) if d @ d else np.zeros(len(q))
        far = ((q - t[:, None] * d) ** 2).sum(axis=1)
        k = int(far.argmax())
        if far[k] > tolerance * tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def simplified_ring(ring: np.ndarray, tolerance: float, turned: bool = False) -> np.ndarray:
    """A ring with fewer vertices; the ring itself where less than a triangle would be left.

    It is cut open at its first vertex or, if `turned`, at the one farthest from that, which then both begins and ends the line.
    """
    p = ring[:-1]
    if tolerance <= 0 or len(p) < 4:
        return ring
    if not turned:
        out = p[kept_vertices(p, tolerance)]
        return np.concatenate([out, out[:1]]) if len(out) > 2 else ring
    p = np.roll(p, -int(((p - p[0]) ** 2).sum(axis=1).argmax()), axis=0)
    closed = np.concatenate([p, p[:1]])
    out = closed[kept_vertices(closed, tolerance)]
    return out if len(out) > 3 else ring


def smoothed_ring(ring: np.ndarray) -> np.ndarray:
    """Every corner cut at a quarter of its edges."""
    p = ring[:-1]
    if len(p) < 3:
        return ring
    q = np.roll(p, -1, axis=0)
    out = np.stack([0.75 * p + 0.25 * q, 0.25 * p + 0.75 * q], axis=1).reshape(-1, 2)
    return np.concatenate([out, out[:1]])


def _whole(ring: np.ndarray) -> np.ndarray:
    """Whole coordinates without repeated vertices."""
    out = np.floor(ring + 0.5)
    return out[np.append(True, (out[1:] != out[:-1]).any(axis=1))] if len(out) else out


def ring_versions(ring: np.ndarray, tolerance: float, smooth: bool) -> list[np.ndarray]:
    """A ring as it is, simplified at ever larger tolerances, and smoothed: the versions to step back through."""
    return [xy for xy, _ in rg.versions(rg.packed([ring]), tolerance, smooth, RETRIES)]


def _mapped(df: DataFrame, ring: str, result: str, f) -> DataFrame:
    """Append `result`, a list of rings that `f` makes of each ring."""
    names = [c for c in df.columns if c != result]
    schema = StructType(list(df.select(*names).schema.fields)).add(result, _RINGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [f(rings[0]) if rings else [] for rings in poly.ring_sets(batch.column(len(names)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), poly._lists(made)], [*names, result])

    return df.select(*names, F.array(ring).alias("_set")).mapInArrow(run, schema)


def simplified_rings(rings: DataFrame, tolerance: float, turned: bool = True) -> DataFrame:
    """`rings` with `ring` simplified; rings of no area go."""
    out = _mapped(rings, "ring", "_made", lambda r: [_whole(simplified_ring(r, tolerance, turned))]).withColumn("ring", F.get("_made", 0)).drop("_made")
    return out.filter(double_area(F.col("ring")) != 0)


def _kinds(stage: np.ndarray, last: int, smooth: bool) -> list[str]:
    return ["raw" if s == 0 else "smoothed" if smooth and s == last else "simplified" for s in stage.tolist()]


def shaped_rings(rings: DataFrame, tolerance: float, smooth: bool, cell: int) -> DataFrame:
    """(group, id, stage, kind, ring, crosses): for each ring (group, id, ring) the most processed version with which its group has no crossings.

    Every ring starts with its last version that turns as the ring itself does. In each round the rings that cross another or themselves step
    back by one version. Rings that cross in raw form have `crosses`: nothing is left to step back to.
    A group's rings, which the capture limits bound, meet as arrays in one task: they are shuffled once, and versions and edges never are.
    """
    schema = StructType([rings.schema["group"], rings.schema["id"]]).add("stage", "integer").add("kind", "string").add("ring", _RINGS.elementType).add("crosses", "boolean")

    def shape(table: pa.Table) -> pa.Table:
        raw = [r[0] for chunk in table.column("_set").chunks for r in poly.ring_sets(chunk)]
        made = rg.versions(rg.packed(raw), tolerance, smooth, RETRIES)
        now, stage, crosses = rg.settled(made, cell)
        columns = [table.column("group"), table.column("id"), pa.array(stage, pa.int32()), pa.array(_kinds(stage, len(made) - 1, smooth)), poly._lists([rg.unpacked(now)])[0].values, pa.array(crosses)]
        return pa.table(columns, names=schema.names)

    return rings.filter("ring is not null").select("group", "id", F.array("ring").alias("_set")).groupBy("group").applyInArrow(shape, schema)


def level_rings(lines: list[tuple[bool, np.ndarray, np.ndarray]], scale: int) -> tuple[rg.Packed, rg.Packed, np.ndarray]:
    """(rings, exact, ids) of a level's contour lines: rings of an area in whole units, `scale` a cell, the same before rounding, and their numbers.

    What is at or above the level lies to the left of every edge, so outlines have positive areas.
    """
    exact = rg.packed([scale * np.column_stack([np.append(x, x[0]), np.append(y, y[0])])[::-1] for _, x, y in lines])
    xy = np.floor(exact[0] + 0.5).astype(np.int64)
    ids = np.flatnonzero(rg.double_areas((xy, exact[1])) != 0)
    return rg.taken((xy, exact[1]), ids), rg.taken(exact, ids), ids


def shaped_levels(grid: DataFrame, thresholds: DataFrame, side: int, tolerance: float, smooth: bool, cell: int, scale: int = 1000, least_hole: float = 250_000.0, least: float = 250_000.0) -> DataFrame:
    """(board, threshold, id, stage, kind, ring, crosses, parent, filled, pieces, area): the contour rings of each level as `shaped_rings`, and the level that they make.

    A hole has `parent`, the outline directly around it. The rings before simplification decide that, so that shaping changes no hole's outline. A hole under `least_hole` is `filled`.
    Outlines with their other holes are clipped to the level below, and the first level to the board, which ends half a cell beyond its outer samples. An outline has `pieces`, what
    is left of it in connected pieces of `least` or more, and their `area`, in square units; smaller ones go, and are not in the level that the next one is clipped to.
    """
    schema = StructType.fromDDL("board long, threshold long, id long, stage int, kind string").add("ring", _RINGS.elementType).add("crosses", "boolean").add("parent", "long").add("filled", "boolean").add("pieces", "long").add("area", "double")
    a, b = -scale // 2, side * scale - scale // 2
    board_ring = rg.packed([np.array([(a, a), (b, a), (b, b), (a, b), (a, a)], np.int64)])

    def made(board: int, lines: dict[int, list]) -> dict[str, object]:
        out = {name: [] for name in schema.names}
        shaped, below = [], board_ring
        for threshold, found in lines.items():
            raw, exact, ids = level_rings(found, scale)
            done = rg.versions(raw, tolerance, smooth, RETRIES)
            now, stage, crosses = rg.settled(done, cell)
            sizes = rg.double_areas(exact)
            parent = rg.parents(exact, sizes, scale)
            hole = sizes <= 0
            if (parent[hole] < 0).any():
                raise ValueError("a hole has no outline around it")
            filled = hole & (np.abs(rg.double_areas(now)) < 2 * least_hole)
            pieces, area, below = _clipped_level(now, np.flatnonzero(~filled), np.where(hole, parent, np.arange(len(ids))), below, scale, least)
            shaped += rg.unpacked(now)
            out["board"] += [board] * len(ids)
            out["threshold"] += [threshold] * len(ids)
            out["kind"] += _kinds(stage, len(done) - 1, smooth)
            for name, values, told in (("id", ids, None), ("stage", stage, None), ("crosses", crosses, None), ("parent", ids[parent] if len(ids) else ids, hole), ("filled", filled, hole), ("pieces", pieces, ~hole), ("area", area, ~hole)):
                out[name] += [v if t else None for v, t in zip(values.tolist(), told.tolist(), strict=True)] if told is not None else values.tolist()
        return out | {"ring": poly._lists([shaped])[0].values}

    return ct.in_boards(grid, thresholds, made, schema, side)


def _clipped_level(now: rg.Packed, which: np.ndarray, outline: np.ndarray, below: rg.Packed, cell: int, least: float) -> tuple[np.ndarray, np.ndarray, rg.Packed]:
    """(pieces, area, level): of each ring's outline what lies in the level below, in pieces of `least` or more; `which` rings make up the level, and `outline` has each ring's outline."""
    pieces, total = np.zeros(len(outline), np.int64), np.zeros(len(outline))
    own = rg.taken(now, which)
    _, _, rings, edge = rg.clipped(own, below, cell)
    level = rg.whole(rg.packed(rings))
    sizes = rg.double_areas(level)
    parent = rg.parents(level, sizes, cell)
    area = np.where(sizes > 0, sizes, 0) / 2
    inner = np.flatnonzero(parent >= 0)
    np.add.at(area, parent[inner], sizes[inner] / 2)
    # A piece's outline is known by an edge that it shares, or else by the rings around it.
    of = np.append(np.repeat(which, np.maximum(np.diff(own[1]) - 1, 0)), -1)[edge]
    outer = np.flatnonzero(sizes > 0)
    alone = outer[of[outer] < 0]
    first = level[0][level[1][:-1][alone]]
    of[alone] = np.append(which, -1)[rg.around(first[:, 0], first[:, 1], own, rg.double_areas(own), cell)]
    kept = outer[(area[outer] >= least) & (of[outer] >= 0)]
    np.add.at(pieces, outline[of[kept]], 1)
    np.add.at(total, outline[of[kept]], area[kept])
    stays = np.zeros(len(sizes), bool)
    stays[kept] = True
    stays |= np.append(stays, False)[parent]
    return pieces, total, rg.taken(level, np.flatnonzero(stays))


def level_hole_parents(grid: DataFrame, thresholds: DataFrame, side: int, scale: int = 1000) -> DataFrame:
    """(board, threshold, id, parent): for each hole of the contours the outline directly around it."""

    def made(board: int, lines: dict[int, list]) -> dict[str, object]:
        out = {name: [] for name in schema.names}
        for threshold, found in lines.items():
            _, exact, ids = level_rings(found, scale)
            sizes = rg.double_areas(exact)
            holes = np.flatnonzero(sizes <= 0)
            parent = rg.parents(exact, sizes, scale)[holes]
            out["board"] += [board] * len(holes)
            out["threshold"] += [threshold] * len(holes)
            out["id"] += ids[holes].tolist()
            out["parent"] += [ids[p].item() if p >= 0 else None for p in parent.tolist()]
        return out

    schema = StructType.fromDDL("board long, threshold long, id long, parent long")
    return ct.in_boards(grid, thresholds, made, schema, side)


def hole_parents(rings: DataFrame, cell: int) -> DataFrame:
    """(group, id, parent): for each hole of (group, id, ring) the smallest outline of its group around its first vertex; null if there is none."""
    sized = checkpointed(rings.select("group", "id", "ring", double_area(F.col("ring")).alias("area")))
    first = F.get("ring", 0)
    holes = sized.filter("area <= 0").select("group", F.col("id").alias("pid"), first["x"].alias("px"), first["y"].alias("py"))
    outlines = sized.filter("area > 0")
    around = rings_around(holes, outlines, cell).join(outlines.select("group", "id", "area"), ["group", "id"])
    best = around.groupBy("group", "pid").agg(F.min(F.struct("area", "id"))["id"].alias("parent"))
    return holes.join(best, ["group", "pid"], "left").select("group", F.col("pid").alias("id"), "parent")


def polygons_of(rings: DataFrame, cell: int, least_hole: float = 0.0) -> DataFrame:
    """(group, id, rings, area): each outline with the holes directly in it that are large enough; `area` is without the holes.

    A hole without an outline around it is an error of the rings, and raises one.
    """
    holes = hole_parents(rings, cell)
    sized = rings.select("group", "id", "ring", (double_area(F.col("ring")) / 2).alias("area"))
    inner = holes.join(sized, ["group", "id"]).filter(F.col("parent").isNull() | (-F.col("area") >= least_hole))
    lost = F.when(F.col("parent").isNull(), F.raise_error(F.lit("a hole has no outline around it"))).otherwise(F.col("parent"))
    inner = inner.select("group", lost.alias("owner"), F.lit(1).alias("k"), "id", "ring", "area")
    outer = sized.filter("area > 0").select("group", F.col("id").alias("owner"), F.lit(0).alias("k"), "id", "ring", "area")
    # An outline and its holes are one feature, which the capture limits bound.
    both = outer.union(inner).groupBy("group", "owner").agg(F.array_sort(F.collect_list(F.struct("k", "id", "ring"))).alias("r"), F.sum("area").alias("area"))
    return both.select("group", F.col("owner").alias("id"), F.transform("r", lambda x: x["ring"]).alias("rings"), "area")


def components_of(sets: DataFrame, key: str, cell: int, least: float = 0.0, rings: str = "rings") -> DataFrame:
    """(group, id, rings, area): the connected pieces of each row's polygon set, outlines with their holes, from an area of `least` on."""
    each = sets.select(F.col(key).alias("group"), F.posexplode(rings).alias("id", "ring"))
    return polygons_of(each, cell).filter(F.col("area") >= least)


def enforced(levels: DataFrame, container: DataFrame, margin: float = 3.0, noise: float = 1000.0, sliver: float = 10_000.0) -> DataFrame:
    """(board, level, outside, verdict, rings, area): each level (board, level, rings) against the one before it, and the first against its board's container (board, rings).

    What lies beyond the other grown by `margin` is measured: up to `noise` (square micrometres) it passes, up to `sliver` it is trimmed off, and more is a
    `breach`, which leaves the level as it is.
    """
    order = Window.partitionBy("board").orderBy("level")
    chain = levels.select("board", "level", F.col("rings").alias("own")).withColumn("below", F.lag("own").over(order))
    chain = chain.join(container.select("board", F.col("rings").alias("frame")), "board").select("board", "level", "own", F.coalesce("below", "frame").alias("outer"))
    chain = chain.repartition(4 * levels.sparkSession.sparkContext.defaultParallelism, "board", "level")
    grown = poly.buffered(chain, "outer", margin, result="grown").drop("area")
    beyond = poly.boolean(grown, "own", "grown", "difference", "beyond").withColumnRenamed("area", "outside").drop("grown", "beyond")
    verdict = F.when(F.col("outside") <= noise, "passes").when(F.col("outside") <= sliver, "trimmed").otherwise("breach")
    told = checkpointed(beyond.withColumn("verdict", verdict))
    trimmed = poly.boolean(told.filter("verdict = 'trimmed'"), "own", "outer", "intersection").select("board", "level", "outside", "verdict", "rings")
    other = told.filter("verdict <> 'trimmed'").select("board", "level", "outside", "verdict", F.col("own").alias("rings"))
    area = F.aggregate("rings", F.lit(0).cast("long"), lambda a, r: a + double_area(r)) / 2
    return other.union(trimmed).withColumn("area", area)


def contour_regions(rings: DataFrame, key: str = "body") -> DataFrame:
    """(key, depth, area, rings): for each depth of a body the region at least as deep.

    `rings` has the key, depth and ring. Equal rings count once; rings of one depth are even-odd, as a ring in another is a hump; and a depth's
    region holds those of all greater depths. All depths come from one decomposition of the plane. A body's rings are bounded by the capture limits.
    """
    once = rings.select(key, "depth", "ring").distinct()
    schema = StructType([rings.schema[key], rings.schema["depth"]]).add("area", "double").add("rings", _RINGS)
    sets = once.groupBy(key, "depth").agg(F.array_sort(F.collect_list("ring")).alias("rings"))

    def sweep(table: pa.Table) -> pa.Table:
        order = np.argsort(-table.column("depth").to_numpy(), kind="stable")
        layers = [poly.edges_of(s) for chunk in table.column("rings").chunks for s in poly.ring_sets(chunk)]
        found = poly.running_unions([layers[k] for k in order])
        depths = table.column("depth").combine_chunks().take(pa.array(order))
        names = pa.array([table.column(key)[0].as_py()] * len(order), table.schema.field(key).type)
        return pa.table([names, depths, pa.array([poly.area(t) for t in found], pa.float64()), poly._lists([poly.rings_of(t) for t in found])], [key, "depth", "area", "rings"])

    return sets.groupBy(key).applyInArrow(sweep, schema).filter("area > 0")
