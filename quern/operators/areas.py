"""Lines against areas: where lines run inside and outside of polygon sets with holes.

A set is all rings of a group, even-odd, so holes are rings like any other. Lines and rings have whole coordinates, and
every question about them is decided in whole numbers: where a vertex lies exactly on an edge, the set counts as shifted by an
infinitesimal step to the right and a smaller one upwards. So no vertex or edge is ever met twice or missed,
and inside and outside alternate along every line.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quern.functions import geometry as geo

#: Pieces of a segment shorter than this share of it are dropped.
LEAST_SHARE = 1e-12
#: Coordinates are below this, so that turns are exact in 64 bits; and how many segments meet eight times as many edges at once.
LARGEST, BLOCK = 1 << 30, 128


def _cells(lo: Column, hi: Column, cell: int) -> Column:
    return F.sequence(F.floor(lo / cell), F.floor(hi / cell))


def _segments(df: DataFrame, line: str, *keys: Column) -> DataFrame:
    """The segments (keys, i, x, y, x2, y2) of lines, without those of no length."""
    s = df.select(*keys, F.explode(geo.segments(F.col(line))).alias("s")).filter("s.x <> s.x2 or s.y <> s.y2")
    return s.select(*(k for k in s.columns if k != "s"), "s.i", "s.x", "s.y", "s.x2", "s.y2")


def _turn(ax: Column, ay: Column, dx: Column, dy: Column, px: Column, py: Column) -> Column:
    return dx * (py - ay) - dy * (px - ax)


def _ring_left(turn: Column, dx: Column, dy: Column) -> Column:
    """Whether a ring's vertex with this turn lies left of a line's segment (dx, dy), once the ring is shifted."""
    return (turn > 0) | ((turn == 0) & ((dy < 0) | ((dy == 0) & (dx > 0))))


def _line_left(turn: Column, ex: Column, ey: Column) -> Column:
    """Whether a line's vertex with this turn lies left of a ring's edge (ex, ey), once the ring is shifted."""
    return (turn > 0) | ((turn == 0) & ((ey > 0) | ((ey == 0) & (ex < 0))))


def _coordinates(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vertices (x, y) of all lines of a column, and each vertex's line and place on it, from 1."""
    at, owner, place, first = [], [], [], 0
    for chunk in column.chunks:
        sizes = np.nan_to_num(pc.list_value_length(chunk).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        points = chunk.flatten()
        xy = np.column_stack([pc.struct_field(points, k).to_numpy(zero_copy_only=False) for k in ("x", "y")])
        if xy.dtype.kind != "i" or (len(xy) and np.abs(xy).max() >= LARGEST):
            raise ValueError("a line has a coordinate that is missing, not whole or too large")
        at.append(xy.astype(np.int64))
        owner.append(np.repeat(np.arange(len(chunk)) + first, sizes))
        place.append(np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1)
        first += len(chunk)
    return np.concatenate([np.zeros((0, 2), np.int64), *at]), np.concatenate([np.zeros(0, np.int64), *owner]), np.concatenate([np.zeros(0, np.int64), *place])


def _joined(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The segments (x, y, x2, y2) of all lines of a column, without those of no length, and each one's line and place on it, from 1."""
    at, owner, place = _coordinates(column)
    s = np.concatenate([at[:-1], at[1:]], axis=1)
    real = (owner[:-1] == owner[1:]) & (s[:, :2] != s[:, 2:]).any(axis=1)
    return s[real], owner[:-1][real], place[:-1][real]


def _met(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places (segment, t), in order, at which edges cross segments. Blocks of segments meet the edges that begin before the block's end and end after its begin."""
    low, high = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
    order = np.argsort(low, kind="stable")
    e, low, top = e[order], low[order], np.maximum.accumulate(high[order])
    left, right = np.minimum(s[:, 0], s[:, 2]), np.maximum(s[:, 0], s[:, 2])
    by = np.argsort(left, kind="stable")
    at, places = [np.zeros(0, np.int64)], [np.zeros(0)]
    for k in range(0, len(s), BLOCK):
        mine = by[k : k + BLOCK]
        stop = int(np.searchsorted(low, right[mine].max(), "right"))
        for j in range(int(np.searchsorted(top, left[mine[0]])), stop, BLOCK * 8):
            x, y, x2, y2 = (s[mine, c][:, None] for c in range(4))
            px, py, qx, qy = (e[j : min(stop, j + BLOCK * 8), c] for c in range(4))
            dx, dy, ex, ey = x2 - x, y2 - y, qx - px, qy - py
            ring = [_ring_left(_turn(x, y, dx, dy, a, b), dx, dy) for a, b in ((px, py), (qx, qy))]
            turns = [_turn(px, py, ex, ey, a, b) for a, b in ((x, y), (x2, y2))]
            line = [_line_left(t, ex, ey) for t in turns]
            i, m = np.nonzero((ring[0] != ring[1]) & (line[0] != line[1]))
            # The segment's ends lie on either side of the edge, in proportion to their turns.
            at.append(mine[i])
            places.append(turns[0][i, m].astype(float) / (turns[0] - turns[1])[i, m].astype(float))
    at, places = np.concatenate(at), np.concatenate(places)
    order = np.lexsort((places, at))
    return at[order], places[order]


def _started(x: np.ndarray, y: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Whether points lie inside, by the edges on a ray to their right. Shifted upwards, a vertex at the ray's height is above it."""
    odd = np.zeros(len(x), bool)
    e = e[e[:, 1] != e[:, 3]]
    for k in range(0, len(x), BLOCK):
        a, b = x[k : k + BLOCK, None], y[k : k + BLOCK, None]
        for j in range(0, len(e), BLOCK * 8):
            px, py, qx, qy = e[j : j + BLOCK * 8].T
            before = _line_left(_turn(px, py, qx - px, qy - py, a, b), qx - px, qy - py) == (qy > py)
            odd[k : k + BLOCK] ^= (((py >= b) != (qy >= b)) & before).sum(axis=1) % 2 == 1
    return odd


def _cut(lines: pa.Table, rings: pa.Table) -> dict[str, np.ndarray]:
    """The pieces of a group's lines along every line: `of`, the line's row, and i, t0, t1, inside, x0, y0, x1, y1."""
    s, of, i = _joined(lines.column("line"))
    e, _, _ = _joined(rings.column("ring"))
    at, t = _met(s, e)
    n = np.bincount(at, minlength=len(s))
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(s) else np.zeros(0, np.int64)
    line = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(s))))
    crossed = np.cumsum(n) - n
    before = crossed - crossed[first][line] + _started(s[first, 0], s[first, 1], e)[line]
    # A segment with n places has n + 1 pieces.
    seg = np.repeat(np.arange(len(s)), n + 1)
    k = np.arange(len(seg)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
    t0, t1 = np.zeros(len(seg)), np.ones(len(seg))
    t0[k > 0], t1[k < n[seg]] = t, t
    out = {"of": of[seg], "i": i[seg].astype(np.int32), "t0": t0, "t1": t1, "inside": (before[seg] + k) % 2 == 1}
    # A segment's ends are its vertices, without rounding.
    for name, share in (("0", t0), ("1", t1)):
        for c, axis in enumerate("xy"):
            a, b = s[seg, c], s[seg, c + 2]
            out[axis + name] = np.where(share == 1, b.astype(float), a.astype(float) + (b - a).astype(float) * share)
    held = t1 - t0 >= LEAST_SHARE
    return {name: v[held] for name, v in out.items()}


def in_groups(lines: DataFrame, rings: DataFrame, group: str, made: Callable[[pa.Table, dict[str, np.ndarray]], dict[str, pa.Array | np.ndarray]], schema: StructType) -> DataFrame:
    """`made` of each group's lines (group, id, line, ..) and their pieces. Lines and rings are shuffled once, as they are; what a group holds is bounded by the capture limits.

    Pieces and what follows from them are many times the lines, so they are made in the group and never shuffled.
    """

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = made(left, _cut(left, right)) if left.num_rows else {}
        return pa.table([pa.array(columns[f.name], types[f.name]) if f.name in columns else pa.nulls(0, types[f.name]) for f in schema], names=schema.names)

    types = {f.name: f.type for f in to_arrow_schema(schema)}
    given = rings.select(F.col(group).alias("_group"), "ring").filter("_group is not null")
    return lines.filter(F.size("line") >= 2).groupBy(group).cogroup(given.groupBy("_group")).applyInArrow(work, schema)


def _ray_hits(at: DataFrame, edges: DataFrame, cell: int) -> DataFrame:
    """Points (group, px, py, cy, ..) joined with the edges (ring_group, x, y, x2, y2, ..) of their group that a ray to their right meets, by rows of cells."""
    edges = edges.filter("y <> y2").withColumn("row", F.explode(_cells(F.least("y", "y2"), F.greatest("y", "y2"), cell)))
    near = at.join(edges, (F.col("group") == F.col("ring_group")) & (F.col("cy") == F.col("row")))
    ex, ey = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    # Shifted upwards, a vertex at the ray's height is above it.
    spans = (F.col("y") >= F.col("py")) != (F.col("y2") >= F.col("py"))
    before = _line_left(_turn(F.col("x"), F.col("y"), ex, ey, F.col("px"), F.col("py")), ex, ey) == (ey > 0)
    return near.filter(spans & before)


def rings_around(points: DataFrame, rings: DataFrame, cell: int) -> DataFrame:
    """(group, pid, id): the rings (group, id, ring) around points (group, pid, px, py) of their group."""
    edges = _segments(rings, "ring", F.col("group").alias("ring_group"), F.col("id").alias("id"))
    hits = _ray_hits(points.withColumn("cy", F.floor(F.col("py") / cell)), edges, cell)
    return hits.groupBy("group", "pid", "id").agg(F.count("*").alias("n")).filter("n % 2 = 1").drop("n")


def pieces(lines: DataFrame, rings: DataFrame, cell: int = 0, group: str = "board") -> DataFrame:
    """(group, id, i, t0, t1, inside, x0, y0, x1, y1): the segments of lines, cut where the group's rings cross them. `cell` has no effect: a group meets as arrays."""
    schema = StructType([lines.schema[group], lines.schema["id"]]).add("i", "integer").add("t0", "double").add("t1", "double").add("inside", "boolean")
    for k in ("x0", "y0", "x1", "y1"):
        schema = schema.add(k, "double")
    return in_groups(lines.select(group, "id", "line"), rings, group, lambda table, cut: {c: table.column(c).take(pa.array(cut["of"])).combine_chunks() for c in (group, "id")} | cut, schema)


RUN = "run long, inside boolean, first int, t0 double, last int, t1 double, length double, starts boolean, ends boolean, line array<struct<x: double, y: double>>"


def run_columns(cut: dict[str, np.ndarray]) -> dict[str, pa.Array | np.ndarray]:
    """The longest stretches of lines inside or outside, from `_cut`: RUN's columns, `of`, and `piece`, the first piece of each."""
    of, inside = cut["of"], cut["inside"]
    turns = np.append(True, of[1:] != of[:-1])[: len(of)]
    new = turns | np.append(True, inside[1:] != inside[:-1])[: len(of)]
    a = np.flatnonzero(new)
    n = np.diff(np.append(a, len(of)))
    z = a + n - 1
    opens = turns[a]
    number = np.arange(len(a)) - np.maximum.accumulate(np.where(opens, np.arange(len(a)), 0)) + 1
    size = np.sqrt((cut["x1"] - cut["x0"]) ** 2 + (cut["y1"] - cut["y0"]) ** 2)
    vertex = np.repeat(np.arange(len(a)), n) + np.arange(len(of)) + 1
    xy = []
    for k in "xy":
        v = np.empty(len(of) + len(a))
        v[vertex], v[a + np.arange(len(a))] = cut[f"{k}1"], cut[f"{k}0"][a]
        xy.append(pa.array(v))
    ends = np.append(opens[1:], True)[: len(a)]
    return {
        "of": of[a], "piece": a, "run": number, "inside": inside[a], "first": cut["i"][a], "t0": cut["t0"][a], "last": cut["i"][z], "t1": cut["t1"][z], "length": np.add.reduceat(size, a) if len(a) else size,
        "starts": opens, "ends": ends, "line": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n + 1)).astype(np.int32)), pa.StructArray.from_arrays(xy, ["x", "y"])),
    }


def runs(cut: DataFrame, group: str = "board") -> DataFrame:
    """(group, id, run, inside, first, t0, last, t1, length, starts, ends, line) of `pieces`: the longest stretches of lines inside or outside.

    `starts` and `ends` tell whether a run has the line's first and last place; runs count from 1.
    """
    order = Window.partitionBy(group, "id").orderBy("i", "t0")
    new = F.when(F.lag("inside").over(order) == F.col("inside"), 0).otherwise(1)
    numbered = cut.withColumn("new", new).withColumn("run", F.sum("new").over(order)).withColumn("runs", F.max("run").over(Window.partitionBy(group, "id")))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    place = F.struct("i", "t0")
    parts = F.array_sort(F.collect_list(F.struct("i", "t0", "x1", "y1")))
    out = numbered.groupBy(group, "id", "run").agg(
        F.first("inside").alias("inside"), F.min("i").alias("first"), F.min_by("t0", place).alias("t0"), F.max("i").alias("last"), F.max_by("t1", place).alias("t1"),
        F.sum(F.sqrt(dx * dx + dy * dy)).alias("length"), F.min_by(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), place).alias("start"), F.max("runs").alias("runs"), parts.alias("parts"),
    )
    line = F.concat(F.array("start"), F.transform("parts", lambda p: F.struct(p["x1"].alias("x"), p["y1"].alias("y"))))
    return out.withColumns({"starts": F.col("run") == 1, "ends": F.col("run") == F.col("runs"), "line": line}).drop("runs", "parts", "start")


def stretches(lines: DataFrame, rings: DataFrame, group: str = "board") -> DataFrame:
    """`runs` of lines and rings, made in one group without a shuffle of pieces."""
    schema = StructType([lines.schema[group], lines.schema["id"], *StructType.fromDDL(RUN).fields])

    def made(table: pa.Table, cut: dict[str, np.ndarray]) -> dict[str, pa.Array | np.ndarray]:
        out = run_columns(cut)
        return {c: table.column(c).take(pa.array(out["of"])).combine_chunks() for c in (group, "id")} | out

    return in_groups(lines.select(group, "id", "line"), rings, group, made, schema)


def lines_in_areas(lines: DataFrame, rings: DataFrame, cell: int = 0, group: str = "board") -> DataFrame:
    """`stretches` inside the group's rings: the lines clipped to the area. `cell` has no effect."""
    return stretches(lines, rings, group).filter("inside")
