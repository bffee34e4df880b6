"""Polygon kernels: union, intersection, difference and offsets, as Arrow tasks over rows.

A polygon set is an array of closed rings of (x, y) in micrometres, even-odd. The kernel cuts the plane into
slabs at every vertex and crossing; inside a slab edges don't meet, so the set is a row of
trapezoids there, and a Boolean of two sets is decided trapezoid by trapezoid. Areas are exact up to rounding of the crossings.
The trapezoids' sides are then stitched to rings in whole micrometres, outer ones counter-clockwise and holes clockwise (as y goes up), so a result is
a polygon set again: kernels can be chained, and results written out.
Rows are independent; each holds the rings of one feature, which the capture limits bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import acos, atan2, ceil, cos, floor, hypot, pi, sin

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from quern.functions.settings import SAGITTA

RINGS = "array<array<struct<x: long, y: long>>>"
#: Vertices of results that a kernel holds before it hands them on.
MOST_HELD = 200_000
_RINGS = ArrayType(ArrayType(StructType().add("x", LongType()).add("y", LongType())))
OPERATIONS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "union": lambda a, b: a | b,
    "intersection": lambda a, b: a & b,
    "difference": lambda a, b: a & ~b,
    "xor": lambda a, b: a ^ b,
}


def edges_of(rings: list) -> np.ndarray:
    """The edges (x, y, x2, y2) of rings of (x, y) pairs that are not level."""
    out = [np.column_stack([r[:-1], r[1:]]) for r in (np.asarray(ring, float).reshape(-1, 2) for ring in rings) if len(r) > 1]
    e = np.concatenate(out) if out else np.zeros((0, 4))
    return e[e[:, 1] != e[:, 3]]


def _levels(e: np.ndarray) -> np.ndarray:
    """The heights of all vertices and crossings."""
    ys = [e[:, 1], e[:, 3]]
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    order = np.argsort(low, kind="stable")
    e, low, high = e[order], low[order], high[order]
    # Edges whose boxes are apart don't cross; the boxes are wider than rounding.
    left, right = np.minimum(e[:, 0], e[:, 2]) - 1e-3, np.maximum(e[:, 0], e[:, 2]) + 1e-3
    both = np.ascontiguousarray(np.concatenate([e[:, :2], e[:, 2:] - e[:, :2]], axis=1).T)
    for k in range(0, len(e), 128):
        # Edges from here on that begin below the block's top; the ones before have met the block already.
        stop = int(np.searchsorted(low, high[k : k + 128].max(), "right"))
        own, other = slice(k, k + 128), slice(k, stop)
        i, j = np.nonzero((left[own, None] <= right[other]) & (left[other] <= right[own, None]) & (low[other] <= high[own, None]) & (low[own, None] <= high[other]))
        (ax, ay, dax, day), (bx, by, dbx, dby) = both[:, i + k], both[:, j + k]
        cross = dax * dby - day * dbx
        with np.errstate(divide="ignore", invalid="ignore"):
            rx, ry = bx - ax, by - ay
            t = (rx * dby - ry * dbx) / cross
            u = (rx * day - ry * dax) / cross
        met = (cross != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        ys.append(ay[met] + t[met] * day[met])
    return np.unique(np.round(np.concatenate(ys), 6))


def _decomposed(layers: list[np.ndarray], wound: tuple[int, ...] = ()) -> tuple:
    """Every edge in every slab that it passes through, slab by slab from left to right, and whether each layer holds right of it."""
    e = np.concatenate(layers)
    layer = np.repeat(np.arange(len(layers)), [len(x) for x in layers])
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    slope = (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    levels = _levels(e)
    middles = (levels[:-1] + levels[1:]) / 2
    first, last = np.searchsorted(middles, low), np.searchsorted(middles, high)
    n = last - first
    edge = np.repeat(np.arange(len(e), dtype=np.int32), n)
    slab = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
    order = np.argsort(np.repeat(e[:, 0], n) + np.repeat(slope, n) * (middles[slab] - np.repeat(e[:, 1], n)), kind="stable")
    # Numbers of 16 bits are sorted by their digits, in place of comparisons.
    order = order[np.argsort(slab.astype(np.uint16 if len(middles) < 1 << 16 else np.int64)[order], kind="stable")]
    edge, slab = edge[order], slab[order]
    sizes = np.bincount(slab, minlength=len(middles))
    begins = np.cumsum(sizes) - sizes
    starts = np.repeat(begins, sizes)
    inside = []
    for k in range(len(layers)):
        step = (layer == k).astype(np.int32)
        if k in wound:
            step[e[:, 1] > e[:, 3]] *= -1
        passed = np.concatenate([[0], np.cumsum(step[edge], dtype=np.int32)])
        since = passed[1:] - np.repeat(passed[begins], sizes)
        inside.append(since % 2 == 1 if k not in wound else since != 0)
    return e, slope, levels, edge, slab, starts, inside


def _kept(parts: tuple, on: np.ndarray) -> np.ndarray:
    """The trapezoids of a decomposition right of whose left edge `on` holds."""
    e, slope, levels, edge, slab, starts, _ = parts
    before = np.concatenate([[False], on[:-1]])
    before[starts == np.arange(len(slab))] = False
    change = np.flatnonzero(on != before)
    p, q, at = edge[change[::2]], edge[change[1::2]], slab[change[::2]]
    y0, y1 = levels[at], levels[at + 1]
    x_at = lambda i, y: e[i, 0] + slope[i] * (y - e[i, 1])
    return np.column_stack([y0, y1, x_at(p, y0), x_at(p, y1), x_at(q, y0), x_at(q, y1), p, q])


def trapezoids(layers: list[np.ndarray], keep: Callable[..., np.ndarray], wound: tuple[int, ...] = ()) -> np.ndarray:
    """(y0, y1, left0, left1, right0, right1, left, right): where `keep` of the layers' insides holds, and the numbers of the edges on either side.

    Each layer is even-odd on its own edges, but those in `wound` hold wherever their edges wind around: a union of rings that turn the same way.
    """
    if not sum(map(len, layers)):
        return np.zeros((0, 8))
    parts = _decomposed(layers, wound)
    return _kept(parts, keep(*parts[-1]))


def running_unions(layers: list[np.ndarray]) -> list[np.ndarray]:
    """For each layer the trapezoids of its union with all before it, from one decomposition."""
    if not sum(map(len, layers)):
        return [np.zeros((0, 8)) for _ in layers]
    parts = _decomposed(layers)
    return [_kept(parts, on) for on in np.logical_or.accumulate(np.array(parts[-1]))]


def area(t: np.ndarray) -> float:
    return float(((t[:, 1] - t[:, 0]) * ((t[:, 4] - t[:, 2]) + (t[:, 5] - t[:, 3])) / 2).sum())


#: Thousandths of a micrometre within which places on a level are one.
_SNAP = 5


def _stacked(t: np.ndarray) -> np.ndarray:
    """Trapezoids between the same two edges on consecutive levels as one, but for those that share a side with the one beside: shared sides have to end at the same levels."""
    near = (t[1:, 0] == t[:-1, 0]) & (np.abs(t[1:, 2:4] - t[:-1, 4:6]) <= 4e-3 * _SNAP).all(axis=1)
    alone = ~(np.append(False, near) | np.append(near, False))
    order = np.lexsort((t[:, 0], t[:, 7], t[:, 6]))
    t, alone = t[order], alone[order]
    follows = (t[1:, 6:] == t[:-1, 6:]).all(axis=1) & (t[1:, 0] == t[:-1, 1]) & alone[1:] & alone[:-1]
    first, last = np.flatnonzero(np.append(True, ~follows)), np.flatnonzero(np.append(~follows, True))
    out = t[first]
    out[:, [1, 3, 5]] = t[last][:, [1, 3, 5]]
    return out[np.argsort(order[first])]


def rings_of(t: np.ndarray) -> list[np.ndarray]:
    """The rings around trapezoids, closed, in whole micrometres."""
    if not len(t):
        return []
    t = _stacked(t)
    owner = t[:, 6:].astype(np.int64)
    t = np.round(t[:, :6] * 1000).astype(np.int64)
    tall = t[:, 0] < t[:, 1]
    (y0, y1, l0, l1, r0, r1), (left, right) = t[tall].T, owner[tall].T
    # Edges that cross on a level come to almost the same place on it.
    at, x = np.concatenate([y0, y1, y0, y1]), np.concatenate([l0, l1, r0, r1])
    order = np.lexsort((x, at))
    fresh = np.append(True, (np.diff(at[order]) != 0) | (np.diff(x[order]) > _SNAP))
    x[order] = x[order][np.maximum.accumulate(np.where(fresh, np.arange(len(x)), 0))]
    l0, l1, r0, r1 = x.reshape(4, -1)
    sides = [np.column_stack([l1, y1, l0, y0]), np.column_stack([r0, y0, r1, y1])]
    # Along each level, what lies above it and what lies below, from left to right.
    n = len(y0)
    at, x = np.concatenate([y0, y0, y1, y1]), np.concatenate([l0, r0, l1, r1])
    up, down = np.repeat([1, -1, 0, 0], n), np.repeat([0, 0, 1, -1], n)
    order = np.lexsort((x, at))
    at, x, up, down = at[order], x[order], np.cumsum(up[order]) > 0, np.cumsum(down[order]) > 0
    gap = (at[1:] == at[:-1]) & (x[1:] > x[:-1])
    for here, back in (((up & ~down)[:-1] & gap, False), ((down & ~up)[:-1] & gap, True)):
        a, b = np.column_stack([x[:-1], at[:-1]])[here], np.column_stack([x[1:], at[1:]])[here]
        sides.append(np.concatenate([b, a] if back else [a, b], axis=1))
    e = np.concatenate(sides)
    # The edge that a side lies on; level sides have none.
    owner = np.concatenate([left, right, np.full(len(e) - 2 * n, -1)])
    return stitched(e, owner)[0]


def stitched(e: np.ndarray, owner: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The closed rings that sides (x, y, x2, y2) in whole thousandths of a micrometre make, in whole micrometres, and of each the least number of the edges (-1: none) that its sides lie on."""
    moves = (e[:, 0] != e[:, 2]) | (e[:, 1] != e[:, 3])
    e, owner = e[moves], owner[moves]
    # Coordinates have less than 31 bits.
    _, node = np.unique(np.concatenate([(e[:, 0] << 32) + e[:, 1], (e[:, 2] << 32) + e[:, 3]]), return_inverse=True)
    start, end = node[: len(e)], node[len(e) :]
    # Where two trapezoids share a side it is no edge.
    real = _uncancelled(start, end)
    e, owner, start, end = e[real], owner[real], start[real], end[real]
    out = np.argsort(start, kind="stable")
    first, last = np.searchsorted(start[out], end), np.searchsorted(start[out], end, "right")
    follow = np.where(last > first, out[np.minimum(first, len(e) - 1)], -1)
    angle = np.arctan2((e[:, 3] - e[:, 1]).astype(float), (e[:, 2] - e[:, 0]).astype(float))
    for k in np.flatnonzero(last - first > 1):
        # Where rings touch, the next side is the first one clockwise from the way back, so they stay apart.
        ways = out[first[k] : last[k]]
        turn = (angle[k] + np.pi - angle[ways]) % (2 * np.pi)
        follow[k] = ways[np.argmin(np.where(turn < 1e-12, 2 * np.pi, turn))]
    used, after, owners, places = bytearray(len(e)), follow.tolist(), owner.tolist(), (e[:, :2] / 1000.0).tolist()
    found, least = [], []
    for k in range(len(e)):
        path = []
        while k >= 0 and not used[k]:
            used[k] = 1
            path.append(k)
            k = after[k]
        if len(path) > 2:
            # Where a slab has cut an edge there is no corner.
            own = [owners[k] for k in path]
            corner = [k for k, o, last in zip(path, own, [own[-1], *own], strict=False) if o != last or o < 0]
            ring = _straightened([places[k] for k in corner]) if len(corner) > 2 else ()
            if len(ring) > 3:
                found.append(ring)
                least.append(min((o for o in own if o >= 0), default=-1))
    return found, np.array(least, np.int64)


def _uncancelled(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which sides stay once every side has taken away one that runs the other way: of two to the right and one to the left there is one to the right."""
    if not len(start):
        return np.zeros(0, bool)
    low, high = np.minimum(start, end), np.maximum(start, end)
    order = np.lexsort((start < end, high, low))
    low, high, onward = low[order], high[order], (start < end)[order]
    first = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
    n = np.diff(np.append(first, len(order)))
    forth = np.add.reduceat(onward.astype(np.int64), first)
    back = n - forth
    # Sides back come first; of either kind the ones beyond the other's number stay.
    place = np.arange(len(order)) - np.repeat(first, n)
    stay = np.empty(len(order), bool)
    stay[order] = np.where(onward, place - np.repeat(back, n) >= np.repeat(back, n), place >= np.repeat(forth, n))
    return stay


def _straightened(around: list[list[float]]) -> np.ndarray:
    """A ring in whole micrometres without the vertices that slabs have put on its edges."""
    kept: list[list[float]] = []
    for v in [*around, around[0], around[1]]:
        while len(kept) > 1 and _between(kept[-2], kept[-1], v):
            kept.pop()
        kept.append(v)
    ring: list[tuple[int, int]] = []
    for x, y in kept[1:]:
        v = (round(x), round(y))
        if not ring or v != ring[-1]:
            ring.append(v)
    if ring and ring[0] != ring[-1]:
        ring.append(ring[0])
    enclosed = sum(a * d - c * b for (a, b), (c, d) in zip(ring, ring[1:], strict=False))
    return np.array(ring, float) if len(ring) > 3 and enclosed else np.zeros((0, 2))


def _between(a: list[float], b: list[float], c: list[float]) -> bool:
    dx, dy, qx, qy = c[0] - a[0], c[1] - a[1], b[0] - a[0], b[1] - a[1]
    length = hypot(dx, dy)
    return length > 0 and abs(dx * qy - dy * qx) <= 0.003 * length and 0 <= dx * qx + dy * qy <= length * length


def signed_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def circle(radius: float, tolerance: float) -> np.ndarray:
    """A closed polygon about a circle's centre, off the circle by the tolerance at most."""
    n = min(2048, max(12, ceil(pi / acos(max(-1.0, 1 - tolerance / radius)))))
    k = np.arange(n + 1) % n * (2 * pi / n)
    return radius * np.column_stack([np.cos(k), np.sin(k)])


def band(lines: list, radius: float, tolerance: float) -> np.ndarray:
    """The edges of a stroke of half-width `radius` along lines or rings: a box for each edge and a circle for each vertex, all turning the same way."""
    cap = circle(radius, tolerance)
    out = [np.zeros((0, 4))]
    for line in lines:
        p = np.asarray(line, float).reshape(-1, 2)
        if not len(p):
            continue
        ends = p if len(p) == 1 or (p[0] != p[-1]).any() else p[:-1]
        around = (cap[None] + ends[:, None]).round(6)
        out.append(np.concatenate([around[:, :-1], around[:, 1:]], axis=2).reshape(-1, 4))
        a, b = p[:-1], p[1:]
        length = np.hypot(*(b - a).T)
        a, b, length = a[length > 0], b[length > 0], length[length > 0]
        n = np.column_stack([a[:, 1] - b[:, 1], b[:, 0] - a[:, 0]]) / length[:, None] * radius
        box = np.stack([a - n, b - n, b + n, a + n, a - n], axis=1)
        out.append(np.concatenate([box[:, :-1], box[:, 1:]], axis=2).reshape(-1, 4))
    e = np.concatenate(out)
    return e[e[:, 1] != e[:, 3]]


def stroke_shapes(lines: list, radius: float, tolerance: float) -> list[np.ndarray]:
    """Rings whose union is the stroke that `band` makes, all turning to the left: a box for each edge, and at each vertex as much of the circle as reaches out of the boxes."""
    cap = circle(radius, tolerance)[:-1]
    step, out = 2 * pi / len(cap), []
    for line in lines:
        p = np.asarray(line, float).reshape(-1, 2)
        p = p[np.append(True, (p[1:] != p[:-1]).any(axis=1))[: len(p)]]
        if not len(p):
            continue
        d = np.diff(p, axis=0)
        length = np.hypot(*d.T)
        d = d / length[:, None]
        n = np.column_stack([-d[:, 1], d[:, 0]]) * radius
        box = np.stack([p[:-1] - n, p[1:] - n, p[1:] + n, p[:-1] + n, p[:-1] - n], axis=1)
        out += list(box)
        looped = len(p) > 1 and (p[0] == p[-1]).all()
        for k, v in enumerate(p[:-1] if looped else p):
            before = k - 1 if k or looped else None
            after = k if k < len(d) else None
            beside = [s for s in (before, after) if s is not None]
            # A box covers its half of the circle if it is long enough.
            a, b, inner = 0.0, 2 * pi, None
            if beside and min(length[s] for s in beside) >= radius:
                if len(beside) == 1:
                    way = -d[after] if before is None else d[before]
                    a, b = (atan2(way[1], way[0]) + x for x in (-pi / 2, pi / 2))
                else:
                    i, o = d[before], d[after]
                    turn = atan2(i[0] * o[1] - i[1] * o[0], i @ o)
                    # Where a line goes almost straight on or back, the circle stays whole.
                    if 2 * step < abs(turn) < pi - 0.1:
                        side = -pi / 2 if turn > 0 else pi / 2
                        a, b = sorted((atan2(i[1], i[0]) + side, atan2(i[1], i[0]) + side + turn))
                        inner = v - radius / 4 * np.array([cos((a + b) / 2), sin((a + b) / 2)])
            if b - a >= 2 * pi - 2 * step:
                ring = cap + v
            else:
                # One place beyond either end, which the boxes cover.
                places = np.arange(floor(a / step), ceil(b / step) + 1) % len(cap)
                ring = cap[places] + v
                ring = ring if inner is None else np.concatenate([inner[None], ring])
            out.append(np.concatenate([ring, ring[:1]]))
    return out


def stroke(lines: list, radius: float, tolerance: float = 20.0) -> np.ndarray:
    """Trapezoids of a stroke along lines."""
    return trapezoids([band(lines, radius, tolerance)], lambda a: a, wound=(0,))


def union(sets: list) -> np.ndarray:
    """Trapezoids of the union of polygon sets."""
    return trapezoids([edges_of(s) for s in sets], lambda *inside: np.logical_or.reduce(inside))


def offset(rings: list, distance: float, tolerance: float = 20.0) -> np.ndarray:
    """Trapezoids of a set grown (or shrunk, if negative) by a distance, with round corners."""
    if not distance:
        return trapezoids([edges_of(rings)], lambda a: a)
    return offsets(rings, abs(distance), tolerance)[int(distance < 0)]


def offsets(rings: list, distance: float, tolerance: float = 20.0) -> tuple[np.ndarray, np.ndarray]:
    """Trapezoids of a set grown and shrunk by a distance above zero, from one decomposition."""
    layers = [edges_of(rings), band(rings, distance, tolerance)]
    if not sum(map(len, layers)):
        return np.zeros((0, 8)), np.zeros((0, 8))
    parts = _decomposed(layers, wound=(1,))
    own, stroke = parts[-1]
    return _kept(parts, own | stroke), _kept(parts, own & ~stroke)


def ring_sets(column: pa.Array) -> list[list[np.ndarray]]:
    """For each row its rings (or lines) as arrays of (x, y); a null has none. A missing or infinite coordinate is an error: a lost ring would be a hole in the product."""
    rings = column.values
    points = rings.values
    xy = np.column_stack([points.field(k).to_numpy(zero_copy_only=False).astype(float) for k in ("x", "y")])
    ends, rows = rings.offsets.to_numpy(), column.offsets.to_numpy()
    out = []
    for known, a, b in zip(column.is_valid().to_pylist(), rows[:-1], rows[1:], strict=True):
        found = [xy[ends[k] : ends[k + 1]] for k in range(a, b)] if known else []
        if not all(np.isfinite(r).all() for r in found):
            raise ValueError("a ring has a coordinate that is missing or not finite")
        out.append(found)
    return out


def _lists(rows: list[list[np.ndarray]]) -> pa.Array:
    """Rings of (x, y) as an Arrow column."""
    rings = [r for row in rows for r in row]
    xy = np.concatenate([np.zeros((0, 2)), *rings]).astype(np.int64)
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"])
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rings])]).astype(np.int32)
    sizes = np.concatenate([[0], np.cumsum([len(row) for row in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends), points))


def _kernel(df: DataFrame, inputs: list[str], f: Callable[..., np.ndarray], result: str = "rings") -> DataFrame:
    """Append `area` and `result`, the rings of a kernel over columns of rings and of numbers."""
    return _kernels(df, inputs, lambda *x: (f(*x),), [("area", result)])


def _kernels(df: DataFrame, inputs: list[str], f: Callable[..., tuple[np.ndarray, ...]], results: list[tuple[str, str]]) -> DataFrame:
    """As `_kernel`, for a kernel of several sets of trapezoids: each gets columns of its area and its rings."""
    made = [c for pair in results for c in pair]
    names = [c for c in df.columns if c not in made]
    every = df.select(*names, *(F.col(c).alias(f"_{k}") for k, c in enumerate(inputs)))
    schema = StructType(df.select(*names).schema.fields)
    for own, rings in results:
        schema = schema.add(own, "double").add(rings, _RINGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [batch.column(len(names) + k) for k in range(len(inputs))]
            areas, sets, held, first = [[] for _ in results], [[] for _ in results], 0, 0
            for k, x in enumerate(zip(*(ring_sets(c) if pa.types.is_list(c.type) else c.to_pylist() for c in given), strict=True), 1):
                # A row's trapezoids are many more than its rings' vertices, and go with the row.
                for n, t in enumerate(f(*x)):
                    areas[n].append(area(t))
                    sets[n].append(rings_of(t))
                    held += sum(map(len, sets[n][-1]))
                if held >= MOST_HELD or k == batch.num_rows:
                    columns = [batch.column(c).slice(first, k - first) for c in range(len(names))]
                    found = [c for n in range(len(results)) for c in (pa.array(areas[n], pa.float64()), _lists(sets[n]))]
                    yield pa.RecordBatch.from_arrays([*columns, *found], [*names, *made])
                    areas, sets, held, first = [[] for _ in results], [[] for _ in results], 0, k

    return every.mapInArrow(run, schema)


def boolean(df: DataFrame, a: str, b: str, operation: str, result: str = "rings") -> DataFrame:
    """Append area and rings of a Boolean of two columns of rings."""
    keep = OPERATIONS[operation]
    return _kernel(df, [a, b], lambda x, y: trapezoids([edges_of(x), edges_of(y)], keep), result)


def normalized(df: DataFrame, rings: str, result: str = "rings") -> DataFrame:
    """Append area and rings of an even-odd set: rings that don't cross themselves or each other, turned outwards and inwards."""
    return _kernel(df, [rings], lambda x: trapezoids([edges_of(x)], lambda a: a), result)


def union_all(df: DataFrame, rings: str, key: list[str], result: str = "rings") -> DataFrame:
    """(key, area, rings): the union of each group's sets, each even-odd on its own. A group is one feature's or board's, which the capture limits bound."""
    schema = StructType([df.schema[k] for k in key]).add("area", "double").add(result, _RINGS)

    def join(table: pa.Table) -> pa.Table:
        sets = [s for chunk in table.column(rings).chunks for s in ring_sets(chunk)]
        t = union(sets)
        return pa.table([*(table.column(k).slice(0, 1).combine_chunks() for k in key), pa.array([area(t)]), _lists([rings_of(t)])], [*key, "area", result])

    return df.select(*key, rings).groupBy(*key).applyInArrow(join, schema)


def boolean_areas(df: DataFrame, a: str, b: str) -> DataFrame:
    """Append the area of each of OPERATIONS on two columns of rings.

    The four follow from three: |A xor B| and |A - B| from the areas of A, B and their intersection.
    """
    names = [c for c in df.columns if c not in OPERATIONS]
    places = [names.index(c) for c in (a, b)]

    def one(x: list, y: list) -> tuple[float, ...]:
        left, right = edges_of(x), edges_of(y)
        own, other = (area(trapezoids([e], lambda i: i)) for e in (left, right))
        both = area(trapezoids([left, right], OPERATIONS["intersection"]))
        return own + other - both, both, own - both, own + other - 2 * both

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [one(*x) for x in zip(*(ring_sets(batch.column(p)) for p in places), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([m[k] for m in made], pa.float64()) for k in range(4))], [*names, *OPERATIONS])

    schema = StructType(df.select(*names).schema.fields)
    for k in OPERATIONS:
        schema = schema.add(k, "double")
    return df.select(*names).mapInArrow(run, schema)


def buffered(df: DataFrame, rings: str, distance: float, tolerance: float = 20.0, result: str = "rings") -> DataFrame:
    """Append area and rings of a set grown or shrunk by a distance."""
    return _kernel(df, [rings], lambda x: offset(x, distance, tolerance), result)


def buffered_both_ways(df: DataFrame, rings: str, distance: float, grown: tuple[str, str], shrunk: tuple[str, str], tolerance: float = 20.0) -> DataFrame:
    """Append columns of area and rings of a set grown, and of the set shrunk, by a distance above zero."""
    return _kernels(df, [rings], lambda x: offsets(x, distance, tolerance), [grown, shrunk])


def stroked(df: DataFrame, lines: str, half_width: str, tolerance: float | None = 20.0, result: str = "rings") -> DataFrame:
    """Append area and rings of strokes along a column of lines, of the half-width in another; without a tolerance caps are as fine as the half-width asks for."""
    return _kernel(df, [lines, half_width], lambda x, r: stroke(x, r, tolerance or min(20.0, max(0.1, r * SAGITTA))), result)



def islands(shapes: DataFrame, least: float, rings: str = "rings") -> DataFrame:
    """(id, island, area, keeps): each ring of a feature on its own; the largest is land, and others below `least` are omitted."""
    from quern.functions.geometry import double_area

    each = shapes.select("id", F.posexplode(rings).alias("island", "ring")).withColumn("area", F.abs(double_area(F.col("ring"))) / 2)
    top = each.groupBy("id").agg(F.max(F.struct("area", -F.col("island")))["area"].alias("largest"))
    return each.join(top, "id").select("id", "island", "area", ((F.col("area") == F.col("largest")) | (F.col("area") >= least)).alias("keeps"))


def star(radius: float, points: int) -> list[tuple[float, float]]:
    k = [(radius * (1 if i % 2 == 0 else 0.4), i * pi / points) for i in range(2 * points)]
    ring = [(r * cos(a), r * sin(a)) for r, a in k]
    return [*ring, ring[0]]
