"""Rings of one group as arrays: which ones meet, versions to step back through, outlines around holes, and one set of rings clipped to another.

Rings are packed as (xy, ends): the vertices (x, y) of all of them, and where each ring ends, from zero. A ring repeats its first vertex at its end.
Whole coordinates are below `areas.LARGEST`, so turns are exact in 64 bits. Everything meets in the cells of a uniform grid, so work and memory grow with a group's edges and
crossings, not with their square. A group is a board's level or the like, which the capture limits bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from quern.operators.areas import LARGEST, _line_left, _ring_left, _turn
from quern.operators.polygons import stitched

#: Pairs of edges that are looked at at once.
PAIRS = 1 << 19
Packed = tuple[np.ndarray, np.ndarray]


def packed(rings: list[np.ndarray]) -> Packed:
    return np.concatenate(rings) if rings else np.zeros((0, 2), np.int64), np.cumsum([0, *map(len, rings)])


def unpacked(rings: Packed) -> list[np.ndarray]:
    xy, ends = rings
    return [xy[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def taken(rings: Packed, which: np.ndarray) -> Packed:
    """The rings of the given numbers."""
    xy, ends = rings
    n = np.diff(ends)[which]
    return xy[_ranges(ends[:-1][which], n)], np.append(0, np.cumsum(n))


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1 and so on, n of each."""
    return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)


def _edges(rings: Packed) -> tuple[np.ndarray, np.ndarray]:
    """The edges (x, y, x2, y2), and the ring of each."""
    xy, ends = rings
    n = np.maximum(np.diff(ends) - 1, 0)
    at = _ranges(ends[:-1], n)
    return np.concatenate([xy[at], xy[at + 1]], axis=1), np.repeat(np.arange(len(n)), n)


def double_areas(rings: Packed) -> np.ndarray:
    """Twice the signed areas, measured from each ring's first vertex."""
    e, of = _edges(rings)
    first = rings[0][np.minimum(rings[1][:-1], max(len(rings[0]) - 1, 0))][of]
    e = e - np.concatenate([first, first], axis=1)
    passed = np.append(0, np.cumsum(e[:, 0] * e[:, 3] - e[:, 2] * e[:, 1]))
    n = np.append(0, np.cumsum(np.bincount(of, minlength=len(rings[1]) - 1)))
    return passed[n[1:]] - passed[n[:-1]]


def whole(rings: Packed) -> Packed:
    """Whole coordinates without repeated vertices."""
    xy, ends = np.floor(rings[0] + 0.5).astype(np.int64), rings[1]
    fresh = np.append(True, (xy[1:] != xy[:-1]).any(axis=1))[: len(xy)]
    fresh[ends[:-1][np.diff(ends) > 0]] = True
    return xy[fresh], np.append(0, np.cumsum(fresh))[ends]


def _near(e: np.ndarray, cell: int, mine: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of edges whose boxes meet, in blocks and each pair once: it is taken in the first cell that both cover. Of the pairs one at least is `mine`."""
    if not len(e):
        return
    low, high = np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])
    if low.min() <= -LARGEST or high.max() >= LARGEST:
        raise ValueError("a ring has a coordinate that is too large")
    # Long edges get larger cells, so that none covers many.
    cell = max(cell, int((high - low).max(axis=1).mean()), int((high.max(axis=0) - low.min(axis=0)).max()) >> 12)
    first = low // cell
    wide = high // cell - first + 1
    n = wide.prod(axis=1)
    edge, k = np.repeat(np.arange(len(e)), n), _ranges(np.zeros(len(e), np.int64), n)
    at = first[edge] + np.column_stack([k % wide[edge, 0], k // wide[edge, 0]])
    key = (at[:, 0] - first[:, 0].min()) * (int((first[:, 1] + wide[:, 1]).max()) - int(first[:, 1].min()) + 1) + at[:, 1] - first[:, 1].min()
    if mine is not None:
        here = np.isin(key, np.unique(key[mine[edge]]))
        edge, at, key = edge[here], at[here], key[here]
    order = np.argsort(key, kind="stable")
    edge, at, key = edge[order], at[order], key[order]
    later = np.searchsorted(key, key, "right") - np.arange(len(key)) - 1
    # Boxes are compared many times faster than pairs are listed.
    if later.sum() > len(e) ** 2 / 24:
        yield from _by_boxes(low, high, mine)
        return
    total = np.append(0, np.cumsum(later))
    a = 0
    while a < len(key):
        b = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS, "right")) - 1)
        rows = np.repeat(np.arange(a, b), later[a:b])
        i, j = edge[rows], edge[_ranges(np.arange(a, b) + 1, later[a:b])]
        ok = (at[rows] == np.maximum(first[i], first[j])).all(axis=1) & (low[i] <= high[j]).all(axis=1) & (low[j] <= high[i]).all(axis=1)
        if mine is not None:
            ok &= mine[i] | mine[j]
        yield np.minimum(i[ok], j[ok]), np.maximum(i[ok], j[ok])
        a = b


def _by_boxes(low: np.ndarray, high: np.ndarray, mine: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As `_near`, for few or long edges: blocks of edges meet all that begin before the block's end."""
    order = np.argsort(low[:, 0], kind="stable")
    # Whole coordinates below LARGEST fit 32 bits.
    (lx, ly), (hx, hy) = low[order].T.astype(np.int32), high[order].T.astype(np.int32)
    for k in range(0, len(order), 128):
        own = slice(k, k + 128)
        other = slice(k, int(np.searchsorted(lx, hx[own].max(), "right")))
        ok = lx[other] <= hx[own, None]
        ok &= ly[other] <= hy[own, None]
        ok &= ly[own, None] <= hy[other]
        # The first ones are the block's own edges, and meet each other once.
        ok[:, : len(ok)] = np.triu(ok[:, : len(ok)], 1)
        i, j = np.divmod(np.flatnonzero(ok), ok.shape[1])
        i, j = order[i + k], order[j + k]
        if mine is not None:
            i, j = i[mine[i] | mine[j]], j[mine[i] | mine[j]]
        yield np.minimum(i, j), np.maximum(i, j)


def _meet(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whether edges s and t of overlapping boxes meet, touching included."""
    turns = [[np.sign(_turn(p[:, 0], p[:, 1], p[:, 2] - p[:, 0], p[:, 3] - p[:, 1], q[:, k], q[:, k + 1])) for k in (0, 2)] for p, q in ((s, t), (t, s))]
    out = (turns[0][0] * turns[0][1] < 0) & (turns[1][0] * turns[1][1] < 0)
    for (p, q), sides in zip(((s, t), (t, s)), turns, strict=True):
        # A vertex on an edge's line is on the edge if it is in its box.
        low, high = np.minimum(p[:, :2], p[:, 2:]), np.maximum(p[:, :2], p[:, 2:])
        for k, side in zip((0, 2), sides, strict=True):
            out |= (side == 0) & (low <= q[:, k : k + 2]).all(axis=1) & (q[:, k : k + 2] <= high).all(axis=1)
    return out


def meeting(rings: Packed, cell: int, moved: np.ndarray | None = None) -> np.ndarray:
    """(a, b): rings of whole coordinates that meet another, or themselves but for neighbouring edges; if `moved` is given, of the pairs with one of those."""
    e, of = _edges(rings)
    n = np.bincount(of, minlength=len(rings[1]) - 1)
    place = np.arange(len(e)) - (np.cumsum(n) - n)[of]
    found = [np.zeros((0, 2), np.int64)]
    for i, j in _near(e, cell, None if moved is None else moved[of]):
        beside = (of[i] == of[j]) & ((j - i == 1) | ((place[i] == 0) & (place[j] == n[of[j]] - 1)))
        i, j = i[~beside], j[~beside]
        met = _meet(e[i], e[j])
        found.append(np.column_stack([of[i[met]], of[j[met]]]))
    return np.unique(np.concatenate(found), axis=0)


def _spread(rings: Packed, least: float) -> np.ndarray:
    """For each vertex the largest squared tolerance below which it stays, if the open line of a ring's vertices is simplified; below `least` squared it may be less.

    Where a stretch is split doesn't depend on the tolerance, so one pass serves them all. All stretches of all rings are split at once.
    """
    xy, ends = rings
    stays = np.zeros(len(xy))
    a, b = ends[:-1], ends[1:] - 2
    a, b = a[b >= a], b[b >= a]
    stays[a] = stays[b] = stays[b + 1] = np.inf
    bound = np.full(len(a), np.inf)
    while True:
        long = b - a > 1
        a, b, bound = a[long], b[long], bound[long]
        if not len(a):
            return stays
        n = b - a - 1
        at, of = _ranges(a + 1, n), np.repeat(np.arange(len(a)), n)
        d, q = (xy[b] - xy[a])[of].astype(float), (xy[at] - xy[a][of]).astype(float)
        size = (d * d).sum(axis=1)
        t = np.clip((q * d).sum(axis=1) / np.where(size > 0, size, 1), 0, 1)
        far = ((q - t[:, None] * d) ** 2).sum(axis=1)
        top = np.maximum.reduceat(far, np.cumsum(n) - n)
        hit = np.flatnonzero(far == top[of])
        split = at[hit[np.append(True, of[hit][1:] != of[hit][:-1])]]
        bound = np.minimum(bound, top)
        real = bound > least * least
        a, b, bound, split = a[real], b[real], bound[real], split[real]
        stays[split] = bound
        a, b, bound = np.concatenate([a, split]), np.concatenate([split, b]), np.concatenate([bound, bound])


def _smoothed(rings: Packed) -> Packed:
    """Every corner cut at a quarter of its edges; rings of less than three vertices stay."""
    xy, ends = rings
    n = np.diff(ends)
    cut = n > 3
    size = np.where(cut, 2 * (n - 1) + 1, n)
    begins = np.cumsum(size) - size
    out = np.empty((size.sum(), 2))
    out[_ranges(begins[~cut], n[~cut])] = xy[_ranges(ends[:-1][~cut], n[~cut])]
    at, to = _ranges(ends[:-1][cut], n[cut] - 1), np.repeat(begins[cut], n[cut] - 1) + 2 * _ranges(np.zeros(cut.sum(), np.int64), n[cut] - 1)
    out[to], out[to + 1] = 0.75 * xy[at] + 0.25 * xy[at + 1], 0.25 * xy[at] + 0.75 * xy[at + 1]
    out[(begins + size - 1)[cut]] = out[begins[cut]]
    return out, np.append(0, np.cumsum(size))


def versions(rings: Packed, tolerance: float, smooth: bool, retries: int) -> list[Packed]:
    """All rings as they are, simplified at ever larger tolerances (a ring itself where less than a triangle would be left), and smoothed."""
    xy, ends = rings
    made = [rings]
    if tolerance > 0:
        stays = _spread(rings, tolerance / 2 ** (retries - 1))
        of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        for k in reversed(range(retries)):
            keep = stays > (tolerance / 2**k) ** 2
            left = np.bincount(of, keep, len(ends) - 1)
            # The last vertex is the first one's copy.
            keep |= ((left < 4) | (np.diff(ends) < 5))[of]
            made.append((xy[keep], np.append(0, np.cumsum(keep))[ends]))
    if smooth:
        made.append(_smoothed(made[-1]))
    return [whole(m) for m in made]


def settled(made: list[Packed], cell: int) -> tuple[Packed, np.ndarray, np.ndarray]:
    """(rings, stage, crosses): of all versions the last ones that turn as the raw ring does and with which no ring meets another or itself.

    In each round the rings that do step back by one version. Those that do so in raw form have `crosses`: nothing is left to step back to.
    """
    turn = np.sign(np.array([double_areas(m) for m in made]))
    right = (turn == turn[0]) & (turn != 0)
    right[0] = True
    stage = len(made) - 1 - np.argmax(right[::-1], axis=0)
    # One packing of all versions, from which every ring takes its current one.
    every = np.concatenate([m[0] for m in made]), np.append(0, np.cumsum(np.concatenate([np.diff(m[1]) for m in made])))
    n = len(stage)
    moved, pairs = None, np.zeros((0, 2), np.int64)
    while True:
        now = taken(every, stage * n + np.arange(n))
        pairs = np.concatenate([pairs, meeting(now, cell, moved)])
        met = np.zeros(n, bool)
        met[pairs] = True
        moved = met & (stage > 0)
        if not moved.any():
            return now, stage, met
        stage = stage - moved
        pairs = pairs[~moved[pairs].any(axis=1)]


def _rayed(x: np.ndarray, y: np.ndarray, e: np.ndarray, cell: int, points_shift: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(point, edge): the edges that a ray to the right of the points meets. Edges count as shifted by an infinitesimal step to the right and a smaller one upwards, or points do."""
    real = np.flatnonzero(e[:, 1] != e[:, 3])
    e = e[real]
    if not len(x) or not len(e):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    cell = max(cell, int((high - low).mean()) + 1)
    first = np.floor(low / cell).astype(np.int64)
    n = np.floor(high / cell).astype(np.int64) - first + 1
    edge = np.repeat(np.arange(len(e)), n)
    row = _ranges(first, n)
    order = np.argsort(row, kind="stable")
    edge, row = edge[order], row[order]
    at = np.floor(y / cell).astype(np.int64)
    begin, end = np.searchsorted(row, at), np.searchsorted(row, at, "right")
    total = np.append(0, np.cumsum(end - begin))
    points, edges = [], []
    a = 0
    while a < len(x):
        b = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS, "right")) - 1)
        p = np.repeat(np.arange(a, b), (end - begin)[a:b])
        k = edge[_ranges(begin[a:b], (end - begin)[a:b])]
        # The points' height is most often not the edge's.
        spans = (e[k, 1] > y[p]) != (e[k, 3] > y[p]) if points_shift else (e[k, 1] >= y[p]) != (e[k, 3] >= y[p])
        p, k = p[spans], k[spans]
        ex, ey = e[k, 2] - e[k, 0], e[k, 3] - e[k, 1]
        left = (_ring_left if points_shift else _line_left)(_turn(e[k, 0], e[k, 1], ex, ey, x[p], y[p]), ex, ey)
        met = left == (ey > 0)
        points.append(p[met])
        edges.append(real[k[met]])
        a = b
    return np.concatenate(points), np.concatenate(edges)


def around(x: np.ndarray, y: np.ndarray, rings: Packed, sizes: np.ndarray, cell: int) -> np.ndarray:
    """For each point the outline (of positive size) with the least size around it; -1 if there is none."""
    e, of = _edges(rings)
    outer = sizes[of] > 0
    p, k = _rayed(x, y, e[outer], cell)
    pair, n = np.unique(np.column_stack([p, of[outer][k]]), axis=0, return_counts=True)
    pair = pair[n % 2 == 1]
    pair = pair[np.lexsort((pair[:, 1], sizes[pair[:, 1]], pair[:, 0]))]
    best = np.append(True, pair[1:, 0] != pair[:-1, 0])[: len(pair)]
    out = np.full(len(x), -1)
    out[pair[best, 0]] = pair[best, 1]
    return out


def parents(rings: Packed, sizes: np.ndarray, cell: int) -> np.ndarray:
    """For each hole (of no positive size) the smallest outline around it; -1 if there is none, and for outlines.

    The middles of three edges decide, as a vertex may lie where rings touch.
    """
    xy, ends = rings
    out = np.full(len(sizes), -1)
    holes = np.flatnonzero((sizes <= 0) & (np.diff(ends) > 1))
    n = np.diff(ends)[holes] - 1
    told = []
    for k in (0 * n, n // 3, 2 * n // 3):
        # Whole coordinates have whole middles if all are doubled.
        middle = xy[ends[:-1][holes] + k] + xy[ends[:-1][holes] + k + 1]
        told.append(around(middle[:, 0], middle[:, 1], (2 * xy, ends), sizes, 2 * cell))
    out[holes] = np.where((told[1] == told[2]) & (told[1] != told[0]), told[1], told[0])
    return out


def _crossed(e: list[np.ndarray], f: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
    """The pairs of edges i of e and j of f (columns x, y, x2, y2) that cross if f counts as shifted, the shares of either at which, and whether e ends left of f and f left of e."""
    x, y, px, py, qx, qy = e[0][i], e[1][i], f[0][j], f[1][j], f[2][j], f[3][j]
    dx, dy = e[2][i] - x, e[3][i] - y
    from_, to = _turn(x, y, dx, dy, px, py), _turn(x, y, dx, dy, qx, qy)
    left = _ring_left(to, dx, dy)
    # Most pairs fall out here.
    some = np.flatnonzero(_ring_left(from_, dx, dy) != left)
    i, j, x, y, dx, dy, px, py, qx, qy, from_, to, left = (v[some] for v in (i, j, x, y, dx, dy, px, py, qx, qy, from_, to, left))
    ex, ey = qx - px, qy - py
    begin, end = _turn(px, py, ex, ey, x, y), _turn(px, py, ex, ey, x + dx, y + dy)
    other = _line_left(end, ex, ey)
    met = np.flatnonzero(_line_left(begin, ex, ey) != other)
    t, u = (a[met].astype(float) / (a - b)[met].astype(float) for a, b in ((begin, end), (from_, to)))
    return i[met], j[met], t, u, other[met], left[met]


def _sides(rings: Packed, e: np.ndarray, of: np.ndarray, edge: np.ndarray, along: np.ndarray, at: np.ndarray, begins_inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(side, edge, inside): rings' edges cut at places `at` of share `along`; inside and outside alternate along a ring."""
    order = np.lexsort((along, edge))
    edge, at = edge[order], at[order]
    n = np.bincount(edge, minlength=len(e))
    cut = np.repeat(np.arange(len(e)), n + 1)
    k = np.arange(len(cut)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
    crossed = np.append(0, np.cumsum(n))
    sizes = np.bincount(of, minlength=len(rings[1]) - 1)
    first = (np.cumsum(sizes) - sizes)[of]
    before = crossed[:-1] - crossed[first] + begins_inside[of]
    start, end = e[cut, :2] * 1000, e[cut, 2:] * 1000
    start[k > 0] = at
    end[k < n[cut]] = at
    return np.concatenate([start, end], axis=1), cut, (before[cut] + k) % 2 == 1


def clipped(own: Packed, frame: Packed, cell: int) -> tuple[float, float, list[np.ndarray], np.ndarray]:
    """(area, outside, rings, edge): what of a set lies inside another, the area of what lies outside, and of each ring the least number of the set's edges on it; the number of all edges if none is.

    Both are rings of whole coordinates with their area to the left: outlines turn one way and holes the other, and none crosses another of its set. The frame counts as shifted
    by an infinitesimal step, so edges that lie on each other meet properly or not at all, and inside and outside alternate along every ring.
    """
    (e, of), (f, on) = _edges(own), _edges(frame)
    both = np.concatenate([e, f])
    mine = np.arange(len(both)) < len(e)
    met_at = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
    columns = [list(v.T.copy()) for v in (e, f)]
    for i, j in _near(both, cell, mine):
        other = (j >= len(e)) & (i < len(e))
        i, j = i[other], j[other] - len(e)
        met_at.append(_crossed(*columns, i, j)[:4])
    i, j, t, u = (np.concatenate(x) for x in zip(*met_at, strict=True))
    # Both edges get the very same place.
    at = np.floor((e[i, :2] + t[:, None] * (e[i, 2:] - e[i, :2])) * 1000 + 0.5).astype(np.int64)

    def begins(rings: Packed, edges: np.ndarray, shifted: bool) -> np.ndarray:
        xy, ends = rings
        first = xy[np.minimum(ends[:-1], max(len(xy) - 1, 0))]
        return np.bincount(_rayed(first[:, 0], first[:, 1], edges, cell, shifted)[0], minlength=len(ends) - 1) % 2 if len(xy) else np.zeros(len(ends) - 1, np.int64)

    s, edge, within = _sides(own, e, of, i, t, at, begins(own, f, False))
    r, rim, inner = _sides(frame, f, on, j, u, at, begins(frame, e, True))
    sides, owner = np.concatenate([s[within], r[inner]]), np.concatenate([edge[within], rim[inner] + len(e)])
    # Beyond the frame, its sides are those of a hole.
    rest = np.concatenate([s[~within], r[inner][:, [2, 3, 0, 1]]])
    rings, least = stitched(sides, owner)
    return _enclosed(sides), _enclosed(rest), rings, np.minimum(np.where(least < 0, len(e), least), len(e))


def _enclosed(sides: np.ndarray) -> float:
    """The area to the left of closed rings of sides in thousandths; whole numbers, so sides that run back on each other leave nothing."""
    return int((sides[:, 0] * sides[:, 3] - sides[:, 2] * sides[:, 1]).sum()) / 2e6


def united(shapes: Packed, cell: int) -> tuple[float, list[np.ndarray]]:
    """(area, rings) of the union of simple rings in whole thousandths of a micrometre that turn to the left; the rings are in whole micrometres.

    Of every edge the pieces stay that no other shape covers: crossings along a ring tell how many do, counted on from its first vertex. Of two shapes the later one counts as
    shifted by an infinitesimal step, so shapes that touch or have edges in common are apart or overlap, and no place is decided by rounding.
    """
    e, of = _edges(shapes)
    if not len(e):
        return 0.0, []
    met_at, columns = [], list(e.T.copy())
    for i, j in _near(e, cell):
        apart = of[i] != of[j]
        met_at.append(_crossed(columns, columns, i[apart], j[apart]))
    i, j, t, u, enters, entered = (np.concatenate(x) for x in zip(*met_at, strict=True))
    at = np.floor(e[i, :2] + t[:, None] * (e[i, 2:] - e[i, :2]) + 0.5).astype(np.int64)
    first = shapes[0][shapes[1][:-1]]
    covers = np.zeros(len(first), np.int64)
    for shifted in (False, True):
        p, k = _rayed(first[:, 0], first[:, 1], e, cell, shifted)
        other = of[k] < p if shifted else of[k] > p
        pair, n = np.unique(p[other] * len(first) + of[k[other]], return_counts=True)
        covers += np.bincount(pair[n % 2 == 1] // len(first), minlength=len(first))
    edge, along, places, step = np.concatenate([i, j]), np.concatenate([t, u]), np.concatenate([at, at]), np.where(np.concatenate([enters, entered]), 1, -1)
    order = np.lexsort((along, edge))
    edge, places, step = edge[order], places[order], step[order]
    n = np.bincount(edge, minlength=len(e))
    cut = np.repeat(np.arange(len(e)), n + 1)
    k = np.arange(len(cut)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
    passed, crossed = np.append(0, np.cumsum(step)), np.append(0, np.cumsum(n))
    begins = np.cumsum(np.bincount(of, minlength=len(first))) - np.bincount(of, minlength=len(first))
    over = passed[crossed[cut] + k] - passed[crossed[begins[of]]][cut] + covers[of[cut]]
    sides = np.concatenate([e[cut, :2], e[cut, 2:]], axis=1)
    sides[k > 0, :2] = places
    sides[k < n[cut], 2:] = places
    bare = over == 0
    return _enclosed(sides[bare]), stitched(sides[bare], cut[bare])[0]
