"""Column functions on lines and rings: arrays of (x, y) structs; a ring repeats its first vertex at the end.

All of them are built-in higher-order functions, so they run in the JVM and take part in column pruning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _tail(line: Column) -> Column:
    return F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0)))


def segments(line: Column) -> Column:
    """The segments of a line, as (i, x, y, x2, y2)."""
    ends = F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), _tail(line), lambda a, b: F.struct(a["x"].alias("x"), a["y"].alias("y"), b["x"].alias("x2"), b["y"].alias("y2")))
    return F.transform(ends, lambda s, i: F.struct((i + 1).alias("i"), s["x"].alias("x"), s["y"].alias("y"), s["x2"].alias("x2"), s["y2"].alias("y2")))


def segment_length(s: Column) -> Column:
    dx, dy = (s["x2"] - s["x"]).cast("double"), (s["y2"] - s["y"]).cast("double")
    return F.sqrt(dx * dx + dy * dy)


def length(line: Column) -> Column:
    return F.aggregate(segments(line), F.lit(0.0), lambda a, s: a + segment_length(s))


def double_area(ring: Column) -> Column:
    """Twice the signed area of a ring of whole coordinates, measured from its first vertex."""
    x0, y0 = F.get(ring, 0)["x"], F.get(ring, 0)["y"]
    return F.aggregate(segments(ring), F.lit(0).cast("long"), lambda a, s: a + (s["x"] - x0) * (s["y2"] - y0) - (s["x2"] - x0) * (s["y"] - y0))


def bounds(line: Column) -> Column:
    side = lambda f, k: f(F.transform(line, lambda p: p[k]))
    return F.struct(side(F.array_min, "x").alias("min_x"), side(F.array_min, "y").alias("min_y"), side(F.array_max, "x").alias("max_x"), side(F.array_max, "y").alias("max_y"))


def crosses_ray(s: Column, x: Column, y: Column) -> Column:
    """Whether the ray from (x, y) to the right crosses a segment; half-open, so a shared vertex counts once."""
    d = lambda c: c.cast("double")
    at = d(s["x2"] - s["x"]) * d(y - s["y"]) / F.nullif(d(s["y2"] - s["y"]), F.lit(0.0)) + d(s["x"])
    return ((s["y"] > y) != (s["y2"] > y)) & F.coalesce(d(x) < at, F.lit(False))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    return F.aggregate(segments(ring), F.lit(False), lambda a, s: a != crosses_ray(s, x, y))


def with_winding(ring: Column, area: Column) -> Column:
    """The ring with a signed area that is not negative."""
    return F.when(area >= 0, ring).otherwise(F.reverse(ring))


def _corners(s: Column) -> Column:
    mix = lambda k, a, b: F.lit(a) * s[k] + F.lit(b) * s[k + "2"]
    return F.array(F.struct(mix("x", 0.75, 0.25).alias("x"), mix("y", 0.75, 0.25).alias("y")), F.struct(mix("x", 0.25, 0.75).alias("x"), mix("y", 0.25, 0.75).alias("y")))


def chaikin_ring(ring: Column) -> Column:
    """A ring with every corner cut at a quarter of its edges."""
    cut = F.flatten(F.transform(segments(ring), _corners))
    return F.when(F.size(ring) >= 4, F.concat(cut, F.slice(cut, 1, 1))).otherwise(_as_double(ring))


def _as_double(line: Column) -> Column:
    return F.transform(line, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))


def chaikin_line(line: Column) -> Column:
    """A line with its inner corners cut; the ends stay."""
    cut = F.flatten(F.transform(segments(line), _corners))
    own = _as_double(line)
    inner = F.slice(cut, 2, F.greatest(F.size(cut) - 2, F.lit(0)))
    return F.when(F.size(line) >= 3, F.concat(F.slice(own, 1, 1), inner, F.slice(own, -1, 1))).otherwise(own)


def clean_ring(ring: Column) -> Column:
    """The ring without repeated vertices, closed; null if fewer than three vertices or a missing coordinate are left."""
    fresh = F.filter(ring, lambda p, i: (i == 0) | (p != F.get(ring, i - 1)))
    last = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(fresh), F.lit(1))), F.lit(1), lambda a, i: F.when(F.get(fresh, i - 1) != F.get(fresh, 0), i).otherwise(a))
    whole = F.slice(fresh, 1, last)
    bad = F.exists(ring, lambda p: p["x"].isNull() | p["y"].isNull())
    return F.when(~bad & (F.size(whole) >= 3), F.concat(whole, F.slice(whole, 1, 1)))


def point_keys(line: Column) -> Column:
    return F.transform(line, lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string")))


def line_key(line: Column) -> Column:
    """The same text for a line and its reverse."""
    keys = point_keys(line)
    return F.least(F.array_join(keys, " "), F.array_join(F.reverse(keys), " "))


def ring_key(ring: Column) -> Column:
    """The same text for a ring whatever its first vertex and direction."""
    keys = point_keys(F.when((F.size(ring) > 1) & (F.get(ring, 0) == F.element_at(ring, -1)), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring))

    def turned(k: Column) -> Column:
        at = F.array_position(k, F.array_min(k)).cast("int")
        return F.array_join(F.concat(F.slice(k, at, F.size(k)), F.slice(k, F.lit(1), at - 1)), " ")

    return F.least(turned(keys), turned(F.reverse(keys)))


def rect_interval(s: Column, min_x: float, min_y: float, max_x: float, max_y: float) -> Column:
    """(t0, t1), the part of a segment inside a rectangle, or null."""
    d = lambda c: c.cast("double")
    low, high, outside = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for k, lo, hi in (("x", min_x, max_x), ("y", min_y, max_y)):
        a, step = d(s[k]), d(s[k + "2"] - s[k])
        near, far = (F.lit(lo) - a) / F.nullif(step, F.lit(0.0)), (F.lit(hi) - a) / F.nullif(step, F.lit(0.0))
        low.append(F.coalesce(F.least(near, far), F.lit(0.0)))
        high.append(F.coalesce(F.greatest(near, far), F.lit(1.0)))
        outside = outside | ((step == 0) & ((a < lo) | (a > hi)))
    t0, t1 = F.greatest(*low), F.least(*high)
    return F.when(~outside & (t1 >= t0), F.struct(t0.alias("t0"), t1.alias("t1")))


def disk_interval(s: Column, cx: float, cy: float, radius: float) -> Column:
    """(t0, t1), the part of a segment inside a disk, or null."""
    d = lambda c: c.cast("double")
    dx, dy, fx, fy = d(s["x2"] - s["x"]), d(s["y2"] - s["y"]), d(s["x"]) - cx, d(s["y"]) - cy
    dd, fd, ff = dx * dx + dy * dy, fx * dx + fy * dy, fx * fx + fy * fy - radius * radius
    disc = fd * fd - dd * ff
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    over = F.nullif(dd, F.lit(0.0))
    t0, t1 = F.greatest(F.lit(0.0), (-fd - root) / over), F.least(F.lit(1.0), (-fd + root) / over)
    point = F.when(fx * fx + fy * fy <= radius * radius, F.struct(F.lit(0.0).alias("t0"), F.lit(0.0).alias("t1")))
    return F.when(dd == 0, point).when((disc >= 0) & (t1 >= t0), F.struct(t0.alias("t0"), t1.alias("t1")))


def chord_interval(s: Column, chord_y: float) -> Column:
    """(t0, t1), the part of a segment with y up to a chord, or null."""
    a, b = s["y"] <= chord_y, s["y2"] <= chord_y
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(chord_y) - s["y"].cast("double")) / F.nullif((s["y2"] - s["y"]).cast("double"), F.lit(0.0))))
    pair = lambda x, y: F.struct(x.alias("t0"), y.alias("t1"))
    return F.when(a & b, pair(F.lit(0.0), F.lit(1.0))).when(a, pair(F.lit(0.0), t)).when(b, pair(t, F.lit(1.0)))


#: Metres of a degree.
DEGREE = 111_320


def ring_square_metres(ring: Column) -> Column:
    """Square metres of a ring in degrees: its plane area, narrowed by the latitude of its first vertex."""
    cross = F.aggregate(segments(ring), F.lit(0.0), lambda a, s: a + (s["x"] * s["y2"] - s["x2"] * s["y"]))
    return F.abs(cross / 2) * float(DEGREE) * float(DEGREE) * F.cos(F.get(ring, 0)["y"] * F.pi() / 180)


def distance_metres(a: Column, b: Column) -> Column:
    dx, dy = (a["x"] - b["x"]) * F.cos(a["y"] * F.pi() / 180), a["y"] - b["y"]
    return F.sqrt(dx * dx + dy * dy) * float(DEGREE)


def vertex_mean(ring: Column) -> Column:
    """The mean of a ring's vertices, the closing one left out."""
    own = F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))
    mean = lambda k: F.aggregate(own, F.lit(0.0), lambda a, p: a + p[k]) / F.nullif(F.size(own), F.lit(0))
    return F.struct(F.coalesce(mean("x"), F.lit(0.0)).alias("x"), F.coalesce(mean("y"), F.lit(0.0)).alias("y"))


def area_centre(ring: Column) -> Column:
    """The centre of a ring's area; its first vertex if it has none."""
    f = lambda s: (s["x"] * s["y2"] - s["x2"] * s["y"]).cast("double")
    total = lambda g: F.aggregate(segments(ring), F.lit(0.0), lambda a, s: a + g(s))
    area = F.nullif(3 * total(f), F.lit(0.0))
    centre = lambda k: F.coalesce(total(lambda s: (s[k] + s[k + "2"]) * f(s)) / area, F.get(ring, 0)[k].cast("double"))
    return F.struct(centre("x").alias("x"), centre("y").alias("y"))


def extent(ring: Column) -> Column:
    box = bounds(ring)
    return F.greatest(box["max_x"] - box["min_x"], box["max_y"] - box["min_y"])


def sampled(ring: Column, most: int) -> Column:
    """A closed ring's vertices, at even strides if there are more than `most`."""
    own = F.when(F.size(ring) > 1, F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)
    stride = F.greatest(F.lit(1), F.ceil(F.size(own) / most)).cast("int")
    return F.filter(own, lambda p, i: i % stride == 0)
