"""Operators on relations of lines and rings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.functions import geometry as geo


def clip(lines: DataFrame, inside: Callable[[Column], Column], key: str = "id") -> DataFrame:
    """(key, run, segments, first, last, t0, t1): the contiguous runs of lines inside a region.

    `inside` gives a segment's (t0, t1) within the region or null. A run goes on over a vertex only if the segment before is
    inside up to its end and the next from its start.
    """
    segs = lines.select(key, F.explode(geo.segments(F.col("line"))).alias("s")).filter("s.x <> s.x2 or s.y <> s.y2")
    kept = segs.select(key, "s", F.col("s.i").alias("i"), F.row_number().over(Window.partitionBy(key).orderBy("s.i")).alias("n"), inside(F.col("s")).alias("t")).filter("t is not null")
    order = Window.partitionBy(key).orderBy("i")
    joined = (F.lag("n").over(order) == F.col("n") - 1) & (F.lag("t.t1").over(order) == 1.0) & (F.col("t.t0") == 0.0)
    runs = kept.withColumn("new", F.when(joined, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    ends = runs.groupBy(key, "run").agg(
        F.count("*").alias("segments"), F.min("i").alias("first"), F.max("i").alias("last"), F.min_by("t.t0", "i").alias("t0"), F.max_by("t.t1", "i").alias("t1"),
        F.array_sort(F.collect_list(F.struct("i", "s", "t"))).alias("parts"),
    )
    at = lambda p, t: F.struct((p["s"]["x"] + (p["s"]["x2"] - p["s"]["x"]) * t).alias("x"), (p["s"]["y"] + (p["s"]["y2"] - p["s"]["y"]) * t).alias("y"))
    start = F.get(F.col("parts"), 0)
    piece = F.concat(F.array(at(start, start["t"]["t0"])), F.transform("parts", lambda p: at(p, p["t"]["t1"])))
    return ends.withColumn("line", piece).drop("parts")


def keep_outside(lines: DataFrame, circles: list[tuple[float, float, float]], key: str = "id") -> DataFrame:
    """(key, i, t0, t1): the parts of each segment outside all circles.

    Segments are cut at every crossing, and a part stays if its middle is outside of every circle. The circles are a
    short list of the caller's. Each step is a projection of its own, so that no term is worked out twice.
    """
    d = lambda c: F.col(f"s.{c}").cast("double")
    segs = lines.select(key, F.explode(geo.segments(F.col("line"))).alias("s")).filter("s.x <> s.x2 or s.y <> s.y2")
    ends = segs.select(key, F.col("s.i").alias("i"), d("x").alias("x"), d("y").alias("y"), (d("x2") - d("x")).alias("dx"), (d("y2") - d("y")).alias("dy"))
    ends = ends.withColumn("dd", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    n = range(len(circles))
    part = lambda name, k: F.col(f"{name}{k}")
    away = lambda f, g: {f"{f}{k}": g(k, F.col("x") - circles[k][0], F.col("y") - circles[k][1]) for k in n}
    ends = ends.withColumns(away("fd", lambda k, fx, fy: fx * F.col("dx") + fy * F.col("dy")) | away("ff", lambda k, fx, fy: fx * fx + fy * fy - circles[k][2] ** 2))
    ends = ends.withColumns({f"disc{k}": part("fd", k) * part("fd", k) - F.col("dd") * part("ff", k) for k in n})
    ends = ends.withColumns({f"root{k}": F.when(part("disc", k) >= 0, F.sqrt(part("disc", k))) for k in n})
    ends = ends.withColumns({f"lo{k}": F.greatest(F.lit(0.0), (-part("fd", k) - part("root", k)) / F.col("dd")) for k in n} | {f"hi{k}": F.least(F.lit(1.0), (-part("fd", k) + part("root", k)) / F.col("dd")) for k in n})
    met = lambda k: part("root", k).isNotNull() & (part("hi", k) >= part("lo", k))
    cuts = F.array(F.lit(0.0), F.lit(1.0), *[F.when(met(k), part(name, k)) for k in n for name in ("lo", "hi")])
    cut = ends.withColumn("ts", F.array_sort(F.array_distinct(F.array_compact(cuts)))).select(key, "i", "x", "y", "dx", "dy", "ts")
    spans = cut.select(key, "i", "x", "y", "dx", "dy", F.posexplode("ts").alias("k", "t0"), "ts").withColumn("t1", F.get(F.col("ts"), F.col("k") + 1)).filter("t1 is not null")
    m = (F.col("t0") + F.col("t1")) / 2
    spans = spans.withColumns({"mx": F.col("x") + F.col("dx") * m, "my": F.col("y") + F.col("dy") * m})
    out = F.lit(True)
    for cx, cy, r in circles:
        out = out & ((F.col("mx") - cx) * (F.col("mx") - cx) + (F.col("my") - cy) * (F.col("my") - cy) >= r * r)
    return spans.filter(out).select(key, "i", "t0", "t1")


def crossings(rings: DataFrame, cell: int, group: str = "board") -> DataFrame:
    """(group, a, b): pairs of rings of a group with segments that meet, touching included."""
    s = rings.select(F.col(group).alias("group"), "id", F.explode(geo.segments(F.col("ring"))).alias("s")).select("group", "id", "s.i", "s.x", "s.y", "s.x2", "s.y2")
    met = _meeting(s, cell, F.col("a.id") < F.col("b.id"))
    return met.select(F.col("a.group").alias(group), F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def self_crossings(rings: DataFrame, cell: int) -> DataFrame:
    """(id, crossings, x, y): rings with edges that meet though they aren't neighbours, and the middle between the first two's starts."""
    s = rings.select("id", F.size("ring").alias("n"), F.explode(geo.segments(F.col("ring"))).alias("s")).select(F.col("id").alias("group"), "n", "s.i", "s.x", "s.y", "s.x2", "s.y2")
    apart = (F.col("b.i") > F.col("a.i") + 1) & ~((F.col("a.i") == 1) & (F.col("b.i") == F.col("a.n") - 1))
    met = _meeting(s, cell, apart)
    middle = lambda k: (F.col(f"a.{k}") + F.col(f"b.{k}")) / 2
    first = F.min(F.struct(F.col("a.i").alias("i"), F.col("b.i").alias("j"), middle("x").alias("x"), middle("y").alias("y")))
    return met.groupBy(F.col("a.group").alias("id")).agg(F.count("*").alias("crossings"), first.alias("f")).select("id", "crossings", "f.x", "f.y")


def _meeting(s: DataFrame, cell: int, pairs: Column) -> DataFrame:
    """(a, b): pairs of segments (group, x, y, x2, y2, ..) of a group that meet, of those for which `pairs` holds.

    A uniform grid of `cell` makes it an equi-join: a segment is listed under the cells that its box covers, and a pair of segments
    whose boxes meet is checked in the first cell that both cover.
    """
    s = s.withColumns({"lx": F.least("x", "x2"), "hx": F.greatest("x", "x2"), "ly": F.least("y", "y2"), "hy": F.greatest("y", "y2")})
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    celled = s.withColumn("cx", F.explode(span("lx", "hx"))).withColumn("cy", F.explode(span("ly", "hy")))
    a, b = celled.alias("a"), celled.alias("b")
    c = lambda side, k: F.col(f"{side}.{k}")
    boxes = (c("a", "lx") <= c("b", "hx")) & (c("b", "lx") <= c("a", "hx")) & (c("a", "ly") <= c("b", "hy")) & (c("b", "ly") <= c("a", "hy"))
    first = (c("a", "cx") == F.floor(F.greatest(c("a", "lx"), c("b", "lx")) / cell)) & (c("a", "cy") == F.floor(F.greatest(c("a", "ly"), c("b", "ly")) / cell))
    both = a.join(b, [c("a", k) == c("b", k) for k in ("group", "cx", "cy")] + [pairs, boxes, first])

    def turn(p: str, q: str, x: str) -> Column:
        """The side of segment p on which vertex x of segment q lies."""
        px, py, qx, qy = c(p, "x"), c(p, "y"), c(q, f"x{x}"), c(q, f"y{x}")
        return F.signum((c(p, "x2") - px) * (qy - py) - (c(p, "y2") - py) * (qx - px))

    turns = {f"{p}{q}{x}": turn(p, q, x) for p, q in (("a", "b"), ("b", "a")) for x in ("", "2")}
    sided = both.select(*(F.struct(*(c(p, k) for k in s.columns)).alias(p) for p in "ab"), *(t.alias(k) for k, t in turns.items()))
    # A vertex on a segment's line is on the segment if it is in its box.
    on = lambda p, q, x: (F.col(f"{p}{q}{x}") == 0) & c(q, f"x{x}").between(c(p, "lx"), c(p, "hx")) & c(q, f"y{x}").between(c(p, "ly"), c(p, "hy"))
    proper = (F.col("ab") * F.col("ab2") < 0) & (F.col("ba") * F.col("ba2") < 0)
    meets = proper | on("a", "b", "") | on("a", "b", "2") | on("b", "a", "") | on("b", "a", "2")
    return sided.filter(meets).select("a", "b")


def nearest_pairs(pairs: DataFrame) -> DataFrame:
    """The shortest way from a vertex of `ring` to `other` or back, for each row (id, ring, other); the first one on a tie.

    Each vertex becomes a row with the other ring's segments, so that these are made once for a ring, and the ways are combined by a grouped minimum.
    """
    own, other = geo.segments(F.col("ring")), geo.segments(F.col("other"))
    way = lambda back, of, to: F.struct(F.lit(back).alias("back"), of.alias("of"), to.alias("to"))
    ways = pairs.select("id", F.explode(F.array(way(0, own, other), way(1, other, own))).alias("w"))
    vertices = ways.select("id", F.col("w.back").alias("back"), F.posexplode("w.of").alias("i", "p"), F.col("w.to").alias("to"))
    at = vertices.select("id", "back", "i", F.col("p.x").cast("double").alias("px"), F.col("p.y").cast("double").alias("py"), F.posexplode("to").alias("j", "s"))
    d = lambda c: c.cast("double")
    at = at.select("id", "back", "i", "j", "px", "py", d(F.col("s.x")).alias("x"), d(F.col("s.y")).alias("y"), d(F.col("s.x2") - F.col("s.x")).alias("dx"), d(F.col("s.y2") - F.col("s.y")).alias("dy"))
    x, y, dx, dy, px, py = (F.col(k) for k in ("x", "y", "dx", "dy", "px", "py"))
    at = at.withColumn("t", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x) * dx + (py - y) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)))), F.lit(0.0)))
    at = at.withColumns({"ex": px - (x + F.col("t") * dx), "ey": py - (y + F.col("t") * dy)})
    best = at.groupBy("id").agg(F.min(F.struct((F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey")).alias("d"), "back", "i", "j")).alias("best"))
    return best.select("id", "best.back", F.col("best.i").alias("vertex"), F.col("best.j").alias("segment"), F.sqrt("best.d").alias("distance"))


def interior_points(rings: DataFrame) -> DataFrame:
    """(id, x, y, width): the middle of the widest span inside each ring on its middle scanline; the leftmost on a tie. A batch of rings is worked out as arrays."""
    schema = StructType([rings.schema["id"]])
    for k in ("x", "y", "width"):
        schema = schema.add(k, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ring, x, y, width = _widest(batch.column("segs"), batch.column("y").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(ring)), *map(pa.array, (x, y, width))], schema.names)

    box = rings.select("id", "ring", geo.bounds(F.col("ring")).alias("b")).filter("b.min_y is not null and b.max_y is not null")
    return box.select("id", geo.segments(F.col("ring")).alias("segs"), ((F.col("b.min_y") + F.col("b.max_y")).cast("double") / 2).alias("y")).mapInArrow(run, schema)


def _widest(segs: pa.ListArray, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, x, y, width) of the widest span between every second crossing of a row's segments with its middle height."""
    sizes = np.nan_to_num(pc.list_value_length(segs).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    row, flat = np.repeat(np.arange(len(segs)), sizes), segs.flatten()
    x, y, x2, y2 = (pc.struct_field(flat, k).to_numpy(zero_copy_only=False).astype(float) for k in ("x", "y", "x2", "y2"))
    m = middle[row]
    met = ((y > m) != (y2 > m)) & ~np.isnan(y + y2)
    row, x, y, x2, y2, m = (v[met] for v in (row, x, y, x2, y2, m))
    at = (x2 - x) * (m - y) / (y2 - y) + x
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])[: len(row)])
    n = np.diff(np.append(first, len(row)))
    # A closed ring meets its height an even number of times; of another the last place opens no span.
    opens = (np.arange(len(row)) - np.repeat(first, n)) % 2 == 0
    opens[(first + n - 1)[n % 2 == 1]] = False
    k = np.flatnonzero(opens)
    width = at[k + 1] - at[k]
    best = np.lexsort((k, -width, row[k]))
    best = best[np.append(True, np.diff(row[k][best]) != 0)[: len(best)]]
    return row[k][best], (at[k][best] + at[k + 1][best]) / 2, middle[row[k][best]], width[best]


def first_by_key(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key, with `duplicates`, the number of later ones. Grouped, so a common key is combined before the shuffle."""
    columns = [c for c in df.columns if c != order]
    return df.groupBy(key.alias("_key")).agg(F.min_by(F.struct(order, *columns), order).alias("_r"), (F.count("*") - 1).alias("duplicates")).select("_r.*", "duplicates")


def simplify(lines: DataFrame, tolerance: float) -> DataFrame:
    """(id, line) by Ramer-Douglas-Peucker: a vertex stays if it lies farther than `tolerance` from the chord of the stretch it ends."""
    import numpy as np
    import pandas as pd

    def one(line: list) -> list:
        p = np.array([(v["x"], v["y"]) for v in line], float)
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
        return [line[i] for i in np.flatnonzero(keep)]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "line": [one(list(x)) if len(x) > 2 else list(x) for x in pdf["line"]]})

    return lines.select("id", "line").mapInPandas(run, "id long, line array<struct<x: long, y: long>>")
