"""Queries of projections between the globe, maps, boards and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import frames as fr
from quern.functions import geometry as geo
from quern.plans.lenses import POINTS, POLYLINES, points, polylines
from quern.plans.registry import query

_D = lambda c: c.cast("double")


def _micro(c: Column, scale: float = 1e6) -> Column:
    return F.floor(c * scale + 0.26)


_MX = "({lng} + 180) / 360"
_MY = "(1 - ln(tan(({lat}) * pi() / 180) + 1 / cos(({lat}) * pi() / 180)) / pi()) / 2"
_CORNERS = (("nw", -3.0, 4.0), ("ne", 5.0, 4.5), ("se", 6.0, -3.5), ("sw", -2.5, -4.0))
_CROPPED = f"""c AS (SELECT id, lng / 40 AS lng, lat / 25 AS lat, (id % 5) / 8::DOUBLE AS s FROM points),
k AS (SELECT id, lng, lat, {', '.join(f"{_MX.format(lng=f'({lng} + s)')} AS {n}x, {_MY.format(lat=f'({lat} + s)')} AS {n}y" for n, lng, lat in _CORNERS)}, {_MX.format(lng='lng')} AS qx, {_MY.format(lat='lat')} AS qy,
  -3.0 + s AS west, -4.0 + s AS south, 6.0 + s AS east, 4.5 + s AS north FROM c)"""
_BI = "(1 - ({u})) * (1 - ({v})) * nw{k} + ({u}) * (1 - ({v})) * ne{k} + ({u}) * ({v}) * se{k} + (1 - ({u})) * ({v}) * sw{k}"


def _newton() -> str:
    at = lambda u, v, k: _BI.format(u=u, v=v, k=k)
    steps = f"""w AS (SELECT k.*, 0.5::DOUBLE AS u, 0.5::DOUBLE AS v, 0 AS step FROM k UNION ALL
  SELECT * EXCLUDE (zx, zy, ux, uy, vx, vy, u, v, step), coalesce(u + ((qx - zx) * vy - (qy - zy) * vx) / nullif(ux * vy - uy * vx, 0), u), coalesce(v + (ux * (qy - zy) - uy * (qx - zx)) / nullif(ux * vy - uy * vx, 0), v), step + 1
  FROM (SELECT *, (({at('u + 1e-6', 'v', 'x')}) - zx) / 1e-6 AS ux, (({at('u + 1e-6', 'v', 'y')}) - zy) / 1e-6 AS uy, (({at('u', 'v + 1e-6', 'x')}) - zx) / 1e-6 AS vx, (({at('u', 'v + 1e-6', 'y')}) - zy) / 1e-6 AS vy
    FROM (SELECT *, {at('u', 'v', 'x')} AS zx, {at('u', 'v', 'y')} AS zy FROM w)) WHERE step < {fr.STEPS})"""
    return f"""WITH RECURSIVE {POINTS}, {_CROPPED}, {steps}
SELECT id, floor(u * 300 * 1e4 + 0.26)::BIGINT AS x, floor(v * 200 * 1e4 + 0.26)::BIGINT AS y, floor(((({at('0.25', '0.75', 'x')}) * 360 - 180)) * 1e6 + 0.26)::BIGINT AS lng,
  floor(atan(sinh(pi() * (1 - 2 * ({at('0.25', '0.75', 'y')})))) * 180 / pi() * 1e6 + 0.26)::BIGINT AS lat, west, south, east, north FROM w WHERE step = {fr.STEPS}"""


@query("crop_projection", _newton())
def crop_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in a four-cornered crop of 300 x 200 mm, a place of the crop back on the globe, and the crop's box."""
    s = F.col("id") % 5 / F.lit(8.0)
    corner = lambda lng, lat: F.struct((F.lit(lng) + s).alias("lng"), (F.lit(lat) + s).alias("lat"))
    p = points(spark, sf_dir).select("id", (F.col("lng") / 40).alias("lng"), (F.col("lat") / 25).alias("lat"), fr.crop(*(corner(lng, lat) for _, lng, lat in _CORNERS)).alias("crop"))
    p = p.withColumn("at", fr.corners(F.col("crop")))
    p = fr.crop_project(p, "at", "lng", "lat", 300.0, 200.0).withColumn("back", fr.crop_unproject(F.col("at"), F.lit(75.0), F.lit(150.0), 300.0, 200.0))
    return p.select("id", _micro(F.col("mm.x"), 1e4).alias("x"), _micro(F.col("mm.y"), 1e4).alias("y"), _micro(F.col("back.lng")).alias("lng"), _micro(F.col("back.lat")).alias("lat"), "crop.west", "crop.south", "crop.east", "crop.north")


_CLAMP = "greatest(-85.051129::DOUBLE, least(85.051129::DOUBLE, {x}))"


@query(
    "map_projection",
    f"""WITH {POINTS}, v AS (SELECT *, (rank % 9)::DOUBLE + 2 AS zoom, CASE WHEN id % 50 = 0 THEN NULL ELSE (80 + id % 40)::DOUBLE / (400 + id % 7 * 50)::DOUBLE END AS mm, lng / 2 AS clng, lat / 2 AS clat FROM points),
q AS (SELECT *, 512 * pow(2, zoom) * mm AS scale, ({_MX.format(lng='lng')}) - ({_MX.format(lng='clng')}) AS dx, ({_MY.format(lat=_CLAMP.format(x='lat'))}) - ({_MY.format(lat=_CLAMP.format(x='clat'))}) AS dy FROM v)
SELECT id, floor(dx * scale * 1e4 + 0.26)::BIGINT AS x, floor(dy * scale * 1e4 + 0.26)::BIGINT AS y, floor((dx * 512 * pow(2, zoom) * (228.6::DOUBLE / 900) + 114.3::DOUBLE) * 1e4 + 0.26)::BIGINT AS board_x,
  floor((dy * 512 * pow(2, zoom) * (228.6::DOUBLE / 900) + 76.2::DOUBLE) * 1e4 + 0.26)::BIGINT AS board_y, floor(-(600 * mm / 2) * 1e4 + 0.26)::BIGINT AS west, floor(400 * mm / 2 * 1e4 + 0.26)::BIGINT AS south FROM q""",
)
def map_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in millimetres from the middle of a map and from a board's corner, and the map's corners; null without a scale."""
    i = F.col("id")
    diameter = F.when(i % 50 == 0, 0.0).otherwise(_D(80 + i % 40))
    p = points(spark, sf_dir).withColumns({"zoom": _D(F.col("rank") % 9) + 2, "mm": fr.map_scale(diameter, _D(400 + i % 7 * 50)), "clng": F.col("lng") / 2, "clat": F.col("lat") / 2})
    at = (F.col("lng"), F.col("lat"), F.col("clng"), F.col("clat"), F.col("zoom"), 512)
    p = p.select("id", fr.map_project(*at, F.col("mm")).alias("p"), fr.board_project(*at, F.lit(228.6), F.lit(152.4), F.lit(900.0)).alias("b"), fr.viewport_corners(F.lit(600.0), F.lit(400.0), F.col("mm")).alias("c"))
    far = lambda c: _micro(F.col(c), 1e4)
    return p.select("id", far("p.x").alias("x"), far("p.y").alias("y"), far("b.x").alias("board_x"), far("b.y").alias("board_y"), far("c.nw.x").alias("west"), far("c.sw.y").alias("south"))


@query(
    "projected_lines",
    f"""WITH {POLYLINES}, v AS (SELECT id, unnest(range(1, len(line) + 1)) AS i, line FROM polylines), g AS (SELECT id, i, line[i].x / 131072::DOUBLE AS lng, line[i].y / 131072::DOUBLE AS lat FROM v)
SELECT id, sum(floor((({_MX.format(lng='lng')}) - 0.5) * 512 * 64 * 1e4 + 0.26))::BIGINT AS sum_x, sum(floor((({_MY.format(lat='lat')}) - ({_MY.format(lat='0::DOUBLE')})) * 512 * 64 * 1e4 + 0.26))::BIGINT AS sum_y, count(*) + 1 AS vertices, (id % 500)::BIGINT AS moved FROM g GROUP BY id""",
)
def projected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on the globe as millimetres of a map, closed, and moved by as much as their id says."""
    degrees = F.transform("line", lambda p: F.struct((p["x"] / F.lit(131072.0)).alias("lng"), (p["y"] / F.lit(131072.0)).alias("lat")))
    project = lambda lng, lat: fr.map_project(lng, lat, F.lit(0.0), F.lit(0.0), F.lit(6.0), 512, F.lit(1.0))
    lines = polylines(spark, sf_dir).select("id", fr.project_rings(F.array(degrees), project).alias("rings"))
    ring = lambda c: F.get(F.col(c), 0)
    moved = lines.withColumn("moved", fr.translate(F.col("rings"), _D(F.col("id") % 500), F.lit(0.0)))
    total = lambda k: F.aggregate(ring("rings"), F.lit(0).cast("long"), lambda a, p: a + _micro(p[k], 1e4))
    shift = F.round(F.get(ring("moved"), 0)["x"] - F.get(ring("rings"), 0)["x"], 3).cast("long")
    return moved.select("id", total("x").alias("sum_x"), total("y").alias("sum_y"), (F.size(ring("rings")) + 1).cast("long").alias("vertices"), shift.alias("moved"))


@query(
    "grid_specs",
    f"""WITH RECURSIVE p AS (SELECT p_partkey AS id, (50 + p_partkey * 7 % 1171)::DOUBLE AS w, (50 + p_partkey * 13 % 1171)::DOUBLE AS h FROM part),
g AS (SELECT id, w, h, greatest(w, h) / greatest({fr.LEAST_SIDE}::DOUBLE, floor({fr.LONG_SIDE} * sqrt(2 * (w + h) / {fr.PERIMETER}::DOUBLE) + 0.5)) AS cell, 0 AS step FROM p UNION ALL
  SELECT id, w, h, cell * greatest(1.001::DOUBLE, sqrt((ceil(w / cell - 1e-9) + 2) * (ceil(h / cell - 1e-9) + 2) / {fr.MOST_SAMPLES}::DOUBLE)), step + 1 FROM g WHERE (ceil(w / cell - 1e-9) + 2) * (ceil(h / cell - 1e-9) + 2) > {fr.MOST_SAMPLES}),
f AS (SELECT id, w, h, arg_max(cell, step) AS cell FROM g GROUP BY ALL), t AS (SELECT *, ceil(w / cell - 1e-9)::BIGINT + 2 AS columns, ceil(h / cell - 1e-9)::BIGINT + 2 AS rows, least(greatest(0.5::DOUBLE, greatest(w, h) / 512), greatest(w, h) / 64) AS tc FROM f)
SELECT id, columns, rows, floor((w - columns * cell) / 2 * 1e6 + 0.26)::BIGINT AS x, floor(((h - rows * cell) / 2 + (3 + 0.5::DOUBLE) * cell) * 1e6 + 0.26)::BIGINT AS row_3, ceil(w / tc)::BIGINT + 2 AS terrain_columns, ceil(h / tc)::BIGINT + 2 AS terrain_rows,
  floor((10 - tc + (7.25::DOUBLE + 0.5::DOUBLE) * tc) * 1e6 + 0.26)::BIGINT AS traced_x FROM t""",
)
def grid_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids for boards and shorelines of the parts' sizes, and places in them."""
    from quern.plans.lenses import table

    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k.alias("id"), _D(50 + k * 7 % 1171).alias("w"), _D(50 + k * 13 % 1171).alias("h"))
    box = F.struct(F.lit(10.0).alias("min_x"), F.lit(10.0).alias("min_y"), (F.col("w") + 10).alias("max_x"), (F.col("h") + 10).alias("max_y"))
    p = p.withColumns({"g": fr.working_grid(F.col("w"), F.col("h")), "t": fr.terrain_grid(box, 0.5, 64, 512)})
    centre = lambda g, c, r, k: _micro(fr.cell_centre(F.col(g), F.lit(c), F.lit(r))[k])
    return p.select("id", "g.columns", "g.rows", _micro(F.col("g.x")).alias("x"), centre("g", 0.0, 3.0, "y").alias("row_3"), F.col("t.columns").alias("terrain_columns"), F.col("t.rows").alias("terrain_rows"), centre("t", 7.25, 0.0, "x").alias("traced_x"))


_CORNER_NAMES = ("top-left", "top-right", "bottom-left", "bottom-right", "custom")


@query(
    "view_transforms",
    f"""WITH {POINTS}, v AS (SELECT id, lng, lat, (id % 6)::DOUBLE AS s, lng * 4 + 500 AS l, lat * 4 + 300 AS t FROM points),
b AS (SELECT *, greatest(0, least(900, l - 20)) AS le, greatest(0, least(600, t - 10)) AS tt, greatest(0, least(900, l + 60 - 20)) AS ri, greatest(0, least(600, t + 40 - 10)) AS bo FROM v)
SELECT id, CASE WHEN s > 0 THEN floor((lng - 400) / s * 1e6 + 0.26)::BIGINT END AS mm_x, floor((300 + lat * s) * 1e6 + 0.26)::BIGINT AS px_y, floor((12 + (lng + 57) * s) * 1e6 + 0.26)::BIGINT AS container_x,
  CASE WHEN ri > le AND bo > tt THEN floor(le * 64)::BIGINT END AS box_left, CASE WHEN ri > le AND bo > tt THEN floor(bo * 64)::BIGINT END AS box_bottom,
  CASE id % 5 WHEN 0 THEN 8 + s / 2 WHEN 2 THEN 8 + s / 2 WHEN 1 THEN 300 - 8 - s / 2 WHEN 3 THEN 300 - 8 - s / 2 END AS corner_x, CASE WHEN id % 5 IN (0, 1) THEN 8 + s / 2 WHEN id % 5 IN (2, 3) THEN 200 - 8 - s / 2 END AS corner_y FROM b""",
)
def view_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places between a map element, its container and the product, the part of a frame on a canvas, and symbols in corners."""
    lng, lat, s, i = F.col("lng"), F.col("lat"), F.col("s"), F.col("id")
    p = points(spark, sf_dir).withColumn("s", _D(i % 6))
    lit = lambda **k: F.struct(*(F.lit(float(v)).alias(n) for n, v in k.items()))
    frame = F.struct((lng * 4 + 500).alias("left"), (lat * 4 + 300).alias("top"), (lng * 4 + 560).alias("right"), (lat * 4 + 340).alias("bottom"))
    p = p.withColumns({
        "mm": fr.map_px_to_mm(lng, lat, F.lit(800.0), F.lit(600.0), s), "px": fr.mm_to_map_px(lng, lat, F.lit(800.0), F.lit(600.0), s),
        "box": fr.query_box(frame, lit(left=20, top=10, width=900, height=600)), "corner": fr.corner_position(F.element_at(F.array(*map(F.lit, _CORNER_NAMES)), (i % 5 + 1).cast("int")), F.lit(300.0), F.lit(200.0), s),
        "container": fr.mm_to_container_px(lng, lat, F.lit(-57.0), F.lit(-57.0), F.lit(12.0), F.lit(12.0), s),
    })
    return p.select(
        "id", F.when(~F.isnan("mm.x"), _micro(F.col("mm.x"))).alias("mm_x"), _micro(F.col("px.y")).alias("px_y"), _micro(F.col("container.x")).alias("container_x"),
        F.floor(F.col("box.left") * 64).alias("box_left"), F.floor(F.col("box.bottom") * 64).alias("box_bottom"), F.col("corner.x").alias("corner_x"), F.col("corner.y").alias("corner_y"),
    )


_DEGREE = 111_320


@query(
    "globe_measures",
    f"""WITH {POLYLINES}, g AS (SELECT id, list_transform(list_append(line, line[1]), lambda p: {{'x': p.x / 65536::DOUBLE, 'y': p.y / 65536::DOUBLE}}) AS r FROM polylines),
a AS (SELECT id, r, abs(list_sum(list_transform(range(1, len(r)), lambda i: r[i].x * r[i + 1].y - r[i + 1].x * r[i].y)) / 2) * {_DEGREE}::DOUBLE * {_DEGREE}::DOUBLE * cos(r[1].y * pi() / 180) AS m2 FROM g)
SELECT a.id, floor(a.m2 + 0.26)::BIGINT AS ring_m2, floor(greatest(0, a.m2 - coalesce(b.m2, 0)) + 0.26)::BIGINT AS holed_m2,
  floor(sqrt(((a.r[1].x - a.r[2].x) * cos(a.r[1].y * pi() / 180)) * ((a.r[1].x - a.r[2].x) * cos(a.r[1].y * pi() / 180)) + (a.r[1].y - a.r[2].y) * (a.r[1].y - a.r[2].y)) * {_DEGREE}::DOUBLE * 1000 + 0.26)::BIGINT AS first_mm
FROM a LEFT JOIN a b ON b.id = a.id + 1""",
)
def globe_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square metres of rings in degrees, alone and with the next ring as a hole, and millimetres of their first edges."""
    degrees = F.transform(F.concat("line", F.slice("line", 1, 1)), lambda p: fr.pair(p["x"] / F.lit(65536.0), p["y"] / F.lit(65536.0)))
    r = polylines(spark, sf_dir).select("id", degrees.alias("r"))
    r = r.select("id", "r", geo.ring_square_metres(F.col("r")).alias("m2"))
    hole = r.select((F.col("id") - 1).alias("h"), F.col("m2").alias("hole"))
    out = r.join(hole, F.col("id") == F.col("h"), "left")
    first = geo.distance_metres(F.get("r", 0), F.get("r", 1))
    return out.select("id", F.floor(F.col("m2") + 0.26).alias("ring_m2"), F.floor(F.greatest(F.lit(0.0), F.col("m2") - F.coalesce("hole", F.lit(0.0))) + 0.26).alias("holed_m2"), F.floor(first * 1000 + 0.26).alias("first_mm"))
