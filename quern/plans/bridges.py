"""Queries of lines cut by areas with holes, and of bridges over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import areas
from quern.operators import bridges as br
from quern.operators import spans
from quern.plans.lenses import POLYLINES, polylines
from quern.plans.registry import query

_SHIFT, _SIDE = 128000, 256000


def _moved(line, dx=0, dy=0):
    return F.transform(line, lambda p: F.struct((p["x"] + _SHIFT + dx).alias("x"), (p["y"] + _SHIFT + dy).alias("y")))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(board, id, line): polylines on boards of four."""
    return polylines(spark, sf_dir).select(F.floor(F.col("id") / 4).alias("board"), "id", _moved(F.col("line")).alias("line"))


def _water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(board, ring): each board's water is the closed polylines of the board beside it, even-odd."""
    return _lines(spark, sf_dir).select(F.col("board").bitwiseXOR(F.lit(1).cast("long")).alias("board"), F.concat("line", F.slice("line", 1, 1)).alias("ring"))


def _roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(board, id, line, tunnel, width): every polyline as three roads end to end, the third a few micrometres off."""
    n, line = F.size("line"), F.col("line")
    a, b = F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int")
    parts = F.array(F.slice(line, F.lit(1), a + 1), F.slice(line, a + 1, b - a + 1), F.concat(F.array(F.struct((F.get(line, b)["x"] + 4).alias("x"), (F.get(line, b)["y"] - 3).alias("y"))), F.slice(line, b + 2, n)))
    each = _lines(spark, sf_dir).select("board", F.col("id").alias("whole"), F.posexplode(parts).alias("k", "line"))
    road = (F.col("whole") * 3 + F.col("k")).alias("id")
    return each.select("board", road, "line").withColumns({"tunnel": F.col("id") % 7 == 0, "width": 2500 + F.col("id") % 5 * 400})


_LINES = f"""{POLYLINES}, placed AS (SELECT id // 4 AS board, id, list_transform(line, lambda p: {{'x': p.x + {_SHIFT}, 'y': p.y + {_SHIFT}}}) AS line FROM polylines),
water AS (SELECT xor(board, 1) AS board, id, list_append(line, line[1]) AS ring FROM placed)"""

_ROADS = f"""{_LINES}, roads AS (
  SELECT board, id * 3 + k AS id, CASE k WHEN 0 THEN line[1:n // 3 + 1] WHEN 1 THEN line[n // 3 + 1:2 * n // 3 + 1]
    ELSE list_prepend({{'x': line[2 * n // 3 + 1].x + 4, 'y': line[2 * n // 3 + 1].y - 3}}, line[2 * n // 3 + 2:n]) END AS line
  FROM (SELECT *, len(line) AS n, unnest([0, 1, 2]) AS k FROM placed))"""


def _cut(lines: str) -> str:
    """CTEs up to `cut`, the pieces of `lines`: every segment against every edge of its board."""
    return f"""segs AS (
  SELECT * FROM (SELECT board, id, i, line[i].x AS x, line[i].y AS y, line[i + 1].x AS x2, line[i + 1].y AS y2 FROM (SELECT *, unnest(range(1, len(line))) AS i FROM {lines})) WHERE x <> x2 OR y <> y2),
shore AS (SELECT * FROM (SELECT board, ring[i].x AS px, ring[i].y AS py, ring[i + 1].x AS qx, ring[i + 1].y AS qy FROM (SELECT *, unnest(range(1, len(ring))) AS i FROM water)) WHERE px <> qx OR py <> qy),
pairs AS (
  SELECT s.*, x2 - x AS dx, y2 - y AS dy, qx - px AS ex, qy - py AS ey, (x2 - x) * (py - y) - (y2 - y) * (px - x) AS r1, (x2 - x) * (qy - y) - (y2 - y) * (qx - x) AS r2,
    (qx - px) * (y - py) - (qy - py) * (x - px) AS l1, (qx - px) * (y2 - py) - (qy - py) * (x2 - px) AS l2 FROM segs s JOIN shore USING (board)),
met AS (
  SELECT board, id, i, l1::DOUBLE / (l1 - l2)::DOUBLE AS t FROM pairs
  WHERE (r1 > 0 OR r1 = 0 AND (dy < 0 OR dy = 0 AND dx > 0)) <> (r2 > 0 OR r2 = 0 AND (dy < 0 OR dy = 0 AND dx > 0))
    AND (l1 > 0 OR l1 = 0 AND (ey > 0 OR ey = 0 AND ex < 0)) <> (l2 > 0 OR l2 = 0 AND (ey > 0 OR ey = 0 AND ex < 0))),
started AS (
  SELECT board, id, count(*) % 2 AS odd FROM (SELECT board, id, arg_min(x, i) AS x, arg_min(y, i) AS y FROM segs GROUP BY board, id) JOIN shore USING (board)
  WHERE (py >= y) <> (qy >= y) AND (((qx - px) * (y - py) - (qy - py) * (x - px) > 0 OR (qx - px) * (y - py) - (qy - py) * (x - px) = 0 AND qy > py) = (qy > py)) GROUP BY board, id),
places AS (SELECT board, id, i, [0.0::DOUBLE] || coalesce(ts, []) || [1.0::DOUBLE] AS ts, coalesce(len(ts), 0) AS n FROM segs LEFT JOIN (SELECT board, id, i, list(t ORDER BY t) AS ts FROM met GROUP BY ALL) USING (board, id, i)),
counted AS (SELECT p.*, coalesce(sum(n) OVER (PARTITION BY board, id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + coalesce(odd, 0) AS before FROM places p LEFT JOIN started USING (board, id)),
cut AS (
  SELECT board, id, i, t0, t1, inside, CASE WHEN t1 = 1 THEN x2::DOUBLE ELSE x::DOUBLE + (x2 - x)::DOUBLE * t1 END AS x1, CASE WHEN t1 = 1 THEN y2::DOUBLE ELSE y::DOUBLE + (y2 - y)::DOUBLE * t1 END AS y1,
    CASE WHEN t0 = 1 THEN x2::DOUBLE ELSE x::DOUBLE + (x2 - x)::DOUBLE * t0 END AS x0, CASE WHEN t0 = 1 THEN y2::DOUBLE ELSE y::DOUBLE + (y2 - y)::DOUBLE * t0 END AS y0
  FROM (SELECT board, id, i, ts[k] AS t0, ts[k + 1] AS t1, (before + k - 1) % 2 = 1 AS inside FROM (SELECT *, unnest(range(1, len(ts))) AS k FROM counted)) JOIN segs USING (board, id, i) WHERE t1 - t0 >= 1e-12),
turned AS (SELECT *, CASE WHEN lag(inside) OVER w = inside THEN 0 ELSE 1 END AS new FROM cut WINDOW w AS (PARTITION BY board, id ORDER BY i, t0)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY board, id ORDER BY i, t0)::BIGINT AS run FROM turned),
runs AS (
  SELECT board, id, run, any_value(inside) AS inside, min(i) AS first, arg_min(t0, (i, t0)) AS t0, max(i) AS last, arg_max(t1, (i, t0)) AS t1, sum(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))) AS length,
    arg_min([x0, y0], (i, t0)) AS p, arg_max([x1, y1], (i, t0)) AS q FROM numbered GROUP BY board, id, run)"""


def _whole(c: str):
    return F.floor(F.col(c) + 0.5).cast("long")


@query("line_area_runs", f"WITH {_LINES}, {_cut('placed')} SELECT board, id, run, inside, first, t0, last, t1, floor(length + 0.5)::BIGINT AS length FROM runs")
def line_area_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every polyline cut into its stretches inside and outside of its board's water."""
    found = areas.stretches(_lines(spark, sf_dir), _water(spark, sf_dir))
    return found.select("board", "id", "run", "inside", F.col("first").cast("long").alias("first"), "t0", F.col("last").cast("long").alias("last"), "t1", _whole("length").alias("length"))


_BRIDGES = f"""{_ROADS}, {_cut('roads')}, runs_of AS (SELECT *, max(run) OVER (PARTITION BY board, id) AS n_runs FROM runs),
ends AS (
  SELECT board, id, run, inside, run = 1 AS line_end, p[1] AS x, p[2] AS y FROM runs_of UNION ALL SELECT board, id, run, inside, run = n_runs, q[1], q[2] FROM runs_of),
keyed AS (SELECT *, floor(x * 10 + 0.5)::BIGINT AS kx, floor(y * 10 + 0.5)::BIGINT AS ky FROM ends),
dry AS (SELECT DISTINCT board, kx, ky, true AS dry FROM keyed WHERE NOT inside AND line_end),
wet AS (
  SELECT board, id, run, kx, ky, x, y, CASE WHEN NOT line_end THEN 'exit' WHEN x <= 0.001 OR y <= 0.001 OR x >= {_SIDE} - 0.001 OR y >= {_SIDE} - 0.001 THEN 'edge' WHEN dry THEN 'exit' ELSE 'node' END AS kind
  FROM keyed LEFT JOIN dry USING (board, kx, ky) WHERE inside AND id % 7 <> 0),
nodes AS (SELECT * FROM wet WHERE kind = 'node'),
bits AS (SELECT board, id, run, x0, y0, x1 - x0 AS dx, y1 - y0 AS dy FROM numbered WHERE inside AND id % 7 <> 0),
near AS (
  SELECT board, a, ar, b, br, x - (x0 + t * dx) AS ex, y - (y0 + t * dy) AS ey
  FROM (SELECT n.board, n.id AS a, n.run AS ar, n.x, n.y, b.id AS b, b.run AS br, x0, y0, dx, dy, coalesce(greatest(0, least(1, ((n.x - x0) * dx + (n.y - y0) * dy) / nullif(dx * dx + dy * dy, 0))), 0) AS t
    FROM nodes n JOIN bits b ON b.board = n.board AND (b.id <> n.id OR b.run <> n.run))),
links AS (
  SELECT board, a, ar, b, br FROM near WHERE ex * ex + ey * ey <= 100
  UNION SELECT m.board, m.id, m.run, n.id, n.run FROM nodes m JOIN nodes n USING (board, kx, ky)),
both_ways AS (SELECT * FROM links UNION SELECT board, b, br, a, ar FROM links),
reach AS (
  SELECT board, id, run, id AS root, run AS root_run FROM (SELECT DISTINCT board, id, run FROM wet)
  UNION SELECT r.board, b, br, root, root_run FROM reach r JOIN both_ways l ON l.board = r.board AND l.a = r.id AND l.ar = r.run),
roots AS (SELECT board, id, run, min((root, root_run)) AS root FROM reach GROUP BY board, id, run),
exits AS (SELECT board, id, run, count(*) FILTER (kind = 'exit') AS exits FROM wet GROUP BY board, id, run),
found AS (SELECT *, sum(exits) OVER (PARTITION BY board, root) >= 2 AS bridge FROM exits JOIN roots USING (board, id, run) JOIN (SELECT board, id, run, length FROM runs) USING (board, id, run))"""
_BRIDGES = _BRIDGES.replace("FILTER (kind", "FILTER (WHERE kind")


@query("bridge_spans", f"WITH RECURSIVE {_BRIDGES} SELECT board, id, run, exits, root[1] AS root_id, root[2] AS root_run, bridge, floor(length + 0.5)::BIGINT AS length FROM found")
def bridge_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of a road over water, with the crossing that it belongs to."""
    found = br.crossings(_roads(spark, sf_dir), _water(spark, sf_dir), _SIDE, _SIDE, lined=False)
    return found.select("board", "id", "run", "exits", F.col("root.id").alias("root_id"), F.col("root.run").alias("root_run"), "bridge", _whole("length").alias("length"))


@query(
    "bridge_report",
    f"""WITH RECURSIVE {_BRIDGES}, w AS (SELECT *, 2500 + id % 5 * 400 AS width FROM found)
SELECT board, count(*) FILTER (WHERE bridge) AS spans, count(DISTINCT root) FILTER (WHERE NOT bridge) AS dead_ends, count(*) FILTER (WHERE bridge AND width < 3000) AS narrow,
  min(width) FILTER (WHERE bridge AND width < 3000) AS thinnest, floor(max(length) FILTER (WHERE bridge AND width < 3000) + 0.5)::BIGINT AS longest FROM w GROUP BY board""",
)
def bridge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridges, dead ends and narrow tabs of each board."""
    roads = _roads(spark, sf_dir)
    out = br.bridge_report(br.crossings(roads, _water(spark, sf_dir), _SIDE, _SIDE, lined=False), roads)
    return out.select("board", "spans", "dead_ends", "narrow", "thinnest", _whole("longest").alias("longest"))


@query("tunnels_over_water", f"WITH {_ROADS}, {_cut('roads')} SELECT DISTINCT board, id FROM runs WHERE inside AND id % 7 = 0")
def tunnels_over_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tunnels below water."""
    return br.tunnels_over_water(_roads(spark, sf_dir), _water(spark, sf_dir))


@query(
    "least_widths",
    f"""WITH {_LINES}, segs AS (
  SELECT * FROM (SELECT board, id, i, line[i].x AS x, line[i].y AS y, line[i + 1].x AS x2, line[i + 1].y AS y2 FROM (SELECT *, unnest(range(1, len(line))) AS i FROM placed)) WHERE x <> x2 OR y <> y2),
sized AS (SELECT *, sqrt((x2 - x)::DOUBLE * (x2 - x)::DOUBLE + (y2 - y)::DOUBLE * (y2 - y)::DOUBLE) AS size FROM segs),
walked AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY board, id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS walked, sum(size) OVER (PARTITION BY board, id) AS length FROM sized),
placed_at AS (SELECT *, unnest(range(0, ceil(size / 2000)::BIGINT)) * 2000 AS d FROM walked),
sta AS (SELECT board, id, x + (x2 - x)::DOUBLE * (d / size) AS px, y + (y2 - y)::DOUBLE * (d / size) AS py FROM placed_at WHERE walked + d >= least(length * 0.1, 2000) AND walked + d <= length - least(length * 0.1, 2000)),
shore AS (SELECT * FROM (SELECT board, ring[i].x AS x, ring[i].y AS y, (ring[i + 1].x - ring[i].x)::DOUBLE AS dx, (ring[i + 1].y - ring[i].y)::DOUBLE AS dy FROM (SELECT *, unnest(range(1, len(ring))) AS i FROM water)) WHERE dx <> 0 OR dy <> 0),
near AS (SELECT board, id, px - (x + t * dx) AS ex, py - (y + t * dy) AS ey FROM (SELECT board, id, px, py, x, y, dx, dy, greatest(0, least(1, ((px - x) * dx + (py - y) * dy) / (dx * dx + dy * dy))) AS t FROM sta JOIN shore USING (board))),
best AS (SELECT board, id, min(sqrt(ex * ex + ey * ey)) AS distance FROM near GROUP BY board, id)
SELECT board, id, round(coalesce(distance * 2, 0), 3) AS width FROM placed LEFT JOIN best USING (board, id)""",
)
def least_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least width between every polyline and the shores of its board."""
    found = spans.least_widths(_lines(spark, sf_dir), _water(spark, sf_dir), 500, step=2000)
    return found.select("board", "id", F.round("width", 3).alias("width"))
