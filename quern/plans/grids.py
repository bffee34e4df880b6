"""Queries on the elevation-grid lens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import scalars as sc
from quern.functions.scalars import noise_word
from quern.operators import grid as g
from quern.plans.lenses import GRID, SIDE, grid
from quern.plans.registry import ORACLES, query
from quern.plans.scalars import _fractal


@query(
    "quantile_bands",
    f"""WITH {GRID}, n AS (SELECT board, count(*) AS samples FROM grid GROUP BY board),
t AS (SELECT board, layer, p, percentile_disc(1 - p) WITHIN GROUP (ORDER BY v) AS x FROM grid, (VALUES (2, 0.5), (3, 0.25), (4, 0.12)) l(layer, p) GROUP BY ALL),
k AS (SELECT board, samples, layer, p, greatest(1, least(samples, ceil(p::DOUBLE * samples)))::BIGINT AS k FROM n, (VALUES (2, 0.5), (3, 0.25), (4, 0.12)) l(layer, p)),
r AS (SELECT board, v, row_number() OVER (PARTITION BY board ORDER BY v DESC) AS rn FROM grid)
SELECT k.board, layer, p::DOUBLE * 100 AS target_pct, r.v AS threshold, (SELECT count(*) FROM grid x WHERE x.board = k.board AND x.v >= r.v) AS cells, samples
FROM k JOIN r ON r.board = k.board AND r.rn = k.k""",
)
def quantile_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.quantile_bands(grid(spark, sf_dir))


@query(
    "contour_elevations",
    f"WITH {GRID}, b AS (SELECT board, min(v) AS low, max(v) AS high FROM grid GROUP BY board) SELECT board, i, low, high, floor((low + i * (high - low) / 9::DOUBLE) * 1000 + 0.5)::BIGINT AS elevation_milli FROM b, range(1, 9) t(i) WHERE high > low",
)
def contour_elevations(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = grid(spark, sf_dir).groupBy("board").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    out = g.contour_elevations(bounds, 8)
    return out.select("board", "i", "low", "high", F.floor(F.col("elevation") * 1000 + 0.5).alias("elevation_milli"))


_CELLS = f"""{GRID}, cells AS (
  SELECT a.board, a.r, a.c, a.v AS tl, b.v AS tr, d.v AS br, e.v AS bl FROM grid a JOIN grid b ON b.board = a.board AND b.r = a.r AND b.c = a.c + 1
  JOIN grid d ON d.board = a.board AND d.r = a.r + 1 AND d.c = a.c + 1 JOIN grid e ON e.board = a.board AND e.r = a.r + 1 AND e.c = a.c
), mid AS (SELECT board, (min(v) + max(v)) // 2 AS threshold FROM grid GROUP BY board
), cased AS (SELECT *, (tl >= threshold)::INT + 2 * (tr >= threshold)::INT + 4 * (br >= threshold)::INT + 8 * (bl >= threshold)::INT AS kase FROM cells JOIN mid USING (board))"""


def _middle(df: DataFrame) -> DataFrame:
    return df.groupBy("board").agg(F.floor((F.min("v") + F.max("v")) / 2).alias("threshold"))


@query("marching_case_histogram", f"WITH {_CELLS} SELECT board, kase AS case_index, count(*) AS cells FROM cased GROUP BY ALL")
def marching_case_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = grid(spark, sf_dir)
    cased = g.cells(samples).join(_middle(samples), "board").withColumn("case_index", g.case_index(F.col("threshold")))
    return cased.groupBy("board", "case_index").agg(F.count("*").alias("cells"))


@query(
    "marching_segments",
    f"""WITH {_CELLS}, e AS (
  SELECT *, k, (kase >> k) & 1 = 1 AND (kase >> ((k + 1) % 4)) & 1 = 0 AS leaves, (kase >> k) & 1 = 0 AND (kase >> ((k + 1) % 4)) & 1 = 1 AS enters FROM cased, range(4) t(k)
), x AS (SELECT * FROM e WHERE leaves), y AS (SELECT board, r, c, k AS entry FROM e WHERE enters)
SELECT board, threshold, r, c, k::INT AS from_edge, (CASE WHEN kase NOT IN (5, 10) THEN (SELECT min(entry) FROM y WHERE y.board = x.board AND y.r = x.r AND y.c = x.c)
  WHEN (tl * br - tr * bl)::DOUBLE / (tl + br - tr - bl)::DOUBLE >= threshold THEN (k + 1) % 4 ELSE (k + 3) % 4 END)::INT AS to_edge FROM x""",
)
def marching_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = grid(spark, sf_dir)
    return g.marching_segments(samples, _middle(samples))


@query(
    "gaussian_smooth",
    f"""WITH {GRID}, k AS (SELECT * FROM (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) t(k, w)), spots AS (SELECT board, p FROM (SELECT DISTINCT board FROM grid), range(64) t(p)),
h AS (SELECT a.board, g.r, a.p AS c, sum(g.v * w) AS v, sum(w) AS n FROM spots a, k JOIN grid g ON g.board = a.board AND g.c = greatest(0, least(63, a.p + k)) GROUP BY ALL)
SELECT a.board, a.p AS r, h.c, sum(h.v * w)::BIGINT AS total FROM spots a, k JOIN h ON h.board = a.board AND h.r = greatest(0, least(63, a.p + k)) AND h.n = 16 GROUP BY ALL HAVING sum(w) = 16""",
)
def gaussian_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.smooth(grid(spark, sf_dir), (1, 4, 6, 4, 1), SIDE)


@query(
    "octile_distance",
    f"""WITH {GRID}, frame AS (SELECT board, r, c FROM (SELECT DISTINCT board FROM grid), range(-1, 65) t(r), range(-1, 65) u(c)),
outside AS (SELECT * FROM frame f WHERE NOT EXISTS (SELECT 1 FROM grid g WHERE g.board = f.board AND g.r = f.r AND g.c = f.c)),
pairs AS (SELECT g.board, g.r, g.c, abs(g.r - o.r) AS dy, abs(g.c - o.c) AS dx FROM grid g JOIN outside o ON o.board = g.board),
best AS (SELECT board, r, c, arg_min({{'s': greatest(dx, dy) - least(dx, dy), 'd': least(dx, dy)}}, greatest(dx, dy) - least(dx, dy) + least(dx, dy) * sqrt(2::DOUBLE)) AS m FROM pairs GROUP BY ALL)
SELECT board, r, c, m.s AS straight, m.d AS diagonal FROM best""",
)
def octile_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.octile_distance(grid(spark, sf_dir), SIDE)


@query(
    "resample_bilinear",
    f"""WITH {GRID}, p AS (SELECT board, r, c, r * 63 // 40 AS y, c * 63 // 40 AS x, r * 63 % 40 AS fy, c * 63 % 40 AS fx FROM (SELECT DISTINCT board FROM grid), range(41) t(r), range(41) u(c))
SELECT p.board, p.r::INT AS r, p.c::INT AS c, (a.v * (40 - fy) * (40 - fx) + b.v * (40 - fy) * fx + d.v * fy * (40 - fx) + e.v * fy * fx)::BIGINT AS v FROM p
JOIN grid a ON a.board = p.board AND a.r = y AND a.c = x JOIN grid b ON b.board = p.board AND b.r = y AND b.c = least(x + 1, 63)
JOIN grid d ON d.board = p.board AND d.r = least(y + 1, 63) AND d.c = x JOIN grid e ON e.board = p.board AND e.r = least(y + 1, 63) AND e.c = least(x + 1, 63)""",
)
def resample_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.resample(grid(spark, sf_dir), SIDE, 41)


_WATER_BODIES = f"""WITH RECURSIVE {GRID}, wet AS (
  SELECT b.board, r, c, r * 64 + c AS id FROM (SELECT DISTINCT board FROM grid) b, range(64) t(r), range(64) u(c)
  WHERE NOT EXISTS (SELECT 1 FROM grid g WHERE g.board = b.board AND g.r = t.r AND g.c = u.c)
), near AS MATERIALIZED (
  SELECT a.board, a.id, b.id AS other FROM wet a, range(-1, 2) y(dy), range(-1, 2) x(dx), wet b WHERE b.board = a.board AND b.r = a.r + dy AND b.c = a.c + dx
), reach AS (
  SELECT board, id AS start, id FROM wet
  UNION SELECT q.board, q.start, n.other FROM reach q JOIN near n ON n.board = q.board AND n.id = q.id
), least AS (SELECT board, start, min(id) AS first FROM reach GROUP BY ALL)
SELECT board, row_number() OVER (PARTITION BY board ORDER BY first) - 1 AS body, count(*) AS cells, first FROM least GROUP BY board, first"""


@query("water_bodies", _WATER_BODIES)
def water_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.water_bodies(grid(spark, sf_dir), SIDE)


@query(
    "depth_terrain",
    ORACLES["octile_distance"].replace("SELECT board, r, c, m.s AS straight, m.d AS diagonal FROM best", """, d AS (SELECT board, r, c, m.s + m.d * sqrt(2::DOUBLE) AS d FROM best),
t AS (SELECT board, r, c, d / max(d) OVER (PARTITION BY board) AS t FROM d), p AS (SELECT board, r, c, t * (2 - t) AS v FROM t)
SELECT board, r, c, floor((CASE WHEN v <= 0 THEN v ELSE v + (greatest(1, least(6, floor(v * 6 + 0.5))) / 6::DOUBLE - v) * 0.5::DOUBLE END) * 1e7 + 0.26)::BIGINT AS depth FROM p"""),
)
def depth_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths by distance from the shore: normalised on each board, shaped as a basin and drawn to six benches."""
    d = g.octile_distance(grid(spark, sf_dir), SIDE).withColumn("d", F.col("straight") + F.col("diagonal") * F.sqrt(F.lit(2.0)))
    t = d.withColumn("t", F.col("d") / F.max("d").over(Window.partitionBy("board")))
    v = t.withColumn("v", sc.profile(F.lit("smooth-basin"), F.col("t")))
    return v.select("board", "r", "c", F.floor(sc.terrace(F.col("v"), 6, 0.5) * 1e7 + 0.26).alias("depth"))


_TERRAIN = g.Terrain(deepest=0.8, bank=0.75, shelf=0.2, terracing=0.5, noise=0.4, feature=0.25, seed=5, octaves=2, ridged=0.2, least_cells=2)


def _terrain_sql() -> str:
    head = _WATER_BODIES[: _WATER_BODIES.index("SELECT board, row_number()")]
    t = _TERRAIN
    return f"""{head}, spot AS (SELECT w.board, w.r, w.c, w.id AS cell, w.board * 4096 + w.id AS id, l.first FROM wet w JOIN least l ON l.board = w.board AND l.start = w.id),
land AS (SELECT board, r, c FROM grid UNION ALL SELECT board, r, c FROM (SELECT DISTINCT board FROM grid), range(-1, 65) t(r), range(-1, 65) u(c) WHERE r IN (-1, 64) OR c IN (-1, 64)),
away AS (SELECT s.id, min(greatest(abs(s.r - o.r), abs(s.c - o.c)) - least(abs(s.r - o.r), abs(s.c - o.c)) + least(abs(s.r - o.r), abs(s.c - o.c)) * sqrt(2::DOUBLE)) AS d FROM spot s JOIN land o ON o.board = s.board GROUP BY s.id),
placed AS (SELECT spot.*, d, count(*) OVER b AS n, max(d) OVER b AS far FROM spot JOIN away USING (id) WINDOW b AS (PARTITION BY board, first)),
sized AS (SELECT *, CASE WHEN n < {t.least_cells} THEN 0 ELSE sqrt(n::DOUBLE / max(n) OVER (PARTITION BY board)::DOUBLE) END AS scale, (d - 0.5::DOUBLE) / (far - 0.5::DOUBLE) AS t, (c + 0.5::DOUBLE) / 16 AS x, (r + 0.5::DOUBLE) / 16 AS y FROM placed),
{_fractal('sized', 'x', 'y', noise_word(0, 0x23, t.seed), t.octaves, t.roughness, t.ridged, 'm')},
pushed AS (SELECT *, least(6, floor(scale * 6)) AS top, greatest(0, least(1, (t + 0.4::DOUBLE * ((m - 0.5::DOUBLE) * 3 / (1 + 2 * abs((m - 0.5::DOUBLE) * 3))) * CASE WHEN t < 0.4::DOUBLE THEN t / 0.4::DOUBLE ELSE 1 END) / 1.2::DOUBLE)) AS p FROM m),
shelved AS (SELECT *, CASE WHEN p IN (0, 1) THEN p WHEN p < 0.2::DOUBLE THEN 0.15::DOUBLE * p / 0.2::DOUBLE ELSE 0.15::DOUBLE + 0.85::DOUBLE * (p - 0.2::DOUBLE) / 0.8::DOUBLE END AS s FROM pushed),
banked AS (SELECT *, CASE WHEN s IN (0, 1) THEN s ELSE s * 4 / (1 + 3 * s) END AS k FROM shelved), shaped AS (SELECT *, k * (2 - k) AS v FROM banked),
topped AS (SELECT *, max(v) OVER (PARTITION BY board, first) AS most, {t.deepest}::DOUBLE * scale AS target FROM shaped),
plain AS (SELECT *, CASE WHEN most > 0 THEN CASE WHEN v = most THEN target ELSE least(target, v * (target / most)) END ELSE 0 END AS z FROM topped),
benched AS (SELECT *, z / {t.deepest}::DOUBLE AS q FROM plain),
done AS (SELECT *, CASE WHEN n < {t.least_cells} THEN 0 WHEN top >= 1 AND most > 0 THEN least(target, {t.deepest}::DOUBLE * CASE WHEN q <= 0 THEN q ELSE q + (greatest(1, least(top, floor(q * 6 + 0.5))) / 6::DOUBLE - q) * 0.5::DOUBLE END) ELSE z END AS depth FROM benched)
SELECT board, r, c, first, floor(depth * 1e7 + 0.26)::BIGINT AS depth FROM done"""


@query("terrain_depths", _terrain_sql())
def terrain_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths of each board's absent cells, with noise, shelf, bank, profile, benches and smaller bodies shallower."""
    v = grid(spark, sf_dir)
    axis = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SIDE - 1).cast("long")))
    every = v.select("board").distinct().select("board", axis.alias("r")).select("board", "r", axis.alias("c"))
    water = every.join(v, ["board", "r", "c"], "left_anti")
    return g.terrain_depths(water, SIDE, _TERRAIN).withColumn("depth", F.floor(F.col("depth") * 1e7 + 0.26))
