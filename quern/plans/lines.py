"""Queries on the line and ring lenses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import geometry as geo
from quern.operators import lines as op
from quern.operators import spatial as sp
from quern.plans.lenses import POLYLINES, RINGS, VERTICES, polylines, rings
from quern.plans.registry import query

_NANO = lambda c: F.floor(c * 1e9 + 0.5)


@query("ring_area", f"WITH {POLYLINES}, {RINGS}, o AS (SELECT id, ring[1].x AS ox, ring[1].y AS oy FROM rings) SELECT id, sum((x - ox) * (y2 - oy) - (x2 - ox) * (y - oy))::BIGINT AS double_area, count(*) + 1 AS vertices FROM edges JOIN o USING (id) GROUP BY id")
def ring_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rings(spark, sf_dir).select("id", geo.double_area(F.col("ring")).alias("double_area"), F.size("ring").cast("long").alias("vertices"))


@query("polyline_length", f"WITH {POLYLINES}, {VERTICES} SELECT id, class, sum(floor(sqrt((x2 - x)::DOUBLE * (x2 - x)::DOUBLE + (y2 - y)::DOUBLE * (y2 - y)::DOUBLE) * 1000 + 0.5)::BIGINT)::BIGINT AS nanometres FROM vertices WHERE i < n GROUP BY ALL")
def polyline_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate(geo.segments(F.col("line")), F.lit(0).cast("long"), lambda a, s: a + F.floor(geo.segment_length(s) * 1000 + 0.5))
    return polylines(spark, sf_dir).select("id", "class", total.alias("nanometres"))


@query("bounds", f"WITH {POLYLINES}, {VERTICES} SELECT id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM vertices GROUP BY id")
def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polylines(spark, sf_dir).select("id", geo.bounds(F.col("line")).alias("b")).select("id", "b.*")


@query(
    "point_in_ring",
    f"""WITH {POLYLINES}, {RINGS}, p AS (SELECT id AS pid, class, floor(line[1].x / 2::DOUBLE)::BIGINT AS x, floor(line[1].y / 2::DOUBLE)::BIGINT AS y FROM polylines),
h AS (SELECT pid, e.id, count(*) FILTER (WHERE (e.y > p.y) <> (e.y2 > p.y) AND p.x::DOUBLE < (e.x2 - e.x)::DOUBLE * (p.y - e.y)::DOUBLE / nullif((e.y2 - e.y)::DOUBLE, 0) + e.x::DOUBLE) AS n
  FROM p JOIN edges e ON e.class = p.class GROUP BY ALL)
SELECT pid, count(*) FILTER (WHERE n % 2 = 1) AS inside, count(*) AS rings FROM h GROUP BY pid""",
)
def point_in_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = lambda k: F.floor(F.get("line", 0)[k] / 2)
    points = polylines(spark, sf_dir).select(F.col("id").alias("pid"), "class", half("x").alias("x"), half("y").alias("y"))
    r = rings(spark, sf_dir)
    inside = sp.points_in_rings(points, r, 8000, "class").groupBy(F.col("pid").alias("p")).agg(F.count("*").alias("inside"))
    counts = r.groupBy(F.col("class").alias("k")).agg(F.count("*").alias("rings"))
    return points.join(counts, F.col("class") == F.col("k")).join(inside, F.col("pid") == F.col("p"), "left").select("pid", F.coalesce("inside", F.lit(0)).alias("inside"), "rings")


@query(
    "chaikin_ring",
    f"""WITH {POLYLINES}, {RINGS}, c AS (
  SELECT id, 2 * i - 1 AS n, 3 * x + x2 AS x, 3 * y + y2 AS y FROM edges UNION ALL SELECT id, 2 * i, x + 3 * x2, y + 3 * y2 FROM edges)
SELECT id, n, x, y FROM c UNION ALL SELECT id, (SELECT max(n) FROM c d WHERE d.id = c.id) + 1, x, y FROM c WHERE n = 1""",
)
def chaikin_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = rings(spark, sf_dir).select("id", F.posexplode(geo.chaikin_ring(F.col("ring"))).alias("n", "p"))
    return cut.select("id", (F.col("n") + 1).cast("long").alias("n"), (F.col("p.x") * 4).cast("long").alias("x"), (F.col("p.y") * 4).cast("long").alias("y"))


@query(
    "chaikin_line",
    f"""WITH {POLYLINES}, {VERTICES}, c AS (
  SELECT id, 2 * i - 1 AS k, 3 * x + x2 AS x, 3 * y + y2 AS y FROM vertices WHERE i < n AND i > 1 UNION ALL SELECT id, 2 * i, x + 3 * x2, y + 3 * y2 FROM vertices WHERE i < n - 1
  UNION ALL SELECT id, 1, 4 * x, 4 * y FROM vertices WHERE i = 1 UNION ALL SELECT id, 2 * n, 4 * x, 4 * y FROM vertices WHERE i = n)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) AS n, x, y FROM c""",
)
def chaikin_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = polylines(spark, sf_dir).select("id", F.posexplode(geo.chaikin_line(F.col("line"))).alias("n", "p"))
    return cut.select("id", (F.col("n") + 1).cast("long").alias("n"), (F.col("p.x") * 4).cast("long").alias("x"), (F.col("p.y") * 4).cast("long").alias("y"))


@query("clean_ring", f"WITH {POLYLINES} SELECT id, len(line) + 1 AS vertices, list_sum(list_transform(line, lambda p: p.x))::BIGINT + line[1].x AS sum_x, list_sum(list_transform(line, lambda p: p.y))::BIGINT + line[1].y AS sum_y FROM polylines")
def clean_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings whose vertices are repeated: every fifth one, and the first once more than a ring needs."""
    twice = F.flatten(F.transform("line", lambda p, i: F.when(i % 5 == 0, F.array(p, p)).otherwise(F.array(p))))
    dirty = polylines(spark, sf_dir).select("id", F.concat(twice, F.slice("line", 1, 1), F.slice("line", 1, 1)).alias("dirty"))
    clean = dirty.select("id", geo.clean_ring(F.col("dirty")).alias("ring"))
    total = lambda k: F.aggregate("ring", F.lit(0).cast("long"), lambda a, p: a + p[k])
    return clean.select("id", F.size("ring").cast("long").alias("vertices"), total("x").alias("sum_x"), total("y").alias("sum_y"))


def _runs(inside: str) -> str:
    return f"""WITH {POLYLINES}, {VERTICES}, s AS (SELECT id, i, x::DOUBLE AS x, y::DOUBLE AS y, x2::DOUBLE AS x2, y2::DOUBLE AS y2, row_number() OVER (PARTITION BY id ORDER BY i) AS n FROM vertices WHERE i < n AND (x <> x2 OR y <> y2)),
t AS ({inside}), k AS (SELECT *, CASE WHEN lag(n) OVER o = n - 1 AND lag(t1) OVER o = 1 AND t0 = 0 THEN 0 ELSE 1 END AS new FROM t WHERE t1 >= t0 WINDOW o AS (PARTITION BY id ORDER BY i)),
r AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY i) AS run FROM k)
SELECT id, run::BIGINT AS run, count(*) AS segments, min(i) AS first, max(i) AS last, floor(arg_min(t0, i) * 1e9 + 0.5)::BIGINT AS t0, floor(arg_max(t1, i) * 1e9 + 0.5)::BIGINT AS t1 FROM r GROUP BY id, run"""


def _hashed(runs: DataFrame) -> DataFrame:
    long = lambda c: F.col(c).cast("long").alias(c)
    return runs.select("id", long("run"), "segments", long("first"), long("last"), _NANO(F.col("t0")).alias("t0"), _NANO(F.col("t1")).alias("t1"))


@query(
    "clip_rect",
    _runs("""SELECT id, i, n, greatest(0, coalesce(least((-8000 - x) / nullif(x2 - x, 0), (9000 - x) / nullif(x2 - x, 0)), 0), coalesce(least((-7000 - y) / nullif(y2 - y, 0), (6000 - y) / nullif(y2 - y, 0)), 0)) AS t0,
  least(1, coalesce(greatest((-8000 - x) / nullif(x2 - x, 0), (9000 - x) / nullif(x2 - x, 0)), 1), coalesce(greatest((-7000 - y) / nullif(y2 - y, 0), (6000 - y) / nullif(y2 - y, 0)), 1)) AS t1
  FROM s WHERE NOT (x = x2 AND (x < -8000 OR x > 9000)) AND NOT (y = y2 AND (y < -7000 OR y > 6000))"""),
)
def clip_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(op.clip(polylines(spark, sf_dir), lambda s: geo.rect_interval(s, -8000.0, -7000.0, 9000.0, 6000.0)))


_DISK = """SELECT id, i, n, greatest(0, (-fd - sqrt(disc)) / dd) AS t0, least(1, (-fd + sqrt(disc)) / dd) AS t1 FROM (
  SELECT *, fd * fd - dd * ff AS disc FROM (SELECT *, dx * dx + dy * dy AS dd, fx * dx + fy * dy AS fd, fx * fx + fy * fy - {r} * {r} AS ff FROM (
    SELECT *, x2 - x AS dx, y2 - y AS dy, x - {cx} AS fx, y - {cy} AS fy FROM s))) WHERE disc >= 0"""


@query("clip_disk", _runs(_DISK.format(cx="500::DOUBLE", cy="-300::DOUBLE", r="9000::DOUBLE")))
def clip_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(op.clip(polylines(spark, sf_dir), lambda s: geo.disk_interval(s, 500.0, -300.0, 9000.0)))


@query(
    "clip_chord",
    _runs("""SELECT id, i, n, CASE WHEN y <= 1500 THEN 0 ELSE least(1, greatest(0, (1500 - y) / (y2 - y))) END AS t0,
  CASE WHEN y2 <= 1500 THEN 1 ELSE least(1, greatest(0, (1500 - y) / (y2 - y))) END AS t1 FROM s WHERE y <= 1500 OR y2 <= 1500"""),
)
def clip_chord(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(op.clip(polylines(spark, sf_dir), lambda s: geo.chord_interval(s, 1500.0)))


_CIRCLES = [(2000.0, 1000.0, 4000.0), (-3000.0, -2000.0, 5000.0), (0.0, 9000.0, 3000.0)]


def _keepout() -> str:
    cuts = " UNION ".join(
        f"SELECT id, i, unnest([greatest(0, (-fd - sqrt(disc)) / dd), least(1, (-fd + sqrt(disc)) / dd)]) AS t FROM ({_DISK.format(cx=f'{a}::DOUBLE', cy=f'{b}::DOUBLE', r=f'{r}::DOUBLE').split('FROM (', 1)[1].rsplit(') WHERE', 1)[0]}) WHERE disc >= 0 AND least(1, (-fd + sqrt(disc)) / dd) >= greatest(0, (-fd - sqrt(disc)) / dd)"
        for a, b, r in _CIRCLES
    )
    m = "(t + nxt) / 2"
    out = " AND ".join(f"((x + (x2 - x) * {m} - {a}) * (x + (x2 - x) * {m} - {a}) + (y + (y2 - y) * {m} - {b}) * (y + (y2 - y) * {m} - {b}) >= {r}::DOUBLE * {r}::DOUBLE)" for a, b, r in _CIRCLES)
    return f"""WITH {POLYLINES}, {VERTICES}, s AS (SELECT id, i, x::DOUBLE AS x, y::DOUBLE AS y, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM vertices WHERE i < n AND (x <> x2 OR y <> y2)),
c AS (SELECT id, i, unnest([0::DOUBLE, 1::DOUBLE]) AS t FROM s UNION {cuts}), p AS (SELECT *, lead(t) OVER (PARTITION BY id, i ORDER BY t) AS nxt FROM c)
SELECT id, i::BIGINT AS i, floor(t * 1e9 + 0.5)::BIGINT AS t0, floor(nxt * 1e9 + 0.5)::BIGINT AS t1 FROM p JOIN s USING (id, i) WHERE nxt IS NOT NULL AND {out}"""


@query("keepout_clip", _keepout())
def keepout_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.keep_outside(polylines(spark, sf_dir), _CIRCLES)
    return out.select("id", F.col("i").cast("long").alias("i"), _NANO(F.col("t0")).alias("t0"), _NANO(F.col("t1")).alias("t1"))


_SIDE = "sign(({p}.x2 - {p}.x) * ({q}.y{v} - {p}.y) - ({p}.y2 - {p}.y) * ({q}.x{v} - {p}.x))"
_ON = "(" + _SIDE + " = 0 AND {q}.x{v} BETWEEN least({p}.x, {p}.x2) AND greatest({p}.x, {p}.x2) AND {q}.y{v} BETWEEN least({p}.y, {p}.y2) AND greatest({p}.y, {p}.y2))"
_MEET = (
    f"({_SIDE.format(p='a', q='b', v='')} * {_SIDE.format(p='a', q='b', v='2')} < 0 AND {_SIDE.format(p='b', q='a', v='')} * {_SIDE.format(p='b', q='a', v='2')} < 0) OR "
    + " OR ".join(_ON.format(p=p, q=q, v=v) for p, q in (("a", "b"), ("b", "a")) for v in ("", "2"))
)


@query("crossing_rings", f"WITH {POLYLINES}, {RINGS} SELECT DISTINCT a.id // 8 AS board, a.id AS a, b.id AS b FROM edges a JOIN edges b ON a.id // 8 = b.id // 8 AND a.id < b.id WHERE {_MEET}")
def crossing_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.crossings(rings(spark, sf_dir).withColumn("board", F.floor(F.col("id") / 8)), 6000)


@query(
    "nearest_pair",
    f"""WITH {POLYLINES}, {RINGS}, w AS (
  SELECT least(v.id, s.id) AS id, (v.id % 2)::INT AS back, (v.i - 1)::INT AS i, (s.i - 1)::INT AS j, v.x::DOUBLE AS px, v.y::DOUBLE AS py, s.x::DOUBLE AS x, s.y::DOUBLE AS y, (s.x2 - s.x)::DOUBLE AS dx, (s.y2 - s.y)::DOUBLE AS dy
  FROM edges v JOIN edges s ON v.id // 2 = s.id // 2 AND v.id <> s.id),
t AS (SELECT *, coalesce(greatest(0, least(1, ((px - x) * dx + (py - y) * dy) / nullif(dx * dx + dy * dy, 0))), 0) AS t FROM w),
d AS (SELECT *, (px - (x + t * dx)) * (px - (x + t * dx)) + (py - (y + t * dy)) * (py - (y + t * dy)) AS d FROM t)
SELECT id, m.back, m.i AS vertex, m.j AS segment, floor(sqrt(m.d) * 1000 + 0.5)::BIGINT AS nanometres FROM (SELECT id, min({{'d': d, 'back': back, 'i': i, 'j': j}}) AS m FROM d GROUP BY id)""",
)
def nearest_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rings(spark, sf_dir)
    even, odd = r.filter("id % 2 = 0").select("id", "ring"), r.filter("id % 2 = 1").select((F.col("id") - 1).alias("id"), F.col("ring").alias("other"))
    found = op.nearest_pairs(even.join(odd, "id"))
    return found.select("id", "back", "vertex", "segment", F.floor(F.col("distance") * 1000 + 0.5).alias("nanometres"))


@query(
    "interior_point",
    f"""WITH {POLYLINES}, {RINGS}, m AS (SELECT id, (min(y) + max(y))::DOUBLE / 2 AS m FROM edges GROUP BY id),
c AS (SELECT id, m, (x2 - x)::DOUBLE * (m - y::DOUBLE) / (y2 - y)::DOUBLE + x::DOUBLE AS cx FROM edges JOIN m USING (id) WHERE (y > m) <> (y2 > m)),
k AS (SELECT *, row_number() OVER o AS n, lead(cx) OVER o AS nx FROM c WINDOW o AS (PARTITION BY id ORDER BY cx)),
b AS (SELECT id, m, max({{'w': nx - cx, 'i': -n, 'x': (cx + nx) / 2}}) AS b FROM k WHERE n % 2 = 1 GROUP BY ALL)
SELECT id, floor(b.x * 1000 + 0.5)::BIGINT AS x, floor(m * 1000 + 0.5)::BIGINT AS y, floor(b.w * 1000 + 0.5)::BIGINT AS width FROM b""",
)
def interior_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    nano = lambda c: F.floor(F.col(c) * 1000 + 0.5).alias(c)
    return op.interior_points(rings(spark, sf_dir)).select("id", nano("x"), nano("y"), nano("width"))


@query(
    "dedupe_lines",
    f"""WITH {POLYLINES}, f AS (SELECT id AS ix, id, line FROM polylines UNION ALL SELECT 1000000 + id, id, list_reverse(line) FROM polylines WHERE id % 3 = 0 UNION ALL SELECT 2000000 + id, id, line FROM polylines WHERE id % 7 = 0),
k AS (SELECT ix, id, list_transform(line, lambda p: p.x || ',' || p.y) AS p FROM f), l AS (SELECT ix, id, least(array_to_string(p, ' '), array_to_string(list_reverse(p), ' ')) AS key FROM k)
SELECT min(ix) AS ix, arg_min(id, ix) AS id, count(*) - 1 AS duplicates FROM l GROUP BY key""",
)
def dedupe_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured lines of which some come again, the same way or reversed."""
    lines = polylines(spark, sf_dir)
    again = lambda k, shift, line: lines.filter(f"id % {k} = 0").select((F.col("id") + shift).alias("ix"), "id", line.alias("line"))
    captured = again(1, 0, F.col("line")).union(again(3, 1_000_000, F.reverse("line"))).union(again(7, 2_000_000, F.col("line")))
    return op.first_by_key(captured, geo.line_key(F.col("line")), "ix").select("ix", "id", "duplicates")


@query(
    "dedupe_rings",
    f"""WITH {POLYLINES}, f AS (SELECT id AS ix, id, line FROM polylines UNION ALL SELECT 1000000 + id, id, list_concat(line[4:], line[1:3]) FROM polylines WHERE id % 3 = 0
  UNION ALL SELECT 2000000 + id, id, list_reverse(list_concat(line[6:], line[1:5])) FROM polylines WHERE id % 7 = 0),
k AS (SELECT ix, id, list_transform(line, lambda p: p.x || ',' || p.y) AS p FROM f), r AS (SELECT ix, id, p, list_reverse(p) AS q FROM k),
t AS (SELECT ix, id, list_concat(p[list_position(p, list_min(p)):], p[1:list_position(p, list_min(p)) - 1]) AS a, list_concat(q[list_position(q, list_min(q)):], q[1:list_position(q, list_min(q)) - 1]) AS b FROM r),
l AS (SELECT ix, id, least(array_to_string(a, ' '), array_to_string(b, ' ')) AS key FROM t)
SELECT min(ix) AS ix, arg_min(id, ix) AS id, count(*) - 1 AS duplicates FROM l GROUP BY key""",
)
def dedupe_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured rings of which some come again from another first vertex, or reversed."""
    lines = polylines(spark, sf_dir)
    turned = lambda n: F.concat(F.slice(F.col("line"), F.lit(n + 1), F.size("line")), F.slice("line", 1, n))
    closed = lambda line: F.concat(line, F.slice(line, 1, 1))
    again = lambda k, shift, line: lines.filter(f"id % {k} = 0").select((F.col("id") + shift).alias("ix"), "id", closed(line).alias("ring"))
    captured = again(1, 0, F.col("line")).union(again(3, 1_000_000, turned(3))).union(again(7, 2_000_000, F.reverse(turned(5))))
    return op.first_by_key(captured, geo.ring_key(F.col("ring")), "ix").select("ix", "id", "duplicates")


@query("rdp_simplify")
def rdp_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.simplify(polylines(spark, sf_dir), 4000.0).select("id", F.size("line").alias("vertices"), "line")
