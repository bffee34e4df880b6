"""Queries on captured features: the line, point and depth lenses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import scalars as sc
from quern.operators import features as op
from quern.plans.lenses import DEPTHS, POINTS, POLYLINES, depths, points, polylines
from quern.plans.registry import query

_CLASSES = list(sc.WIDTHS) + ["raceway"]
_CLASS_SQL = "list_extract([" + ", ".join(f"'{c}'" for c in _CLASSES) + f"], (id % {len(_CLASSES)} + 1)::INT)"
_WIDTH_SQL = "CASE road_class " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in sc.WIDTHS.items()) + f" ELSE {sc.UNKNOWN_WIDTH}::DOUBLE END"
_FACTOR_SQL = "least(2::DOUBLE, greatest(0.6::DOUBLE, sqrt({d} / 101.6::DOUBLE)))"


def _roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polylines(spark, sf_dir).withColumn("road_class", F.element_at(F.array(*map(F.lit, _CLASSES)), (F.col("id") % len(_CLASSES) + 1).cast("int")))


@query(
    "road_widths",
    f"WITH {POLYLINES} SELECT id, road_class, floor(greatest(0.25::DOUBLE, ({_WIDTH_SQL}) * {_FACTOR_SQL.format(d='(25 + id % 276)::DOUBLE')} * (1 + (id % 4) / 4::DOUBLE)) / 0.0001::DOUBLE + 0.5)::BIGINT AS tenth_micrometres FROM (SELECT id, {_CLASS_SQL} AS road_class FROM polylines)",
)
def road_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = op.road_width(F.col("road_class"), (25 + F.col("id") % 276).cast("double"), 1 + F.col("id") % 4 / F.lit(4.0))
    return _roads(spark, sf_dir).select("id", "road_class", sc.round_half_up(width / 1e-4).alias("tenth_micrometres"))


@query(
    "road_groups",
    f"""WITH {POLYLINES}, r AS (SELECT {_CLASS_SQL} AS road_class, len(line) AS n FROM polylines), w AS (SELECT *, greatest(0.25::DOUBLE, ({_WIDTH_SQL}) * {_FACTOR_SQL.format(d='60::DOUBLE')} * 1.0::DOUBLE) AS width FROM r WHERE road_class IN ({', '.join(f"'{c}'" for c in op.classes_of('high'))}))
SELECT road_class, floor(width * 1e6 + 0.5)::BIGINT AS width_nm, count(*) AS lines, sum(n)::BIGINT AS vertices, width <= 0.25::DOUBLE AS floored FROM w GROUP BY road_class, width""",
)
def road_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.road_groups(_roads(spark, sf_dir), "high", 60.0, 1.0)
    return out.select("road_class", F.floor(F.col("width") * 1e6 + 0.5).alias("width_nm"), "lines", "vertices", "floored")


@query(
    "road_label_candidates",
    f"""WITH {POLYLINES}, s AS (SELECT class, id // 3 % 7 AS name, id AS ix, i, line[i].x AS x, line[i].y AS y, line[i + 1].x AS x2, line[i + 1].y AS y2 FROM (SELECT *, unnest(range(1, len(line))) AS i FROM polylines)),
k AS (SELECT *, (x2 - x) * (x2 - x) + (y2 - y) * (y2 - y) AS squared FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY class, name ORDER BY squared DESC, ix, i) AS rn FROM k), c AS (SELECT class, name, count(DISTINCT ix) AS roads FROM s GROUP BY ALL)
SELECT class, name, roads, ix, i AS segment, squared, x + x2 AS twice_x, y + y2 AS twice_y, x2 >= x AS upright FROM b JOIN c USING (class, name) WHERE rn = 1""",
)
def road_label_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = polylines(spark, sf_dir).select("class", (F.floor(F.col("id") / 3) % 7).alias("name"), F.col("id").alias("ix"), "line")
    return op.road_label_candidates(named, ["class", "name"]).withColumn("segment", F.col("segment").cast("long"))


_LABELS_SQL = f"""{POINTS}, labels AS (
  SELECT id AS ix, id // 50 AS board, CASE WHEN id % 3 = 0 THEN 'poi' ELSE 'place' END AS kind, list_extract(['city', 'town', 'village', 'hamlet', 'islet', 'other'], (id % 6 + 1)::INT) AS label_class, rank, name,
    (id * 7919 % 1200)::BIGINT AS x, (id * 104729 % 900)::BIGINT AS y FROM points),
ordered AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY CASE kind WHEN 'place' THEN 0 ELSE 1 END,
  CASE WHEN kind = 'place' THEN CASE label_class WHEN 'city' THEN 0 WHEN 'town' THEN 1 WHEN 'village' THEN 2 WHEN 'hamlet' THEN 6 WHEN 'islet' THEN 8 ELSE 11 END ELSE 0 END, rank, name, ix) AS place FROM labels)"""


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = F.array(*map(F.lit, ("city", "town", "village", "hamlet", "islet", "other")))
    i = F.col("id")
    p = points(spark, sf_dir)
    labels = p.select(
        i.alias("ix"), F.floor(i / 50).alias("board"), F.when(i % 3 == 0, "poi").otherwise("place").alias("kind"), F.element_at(classes, (i % 6 + 1).cast("int")).alias("label_class"),
        "rank", "name", (i * 7919 % 1200).alias("x"), (i * 104729 % 900).alias("y"),
    )
    order = op.label_order(F.col("kind"), F.col("label_class"), F.col("rank"), F.col("name"), F.col("ix"))
    return labels.withColumn("place", F.row_number().over(Window.partitionBy("board").orderBy(*order)))


@query("label_priority", f"WITH {_LABELS_SQL} SELECT board, ix, kind, label_class, rank, name, place FROM ordered")
def label_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select("board", "ix", "kind", "label_class", "rank", "name", F.col("place").cast("long").alias("place"))


@query(
    "label_placement",
    f"""WITH RECURSIVE {_LABELS_SQL}, named AS (SELECT board, ix, place, kind, x, y, CASE WHEN ix % 11 = 0 THEN 'country' ELSE label_class END AS label_class, CASE WHEN ix % 4 = 0 THEN 'P' || ix % 30 || ' ' ELSE 'p' || ix % 30 END AS name FROM ordered),
box AS (SELECT *, x - 24 * length(name) // 2 AS a, y - 15 AS b, x + 24 * length(name) // 2 AS c, y + 15 AS d, lower(trim(name)) AS key, board * 53 % 900 AS wx, board * 31 % 600 AS wy FROM named),
judged AS (SELECT *, kind = 'place' AND label_class = 'country' AS excluded, greatest(0, least(c, wx + 300) - greatest(a, wx)) * greatest(0, least(d, wy + 200) - greatest(b, wy)) > 0.02 * (c - a) * (d - b) AS wet,
  a < 10 OR b < 10 OR c > 1190 OR d > 890 AS leaves, a < 600 AND 400 < c AND b < 500 AND 450 < d AS titled FROM box),
fold AS (
  SELECT board, 0::BIGINT AS place, NULL::BIGINT AS ix, '' AS reason, []::STRUCT(a BIGINT, b BIGINT, c BIGINT, d BIGINT, key VARCHAR)[] AS done FROM (SELECT DISTINCT board FROM box)
  UNION ALL
  SELECT f.board, n.place, n.ix, n.reason, CASE WHEN n.reason = 'placed' THEN list_append(f.done, {{'a': n.a, 'b': n.b, 'c': n.c, 'd': n.d, 'key': n.key}}) ELSE f.done END
  FROM fold f JOIN LATERAL (SELECT x.*, CASE WHEN excluded THEN 'excluded' WHEN list_bool_or(list_transform(f.done, lambda q: q.key = x.key)) THEN 'duplicate' WHEN leaves THEN 'outside'
    WHEN titled OR list_bool_or(list_transform(f.done, lambda q: x.a < q.c AND q.a < x.c AND x.b < q.d AND q.b < x.d)) THEN 'collision' WHEN wet THEN 'water' ELSE 'placed' END AS reason FROM judged x WHERE x.board = f.board AND x.place = f.place + 1) n ON true)
SELECT board, ix, reason FROM fold WHERE place > 0""",
)
def label_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels on boards with a body of water and a title's box, a tenth of them of a class that gets none, with names that recur in other letters."""
    i = F.col("ix")
    labels = _labels(spark, sf_dir).withColumns({"label_class": F.when(i % 11 == 0, "country").otherwise(F.col("label_class")), "name": F.when(i % 4 == 0, F.concat(F.lit("P"), i % 30, F.lit(" "))).otherwise(F.concat(F.lit("p"), i % 30))})
    boards = labels.select("board").distinct()
    x, y = F.col("board") * 53 % 900, F.col("board") * 31 % 600
    at = lambda dx, dy: F.struct((x + dx).cast("long").alias("x"), (y + dy).cast("long").alias("y"))
    water = boards.select("board", F.array(F.array(at(0, 0), at(300, 0), at(300, 200), at(0, 200), at(0, 0))).alias("rings"))
    title = boards.select("board", F.lit(400).alias("a"), F.lit(450).alias("b"), F.lit(600).alias("c"), F.lit(500).alias("d"))
    return op.place_labels(op.over_water(labels, water, 24, 30, 300), 1200, 900, 24, 30, inset=10, keep_out=title)


@query("override_join", f"WITH {POINTS}, o AS (SELECT id AS object_id, CASE WHEN id % 2 = 0 THEN lng + 1 END AS lng, CASE WHEN id % 5 = 0 THEN lat - 1 END AS lat FROM points WHERE id % 10 < 6) SELECT p.id AS object_id, coalesce(o.lng, p.lng) AS lng, coalesce(o.lat, p.lat) AS lat, p.name FROM points p LEFT JOIN o ON o.object_id = p.id")
def override_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = points(spark, sf_dir).select(F.col("id").alias("object_id"), "lng", "lat", "name")
    some = objects.filter("object_id % 10 < 6")
    overrides = some.select("object_id", F.when(F.col("object_id") % 2 == 0, F.col("lng") + 1).alias("lng"), F.when(F.col("object_id") % 5 == 0, F.col("lat") - 1).alias("lat"))
    return op.with_overrides(objects, overrides, ["lng", "lat"])


@query("place_label_distinct", f"WITH {POINTS} SELECT class, name, min(id) AS ix, arg_min(rank, id) AS rank, count(*) - 1 AS duplicates FROM points WHERE lng BETWEEN -120 AND 120 GROUP BY class, name")
def place_label_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.operators.lines import first_by_key

    p = points(spark, sf_dir).filter(F.col("lng").between(-120, 120)).select(F.col("id").alias("ix"), "class", "name", "rank")
    return first_by_key(p, F.struct("class", "name"), "ix").select("class", "name", "ix", "rank", "duplicates")


@query(
    "automatic_thresholds",
    f"""WITH {DEPTHS}, l AS (SELECT DISTINCT body, depth FROM depths), r AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY depth) - 1 AS k, count(*) OVER (PARTITION BY body) AS n FROM l)
SELECT body, i::INT AS i, depth FROM r, range(5) t(i) WHERE n >= 5 AND k = floor(i * (n - 1) / 4::DOUBLE + 0.5)""",
)
def automatic_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.automatic_thresholds(depths(spark, sf_dir), 5)


@query("capacity_check", f"WITH {POLYLINES}, t AS (SELECT class, count(*) AS features, sum(len(line))::BIGINT AS vertices FROM polylines GROUP BY class) SELECT *, vertices * 32 AS bytes, CASE WHEN features > 60 OR vertices > 1800 THEN 'refuse' WHEN vertices > 1400 THEN 'simplify' ELSE 'accept' END AS verdict FROM t")
def capacity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.capacity(polylines(spark, sf_dir), 60, 1800, 1400, "class")


@query(
    "preflight_findings",
    f"""WITH {POLYLINES}, f AS (SELECT id, id % 4 AS fault, line, list_sum(list_transform(range(1, len(line) + 1), lambda i: (line[i].x - line[1].x) * (line[i % len(line) + 1].y - line[1].y) - (line[i % len(line) + 1].x - line[1].x) * (line[i].y - line[1].y))) AS area FROM polylines)
SELECT id, CASE WHEN fault = 1 THEN 'open-path' WHEN fault = 2 THEN 'non-finite' ELSE 'tiny-piece' END AS finding, CASE WHEN fault IN (1, 2) THEN 'error' ELSE 'warning' END AS severity FROM f WHERE fault IN (1, 2) OR abs(area) < 200000000""",
)
def preflight_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of which every fourth is left open and every fourth lacks a coordinate."""
    none = F.array(F.struct(F.lit(None).cast("long").alias("x"), F.lit(0).cast("long").alias("y")))
    closed = F.concat("line", F.slice("line", 1, 1))
    fault = F.when(F.col("id") % 4 == 1, F.col("line")).when(F.col("id") % 4 == 2, F.concat("line", none)).otherwise(closed)
    return op.preflight(polylines(spark, sf_dir).select("id", fault.alias("ring")), 100_000_000)
