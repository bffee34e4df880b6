"""Queries of settings, checks and the texts that name them, on the points, parts, orders and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import settings as st
from quern.plans.lenses import POINTS, points, table
from quern.plans.registry import query

_D = lambda c: c.cast("double")
_MICRO = lambda c: F.floor(c * 1e6 + 0.26)
_sql_micro = lambda x: f"floor(({x}) * 1e6 + 0.26)::BIGINT"


def _clamp_sql(x: str, low: float, high: float) -> str:
    return f"greatest({float(low)}::DOUBLE, least({float(high)}::DOUBLE, {x}))"


_SHAPES = (*st.PROFILES, "unknown")
_UNIT = _clamp_sql("{x}", 0, 1)
_TERRAIN = {
    "maxDepth": "coalesce(deep, 1)", "bankSteepness": "bank", "shelfWidth": "0.22::DOUBLE * (1 - bank)", "terraceStrength": "terracing", "terraceLevels": "6", "noiseAmplitude": "0.2::DOUBLE + 0.6::DOUBLE * ch",
    "featureScale": "(0.22::DOUBLE - 0.1::DOUBLE * ch) * (1 - 0.4::DOUBLE * weave)", "octaves": "3 + floor(3 * ch + 0.5)", "roughness": "0.4::DOUBLE + 0.2::DOUBLE * ch", "ridged": "0.7::DOUBLE * rt * rt * (3 - 2 * rt)",
    "warpStrength": "(0.2::DOUBLE + 0.8::DOUBLE * ch) * (1 - 0.4::DOUBLE * weave)", "grainStrength": "0.85::DOUBLE * weave", "bodyScaleExponent": "0.5",
}


@query(
    "terrain_settings",
    f"""WITH {POINTS}, c AS (SELECT id, list_extract([{', '.join(f"'{s}'" for s in _SHAPES)}], (id % 5 + 1)::INT) AS shape, CASE WHEN id % 11 > 0 THEN (id % 7)::DOUBLE / 4 END AS deep, {_UNIT.format(x='coalesce(CASE WHEN id % 13 > 0 THEN (id % 9)::DOUBLE / 8 END, 0.4)')} AS ch,
  {_UNIT.format(x='(id % 6)::DOUBLE / 4 - 0.125')} AS bank, {_UNIT.format(x='(id % 8)::DOUBLE / 8')} AS weave, {_UNIT.format(x='(id % 3)::DOUBLE / 2')} AS terracing, lng * 3 AS angle, lng * 100000000 AS s FROM points),
r AS (SELECT *, {_clamp_sql('(ch - 0.4) / 0.6', 0, 1)} AS rt FROM c)
SELECT id, {', '.join(f"{_sql_micro(_clamp_sql(f'({x})::DOUBLE', *st.RANGES[k]))} AS {k}" for k, x in _TERRAIN.items())}, ((trunc(s)::BIGINT % 4294967296) + 4294967296) % 4294967296 AS seed,
  CASE WHEN shape IN ({', '.join(f"'{s}'" for s in st.PROFILES)}) THEN shape ELSE 'smooth-basin' END AS profile, {_sql_micro('((angle % 180) + 180) % 180')} AS grain,
  {_sql_micro(_clamp_sql('(id % 50)::DOUBLE / 2', *st.GRID_RANGES['cellMm']))} AS cell, {_clamp_sql('id::DOUBLE', *st.GRID_RANGES['maxCellsLongSide'])}::BIGINT AS most_cells FROM r""",
)
def terrain_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terrain settings made from simple controls, of which some are missing, out of range or unknown."""
    i = F.col("id")
    part = lambda n, d, shift=0.0: _D(i % n) / d + shift
    controls = F.struct(
        F.element_at(F.array(*map(F.lit, _SHAPES)), (i % 5 + 1).cast("int")).alias("profile"), F.when(i % 11 > 0, part(7, 4)).alias("maxDepth"), F.when(i % 13 > 0, part(9, 8)).otherwise(float("nan")).alias("character"),
        part(6, 4, -0.125).alias("bankSteepness"), part(8, 8).alias("weave"), part(3, 2).alias("terracing"), (F.col("lng") * 3).alias("weaveAngleDeg"), (F.col("lng") * 100_000_000).alias("seed"),
    )
    made = points(spark, sf_dir).select("id", controls.alias("c"))
    found = st.simple_controls(F.col("c"))
    return made.select(
        "id", *(_MICRO(found[k]).alias(k) for k in _TERRAIN), found["seed"].alias("seed"), found["profile"].alias("profile"), _MICRO(found["grainAngleDeg"]).alias("grain"),
        _MICRO(st.terrain_setting("cellMm", part(50, 2), 0.5)).alias("cell"), st.terrain_setting("maxCellsLongSide", i, 512).cast("long").alias("most_cells"),
    )


_PRESETS = (*st.OFFSETS, "custom")
_PRESET_SQL = "CASE name " + " ".join(f"WHEN '{k}' THEN [{', '.join(f'{float(x)}::DOUBLE' for x in v)}]" for k, v in st.OFFSETS.items()) + " ELSE [id::DOUBLE] END"


@query(
    "depth_levels",
    f"""WITH p AS (SELECT p_partkey AS id, p_size AS n, list_extract([{', '.join(f"'{k}'" for k in _PRESETS)}], (p_partkey % 6 + 1)::INT) AS name, list_transform(range(p_partkey % 5), lambda j: ((p_size * (j + 3)) % 40)::DOUBLE / 32) AS t FROM part)
SELECT id, CASE WHEN len(t) > 0 AND len(list_filter(t, lambda x: x <= 0 OR x > 1)) = 0 THEN list_sort(list_distinct(t)) END AS levels, {_sql_micro("coalesce(list_sum(list_transform(range(n % 6), lambda j: (j + 1.5)::DOUBLE / (n % 6 + 1))), 0)")} AS even,
  {_sql_micro(f"list_sum({_PRESET_SQL}) * 228.6::DOUBLE / 500")} AS offsets, {_sql_micro("500 * n::DOUBLE / (n + 7)::DOUBLE")} AS tall FROM p""",
)
def depth_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds in order, even ones for a number of panels, and offsets of presets in millimetres."""
    k, n = F.col("p_partkey"), F.col("p_size")
    made = F.transform(F.when(k % 5 > 0, F.sequence(F.lit(0), (k % 5 - 1).cast("int"))).otherwise(F.array().cast("array<int>")), lambda j: _D((n * (j + 3)) % 40) / 32)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    name = F.element_at(F.array(*map(F.lit, _PRESETS)), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        k.alias("id"), st.depth_levels(made).alias("levels"), _MICRO(total(st.even_levels((n % 6).cast("int")))).alias("even"),
        _MICRO(total(st.preset_offsets(name, F.array(_D(k)))) * 228.6 / st.DESIGN_WIDTH).alias("offsets"), _MICRO(st.DESIGN_WIDTH * _D(n) / _D(n + 7)).alias("tall"),
    )


@query(
    "view_checks",
    f"""WITH {POINTS}, v AS (SELECT *, CASE WHEN id % 7 > 0 THEN (id % 4)::DOUBLE * 4e-7::DOUBLE END AS off, list_extract(['low', 'medium', 'high'], (id % 3 + 1)::INT) AS tier, list_extract(['low', 'medium', 'high'], (rank % 3 + 1)::INT) AS detail FROM points),
s AS (SELECT *, off IS NOT NULL AND NOT (off <= 1e-6::DOUBLE AND tier = detail) AS stale FROM v)
SELECT id, stale, id % 3 <= rank % 3 AS visible, list_filter([CASE WHEN id % 9 = 0 THEN 'geometry-invalid' END, CASE WHEN id % 10 = 0 THEN 'text-invalid' END, CASE WHEN id % 4 = 0 THEN 'no-place' END,
  CASE WHEN off IS NULL THEN 'no-snapshot' END, CASE WHEN stale THEN 'snapshot-stale' END], lambda x: x IS NOT NULL) AS reasons, CASE id % 3 WHEN 0 THEN ['water'] WHEN 1 THEN []::VARCHAR[] END AS missing FROM s""",
)
def view_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether captures are stale, tiers visible and products ready, and which layers a source lacks."""
    i = F.col("id")
    tiers = F.array(*map(F.lit, st.TIERS))
    view = lambda off, detail: F.struct((F.lit(1.0) + off).alias("lng"), F.lit(2.0).alias("lat"), F.lit(9.5).alias("zoom"), F.lit(40.0).alias("radius"), detail.alias("detail"))
    p = points(spark, sf_dir).withColumns({"tier": F.element_at(tiers, (i % 3 + 1).cast("int")), "detail": F.element_at(tiers, (F.col("rank") % 3 + 1).cast("int"))})
    p = p.withColumns({"held": F.when(i % 7 > 0, view(_D(i % 4) * 4e-7, F.col("tier"))), "now": view(F.lit(0.0), F.col("detail"))})
    layers = F.when(i % 3 == 0, F.array(F.lit("transportation"), F.lit("place"))).when(i % 3 == 1, F.array(F.lit("water"), F.lit("transportation")))
    return p.select(
        "id", (F.col("held").isNotNull() & ~st.same_view(F.col("held"), F.col("now"))).alias("stale"), st.tier_visible(F.col("tier"), F.col("detail")).alias("visible"),
        st.unready(F.col("held"), F.col("now"), i % 4 != 0, F.when(i % 9 == 0, 1).otherwise(0), F.when(i % 10 == 0, 1).otherwise(0)).alias("reasons"), st.missing_layers(layers).alias("missing"),
    )


@query(
    "loop_and_widths",
    f"""WITH p AS (SELECT p_partkey AS id, (50 + p_partkey % 90)::DOUBLE AS d, (6 + p_size % 12)::DOUBLE AS o, (p_size % 5)::DOUBLE AS i, (p_partkey % 9)::DOUBLE / 2 AS lap, 2.5::DOUBLE AS least FROM part),
c AS (SELECT *, -d / 2 + lap - o / 2 AS cy, d / 2 AS rr, o / 2 AS r FROM p), m AS (SELECT *, abs(cy) AS ac, abs(cy) < rr + r AND abs(cy) > abs(rr - r) AND abs(cy) > 0 AS meets FROM c),
j AS (SELECT *, (ac * ac + rr * rr - r * r) / nullif(2 * ac, 0) AS x FROM m), k AS (SELECT *, CASE WHEN meets THEN 2 * sqrt(greatest(0, rr * rr - x * x)) ELSE 0 END AS junction FROM j)
SELECT id, {_sql_micro('cy')} AS centre, {_sql_micro('junction')} AS junction, meets, meets AND junction >= least AND r - i / 2 >= least AS connected, {_sql_micro('sqrt(greatest(0, rr * rr - 400))')} AS chord,
  {_sql_micro('greatest(0.6::DOUBLE, least(2::DOUBLE, sqrt(d / 101.6::DOUBLE))) * CASE WHEN i > 0 THEN i ELSE 1 END')} AS factor, {_sql_micro(f'least({st.ARC}::DOUBLE, greatest(1e-4::DOUBLE, i / 4 * {st.SAGITTA}::DOUBLE))')} AS cap,
  {_sql_micro(f'least({st.ROAD}::DOUBLE, least({st.ARC}::DOUBLE, greatest(1e-4::DOUBLE, i / 4 * {st.SAGITTA}::DOUBLE)) / 10)')} AS road,
  CASE WHEN id % 2 = 0 THEN floor(d / 25.4::DOUBLE * 1e9 + 0.5)::BIGINT ELSE (d * 1000000000)::BIGINT END AS shown, CASE WHEN id % 2 = 0 THEN floor(o * 25.4::DOUBLE * 1e9 + 0.5)::BIGINT ELSE (o * 1000000000)::BIGINT END AS meant,
  d BETWEEN 50 AND 1220 AND d < 120 AS fits FROM k""",
)
def loop_and_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hanging loops on disks, the width factor of boards, tolerances, and sizes in either unit."""
    k, n = F.col("p_partkey"), F.col("p_size")
    p = table(spark, sf_dir, "part").select(k.alias("id"), _D(50 + k % 90).alias("d"), _D(6 + n % 12).alias("o"), _D(n % 5).alias("i"), (_D(k % 9) / 2).alias("lap"))
    d, o, i = F.col("d"), F.col("o"), F.col("i")
    unit = F.when(F.col("id") % 2 == 0, "in").otherwise("mm")
    nano = lambda c: F.floor(c * 1e9 + 0.5)
    p = p.withColumn("loop", st.hanging_loop(d, o, i, F.col("lap"), F.lit(2.5)))
    return p.select(
        "id", _MICRO(F.col("loop.centre_y")).alias("centre"), _MICRO(F.col("loop.junction")).alias("junction"), "loop.meets", "loop.connected", _MICRO(st.chord_half_width(F.lit(20.0), d / 2)).alias("chord"),
        _MICRO(st.board_width_factor(d, d + 10, i)).alias("factor"), _MICRO(st.cap_tolerance(i / 4)).alias("cap"), _MICRO(st.road_tolerance(i / 4)).alias("road"),
        nano(st.to_display(d, unit)).alias("shown"), nano(st.from_display(o, unit)).alias("meant"), (d.between(50, 1220) & (d < 120)).alias("fits"),
    )


_PATHS = ("M0 0 L{a} {b} Z", "M{a} 1.5 L2 {b}", "M0 0 L1 {a} Z M3 3 L{b} 4", "M1 2 C1 2 {a} 4 5 {b} Q1 1 2 2 H9 V{a} Z", "M0 0 L{a} NaN Z", "M0 0 l{a} 1 Z", "M0 {a} {b} Z",
    "m1 2 3 4 A5 6 0 0 1 {a} {b} z", "M1 1 S2 2 {a} 3 T4 {b} c1 1 2 2 {a} 0 h{a} v1 Z", "M0 0 C1 2 3 4 5 {a} 7 8 Z")


@query(
    "path_checks",
    f"""WITH {POINTS}, p AS (SELECT id, rank, replace(replace(list_extract([{', '.join(f"'{p}'" for p in _PATHS)}], (id % {len(_PATHS)} + 1)::INT), '{{a}}', (id % 50)::VARCHAR), '{{b}}', '-' || (rank % 9)::VARCHAR || '.25') AS d FROM points),
t AS (SELECT *, list_filter(list_transform(string_split_regex(replace(replace(d, 'm', 'M'), 'M', chr(1) || 'M'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM p)
SELECT id, d, len(parts) > 0 AND len(list_filter(parts, lambda x: NOT regexp_matches(x, '[Zz]\\s*$'))) = 0 AS closed, regexp_matches(d, '(?i)NaN|Infinity') AS not_finite,
  CASE id % {len(_PATHS)} WHEN 0 THEN 'M 10 -5 L ' || a10 || ' ' || b5 || ' Z' WHEN 1 THEN 'M ' || a10 || ' -3.5 L 12 ' || b5
    WHEN 2 THEN 'M 10 -5 L 11 ' || a5 || ' Z M 13 -2 L ' || (9 - rank % 9) || '.75 -1' WHEN 3 THEN 'M 11 -3 C 11 -3 ' || a10 || ' -1 15 ' || b5 || ' Q 11 -4 12 -3 H 19 V ' || a5 || ' Z'
    WHEN 5 THEN 'M 10 -5 l ' || id % 50 || ' 1 Z' WHEN 7 THEN 'm 11 -3 3 4 A 5 6 0 0 1 ' || a10 || ' ' || b5 || ' z'
    WHEN 8 THEN 'M 11 -4 S 12 -3 ' || a10 || ' -2 T 14 ' || b5 || ' c 1 1 2 2 ' || id % 50 || ' 0 h ' || id % 50 || ' v 1 Z' END AS moved
FROM (SELECT *, (id % 50 + 10)::VARCHAR AS a10, (id % 50 - 5)::VARCHAR AS a5, '-' || (rank % 9 + 5) || '.25' AS b5 FROM t)""",
)
def path_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path data: whether it is closed and finite, and moved by (10, -5) where it is well formed."""
    i = F.col("id")
    made = F.replace(F.replace(F.element_at(F.array(*map(F.lit, _PATHS)), (i % len(_PATHS) + 1).cast("int")), F.lit("{a}"), (i % 50).cast("string")), F.lit("{b}"), F.concat(F.lit("-"), (F.col("rank") % 9).cast("string"), F.lit(".25")))
    d = F.col("d")
    return points(spark, sf_dir).select("id", made.alias("d")).select("id", "d", st.path_closed(d).alias("closed"), st.path_not_finite(d).alias("not_finite"), st.moved_path(d, F.lit(10.0), F.lit(-5.0)).alias("moved"))


@query(
    "keys_and_urls",
    f"""WITH {POINTS}, p AS (SELECT *, (id % 16)::INT AS z, floor(lng * 64)::BIGINT AS x, floor(lat * 64)::BIGINT AS y FROM points)
SELECT id, z || '/' || x || '/' || y AS tile, 'https://t.example/' || z || '/' || x || '/' || y || '.png?s=' || z AS url, floor(lng * 10000 + 0.5)::BIGINT || ',' || floor(lat * 10000 + 0.5)::BIGINT AS node,
  CASE WHEN regexp_matches(name, '^p[0-9]+$') AND (substr(name, 2)::INT) > 0 THEN substr(name, 2) END AS wbic,
  'M' || printf('%.2f', lng) || ' ' || printf('%.2f', floor(lat)) || 'L' || printf('%.2f', floor(lat)) || ' ' || printf('%.2f', 0.5) || 'M' || printf('%.2f', 1.25) || ' ' || printf('%.2f', -2.0) AS path FROM (SELECT id, z, x, y, floor(lng * 4) / 4 AS lng, lat, name FROM p)""",
)
def keys_and_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles' keys and addresses, points' keys, positive numbers of water bodies, and lines as path data."""
    z, x, y = (F.col("id") % 16).cast("int"), F.floor(F.col("lng") * 64), F.floor(F.col("lat") * 64)
    p = points(spark, sf_dir).select("id", z.alias("z"), x.alias("x"), y.alias("y"), (F.floor(F.col("lng") * 4) / 4.0).alias("lng"), "lat", F.expr("substring(name, 2)").alias("number"))
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    down = _D(F.floor("lat"))
    lines = F.array(F.array(at(F.col("lng"), down), at(down, F.lit(0.5))), F.array(at(F.lit(1.25), F.lit(-2.0))))
    tile = (F.col("z"), F.col("x"), F.col("y"))
    return p.select(
        "id", st.tile_key(*tile).alias("tile"), st.tile_url(F.lit("https://t.example/{z}/{x}/{y}.png?s={z}"), *tile).alias("url"), st.node_key(F.col("lng"), F.col("lat")).alias("node"),
        F.when(F.expr("try_cast(number AS double) > 0"), F.col("number")).alias("wbic"), st.lines_path(lines).alias("path"),
    )


def _round_plate() -> str:
    n = lambda e: f"CASE WHEN ({e}) = floor({e}) THEN floor({e})::BIGINT::VARCHAR ELSE ({e})::VARCHAR END"
    x0, y0, x1, y1 = "(x - pad)::DOUBLE", "(y - pad)::DOUBLE", "(x + w + pad)::DOUBLE", "(y + h + pad)::DOUBLE"
    r = "least(pad::DOUBLE, (w + 2 * pad)::DOUBLE / 2, (h + 2 * pad)::DOUBLE / 2)"
    arc = lambda a, b: f"' A' || {n(r)} || ' ' || {n(r)} || ' 0 0 1 ' || {n(a)} || ' ' || {n(b)}"
    line = lambda a, b: f"' L' || {n(a)} || ' ' || {n(b)}"
    return " || ".join((
        f"'M' || {n(f'{x0} + {r}')} || ' ' || {n(y0)}", line(f"{x1} - {r}", y0), arc(x1, f"{y0} + {r}"), line(x1, f"{y1} - {r}"), arc(f"{x1} - {r}", y1),
        line(f"{x0} + {r}", y1), arc(x0, f"{y1} - {r}"), line(x0, f"{y0} + {r}"), arc(f"{x0} + {r}", y0), "' Z'",
    ))


_PLATE = "'M' || {x0} || ' ' || {y0} || ' L' || {x1} || ' ' || {y0} || ' L' || {x1} || ' ' || {y1} || ' L' || {x0} || ' ' || {y1} || ' Z'"


@query(
    "plates_and_labels",
    f"""WITH {POINTS}, b AS (SELECT *, floor(lng)::BIGINT AS x, floor(lat)::BIGINT AS y, id % 40 AS w, id % 20 - 2 AS h, id % 4 AS pad, id % 3 AS mode FROM points),
u AS (SELECT *, CASE WHEN id % 5 > 0 THEN least(x, 0) ELSE x END AS ux, CASE WHEN id % 5 > 0 THEN greatest(x + w, 10) ELSE x + w END AS vx FROM b)
SELECT id, ux, vx, CASE WHEN mode = 1 AND w + 2 * pad > 0 AND h + 2 * pad > 0 THEN {_PLATE.format(x0='(x - pad)', x1='(x + w + pad)', y0='(y - pad)', y1='(y + h + pad)')} END AS sharp,
  CASE WHEN mode = 2 AND w + 2 * pad > 0 AND h + 2 * pad > 0 THEN {_round_plate()} END AS rounded, greatest(0, w - 5) + greatest(0, pad - 1) AS kept_r,
  (id % 2 = 0) <> (rank % 2 = 0) AS flipped, CASE WHEN id % 6 = 0 THEN 99::DOUBLE ELSE x + 0.6::DOUBLE * 5 * CASE WHEN (id % 2 = 0) <> (rank % 2 = 0) THEN -1 ELSE 1 END END AS label_x,
  CASE WHEN id % 9 = 0 THEN 'the loop is not joined to the body at all' ELSE printf('%.2f', (id % 16)::DOUBLE / 4) || 'mm' || CASE WHEN id % 2 = 0 THEN '+' ELSE '' END || ' of material joins the loop to the body (minimum 2.5mm)' END AS neck,
  CASE WHEN id % 3 > 0 THEN (id % 3) || ' problem' || CASE id % 3 WHEN 1 THEN '' ELSE 's' END || ' must be fixed before this can be exported' || CASE WHEN rank % 3 > 0 THEN ' (and ' || (rank % 3) || ' warning' || CASE rank % 3 WHEN 1 THEN '' ELSE 's' END || ')' ELSE '' END || '.'
    WHEN rank % 3 > 0 THEN 'Preflight passed with ' || (rank % 3) || ' warning' || CASE rank % 3 WHEN 1 THEN '' ELSE 's' END || ' · n.' ELSE 'Preflight passed all 9 checks · n.' END AS summary FROM u""",
)
def plates_and_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes joined, plates behind them, circles kept free, labels on one side of roads, and sentences on checks."""
    i, rank = F.col("id"), F.col("rank")
    p = points(spark, sf_dir).withColumns({"x": F.floor("lng"), "y": F.floor("lat"), "w": i % 40, "h": i % 20 - 2, "pad": i % 4})
    box = lambda a, b, c, d: F.struct(a.alias("min_x"), b.alias("min_y"), c.alias("max_x"), d.alias("max_y"))
    zero = F.lit(0).cast("long")
    p = p.withColumn("u", st.union_box(box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")), F.when(i % 5 > 0, box(zero, zero, zero + 10, zero + 10))))
    plate = lambda mode: st.plate_path(F.lit(mode), *(_D(c) for c in (F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"), F.col("pad"))))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    label = st.road_label_place(point(_D(F.col("x")), _D(F.col("y"))), point(F.lit(0.6), F.lit(0.8)), F.lit(5.0), rank % 2 == 0, i % 2 == 0, F.when(i % 6 == 0, point(F.lit(99.0), F.lit(99.0))))
    errors, warnings = i % 3, rank % 3
    return p.select(
        "id", F.col("u.min_x").alias("ux"), F.col("u.max_x").alias("vx"), F.when(i % 3 == 1, plate("rectangle")).alias("sharp"), F.when(i % 3 == 2, plate("offset")).alias("rounded"),
        st.keep_out(F.col("x"), F.col("y"), F.col("w") - 5, F.col("pad") - 1)["r"].cast("long").alias("kept_r"), label["flipped"].alias("flipped"), label["x"].alias("label_x"),
        st.neck_text(i % 9 != 0, _D(i % 16) / 4, i % 2 == 0, F.lit(2.5)).alias("neck"), st.findings_text(errors, warnings, F.lit(9), F.lit("n")).alias("summary"),
    )
