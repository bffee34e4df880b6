"""Queries of the scalar functions on the point, depth and text lenses. Transcendental results are rounded to whole units before they are compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import scalars as sc
from quern.operators import grid as g
from quern.plans.lenses import DEPTHS, POINTS, depths, points, table
from quern.plans.registry import query

_NANO = lambda c: F.floor(c * 1e9 + 0.5)
# Rounded to 1e-7 with an offset, which keeps values off half-way points.
_TENTH = lambda c: F.floor(c * 1e7 + 0.26)


_Y = "(1 - ln(tan(phi) + 1 / cos(phi)) / pi()) / 2"


@query("mercator_project", f"WITH {POINTS} SELECT id, floor((lng + 180) / 360 * 1e7 + 0.26)::BIGINT AS x, floor({_Y} * 1e7 + 0.26)::BIGINT AS y FROM (SELECT *, greatest(-85.051129::DOUBLE, least(85.051129::DOUBLE, lat)) * pi() / 180 AS phi FROM points)")
def mercator_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("id", _TENTH(sc.mercator_x(F.col("lng"))).alias("x"), _TENTH(sc.mercator_y(F.col("lat"))).alias("y"))


@query("mercator_roundtrip", f"WITH {POINTS} SELECT id, floor(lng * 1e7 + 0.26)::BIGINT AS lng, floor(lat * 1e7 + 0.26)::BIGINT AS lat FROM points")
def mercator_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("id", _TENTH(sc.lng_of(sc.mercator_x(F.col("lng")))).alias("lng"), _TENTH(sc.lat_of(sc.mercator_y(F.col("lat")))).alias("lat"))


@query(
    "tile_plan",
    f"""WITH {POINTS}, q AS (SELECT id, (1 << least(14, greatest(5, rank % 18)))::BIGINT AS n, least(14, greatest(5, rank % 18))::INT AS z, lng, greatest(-85.051129::DOUBLE, least(85.051129::DOUBLE, lat)) * pi() / 180 AS phi FROM points),
t AS (SELECT id, z, n, floor((lng + 180) / 360 * n)::BIGINT AS x, floor({_Y} * n)::BIGINT AS y FROM q)
SELECT id, z, ((x + dx) % n + n) % n AS x, y + dy AS y FROM t, range(-1, 2) a(dx), range(-1, 2) b(dy) WHERE y + dy BETWEEN 0 AND n - 1""",
)
def tile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tile of each point and the ring of tiles around it; columns wrap, rows end at the poles."""
    p = points(spark, sf_dir).withColumn("z", sc.tile_zoom(F.col("rank") % 18))
    n = F.pow(F.lit(2.0), F.col("z")).cast("long")
    at = p.withColumn("n", n).select("id", "z", "n", F.floor(sc.mercator_x(F.col("lng")) * F.col("n")).alias("x"), F.floor(sc.mercator_y(F.col("lat")) * F.col("n")).alias("y"))
    ring = at.withColumn("x", F.explode(F.sequence(F.col("x") - 1, F.col("x") + 1))).withColumn("y", F.explode(F.sequence(F.greatest(F.lit(0), F.col("y") - 1), F.least(F.col("n") - 1, F.col("y") + 1))))
    return ring.select("id", "z", sc.wrap(F.col("x"), F.col("n")).alias("x"), "y")


@query("terrarium_decode", f"WITH {POINTS}, c AS (SELECT id, id * 31 % 256 AS r, id * 17 % 256 AS g, id * 7 % 256 AS b FROM points) SELECT id, greatest(-11500, least(9000, r * 256.0::DOUBLE + g + b / 256.0::DOUBLE - 32768)) AS elevation, (r * 256.0::DOUBLE + g + b / 256.0::DOUBLE - 32768 NOT BETWEEN -11500 AND 9000) AS clamped FROM c")
def terrarium_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = points(spark, sf_dir).select("id", *[(F.col("id") * k % 256).alias(n) for k, n in ((31, "r"), (17, "g"), (7, "b"))])
    e = sc.elevation(F.col("r"), F.col("g"), F.col("b"))
    return c.select("id", sc.clamp(e, -11500.0, 9000.0).alias("elevation"), (~e.between(-11500.0, 9000.0)).alias("clamped"))


def _times(a: str, k: int) -> str:
    return f"(({a})::HUGEINT * {k} % 4294967296)::BIGINT"


def _hash(x: str, y: str, seed: str) -> str:
    fold = lambda h, n: f"xor(({h}), ({h}) >> {n})"
    steps = [
        ("h0", _times(f"xor(({seed}) & 4294967295, {sc.SEED_SALT})", sc.MIX_A)),
        ("h1", f"xor(h0, {_times(f'({x}) & 4294967295', sc.LATTICE_X)})"),
        ("h2", _times(fold("h1", 15), sc.MIX_B)),
        ("h3", f"xor(h2, {_times(f'({y}) & 4294967295', sc.LATTICE_Y)})"),
        ("h4", _times(fold("h3", 13), sc.MIX_C)),
        ("h5", _times(fold("h4", 16), sc.MIX_A)),
        ("h6", fold("h5", 14)),
    ]
    return steps


def _hash_ctes(source: str, x: str, y: str, seed: str, name: str) -> str:
    out, last = [], source
    for k, (h, e) in enumerate(_hash(x, y, seed)):
        out.append(f"{name}{k} AS (SELECT *, {e} AS {h} FROM {last})")
        last = f"{name}{k}"
    return ", ".join(out)


@query("noise_hash", f"WITH {POINTS}, {_hash_ctes('points', 'id % 1000 - 500', 'rank - 3', 'id', 's')} SELECT id, h6 AS hash FROM s6")
def noise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("id", sc.noise_hash(F.col("id") % 1000 - 500, F.col("rank").cast("long") - 3, F.col("id")).alias("hash"))


@query(
    "value_noise",
    f"""WITH {POINTS}, q AS (SELECT id, lng / 4 AS x, lat / 4 AS y, floor(lng / 4)::BIGINT AS x0, floor(lat / 4)::BIGINT AS y0 FROM points), c AS (SELECT *, x0 + dx AS px, y0 + dy AS py FROM q, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) d(dx, dy)),
{_hash_ctes('c', 'px', 'py', '7', 's')}, v AS (SELECT id, x - x0 AS fx, y - y0 AS fy, max(CASE WHEN dx = 0 AND dy = 0 THEN h6 END) / 4294967296::DOUBLE AS a, max(CASE WHEN dx = 1 AND dy = 0 THEN h6 END) / 4294967296::DOUBLE AS b,
  max(CASE WHEN dx = 0 AND dy = 1 THEN h6 END) / 4294967296::DOUBLE AS c, max(CASE WHEN dx = 1 AND dy = 1 THEN h6 END) / 4294967296::DOUBLE AS d FROM s6 GROUP BY ALL),
t AS (SELECT id, a + (b - a) * (fx * fx * (3 - 2 * fx)) AS top, c + (d - c) * (fx * fx * (3 - 2 * fx)) AS bottom, fy * fy * (3 - 2 * fy) AS sy FROM v)
SELECT id, floor((top + (bottom - top) * sy) * 1e9 + 0.5)::BIGINT AS noise FROM t""",
)
def value_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("id", _NANO(sc.value_noise(F.col("lng") / 4, F.col("lat") / 4, F.lit(7).cast("long"))).alias("noise"))


def _fractal(source: str, x: str, y: str, seed: int, octaves: int, roughness: float, ridged: float, name: str) -> str:
    """CTEs that end in `name`: the rows of `source` (with an id) and a column `name` of octaves of value noise."""
    seeds = ", ".join(f"({k}, {sc.noise_word(k, 0x11, seed)})" for k in range(octaves))
    corner = lambda a, b: f"max(CASE WHEN dx = {a} AND dy = {b} THEN h6 END) / 4294967296::DOUBLE"
    weight = sum(roughness**k for k in range(octaves))
    return f"""{name}_o AS (SELECT id, k, s, ({x}) * (1 << k) + k * 0.3719::DOUBLE AS x, ({y}) * (1 << k) + k * 0.6173::DOUBLE AS y FROM {source}, (VALUES {seeds}) t(k, s)),
{name}_c AS (SELECT *, floor(x)::BIGINT AS x0, floor(y)::BIGINT AS y0, floor(x)::BIGINT + dx AS px, floor(y)::BIGINT + dy AS py FROM {name}_o, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) d(dx, dy)),
{_hash_ctes(f"{name}_c", "px", "py", "s", f"{name}_s")}, {name}_v AS (SELECT id, k, x - x0 AS fx, y - y0 AS fy, {corner(0, 0)} AS a, {corner(1, 0)} AS b, {corner(0, 1)} AS c, {corner(1, 1)} AS d FROM {name}_s6 GROUP BY ALL),
{name}_t AS (SELECT id, k, a + (b - a) * (fx * fx * (3 - 2 * fx)) AS top, c + (d - c) * (fx * fx * (3 - 2 * fx)) AS bottom, fy * fy * (3 - 2 * fy) AS sy FROM {name}_v),
{name}_n AS (SELECT id, k, top + (bottom - top) * sy AS v FROM {name}_t),
{name} AS (SELECT p.*, z.f AS {name} FROM {source} p JOIN (SELECT id, sum(pow({roughness}::DOUBLE, k) * (v + (pow(1 - abs(2 * v - 1), 2) - v) * {ridged}::DOUBLE)) / {weight}::DOUBLE AS f FROM {name}_n GROUP BY id) z USING (id))"""


_FINE = lambda c: F.floor(c * 1e9 + 0.26)


@query("fractal_noise", f"WITH {POINTS}, {_fractal('points', 'lng / 8', 'lat / 8', 1, 4, 0.5, 0.3, 'f')} SELECT id, floor(f * 1e9 + 0.26)::BIGINT AS noise FROM f")
def fractal_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("id", (F.col("lng") / 8).alias("x"), (F.col("lat") / 8).alias("y"))
    return g.fractal_noises(p, {"noise": g.Fractal("x", "y", 1, 4, 0.5, 0.3)}).select("id", _FINE(F.col("noise")).alias("noise"))


_TURN = "30 * pi() / 180"
_GRAIN = f"(lng / 8 * cos({_TURN}) + lat / 8 * sin({_TURN})) / 3 AS along, lat / 8 * cos({_TURN}) - lng / 8 * sin({_TURN}) AS across"


@query(
    "noise_sampler",
    f"""WITH {POINTS}, g AS (SELECT *, {_GRAIN} FROM points), uv AS (SELECT id, along * cos({_TURN}) - across * sin({_TURN}) AS u, along * sin({_TURN}) + across * cos({_TURN}) AS v FROM g),
{_fractal('uv', 'u * 0.5::DOUBLE', 'v * 0.5::DOUBLE', sc.noise_word(0, 0x35, 9), 2, 0.5, 0.0, 'wu')}, {_fractal('wu', 'u * 0.5::DOUBLE', 'v * 0.5::DOUBLE', sc.noise_word(0, 0x47, 9), 2, 0.5, 0.0, 'wv')},
b AS (SELECT id, u + (2 * wu - 1) * 0.8::DOUBLE AS u, v + (2 * wv - 1) * 0.8::DOUBLE AS v FROM wv), {_fractal('b', 'u', 'v', sc.noise_word(0, 0x23, 9), 3, 0.6, 0.5, 'm')},
k AS (SELECT id, m, (m - 0.5::DOUBLE) * 3 AS x FROM m) SELECT id, floor(m * 1e9 + 0.26)::BIGINT AS noise, floor(x / (1 + 2 * abs(x)) * 1e9 + 0.26)::BIGINT AS contrast FROM k""",
)
def noise_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise with a grain of half strength at 30 degrees, bent by 0.8 of a feature, and its contrast."""
    p = points(spark, sf_dir).select("id", (F.col("lng") / 8).alias("x"), (F.col("lat") / 8).alias("y"))
    p = g.sampled_noise(p, 9, 3, 0.6, 0.5, 0.8, 30.0, 0.5)
    return p.select("id", _FINE(F.col("noise")).alias("noise"), _FINE(sc.noise_contrast(F.col("noise"))).alias("contrast"))


_PROFILES = ("even-slope", "smooth-basin", "broad-shelf", "stepped-benches")


@query(
    "depth_profiles",
    f"""WITH {POINTS}, q AS (SELECT id, (id % 1025) / 1024::DOUBLE AS x FROM points), p AS (SELECT * FROM q, (VALUES {", ".join(f"('{n}')" for n in _PROFILES)}) n(name)),
u AS (SELECT *, CASE WHEN x <= 0.3::DOUBLE THEN 0 ELSE (x - 0.3::DOUBLE) / 0.7::DOUBLE END AS d, least(floor(x * 4), 3) AS b, x * 4 - least(floor(x * 4), 3) AS w FROM p),
r AS (SELECT id, name, x, CASE name WHEN 'even-slope' THEN x WHEN 'smooth-basin' THEN x * (2 - x) WHEN 'broad-shelf' THEN CASE WHEN x IN (0, 1) THEN x ELSE 0.18::DOUBLE * x + 0.82::DOUBLE * (d * d * (3 - 2 * d)) END
  ELSE CASE WHEN x IN (0, 1) THEN x ELSE (b + w * w * w * (w * (6 * w - 15) + 10)) / 4 END END AS v FROM u)
SELECT id, name, floor(v * 1e9 + 0.26)::BIGINT AS depth, floor(CASE WHEN v IN (0, 1) THEN v WHEN v < 0.25::DOUBLE THEN 0.15::DOUBLE * v / 0.25::DOUBLE ELSE 0.15::DOUBLE + 0.85::DOUBLE * (v - 0.25::DOUBLE) / 0.75::DOUBLE END * 1e9 + 0.26)::BIGINT AS shelf,
  floor(CASE WHEN v IN (0, 1) THEN v ELSE v * 4 / (1 + 3 * v) END * 1e9 + 0.26)::BIGINT AS bank,
  floor(CASE WHEN v <= 0 THEN v ELSE v + (greatest(1, least(6, floor(v * 6 + 0.5))) / 6::DOUBLE - v) * 0.5::DOUBLE END * 1e9 + 0.26)::BIGINT AS terraced FROM r""",
)
def depth_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = points(spark, sf_dir).select("id", F.explode(F.array(*map(F.lit, _PROFILES))).alias("name"), (F.col("id") % 1025 / F.lit(1024.0)).alias("x"))
    v = q.withColumn("v", sc.profile(F.col("name"), F.col("x")))
    nano = lambda c, n: F.floor(c * 1e9 + 0.26).alias(n)
    return v.select("id", "name", nano(F.col("v"), "depth"), nano(sc.shelf(F.col("v"), 0.25), "shelf"), nano(sc.bank(F.col("v"), 0.75), "bank"), nano(sc.terrace(F.col("v"), 6, 0.5), "terraced"))


@query(
    "depth_normalise",
    f"WITH {DEPTHS} SELECT body, source, unit, depth, floor((CASE WHEN regexp_matches(unit, '(?i)^m(eters?)?$') THEN depth WHEN regexp_matches(unit, '(?i)^(ft|feet|foot)$') THEN depth * 0.3048::DOUBLE END) * 1e6 + 0.5)::BIGINT AS micrometres, count(*) AS n FROM depths GROUP BY ALL",
)
def depth_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = depths(spark, sf_dir).withColumn("micrometres", F.floor(sc.to_metres(F.col("depth"), F.col("unit")) * 1e6 + 0.5))
    return d.groupBy("body", "source", "unit", "depth", "micrometres").agg(F.count("*").alias("n"))


_SLUG = "regexp_replace(regexp_replace(translate(lower({s}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(
    "text_scalars",
    f"""WITH t AS (SELECT doc_id, text AS s FROM documents), k AS (SELECT doc_id, s, regexp_replace(substr({_SLUG.format(s='s')}, 1, 48), '-+$', '') AS slug FROM t)
SELECT doc_id, CASE WHEN coalesce(slug, '') = '' THEN 'map' ELSE slug END AS slug, md5(trim(regexp_replace(s, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS query, regexp_matches(s, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]') AS control,
  md5(replace(replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS escaped FROM k""",
)
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", sc.slug(s, "map").alias("slug"), F.md5(sc.normalize_query(s)).alias("query"), sc.has_control_characters(s).alias("control"), F.md5(sc.escape_xml(s)).alias("escaped"))


@query(
    "tile_path_parse",
    f"""WITH {POINTS}, p AS (SELECT id, '/api/terrain/' || (id % 18) || '/' || (id * 37 % 40000) || '/' || (id * 91 % 40000) || CASE WHEN id % 11 = 0 THEN '.jpg' ELSE '.png' END AS path FROM points),
m AS (SELECT *, nullif(regexp_extract(path, '^/api/terrain/(\\d{{1,2}})/(\\d{{1,6}})/(\\d{{1,6}})\\.png$', 1), '')::INT AS z, nullif(regexp_extract(path, '^/api/terrain/(\\d{{1,2}})/(\\d{{1,6}})/(\\d{{1,6}})\\.png$', 2), '')::INT AS x,
  nullif(regexp_extract(path, '^/api/terrain/(\\d{{1,2}})/(\\d{{1,6}})/(\\d{{1,6}})\\.png$', 3), '')::INT AS y FROM p)
SELECT id, path, CASE WHEN ok THEN z END AS z, CASE WHEN ok THEN x END AS x, CASE WHEN ok THEN y END AS y FROM (SELECT *, z <= 15 AND x < (1 << least(z, 20)) AND y < (1 << least(z, 20)) AS ok FROM m)""",
)
def tile_path_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda k: (F.col("id") * k % 40000).cast("string")
    path = F.concat(F.lit("/api/terrain/"), (F.col("id") % 18).cast("string"), F.lit("/"), text(37), F.lit("/"), text(91), F.when(F.col("id") % 11 == 0, ".jpg").otherwise(".png"))
    p = points(spark, sf_dir).select("id", path.alias("path")).withColumn("t", sc.tile_of_path(F.col("path")))
    return p.select("id", "path", "t.z", "t.x", "t.y")
