"""Queries of readers: answers, captures and settings are written in their formats from the points, some of them incomplete, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.lenses import POINTS, POLYLINES, points, polylines
from quern.plans.registry import query
from quern.sources import geo as readers


@query(
    "geocoder_answers",
    f"""WITH {POINTS}, p AS (SELECT *, ['nominatim', 'photon', 'census'][(id % 3 + 1)::INT] AS provider FROM points)
SELECT id, provider, 0 AS place, CASE provider WHEN 'nominatim' THEN id::VARCHAR WHEN 'photon' THEN 'o' || id ELSE 't' || id END AS answer, CASE provider WHEN 'photon' THEN name || ', ' || class ELSE name || ' "' || class || '"' END AS label, lng, lat,
  CASE provider WHEN 'nominatim' THEN lng - 1 WHEN 'photon' THEN lng - 2 END AS west, CASE provider WHEN 'nominatim' THEN lat + 1 WHEN 'photon' THEN lat + 2 END AS north FROM p
UNION ALL SELECT id, provider, 1, CASE provider WHEN 'nominatim' THEN 'n2' WHEN 'photon' THEN 'o2' ELSE 't2' END, CASE provider WHEN 'photon' THEN 'b' ELSE 'second' END, 0, 0, NULL, NULL FROM p WHERE id % 5 > 0""",
)
def geocoder_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of three geocoders as candidates: the first two that have a label and a place."""
    p = points(spark, sf_dir)
    text = lambda c: c.cast("string")
    lng, lat = F.col("lng"), F.col("lat")
    label = F.concat(F.col("name"), F.lit(' "'), F.col("class"), F.lit('"'))
    second = lambda a: F.when(F.col("id") % 5 > 0, F.array(a)).otherwise(F.slice(F.array(a), 1, 0))
    nominatim = lambda i, name, x, y, box: F.struct(i.alias("place_id"), name.alias("display_name"), text(y).alias("lat"), text(x).alias("lon"), F.transform(box, text).alias("boundingbox"))
    none = F.lit(None).cast("array<double>")
    rows = F.concat(
        F.array(nominatim(text(F.col("id")), label, lng, lat, F.array(lat - 1, lat + 1, lng - 1, lng + 1)), nominatim(F.lit("lost"), F.lit("nowhere"), F.lit(None).cast("double"), lat, none)),
        second(nominatim(F.lit("n2"), F.lit("second"), F.lit(0.0), F.lit(0.0), none)),
    )
    feature = lambda i, name, city, x, y, box: F.struct(F.struct(F.array(x, y).alias("coordinates")).alias("geometry"), F.struct(i.alias("osm_id"), name.alias("name"), F.lit("").alias("street"), city.alias("city"), name.alias("state"), box.alias("extent")).alias("properties"))
    features = F.concat(
        F.array(feature(F.concat(F.lit("o"), text(F.col("id"))), F.col("name"), F.col("class"), lng, lat, F.array(lng - 2, lat - 2, lng + 2, lat + 2))),
        second(feature(F.lit("o2"), F.lit("b"), F.lit("b"), F.lit(0.0), F.lit(0.0), none)),
    )
    match = lambda i, name, x, y: F.struct(name.alias("matchedAddress"), F.struct(x.alias("x"), y.alias("y")).alias("coordinates"), F.struct(i.alias("tigerLineId")).alias("tigerLine"))
    matches = F.concat(F.array(match(F.concat(F.lit("t"), text(F.col("id"))), label, lng, lat), match(F.lit("empty"), F.lit(""), lng, lat)), second(match(F.lit("t2"), F.lit("second"), F.lit(0.0), F.lit(0.0))))
    read = {
        "nominatim": (0, F.to_json(rows), readers.nominatim), "photon": (1, F.to_json(F.struct(features.alias("features"))), readers.photon),
        "census": (2, F.to_json(F.struct(F.struct(matches.alias("addressMatches")).alias("result"))), readers.census),
    }
    out = None
    for name, (k, json, reader) in read.items():
        part = reader(p.filter(F.col("id") % 3 == k).select(F.col("id").alias("key"), F.lit(name).alias("provider"), json.alias("json")), 2)
        out = part if out is None else out.unionByName(part)
    # Boxes are west, south, east, north.
    return out.select(F.col("id").alias("answer"), "provider", "place", "label", "lng", "lat", F.get("box", 0).alias("west"), F.get("box", 3).alias("north"), "key").withColumnRenamed("key", "id")


_LAYERS = ("water", "transportation", "place", "poi", "landcover")
_KINDS = ("Polygon", "MultiPolygon", "LineString", "MultiLineString", "Point", "MultiPoint")


@query(
    "captured_parts",
    f"""WITH {POLYLINES}, f AS (SELECT id, ['water', 'transportation', 'place', 'poi', 'landcover'][(id % 5 + 1)::INT] AS layer, ['Polygon', 'MultiPolygon', 'LineString', 'MultiLineString', 'Point', 'MultiPoint'][(id % 6 + 1)::INT] AS kind, line, CASE WHEN id % 4 > 0 THEN 'primary' END AS class FROM polylines),
k AS (SELECT *, CASE layer WHEN 'water' THEN 'water' WHEN 'transportation' THEN 'road' ELSE 'label' END AS of FROM f WHERE layer <> 'landcover' AND CASE layer WHEN 'water' THEN kind LIKE '%Polygon' WHEN 'transportation' THEN kind LIKE '%LineString' AND class IS NOT NULL ELSE kind LIKE '%Point' END)
SELECT id, of AS kind, part::INT AS part, class, CASE id % 3 WHEN 0 THEN 'Latin ' || id WHEN 1 THEN 'en ' || id END AS name, CASE WHEN id % 7 = 0 THEN 99 ELSE id % 7 END::INT AS rank, CASE part WHEN 0 THEN len(line) ELSE 2 END AS vertices FROM k, range(2) t(part) WHERE part = 0 OR kind LIKE 'Multi%'""",
)
def captured_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured features of several layers and kinds, of which some can't be used, as parts."""
    i = F.col("id")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (i % n + 1).cast("int"))
    text = lambda prefix: F.concat(F.lit(prefix), i.cast("string"))
    # Only a feature that has it holds a property.
    some = lambda when, key, value: F.when(when, F.create_map(F.lit(key), value)).otherwise(F.create_map().cast("map<string,string>"))
    named = F.map_concat(some(i % 4 > 0, "class", F.lit("primary")), some(i % 3 == 0, "name:latin", text(" Latin ")), some(i % 3 == 1, "name:en", text("en ")), some(i % 3 == 2, "name", F.lit("  ")), some(i % 7 > 0, "rank", (i % 7).cast("string")))
    many = F.col("geom_type").startswith("Multi")
    f = polylines(spark, sf_dir).select(i.alias("ix"), pick(_LAYERS, 5).alias("source_layer"), pick(_KINDS, 6).alias("geom_type"), named.alias("properties"), "line")
    f = f.withColumn("parts", F.when(many, F.array("line", F.slice("line", 1, 2))).otherwise(F.array("line")))
    out = readers.captured_features(f)
    return out.select(F.col("ix").alias("id"), "kind", "part", "class", "name", "rank", F.size("geometry").cast("long").alias("vertices"))


_MAP_LAYERS = ("water", "transportation", "transportation_name", "place", "building")
_CLASSES = ("motorway", "residential", "footway", "rail", "town", "island")
_OF_ROADS = "CASE class WHEN 'motorway' THEN 'motorway' WHEN 'residential' THEN 'minor' WHEN 'footway' THEN 'service' END"


@query(
    "map_features",
    f"""WITH {POLYLINES}, f AS (
  SELECT id, k, id * 2 + k AS ix, {list(_MAP_LAYERS)}[(id % 5 + 1)::INT] AS layer, {list(_KINDS)}[(id // 5 % 6 + 1)::INT] AS kind, {list(_CLASSES)}[(id // 7 % 6 + 1)::INT] AS class, CASE WHEN id % 4 > 0 THEN 'n' || id END AS name, line
  FROM polylines, range(2) t(k) WHERE k = 0 OR id % 3 > 0),
g AS (SELECT *, CASE layer WHEN 'water' THEN 'water' WHEN 'place' THEN 'place' ELSE 'road' END AS of FROM f WHERE layer <> 'building'),
h AS (SELECT *, CASE of WHEN 'road' THEN {_OF_ROADS} WHEN 'place' THEN CASE WHEN class = 'town' THEN class END END AS label FROM g)
SELECT of AS kind, ix, part::INT AS part, label AS class, CASE of WHEN 'road' THEN name WHEN 'place' THEN coalesce(name, '') END AS name, CASE part WHEN 0 THEN len(line) ELSE 2 END AS vertices FROM h, range(2) t(part)
WHERE (part = 0 OR kind LIKE 'Multi%') AND CASE of WHEN 'water' THEN kind LIKE '%Polygon' WHEN 'road' THEN kind LIKE '%LineString' AND label IS NOT NULL ELSE kind = 'Point' AND label IS NOT NULL END""",
)
def map_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered features of which a third come twice, as two tiles give them, and others differ in a property alone."""
    i = F.col("id")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    some = lambda when, key, value: F.when(when, F.create_map(F.lit(key), value)).otherwise(F.create_map().cast("map<string,string>"))
    f = polylines(spark, sf_dir).select(i.alias("feature_id"), F.lit("tiles").alias("source"), pick(_MAP_LAYERS, i).alias("source_layer"), pick(_KINDS, F.floor(i / 5)).alias("geom_type"), pick(_CLASSES, F.floor(i / 7)).alias("class"), "line")
    i = F.col("feature_id")
    f = f.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("ix", i * 2 + F.col("k"))
    named = F.map_concat(F.create_map(F.lit("class"), F.col("class")), some(i % 4 > 0, "name", F.concat(F.lit("n"), i.cast("string"))), some((F.col("k") == 1) & (i % 3 > 0), "tunnel", F.lit("1")))
    f = f.withColumns({"properties": named, "parts": F.when(F.col("geom_type").startswith("Multi"), F.array("line", F.slice("line", 1, 2))).otherwise(F.array("line"))})
    return readers.map_features(f).select("kind", "ix", "part", "class", "name", F.size("geometry").cast("long").alias("vertices"))


_SETTINGS = {"version": 2, "widthMm": 228.6, "heightMm": 228.6, "style": "plain", "labels": True}


@query(
    "saved_settings",
    f"""WITH {POINTS} SELECT id, 2 AS version, CASE WHEN id % 4 > 0 AND id % 3 > 0 AND id % 5 > 0 THEN (100 + id % 50)::DOUBLE ELSE 228.6 END AS "widthMm", 228.6::DOUBLE AS "heightMm",
  CASE WHEN id % 4 > 0 AND id % 5 > 0 THEN class ELSE 'plain' END AS style, NOT (id % 4 > 0 AND id % 5 > 0 AND id % 2 = 0) AS labels FROM points""",
)
def saved_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved settings over their defaults: fields may be missing, the version another, or the text broken."""
    i = F.col("id")
    made = F.to_json(F.struct(F.when(i % 4 > 0, 2).otherwise(1).alias("version"), F.when(i % 3 > 0, (100 + i % 50).cast("double")).alias("widthMm"), F.col("class").alias("style"), F.when(i % 2 == 0, F.lit(False)).alias("labels")))
    text = F.when(i % 5 > 0, made).otherwise(F.substring(made, 1, 12))
    saved = points(spark, sf_dir).select("id", text.alias("json"))
    return readers.project_settings(saved, "version int, widthMm double, heightMm double, style string, labels boolean", _SETTINGS)


@query(
    "gpx_branches",
    f"""WITH {POLYLINES} SELECT id, CASE id % 3 WHEN 0 THEN 'track' WHEN 1 THEN 'route' ELSE 'waypoints' END AS source, s::INT AS segment, CASE s WHEN 0 THEN len(line) ELSE 2 END AS points,
  list_sum(list_transform(CASE s WHEN 0 THEN line ELSE line[1:2] END, lambda p: p.x))::BIGINT AS sum_lng FROM polylines, range(2) t(s) WHERE s = 0 OR id % 3 = 0""",
)
def gpx_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GPX documents with tracks of several segments, one of a single point, or routes, or way points alone; tracks win over the others."""
    i = F.col("id")
    milli = lambda v: F.format_string("%.3f", v.cast("double") / 1000)

    def marks(tag: str, line: Column) -> Column:
        return F.array_join(F.transform(line, lambda p: F.concat(F.lit(f'<{tag} lat="'), milli(p["y"]), F.lit('" lon="'), milli(p["x"]), F.lit('"/>'))), "")

    line = F.col("line")
    segment = lambda part: F.concat(F.lit("<trkseg>"), marks("trkpt", part), F.lit("</trkseg>"))
    route = F.concat(F.lit("<rte>"), marks("rtept", line), F.lit("</rte>"))
    track = F.concat(F.lit("<trk>"), segment(line), segment(F.slice(line, 1, 1)), F.lit("</trk><trk>"), segment(F.slice(line, 1, 2)), F.lit("</trk>"))
    body = F.when(i % 3 == 0, F.concat(marks("wpt", line), track, route)).when(i % 3 == 1, F.concat(marks("wpt", line), route)).otherwise(marks("wpt", line))
    read = readers.gpx_segments(polylines(spark, sf_dir).select("id", F.concat(F.lit("<gpx>"), body, F.lit("</gpx>")).alias("xml")))
    total = F.aggregate("points", F.lit(0).cast("long"), lambda a, p: a + F.floor(p["lng"] * 1000 + 0.5))
    return read.select("id", "source", "segment", F.size("points").cast("long").alias("points"), total.alias("sum_lng"))
