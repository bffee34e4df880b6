"""Readers of map data: GeoJSON depth regions, GPX routes, captured features and geocoder answers.

They turn text columns into relations with from_json, from_xml and higher-order functions, so they read files, tables and
streams alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.scalars import to_metres

_COLLECTION = "type string, features array<struct<type: string, properties: struct<depth: double, depth_value: double, depth_unit: string, unit: string>, geometry: struct<type: string, coordinates: string>>>"
_FEATURE = "type string, properties struct<depth: double, depth_value: double, depth_unit: string, unit: string>, geometry struct<type: string, coordinates: string>"
_RINGS = "array<array<array<double>>>"


def depth_regions(df: DataFrame, json: str = "json") -> DataFrame:
    """(.., depth_m, polygons, regions): the polygons of GeoJSON features by depth in metres.

    A Feature counts as a collection of one. A depth without a known unit, a negative depth or a geometry that is no polygon
    raises an error, as a silently dropped region would be a hole in the map.
    """
    keys = [c for c in df.columns if c != json]
    whole = F.from_json(json, _COLLECTION)
    single = F.from_json(json, _FEATURE)
    features = F.when(whole["type"] == "FeatureCollection", whole["features"]).otherwise(F.array(F.struct(single["type"].alias("type"), single["properties"].alias("properties"), single["geometry"].alias("geometry"))))
    f = df.select(*keys, F.explode(features).alias("f"))
    p = F.col("f.properties")
    metres = to_metres(F.coalesce(p["depth"], p["depth_value"]), F.coalesce(p["unit"], p["depth_unit"], F.lit("")))
    kind = F.col("f.geometry.type")
    polygons = F.when(kind == "Polygon", F.array(F.from_json("f.geometry.coordinates", _RINGS))).when(kind == "MultiPolygon", F.from_json("f.geometry.coordinates", f"array<{_RINGS}>"))
    read = f.select(*keys, F.coalesce(metres, F.raise_error(F.lit("a depth region needs a depth and a unit of metres or feet")).cast("double")).alias("depth_m"), F.coalesce(polygons, F.raise_error(F.lit("a depth region needs polygons")).cast(f"array<{_RINGS}>")).alias("polygons"))
    return read.groupBy(*keys, "depth_m").agg(F.flatten(F.collect_list("polygons")).alias("polygons"), F.count("*").alias("regions"))


_POINT = "array<struct<_lat: string, _lon: string>>"
_GPX = f"trk array<struct<trkseg: array<struct<trkpt: {_POINT}>>>>, rte array<struct<rtept: {_POINT}>>, wpt {_POINT}"


def gpx_segments(df: DataFrame, xml: str = "xml") -> DataFrame:
    """(.., source, segment, points): the lines of GPX documents, from tracks, else routes, else way points.

    Lines of fewer than two points are left out; a coordinate that is missing or out of range raises an error.
    """
    keys = [c for c in df.columns if c != xml]
    doc = df.select(*keys, F.from_xml(F.col(xml), _GPX).alias("g"))
    none = F.array().cast(f"array<{_POINT}>")
    usable = lambda lines: F.filter(F.coalesce(lines, none), lambda s: F.size(s) >= 2)
    tracks = usable(F.flatten(F.transform("g.trk", lambda t: F.transform(t["trkseg"], lambda s: s["trkpt"]))))
    routes = usable(F.transform("g.rte", lambda r: r["rtept"]))
    points = usable(F.array("g.wpt"))
    pick = F.when(F.size(tracks) > 0, F.struct(F.lit("track").alias("source"), tracks.alias("lines"))).when(F.size(routes) > 0, F.struct(F.lit("route").alias("source"), routes.alias("lines"))).otherwise(F.struct(F.lit("waypoints").alias("source"), points.alias("lines")))
    lines = doc.select(*keys, pick.alias("p")).select(*keys, "p.source", F.posexplode("p.lines").alias("segment", "line"))

    def number(text: Column, most: int) -> Column:
        value = text.try_cast("double")
        return F.when(F.abs(value) <= most, value).otherwise(F.raise_error(F.lit("a GPX point is out of range")).cast("double"))

    return lines.select(*keys, "source", "segment", F.transform("line", lambda p: F.struct(number(p["_lon"], 180).alias("lng"), number(p["_lat"], 90).alias("lat"))).alias("points"))


#: Source layers of a vector tile that hold what a capture needs.
LAYERS = {"water": "water", "transportation": "road", "place": "label", "poi": "label"}


def captured_features(df: DataFrame) -> DataFrame:
    """(kind, ix, part, class, name, rank, geometry): the parts of captured features that can be used.

    `df` has ix, source_layer, geom_type, properties (a map) and parts (lines or rings). Multi-part geometries are split,
    and water that is no polygon or a road without a class is left out.
    """
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in LAYERS.items() for x in kv]), F.col("source_layer"))
    known = df.withColumn("kind", kind).filter("kind is not null")
    fits = F.when(F.col("kind") == "water", F.col("geom_type").isin("Polygon", "MultiPolygon")).when(F.col("kind") == "road", F.col("geom_type").isin("LineString", "MultiLineString") & F.col("properties")["class"].isNotNull()).otherwise(F.col("geom_type").isin("Point", "MultiPoint"))
    p = F.col("properties")
    name = F.coalesce(*[F.nullif(F.trim(F.try_element_at(p, F.lit(k))), F.lit("")) for k in ("name:latin", "name:en", "name")])
    return known.filter(fits).select("kind", "ix", F.posexplode("parts").alias("part", "geometry"), F.try_element_at(p, F.lit("class")).alias("class"), name.alias("name"), F.coalesce(F.try_element_at(p, F.lit("rank")).try_cast("int"), F.lit(99)).alias("rank"))


# Source layers of a map's tiles, the road class that each transport class counts as (rails, ferries and lifts are none), and the classes of places.
MAP_LAYERS = {"water": "water", "transportation": "road", "transportation_name": "road", "place": "place"}
ROAD_CLASSES = {
    "motorway": "motorway", "trunk": "trunk", "primary": "primary", "secondary": "secondary", "tertiary": "tertiary", "minor": "minor", "residential": "minor", "unclassified": "minor",
    "living_street": "minor", "service": "service", "track": "service", "path": "service", "footway": "service", "cycleway": "service", "pedestrian": "service", "bridleway": "service",
    "steps": "service", "busway": "service", "raceway": "service",
}
PLACE_CLASSES = ("city", "town", "village", "hamlet")


def map_features(df: DataFrame) -> DataFrame:
    """(kind, ix, part, class, name, geometry): the water, roads and places of rendered map features, each feature once.

    `df` has ix, source, source_layer, feature_id, geom_type, properties (a map) and parts (lines, rings or points). Neighbouring tiles give a feature several
    times: rows that agree in all but `ix` are one, and the first stays. They are grouped by a digest, combined before the shuffle, and only the
    digests and places are shuffled. Roads of a class that is no road's, places of other classes and geometries that don't fit are left out; a missing name of a place is empty.
    """
    layers = F.create_map(*(F.lit(x) for kv in MAP_LAYERS.items() for x in kv))
    roads = F.create_map(*(F.lit(x) for kv in ROAD_CLASSES.items() for x in kv))
    known = df.withColumn("kind", F.try_element_at(layers, F.col("source_layer"))).filter("kind is not null")
    properties = F.array_sort(F.map_entries(F.coalesce("properties", F.create_map().cast("map<string,string>"))))
    mark = F.sha2(F.to_json(F.struct("source", "source_layer", "feature_id", "geom_type", "parts", properties.alias("p"))), 256)
    first = known.groupBy(mark.alias("mark")).agg(F.min("ix").alias("first")).select("first")
    once = known.join(first, F.col("ix") == F.col("first"), "left_semi")
    given = F.try_element_at(F.col("properties"), F.lit("class"))
    label = F.when(F.col("kind") == "road", F.try_element_at(roads, given)).when((F.col("kind") == "place") & given.isin(*PLACE_CLASSES), given)
    fits = F.when(F.col("kind") == "water", F.col("geom_type").isin("Polygon", "MultiPolygon")).when(F.col("kind") == "road", F.col("geom_type").isin("LineString", "MultiLineString")).otherwise(F.col("geom_type") == "Point")
    name = F.try_element_at(F.col("properties"), F.lit("name"))
    out = once.withColumns({"class": label, "name": F.when(F.col("kind") == "place", F.coalesce(name, F.lit(""))).when(F.col("kind") == "road", name)})
    return out.filter(fits & ((F.col("kind") == "water") | F.col("class").isNotNull())).select("kind", "ix", F.posexplode("parts").alias("part", "geometry"), "class", "name").select("kind", "ix", "part", "class", "name", "geometry")


def _places(df: DataFrame, rows: Column, most: int) -> DataFrame:
    keys = [c for c in df.columns if c != "json"]
    out = df.select(*keys, F.posexplode(F.slice(F.filter(rows, lambda r: r["lng"].isNotNull() & r["lat"].isNotNull() & (r["label"] != "")), 1, most)).alias("place", "r"))
    return out.select(*keys, "place", "r.*")


def nominatim(df: DataFrame, most: int = 5) -> DataFrame:
    """(.., place, id, label, lng, lat, box): answers of Nominatim; its boxes come as south, north, west, east and leave as west, south, east, north."""
    rows = F.from_json("json", "array<struct<place_id: string, display_name: string, lat: string, lon: string, boundingbox: array<string>>>")
    num = lambda c: c.try_cast("double")
    one = lambda r: F.struct(r["place_id"].alias("id"), F.coalesce(r["display_name"], F.lit("")).alias("label"), num(r["lon"]).alias("lng"), num(r["lat"]).alias("lat"), F.transform(F.array(*[F.lit(k) for k in (2, 0, 3, 1)]), lambda k: num(F.get(r["boundingbox"], k))).alias("box"))
    return _places(df, F.transform(rows, one), most)


def photon(df: DataFrame, most: int = 5) -> DataFrame:
    """Answers of Photon; the label is the distinct parts of the address that are not empty."""
    doc = F.from_json("json", "features array<struct<geometry: struct<coordinates: array<double>>, properties: struct<osm_id: string, name: string, street: string, city: string, state: string, country: string, extent: array<double>>>>")
    parts = lambda p: F.array_join(F.array_distinct(F.filter(F.array(p["name"], p["street"], p["city"], p["state"], p["country"]), lambda x: F.coalesce(x, F.lit("")) != "")), ", ")
    one = lambda f: F.struct(f["properties"]["osm_id"].alias("id"), parts(f["properties"]).alias("label"), F.get(f["geometry"]["coordinates"], 0).alias("lng"), F.get(f["geometry"]["coordinates"], 1).alias("lat"), f["properties"]["extent"].alias("box"))
    return _places(df, F.transform(doc["features"], one), most)


def census(df: DataFrame, most: int = 5) -> DataFrame:
    """Answers of the census geocoder, which have no box."""
    doc = F.from_json("json", "result struct<addressMatches: array<struct<matchedAddress: string, coordinates: struct<x: double, y: double>, tigerLine: struct<tigerLineId: string>>>>")
    one = lambda a: F.struct(a["tigerLine"]["tigerLineId"].alias("id"), F.coalesce(a["matchedAddress"], F.lit("")).alias("label"), a["coordinates"]["x"].alias("lng"), a["coordinates"]["y"].alias("lat"), F.lit(None).cast("array<double>").alias("box"))
    return _places(df, F.transform(doc["result"]["addressMatches"], one), most)


def project_settings(df: DataFrame, schema: str, defaults: dict, json: str = "json") -> DataFrame:
    """Saved settings over their defaults, field by field; a text of another version gives the defaults."""
    keys = [c for c in df.columns if c != json]
    s = F.from_json(json, schema)
    return df.select(*keys, *[F.coalesce(F.when(s["version"] == defaults.get("version", 1), s[k]), F.lit(v)).alias(k) for k, v in defaults.items()])


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    return gpx_segments(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("xml")))


def read_depth_regions(spark: SparkSession, path: str) -> DataFrame:
    return depth_regions(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("json")))
