"""Readers and writers: detection CSVs, map extracts, facility layers, reports, key-wise merges."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from calorine.functions.geo import parse_wkt, point_rings, wkt_type
from calorine.functions.parsing import clean_text, observation_hash, require_columns, split_osm_id, to_double, to_map
from calorine.plans.clean import RAW_COLUMNS


def text_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """CSV with every column as text, and source_file."""
    if not paths:
        raise ValueError("no input files")
    df = spark.read.option("header", True).option("inferSchema", False).csv(paths)
    return df.withColumn("source_file", F.element_at(F.split("_metadata.file_path", "/"), -1))


def detections_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return require_columns(text_csv(spark, paths), RAW_COLUMNS)


def nrt_rows(df: DataFrame, product: str) -> DataFrame:
    """Near-real-time rows: trimmed headers, `type` optional, all text, hash and source name."""
    df = df.toDF(*[c.strip() for c in df.columns])
    if "type" not in df.columns:
        df = df.withColumn("type", F.lit(None).cast("string"))
    df = require_columns(df, RAW_COLUMNS).select(*[F.col(c).cast("string").alias(c) for c in RAW_COLUMNS])
    return df.withColumns({"source_file": F.lit(f"firms_nrt_{product.lower()}"), "observation_hash": observation_hash()})



def geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features as osm_type, osm_id, name, tags, geometry_type, rings (rings from the coordinates' text)."""
    schema = T.StructType([T.StructField("features", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]))])))])
    raw = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    # Innermost lists of pairs: "[[a,b],[c,d]]" runs between doubled brackets; a bare pair is a point.
    coords = F.regexp_replace(F.col("f.geometry.coordinates"), r"\s", "")
    bare = F.when(F.col("f.geometry.type") == "Point", F.concat(F.lit("[["), F.regexp_replace(coords, r"^\[|\]$", ""), F.lit("]]"))).otherwise(coords)
    runs = F.regexp_extract_all(bare, F.lit(r"\[(\[[-0-9.eE,+]+\](?:,\[[-0-9.eE,+]+\])*)\]"), F.lit(1))
    pair = lambda t: F.split(F.regexp_replace(t, r"[\[\]]", ""), ",")
    rings = F.transform(runs, lambda r: F.transform(F.split(r, r"\],\["), lambda t: F.struct(F.get(pair(t), F.lit(0)).cast("double").alias("x"), F.get(pair(t), F.lit(1)).cast("double").alias("y"))))
    tags = F.col("f.properties")
    kind, number = split_osm_id(F.coalesce(F.col("f.id"), F.element_at(tags, "@id"), F.element_at(tags, "id")))
    return raw.select(F.coalesce(clean_text(F.element_at(tags, "osm_type")), kind).alias("osm_type"), F.coalesce(clean_text(F.element_at(tags, "osm_id")), number).alias("osm_id"), clean_text(F.element_at(tags, "name")).alias("name"), tags.alias("tags"), F.col("f.geometry.type").alias("geometry_type"), rings.alias("rings"))


def osm_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV of map objects: geometry_wkt or latitude/longitude; tags as JSON or one column each."""
    df = text_csv(spark, path)
    lat, lon = (to_double(c) if c in df.columns else F.lit(None).cast("double") for c in ("latitude", "longitude"))
    wkt = F.col("geometry_wkt") if "geometry_wkt" in df.columns else F.lit(None).cast("string")
    own = [c for c in df.columns if c not in ("osm_id", "osm_type", "name", "latitude", "longitude", "geometry_wkt", "tags", "source_file")]
    flat = F.map_filter(F.create_map(*[x for c in own for x in (F.lit(c), clean_text(c))]), lambda k, v: v.isNotNull()) if own else F.create_map().cast("map<string,string>")
    tags = F.coalesce(to_map("tags"), flat) if "tags" in df.columns else flat
    kind = F.when(parse_wkt(wkt).isNotNull(), F.initcap(wkt_type(wkt))).otherwise("Point")
    kind = F.when(kind == "Multipolygon", "MultiPolygon").otherwise(kind)
    return df.select("osm_type", "osm_id", clean_text("name").alias("name"), tags.alias("tags"), kind.alias("geometry_type"), F.coalesce(parse_wkt(wkt), F.when(lat.isNotNull() & lon.isNotNull(), point_rings(lon, lat))).alias("rings"))


def osm_extract(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith((".geojson", ".json")):
        return geojson(spark, path)
    if path.endswith(".csv"):
        return osm_csv(spark, path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {path}: export it to GeoJSON, CSV or Parquet")


def ways_from_nodes(nodes: DataFrame, way_nodes: DataFrame, tags: DataFrame) -> DataFrame:
    """Objects from exported nodes(id, lat, lon), way_nodes(way_id, seq, node_id) and tags(way_id, tags): closed ways of four points or more are polygons."""
    joined = way_nodes.join(nodes, way_nodes["node_id"] == nodes["id"]).groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("p"))
    points = F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))
    closed = (F.size("p") >= 4) & (F.get("p", F.lit(0))["x"] == F.element_at("p", -1)["x"]) & (F.get("p", F.lit(0))["y"] == F.element_at("p", -1)["y"])
    return joined.join(tags, "way_id").select(F.lit("way").alias("osm_type"), F.col("way_id").cast("string").alias("osm_id"), F.element_at("tags", "name").alias("name"), "tags", F.when(closed, "Polygon").otherwise("LineString").alias("geometry_type"), F.array(points).alias("rings"))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_geojson(facilities: DataFrame, path: str) -> None:
    """One feature per line."""
    coords = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    geometry = F.when(F.col("geometry_type") == "Point", F.to_json(F.struct("geometry_type", coords[0][0].alias("c")))).otherwise(F.to_json(F.struct("geometry_type", coords.alias("c"))))
    geometry = F.regexp_replace(F.regexp_replace(geometry, '"geometry_type":', '"type":'), '"c":', '"coordinates":')
    props = F.to_json(F.struct(*[c for c in facilities.columns if c not in ("rings", "tags")]))
    facilities.select(F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), props, F.lit("}")).alias("value")).write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str) -> dict:
    """A one-row aggregate as JSON, NaN as null; returns it."""
    row = df.first().asDict(recursive=True)
    text = json.dumps({k: None if isinstance(v, float) and v != v else v for k, v in row.items()}, default=str)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return json.loads(text)


def new_rows(incoming: DataFrame, stored: DataFrame, key: str = "observation_hash") -> DataFrame:
    """Rows whose key is not stored yet, once each."""
    return incoming.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new put in by key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)
