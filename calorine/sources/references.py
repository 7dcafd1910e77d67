"""Reference labels from tables of any column names, in one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from calorine.functions.geo import centroid, edges
from calorine.functions.parsing import clean_text, to_boolean, to_double, to_utc
from calorine.operators.stdbscan import with_rank
from calorine.plans.validation import independent, normalize_label
from calorine.sources.readers import geojson, text_csv

#: Names under which a column may come; the first that has a value counts.
ALIASES = {
    "validation_id": ("validation_id", "id", "ref_id", "reference_id"),
    "reference_label_raw": ("reference_label_raw", "label", "reference_label", "class", "category"),
    "reference_source": ("reference_source", "source", "data_source"),
    "reference_date": ("reference_date", "date", "datetime", "acq_date", "event_date"),
    "reference_latitude": ("reference_latitude", "latitude", "lat", "y"),
    "reference_longitude": ("reference_longitude", "longitude", "lon", "lng", "x"),
    "reference_confidence": ("reference_confidence", "confidence"),
    "event_id": ("event_id",),
    "label_notes": ("label_notes", "notes"),
    "validation_source_independent": ("validation_source_independent", "independent"),
    "validation_label_verified": ("validation_label_verified", "verified"),
}


def read(spark: SparkSession, path: str) -> DataFrame:
    """CSV, Parquet or GeoJSON; of geometries the centre is latitude and longitude."""
    if path.endswith(".csv"):
        return text_csv(spark, path).drop("source_file")
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith((".geojson", ".json")):
        raw = geojson(spark, path)
        x, y = centroid(edges(F.col("rings")), F.col("geometry_type").isin("Polygon", "MultiPolygon"))
        keys = sorted({k for names in ALIASES.values() for k in names} - {"latitude", "longitude"})
        return raw.select(*[F.element_at("tags", k).alias(k) for k in keys], x.alias("longitude"), y.alias("latitude"))
    raise ValueError(f"no reader for {path}: export it to CSV, Parquet or GeoJSON")


def normalize(raw: DataFrame, source_name: str = "", required: bool = True) -> DataFrame:
    """raw as canonical references: ids val_000000 and on for rows without one (in order of all their values), labels normalised, independence by flag or else by source."""
    have = {c.lower(): c for c in raw.columns}

    def pick(name: str) -> Column:
        found = [clean_text(F.col(have[c])) for c in ALIASES[name] if c in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    rows = raw.select(*[pick(k).alias(k) for k in ALIASES], F.to_json(F.struct(*raw.columns)).alias("__row"))
    rows = with_rank(rows, ["__row"], "__n")
    source = F.coalesce("reference_source", F.lit(source_name))
    flag = to_boolean("validation_source_independent")
    return rows.select(
        F.coalesce("validation_id", F.format_string("val_%06d", F.col("__n") - 1)).alias("validation_id"),
        "event_id", "reference_label_raw", normalize_label("reference_label_raw").alias("reference_label_normalized"), "reference_source", source.alias("validation_source"),
        to_utc("reference_date").alias("reference_date"), to_double("reference_latitude").alias("reference_latitude"), to_double("reference_longitude").alias("reference_longitude"),
        "reference_confidence", "label_notes", F.coalesce(flag, independent(source, required)).alias("validation_source_independent"), F.coalesce(to_boolean("validation_label_verified"), F.lit(False)).alias("validation_label_verified"),
    )


def load(spark: SparkSession, path: str) -> DataFrame:
    return normalize(read(spark, path), path.rsplit("/", 1)[-1])
