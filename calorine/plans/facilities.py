"""Facilities from map extracts: types by precedence of tags, identities, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from calorine.functions.geo import albers, centroid, edges
from calorine.functions.parsing import canonical_json, clean_text, fallback_facility_id, osm_facility_id

GAS_NAME_WORDS = ("lng", "liquefied natural gas", "regasification", "gas terminal")
GEOMETRY_TYPES = ("Point", "Polygon", "MultiPolygon")
TYPES = ("REFINERY", "LNG_TERMINAL", "MINE", "POWER_PLANT", "INDUSTRIAL_AREA", "OTHER_INDUSTRIAL")


def tag(tags: Column, key: str) -> Column:
    return F.lower(clean_text(F.element_at(tags, key)))


def relevant(tags: Column) -> Column:
    """Whether an object's tags make it a candidate at all."""
    hit = tag(tags, "industrial").isNotNull() | tag(tags, "power").isin("plant", "generator") | tag(tags, "landuse").isin("industrial", "quarry") | tag(tags, "man_made").isin("works", "wastewater_plant", "storage_tank", "tank") | tag(tags, "content").isin("lng", "gas", "natural_gas")
    return F.coalesce(hit, F.lit(False))


def classify(tags: Column, name: Column) -> tuple[Column, Column]:
    """(facility_type, classification_confidence)."""
    industrial, power, landuse, man_made, content = (tag(tags, k) for k in ("industrial", "power", "landuse", "man_made", "content"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    gas = yes(industrial == "gas") | yes(content.isin("lng", "gas", "natural_gas")) | yes(man_made.isin("storage_tank", "tank"))
    named = F.lit(False)
    for w in GAS_NAME_WORDS:
        named = named | yes(F.contains(F.lower(name), F.lit(w)))
    other = industrial.isNotNull() | yes(man_made.isin("works", "wastewater_plant")) | power.isNotNull()
    kind = F.when(yes(industrial == "refinery"), "REFINERY").when(gas & named, "LNG_TERMINAL").when(yes(industrial == "mine") | yes(landuse == "quarry"), "MINE").when(yes(power == "plant"), "POWER_PLANT").when(yes(landuse == "industrial"), "INDUSTRIAL_AREA").when(other, "OTHER_INDUSTRIAL").otherwise("UNKNOWN")
    return kind, F.when(kind.isin("LNG_TERMINAL", "OTHER_INDUSTRIAL"), "medium").when(kind != "UNKNOWN", "high")


def normalize(raw: DataFrame) -> DataFrame:
    """raw(osm_id, osm_type, name, tags map, geometry_type, rings) as canonical facilities."""
    raw = raw.withColumn("name", F.coalesce(F.col("name"), F.element_at("tags", "name")))
    kind, confidence = classify(F.col("tags"), F.col("name"))
    es = edges(F.col("rings"))
    x, y = centroid(es, F.col("geometry_type").isin("Polygon", "MultiPolygon"))
    df = raw.withColumns({"facility_type": kind, "classification_confidence": confidence, "longitude": x, "latitude": y})
    found = F.coalesce(osm_facility_id("osm_type", "osm_id"), fallback_facility_id(F.col("latitude"), F.col("longitude"), F.col("name"), F.col("tags")))
    return df.withColumns({"facility_id": found, "facility_name": clean_text("name"), "operator": clean_text(F.element_at("tags", "operator")), "power_type": F.when(kind == "POWER_PLANT", tag(F.col("tags"), "plant:source")), "tags_json": canonical_json(F.col("tags"))}).drop("name")


def validate(facilities: DataFrame) -> DataFrame:
    """facilities with is_valid and rejection_reason (failed checks in fixed order, joined by '; ')."""
    fails = [
        (F.col("facility_id").isNull(), "missing facility_id"),
        (~F.coalesce(F.col("geometry_type").isin(*GEOMETRY_TYPES), F.lit(False)), "unsupported geometry"),
        (~F.coalesce(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180), F.lit(False)), "coordinates out of range"),
        (~F.col("facility_type").isin(*TYPES), "unknown facility type"),
    ]
    reason = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in fails])), "; ")
    return facilities.withColumn("rejection_reason", F.nullif(reason, F.lit(""))).withColumn("is_valid", F.col("rejection_reason").isNull())


def duplicates(facilities: DataFrame, order: str = "facility_id") -> DataFrame:
    """facilities with is_duplicate for all but the first row of a facility_id."""
    w = Window.partitionBy("facility_id").orderBy(order, "tags_json")
    return facilities.withColumn("is_duplicate", F.col("facility_id").isNotNull() & (F.row_number().over(w) > 1))


def ingest(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid facilities, rejected ones), of the candidates among raw objects."""
    checked = duplicates(validate(normalize(raw.where(relevant(F.col("tags"))))))
    good = F.col("is_valid") & ~F.col("is_duplicate")
    reason = F.concat_ws("; ", "rejection_reason", F.when(F.col("is_duplicate"), F.lit("duplicate facility_id")))
    return checked.where(good).drop("is_valid", "is_duplicate", "rejection_reason"), checked.where(~good).withColumn("rejection_reason", reason)


def counts(facilities: DataFrame, column: str = "facility_type", known: tuple[str, ...] = TYPES) -> DataFrame:
    return facilities.groupBy(F.when(F.col(column).isin(*known), F.col(column)).otherwise("OTHER").alias(column)).agg(F.count(F.lit(1)).alias("n"))


def projected_centre(facilities: DataFrame) -> DataFrame:
    x, y = albers(F.col("longitude"), F.col("latitude"))
    return facilities.withColumns({"x": x, "y": y})
