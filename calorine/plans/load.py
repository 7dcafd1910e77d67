"""Checked loads of stage outputs: rows with errors are told apart, keys are looked up, counts are reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from calorine.functions.parsing import clean_text, to_double, to_long, valid_lon_lat

SAMPLE = 50


def _first(*rules: tuple[Column, Column]) -> Column:
    out = F.lit(None).cast("string")
    for bad, text in reversed(rules):
        out = F.when(F.coalesce(bad, F.lit(True)), text).otherwise(out)
    return out


def _doubles(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """rows with error "duplicate key" on all but the first good row of a key."""
    w = Window.partitionBy(*key, F.col("error").isNull()).orderBy(order)
    return rows.withColumn("error", F.when(F.col("error").isNull() & (F.row_number().over(w) > 1), F.concat(F.lit("duplicate key "), F.concat_ws("/", *key))).otherwise(F.col("error")))


def checked_facilities(raw: DataFrame, order: str = "facility_id") -> DataFrame:
    """raw text rows, typed, with error: a missing id, a place out of range, a key that came before."""
    rows = raw.withColumns({"facility_id": clean_text("facility_id"), "latitude": to_double("latitude"), "longitude": to_double("longitude")})
    bad = ~valid_lon_lat("longitude", "latitude")
    return _doubles(rows.withColumn("error", _first((F.col("facility_id").isNull(), F.lit("missing facility_id")), (bad, F.concat(F.lit("invalid coordinates for "), "facility_id")))), ["facility_id"], order)


def checked_events(raw: DataFrame, order: str = "event_id") -> DataFrame:
    """raw text rows, typed, with error: a missing id, a centroid out of range, a risk beyond 0 to 100, a key that came before."""
    rows = raw.withColumns({"event_id": clean_text("event_id"), "centroid_latitude": to_double("centroid_latitude"), "centroid_longitude": to_double("centroid_longitude"), "risk_score": to_double("risk_score")})
    bad = ~valid_lon_lat("centroid_longitude", "centroid_latitude")
    risk = F.coalesce(~F.col("risk_score").between(0, 100), F.lit(False))
    error = _first((F.col("event_id").isNull(), F.lit("missing event_id")), (bad, F.concat(F.lit("invalid centroid coordinates for "), "event_id")), (risk, F.concat(F.lit("risk_score out of range for "), "event_id")))
    return _doubles(rows.withColumn("error", error), ["event_id"], order)


def checked_candidates(raw: DataFrame, events: DataFrame, facilities: DataFrame) -> DataFrame:
    """raw text rows, typed, with error: missing ids, ids that the loaded events or facilities lack, a bad rank, a pair that came before."""
    rows = raw.withColumns({"event_id": clean_text("event_id"), "facility_id": clean_text("facility_id"), "candidate_rank": to_long("candidate_rank"), "distance_km": to_double("distance_km")})
    rows = rows.join(events.select("event_id").distinct().withColumn("__e", F.lit(True)), "event_id", "left").join(facilities.select("facility_id").distinct().withColumn("__f", F.lit(True)), "facility_id", "left")
    error = _first((F.col("event_id").isNull() | F.col("facility_id").isNull(), F.lit("missing key")), (F.col("__e").isNull(), F.concat(F.lit("unknown event "), "event_id")), (F.col("__f").isNull(), F.concat(F.lit("unknown facility "), "facility_id")), (F.col("candidate_rank") < 1, F.lit("invalid rank")))
    return _doubles(rows.withColumn("error", error).drop("__e", "__f"), ["event_id", "facility_id"], "candidate_rank")


def good(checked: DataFrame) -> DataFrame:
    return checked.where("error is null").drop("error")


def counters(checked: DataFrame) -> DataFrame:
    """One row: rows received, inserted, rejected, and of these duplicates."""
    return checked.agg(F.count(F.lit(1)).alias("received"), F.count_if(F.col("error").isNull()).alias("inserted"), F.count_if(F.col("error").isNotNull()).alias("rejected"), F.count_if(F.col("error").startswith("duplicate key")).alias("duplicates"))


def rejections(checked: DataFrame, n: int = SAMPLE) -> DataFrame:
    """The first n errors, as a sample for the report."""
    return checked.where("error is not null").select("error").orderBy("error").limit(n)


def replace_all(facilities: DataFrame, events: DataFrame, candidates: DataFrame, folder: str) -> dict:
    """Check and write the three tables in order of their keys, each in place of what was there, read them again and compare counts."""
    spark, out = facilities.sparkSession, {}
    tables: dict[str, DataFrame] = {}
    for name, raw in (("facilities", facilities), ("events", events), ("candidates", candidates)):
        checked = checked_candidates(raw, tables["events"], tables["facilities"]) if name == "candidates" else checked_facilities(raw) if name == "facilities" else checked_events(raw)
        good(checked).write.mode("overwrite").parquet(f"{folder}/{name}")
        tables[name] = spark.read.parquet(f"{folder}/{name}")
        counts = counters(checked).first().asDict()
        there = tables[name].count()
        if there != counts["inserted"]:
            raise RuntimeError(f"{name}: {there} rows written, {counts['inserted']} expected")
        out[name] = counts | {"rejections": [r[0] for r in rejections(checked).collect()]}
    return out


def point(lon: Column, lat: Column) -> Column:
    """A GeoJSON point, or NULL without both coordinates."""
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))


def degrees_for_km(km: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees of latitude and longitude that km span at a latitude; the cosine counts as 0.2 at least."""
    return km / F.lit(111.0), km / (F.lit(111.0) * F.greatest(F.cos(F.radians(lat)), F.lit(0.2)))


def source_version(df: DataFrame) -> DataFrame:
    """(file, modified) of the files behind a frame that was read from files."""
    return df.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("modified")).distinct()


def without_parent(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """rows with key set to NULL where no parent has it."""
    known = parents.select(F.col(key).alias("__known")).distinct()
    return rows.join(known, rows[key] == F.col("__known"), "left").withColumn(key, F.when(F.col("__known").isNotNull(), F.col(key))).drop("__known")


def merged(frames: list[DataFrame], key: str = "event_id") -> DataFrame:
    """Evidence frames side by side by key: every event of the first, columns of the first frame that has them."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f.select(key, *[c for c in f.columns if c not in out.columns]), key, "left")
    return out
