"""Stage inputs derived from the generic test tables, by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from calorine.functions.geo import box_rings, point_rings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DETECTIONS = {
    "det_id": "event_id",
    "acq_datetime": "cast(ts as timestamp)",
    "latitude": "8 + (user_id % 50) * 0.5 + (k % 4) * 0.05 + (k % 7) * 0.0005",
    "longitude": "70 + floor(user_id / 50.0) * 0.5 + (k % 5) * 0.0005",
    "frp": "value",
    "frp_valid": "coalesce(value >= 1, false)",
    "bright_ti4": "300 + value",
    "bright_ti5": "280 + value / 2",
    "confidence": "case when event_type = 'error' then 'l' when event_type = 'purchase' then 'h' else 'n' end",
    "daynight": "case when hour(ts) between 6 and 17 then 'D' else 'N' end",
    "site": "user_id * 4 + k % 4",
}


def _double(name: str, e: str) -> str:
    return f"cast({e} as double)" if name in ("latitude", "longitude", "bright_ti4", "bright_ti5") else e


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return rows.selectExpr(*[f"{_double(n, e)} as {n}" for n, e in DETECTIONS.items()])


DETECTIONS_SQL = "select " + ", ".join(f"{_double(n, e)} as {n}" for n, e in DETECTIONS.items()) + " from (select *, cast(json_extract_string(props, '$.k') as integer) as k from events)"


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from suppliers and points from customers."""
    types = F.array(*[F.lit(t) for t in ("REFINERY", "LNG_TERMINAL", "MINE", "POWER_PLANT", "INDUSTRIAL_AREA", "OTHER_INDUSTRIAL", "UNKNOWN")])
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as k", "s_name as facility_name", "s_nationkey as n")
    lat, lon = F.expr("cast(8 + (k % 50) * 0.5 + (k % 4) * 0.05 as double)"), F.expr("cast(70 + floor(k / 50.0) * 0.5 as double)")
    boxes = s.select(F.concat(F.lit("osm_way_"), F.col("k").cast("string")).alias("facility_id"), "facility_name", F.get(types, F.col("n") % 7).alias("facility_type"), F.lit("Polygon").alias("geometry_type"), box_rings(lon - 0.01, lat - 0.01, lon + 0.01, lat + 0.01).alias("rings"))
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey as k", "c_name as facility_name", "c_nationkey as n")
    plat, plon = F.expr("cast(8 + (k % 50) * 0.5 + (k % 11) * 0.02 as double)"), F.expr("cast(70 + floor((k % 150) / 50.0) * 0.5 + (k % 7) * 0.01 as double)")
    points = c.select(F.concat(F.lit("osm_node_"), F.col("k").cast("string")).alias("facility_id"), "facility_name", F.get(types, F.col("n") % 7).alias("facility_type"), F.lit("Point").alias("geometry_type"), point_rings(plon, plat).alias("rings"))
    return boxes.union(points)


#: Events with all columns that later stages read, from orders.
EVENTS = {
    "event_id": "concat('EVT_', lpad(cast(o_orderkey as string), 7, '0'))",
    "facility_id": "case when o_orderkey % 5 = 0 then null else concat('osm_way_', cast(o_custkey % 97 as string)) end",
    "facility_type": "case when o_orderkey % 5 = 0 then null when o_custkey % 97 % 4 = 0 then 'REFINERY' when o_custkey % 97 % 4 = 1 then 'POWER_PLANT' when o_custkey % 97 % 4 = 2 then 'INDUSTRIAL_AREA' else 'OTHER_INDUSTRIAL' end",
    "facility_association_method": "case when o_orderkey % 10 = 0 then 'NO_FACILITY_ASSOCIATION' when o_orderkey % 5 = 0 then 'AMBIGUOUS' when o_orderkey % 3 = 0 then 'WITHIN_FACILITY' when o_orderkey % 3 = 1 then 'NEAR_FACILITY' else 'INTERSECTS_FACILITY' end",
    "facility_attribution_confidence": "case when o_orderkey % 10 = 0 then 'NONE' when o_orderkey % 5 = 0 then 'LOW' when o_orderkey % 3 <> 1 then 'HIGH' when o_orderkey % 7 = 0 then 'LOW' else 'MEDIUM' end",
    "facility_distance_km": "case when o_orderkey % 5 = 0 then null else (o_orderkey % 41) * 0.1 end",
    "candidate_facility_ids": "case when o_orderkey % 10 = 0 then null else concat('osm_way_', cast(o_custkey % 97 as string), ',osm_way_', cast((o_custkey + 1) % 97 as string)) end",
    "event_start": "cast(o_orderdate as timestamp)",
    "event_end": "cast(o_orderdate as timestamp)",
    "detection_count": "o_orderkey % 23 + 1",
    "distinct_detection_days": "o_orderkey % 4 + 1",
    "observed_duration_hours": "(o_orderkey % 60) * 4.51373",
    "max_gap_hours": "(o_orderkey % 9) * 6.5",
    "day_detection_count": "o_orderkey % 3",
    "night_detection_count": "o_orderkey % 2",
    "peak_frp": "case when o_orderkey % 19 = 0 then null else floor(o_totalprice / 1000) * 0.5 end",
    "persistence_label": "case when o_orderkey % 29 = 0 then null when o_orderkey % 4 = 0 then 'PERSISTENT' when o_orderkey % 4 = 1 then 'RECURRING' when o_orderkey % 4 = 2 then 'SHORT_LIVED' else 'INSUFFICIENT_OBSERVATIONS' end",
    "anomaly_status": "case when o_orderkey % 6 = 0 then 'ANOMALOUS' when o_orderkey % 6 = 1 then 'ELEVATED' when o_orderkey % 6 < 4 then 'NORMAL' else 'INSUFFICIENT_HISTORY' end",
    "anomaly_score": "case when o_orderkey % 6 < 4 then (o_orderkey % 31) * 0.25 else null end",
    "anomaly_history_status": "case when o_orderkey % 6 < 4 then 'LIMITED_HISTORY' else 'INSUFFICIENT_HISTORY' end",
    "baseline_history_status": "case when o_custkey % 97 < 30 then 'ESTABLISHED_BASELINE' when o_custkey % 97 < 60 then 'LIMITED_HISTORY' when o_custkey % 97 < 80 then 'INSUFFICIENT_HISTORY' else 'NO_OBSERVATIONS' end",
    "sta_association_status": "case when o_orderkey % 11 = 0 then 'STA_ASSOCIATED' when o_orderkey % 11 = 1 then 'AMBIGUOUS' else 'NO_STA_ASSOCIATION' end",
    "sta_evidence_quality": "case when o_orderkey % 11 = 0 and o_orderkey % 2 = 0 then 'HIGH' when o_orderkey % 11 < 2 then 'LOW' else 'NONE' end",
    "sta_evidence_available": "o_orderkey % 11 < 2",
    "vegetation_available": "o_orderkey % 2 = 0",
    "vegetation_present": "o_orderkey % 8 = 0",
    "agriculture_available": "o_orderkey % 2 = 0",
    "agriculture_present": "o_orderkey % 14 = 0",
    "builtup_available": "o_orderkey % 2 = 0",
    "builtup_present": "o_orderkey % 4 = 0",
    "environmental_context_available": "o_orderkey % 2 = 0",
    "centroid_latitude": "8 + (o_orderkey % 600) * 0.04",
    "centroid_longitude": "70 + (o_orderkey % 500) * 0.04",
    "is_active": "o_orderkey % 2 = 1",
}
_DOUBLES = ("facility_distance_km", "observed_duration_hours", "max_gap_hours", "peak_frp", "anomaly_score", "centroid_latitude", "centroid_longitude")
_INTS = ("detection_count", "distinct_detection_days", "day_detection_count", "night_detection_count")


def _typed(n: str, e: str) -> str:
    return f"cast({e} as double)" if n in _DOUBLES else f"cast({e} as integer)" if n in _INTS else e


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{_typed(n, e)} as {n}" for n, e in EVENTS.items()])


EVENTS_SQL = "select " + ", ".join(f"{_typed(n, e)} as {n}" for n, e in EVENTS.items()) + " from orders"

#: Raw text rows with faults, from orders.
RAW = {
    "row_no": "o_orderkey",
    "latitude": "case when o_orderkey % 50 = 0 then '' when o_orderkey % 53 = 0 then 'abc' when o_orderkey % 47 = 0 then '95.5' else cast(8 + o_orderkey % 25 as string) end",
    "longitude": "case when o_orderkey % 61 = 0 then 'nan' else cast(70 + o_orderkey % 27 as string) end",
    "bright_ti4": "'330.5'",
    "scan": "'0.5'",
    "track": "'0.5'",
    "acq_date": "case when o_orderkey % 71 = 0 then 'bad' else cast(cast(o_orderdate as date) as string) end",
    "acq_time": "case when o_orderkey % 67 = 0 then '2475' else cast((o_orderkey % 24) * 100 + o_orderkey % 60 as string) end",
    "satellite": "'N20'",
    "instrument": "'VIIRS'",
    "confidence": "case when o_orderkey % 3 = 0 then ' N ' when o_orderkey % 3 = 1 then 'h' else '7' end",
    "version": "'2'",
    "bright_ti5": "'290.1'",
    "frp": "case when o_orderkey % 43 = 0 then '-1.5' when o_orderkey % 41 = 0 then '' else '2.5' end",
    "daynight": "case when o_orderkey % 2 = 0 then 'd' else 'N' end",
    "type": "'0'",
}


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fifth row comes twice."""
    rows = table(spark, sf_dir, "orders").selectExpr(*[f"{e} as {n}" for n, e in RAW.items()])
    return rows.union(rows.where("row_no % 5 = 0").withColumn("row_no", F.col("row_no") + 100_000_000))


RAW_SQL = f"select {', '.join(f'{e} as {n}' for n, e in RAW.items())} from orders"
RAW_SQL = f"select * from ({RAW_SQL}) union all select * replace (row_no + 100000000 as row_no) from ({RAW_SQL}) where row_no % 5 = 0"
