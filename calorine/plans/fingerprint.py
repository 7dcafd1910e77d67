"""Facility baselines from associated events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

FAMILIES = {"peak_frp": "peak_frp", "detection_count": "detection_count", "duration": "observed_duration_hours", "distance": "facility_distance_km"}
DAYNIGHT = ("DAY", "NIGHT", "MIXED", "UNKNOWN")
LABELS = ("PERSISTENT", "RECURRING", "SHORT_LIVED", "INSUFFICIENT_OBSERVATIONS")


def daynight(day: Column, night: Column) -> Column:
    return F.when((night == 0) & (day > 0), "DAY").when((day == 0) & (night > 0), "NIGHT").when((day > 0) & (night > 0), "MIXED").otherwise("UNKNOWN")


def history_status(n: Column) -> Column:
    return F.when(n == 0, "NO_OBSERVATIONS").when(n < 3, "INSUFFICIENT_HISTORY").when(n < 10, "LIMITED_HISTORY").otherwise("ESTABLISHED_BASELINE")


def fingerprints(events: DataFrame, facilities: DataFrame) -> DataFrame:
    """One row per facility: totals, robust statistics of four families, shares of classes, ambiguity, status."""
    own = events.where("facility_id is not null")
    per = Window.partitionBy("facility_id")
    own = own.withColumns({f"{k}_m": F.median(c).over(per) for k, c in FAMILIES.items()})
    n = F.count(F.lit(1))
    aggs = [n.cast("int").alias("event_count"), F.sum("detection_count").cast("long").alias("total_detections"), F.sum("distinct_detection_days").cast("long").alias("observation_day_count"), F.min("event_start").alias("first_event_start"), F.max("event_end").alias("last_event_end"), (F.datediff(F.to_date(F.max("event_end")), F.to_date(F.min("event_start"))) + 1).alias("observation_span_days"), F.count_distinct(F.month("event_start")).cast("int").alias("active_months")]
    for k, c in FAMILIES.items():
        v = F.col(c).cast("double")
        q = lambda x, v=v: F.percentile(v, F.lit(x))
        aggs += [q(0.5).alias(f"{k}_median"), F.median(F.abs(v - F.col(f"{k}_m"))).alias(f"{k}_mad"), q(0.25).alias(f"{k}_p25"), q(0.75).alias(f"{k}_p75"), q(0.9).alias(f"{k}_p90"), F.max(v).alias(f"{k}_max")]
    classes = [("daynight", daynight(F.col("day_detection_count"), F.col("night_detection_count")), DAYNIGHT), ("label", F.col("persistence_label"), LABELS), ("method", F.col("facility_association_method"), ("WITHIN_FACILITY", "INTERSECTS_FACILITY", "NEAR_FACILITY")), ("confidence", F.col("facility_attribution_confidence"), ("HIGH", "MEDIUM", "LOW"))]
    for k, c, values in classes:
        for x in values:
            hits = F.count_if(F.coalesce(c == x, F.lit(False)))
            aggs += [hits.cast("int").alias(f"{k}_{x.lower()}_count"), (hits / n).alias(f"{k}_{x.lower()}_fraction")]
    stats = own.groupBy("facility_id").agg(*aggs)
    out = facilities.select("facility_id", "facility_name", "facility_type").join(stats, "facility_id", "left").join(ambiguous(events), "facility_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast(t)) for c, t in (("event_count", "int"), ("total_detections", "long"), ("observation_day_count", "long"), ("ambiguous_opportunity_count", "long"))})
    return out.withColumn("baseline_history_status", history_status(F.col("event_count")))


def ambiguous(events: DataFrame) -> DataFrame:
    """(facility_id, ambiguous_opportunity_count): ambiguous events that had the facility among their candidates."""
    rows = events.where("facility_association_method = 'AMBIGUOUS'").select(F.explode(F.split("candidate_facility_ids", ",")).alias("facility_id"))
    return rows.where("facility_id <> ''").groupBy("facility_id").agg(F.count(F.lit(1)).alias("ambiguous_opportunity_count"))


def monthly_profile(events: DataFrame) -> DataFrame:
    """(facility_id, month, event_count, detection_count, event_fraction)."""
    per = events.where("facility_id is not null and event_start is not null").groupBy("facility_id", F.month("event_start").alias("month")).agg(F.count(F.lit(1)).alias("event_count"), F.sum("detection_count").cast("long").alias("detection_count"))
    return per.withColumn("event_fraction", F.col("event_count") / F.sum("event_count").over(Window.partitionBy("facility_id")))
