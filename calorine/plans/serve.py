"""Serving queries: filtered, sorted, paged events and facilities, histories and dashboard figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SORTS = ("risk_score", "event_start", "last_detection_at")


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    parts = [float(x) for x in text.split(",")]
    if len(parts) != 4 or parts[0] > parts[2] or parts[1] > parts[3]:
        raise ValueError("bbox must be min_lon,min_lat,max_lon,max_lat")
    return tuple(parts)


def filter_events(events: DataFrame, bbox: str | None = None, start: str | None = None, end: str | None = None, min_risk: float | None = None, max_risk: float | None = None, priorities: list[str] | None = None, is_active: bool | None = None, **equal) -> DataFrame:
    """Conjunction of the given filters; all are plain predicates that reach the scan."""
    for c, v in equal.items():
        if v is not None:
            events = events.where(F.col(c).isin(*v) if isinstance(v, list | tuple) else F.col(c) == v)
    if priorities:
        events = events.where(F.col("investigation_priority").isin(*priorities))
    if start:
        events = events.where(F.col("event_start") >= F.lit(start).cast("timestamp"))
    if end:
        events = events.where(F.col("event_start") <= F.lit(end).cast("timestamp"))
    if min_risk is not None:
        events = events.where(F.col("risk_score") >= min_risk)
    if max_risk is not None:
        events = events.where(F.col("risk_score") <= max_risk)
    if is_active is not None:
        events = events.where(F.col("is_active") == is_active)
    if bbox:
        w, s, e, n = parse_bbox(bbox)
        events = events.where(F.col("centroid_longitude").between(w, e) & F.col("centroid_latitude").between(s, n))
    return events


def sort_columns(sort_by: str | None = None, order: str = "desc") -> list[Column]:
    """By risk_score unless another column is named; equal risks by latest start; event_id decides."""
    by = sort_by or "risk_score"
    if by not in SORTS or order not in ("asc", "desc"):
        raise ValueError(f"sort by one of {SORTS}, asc or desc")
    first = F.desc_nulls_last(by) if order == "desc" else F.asc_nulls_last(by)
    return [first, *([F.desc_nulls_last("event_start")] if by == "risk_score" else []), F.asc("event_id")]


def page(df: DataFrame, by: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    size = min(max(size, 1), 500)
    return df.orderBy(*by).offset((max(number, 1) - 1) * size).limit(size)


def list_events(events: DataFrame, number: int = 1, size: int = 50, sort_by: str | None = None, order: str = "desc", **filters) -> DataFrame:
    return page(filter_events(events, **filters), sort_columns(sort_by, order), number, size)


def alerts(events: DataFrame, number: int = 1, size: int = 50, **filters) -> DataFrame:
    return list_events(events, number, size, priorities=["HIGH", "CRITICAL"], **filters)


def totals(df: DataFrame, size: int = 50) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total")).select("total", F.ceil(F.col("total") / size).alias("total_pages"))


def get_event(events: DataFrame, candidates: DataFrame, event_id: str) -> DataFrame:
    """The event with its candidates, in order of rank and distance."""
    own = candidates.where(F.col("event_id") == event_id).groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("candidate_rank", "distance_km", "facility_id", "spatial_relation"))).alias("candidates"))
    return events.where(F.col("event_id") == event_id).join(own, "event_id", "left")


def evidence(events: DataFrame, event_id: str) -> DataFrame:
    """Nested blocks by family; a score is NULL where its family is unavailable."""
    block = lambda ok, s: F.struct(F.col(ok).alias("available"), F.when(F.col(ok), F.col(s)).alias("score"))
    return events.where(F.col("event_id") == event_id).select("event_id", block("temporal_evidence_available", "temporal_score").alias("temporal"), block("infrastructure_evidence_available", "infrastructure_score").alias("infrastructure"), block("sta_domain_available", "sta_score").alias("sta"), block("environmental_domain_available", "environmental_score").alias("environmental"), "candidate_interpretation", "industrial_evidence_score")


def timeline(events: DataFrame, event_id: str) -> DataFrame:
    return events.where(F.col("event_id") == event_id).select("event_id", "event_start", "event_end", "observed_duration_hours", "detection_count", "mean_gap_hours", "max_gap_hours")


def list_facilities(facilities: DataFrame, number: int = 1, size: int = 50, facility_type: str | None = None, search: str | None = None, bbox: str | None = None) -> DataFrame:
    if facility_type:
        facilities = facilities.where(F.col("facility_type") == facility_type)
    if search:
        facilities = facilities.where(F.col("facility_name").ilike(f"%{search}%") | F.col("facility_id").ilike(f"%{search}%"))
    if bbox:
        w, s, e, n = parse_bbox(bbox)
        facilities = facilities.where(F.col("longitude").between(w, e) & F.col("latitude").between(s, n))
    return page(facilities, [F.asc_nulls_last("facility_name"), F.asc("facility_id")], number, size)


def facility_summary(events: DataFrame) -> DataFrame:
    """One row per facility in one aggregation: events, active ones, worst score, latest start."""
    return events.where("facility_id is not null").groupBy("facility_id").agg(F.count(F.lit(1)).alias("event_count"), F.count_if(F.col("investigation_priority").isin("HIGH", "CRITICAL")).alias("alert_count"), F.count_if(F.col("anomaly_status") == "ANOMALOUS").alias("anomalous_count"), F.max("risk_score").alias("max_risk_score"), F.max("event_start").alias("latest_event_start"))


def facility_history(events: DataFrame, facility_id: str, number: int = 1, size: int = 50) -> DataFrame:
    return list_events(events, number, size, facility_id=facility_id)


def dashboard_totals(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("facility_id").isNotNull()).alias("with_facility"), F.count_if(F.col("anomaly_status") == "ANOMALOUS").alias("anomalous"), F.count_if(F.col("investigation_priority").isin("HIGH", "CRITICAL")).alias("alerts"), F.count_if(F.col("persistence_label") == "PERSISTENT").alias("persistent"), F.min("event_start").alias("first_start"), F.max("event_end").alias("last_end"), F.max("risk_score").alias("max_risk_score"))


DISTRIBUTIONS = ("investigation_priority", "persistence_label", "anomaly_status", "facility_association_method", "candidate_interpretation", "facility_type")


def dashboard_distributions(events: DataFrame, columns: tuple[str, ...] = DISTRIBUTIONS) -> DataFrame:
    """(dimension, value, n) of all dimensions in one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")).alias("value")) for c in columns])
    return events.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))
